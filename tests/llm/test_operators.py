"""The training-data operators on small tables: edge cases, and brute-force versions where SQL cannot state the result."""

import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from tallyhound.llm import html_main, hashing, line_dedup, mixing, ngram_jaccard, packing, quality_classifier, quality_rules, sharding, substring_dedup  # noqa: E402
from tallyhound.llm.embedding_forest import near_duplicate_vectors  # noqa: E402
from tallyhound.llm.graph import components  # noqa: E402
from tallyhound.llm.queries import tokenizer_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, kept string, pass string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (120, 80, 60, 30, 12)]
    out = [None, "", " \t\n", "one", "one two", "One  two", "x" * 5000, "éé \U0001f600 café " * 9, *base]
    for b in base:
        for k in (1, 2, 4):
            w = b.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = prose(rng, 1)
            out.append(" ".join(w))
    return [*out, base[0], base[0], base[1], prose(rng, 3000), base[2] + " " + prose(rng, 200), prose(rng, 150) + " " + base[2] + " tail here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4], 0, 7, "s", "k", "p") for i, t in enumerate(texts())]
    rows += [rows[8], (None, "one two three four five six", "en", "a", 0, 7, "s", "k", "p")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def smallest(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_ngram_jaccard_equals_all_pairs(spark, docs, empty):
    sets = [shingles(t) for t in texts()]
    linked = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = smallest(range(len(sets)), linked)
    got = [r for r in ngram_jaccard.near_duplicates(docs).collect() if r["doc_id"] is not None]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), want[i]) for i in want}
    assert len(got) == len(sets) + 1 and len(linked) > 15
    assert ngram_jaccard.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_is_kept(spark):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d = (prose(rng, 600) for _ in range(4))
    rows = [(1, a), (1, b), (2, b + " end"), (None, c), (None, c), (None, c + " end"), (None, a), (3, d), (3, d), (None, d), (4, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([x for x in got if x[0] is None] + [(1, a), (1, b), (3, d), (4, ""), (5, None)], key=str)
    assert len(got) == 6 and [t in (c, c + " end") for i, t in got if i is None] == [True]


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 1001: 1000}


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = spark.createDataFrame([(90, "a\x1cb \x1f c"), (91, "x \n\n y<|endoftext|> z  "), (92, "tabs\t\tand\r\n ends \n")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd)
    got = packing.pack(packing.tokenised_pieces(both, tokenizer_path())).collect()
    seen = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 2048 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
        seen.setdefault(r["doc_id"], {})[r["piece"]] = bytes(r["ids"])
    for r in both.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        assert b"".join(seen[r["doc_id"]][k] for k in sorted(seen[r["doc_id"]])) == np.array(ids, "<u4").tobytes()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for _, group in itertools.groupby(places, key=lambda p: p[0]):
        end = 0
        for _, offset, length in group:
            assert offset == end
            end += length
        assert end <= 2048
    assert len({p[0] for p in places}) <= sum(p[2] for p in places) // 2048 + 2
    assert packing.pack(packing.tokenised_pieces(empty, tokenizer_path())).count() == 0


def test_best_fit_plan_covers_every_piece():
    rng = np.random.Generator(np.random.PCG64(4))
    counts = np.zeros(2049, np.int64)
    for s, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 90, 300), strict=True):
        counts[s] += n
    counts[1] = 100_000
    plan, opened = packing.best_fit_plan(counts)
    filled = np.zeros(opened, np.int64)
    for s, rank, per, first, n, offset in plan[np.argsort(plan[:, 5], kind="stable")]:
        for k in range(-(-n // per)):
            filled[first + k] += s * min(per, n - k * per)
    assert (filled <= 2048).all() and filled.sum() == (counts * np.arange(2049)).sum()
    for s in np.flatnonzero(counts):
        own = sorted((r, n) for l, r, _, _, n, _ in plan if l == s)
        assert [r for r, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == counts[s]


def test_embedding_links_equal_all_pairs(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    centres = rng.standard_normal((20, 16))
    rows = []
    for i in range(600):
        v = centres[i % 20] + rng.standard_normal(16) * 0.12
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3)))
    rows += [(600, rows[0][1], 0), (601, rows[0][1], 1), (602, None, 0), (603, [0.0] * 16, 0), (604, [None, *[1.0] * 15], 0), (605, [float("nan")] * 16, 0), (606, rows[0][1], None), (607, [], 0), (608, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r for r in near_duplicate_vectors(df, leaf=64, trees=12).collect()}
    ok = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    assert len(got) == len(rows) and len(linked) > 500
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * 2 * len(linked)
    want = {i: sum(i in x for x in linked) for i, *_ in rows}
    assert all(r["n_links"] <= want[i] for i, r in got.items())
    roots = smallest([i for i, *_ in rows], linked)
    assert sum(got[i]["component_id"] == roots[i] for i in roots) >= 0.97 * len(roots)
    assert all(got[i]["component_id"] == i and got[i]["kept"] for i in range(602, 609))
    assert near_duplicate_vectors(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>a</ul></nav>
<div>Welcome to the site</div><div id=x><h2>{0} title</h2><p>Body&nbsp;of <i>{0}</i>&amp;co<br>more <p>Second {0}</div><form>q<input></form><!-- c --><div class="user-comments"><p>me too</p></div><div>Terms of use</div></body></html>"""


def test_pages_lose_what_their_neighbour_has(spark):
    rows = [(i, f"https://h.example/a/{i}", PAGE.format(f"n{i}"), "x") for i in range(4)]
    rows += [(10, None, None, "x"), (11, "odd url", "", "x"), (12, "https://o.example/z", "<article><header>by me<h1>Head</h1></header><p>Text &lt;b&gt; <script>1</p></script>end<nav>m</nav></article><p>out</p>", "x"),
             (13, "https://o.example/z2", "<p>cut off <b>here <a hre", "x"), (14, "https://h.example/a/0", PAGE.format("n0"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r["page_id"]: r for r in html_main.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(1, 4):
        assert got[i]["text"] == f"n{i} title\n\nBody of n{i}&co more\n\nSecond n{i}"
    assert got[10]["text"] == got[11]["text"] == "" and got[10]["n_chars"] == 0
    assert got[12]["text"] == "Head\n\nText <b> end" and got[13]["text"] == "cut off here"
    assert html_main.main_text(df.limit(0)).count() == 0


def test_pages_lose_shared_lines_inside_articles(spark):
    """The pair decides inside an article and outside it; a near copy of a page decides nothing."""
    page = "<p>By the {0} desk</p><article><h1>{0} head</h1><p>{0} body of some length</p><p>Share this</p></article><div>Terms</div>"
    rows = [(i, f"https://h.example/{n}", page.format(n)) for i, n in enumerate(("alpha", "beta"))]
    rows += [(i, f"https://c.example/{i}", f"<article><p>a long text that both copies hold</p><p>seen {i}</p></article><p>foot</p>") for i in (5, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: r["text"] for r in html_main.main_text(df).collect()}
    for i, n in enumerate(("alpha", "beta")):
        assert got[i] == f"By the {n} desk\n\n{n} head\n\n{n} body of some length"
    assert got[5] == "a long text that both copies hold\n\nseen 5" and got[6] == "a long text that both copies hold\n\nseen 6"


def test_chrome_ends_where_its_element_ends():
    def content(page):
        return [x for x, kind in html_main.page_lines(page) if kind == html_main.CONTENT]

    for wrapper in ("class='container no-sidebar'", "id='search-results'", "class='page sidebar'", "class='widget'"):
        assert content(f"<div {wrapper}><nav>m</nav><article class='post has-comments'><div class='article-header'><h1>Head</h1></div><p>Text</article></div>") == ["Head", "Text"]
    assert content("<form><div class=header><article class=notice><p>Text</p></article></div></form>") == ["Text"]
    assert content("<article><p class='notice'>n<p>One<p>Two</article><article><p>Three</article>") == ["One", "Two", "Three"]
    assert content("<article><ul><li class='share'>s<li>One<ul><li>In</ul><li class=share>s</ul><p>Two</article>") == ["One", "In", "Two"]
    assert content("<article><p>One</p><section class=comments><p>c</article><p>out") == ["One"]
    assert content("<main><p>One</main><div class='comments'><article>c</article></div>") == ["One"]
    assert content("<article>a <span class=share>s <b>t</span> b</article>") == ["a b"]
    assert content("<b><article><p>One</b> two <a class=share>s</a>three</article>") == ["One two three"]
    assert content("<article hidden>h</article><div class='ad-banner'>x</div><div class='user-comments'><p>y</div>") == []


def test_copies_of_a_page_lose_its_template(spark):
    """Copies at any number of addresses meet the next page that differs."""
    rows = [(i, f"https://h.example/a/{i}", PAGE.format(f"n{i}")) for i in range(4)] + [(14, "https://h.example/a/0", PAGE.format("n0")), (15, "https://h.example/a/0?p=2", PAGE.format("n0"))]
    # Three pages in a row of which each holds all of the one before
    rows += [(20 + i, f"https://s.example/b/{i}", "<div>menu</div><p>one</p>" + "<p>two</p>" * (i > 0) + "<p>three</p>" * (i > 1)) for i in range(3)]
    rows += [(23, "https://s.example/c", "<div>menu</div><p>other</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_main.main_text(df).collect()}
    for i in (0, 14, 15):
        assert got[i] == "n0 title\n\nBody of n0&co more\n\nSecond n0"
    assert [got[i] for i in (20, 21, 22)] == ["one", "one\n\ntwo", "one\n\ntwo\n\nthree"] and got[23] == "other" and len(got) == len(rows)


def test_common_lines_are_longest():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        at = html_main.common_lines(a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        it = iter(b)
        assert len(at) == table[-1][-1] and all(a[i] in it for i in at)


def test_classifier_rejects_junk(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80) + ".", 1) for i in range(300)]
    for i in range(300, 360):
        w = prose(rng, 60).split(" ")
        kind = i % 4
        junk = [" ".join(x + "###" for x in w), " ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x for x in w for _ in range(5))][kind]
        rows.append((i, junk, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, good int")
    got = quality_classifier.classify(df).collect()
    assert sum(r["kept"] == bool(r["good"]) for r in got) >= 0.97 * len(rows)
    assert all(r["kept"] for r in got if r["good"])
    told = quality_classifier.classify(docs)
    assert told.count() == docs.count() and not any(r["kept"] for r in told.filter("text is null or text = ''").collect())
    assert quality_classifier.classify(empty).count() == 0


def test_label_model_finds_the_accurate_labellers():
    rng = np.random.Generator(np.random.PCG64(6))
    truth = rng.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.9, 0.85])
    cast = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]).astype(np.int8) * 2 - 1
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = quality_classifier.fit_labels(patterns, counts.astype(float))
    assert ((model.posterior(cast) >= 0.5) == truth).mean() > 0.9


def test_line_templates(spark, docs, empty):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 20)}\nPosted by user{i} on 2020-01-{i:02d} in the general forum section\n{prose(rng, 15)}\nEnd.") for i in range(12)]
    rows += [(50, None), (51, ""), (52, rows[3][1]), (None, "\n".join(["no", prose(rng, 30)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(df).collect()}
    assert got[0]["text"] == rows[0][1] and got[50]["text"] is None and got[51]["text"] == ""
    for i in range(1, 12):
        lines = rows[i][1].split("\n")
        assert got[i]["text"] == "\n".join([lines[0], *lines[2:]]) and got[i]["dropped_lines"] == [1]
    counts = {}
    for i, t in rows:
        for number, line in enumerate((t or "").split("\n")):
            for x in line_dedup.templates(line):
                counts.setdefault(x, []).append((i is None, i or 0, number, t))
    recurring = {x: min(p[:3] for p in places) for x, places in counts.items() if len({p[3] for p in places}) >= 10}
    want = {(p[1], p[2]) for x, places in counts.items() if x in recurring for p in places if p[:3] != recurring[x]}
    assert {(i, n) for i, r in got.items() for n in r["dropped_lines"]} == want
    assert line_dedup.drop_recurring_lines(docs).count() == docs.count() and line_dedup.drop_recurring_lines(empty).count() == 0


def test_short_lines_recur_too(spark):
    rng = random.Random(12)
    short = ["All rights reserved.", "2020-01-01 12:00 a@b.example", "1 2 3 4 5 6 7"]
    rows = [(i, "\n".join([prose(rng, 20), *short, f"page {i}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.drop_recurring_lines(df).collect()}
    assert got[0] == [] and all(got[i] == [1, 2, 3] for i in range(1, 12))


def test_repeated_passages(spark, docs, empty):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 70 + i) + " " + passage + " " + prose(rng, 50)) for i in range(6)] + [(i, prose(rng, 200)) for i in range(10, 30)]
    rows += [(40, None), (41, ""), (42, prose(rng, 5)), (43, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated_paragraphs(df).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 43}
    # The whole passage repeats document 0; a paragraph across its edge may be near one of another earlier document
    assert {r["doc_id"] for r in got if r["first_id"] == 0} == {1, 2, 3, 4, 5}
    assert all(r["first_id"] < r["doc_id"] for r in got)
    by_id = dict(rows)
    for r in got:  # every repeat is a passage of its first document
        own = by_id[r["doc_id"]].split()[r["start"] : r["start"] + r["n_words"]]
        assert len(shingles(" ".join(own)) & shingles(by_id[r["first_id"]])) >= 15
    left = {r["doc_id"]: r for r in substring_dedup.drop_repeats(df).collect()}
    assert left[0]["text"] == rows[0][1] and left[40]["text"] is None and left[43]["n_dropped_words"] > 100
    assert len(left) == len(rows) and substring_dedup.drop_repeats(empty).count() == 0
    assert substring_dedup.repeated_paragraphs(docs).count() > 0


def test_near_passages_meet_in_groups_of_unlike_ones(spark):
    """Families of passages that share their middle and differ at both ends: most of a family are not near each other."""
    rng = np.random.Generator(np.random.PCG64(11))
    rows = []
    for family in range(6):
        base = [f"w{family}x{k}" for k in range(24)]
        for _ in range(60):
            words, left, right = list(base), int(rng.integers(0, 4)), int(rng.integers(0, 4))
            words[:left] = [f"p{rng.integers(0, 3)}" for _ in range(left)]
            words[24 - right :] = [f"q{rng.integers(0, 3)}" for _ in range(right)]
            rows.append((len(rows), " ".join(words)))
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_paragraphs(df).collect()
    want = {i for i, r in enumerate(root) if r != i}
    assert all(root[r["first_id"]] == root[r["doc_id"]] for r in got)  # nothing that is not linked
    assert len({r["doc_id"] for r in got} & want) >= 0.9 * len(want) and {r["doc_id"] for r in got} <= want


def test_no_near_passage_is_left_out_among_unlike_ones(spark):
    """Passages near each other, but seldom near the smallest of those they meet, are all linked (brute force)."""
    rng = np.random.Generator(np.random.PCG64(17))
    rows = []
    for family in range(8):
        base = [f"w{family}x{k}" for k in range(23)]
        for _ in range(50):
            words, left, right = list(base), int(rng.integers(0, 4)), int(rng.integers(0, 4))
            words[:left] = [f"p{rng.integers(0, 3)}" for _ in range(left)]
            words[23 - right :] = [f"q{rng.integers(0, 3)}" for _ in range(right)]
            rows.append((len(rows), " ".join(words)))
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["first_id"] for r in substring_dedup.repeated_paragraphs(df).collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i}


def test_training_rows_take_little_of_the_driver(docs, monkeypatch):
    taken = []
    monkeypatch.setattr(quality_classifier.LinearScorer, "fit", lambda self, parts: taken.extend(parts))
    quality_classifier.train(docs)
    row, column, weight = (sum(f[k].nbytes for f, _ in taken) for k in range(3))
    assert 0 < row + column + weight <= 9 * sum(len(f[1]) for f, _ in taken)


def test_short_copies_and_lines_edited_in_the_middle_are_found(spark):
    """Lines of 100 words with two words changed in the middle are found whole; so are copies of texts too short for a window."""
    rng = random.Random(21)
    base, rows = prose(rng, 100), []
    for i in range(20):
        words = base.split()
        for k in (33, 66):
            words[k] = f"edit{i}at{k}"
        rows.append((i, f"{prose(rng, 30)}\n{' '.join(words)}\n{prose(rng, 40)}"))
    rows += [(100 + i, "a short text of exactly eight words here") for i in range(5)] + [(200 + i, "two words") for i in range(3)]
    rows += [(300, "a short text that nobody repeats at all"), (301, "  "), (302, None), (None, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.repeated_paragraphs(df).collect()
    whole = {r["doc_id"] for r in got if (r["start"], r["n_words"], r["first_id"]) == (30, 100, 0)}
    assert len(whole) >= 0.9 * 19
    assert {r["doc_id"] for r in got} - set(range(20)) == {101, 102, 103, 104, 201, 202, None}
    left = {r["doc_id"]: r for r in substring_dedup.drop_repeats(df).collect()}
    assert left[100]["text"] == rows[20][1] and left[101]["n_dropped_words"] == 8 and not left[101]["text"].strip()
    edited = [left[i]["n_dropped_words"] for i in whole]
    assert min(edited) >= 100 and max(edited) <= 102


def test_shards_are_near_equal_and_whole(spark, docs, empty):
    out = sharding.shard_by_bytes(docs, 5).collect()
    assert len(out) == docs.count()
    for r in out:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
    for _, group in itertools.groupby(sorted(out, key=lambda r: (r["text"] is None, r["text"] or "")), key=lambda r: r["text"]):
        assert len({r["shard"] for r in group}) == 1
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard_by_bytes(empty, 5).count() == 0


def test_differencing_is_tight():
    rng = np.random.Generator(np.random.PCG64(2))
    sums = rng.integers(1, 10_000, (400, 6))
    total, place = sharding.differencing(sums)
    again = np.zeros(6, np.int64)
    np.add.at(again, place.reshape(-1), sums.reshape(-1))
    assert (again == total).all() and total.max() - total.min() < 100


def test_quality_rules_equal_plain_counts(spark, docs, empty):
    body = "a # b\n\nsame line here\nsame line here\n" + "w1 w2 w3 w4 w5 w6 w7 w8 " * 3 + "x" * 40
    more = spark.createDataFrame([(70, body), (71, "z " * 30)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    good = spark.createDataFrame([(8,), (9,), (None,), (8,)], "doc_id long")
    for r in quality_rules.judge(both, good).collect():
        text = r["text"] or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(w) < 2000 else set()
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text[:50]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.judge(docs, good).count() == docs.count() and quality_rules.judge(empty, good).count() == 0


def test_mix_meets_its_targets(spark, docs, empty):
    draws, sized = mixing.mix_sources(docs, block_words=50, shards=3)
    rows, drawn = sized.collect(), draws.collect()
    by_row = {r["__row"]: r for r in rows}
    assert len(rows) == docs.count()
    spans = {}
    for d in drawn:
        assert 0 <= d["from_word"] < d["to_word"] <= by_row[d["__row"]]["size"] and 0 <= d["shard"] < 3
        spans.setdefault((d["__row"], d["pass"]), []).append((d["from_word"], d["to_word"]))
    for s in spans.values():
        s.sort()
        assert all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[0][0] == 0
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in sources]
    want = mixing.targets_for(sizes, [3, 1, 2, 3], 1.5 * sum(sizes))
    assert abs(sum(want) - 1.5 * sum(sizes)) < 1e-6
    for s, size, target in zip(sources, sizes, want, strict=True):
        assert abs(sum(d["to_word"] - d["from_word"] for d in drawn if d["source"] == s) - target) <= 1 and target <= 2 * size
    mixed = mixing.mixed_documents(docs)
    total = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert abs(total - 1.5 * sum(sizes)) <= 4 and mixing.mixed_documents(empty).count() == 0


def test_quotas_are_exact():
    blocks = np.array([1000, 1, 0, 37])
    out = mixing.split_quotas(blocks, 7, 3)
    assert (out.sum(axis=0) == blocks).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 3
    assert (mixing.split_quotas(blocks, 7, 3) == out).all()


def test_words_cross_slabs():
    text = " ".join(prose(random.Random(1), 3000).split()) + " " + "y" * (hashing.SLAB + 10) + " end"
    data = text.encode()
    whole = hashing.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), True)
    parts = [hashing.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), True).hash[0] for w in WORD.findall(text)[-50:]]
    assert list(whole.hash[-50:]) == parts


def test_paragraphs_start_at_the_first_least_word_of_every_run():
    """Against brute force, on texts in which most words recur."""
    rng = random.Random(5)
    some = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 7, 8, 9, 20, 90]))) for _ in range(300)]
    data = "".join(some).encode()
    words = hashing.Words(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, some)]), lower=True)
    for size, reach in ((8, 8), (8, 5), (8, 1), (5, 8)):
        value, want = hashing.mix(words.hash ^ np.uint64(0x5DEECE66D)), set()
        for a, b in itertools.pairwise(words.first):
            last = b - size
            want |= {min(range(i, min(i + reach, last + 1)), key=lambda j: (value[j], j)) for i in range(a, last + 1)}
        starts = np.array(sorted(want))
        keep = np.ones(len(starts), bool)
        for k in np.flatnonzero(np.diff(starts) <= substring_dedup.NEAR):
            keep[k if value[starts[k + 1]] < value[starts[k]] else k + 1] = False
        assert substring_dedup.paragraphs(words, size, reach).tolist() == starts[keep].tolist()


def test_bands_take_little_room_and_lose_no_unit():
    """Bands are dealt in packed rows, and the units of a band meet its smallest one whatever rows hold them."""
    import pyarrow as pa

    rng = random.Random(9)
    base = [prose(rng, 30) for _ in range(40)]
    rows = [t for t in base for _ in range(2)] + [f"{t} {prose(rng, 1)}" for t in base] + [None, "", "two words"]
    deal = substring_dedup._bands("text", 24, 24, 5, 5, 2, 4)
    packed = [b for k in range(0, len(rows), 50) for b in deal(iter([pa.RecordBatch.from_pydict({"text": pa.array(rows[k : k + 50], pa.string())})]))]
    table = pa.Table.from_batches(packed).sort_by("bucket")
    entries = sum(len(x) for x in table["bands"].to_pylist())
    assert table.nbytes <= 13 * entries + 16 * table.num_rows  # a row for each band and unit takes 19 bytes when compressed
    held = {}
    for r in table.to_pylist():
        for band, unit in zip(r["bands"], r["units"], strict=True):
            held.setdefault((r["bucket"] << 32) | (band & 0xFFFFFFFF), set()).add(unit)
    want = sorted((band, unit, min(units)) for band, units in held.items() for unit in units - {min(units)})
    for most in (1, 3, 1000):  # buckets that end inside a batch and beyond it
        got = pa.Table.from_batches(list(substring_dedup._met(iter(table.to_batches(most))))).to_pylist()
        assert want and sorted((r["band"], r["unit"], r["pivot"]) for r in got) == want


def test_a_write_leaves_no_shuffle_files(spark):
    import os
    import time

    from tallyhound.llm.common import FREE_SHUFFLES, written

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(FREE_SHUFFLES, None)
    kept = written(spark.range(20000).selectExpr("id % 5000 as k").groupBy("k").count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 5000 and spark.conf.get(FREE_SHUFFLES, None) == setting
