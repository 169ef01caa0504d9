"""Licence scans, the conversation trie and hard negatives: edge cases against plain Python, whole tables against SQL."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from tallyhound.llm import hard_negatives, license_scan, prefix_trie  # noqa: E402
from tallyhound.llm.queries import ORACLES, QUERIES  # noqa: E402
from tests.compare import SPARK_TO_DUCK, _rows, oracle_connection  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_prefix_trie", "op13_hard_negatives"])
def test_whole_table_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = oracle_connection(SF).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(columns, cursor.fetchall())
    assert got == want and len(got[0]) > 0
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert all(SPARK_TO_DUCK[t] == types[c] for c, t in df.dtypes)


# ---- licence scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def notice_texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "the", "license", "version", "é1", "of"]) for _ in range(n))
    notice = [text for _, text, _ in license_scan.NOTICES]
    out = [None, "", " \n", "MIT License", "mit-license", "mit, LICENSE. Apache\nLicense mit license", "General Public", "x" * 9000]
    for text in notice:
        out.append(f"{filler(40)}. {text.title()}! {filler(30)}")
        w = text.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(f"{filler(5)} {' '.join(w)}")
        out.append(" ".join(text.split()[: len(text.split()) // 2]))
    long = filler(400_000) + " " + notice[1] + " " + filler(200_000) + " general public license"
    return [*out, long, *out[8:10], notice[0] + " " + notice[0]]


def plain_scan(texts):
    found = [words_of(t) for t in texts]
    held = {w: sum(w in set(f) for f in found) for w in license_scan.vocabulary()}
    weight = {w: round(license_scan.WEIGHT_UNIT * float(np.log1p(len(texts) / (1 + n)))) + 1 for w, n in held.items()}
    for f in found:
        starts, base, labels, score = [], set(), set(), 0.0
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(f)) if f[i : i + len(p)] == p] if len(f) < 20_000 or phrase else []
            starts += here
            base |= {label} if here else set()
        at = defaultdict(list)
        for i, w in enumerate(f):
            if w in weight:
                at[w].append(i)
        for label, text, phrases in license_scan.NOTICES:
            t = text.split()
            keys = license_scan._key_positions(t, phrases)
            for s in {i - p for p, w in enumerate(t) for i in at[w]}:
                same = [0 <= s + p < len(f) and f[s + p] == w for p, w in enumerate(t)]
                aligned, total = sum(weight[w] for w, x in zip(t, same) if x), sum(weight[w] for w in t)
                if all(same[k] for k in keys) and 100 * aligned >= license_scan.ACCEPT_PERCENT * total:
                    labels.add(label)
                    score = max(score, aligned / total)
        yield len(f), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def test_license_scan_equals_all_places(spark):
    texts = notice_texts()
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "mit license", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, word int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(docs, ["doc_id"]).collect()}
    want = list(plain_scan([t for _, t, _, _ in rows]))
    assert len(got) == len(rows)
    for (i, *_), w in zip(rows, want):
        assert got[i][:6] == w[:6], i
        assert got[i][6] == pytest.approx(w[6], abs=1e-12)
    assert sum(1 for w in want if w[5]) > len(license_scan.NOTICES)


def test_license_scan_of_nothing(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


# ---- conversation trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(role.encode()).digest(), hashlib.md5(text.encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def below(path):
        leaves, saved, todo = 0, 0, [path]
        while todo:
            p = todo.pop()
            leaves += not kids[p]
            saved += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
            todo += kids[p]
        return leaves, saved

    for path, who in members.items():
        ends = ",".join(str(c) for c in who if len(built[c]) == len(path))
        yield (who[0], len(path), members[path[:-1]][0] if path else None, len(who), len(kids[path]), *below(path), hashlib.sha256(ends.encode()).hexdigest())


def talks():
    rng = random.Random(11)
    rows = []
    for conv in [*range(0, 24), 30, 33, 57, 1001, 1002, 123456789]:
        for turn in range(rng.randint(1, 11)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["hello", "hello", "é\U0001f600", None, "", "x" * 3000]), 1, "n"))
    rows += [(7, None, "system", "first", 1, "n"), (7, 3, "user", "tie", 1, "n"), rows[0], rows[0], (None, 1, "user", "nobody", 1, "n")]
    rows += [(conv, 0, "user", "same beginning", 1, "n") for conv in range(2000, 2300)]
    return rows


TALK = "conv_id long, turn long, role string, text string, n long, depth string"


def test_trie_equals_plain(spark):
    rows = talks()
    got = sorted(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, TALK).repartition(5)).collect()), key=repr)
    assert got == sorted(plain_trie(rows), key=repr)


def test_trie_of_one_endless_conversation(spark):
    """A conversation that holds most rows is cut into parts; its nodes are one chain."""
    rows = [(5, i, "user", f"turn {i}", 1, "n") for i in range(60)] + [(6, i, "user", f"own {i}", 1, "n") for i in range(3)]
    got = sorted(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, TALK).repartition(3)).collect()), key=repr)
    assert got == sorted(plain_trie(rows), key=repr)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TALK)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_contraction_equals_walk(spark, shape):
    rng = random.Random(2)
    parent = {0: None} | {i: {"chain": i - 1, "star": 0, "random": rng.randrange(max(0, i - 4), i)}[shape] for i in range(1, 40)}
    value = {i: rng.randrange(-5, 50) for i in parent}
    want = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    tree = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "id long, parent long, v long")
    assert {r["id"]: r["v"] for r in prefix_trie.subtree_totals(tree, ["v"]).collect()} == want


def test_digest_of_many_members(spark):
    ids = random.Random(1).sample(range(10**7), 3500)
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 9)], "n0 long, n1 long, conv_id long").repartition(4)
    got = {(r["n0"], r["n1"]): r["ends_sha256"] for r in prefix_trie.digests_of_members(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"9").hexdigest()}


# ---- hard negatives


@pytest.mark.parametrize("top", [3, 200, 40_000, 10**7, 10**12])
def test_packed_products_are_exact(top):
    rng = random.Random(top)
    a, c = ([[rng.randint(-top, top // 2) for _ in range(17)] for _ in range(n)] for n in (5, 23))
    want = [[max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(r, s)))) for s in c] for r in a]
    assert hard_negatives.packed_products(np.array(a), np.array(c)).tolist() == want


def plain_negatives(rows):
    ok = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ok.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in ok:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in ok)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            fits = [(-t, k) for t, k, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, n, k, -s, t) for n, (t, k) in enumerate(fits, 1)]
    return sorted(out)


VECTOR = "vec_id long, embedding array<float>, label int, score long, block string"


def test_hard_negatives_equal_plain(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(base)], rng.choice([0, 1, 1, 1, 9]), 1, "b") for i in range(0, 700)]
    rows += [(5, None, 1, 1, "b"), (6, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, "b"), (800, [float("nan")] * 6, 1, 1, "b"), (900, [float("inf")] * 6, 1, 1, "b"),
             (1000, [0.0] * 6, 2, 1, "b"), (1001, [0.0] * 6, 2, 1, "b"), (1100, [], 3, 1, "b"), (None, [1.0] * 6, 1, 1, "b"), (1200, [1.0] * 6, None, 1, "b"),
             (1300, [2.0, 1.0], 0, 1, "b"), *[(2001 + 10 * k, rows[200][1], k % 3, 1, "b") for k in range(60)], rows[3], rows[3]]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame(rows, VECTOR).repartition(3)
    for blocks, anchors in ((4096, 1024), (50, 3)):
        got = sorted(map(tuple, hard_negatives.mine_hard_negatives(df, label, F.col("vec_id") % 100 == 0, block_rows=blocks, anchor_rows=anchors).collect()))
        assert got == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTOR)
    assert hard_negatives.mine_hard_negatives(df, F.col("label"), F.col("vec_id") % 100 == 0).collect() == []
