"""Main text of web pages: what a page shares with the nearest page of its host is template, the rest is text."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import bitmap, in_bitmap, written

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|</[^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split())
_SPACE = frozenset("br td th wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_CHROME = frozenset("nav footer aside form script style noscript template head title iframe object svg canvas button select textarea dialog menu search input label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: What may stand beside such a name in one token, as in ``ad-banner`` or ``user-comments``; ``no``, ``has`` or ``article`` may not.
_BESIDE = frozenset("area bar block bottom box button buttons center col column form global icon icons inner item items left link links list main mobile nav outer page panel primary right secondary section site slot sticky top unit user widget wrap wrapper".split())
_HARD = frozenset("script style noscript template head title svg".split())  # hold no text, whatever stands in them
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Start tags that end an open element of these names, looked for up to these.
_IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), **{x: ("tbody thead tfoot", "table") for x in ("tbody", "thead", "tfoot")}}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _IMPLIED.items()}
_SCOPE = frozenset("table td th caption template object".split())
_P = frozenset(("p",))
_TABLE = frozenset("table caption tbody thead tfoot tr td th".split())
_HOLDS_INLINE = (_BLOCK | _SCOPE) - _P  # that no end tag of an inline element ends
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTENT, OPEN, CHROME = 0, 1, 2
PART = 50_000  # places of a task that looks for runs
OUTLINE = ("path", "lines", "kinds", "sizes")

Line = tuple[str, int]


def _named(value: str) -> bool:
    """Is a token of a class or id a name of chrome, or made of such a name and what may stand beside it?"""
    for token in value.split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        if parts and not _NAMES.isdisjoint(parts) and all(x in _NAMES or x in _BESIDE for x in parts):
            return True
    return False


def _chrome(name: str, attributes: str) -> str:
    """Why the element holds no text of the page: "hard" if nothing in it can be text, else "soft"; empty if it may."""
    if name in _CHROME or name == "header":
        return "hard" if name in _HARD else "soft"
    if not attributes or name in ("html", "body", "main"):
        return ""
    kind = ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hard"
        if key in ("class", "id") and name != "article" and _named(value) or key == "role" and value in _ROLES:
            kind = "soft"
    return kind


def page_lines(page: str) -> list[Line]:
    """The text blocks of a page in order, each with its kind.

    CONTENT stands in an article or main element, CHROME in an element that by name, role or class holds no
    text of the page, OPEN in neither. Headings of an article's own header are content. An element ends where its
    end tag, the end of an element around it or a start tag that implies the end stands. If all articles of a page
    stand in elements that look like chrome, those are none. Comments and raw elements give no block.
    """
    spared: set[int] = set()
    while True:
        lines, holders = _parsed(page, spared)
        if not holders - spared or any(kind == CONTENT for _, kind in lines):
            return lines
        spared |= holders


def _parsed(page: str, spared: set[int]) -> tuple[list[Line], set[int]]:
    """The lines, and where the chrome elements begin that hold an article; those in ``spared`` count as no chrome."""
    lines: list[Line] = []
    parts: list[str] = []
    holders: set[int] = set()
    names: list[str] = []  # open elements
    open_: Counter[str] = Counter()
    skip: list[tuple[int, bool, bool, int]] = []  # chrome elements that are open: depth, whether an article's header, whether inline, where
    inside: list[int] = []  # depths of the open article and main elements
    heading = False
    at = 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                in_header = len(skip) == 1 and skip[0][1] and heading
                kind = CHROME if skip and not in_header else CONTENT if inside else OPEN
                lines.append((text, kind))

    def close(depth: int) -> None:
        """End the element at this depth and all in it."""
        for x in names[depth:]:
            open_[x] -= 1
        del names[depth:]
        while skip and skip[-1][0] >= depth:
            skip.pop()
        while inside and inside[-1] >= depth:
            inside.pop()

    def find(wanted: frozenset[str], until: frozenset[str]) -> int:
        """Depth of the innermost open element of these names that none of ``until`` holds back; -1 if there is none."""
        if any(open_[x] for x in wanted):
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in wanted:
                    return depth
                if names[depth] in until:
                    break
        return -1

    while True:
        found = _TOKEN.search(page, at)
        inline = bool(skip) and skip[0][2]
        if not inline:  # what stands in an inline element does not break the block around it
            parts.append(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        closing, name, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not name:
            continue
        if name in _SPACE and not inline:
            parts.append(" ")
        if name in _BLOCK and not inline:
            end_block()
        if closing:
            if name in _HEADING:
                heading = False
            depth = find(frozenset((name,)), frozenset() if name in _TABLE or name in ("html", "body") else _SCOPE if name in _BLOCK else _HOLDS_INLINE)
            if depth >= 0:
                close(depth)
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            if not stop:
                break
            at = stop.start()
            continue
        if name in _ENDS_P and (depth := find(_P, _SCOPE)) >= 0:
            close(depth)
        if name in _IMPLIED and (depth := find(*_IMPLIED[name])) >= 0:
            close(depth)
        if name in _VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in _HEADING:
            heading = True
        names.append(name)
        open_[name] += 1
        article = name in ("article", "main") or bool(re.search(r"""\brole\s*=\s*["']?main\b""", attributes))
        if article and skip and not any(x[3] < 0 for x in skip):
            holders.update(x[3] for x in skip)
        if (not skip or skip[-1][1]) and found.start() not in spared and (kind := _chrome(name, attributes)):
            skip.append((len(names) - 1, name == "header" and bool(inside), name not in _BLOCK, -1 if kind == "hard" else found.start()))
        elif not skip and article:
            inside.append(len(names) - 1)
    end_block()
    return lines, holders


def _line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (by increasing chains of matches)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    out, link = [], chains[-1] if chains else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _outline(page: str, url: str):
    """Per page: host, path, and the hash, kind and length of each of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, hashes, kinds, sizes = [], [], [], [], []
            for text, address in zip(batch.column(page).to_pylist(), batch.column(url).to_pylist(), strict=True):
                found = _URL.match(address or "")
                hosts.append(found[1].lower() if found else "")
                paths.append(found[2] if found else address or "")
                lines = page_lines(text or "")
                hashes.append([_line_hash(x) for x, _ in lines])
                kinds.append([kind for _, kind in lines])
                sizes.append([len(x) for x, _ in lines])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))],
                ["key", "host", "path", "lines", "kinds", "sizes"])

    return run


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _copies(lines: list[int], kinds: list[int], sizes: list[int], other: list[int], other_kinds: list[int], other_sizes: list[int], common: list[int] | None = None) -> bool:
    """Is the page a copy: has ``other`` all its text, or do they share half of what stands in the article of either?"""
    text = [i for i in (common_lines(lines, other) if common is None else common) if kinds[i] != CHROME]
    if text and len(text) == sum(kind != CHROME for kind in kinds):
        return True
    shared = sum(sizes[i] for i in text if kinds[i] == CONTENT)
    content = [sum(n for n, kind in zip(*x, strict=True) if kind == CONTENT) for x in ((sizes, kinds), (other_sizes, other_kinds))]
    return bool(shared) and 2 * shared >= min(x for x in content if x)


def template_lines(*pair: list[int]) -> list[int] | None:
    """Positions of the lines that a page shares with another; None if the pair does not tell template from text.

    It does not if nothing is shared, or if the page is a copy. ``pair``: lines, kinds and sizes of both.
    """
    common = common_lines(pair[0], pair[3])
    return common if common and not _copies(*pair, common) else None


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class and the other of a pair on its host, in both directions: the places of the lines they share, null if the pair tells nothing.

    ``edge``: neither is a copy of the other.
    """
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for r in batch.to_pylist():
            ours, theirs = ([r[f"{s}{c}"] for c in ("lines", "kinds", "sizes")] for s in ("", "other_"))
            near = _prefix(r["path"], r["other_path"])
            edge = not (_copies(*ours, *theirs) or _copies(*theirs, *ours))
            for column, x in zip(out, ((r["place"], r["other_place"]), (r["other_place"], r["place"]), (near, near), (template_lines(*ours, *theirs), template_lines(*theirs, *ours)), (edge, edge)), strict=True):
                column.extend(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_()), strict=True)], ["place", "other", "near", "shared", "edge"])


PAIRS = "place long, other long, near int, shared array<int>, edge boolean"


def _marked(batch: pa.RecordBatch, marks: np.ndarray, want: bool) -> pa.RecordBatch:
    key = batch.column("__key").to_numpy()
    return batch.filter(pa.array(in_bitmap(marks, key) == want))


def _plain(page: str, keep: list[str], marks):
    """Pages without a pair, rendered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _marked(batch, marks.value, False)
            texts = [rendered([x for x, _ in lines], [kind for _, kind in lines], None) for lines in (page_lines(text or "") for text in batch.column(page).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    return run


def _blocks(page: str, keep: list[str], marks):
    """Pages with a pair as the texts and kinds of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _marked(batch, marks.value, True)
            lines = [page_lines(text or "") for text in batch.column(page).to_pylist()]
            # What the markup names as chrome is never rendered, so it need not travel; its places count all the same
            texts = pa.array([[x if kind != CHROME else "" for x, kind in page] for page in lines], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("__key"), texts, pa.array([[kind for _, kind in page] for page in lines], pa.list_(pa.int32()))], [*keep, "__key", "__texts", "__kinds"])

    return run


def rendered(texts: list[str], kinds: list[int], shared: list[int] | None) -> str:
    """The text of a page: its lines but for shared ones and chrome.

    Without a page to compare with (``shared`` is None) the markup alone decides: on a page with an article, what
    stands outside it is not text.
    """
    article = shared is None and CONTENT in kinds
    gone = set(shared or ())
    return "\n\n".join(x for i, (x, kind) in enumerate(zip(texts, kinds, strict=True)) if i not in gone and (kind == CONTENT or kind == OPEN and not article))


def _texts(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rendered(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("__texts", "__kinds", "__shared")], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    return run


def main_text(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """All columns of ``pages`` but the page itself, with ``text`` and ``n_chars``; one row per row.

    Pages of a host with the same lines are one class. Classes are sorted by host and URL path over the whole
    cluster, so a host of any size is spread out. Neighbours that are copies of each other form runs; each class
    is paired with the nearer of the two classes next to its run, or else of its two neighbours, leaving out
    classes that hold a copy of it and those that share nothing. All lines of the pair are aligned by longest
    common subsequence; shared ones are deleted, also inside an article. The markup is asked afterwards: lines
    that it names as menu, form and the like are deleted as well, and on a page with an article, lines outside it
    stay only if a pair tells that they are the page's own. Only pages with such a pair are shuffled.
    A null page has an empty text; a null or odd URL belongs to a host of its own kind. Columns of ``pages``
    named ``text`` or ``n_chars`` are replaced.
    """
    pages = pages.drop(*[c for c in ("text", "n_chars") if c not in (page, url)])
    keep = [c for c in pages.columns if c != page]
    key = F.xxhash64(*[F.col(c) for c in pages.columns if c in (page, url)], *[F.col(c) for c in keep if c != url and pages.schema[c].dataType.simpleString() in ("bigint", "int", "string")])
    keyed = pages.withColumn("__key", key)
    outline = keyed.select("__key", page, url).mapInArrow(_outline(page, url), "key long, host string, path string, lines array<long>, kinds array<int>, sizes array<int>")
    outline = written(outline.withColumn("class", F.xxhash64("host", "lines", "kinds")))
    classes = outline.groupBy("class").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("host", "lines", "kinds", "sizes")])
    sorted_ = classes.repartitionByRange(F.col("host"), F.col("path"), F.col("class")).sortWithinPartitions("host", "path", "class")
    numbered = written(sorted_.withColumn("__m", F.monotonically_increasing_id()))
    parts = numbered.groupBy(F.shiftright("__m", 33).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(parts.select("__p", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__s")))  # a row per partition
    place = F.col("__s") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = numbered.join(starts, F.shiftright("__m", 33) == F.col("__p")).select("class", "host", "path", "lines", "kinds", "sizes", place.alias("place"))

    def paired(asked: DataFrame) -> DataFrame:
        """``asked``: columns of ranked, and ``at``, the place of the other."""
        others = ranked.select(F.col("place").alias("other_place"), F.col("host").alias("other_host"), *[F.col(c).alias(f"other_{c}") for c in OUTLINE])
        met = asked.join(others, (F.col("at") == F.col("other_place")) & (F.col("host") == F.col("other_host")))
        return written(met.select("place", "other_place", *OUTLINE, *[f"other_{c}" for c in OUTLINE]).mapInArrow(_pairs, PAIRS))

    beside = paired(ranked.withColumn("at", F.col("place") - 1))
    # Runs of neighbours that are copies of each other: the first place of each run, and of the next. Only the
    # classes in a run of several meet further ones; places are dealt to parts of PART, whose edges are a row each.
    inner = beside.filter("not edge and other < place").select(F.col("place").alias("__i"))
    edges = ranked.select("place").join(inner, F.col("place") == F.col("__i"), "left").select("place", F.expr(f"place div {PART}").alias("part"), F.when(F.col("__i").isNull(), F.col("place")).alias("own"))
    held = edges.groupBy("part").agg(F.max("own").alias("last"), F.min("own").alias("first"))
    falling = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    rising = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = F.broadcast(held.select(F.col("part").alias("__h"), F.max("last").over(rising).alias("last"), F.min("first").over(falling).alias("first")))
    back = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("part").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    runs = edges.join(held, F.col("part") == F.col("__h")).select(F.col("place").alias("__l"), F.coalesce(F.max("own").over(back), "last").alias("begin"), F.coalesce(F.min("own").over(ahead), "first").alias("end"))
    runs = written(runs.filter("begin < __l or coalesce(end > __l + 1, true)"))
    far = F.explode(F.array(F.col("begin") - 1, F.col("end")))
    asked = runs.select("__l", far.alias("at")).filter("at <> __l - 1 and at <> __l + 1")
    beyond = paired(ranked.join(asked, F.col("place") == F.col("__l")).drop("__l"))
    # Classes next to the run go before neighbours in it, nearer ones before others
    told = beside.unionByName(beyond).filter("shared is not null")
    best = told.groupBy("place").agg(F.min(F.struct(F.expr("not edge").alias("inside"), (-F.col("near")).alias("far"), "other", "shared")).alias("b"))
    differed = ranked.select("class", "place").join(best, "place").select(F.col("class").alias("__c"), F.col("b.shared").alias("__shared"))
    shared = outline.select("key", "class").join(differed, F.col("class") == F.col("__c")).select(F.col("key").alias("__k"), "__shared").dropDuplicates(["__k"])
    shared = written(shared)
    # Pages that no pair tells anything about are rendered in the scan; the bitmap may send some more to the join
    marks = pages.sparkSession.sparkContext.broadcast(bitmap(shared, "__k"))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != page]
    schema = ", ".join([*columns, "text string, n_chars long"])
    plain = keyed.mapInArrow(_plain(page, keep, marks), schema)
    blocks = keyed.mapInArrow(_blocks(page, keep, marks), ", ".join([*columns, "__key long, __texts array<string>, __kinds array<int>"]))
    joined = blocks.join(shared, F.col("__key") == F.col("__k"), "left")
    return plain.unionByName(joined.mapInArrow(_texts(keep), schema))
