"""Repeated passages: MinHash banding over paragraphs, which are lines, short texts, and windows that the words themselves delimit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import buckets_for, written
from tallyhound.llm.graph import components
from tallyhound.llm.hashing import Words, mix, slabs

N = 5
PARAGRAPH = 24  # words
REACH = 24  # in every run of so many words a paragraph starts, so a repeat of 50 words holds one
NEAR = 2
SIMILARITY = 0.75
ROWS = 2  # minima per band
MARKS = 1 << 26  # bits of the broadcast bitmap of paragraphs to verify
RECALL = 0.98
BUCKETS = 4096  # of bands, at least
UNITS_PER_BUCKET = 200_000
NONE = (1 << 64) - 1  # above all hashes
HELD = 1 << 20  # bands that a task gathers before it deals them out
ORDERED_BY = 8  # one in so many units counts for the order of the n-grams
FREQUENT = 500_000  # n-grams, at most, that come last in that order


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` minima that let pairs of this similarity meet with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def paragraphs(words: Words, size: int = PARAGRAPH, reach: int = REACH) -> np.ndarray:
    """First words of the paragraphs of all texts: the word with the smallest hash of every run of ``reach`` words.

    A start depends on the words of its run alone, so a passage is cut alike wherever it stands. A text of
    ``size`` to ``size + reach`` words has at least one paragraph, a shorter one none.
    """
    total = len(words.hash) - size + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    fits = np.arange(total) <= words.first[1:][words.doc[:total]] - size  # up to the last start in the text
    if not fits.any():
        return np.zeros(0, np.int64)
    value = mix(words.hash[:total] ^ np.uint64(0x5DEECE66D))
    if reach > size:  # runs may reach into the next text
        best = _leftmost(value, fits, words.doc, reach)
        starts = np.unique(best[fits])
    else:  # between the starts of two texts lie size - 1 words that are none
        least = _over_runs(np.where(fits, value, np.uint64(NONE)), reach, np.minimum, NONE)
        least[~fits] = 0
        starts = np.flatnonzero(fits & (_over_runs(least[::-1], reach, np.maximum, 0)[::-1] == value))
        # Of equal words a run takes the first, so the later needs a run that starts after the former
        tied = np.flatnonzero((value[starts[1:]] == value[starts[:-1]]) & (np.diff(starts) < reach)) + 1
        if len(tied):
            since = np.stack([starts[tied - 1] + 1, starts[tied] + 1], 1).ravel()
            starts = np.delete(starts, tied[np.maximum.reduceat(np.append(least, np.uint64(0)), since)[::2] < value[starts[tied]]])
    # Of starts within NEAR words only the one with the smallest hash, else paragraphs nearly equal themselves
    close = np.diff(starts) <= NEAR
    falls = value[starts[1:]] < value[starts[:-1]]
    keep = np.ones(len(starts), bool)
    keep[:-1] &= ~(close & falls)
    keep[1:] &= ~(close & ~falls)
    return starts[keep]


def _over_runs(value: np.ndarray, reach: int, least: np.ufunc, end: int) -> np.ndarray:
    """The minimum (or maximum) of every place and the ``reach`` - 1 places after it; ``end`` stands for those after the last."""
    span = 1
    while span < reach:
        step = min(span, reach - span)
        value = least(value, np.concatenate([value[step:], np.full(min(step, len(value)), end, value.dtype)]))
        span += step
    return value


def _leftmost(value: np.ndarray, fits: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """The place of the first minimum of every run of ``reach`` places that fit in one text."""
    total = len(value)
    best, span = np.arange(total), 1
    while span < reach:
        step = min(span, reach - span)
        other = np.concatenate([best[step:], best[-step:]])[:total]
        same = (doc[np.minimum(np.arange(total) + step, total - 1)] == doc[:total]) & fits[other]
        other = np.where(same, other, best)
        best = np.where(value[other] < value[best], other, best)
        span += step
    return best


def spans(words: Words, data: np.ndarray, size: int = PARAGRAPH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of all units: windows, lines of ``size`` words or more, whole texts below ``size``."""
    windows = paragraphs(words, size, reach)
    count = np.diff(words.first)
    after = np.searchsorted(words.start, np.flatnonzero(data == 10))
    head = np.unique(np.concatenate([words.first[:-1][count > 0], after[after < len(words.hash)]]))
    length = np.diff(np.append(head, len(words.hash)))
    own = (length > size) | ((length == size) & ~np.isin(head, windows))
    short = (count > 0) & (count < size)
    starts = np.concatenate([windows, head[own], words.first[:-1][short]])
    return starts, np.concatenate([np.full(len(windows), size), length[own], count[short]])


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values before every place, the end included."""
    return np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])


class _Sets:
    """Units over the word n-grams of a slab: ``grams`` by first word, where each unit has its ``start``, ``size`` n-grams and a ``unit`` hash."""

    def __init__(self, words: Words, starts: np.ndarray, lengths: np.ndarray, n: int):
        at, value = words.ngrams(n)
        self.grams = np.zeros(len(words.hash), np.uint64)
        self.grams[at] = value
        count = np.diff(words.first)
        for i in np.flatnonzero((count > 0) & (count < n)):  # a text of fewer words has itself as its only n-gram
            self.grams[words.first[i]] = words.whole(i)
        self.start, self.length, self.size = starts, lengths, np.maximum(lengths - n + 1, 1)
        spread, twice = mix(self.grams), 2 * np.arange(len(self.grams), dtype=np.uint64)
        plain, placed = _sums(spread), _sums(spread * twice)
        end, first = starts + self.size, twice[starts] - np.uint64(1)
        # The k-th n-gram of a unit counts 2 k + 1 times
        total = placed[end] - placed[starts] - first * (plain[end] - plain[starts])
        self.unit = mix(total + self.size.astype(np.uint64)).view(np.int64)

    def keep(self, which: np.ndarray) -> _Sets:
        self.start, self.length, self.size, self.unit = (x[which] for x in (self.start, self.length, self.size, self.unit))
        return self

    def least(self, seed: int) -> np.ndarray:
        value = np.append(mix(self.grams ^ np.uint64(seed)), np.uint64(0))
        return np.minimum.reduceat(value, np.stack([self.start, self.start + self.size], 1).ravel())[::2]


def _occurrences(text: str, key: str, size: int, reach: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slabs(batch, text):
                words = Words(data, offsets, lower=True)
                starts, lengths = spans(words, data, size, reach)
                if not len(starts):
                    continue
                doc = pa.array(words.doc[starts])
                place = (starts - words.first[words.doc[starts]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_Sets(words, starts, lengths, n).unit), rows.column(key).take(doc), rows.column("__row").take(doc), pa.array(place), pa.array(lengths.astype(np.int32))], ["unit", "id", "row", "start", "n_words"])

    return run


def _distinct(words: Words, data: np.ndarray, size: int, reach: int, n: int) -> _Sets | None:
    """The units of a slab, those of equal words once; None if there are none."""
    starts, lengths = spans(words, data, size, reach)
    if not len(starts):
        return None
    sets = _Sets(words, starts, lengths, n)
    return sets.keep(np.sort(np.unique(sets.unit, return_index=True)[1]))


def _bands(text: str, size: int, reach: int, n: int, bands: int, rows: int, buckets: int):
    """The bands and their units, dealt to buckets by band; windows meet windows, and lines and short texts one another.

    A row holds what a run of slabs has for a bucket, 32 bits of each band beside the bucket: most bands are of one
    unit alone, and a row for each would take more room than all else. Two bands that agree in these bits are one,
    which costs a comparison and loses no pair.
    """

    def dealt(values: list[np.ndarray], units: list[np.ndarray]) -> pa.RecordBatch:
        unit, first = np.unique(np.concatenate(units), return_index=True)
        value = np.concatenate(values, 1)[:, first].ravel()
        bucket = ((value & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, rest = bucket[order], (value[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        offsets = pa.array(np.append(cut, len(bucket)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.ListArray.from_arrays(offsets, rest), pa.ListArray.from_arrays(offsets, np.tile(unit, bands)[order])], ["bucket", "bands", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, units = [], []
        for batch in batches:
            for _, data, offsets in slabs(batch, text):
                sets = _distinct(Words(data, offsets, lower=True), data, size, reach, n)
                if sets is None:
                    continue
                kind = np.where(sets.length == size, 0, bands).astype(np.uint64)
                value = kind + np.arange(bands, dtype=np.uint64)[:, None]
                for b in range(bands):
                    for r in range(rows):
                        value[b] = mix(value[b] ^ mix(sets.least(0x9E37 + 7919 * (b * rows + r))))
                values.append(value)
                units.append(sets.unit)
                if bands * sum(map(len, units)) >= HELD:
                    yield dealt(values, units)
                    values, units = [], []
        if units:
            yield dealt(values, units)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, unit, pivot) from rows in the order of their buckets: the units of each band but its smallest, the pivot."""

    def bands_of(held: list[tuple[np.ndarray, np.ndarray]], open_bucket: int) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        band, unit = (np.concatenate(x) for x in zip(*held, strict=True))
        later = band >> 32 == open_bucket
        rest = band[later], unit[later]
        band, unit = band[~later], unit[~later]
        order = np.argsort(band)
        inside = np.diff(band[order], prepend=-1) == 0
        order = order[inside | np.append(inside[1:], False)] if len(order) else order  # bands of one row have no more to tell
        order = order[np.lexsort((unit[order], band[order]))]
        band, unit = band[order], unit[order]
        new = np.diff(band, prepend=-1) != 0
        pivot = unit[np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))]
        use = ~new & (np.diff(unit, prepend=0) != 0)
        return pa.RecordBatch.from_arrays([pa.array(band[use]), pa.array(unit[use]), pa.array(pivot[use])], ["band", "unit", "pivot"]), rest

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        bands, bucket = batch.column("bands"), batch.column("bucket").to_numpy().astype(np.int64)
        if not len(bucket):
            continue
        n = pa.compute.list_value_length(bands).to_numpy()
        held.append((np.repeat(bucket, n) << 32 | bands.flatten().to_numpy().view(np.uint32), batch.column("units").flatten().to_numpy()))
        if held[0][0][0] >> 32 != bucket[-1]:
            done, rest = bands_of(held, bucket[-1])
            held = [rest]
            yield done
    if held:
        yield bands_of(held, -1)[0]


def _unit_sets(text: str, size: int, reach: int, n: int, shared):
    """The n-grams of the units that the bitmap marks, and whether a unit is a window; copies in a slab once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            for _, data, offsets in slabs(batch, text):
                sets = _distinct(Words(data, offsets, lower=True), data, size, reach, n)
                if sets is None:
                    continue
                at = sets.unit & (MARKS - 1)
                sets.keep((marks[at >> 6] >> (at & 63)) & 1 == 1)
                if not len(sets.unit):
                    continue
                order, flat, count = [], [], []
                for k in np.unique(sets.size):  # units of as many n-grams at once
                    which = np.flatnonzero(sets.size == k)
                    grams = np.sort(sets.grams[sets.start[which][:, None] + np.arange(k)], axis=1)
                    new = np.diff(grams, axis=1, prepend=~grams[:, :1]) != 0
                    order.append(which)
                    flat.append(grams[new])
                    count.append(new.sum(1))
                sets.keep(np.concatenate(order))
                lists = pa.ListArray.from_arrays(_sums(np.concatenate(count)).astype(np.int32), np.concatenate(flat).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sets.unit), pa.array(sets.length == size), lists], ["unit", "window", "grams"])

    return run


def _bitmap(units: DataFrame) -> np.ndarray:
    """MARKS bits, those at the low bits of ``unit`` set; its size does not depend on the input."""
    low = F.col("unit").bitwiseAND(F.lit(MARKS - 1))
    words = units.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(unit & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that many units hold, in order, and about how many; they only order the n-grams, so a part of the units will do."""
    some = sets.filter(F.pmod("unit", F.lit(ORDERED_BY)) == 0).select(F.explode("grams").alias("gram"))
    found = some.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").orderBy(F.col("held").desc(), "gram").limit(FREQUENT).toArrow()
    grams, held = found.column("gram").to_numpy(), found.column("held").to_numpy()
    order = np.argsort(grams)
    return grams[order], held[order]


def _prefixes(similarity: float, shared):
    """The n-grams of each unit's prefix, rare ones first, and the largest partner that their position still allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held = shared.value
        for batch in batches:
            lists = batch.column("grams")
            n = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
            if not n.sum():
                continue
            owner, grams = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy()
            count = np.zeros(len(grams), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                count = np.where(frequent[at] == grams, held[at], 0)
            grams = grams[np.lexsort((grams, count, owner))]
            place, whole = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n), n[owner]
            # similarity * (n + m - o) <= o, where o <= n - place
            largest = np.floor((1 + similarity) / similarity * (whole - place) - whole + 1e-6)
            use = largest >= similarity * whole - 1e-6
            kind = batch.column("window").to_numpy(zero_copy_only=False)[owner]  # windows meet windows alone
            key = np.where(kind, grams, mix(grams.view(np.uint64)).view(np.int64))
            rows = batch.select(["unit", "row", "root"]).take(pa.array(owner[use]))
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), *rows.columns, pa.array(whole[use].astype(np.int32)), pa.array(largest[use].astype(np.int32))], ["gram", "unit", "row", "root", "n", "largest"])

    return run


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, …) whose sets reach the similarity."""
    left, right = sets.select(F.col("unit").alias("a"), F.col("grams").alias("x")), sets.select(F.col("unit").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select(*pairs.columns)


def _mixed(prefix: DataFrame) -> DataFrame:
    """The lists of ``prefix`` that hold several components and several rows, with the most central unit of each.

    Central is the unit with most left after the n-gram, that is, with the fewest rare ones before.
    """
    lists = prefix.groupBy(F.col("gram").alias("g")).agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("row").alias("s0"), F.max("row").alias("s1"),
        F.max(F.struct(F.expr("largest - n").alias("room"), "unit", "row", "root", "n", "largest")).alias("c"))
    return prefix.join(lists.filter("r0 <> r1 and s0 <> s1").select("g", "c"), F.col("gram") == F.col("g")).drop("g")


def _joined(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``roots`` (node, root) after further ``links`` (a, b) between roots, and what became of these roots."""
    moved = components(links)
    later = moved.select(F.col("node").alias("old"), F.col("root").alias("new"))
    return roots.join(later, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).union(moved), later


def _near_units(stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the units in ``sets`` as the comparison of all their pairs would link them; units of one row are no pair.

    ``stars`` are pairs (a, b) of units that met. Those that are near are linked first. Then only units that are not
    yet connected are compared, if they share an n-gram among the rare ones of both that similar sets must share
    (prefix filter) and their sizes allow it: first with the most central unit of each n-gram's list, then, where
    several components are left in a list, all of them.
    """
    roots = components(_near(stars, sets, similarity).select("a", "b"))
    shared = sets.sparkSession.sparkContext.broadcast(_frequent(sets))
    known = sets.join(roots, F.col("unit") == F.col("node"), "left").select("unit", "row", F.coalesce("root", "unit").alias("root"), "window", "grams")
    prefix = written(_mixed(written(known.mapInArrow(_prefixes(similarity, shared), "gram long, unit long, row long, root long, n int, largest int"))))
    spokes = prefix.filter("root <> c.root and row <> c.row and n <= c.largest and c.n <= largest")
    spokes = spokes.select(F.col("unit").alias("a"), F.col("c.unit").alias("b"), F.col("root").alias("ra"), F.col("c.root").alias("rb")).distinct()
    roots, later = _joined(roots, _near(spokes, sets, similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    apart = prefix.drop("c").join(later, F.col("root") == F.col("old"), "left").withColumn("root", F.coalesce("new", "root")).drop("old", "new")
    apart = written(_mixed(apart).drop("c"))
    x, y = apart.alias("x"), apart.alias("y")
    pairs = x.join(y, F.expr("x.gram = y.gram and x.root <> y.root and x.row <> y.row and x.unit < y.unit and x.n <= y.largest and y.n <= x.largest"))
    pairs = pairs.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb")).distinct()
    return written(_joined(roots, _near(pairs, sets, similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b")))[0])


def repeated_paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = PARAGRAPH, reach: int = REACH, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """Paragraphs that repeat one of an earlier document: key, ``row``, ``start``, ``n_words``, ``component``, ``first_id``, ``first_start``.

    ``row`` is the hash of key and text, ``start`` the paragraph's first word in the text. Paragraphs are lines of
    ``size`` words or more, whole texts of fewer words, and windows of ``size`` words that the words cut, for passages
    inside lines. Equal paragraphs are one unit. Units that share a band with a unit of another row are compared by the
    exact Jaccard similarity of their word n-grams, with the band's smallest unit first and then with every one of
    them that can be similar and is not connected yet; linked units form components. The first occurrence in a component, by key (null last) and position, is no repeat, nor
    is what its own document has of the component. Shorter lines of longer texts are no paragraphs (line dedup
    counts them); texts without words, and null texts, have none. Rows equal in key and text count once.
    """
    marked = docs.select(key, text, F.xxhash64(key, text).alias("__row"))
    kind = docs.schema[key].dataType.simpleString()
    found = written(marked.mapInArrow(_occurrences(text, key, size, reach, n), f"unit long, id {kind}, row long, start int, n_words int"))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row", "start")
    units = found.groupBy("unit").agg(F.min(place).alias("first"), F.min("row").alias("r"), F.max("row").alias("s"))
    units = written(units.select("unit", "first", F.expr("r <> s").alias("spread")))
    buckets = buckets_for(found.count(), UNITS_PER_BUCKET, BUCKETS)
    bands = docs.select(text).mapInArrow(_bands(text, size, reach, n, bands_for(similarity), ROWS, buckets), "bucket int, bands array<int>, units array<long>")
    met = written(bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "band long, unit long, pivot long"))
    ours, theirs = units.select("unit", F.col("first.row").alias("row")), units.select(F.col("unit").alias("pivot"), F.col("first.row").alias("pivot_row"))
    # Overlapping paragraphs of one document meet too; they repeat nothing, and bands of one document are left out
    placed = written(met.join(ours, "unit").join(theirs, "pivot").select("band", "unit", "row", "pivot", "pivot_row"))
    apart = placed.filter("row <> pivot_row")
    several = placed.join(apart.select("band").distinct(), "band", "left_semi")
    asked = written(several.select("unit", "row").union(several.select("pivot", "pivot_row")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(asked))
    marked_sets = docs.select(text).mapInArrow(_unit_sets(text, size, reach, n, shared), "unit long, window boolean, grams array<long>")
    sets = written(marked_sets.join(asked, "unit").dropDuplicates(["unit"]))
    roots = _near_units(apart.select(F.col("unit").alias("a"), F.col("pivot").alias("b")).distinct(), sets, similarity)
    named = roots.union(roots.select("root", "root").distinct())
    rooted = units.join(named, F.col("unit") == F.col("node"), "left").filter("spread or node is not null")
    rooted = rooted.select("unit", "first", "spread", F.coalesce("root", "unit").alias("component"))
    groups = rooted.groupBy("component").agg(F.min("first").alias("first"), F.max("spread").alias("spread"), F.min("first.row").alias("r"), F.max("first.row").alias("s")).filter("spread or r <> s")
    repeated = written(rooted.select("unit", "component").join(groups.select("component", "first"), "component").select(F.col("unit").alias("u"), "component", "first"))
    out = found.withColumn("place", place).join(repeated, F.col("unit") == F.col("u")).filter(F.col("row") != F.col("first.row"))
    return out.select(F.col("id").alias(key), "row", "start", "n_words", "component", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")).distinct()


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without the words of repeated paragraphs, and ``n_dropped_words``."""
    gone = repeated_paragraphs(docs, text, key, **options).groupBy("row").agg(F.collect_list(F.struct("start", "n_words")).alias("__gone"))
    marked = docs.withColumn("__row", F.xxhash64(key, text)).join(gone.withColumnRenamed("row", "__r"), F.col("__row") == F.col("__r"), "left")
    names = [c for c in docs.columns if c != "n_dropped_words"]
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], "n_dropped_words long"])
    return marked.select(*names, "__gone").mapInArrow(_cut(text, names), schema)


def _cut(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for body, gone in zip(batch.column(text).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                if not gone:
                    texts.append(body)
                    dropped.append(0)
                    continue
                data = body.encode("utf-8", "surrogatepass")
                words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True)
                out = np.zeros(len(words.hash), bool)
                for span in gone:
                    out[span["start"] : span["start"] + span["n_words"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                kept, at = [], 0
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    kept.append(data[at : words.start[a]])
                    at = words.end[b - 1]
                texts.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"))
                dropped.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays([*[pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], pa.array(dropped, pa.int64())], [*names, "n_dropped_words"])

    return run
