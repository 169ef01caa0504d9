"""Quality rules: basic counts of a text, then the log-likelihood ratio of its hashed word pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.hashing import Words, slabs

BUCKETS = 1 << 16
PRIOR = 8.0  # occurrences, as the raw shares have them, added to every bucket on both sides
THRESHOLD = -0.1  # mean log ratio per word pair below which a text is rejected
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of words, lower-cased."""
    at, pair = words.ngrams(2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    hashed = np.concatenate([words.hash, pair]) >> shift
    return np.concatenate([words.doc, words.doc[at]]), hashed.astype(np.int64)


def _bucket_rows(text: str, key: str):
    """Per text its key and its buckets, two bytes each; less than the text, should a join shuffle it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slabs(batch, text):
                doc, bucket = _buckets(Words(data, offsets, lower=True))
                bucket = bucket[np.argsort(doc, kind="stable")].astype("<u2")
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows.num_rows))])
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array([bucket[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], [key, "buckets"])

    return run


def _count_buckets(trusted: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            held, marks = batch.column("buckets").to_pylist(), batch.column(trusted).to_pylist()
            for side, some in enumerate((held, [h for h, m in zip(held, marks, strict=True) if m])):
                counts[side] += np.bincount(np.frombuffer(b"".join(some), "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "raw", "target"])

    return run


def log_ratios(rows: DataFrame, trusted: str) -> np.ndarray:
    """Per bucket the log of its share in the trusted texts over its share in all texts.

    Every text is counted. The tasks add up in arrays of BUCKETS numbers; that many sums reach the driver,
    whatever the input. Without trusted texts all ratios are 0.
    """
    counted = rows.select("buckets", trusted).mapInArrow(_count_buckets(trusted), "bucket long, raw long, target long")
    found = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR)).astype(np.float32)


def _repeated(words: Words) -> np.ndarray:
    """Per text the number of words in windows that the text holds twice or more."""
    at, value = words.ngrams(REPEAT_WINDOW)
    n = len(words.first) - 1
    if not len(at):
        return np.zeros(n, np.int64)
    doc = words.doc[at]
    order = np.lexsort((value, doc))
    same = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.doc[inside], minlength=n)


def _repeat_lines(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            out[i] = len(lines) - len(set(lines))
    return out


def text_counts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """The rows of a batch in slabs, with their basic counts, bytes and offsets."""
    for rows, data, offsets in slabs(batch, text):
        words = Words(data, offsets, lower=False)
        n = rows.num_rows
        starts = (data & 0xC0) != 0x80  # one byte of every code point
        upto = np.concatenate([[0], np.cumsum(starts)])
        length = upto[words.end] - upto[words.start]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets]
        yield rows, {
            "n_words": np.diff(words.first), "word_chars": np.bincount(words.doc, length, n).astype(np.int64),
            "n_symbols": np.diff(symbols), "n_dup_lines": _repeat_lines(rows.column(text).to_pylist()),
            "n_repeat_words": _repeated(words),
        }, data, offsets


def _judge(text: str, keep: list[str], shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for rows, counts, data, offsets in text_counts(batch, text):
                doc, bucket = _buckets(Words(data, offsets, lower=True))
                n = rows.num_rows
                total = np.bincount(doc, minlength=n)
                score = np.bincount(doc, ratio[bucket].astype(np.float64), n) / np.maximum(total, 1)
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in keep], *[pa.array(v.astype(np.int64)) for v in counts.values()], pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))],
                    [*keep, *counts, "llr", "base_failed", "kept"],
                )

    return run


def judge(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Add the basic counts, ``llr`` (mean log ratio per word and pair), ``base_failed`` and ``kept`` to every document.

    ``trusted_ids`` holds the keys of the documents that make the target corpus; repeated and null keys there
    count once and not at all. The raw corpus is all of ``docs``. A text without words has llr 0 and fails the
    basic rules. Columns of ``docs`` named like an added one are replaced. Every row is judged, repeated ones too.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    docs = docs.drop(*[c for c in added if c != text])
    ids = trusted_ids.select(F.col(key).alias("__id")).filter("__id is not null").distinct().withColumn("__in", F.lit(True))
    rows = docs.select(key, text).mapInArrow(_bucket_rows(text, key), f"`{key}` {docs.schema[key].dataType.simpleString()}, buckets binary")
    # Merged at every size: whether the ids happen to be few enough to be broadcast must not decide what is shuffled
    marked = rows.join(ids.hint("merge"), F.col(key) == F.col("__id"), "left").select("buckets", F.coalesce("__in", F.lit(False)).alias("__in"))
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(marked, "__in"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], _COUNTS, "llr double, base_failed boolean, kept boolean"])
    return docs.mapInArrow(_judge(text, docs.columns, ratio, threshold), schema)
