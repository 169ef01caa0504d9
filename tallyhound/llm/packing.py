"""Bulk-synchronous best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import gapless_rank, written

CAPACITY = 2048
_CHUNK = re.compile(r"\s*\S+|\s+")  # the tokenizer's own pattern never joins a non-space with a space after it
_UNSURE = re.compile("[\x1c-\x1f]")  # white space to Python, but not to the tokenizer
MEMO = 1_000_000  # chunks of either age whose ids a worker remembers
LONGEST = 32  # longer chunks hardly recur and are not remembered
_tokenizers: dict[str, object] = {}
_memo: dict[str, bytes] = {}  # chunks of late
_older: dict[str, bytes] = {}  # those remembered before; a chunk met again becomes one of late


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; its threads would only wait for each other
        from tokenizers import Tokenizer

        _tokenizers.clear()
        _memo.clear()
        _older.clear()
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def token_ids(texts: list[str], path: str, memo: int = MEMO) -> Iterator[bytes]:
    """The ids of every text as little-endian unsigned 32-bit numbers, as the tokenizer gives them for the whole text.

    Texts are cut before white space, where the byte-level pattern always cuts; a chunk met before is looked up. When
    the memo is full its older half goes, so what recurs stays.
    """
    tokenizer = _tokenizer(path)
    for text in texts:
        if _UNSURE.search(text):
            yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            continue
        chunks = _CHUNK.findall(text)
        try:
            yield b"".join(map(_memo.__getitem__, chunks))
            continue
        except KeyError:
            pass
        if len(_memo) > memo:
            _older.clear()
            _older.update(_memo)
            _memo.clear()
        found: dict[str, bytes] = {}
        new = []
        for chunk in {c for c in chunks if c not in _memo}:
            if (ids := _older.get(chunk)) is None:
                new.append(chunk)
            else:
                _memo[chunk] = ids
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for chunk, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (_memo if len(chunk) <= LONGEST else found)[chunk] = np.array(e.ids, "<u4").tobytes()
        if found:
            yield b"".join(found[c] if c in found else _memo[c] for c in chunks)
        else:
            yield b"".join(map(_memo.__getitem__, chunks))


def _pieces(key: str, text: str, path: str, capacity: int, with_ids: bool, end_id: int, id_bytes: int, memo: int):
    end = np.array([end_id], "<u4").tobytes()

    def stored(part: bytes) -> bytes | None:
        if not with_ids or id_bytes == 4:
            return part if with_ids else None
        ids = np.frombuffer(part, "<u4")
        if ids.max(initial=0) >= 1 << 16:
            raise ValueError("an id does not fit 16 bits; use id_bytes=4")
        return ids.astype("<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                out: list[list] = [[], [], [], [], [], []]
                for k, ids in enumerate(token_ids([t or "" for t in rows.column(text).to_pylist()], path, memo)):
                    ids += end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    stop = n % capacity or capacity
                    while start < n:
                        part = ids[4 * start : 4 * stop]
                        for column, value in zip(out, (k, piece, start, stop - start, zlib.crc32(part), stored(part)), strict=True):
                            column.append(value)
                        start, stop, piece = stop, stop + capacity, piece + 1
                columns = [rows.column(key).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def tokenised_pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = True, end_id: int = 0,
                     id_bytes: int = 4, memo: int = MEMO) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian numbers.

    ``id_bytes`` is 4, or 2 for vocabularies of up to 65,536 ids; the checksum is always that of 32-bit ids.
    ``memo`` bounds the chunks that a worker remembers, about 200 bytes each and twice as many at most; it changes no result.

    A document's ids end with ``end_id``. One longer than ``capacity`` is cut so that only its first piece is
    shorter. A null text is empty and gives the end id alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(key, text).mapInArrow(_pieces(key, text, path, capacity, with_ids, end_id, id_bytes, memo), schema)


class _Gaps:
    """Open sequences by their free space: for each gap, runs (first sequence, how many)."""

    def __init__(self, capacity: int):
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self.runs[gap].append((first, count))


def best_fit_plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rounds of best fit over pieces sorted by falling length; returns the placements and the number of sequences.

    ``counts[s]`` pieces have length s. In the round of length s the successor sweep goes up the gaps from s on:
    the k-th piece of the round meets the k-th free place of the smallest gaps, a gap of g taking g // s pieces,
    so equal wishes are settled by rank. Pieces that no gap takes open sequences. A placement is a row
    (length, first rank, places per sequence, first sequence, number of pieces, offset of the first place).
    """
    gaps, plan, opened = _Gaps(capacity), [], 0
    for s in range(capacity, 0, -1):
        left, rank, kept = int(counts[s]), 0, []
        for g in range(s, capacity + 1):
            if not left:
                break
            while left and gaps.runs[g]:
                first, count = gaps.runs[g].pop()
                per = g // s
                full = min(count, left // per)
                if full:
                    plan.append((s, rank, per, first, full * per, capacity - g))
                    kept.append((g - per * s, first, full))
                    rank, left = rank + full * per, left - full * per
                if full < count and left:  # one more sequence takes what is left of the round
                    plan.append((s, rank, per, first + full, left, capacity - g))
                    kept.append((g - left * s, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < count:
                    gaps.put(g, first + full, count - full)
        if left:
            per = capacity // s
            plan.append((s, rank, per, opened, left, 0))
            kept.append((capacity - per * s, opened, left // per))
            if left % per:
                kept.append((capacity - left % per * s, opened + left // per, 1))
            opened += -(-left // per)
        for run in kept:
            gaps.put(*run)
    return np.array(plan, np.int64).reshape(-1, 6), opened


def _place(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, starts = shared.value  # sorted by length and rank
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            at = np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1
            row = plan[at]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 5] + nth % row[:, 2] * length)], [*columns, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``; a sequence has no holes.

    Pieces and gaps are sorted by length. Both orders have at most ``capacity`` distinct values, so the sorted
    sequences are held as runs and a round of the sweep moves whole runs; the plan has a few rows per length,
    whatever the number of pieces, and is broadcast. The distributed part ranks the pieces inside their length,
    a length of any frequency in many buckets, and places each by its rank. Repeated pieces are kept; lengths
    out of range are an error; an empty table gives an empty result.
    """
    pieces = written(pieces)
    seen = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect() if not pieces.isEmpty() else []
    if bad := [r["length"] for r in seen if r["length"] is None or not 1 <= r["length"] <= capacity]:
        raise ValueError(f"lengths out of 1 to {capacity}: {bad[:5]}")
    counts = np.zeros(capacity + 1, np.int64)
    for r in seen:
        counts[r["length"]] = r["n"]
    plan, _ = best_fit_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast((plan, plan[:, 0] * (1 << 48) + plan[:, 1]))
    ranked = gapless_rank(pieces, ["length"], [c for c in pieces.columns if c not in ("length", "ids")], "__rank", int(counts.sum()))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema], "sequence_id long", "offset long"])
    return ranked.mapInArrow(_place(shared, pieces.columns), schema)
