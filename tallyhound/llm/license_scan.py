"""Licence notices in texts, found through a positional index of their rare words.

Notices are templates of a few words each. A word's rarity is counted over all texts. Of every template only its
rarest words are indexed, just as many as leave less weight unindexed than a notice needs to be accepted, so no
acceptable place is missed. The rare licence words of a text are looked up; word and template position give the place
where the template would begin, and all template words are then compared at that place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.hashing import SLAB, Words, slabs

# The phrases that every scan reports, with their label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licences; label, words of the notice, key phrases that must stand in it.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["free of charge", "to any person obtaining a copy"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ("gpl", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ["with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered"]),
    ("zlib", "this software is provided as is without any express or implied warranty", ["express or implied warranty"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
ACCEPT_PERCENT = 60  # share of a notice's weight that must stand in place
WEIGHT_UNIT = 1000  # weights are whole thousandths, so that sums do not depend on their order

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 32
_PLAIN[~_WORD_BYTE[_PLAIN]] = 0x20  # every byte outside words is a space
_DOC = 40  # bits for a word's position


def vocabulary(notices=NOTICES) -> list[str]:
    """The licence words: those of the notices and of the base phrases, sorted."""
    return sorted({w for _, text, _ in notices for w in text.split()} | {w for p in BASE_PHRASES for w in p.split()})


def _hash_words(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), lower=False).hash


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text in pieces of about ``most`` bytes that end between words."""
    i = 0
    while i < len(data):
        j = min(i + most, len(data))
        while j < len(data) and data[j] != 0x20:
            gaps = np.flatnonzero(data[j : j + most] == 0x20)
            j = j + int(gaps[0]) if len(gaps) else min(j + most, len(data))
        yield data[i:j]
        i = j


def _hits(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> tuple:
    """(words per text, text, position and word id of every licence word); a long text is read piece by piece."""
    data = _PLAIN[data]
    if len(offsets) == 2 and len(data) > 2 * SLAB:
        count, at, word = 0, [], []
        for piece in _pieces(data, SLAB):
            (n,), _, p, w = _hits(piece, np.array([0, len(piece)]), hashes, ids)
            at.append(p + count)
            word.append(w)
            count += int(n)
        at, word = np.concatenate(at), np.concatenate(word)
        return np.array([count]), np.zeros(len(at), np.int64), at, word
    words = Words(data, offsets, lower=False)
    near = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
    found = np.flatnonzero(hashes[near] == words.hash)
    doc = words.doc[found]
    return np.diff(words.first), doc, found - words.first[doc], ids[near[found]]


def _texts(batch: pa.RecordBatch, lookup: tuple) -> Iterator[tuple]:
    for rows, data, offsets in slabs(batch, "__text"):
        yield rows, *_hits(data, offsets, *lookup)


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """(number of texts, texts that hold each licence word); the answer has one row per licence word."""
    hashes = _hash_words(words)
    order = np.argsort(hashes)
    lookup = hashes[order], order

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = 0, np.zeros(len(words), np.int64)
        for batch in batches:
            texts += batch.num_rows
            for rows, _, doc, _, word in _texts(batch, lookup):
                held += np.bincount(np.unique(doc * len(words) + word) % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, len(words))], pa.int32()), pa.array([texts, *held], pa.int64())], ["word", "n"])

    texts = docs.select(F.col("text").alias("__text")).mapInArrow(count, "word int, n long")
    found = dict(texts.groupBy("word").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False, name=None))
    return int(found.get(-1, 0)), {w: int(found.get(i, 0)) for i, w in enumerate(words)}


class NoticeIndex:
    """Weights, postings of the rare words and key positions of all notices."""

    def __init__(self, notices: list[tuple], texts: int, held: dict[str, int], accept_percent: int):
        self.words, self.labels, self.accept_percent = sorted(held), [label for label, _, _ in notices], accept_percent
        number = {w: i for i, w in enumerate(self.words)}
        hashes = _hash_words(self.words)
        order = np.argsort(hashes)
        self.lookup = hashes[order], order
        weight = np.array([round(WEIGHT_UNIT * np.log1p(texts / (1 + held[w]))) + 1 for w in self.words], np.int64)
        self.notice, self.weight, self.key = [], [], []
        posts = []
        for t, (_, text, phrases) in enumerate(notices):
            ids = np.array([number[w] for w in text.split()])
            self.notice.append(ids)
            self.weight.append(weight[ids])
            self.key.append(_key_positions(text.split(), phrases))
            left, total = int(weight[ids].sum()), int(weight[ids].sum())
            for word in sorted(set(ids.tolist()), key=lambda i: (-weight[i], self.words[i])):
                if 100 * left < accept_percent * total:
                    break  # the rest alone cannot be accepted
                places = np.flatnonzero(ids == word)
                posts += [(word, t, int(p)) for p in places]
                left -= int(weight[word]) * len(places)
        posts = np.array(sorted(posts), np.int64).reshape(-1, 3)
        self.post_notice, self.post_at = posts[:, 1], posts[:, 2]
        self.post_from = np.searchsorted(posts[:, 0], np.arange(len(self.words) + 1))
        self.base = [([number[w] for w in phrase.split()], label) for phrase, label in BASE_PHRASES.items()]

    def candidates(self, doc: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, notice, place of its first word) that an indexed word points to."""
        n = self.post_from[word + 1] - self.post_from[word]
        hit = np.repeat(np.arange(len(word)), n)
        post = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + self.post_from[word][hit]
        found = np.stack([self.post_notice[post], doc[hit], at[hit] - self.post_at[post]])
        return tuple(np.unique(found, axis=1)) if found.shape[1] else tuple(found)

    def places(self, doc: np.ndarray, at: np.ndarray, word: np.ndarray, most: int = 1 << 16) -> Iterator[tuple]:
        """(text, notice, share of its weight in place) of every accepted place."""
        key = (doc << _DOC) + at
        notice, where, start = self.candidates(doc, at, word)
        for t, ids in enumerate(self.notice):
            low, high = np.searchsorted(notice, [t, t + 1])
            for i in range(low, high, most):
                d, s = where[i : min(high, i + most)], start[i : min(high, i + most)]
                place = s[:, None] + np.arange(len(ids))
                wanted = (d[:, None] << _DOC) + place
                near = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                same = (place >= 0) & (key[near] == wanted) & (word[near] == ids)
                aligned, total = same @ self.weight[t], int(self.weight[t].sum())
                good = (100 * aligned >= self.accept_percent * total) & same[:, self.key[t]].all(axis=1)
                for j in np.flatnonzero(good):
                    yield int(d[j]), t, int(aligned[j]) / total

    def base_places(self, doc: np.ndarray, at: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, str]]:
        """(indexes of the first words, label) of every base phrase."""
        for ids, label in self.base:
            n = max(0, len(word) - len(ids) + 1)
            good = np.ones(n, bool)
            for k, i in enumerate(ids):
                good &= (word[k : k + n] == i) & (doc[k : k + n] == doc[:n]) & (at[k : k + n] == at[:n] + k)
            yield np.flatnonzero(good), label


def _key_positions(words: list[str], phrases: list[str]) -> np.ndarray:
    out: set[int] = set()
    for phrase in phrases:
        part = phrase.split()
        start = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        out.update(range(start, start + len(part)))
    return np.array(sorted(out))


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, keep: list[str], notices: list[tuple] = NOTICES, accept_percent: int = ACCEPT_PERCENT) -> DataFrame:
    """The licence notices of every whole text: the columns ``keep`` of ``docs`` and those of ``_SCHEMA``.

    A place counts for a notice when its key phrases stand there in full and at least ``accept_percent`` of the notice's
    weight (rarity over all texts) stands at the same relative positions. ``score`` is the largest such share, 0 without
    one. A null or empty text has no words, no place and the empty label lists. Every row, repeated or not and with
    whatever id, stands for itself; an empty table gives an empty one. Other columns of ``docs`` are not read, so
    their names cannot clash; those of ``keep`` must differ from the added ones.
    """
    words = vocabulary(notices)
    index = NoticeIndex(notices, *document_frequencies(docs, words), accept_percent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, n_words, doc, at, word in _texts(batch, index.lookup):
                n = rows.num_rows
                base, labels, starts = [set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
                score = np.zeros(n)
                for first, label in index.base_places(doc, at, word):
                    for i in first:
                        base[doc[i]].add(label)
                        starts[doc[i]].append(int(at[i]))
                for d, t, share in index.places(doc, at, word):
                    labels[d].add(index.labels[t])
                    score[d] = max(score[d], share)
                columns = [
                    pa.array(n_words, pa.int64()), pa.array([len(s) for s in starts], pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()), pa.array([max(s, default=None) for s in starts], pa.int64()),
                    pa.array([",".join(sorted(s)) for s in base], pa.string()),
                    pa.array([",".join(sorted(s | b)) for s, b in zip(labels, base)], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *columns], [*keep, *(c.split()[0] for c in _SCHEMA.split(", "))])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(scan, f"{kept}, {_SCHEMA}")


def oracle_sql() -> str:
    """The same rows in SQL, over all places of all notices instead of the indexed ones."""
    values = ", ".join(f"({t}, '{label}', {p}, '{w}', {p in _key_positions(text.split(), phrases)})"
                       for t, (label, text, phrases) in enumerate(NOTICES) for p, w in enumerate(text.split()))
    phrase = ", ".join(f"('{p}', '{label}')" for p, label in BASE_PHRASES.items())
    return f"""WITH tpl(t, label, p, word, is_key) AS (VALUES {values}), phrase(ph, label) AS (VALUES {phrase}),
doc AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM doc),
hit AS (SELECT * FROM w WHERE word IN (SELECT word FROM tpl)),
df AS (SELECT word, count(DISTINCT r) AS n FROM hit GROUP BY word),
wt AS (SELECT v.word, cast(round({WEIGHT_UNIT} * ln(1 + (SELECT count(*) FROM doc) / (1.0 + coalesce(n, 0)))) AS bigint) + 1 AS weight
       FROM (SELECT DISTINCT word FROM tpl) v LEFT JOIN df ON v.word = df.word),
total AS (SELECT t, sum(weight) AS total, count(*) FILTER (is_key) AS keys FROM tpl JOIN wt USING (word) GROUP BY t),
place AS (SELECT r, t, any_value(label) AS label, sum(weight) AS aligned, count(*) FILTER (is_key) AS keys
          FROM hit JOIN tpl USING (word) JOIN wt USING (word) GROUP BY r, t, pos - p),
good AS (SELECT r, label, cast(aligned AS double) / cast(total AS double) AS share FROM place JOIN total USING (t)
         WHERE place.keys = total.keys AND 100 * aligned >= {ACCEPT_PERCENT} * total),
b AS (SELECT x.r, ph.label, x.pos FROM w x JOIN phrase ph ON x.word = string_split(ph.ph, ' ')[1]
      JOIN doc ON doc.r = x.r AND list_slice(doc.ws, x.pos + 1, x.pos + len(string_split(ph.ph, ' '))) = string_split(ph.ph, ' ')),
bs AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
ls AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM good) GROUP BY r),
sc AS (SELECT r, max(share) AS score FROM good GROUP BY r)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, cast(coalesce(n_base, 0) AS bigint) AS n_base, cast(first_word AS bigint) AS first_word,
  cast(last_word AS bigint) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::double) AS score
FROM doc LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN sc USING (r)"""
