"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.hashing import Words, mix, slabs
from tallyhound.llm.quality_rules import text_counts

GOOD, ABSTAIN, BAD = 1, 0, -1
SAMPLE = 20_000  # documents, chosen by hash, to which the scorer is fitted
FEATURES = 1 << 14
ROUNDS = 50
EPOCHS = 8
MEASURE_WEIGHT = 3.0  # of a binned measure; all words of a text together have its length's square root
KEEP = 0.5  # posterior from which the scorer keeps a document
LEAST_WORDS = 1  # a text without words gets no good votes

#: One vote each: (name, measure, bad from, good below); a share of the words or of the characters.
LABELLERS = [
    ("symbols", "symbol_share", 0.06, 0.02),
    ("symbol_words", "symbol_words", 0.25, 0.05),
    ("capitals", "upper_words", 0.40, 0.15),
    ("repeats", "repeated", 0.60, 0.30),
    ("doubled", "doubled", 0.25, 0.05),
    ("bars", "bar_words", 0.15, 0.02),
    ("marks", "mark_words", 0.30, 0.05),
    ("variety", "sameness", 0.75, 0.60),
]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERCASE = np.zeros(256, bool)
_LOWERCASE[97:123] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>^~=+{}[]\\@_")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True


def _per_word(flags: np.ndarray, words: Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[words.end] - sums[words.start]


def measures(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], Words]]:
    """Shares by which the labellers vote, for every text of a batch, computed over the whole text."""
    for rows, counts, data, offsets in text_counts(batch, text):
        words, n = Words(data, offsets, lower=False), rows.num_rows
        total, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
        length = words.end - words.start
        symbols, marks = _per_word(_SYMBOLS[data], words), _per_word(_MARKS[data], words)
        upper, lower = _per_word(_UPPER[data], words), _per_word(_LOWERCASE[data], words)
        same = np.zeros(len(words.hash), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])

        def share(flag: np.ndarray) -> np.ndarray:
            return np.bincount(words.doc[flag], minlength=n) / total

        order = np.lexsort((words.hash, words.doc))
        first = np.ones(len(order), bool)
        first[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
        distinct = np.bincount(words.doc[order][first], minlength=n)
        yield rows, {
            "n_words": counts["n_words"], "symbol_share": np.bincount(words.doc, symbols, n) / chars,
            "symbol_words": share((symbols >= 2) & (symbols < length)), "upper_words": share((upper >= 2) & (lower == 0)),
            "repeated": counts["n_repeat_words"] / total, "doubled": share(same), "bar_words": share((length == 1) & (symbols == 1)),
            "mark_words": share(marks >= 2), "sameness": np.where(counts["n_words"] > 40, 1 - distinct / np.minimum(total, 200 + total * 0.3), 0.5),
        }, words


def votes(values: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers): BAD, GOOD or ABSTAIN. A text with fewer than LEAST_WORDS words gets no good votes."""
    out = np.zeros((len(values["n_words"]), len(LABELLERS)), np.int8)
    enough = values["n_words"] >= LEAST_WORDS
    for k, (_, measure, bad, good) in enumerate(LABELLERS):
        out[:, k] = np.where(values[measure] >= bad, BAD, np.where((values[measure] < good) & enough, GOOD, ABSTAIN))
    return out


@dataclass(frozen=True)
class LabelModel:
    """How the labellers vote on good and on bad texts: log probabilities (class, labeller, vote + 1), and the prior of good."""

    log_table: np.ndarray
    prior: float

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of good per text."""
        picked = self.log_table[:, np.arange(cast.shape[1]), cast.astype(np.int64) + 1].sum(axis=2)
        gap = picked[1] - picked[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(gap, -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns with their counts.

    Starts from the majority (any bad vote outweighs the good ones) and assumes votes independent given the class.
    """
    good = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
    model = LabelModel(np.zeros((2, patterns.shape[1], 3)), 0.5)
    for _ in range(rounds):
        table = np.ones((2, patterns.shape[1], 3))
        for c, weight in ((0, (1 - good) * counts), (1, good * counts)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] += (weight[:, None] * (patterns == v)).sum(axis=0)
        table[0, :, 0] += 1  # a labeller is no worse than chance
        prior = float(np.clip((good * counts).sum() / max(1, counts.sum()), 0.02, 0.98))
        model = LabelModel(np.log(table / table.sum(axis=2, keepdims=True)), prior)
        good = model.posterior(patterns)
    return model


def _vote_counts(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for _, values, _ in measures(batch, text):
                for row in votes(values):
                    seen[row.tobytes()] = seen.get(row.tobytes(), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return run


def _features(values: dict[str, np.ndarray], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight): hashed words by share of the text, and the binned measures."""
    n = len(values["n_words"])
    bucket = (mix(words.hash) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    length = np.sqrt(np.maximum(values["n_words"], 1))
    rows, columns, weights = [words.doc], [bucket], [1 / length[words.doc]]
    for k, (name, *_) in enumerate((m, 0) for _, m, _, _ in LABELLERS):
        level = np.minimum(9, (np.sqrt(np.maximum(values[name], 0)) * 10).astype(np.int64))
        rows.append(np.arange(n))
        columns.append(FEATURES + k * 10 + level)
        weights.append(np.full(n, MEASURE_WEIGHT))
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(weights)


class LinearScorer:
    """Logistic regression on hashed features, fitted by adaptive gradient steps to posterior labels."""

    def __init__(self) -> None:
        self.weight = np.zeros(FEATURES + 10 * len(LABELLERS) + 1)

    def score(self, features: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        row, column, value = features
        gap = np.bincount(row, self.weight[column] * value, n) + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(gap, -60, 60)))

    def fit(self, parts: list[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> None:
        speed = np.full(len(self.weight), 1e-6)
        for _ in range(epochs):
            for features, label in parts:
                row, column, value = features
                error = self.score(features, len(label)) - label
                step = np.bincount(column, error[row] * value, len(self.weight)) / len(label)
                step[-1] = error.mean()
                step += decay * self.weight
                speed += step * step
                self.weight -= rate * step / np.sqrt(speed)


def _classify(text: str, keep: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        for batch in batches:
            for rows, values, words in measures(batch, text):
                weak = model.posterior(votes(values))
                score = scorer.score(_features(values, words), rows.num_rows)
                kept = (score >= KEEP) & (values["n_words"] > 0)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(weak), pa.array(score), pa.array(kept)], [*keep, "weak_label", "score", "kept"])

    return run


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, LinearScorer]:
    """The label model over the votes on all documents, and the scorer fitted to the posteriors of a sample.

    Vote patterns are counted by the tasks, so the driver gets at most 3 ** labellers counts. The scorer sees at
    most ``sample`` documents, chosen by the hash of their text; copies of a text count once there.
    """
    counted = docs.select(text).mapInArrow(_vote_counts(text), "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([np.frombuffer(bytes(r["pattern"]), np.int8) for r in counted], np.int8).reshape(-1, len(LABELLERS))
    counts = np.array([r["n"] for r in counted], np.float64)
    model = fit_labels(patterns, counts)
    part = min(1.0, sample / max(1.0, counts.sum()))
    bound = int(part * 1_000_000)
    scored = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < bound)
    found = scored.mapInArrow(_training_rows(text, model), "print long, label double, columns binary, weights binary").dropDuplicates(["print"])
    rows = found.limit(2 * sample).toArrow().combine_chunks()
    order = np.argsort(rows.column("print").to_numpy(), kind="stable")
    scorer, parts = LinearScorer(), []
    for i in range(0, len(order), 64):
        some = rows.take(pa.array(order[i : i + 64])).to_pydict()
        columns = [np.frombuffer(c, "<i4") for c in some["columns"]]
        row = np.repeat(np.arange(len(columns), dtype=np.uint8), [len(c) for c in columns])
        parts.append(((row, np.concatenate(columns), np.concatenate([np.frombuffer(w, "<f4") for w in some["weights"]])), np.array(some["label"])))
    del rows
    pa.default_memory_pool().release_unused()
    scorer.fit(parts)
    return model, scorer


def _training_rows(text: str, model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, words in measures(batch, text):
                row, column, weight = _features(values, words)
                joint, at = np.unique(row * (1 << 20) + column, return_inverse=True)
                summed = np.bincount(at, weight)
                cut = np.searchsorted(joint >> 20, np.arange(rows.num_rows + 1))
                column = (joint & ((1 << 20) - 1)).astype("<i4")
                prints = [int(mix(words.hash[a:b] + np.arange(b - a, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True).view(np.int64)[0]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(prints, pa.int64()), pa.array(model.posterior(votes(values))),
                    pa.array([column[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([summed[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ], ["print", "label", "columns", "weights"])

    return run


def classify(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Add ``weak_label`` (posterior of the label model), ``score`` (of the scorer) and ``kept`` to every document.

    A document is kept if its score reaches KEEP; a null text or one without words is not. Every row is judged by
    its whole text, repeated rows alike. Columns of ``docs`` named like an added one are replaced. An empty table
    gives an empty result.
    """
    docs = docs.drop(*[c for c in ("weak_label", "score", "kept") if c != text])
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text, sample))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "weak_label double, score double, kept boolean"])
    return docs.mapInArrow(_classify(text, docs.columns, shared), schema)
