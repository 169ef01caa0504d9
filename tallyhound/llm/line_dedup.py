"""Line dedup with a log-template tree: lines of one template that recurs across documents are dropped but for the first."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import written

DEPTH = 3  # leading tokens that lead to a leaf, below the number of tokens
LEAST_TOKENS = 6  # shorter lines are templates as they stand, without fields
LEAST_DOCUMENTS = 10  # different texts in which a template recurs
SALTS = 8  # tasks over which the lines of one template are dealt when its first line is looked up
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_VARIABLE = re.compile(r"\d|@|://")
FIELD = "<*>"


def templates(line: str, depth: int = DEPTH, least: int = LEAST_TOKENS) -> tuple[str, ...]:
    """The templates that a line falls under; none for a line of a single word, which may be a mark of structure.

    A line of fewer than ``least`` tokens, or of variable fields alone, is a template as it stands.

    The tree's first level is the number of tokens, the next ``depth`` levels are the leading tokens, with tokens
    that hold a digit or an address as a variable field. In a leaf a template fixes one half of the remaining
    tokens and leaves the other half as a field. So a line has two templates, and the whole line lies in both.
    """
    words = _WORDS.findall(line)
    tokens = [FIELD if _VARIABLE.search(t) else t for t in words]
    if len(words) < 2:
        return ()
    if len(words) < least or all(t == FIELD for t in tokens):
        return ("\0".join([str(len(words)), "", *words]),)
    leaf, rest = [str(len(tokens)), *tokens[:depth]], tokens[depth:]
    if len(rest) < 4 or len(tokens) < 10:  # half of so few tokens says too little
        return ("\0".join([*leaf, "=", *rest]),)
    middle = len(rest) // 2
    return "\0".join([*leaf, "<", *rest[:middle]]), "\0".join([*leaf, ">", *rest[middle:]])


def _rows(text: str, key: str, depth: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, body in enumerate(batch.column(text).to_pylist()):
                for number, line in enumerate((body or "").split("\n")):
                    for t in templates(line, depth, least):
                        for column, x in zip(out, (i, number, xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)), strict=True):
                            column.append(x)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(at), batch.column("__row").take(at), batch.column("__text").take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())],
                ["id", "row", "print", "line", "template"])

    return run


def recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(row, line): lines to drop, ``row`` being the hash of key and text, ``line`` the number in the text from 0.

    A template recurs if it stands in at least ``least_documents`` different texts. Its first line, by smallest
    key (null last) and line number, is kept. Texts are counted per template in two steps, so that a template
    with a third of all lines is combined before it meets anywhere; its lines then meet the first one in SALTS parts.
    """
    marked = docs.select(key, text, F.xxhash64(key, text).alias("__row"), F.xxhash64(text).alias("__text"))
    kind = docs.schema[key].dataType.simpleString()
    lines = written(marked.mapInArrow(_rows(text, key, depth, least_tokens), f"id {kind}, row long, print long, line int, template long"))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row", "line")
    per_text = lines.groupBy("template", "print").agg(F.min(place).alias("first"))
    recurring = per_text.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).filter(F.col("texts") >= least_documents)
    firsts = recurring.select(F.col("template").alias("t"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("u"))
    salted = lines.withColumns({"place": place, "salt": F.pmod("row", F.lit(SALTS)).cast("int")})
    later = salted.join(firsts.hint("merge"), (F.col("template") == F.col("t")) & (F.col("salt") == F.col("u")))
    return later.filter(~F.col("place").eqNullSafe(F.col("first"))).select("row", "line").distinct()


def drop_recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without its recurring lines, and ``dropped_lines``, their numbers.

    A null text stays null; a text that loses all its lines is empty. Rows equal in key and text are treated alike,
    so the first line of a template stays in each of them. A column ``dropped_lines`` of ``docs`` is replaced.
    """
    docs = docs.drop(*[c for c in ("dropped_lines",) if c not in (text, key)])
    gone = recurring_lines(docs, text, key, depth, least_tokens, least_documents)
    gone = written(gone.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("__gone")))
    marked = docs.withColumn("__row", F.xxhash64(key, text)).join(gone.withColumnRenamed("row", "__r").hint("merge"), F.col("__row") == F.col("__r"), "left")
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest)
    return marked.select(*[cleaned.alias(text) if c == text else F.col(c) for c in docs.columns], F.coalesce("__gone", F.array().cast("array<int>")).alias("dropped_lines"))
