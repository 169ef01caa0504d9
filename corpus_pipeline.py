"""From raw documents to packed training sequences, in five stages that each start from what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, characters counted anew (null for a null text)."""
    return df.select(*DOCUMENT[:-1], F.char_length("text").cast("long").alias("n_chars"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the weakly supervised classifier rejects."""
    from tallyhound.llm.quality_classifier import classify

    return classify(docs).filter("kept").select(*DOCUMENT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the later occurrences of lines whose template recurs across documents."""
    from tallyhound.llm.line_dedup import drop_recurring_lines

    return _documents(drop_recurring_lines(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: the one with the smallest id (null last), of these the one with the smallest hash.

    Rows are told apart by id and text, so rows that share an id but not their text stand for themselves, and rows
    without an id are deduplicated like all others. Rows equal in id and text are one, also if they hold no words.
    """
    from tallyhound.llm.ngram_jaccard import near_duplicates

    docs = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    component = near_duplicates(docs.select("__row", "text"), key="__row").select("__row", "component_id").distinct()
    names = docs.groupBy("__row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row", "lang", "source")).alias("first"))
    first = names.join(component, "__row").groupBy("component_id").agg(F.min("first").alias("first")).select("first.__row", "first.lang", "first.source")
    first = first.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(first.columns)])
    same = (F.col("__row") == F.col("__0")) & F.col("lang").eqNullSafe(F.col("__1")) & F.col("source").eqNullSafe(F.col("__2"))
    return docs.join(first, same, "left_semi").dropDuplicates(["__row"]).select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws: a row per document and pass, cut short where the mix takes only a part.

    Rows are written shard by shard, in the shuffled order of each shard; a shard may take several files.
    """
    from tallyhound.llm.mixing import mixed_documents

    mixed = mixed_documents(docs).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return _documents(mixed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, token ids (16 bits each) included, with their place in sequences of 2048 tokens."""
    from tallyhound.llm.packing import pack as best_fit
    from tallyhound.llm.packing import tokenised_pieces
    from tallyhound.llm.queries import tokenizer_path

    return best_fit(tokenised_pieces(docs, tokenizer_path(), id_bytes=2, memo=250_000))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # no stage can be stated in SQL; tests/llm holds the brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table; each stage but the last is written to the shared folder and read again."""
    from tallyhound.llm.common import shared_folder

    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
