"""The queries of this subpackage; thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes."""
    from tallyhound.llm.sharding import shard_by_bytes

    out = shard_by_bytes(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic counts of every document and the verdict of the log-likelihood ratio, target: documents labelled good."""
    from tallyhound.llm.quality_rules import judge

    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    return judge(_table(spark, sf_dir, "documents"), good).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and the block, shard and place of the first of them (null if none)."""
    from tallyhound.llm.mixing import mix_sources

    draws, docs = mix_sources(_table(spark, sf_dir, "documents"))
    first = F.min(F.struct("pass", "block", "shard", "place")).alias("first")
    taken = draws.groupBy("__row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), first)
    return docs.join(taken, "__row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first.block", "first.shard", "first.place")


def tokenizer_path() -> str:
    """Where the public vocabulary lies: beside the module ``public_tokenizers`` if it is there."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    from tallyhound.llm.packing import pack, tokenised_pieces

    return pack(tokenised_pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False))


@_query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from tallyhound.llm.ngram_jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    from tallyhound.llm.embedding_forest import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from tallyhound.llm.html_main import main_text

    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's score and decision for all documents; it sees no labels."""
    from tallyhound.llm.quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents")).select("doc_id", "weak_label", "score", "kept")


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later lines of recurring templates."""
    from tallyhound.llm.line_dedup import drop_recurring_lines

    return drop_recurring_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "dropped_lines")


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat one of an earlier document, with the first occurrence."""
    from tallyhound.llm.substring_dedup import repeated_paragraphs

    return repeated_paragraphs(_table(spark, sf_dir, "documents")).drop("row")


@_query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents."""
    from tallyhound.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"), ["doc_id"])


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    from tallyhound.llm.prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; labels of every seventh are moved on by one first."""
    from tallyhound.llm.hard_negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def _oracles() -> dict[str, str]:
    from tallyhound.llm import hard_negatives, license_scan, prefix_trie

    return {"op11_license_scan": license_scan.oracle_sql(), "op12_prefix_trie": prefix_trie.oracle_sql(),
            "op13_hard_negatives": hard_negatives.oracle_sql()}


ORACLES |= _oracles()
