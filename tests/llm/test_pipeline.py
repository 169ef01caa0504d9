"""The corpus pipeline from end to end on a small table with nulls, empty and repeated rows."""

import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline  # noqa: E402
from tallyhound.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    copies = [(1000 + i, given[0][1], "en", "hot", 0) for i in range(60)]
    odd = [(2000, None, None, None, None), (2001, "", "en", None, 0), (2002, "  ", "en", "b", 2), (None, given[1][1], "en", "b", 1), given[2], given[2]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([*given, *copies, *odd], DOCS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_stages_hand_on_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), DOCS)
        assert docs.columns == corpus_pipeline.DOCUMENT and docs.count() > 0, name


def test_run_packs_ids_that_decode_to_kept_text(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    source = {(r["text"] or "").strip() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"] and r["offset"] + r["length"] <= 2048
        if r["piece"] == 0:
            opening = tokenizer.decode(ids[ids != 0][:40].tolist()).strip().split("\n")[0][:15]
            assert any(opening in t for t in source), opening
    ends = {(r["sequence_id"], r["offset"] + r["length"]) for r in rows} | {(r["sequence_id"], 0) for r in rows}
    assert all((r["sequence_id"], r["offset"]) in ends for r in rows)  # no holes


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
