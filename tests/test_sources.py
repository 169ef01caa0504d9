"""Files, normalising, loads and the incremental stream."""

import os

import pytest

from pyspark.sql import functions as F

from tallyhound.sources import dataset, files, relational
from tallyhound.streaming.incremental import incremental_load


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_delimited_files(spark, tmp_path):
    path = str(tmp_path / "consumo_2025-09-01.csv")
    with open(path, "w") as f:
        f.write("code;litres;name\n" + "".join(f"00{i};{i}.5;n{i}\n" for i in range(30)))
    df = files.read_delimited(spark, path)
    assert dict(df.dtypes) == {"code": "string", "litres": "double", "name": "string"}
    tables, report = files.group_files(spark, str(tmp_path))
    assert report == [{"table": "consumo", "files": 1, "mode": "unico"}] and tables["consumo"].count() == 30


def test_files_are_grouped_by_their_headers(spark, tmp_path):
    def write(name, header, low, high):
        with open(tmp_path / name, "w") as f:
            f.write(header + "\n" + "".join(f"{i};v{i}\n" for i in range(low, high)))

    write("lote 1 (2).csv", "Clave;Valor", 0, 40)
    write("lote 2.csv", "Clave;Valor", 30, 70)
    os.makedirs(tmp_path / "sub")
    write("sub/lote_2024-05-01.csv", "clave;valor", 70, 90)
    write("otra-0f8fad5b-d9cb-469f-a165-70867728950e.csv", "x;y", 0, 5)
    heads = {r["path"].rsplit("/", 1)[-1]: r["header"] for r in files.file_headers(spark, str(tmp_path)).collect()}
    assert len(heads) == 4 and heads["lote%202.csv"] == "Clave;Valor"
    tables, report = files.group_files(spark, str(tmp_path))
    assert sorted((r["table"], r["files"], r["mode"]) for r in report) == [("lote", 3, "lotes"), ("otra", 1, "unico")]
    assert tables["lote"].select("Clave").distinct().count() == 90 and tables["otra"].count() == 5


def test_patterns_of_names():
    for name, pattern in {"consumo_2025-09-01": "consumo", "Reporte (12)": "Reporte", "lote_3_final": "lote_9_final", "REPORT": "REPORT", "a 2024-01-02T10:00:00": "a",
                          "0f8fad5b-d9cb-469f-a165-70867728950e": "", "dato(1) (2)": "dato", "carga(x)": "carga(x", "abc12": "abc", "": "", "12": ""}.items():
        assert files.name_pattern(name) == pattern, name


def test_batches_and_versions(spark):
    def part(name, time, low, high):
        return spark.range(low, high).select(F.col("id").cast("string").alias("k"), F.lit(name).alias("v"), F.lit(name).alias("_file"), F.lit(time).alias("_mtime"))

    batches = part("a", 1, 0, 600).unionByName(part("b", 2, 500, 720))
    df, mode = files.combine_files(batches)
    assert mode == "lotes" and df.count() == 720 and df.filter("v = 'b'").count() == 220
    versions = part("a", 1, 0, 600).unionByName(part("b", 2, 0, 620))
    df, mode = files.combine_files(versions)
    assert mode == "versiones" and df.count() == 620 and df.filter("v = 'a'").count() == 0


def test_dataset_without_a_table(spark, tmp_path):
    dataset.write_dataset({"refuel": spark.range(3).toDF("id"), "device": None}, str(tmp_path / "d"))
    got = dataset.load_dataset(spark, str(tmp_path / "d"), {"refuel": None, "device": None})
    assert got["device"] is None and got["refuel"].count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "d" / "dictionary.csv")).count() == 1


def test_incremental_load_equals_full_load(spark, tmp_path):
    whole = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") * 2).alias("litres"))
    source = str(tmp_path / "in")
    for i, (low, high) in enumerate([(0, 40), (30, 70), (60, 100)]):
        whole.filter((F.col("litres") >= low * 2) & (F.col("litres") < high * 2)).coalesce(1).write.parquet(f"{source}/part={i}")
    store = relational.KeyedTables(spark, str(tmp_path / "store"), buckets=8)
    flat = f"{source}/*"
    schema = whole.schema
    for _ in range(2):  # the second run finds nothing new
        incremental_load(spark, flat, schema, store, "refuel", str(tmp_path / "ck"), files_per_batch=1)
    assert rows(store.read("refuel").select("id", "litres")) == rows(whole)
    full = relational.KeyedTables(spark, str(tmp_path / "full"))
    assert full.load({"refuel": whole}, "all") == {"refuel": 100}
    assert full.load({"refuel": whole}, "again") == {"refuel": 100}
    assert rows(full.read("refuel")) == rows(store.read("refuel").select("id", "litres"))
    assert os.path.isdir(str(tmp_path / "full" / "_loads"))


def test_a_load_rewrites_the_buckets_it_touches(spark, tmp_path):
    folder = str(tmp_path / "t")
    store = relational.KeyedTables(spark, folder, buckets=16)
    frame = lambda *r: spark.createDataFrame(list(r), "id string, day int, v string")
    store.load({"refuel": frame(*[(str(i), 1, "a") for i in range(60)], (None, 1, "a"))}, "first")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/refuel") for f in names if f.endswith(".parquet")}
    before = files()
    order = {"refuel": ["day"]}
    assert store.load({"refuel": frame(("7", 3, "b"), (None, 2, "b"), ("7", 2, "z"))}, "second", order=order) == {"refuel": 3}
    assert len(before - files()) <= 2
    store.load({"refuel": frame(("7", 1, "late"))}, "third", order=order)
    got = {r["id"]: r["v"] for r in store.read("refuel").collect()}
    assert len(got) == store.read("refuel").count() == 61 and got["7"] == "b" and got[None] == "b" and got["8"] == "a"
    store.load({"refuel": frame(("7", 1, "plain"))}, "fourth")
    assert {r["v"] for r in store.read("refuel").filter("id = '7'").collect()} == {"plain"}
    store.load({"refuel": frame()}, "nothing")
    assert store.read("refuel").count() == 61 and store.read("card") is None
    with pytest.raises(ValueError):
        relational.KeyedTables(spark, folder, buckets=8)
