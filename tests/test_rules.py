"""Golden cases of single rules."""

import pytest
from pyspark.sql import functions as F

from tallyhound.functions.dates import parse_date2, parse_date_text
from tallyhound.functions.text import normalise_id, one_edit_kind
from tallyhound.operators import linkage, sequence
from tallyhound.operators.prepare import typed_refuels
from tallyhound.operators.rules import charges, devices, links, odometer, quality, volume


def ids(df):
    return {r["record_id"] for r in df.collect()}


def readings(spark, rows):
    """(id, vehicle, day of March, odometer)"""
    df = spark.createDataFrame([(i, v, f"2024-03-{d:02d}", "10:00:00", o) for i, v, d, o in rows],
                               "id string, vehicle_id string, date string, time string, odometer long")
    return typed_refuels(df)


def test_dates_and_ids(spark):
    df = spark.createDataFrame([("2024-03-05",), ("05/03/2024",), ("31/12/2024",), ("12/31/2024",)], "t string")
    got = [str(r[0]) for r in df.select(parse_date2(F.col("t"))).collect()]
    assert got == ["2024-03-05", "2024-03-05", "2024-12-31", "None"]
    spellings = spark.createDataFrame([("ab-0001 cd",), ("AB0001CD",), ("ab.0001_cd",), ("AB 0001 CD",)], "t string")
    assert {r[0] for r in spellings.select(normalise_id(F.col("t"))).collect()} == {"AB0001CD"}
    spelled = spark.createDataFrame([("viernes, 12 de septiembre de 2025 9:05",), ("12/09/2025 09:05",), ("nada",)], "t string")
    assert [str(r[0]) for r in spelled.select(parse_date_text(F.col("t"))).collect()] == ["2025-09-12 09:05:00"] * 2 + ["None"]


@pytest.mark.parametrize("a,b,kind", [
    ("AB123CD", "AB123CD", None), ("AB0", "ABO", "confusion_visual"), ("AB1", "AB2", "letra_cambiada"), ("AB12", "BA12", "transposicion"),
    ("AB12", "AB1", "letra_de_mas_o_de_menos"), ("B12", "AB12", "letra_de_mas_o_de_menos"), ("AB12", "BA21", None), ("ABC", "CBA", None)])
def test_one_edit(spark, a, b, kind):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(one_edit_kind(F.col("a"), F.col("b"))).first()
    assert row[0] == kind


def test_sequence_skips_missing_reading(spark):
    steps = sequence.odometer_sequence(readings(spark, [("C1", "A", 1, 1000), ("C2", "A", 2, None), ("C3", "A", 3, 800)]))
    assert [(r["id"], r["km"]) for r in steps.collect()] == [("C3", -200.0)]


def test_excess_with_history(spark):
    vehicles = spark.createDataFrame([("A", 50.0), ("B", 50.0), ("C", 50.0)], "vehicle_id string, tank_capacity double")
    rows = [("A1", "A", 60.0), ("A2", "A", 40.0), ("B1", "B", 40.0), ("B2", "B", 41.0), ("B3", "B", 42.0), ("B4", "B", 60.0), ("C1", "C", 51.0)]
    refuels = spark.createDataFrame([(i, v, f"2024-03-0{i[1]}", l) for i, v, l in rows], "id string, vehicle_id string, date string, litres double")
    got = {r["record_id"]: (r["anomaly_type"], r["probable_cause"]) for r in volume.over_tank_with_history(typed_refuels(refuels), vehicles).collect()}
    assert got == {"A1": ("CAPACIDAD_MAL_REGISTRADA", "capacidad_tanque_mal_registrada"), "B4": ("EXCESO_VOLUMETRICO", "sin_explicacion")}


def test_regression_shapes(spark):
    rows = []
    for v, odo in (("A", [10000, 10100, 110200, 10300, 10400]), ("B", [20000, 20100, 5200, 20300, 20400]), ("C", [30000, 30100, 30090, 30200, 30300])):
        rows += [(f"{v}{i}", v, i + 1, o) for i, o in enumerate(odo)]
    shapes = {r["vehicle_id"]: (r["shape"], r["sub_shape"]) for r in sequence.regression_shapes(sequence.odometer_sequence(readings(spark, rows))).collect()}
    assert shapes == {"A": ("tras_un_salto",) * 2, "B": ("lectura_baja_aislada",) * 2, "C": ("otro", "leve")}
    steps = sequence.odometer_sequence(readings(spark, rows))
    assert ids(odometer.decreases(steps)) == {"A3", "B2", "C2"}
    assert ids(odometer.decreases_in_context(steps)) == {"C2"}


def test_no_advance_with_one_day_exemption(spark):
    refuels = readings(spark, [("C1", "A", 1, 1000), ("C2", "A", 2, 1000), ("C3", "A", 3, 1000), ("C4", "A", 3, 1000)])
    vehicles = spark.createDataFrame([("A", "AA001BB")], "vehicle_id string, plate string")
    exemptions = spark.sql("SELECT 'aa 001 bb' AS plate, DATE'2024-03-02' AS date_from, DATE'2024-03-02' AS date_to")
    exempt = linkage.exempt_refuels(refuels, vehicles, exemptions)
    assert ids(odometer.no_advance_without_exemption(sequence.odometer_sequence(refuels, exempt=exempt))) == {"C3"}


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([("3", "x", None), ("1", "x", None), ("2", "x", None), ("4", "y", 1)], "id string, a string, b int")
    assert ids(quality.exact_duplicates(df)) == {"2", "3"}


def test_double_charge_with_shifted_decimal(spark):
    pairs = [("V1", 1596.0, 15.96, 2), ("V2", 2.0, 20.0, 2), ("V3", 3000.0, 30.0, 2), ("V5", 17.0, 40.0, 2), ("V7", 25.0, 25.0, 14)]
    rows = []
    for n, (v, fallback, usual, hours) in enumerate(pairs, 1):
        rows += [(f"C{n}", v, "2024-03-05", "08:00:00", fallback, "CONTINGENCIA"), (f"U{n}", v, "2024-03-05", f"{8 + hours:02d}:00:00", usual, "POSNET")]
    rows += [("C8", "V8", "2024-03-05", "08:00:00", 30.0, "CONTINGENCIA"), ("U8", "V8", "2024-03-05", "09:00:00", 3.0, "POSNET"),
             ("U9", "V8", "2024-03-05", "10:00:00", 30.0, "POSNET"), ("C9", "V9", "2024-03-05", "08:00:00", 30.0, "CONTINGENCIA")]
    refuels = typed_refuels(spark.createDataFrame(rows, "id string, vehicle_id string, date string, time string, litres double, origin string"))
    found = {r["record_id"]: r["measure"] for r in charges.double_charges(refuels).collect()}
    assert found == {"C1": 1.0, "C2": 1.0, "C3": 1.0, "C8": 0.0}


def test_active_devices_seven_day_edge(spark):
    vehicles = spark.createDataFrame([("A", "P1", "EN TRAMITE DE BAJA", None), ("B", "P2", "BAJA", None), ("C", "P3", "EN SERVICIO", None)],
                                     "vehicle_id string, plate string, state string, engine_number string")
    rows = [("D1", "P1", "2024-03-01 00:00:00"), ("D2", "P2", "2024-02-29 23:59:59"), ("D3", "P3", "2024-03-08 00:00:00"), ("D4", "P2", "sin dato")]
    found = spark.createDataFrame([(a, p, "FLOTA", t) for a, p, t in rows], "alias string, plate string, device_group string, last_contact string")
    assert ids(devices.active_device(vehicles, found)) == {"D1"}
    assert {r["alias"] for r in devices.written_off_unreadable(vehicles, found).collect()} == {"D4"}
    assert ids(links.unlinked_device(found.withColumn("plate", F.lit("QQ")), vehicles)) == {"D1", "D2", "D3", "D4"}


def test_shared_engine_suffix_links_nobody(spark):
    vehicles = spark.createDataFrame([("A", "P1", "X-12345678"), ("B", "P2", "Y-12345678"), ("C", "P3", "Z-87654321")],
                                     "vehicle_id string, plate string, engine_number string")
    codes = spark.createDataFrame([("R1", "P1"), ("R2", "p-1"), ("R3", "87654321"), ("R4", "12345678")], "id string, plate string")
    got = {r["id"]: (r["linked_vehicle"], r["link_tier"]) for r in linkage.link_identifiers(codes, "plate", vehicles).collect()}
    assert got == {"R1": ("A", "exacto"), "R2": ("A", "normalizado"), "R3": ("C", "motor"), "R4": (None, None)}
