"""Profile, suppression and exploration queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyhound.functions import bands, text
from tallyhound.functions.dates import instant, parse_date2, parse_date_text
from tallyhound.functions.geo import haversine_km
from tallyhound.operators import eda, profile, suppress
from tallyhound.operators.matching import greedy_day_pairs
from tallyhound.plans.queries_links import NORM, refuels, requests
from tallyhound.plans.queries_matching import GREEDY
from tallyhound.plans.registry import Inputs, query

ACCENTS = text.ACCENTED, text.PLAIN


def shape_sql(c: str) -> str:
    folded = f"translate(trim(cast({c} as varchar)), '{ACCENTS[0]}', '{ACCENTS[1]}')"
    plain = f"regexp_replace({folded}, '[^\\x00-\\x7F]', '', 'g')"
    s = f"regexp_replace(regexp_replace({plain}, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g')"
    return f"CASE WHEN length({s}) <= 60 THEN {s} ELSE substr({s}, 1, 60) || '…' END"


def pct_sql(a: str, b: str) -> str:
    return f"round_even(100.0 * ({a}) / nullif({b}, 0), 1)"


@query("pf01_value_shapes", [], f"SELECT page_id, {shape_sql('url')} AS shape FROM pages")
def _(x: Inputs):
    return x.table("pages").select("page_id", text.value_shape(F.col("url")).alias("shape"))


_TABLES = [("pages", "url"), ("customer", "c_name"), ("orders", "o_orderpriority"), ("events", "event_type"),
           ("documents", "source"), ("part", "p_brand")]


def counts(x: Inputs):
    out = None
    for table, column in _TABLES:
        part = profile.value_counts(x.table(table), [column])
        out = part if out is None else out.unionByName(part)
    return out


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", cast({c} as varchar) AS v FROM {t}" for t, c in _TABLES)


_IS_DATE = "regexp_matches(shape, '^9{1,4}[-/.]9{1,2}[-/.]9{1,4}([ T]9{1,2}:9{2}(:9{2})?(\\.9+)?)?$')"
_IS_CODE = "(length(shape) >= 6 AND NOT regexp_matches(shape, '^9{1,2}:9{2}(:9{2})?(\\.9+)?$') AND length(regexp_replace(shape, '[^9]', '', 'g')) / length(shape) >= 0.6)"
# Distinct values of columns with their shape, and the type and the kind of sensitive data that they show.
_TYPES = """
d AS (SELECT "column", v, {shape} AS shape, count(*) AS n FROM l WHERE v IS NOT NULL AND upper(trim(v)) NOT IN ('', 'NAN') GROUP BY ALL),
s AS (SELECT "column", shape, sum(n) AS n FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, shape) AS k FROM s),
a AS (SELECT "column", sum(n) AS total, count(*) AS shapes, sum(n) FILTER ({date}) AS dates, sum(n) FILTER ({code}) AS codes,
             bool_or(k <= 3 AND shape IN ({plates})) AS plates, max(length(shape)) FILTER (k = 1) AS main FROM r GROUP BY 1),
b AS (SELECT "column", count(*) AS distinct_values, sum(n) FILTER (try_cast(replace(v, ',', '.') AS double) IS NOT NULL) AS numbers FROM d GROUP BY 1),
t AS (SELECT *, CASE WHEN total < 20 THEN 'desconocido' WHEN coalesce(dates, 0) / total >= 0.9 THEN 'fecha como texto'
                     WHEN round_even(100.0 * coalesce(numbers, 0) / total, 1) >= 90 THEN 'número como texto' ELSE 'texto' END AS type FROM a JOIN b USING ("column")),
typed AS (SELECT "column", type, distinct_values, CASE WHEN type NOT IN ('texto', 'número como texto') THEN NULL WHEN plates THEN 'vehiculo'
            WHEN (main > 30 OR shapes > 40) AND distinct_values / total > 0.5 THEN 'texto libre'
            WHEN distinct_values / total > 0.95 AND distinct_values > 50 THEN 'identificador' WHEN coalesce(codes, 0) / total >= 0.5 THEN 'identificador' END AS sensitive_by_value FROM t)""".format(
    shape=shape_sql("v"), date=_IS_DATE, code=_IS_CODE, plates=", ".join(f"'{p}'" for p in profile.PLATE_SHAPES))


@query("pf02_shape_histogram", [], f"""
WITH l AS (SELECT "column", {shape_sql('v')} AS shape FROM ({_LONG}) WHERE v IS NOT NULL AND upper(trim(v)) NOT IN ('', 'NAN')),
g AS (SELECT "column", shape, count(*) AS n FROM l GROUP BY 1, 2),
t AS (SELECT "column", sum(n) AS total FROM g GROUP BY 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, shape) AS r FROM g WHERE n >= 20) WHERE r <= 10),
o AS (SELECT t."column", total - coalesce(sum(n), 0) AS n FROM t LEFT JOIN k ON k."column" = t."column" GROUP BY t."column", total),
p AS (SELECT k."column", shape, {pct_sql('n', 'total')} AS pct FROM k JOIN t ON t."column" = k."column"
      UNION ALL SELECT o."column", 'OTRA_CATEGORIA_SINTETIZABLE', {pct_sql('n', 'total')} FROM o JOIN t ON t."column" = o."column" WHERE n > 0),
z AS (WITH l AS ({_LONG}), {_TYPES} SELECT "column" FROM typed WHERE sensitive_by_value IS NOT NULL)
SELECT "column", CASE WHEN "column" NOT IN (SELECT "column" FROM z) OR length(shape) <= 20 OR shape = 'OTRA_CATEGORIA_SINTETIZABLE' THEN shape
  WHEN length(shape) <= 40 THEN 'TEXTO_21-40' ELSE 'TEXTO_MAS_DE_40' END AS shape, round_even(sum(pct), 1) AS pct FROM p GROUP BY 1, 2""")
def _(x: Inputs):
    return profile.shape_histogram(counts(x))


@query("pf07_categories", [], f"""
WITH z AS (WITH l AS ({_LONG}), {_TYPES} SELECT "column" FROM typed WHERE sensitive_by_value IS NOT NULL),
g AS (SELECT "column", trim(v) AS value, count(*) AS n FROM ({_LONG}) WHERE "column" NOT IN (SELECT "column" FROM z) AND v IS NOT NULL AND upper(trim(v)) NOT IN ('', 'NAN') GROUP BY 1, 2),
t AS (SELECT "column", sum(n) AS total FROM g GROUP BY 1 HAVING count(*) <= 50),
k AS (SELECT g.* FROM g JOIN t ON t."column" = g."column" WHERE n >= 20),
o AS (SELECT t."column", total - coalesce(sum(n), 0) AS n FROM t LEFT JOIN k ON k."column" = t."column" GROUP BY t."column", total)
SELECT k."column", value, {pct_sql('n', 'total')} AS pct FROM k JOIN t ON t."column" = k."column"
UNION ALL SELECT o."column", 'OTRA_CATEGORIA_SINTETIZABLE', {pct_sql('n', 'total')} FROM o JOIN t ON t."column" = o."column" WHERE n > 0""")
def _(x: Inputs):
    return profile.categories(counts(x))


_GUARDED = [("conductor", "driver"), ("patente", "plate"), ("NumeroTarjeta", "card"), ("producto", "product"), ("origen", "origin"), ("clave", "id_type")]


@query("pf07_categories_without_sensitive", ["refuel"], " UNION ALL ".join(f"""
SELECT '{name}' AS "column", {c} AS value, round_even(100.0 * count(*) / (SELECT count({c}) FROM refuel), 1) AS pct FROM refuel
WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 20""" for name, c in _GUARDED if name in ("producto", "origen")))
def _(x: Inputs):
    named = x.view("refuel").select(*[F.col(c).alias(name) for name, c in _GUARDED])
    return profile.categories(profile.value_counts(named))


# Per table: column, declared kind, sensitivity of the name in the oracle.
_TYPED = {
    "orders": [("o_orderkey", "number"), ("o_totalprice", "number"), ("o_orderdate", "date"), ("o_orderstatus", "text"), ("o_orderpriority", "text")],
    "labels": [("quality", "number"), ("toxic", "number")], "events": [("event_id", "number"), ("user_id", "number"), ("value", "number"), ("ts", "date"), ("event_type", "text")],
    "pages": [("url", "text")]}
_TYPED_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, cast({c} as varchar) AS v FROM {t}" for t, columns in _TYPED.items() for c, k in columns)


@query("pf04_column_types", [], f"""WITH raw AS ({_TYPED_VALUES}), l AS (SELECT "column", v FROM raw), {_TYPES},
x AS (SELECT "column", any_value(kind) AS kind, count(*) AS n, bool_and(try_cast(v AS double) IN (0, 1)) AS flags, count(*) FILTER (try_cast(v AS double) = 1 OR v = 'true') AS yes,
             bool_and(try_cast(v AS double) = round(try_cast(v AS double))) AS whole, bool_and(abs(try_cast(v AS double)) <= 90) AS angle,
             median(length(string_split(v, '.')[-1])) AS decimals, median(length(v)) AS digits, count(*) FILTER (kind = 'date' AND length(v) > 10 AND substr(v, 12) <> '00:00:00') AS timed
      FROM raw WHERE v IS NOT NULL AND upper(trim(v)) NOT IN ('', 'NAN') GROUP BY 1),
y AS (SELECT x.*, sensitive_by_value AS s, CASE WHEN kind = 'number' AND flags THEN 'booleano' WHEN kind = 'date' THEN 'fecha' WHEN kind = 'number' AND whole THEN 'entero'
        WHEN kind = 'number' THEN 'decimal' ELSE type END AS type FROM x JOIN typed USING ("column"))
SELECT "column", type, CASE WHEN "column" IN ('event_id', 'user_id') THEN 'identificador' WHEN type = 'decimal' AND angle AND decimals >= 4 THEN 'ubicacion'
    WHEN type = 'entero' AND digits >= 11 THEN 'identificador' WHEN type IN ('texto', 'número como texto') THEN s END AS sensitive,
  CASE WHEN type = 'booleano' THEN round_even(100.0 * yes / n, 1) END AS true_pct, CASE WHEN type = 'fecha' THEN round_even(100.0 * timed / n, 1) END AS with_time_pct FROM y""")
def _(x: Inputs):
    out = [profile.column_types(x.table(t), [c for c, _ in columns]) for t, columns in _TYPED.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("pf04_column_overview", [], f"""
WITH l AS (SELECT "column", CASE WHEN upper(trim(v)) NOT IN ('', 'NAN') THEN v END AS v FROM ({_LONG})),
s AS (SELECT "column", count(*) AS n, count(v) AS p, count(DISTINCT v) AS d,
             count(*) FILTER (WHERE v <> trim(v)) + count(*) FILTER (WHERE regexp_matches(v, '\\s{{2,}}')) AS sp,
             count(*) FILTER (WHERE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')) AS mx,
             count(*) FILTER (WHERE try_cast(replace(v, ',', '.') as double) IS NOT NULL) AS nu FROM l GROUP BY 1)
SELECT "column", n AS "rows", {pct_sql('n - p', 'n')} AS missing_pct,
       CASE WHEN d = 0 THEN '0' WHEN d <= 1 THEN '1' WHEN d <= 10 THEN '2–10' WHEN d <= 100 THEN '11–100' WHEN d <= 1000 THEN '101–1.000'
            WHEN d <= 10000 THEN '1.001–10.000' ELSE '>10.000' END AS cardinality, {pct_sql('d', 'p')} AS unique_pct,
       {pct_sql('sp', 'p')} AS extra_spaces_pct, {pct_sql('mx', 'p')} AS mixed_case_pct, {pct_sql('nu', 'p')} AS numbers_as_text_pct FROM s""")
def _(x: Inputs):
    return profile.column_overview(counts(x)).select("column", "rows", "missing_pct", "cardinality", "unique_pct",
                                                     "extra_spaces_pct", "mixed_case_pct", "numbers_as_text_pct")


@query("pf04_text_types", [], f"""WITH l AS ({_LONG}), {_TYPES} SELECT "column", type, sensitive_by_value FROM typed""")
def _(x: Inputs):
    return profile.text_types(counts(x))


_DIGITS = "CASE WHEN {v} = 0 THEN 0 ELSE round_even({v} / pow(10, floor(log10(abs({v}))) - 1), 0) * pow(10, floor(log10(abs({v}))) - 1) END"
_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pf05_numeric_profile", [], " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {', '.join(f"round({_DIGITS.format(v=f'quantile_cont({c}, {q})')}, 6) AS {n}" for n, q in profile.QUANTILES.items())},
       {pct_sql(f'count(*) FILTER (WHERE {c} = 0)', f'count({c})')} AS zeros_pct, {pct_sql(f'count(*) FILTER (WHERE {c} < 0)', f'count({c})')} AS negatives_pct,
       {pct_sql(f'count(*) FILTER (WHERE {c} = round({c}))', f'count({c})')} AS whole_pct FROM lineitem""" for c in _NUMERIC))
def _(x: Inputs):
    out = profile.numeric_profile(x.table("lineitem"), _NUMERIC)
    return out.withColumns({n: F.round(n, 6) for n in profile.QUANTILES})


@query("pf06_dates", [], """
WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS k, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT dayname(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT 'month' AS section, k AS key, cast(round_even(n / 10.0, 0) * 10 as double) AS value FROM g WHERE n >= 20
UNION ALL SELECT 'weekday_pct', k, round_even(100.0 * n / (SELECT count(*) FROM orders), 1) FROM w WHERE n >= 20""")
def _(x: Inputs):
    return profile.date_profile(x.table("orders"), "o_orderdate")


_KEYS = ", ".join(
    f"(SELECT CASE WHEN count(DISTINCT {c}) = count(*) AND count(*) >= 20 THEN '{c}' END FROM orders)"
    for c in ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"))


@query("pf09_table_profile", [], f"""
WITH t AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS d FROM orders)
SELECT 'orders' AS "table", CASE WHEN n < 1000 THEN '100–999' WHEN n < 10000 THEN '1.000–9.999' WHEN n < 100000 THEN '10.000–99.999'
       ELSE '100.000–999.999' END AS "rows", round_even(n / pow(10, floor(log10(n)) - 1), 0) * pow(10, floor(log10(n)) - 1) AS rows_approx,
       cast(6 as int) AS columns, round_even(100.0 * (n - d) / n, 1) AS duplicate_rows_pct, concat_ws(', ', {_KEYS}) AS candidate_keys FROM t""")
def _(x: Inputs):
    return profile.table_profile(x.table("orders"), "orders")


@query("pf10_whole_profile")
def _(x: Inputs):
    out = None
    for name in derive_tables():
        table = x.table(name)
        rows = profile.column_overview(profile.value_counts(table)).withColumn("table", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def derive_tables():
    from tallyhound.plans.derive import _TABLES as names

    return names


@query("pf11_bands", [], """
WITH g AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN n = 0 THEN '0' WHEN n < 20 THEN '<20' WHEN n < 100 THEN '20–99' WHEN n < 1000 THEN '100–999' WHEN n < 10000
       THEN '1.000–9.999' ELSE '10.000–99.999' END AS count_band, CASE WHEN d <= 1 THEN '1' WHEN d <= 10 THEN '2–10' WHEN d <= 100 THEN '11–100'
       WHEN d <= 1000 THEN '101–1.000' WHEN d <= 10000 THEN '1.001–10.000' ELSE '>10.000' END AS cardinality FROM g""")
def _(x: Inputs):
    g = x.table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("d"))
    return g.select("l_suppkey", bands.count_band(F.col("n")).alias("count_band"), bands.cardinality_band(F.col("d")).alias("cardinality"))


_PARTS = """
WITH p AS (SELECT o_custkey % 40 AS block, o_orderpriority AS part, count(*) FILTER (WHERE (o_orderkey * 7) % 11 < 2 + o_custkey % 4) AS n
           FROM orders GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY block) + block % 3 * 5 AS total FROM p),
v AS (SELECT *, coalesce(sum(CASE WHEN n >= 20 THEN n END) OVER (PARTITION BY block), 0) AS shown,
             CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY block, n >= 20 ORDER BY n, part) END AS r FROM t)
SELECT block, part, n, cast(total as bigint) AS total,
       CASE WHEN n > 0 AND n < 20 THEN '1–19' WHEN r = 1 AND total >= 20 AND total - shown > 0 AND total - shown < 20 THEN NULL
            ELSE cast(n as varchar) END AS published FROM v"""


@query("pf12_suppressed_parts", [], _PARTS)
def _(x: Inputs):
    keep = (F.col("o_orderkey") * 7) % 11 < 2 + F.col("o_custkey") % 4
    parts = x.table("orders").groupBy((F.col("o_custkey") % 40).alias("block"), F.col("o_orderpriority").alias("part")).agg(
        F.count_if(keep).alias("n"))
    totals = parts.groupBy("block").agg((F.sum("n") + F.first(F.col("block") % 3 * 5)).alias("total"))
    return suppress.suppress_parts(parts.join(totals, "block"), ["block"]).select("block", "part", "n", "total", "published")


@query("pf12_suppressed_axis", [], """
WITH cells AS (SELECT o_custkey % 25 AS block, strftime(o_orderdate, '%Y') AS year, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL),
f AS (SELECT *, sum(n) OVER (PARTITION BY block, status) + 7 AS ft, sum(n) OVER (PARTITION BY block) + 7 AS bt, n = 0 OR n >= 20 AS open1 FROM cells),
g AS (SELECT *, ft - sum(CASE WHEN open1 THEN n ELSE 0 END) OVER (PARTITION BY block, status) AS rest,
             row_number() OVER (PARTITION BY block, status ORDER BY (open1 AND n >= 20) DESC, n, year, status) AS place FROM f),
h AS (SELECT *, open1 AND NOT (ft >= 20 AND rest > 0 AND rest < 20 AND open1 AND n >= 20 AND place = 1) AS open2 FROM g),
i AS (SELECT *, bt - sum(CASE WHEN open2 THEN n ELSE 0 END) OVER (PARTITION BY block) AS rest2,
             row_number() OVER (PARTITION BY block ORDER BY (open2 AND n >= 20) DESC, n, year, status) AS place2 FROM h)
SELECT block, year, status, n, CASE WHEN n > 0 AND n < 20 THEN '1–19'
  WHEN open2 AND NOT (bt >= 20 AND rest2 > 0 AND rest2 < 20 AND open2 AND n >= 20 AND place2 = 1) THEN n::varchar END AS published FROM i""")
def _(x: Inputs):
    o = x.table("orders").select((F.col("o_custkey") % 25).alias("block"), F.date_format("o_orderdate", "yyyy").alias("year"),
                                 F.col("o_orderstatus").alias("status"))
    cells = o.groupBy("block", "year", "status").agg(F.count(F.lit(1)).alias("n"))
    totals = o.groupBy("block", F.col("status")).agg((F.count(F.lit(1)) + 7).alias("total")).unionByName(
        o.groupBy("block").agg(F.lit(None).cast("string").alias("status"), (F.count(F.lit(1)) + 7).alias("total")))
    return suppress.suppress_axis(cells, ["block"], "year", "status", "n", totals)


@query("pf13_profile_gaps", [], """
WITH p("column", other) AS (VALUES ('c_custkey', 's_suppkey'), ('c_name', 's_name'), ('c_nationkey', 's_nationkey'), ('c_acctbal', 's_acctbal')),
d AS (SELECT 'c_custkey' AS c, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer
      UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer
      UNION ALL SELECT 's_suppkey', count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 's_name', count(DISTINCT s_name) FROM supplier
      UNION ALL SELECT 's_nationkey', count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 's_acctbal', count(DISTINCT s_acctbal) FROM supplier),
b AS (SELECT c, CASE WHEN n <= 1 THEN '1' WHEN n <= 10 THEN '2–10' WHEN n <= 100 THEN '11–100' WHEN n <= 1000 THEN '101–1.000'
             WHEN n <= 10000 THEN '1.001–10.000' ELSE '>10.000' END AS band FROM d)
SELECT 'baja' AS severity, p."column", 'cardinalidad' AS aspect, l.band AS real_value, r.band AS other_value
FROM p JOIN b l ON l.c = p."column" JOIN b r ON r.c = p.other WHERE l.band <> r.band
UNION ALL SELECT 'alta', 'c_mktsegment', 'columna no modelada', 'c_mktsegment', NULL""")
def _(x: Inputs):
    left = profile.column_overview(profile.value_counts(x.table("customer")))
    right = profile.column_overview(profile.value_counts(x.table("supplier")))
    bare = lambda df: df.select("column", F.substring("column", 3, 100).alias("bare"))
    key = F.when(F.col("bare").endswith("key") & ~F.col("bare").startswith("nation"), "key").otherwise(F.col("bare"))
    pairs = bare(left).select(F.col("column"), key.alias("k")).join(bare(right).select(F.col("column").alias("other"), key.alias("k")), "k")
    return profile.compare_profiles(left, right, pairs.select("column", "other"))


@query("jn17_paired_columns", [], """
WITH c AS (SELECT substr(column_name, 3) AS a FROM (DESCRIBE customer)), s AS (SELECT substr(column_name, 3) AS b FROM (DESCRIBE supplier)),
n AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS near FROM c, s)
SELECT a AS "column", b AS other FROM n WHERE near >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY near DESC, b DESC) = 1""")
def _(x: Inputs):
    left = profile.column_overview(profile.value_counts(x.table("customer"))).withColumn("column", F.substring("column", 3, 100))
    right = profile.column_overview(profile.value_counts(x.table("supplier"))).withColumn("column", F.substring("column", 3, 100))
    return profile.pair_columns(left, right)


@query("pf14_small_shares", [], """
WITH t AS (SELECT sum(r_regionkey) AS s FROM region)
SELECT string_agg(cast(share as varchar), ',' ORDER BY share DESC) AS share_pct, cast((SELECT s FROM t) as double) AS total_approx
FROM (SELECT cast(round_even(r_regionkey * 100.0 / (SELECT s FROM t), 0) as bigint) AS share FROM region)""")
def _(x: Inputs):
    return profile.small_table_shares(x.table("region"), "r_regionkey").withColumn(
        "share_pct", F.array_join(F.col("share_pct").cast("array<string>"), ","))


@query("prj10_replaced_texts", [], """
SELECT doc_id, regexp_replace(regexp_replace(source, 'src1', 'north', 'gi'), 'src', 'south', 'gi') AS source FROM documents""")
def _(x: Inputs):
    return profile.replace_texts(x.table("documents").select("doc_id", "source"), "source", {"src": "south", "SRC1": "north"})


@query("jn16_relations", [], "WITH " + ",\n".join(
    f"{a} AS (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)" for a, t, c in
    [("cn", "customer", "c_name"), ("sn", "supplier", "s_name"), ("doc", "documents", "doc_id"), ("lab", "labels", "doc_id")]) + """
SELECT 'labels.doc_id' AS origin, 'documents.doc_id' AS target, round_even(100.0 * (SELECT count(*) FROM lab JOIN doc USING (v)) / (SELECT count(*) FROM lab), 1) AS exact_pct,
       round_even(100.0 * (SELECT count(*) FROM lab JOIN doc USING (v)) / (SELECT count(*) FROM lab), 1) AS normalised_pct
UNION ALL SELECT 'documents.doc_id', 'labels.doc_id', p, p FROM (SELECT round_even(100.0 * (SELECT count(*) FROM lab JOIN doc USING (v)) / (SELECT count(*) FROM doc), 1) AS p)
WHERE p >= 50""")
def _(x: Inputs):
    return profile.discover_relations({
        "customer": x.table("customer").select("c_name"), "supplier": x.table("supplier").select("s_name"),
        "documents": x.table("documents").select("doc_id"), "labels": x.table("labels").select("doc_id")})


_RATIO = "l_extendedprice / (l_quantity * 1500)"


@query("prj08_price_bands", [], f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r < 0.95 THEN 'menos_de_0_95' WHEN r < 0.98 THEN 'de_0_95_a_0_98' WHEN r < 1.0 THEN 'de_0_98_a_1_00'
       WHEN r <= 1.02 THEN 'de_1_00_a_1_02' ELSE 'mas_de_1_02' END AS billed, CASE WHEN r <= 1.05 THEN '1_02_a_1_05' WHEN r <= 1.10 THEN '1_05_a_1_10'
       WHEN r <= 1.25 THEN '1_10_a_1_25' WHEN r <= 1.5 THEN '1_25_a_1_50' ELSE 'mas_de_1_50' END AS tank,
       CASE WHEN abs(r - 1) = 0 THEN 'exacta' WHEN abs(r - 1) <= 0.001 THEN 'hasta_0_1_pct' WHEN abs(r - 1) <= 0.005 THEN 'de_0_1_a_0_5_pct'
            WHEN abs(r - 1) <= 0.02 THEN 'de_0_5_a_2_pct' ELSE 'mas_de_2_pct' END AS difference
FROM (SELECT *, {_RATIO} AS r FROM lineitem)""")
def _(x: Inputs):
    r = F.expr(_RATIO)
    return x.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bands.billed_price_band(r).alias("billed"),
                                      bands.tank_ratio_band(r).alias("tank"), bands.amount_difference_band(F.abs(r - 1)).alias("difference"))


@query("prj02_two_date_forms", [], """
SELECT o_orderkey, cast(o_orderdate as date) AS iso, cast(o_orderdate as date) AS day_first, cast(NULL as date) AS neither FROM orders""")
def _(x: Inputs):
    d = F.col("o_orderdate")
    return x.table("orders").select(
        "o_orderkey", parse_date2(F.date_format(d, "yyyy-MM-dd")).alias("iso"), parse_date2(F.date_format(d, " dd/MM/yyyy")).alias("day_first"),
        parse_date2(F.date_format(d, "yyyy.MM.dd")).alias("neither"))


@query("prj03_spelled_dates", [], """
SELECT event_id, epoch_us(date_trunc('minute', ts)) AS spelled, epoch_us(date_trunc('second', ts)) AS iso FROM events""")
def _(x: Inputs):
    t = F.col("ts").cast("timestamp")
    names = F.array(*[F.lit(m) for m in ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre",
                                         "octubre", "noviembre", "diciembre")])
    spelled = F.concat(F.lit("Lunes, "), F.dayofmonth(t), F.lit(" de "), F.element_at(names, F.month(t)), F.lit(" de "), F.year(t),
                       F.lit(" "), F.date_format(t, "H:mm:ss"))
    return x.table("events").select("event_id", F.unix_micros(parse_date_text(spelled)).alias("spelled"),
                                    F.unix_micros(parse_date_text(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))).alias("iso"))


@query("prj04_instants", ["refuel"], """
SELECT id, cast(epoch(cast(date || ' ' || coalesce(time, '00:00:00') as timestamp)) as bigint) AS at_second FROM refuel""")
def _(x: Inputs):
    return x.view("refuel").select("id", F.unix_seconds(instant(F.col("date").cast("date"), F.col("time"))).alias("at_second"))


@query("prj05_clean_values", [], """
SELECT c_custkey, regexp_replace(c_name, '\\D', '', 'g') AS digits, try_cast(' ' || c_acctbal as double) AS number FROM customer""")
def _(x: Inputs):
    return x.table("customer").select("c_custkey", text.digits_only(F.col("c_name")).alias("digits"),
                                      text.as_number(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).alias("number"))


@query("prj06_categories", [], """
SELECT p_partkey, CASE WHEN upper(p_type) LIKE '%STEEL%' OR upper(p_type) LIKE '%BRASS%' THEN 'metal' WHEN upper(p_type) LIKE '%ECON%'
       THEN 'economy' ELSE 'otro' END AS category FROM part""")
def _(x: Inputs):
    return x.table("part").select("p_partkey", text.categorise(F.col("p_type"), {"metal": ["steel", "brass"], "economy": ["econ"]}).alias("category"))


@query("prj07_filtered_orders", [], "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(x: Inputs):
    from tallyhound.sources.dataset import filter_in

    return filter_in(x.table("orders"), {"o_orderstatus": ["P", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey", "o_orderstatus")


@query("geo03_haversine", ["station"], """
SELECT code, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat + 34.6) / 2), 2) + cos(radians(-34.6)) * cos(radians(lat))
       * pow(sin(radians(lon + 58.4) / 2), 2))), 6) AS km FROM station""")
def _(x: Inputs):
    return x.view("station").select("code", F.round(haversine_km(F.lit(-34.6), F.lit(-58.4), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("ag05_category_counts", [], f"""
SELECT c_mktsegment AS category, count(*) AS n, {pct_sql('count(*)', '(SELECT count(*) FROM customer)')} AS pct FROM customer GROUP BY 1""")
def _(x: Inputs):
    return eda.category_counts(x.table("customer"), "c_mktsegment")


@query("ag06_fleet_coverage", ["vehicle", "device"], f"""
SELECT state, CASE WHEN {NORM.format(c='plate')} IN (SELECT {NORM.format(c='plate')} FROM device) THEN 'Con' ELSE 'Sin' END AS device, count(*) AS n
FROM vehicle GROUP BY 1, 2""")
def _(x: Inputs):
    return eda.fleet_coverage(x.view("vehicle"), x.view("device"))


@query("ag07_litres_by_type", ["refuel", "vehicle"], """
SELECT coalesce(vehicle_type, 'Sin dato') AS vehicle_type, count(*) AS refuels, round(sum(litres), 2) AS litres_total, median(litres) AS litres_median
FROM refuel r LEFT JOIN vehicle v ON v.vehicle_id = r.vehicle_id GROUP BY 1""")
def _(x: Inputs):
    return eda.litres_by_type(x.view("refuel"), x.view("vehicle"))


_POINTS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("ag07_percentiles", [], " UNION ALL ".join(
    f"SELECT '{c}' AS variable, '{p}' AS percentile, round(quantile_cont({c}, {q}), 4) AS value FROM orders"
    for c in ("o_totalprice", "o_custkey") for p, q in _POINTS.items()))
def _(x: Inputs):
    return eda.percentiles(x.table("orders"), ["o_totalprice", "o_custkey"], _POINTS).withColumn("value", F.round("value", 4))


@query("ag08_time_profile", ["refuel"], """
WITH r AS (SELECT *, cast(date as date) AS d FROM refuel)
SELECT 'month' AS section, strftime(d, '%Y-%m') AS key, count(*) AS refuels, round(sum(litres), 2) AS litres FROM r GROUP BY 2
UNION ALL SELECT 'weekday', cast(isodow(d) as varchar), count(*), round(sum(litres), 2) FROM r GROUP BY 2
UNION ALL SELECT 'hour', cast(cast(substr(time, 1, 2) as int) as varchar), count(*), round(sum(litres), 2) FROM r WHERE time IS NOT NULL GROUP BY 2""")
def _(x: Inputs):
    return eda.time_profile(refuels(x))


@query("ag09_column_quality", [], f"""
WITH l AS (SELECT 'part' AS source, c, v FROM (SELECT 'p_brand' AS c, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part
           UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_size', cast(p_size as varchar) FROM part))
SELECT source, c AS "column", count(*) AS "rows", {pct_sql('count(v)', 'count(*)')} AS complete_pct, count(DISTINCT v) AS distinct_values,
       {pct_sql('count(DISTINCT v)', 'count(*)')} AS unique_pct FROM l GROUP BY 1, 2""")
def _(x: Inputs):
    return eda.column_quality(x.table("part").select("p_brand", "p_type", "p_name", "p_size"), "part")


@query("ag09_link_quality", ["refuel", "vehicle"], f"""
WITH k AS (SELECT CASE WHEN id_type = 'DNI' THEN 'Tarjeta personal' WHEN plate IN (SELECT plate FROM vehicle) THEN 'Coincide exactamente'
  WHEN {NORM.format(c='plate')} IN (SELECT {NORM.format(c='plate')} FROM vehicle) THEN 'Coincide solo normalizado' ELSE 'Sin vínculo con la flota' END AS match FROM refuel)
SELECT match, count(*) AS n, {pct_sql('count(*)', '(SELECT count(*) FROM refuel)')} AS pct FROM k GROUP BY 1""")
def _(x: Inputs):
    return eda.link_quality(x.view("refuel"), x.view("vehicle"))


@query("ag10_leg_coverage", ["refuel", "vehicle", "daily_track"], f"""
WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM vehicle v JOIN daily_track t ON t.plate = v.plate
  WHERE v.vehicle_id = r.vehicle_id AND t.date = cast(r.date as date))) AS covered FROM refuel r)
SELECT 'Carga → GPS diario' AS leg, covered, total, {pct_sql('covered', 'total')} AS pct FROM c""")
def _(x: Inputs):
    return eda.leg_coverage(refuels(x), x.view("vehicle"), None, x.view("daily_track"), None)


@query("ag10_all_legs", ["refuel", "request", "vehicle", "daily_track"], f"""WITH RECURSIVE {GREEDY},
c AS (SELECT count(*) AS total, count(*) FILTER (id IN (SELECT refuel_id FROM daily_pairs)) AS asked, count(*) FILTER (product = 'DIESEL') AS billed,
             count(*) FILTER (EXISTS (SELECT 1 FROM vehicle v JOIN daily_track t ON t.plate = v.plate
                                      WHERE v.vehicle_id = r.vehicle_id AND t.date = cast(r.date as date))) AS tracked FROM refuel r),
u AS (SELECT unnest([{{'leg': 'Pedido → carga', 'covered': asked}}, {{'leg': 'Carga → GPS diario', 'covered': tracked}},
                     {{'leg': 'Carga → línea facturada', 'covered': billed}}]) AS i, total FROM c)
SELECT i.leg AS leg, i.covered AS covered, total, {pct_sql('i.covered', 'total')} AS pct FROM u""")
def _(x: Inputs):
    r = refuels(x)
    lines = r.filter(F.col("product") == "DIESEL").select(F.col("id").alias("refuel_ref"))
    return eda.leg_coverage(r, x.view("vehicle"), greedy_day_pairs(r, requests(x)), x.view("daily_track"), lines)


@query("ag12_percentile_comparison", [], """
WITH h AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS early, quantile_cont(o_totalprice, 0.05) AS p05, quantile_cont(o_totalprice, 0.5) AS p50,
                  quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1),
l AS (UNPIVOT h ON p05, p50, p95 INTO NAME percentile VALUE v)
SELECT 'o_totalprice' AS variable, a.percentile, a.v AS approved, round(b.v, 3) AS "current", round(round(b.v, 3) - a.v, 3) AS difference
FROM l a JOIN l b ON a.percentile = b.percentile AND a.early AND NOT b.early""")
def _(x: Inputs):
    o = x.table("orders")
    points = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    early = eda.percentiles(o.filter("o_orderdate < '1998-01-01'"), ["o_totalprice"], points)
    late = eda.percentiles(o.filter("o_orderdate >= '1998-01-01'"), ["o_totalprice"], points)
    return eda.compare_percentiles(early, late)


@query("ag13_alerts_by_month", ["alert", "refuel"], """
SELECT a.rule, strftime(cast(r.date as date), '%Y-%m') AS month, count(DISTINCT a.record_id) AS records
FROM alert a LEFT JOIN refuel r ON r.id = a.record_id GROUP BY 1, 2""")
def _(x: Inputs):
    return eda.alerts_by_month(x.view("alert"), refuels(x).select(F.col("id").alias("record_id"), "date"))


@query("ag14_device_state_table", ["vehicle", "device"], f"""
WITH d AS (SELECT {NORM.format(c='plate')} AS p, device_group = 'BAJA / REEMPLAZOS' AS depot, try_cast(last_contact as timestamp) AS s FROM device),
r AS (SELECT p, max(CASE WHEN depot THEN CASE WHEN coalesce((SELECT max(s) FROM d) - s <= INTERVAL '7' DAY, false) THEN 2 ELSE 1 END
                    WHEN coalesce((SELECT max(s) FROM d) - s <= INTERVAL '7' DAY, false) THEN 4 ELSE 3 END) AS r FROM d GROUP BY 1),
c AS (SELECT state, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE coalesce(r, 0) = {i}) AS c{i}" for i in range(5))}
      FROM vehicle v LEFT JOIN r ON r.p = {NORM.format(c='v.plate')} GROUP BY 1)
SELECT state, {', '.join(f"CASE WHEN {c} > 0 AND {c} < 20 THEN '1–19' ELSE cast({c} as varchar) END AS {n}" for c, n in
                         zip(['n', 'c0', 'c1', 'c2', 'c3', 'c4'], ['vehicles', 'sin_dispositivo', 'deposito_sin_transmitir', 'deposito_transmite',
                                                                   'otro_grupo_sin_transmitir', 'otro_grupo_transmite']))} FROM c""")
def _(x: Inputs):
    return eda.device_state_table(x.view("vehicle"), x.view("device"))


@query("ag15_complete_months", [], """
WITH d AS (SELECT DISTINCT cast(o_orderdate as date) AS d FROM orders),
m AS (SELECT strftime(d, '%Y-%m') AS month, count(*) AS days, max(day(d)) AS last, max(day(last_day(d))) AS n FROM d GROUP BY 1)
SELECT month, days FROM m WHERE days >= n * 0.9 AND last > n - 3""")
def _(x: Inputs):
    return eda.complete_months(x.table("orders"), "o_orderdate")


@query("ag18_table_stats", ["refuel"], """
SELECT count(*) AS "rows", cast(sum((vehicle_id IS NULL)::int + (plate IS NULL)::int + (time IS NULL)::int + (station IS NULL)::int
       + (driver IS NULL)::int + (odometer IS NULL)::int) as bigint) AS nulls, cast(16 as int) AS columns FROM refuel""")
def _(x: Inputs):
    return eda.table_stats(x.view("refuel"))


@query("ag19_prevalence", ["truth", "benign"], f"""
SELECT 'anomaly' AS kind, count(*) AS cases, count(DISTINCT record_id) AS records, {pct_sql('count(DISTINCT record_id)', '(SELECT count(*) FROM documents)')} AS prevalence_pct FROM truth
UNION ALL SELECT 'benign', count(*), count(DISTINCT record_id), {pct_sql('count(DISTINCT record_id)', '(SELECT count(*) FROM documents)')} FROM benign""")
def _(x: Inputs):
    return eda.prevalence(x.view("truth"), x.view("benign"), x.table("documents"))
