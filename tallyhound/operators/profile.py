"""Profiles of a table: structure and quality, never rows or single values of sensitive columns.

Everything starts from one table of distinct values per column with their counts, aggregated before the
shuffle; long texts travel as a digest.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions.bands import MINIMUM_GROUP, cardinality_band, count_band, share, two_digits
from tallyhound.functions.text import as_number, fold_accents, normalise_id, value_shape
from tallyhound.operators.settle import settle

# Fixed values.
OTHER = "OTRA_CATEGORIA_SINTETIZABLE"
MAX_CATEGORIES = 50
TOP_SHAPES = 10
FREE_TEXT_SHAPE = 30
FREE_TEXT_SHAPES = 40
SENSITIVE_SHAPE = 20
PLATE_SHAPES = ["AAA999", "AAA 999", "AA999AA", "AA 999 AA", "A999AAA"]
TEXTUAL_EMPTY = ["", "-", "--", "S/D", "SD", "N/A", "NA", "NULL", "NONE", "SIN DATO", "SIN DATOS", "."]
SENSITIVE_HINTS = {
    "identificador": ["id", "codigo", "cod", "numero", "nro", "num", "imei", "matricula", "chasis", "motor", "tarjeta",
                      "msisdn", "ticket", "serie", "cuenta", "cbu", "legajo", "password", "hash", "hashed", "token", "secret",
                      "clave", "extracto", "remito"],
    "persona": ["nombre", "nombres", "apellido", "apellidos", "conductor", "chofer", "responsable", "dni", "cuit", "cuil",
                "email", "mail", "correo", "telefono", "celular", "usuario", "firma", "username", "user", "login",
                "solicitante", "cargador", "retira", "agente"],
    "vehiculo": ["dominio", "patente", "placa"],
    "ubicacion": ["lat", "lon", "lng", "latitud", "longitud", "direccion", "domicilio", "calle", "coordenada", "coordenadas",
                  "ubicacion", "geo", "localidad", "provincia"],
    "organizacion": ["depend", "contrato", "establecimiento"],
    "texto libre": ["observacion", "observaciones", "comentario", "comentarios", "descripcion", "detalle", "nota", "notas",
                    "motivo", "glosa", "leyenda"],
}
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_LONG = 200


def normalise_name(name: str) -> str:
    """``Fecha_Carga`` and ``fechaCarga`` both become ``fecha carga``."""
    from tallyhound.functions.text import ACCENTED, PLAIN

    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", str(name)).translate(str.maketrans(ACCENTED, PLAIN)).lower()
    return " ".join(re.findall(r"[a-z0-9]+", spaced))


def sensitivity_of_name(name: str) -> str | None:
    """The kind of sensitive data a column's name hints at."""
    words = normalise_name(name).split()
    for kind, hints in SENSITIVE_HINTS.items():
        if any(w in hints or any(len(h) > 3 and w.startswith(h) for h in hints) for w in words):
            return kind
    return None


def name_sensitivity(name: Column) -> Column:
    """``sensitivity_of_name`` as an expression over a column of names."""
    words = F.split(F.trim(F.regexp_replace(F.lower(fold_accents(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " "))), "[^a-z0-9]+", " ")), " ")

    def hinted(hints: list[str]) -> Column:
        long = [h for h in hints if len(h) > 3]
        return F.exists(words, lambda w: w.isin(hints) | (w.rlike("^(" + "|".join(long) + ")") if long else F.lit(False)))

    kinds = [F.when(hinted(hints), kind) for kind, hints in SENSITIVE_HINTS.items()]
    return F.coalesce(*kinds)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n, shape, chars, number`` for every distinct value, nulls and blank texts included as null."""
    types = dict(df.dtypes)
    columns = columns or [c for c in df.columns if not types[c].startswith(("array", "map", "struct", "binary"))]
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns
    ])
    long = df.select(F.explode(items).alias("i")).select("i.column", "i.text")
    blank = F.upper(F.trim("text")).isin("", "NAN")
    text = F.when(~blank, F.col("text"))

    def facts(text: Column) -> dict[str, Column]:
        spaces = (text != F.trim(text)).cast("int") + text.rlike(r"\s{2,}").cast("int")
        return {
            "shape": value_shape(text), "chars": F.length(text), "number": as_number(F.replace(text, F.lit(","), F.lit("."))), "spaces": spaces,
            "textual_empty": F.upper(F.trim(text)).isin(TEXTUAL_EMPTY), "mixed_case": text.rlike("[a-z]") & text.rlike("[A-Z]")}

    # What a short text tells follows from the value and is worked out once per distinct one; only of long texts it travels
    digested = F.length(text) > _LONG
    told = F.struct(*[c.alias(name) for name, c in facts(text).items()])
    keyed = long.select("column", F.when(digested, F.sha2(text, 256)).otherwise(text).alias("value"), F.when(digested, told).alias("__long"))
    counted = keyed.groupBy("column", "value", "__long").agg(F.count(F.lit(1)).alias("n"))
    was_long = F.col("__long").isNotNull()
    return counted.select("column", "value", *[
        F.when(was_long, F.col("__long")[name]).otherwise(c).alias(name) for name, c in facts(F.col("value")).items()], "n")


def column_overview(counts: DataFrame) -> DataFrame:
    """Missing share, cardinality band, unique share and text quality of every column."""
    present = F.col("value").isNotNull()
    n = F.when(present, F.col("n")).otherwise(0)
    weigh = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(n).alias("present"), F.count_if(present).alias("distinct"),
        F.sum(F.col("spaces") * F.col("n")).alias("spaces"), weigh(F.col("textual_empty")).alias("empties"),
        weigh(F.col("mixed_case")).alias("mixed"), weigh(F.col("number").isNotNull()).alias("numbers"),
        F.count_distinct(F.when(present, F.col("shape"))).alias("shapes"))
    of_present = lambda c: share(F.coalesce(F.col(c), F.lit(0)), F.col("present"))
    return sums.select(
        "column", "rows", share(F.col("rows") - F.col("present"), F.col("rows")).alias("missing_pct"),
        F.when(F.col("present") == 0, "0").otherwise(cardinality_band(F.col("distinct"))).alias("cardinality"),
        of_present("distinct").alias("unique_pct"), of_present("spaces").alias("extra_spaces_pct"),
        of_present("empties").alias("textual_empty_pct"), of_present("mixed").alias("mixed_case_pct"),
        of_present("numbers").alias("numbers_as_text_pct"), "shapes", "distinct", "present")


def _guarded(counts: DataFrame, sensitive: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The counts, computed once where they are needed to find the sensitive columns as well, and those columns."""
    if sensitive is not None:
        return counts, sensitive
    counts = settle(counts)
    return counts, sensitive_columns(counts)


def shape_histogram(counts: DataFrame, top: int = TOP_SHAPES, sensitive: DataFrame | None = None) -> DataFrame:
    """The most frequent shapes of each column in percent; groups under 20 and the rest are pooled.

    Long shapes of sensitive columns (by default those of ``sensitive_columns``) show how units or persons are named, so
    only the band of their length is told.
    """
    counts, sensitive = _guarded(counts, sensitive)
    present = counts.filter(F.col("value").isNotNull())
    shapes = present.groupBy("column", "shape").agg(F.sum("n").alias("n"))
    totals = shapes.groupBy("column").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("shape"))
    ranked = shapes.filter(F.col("n") >= MINIMUM_GROUP).withColumn("__rank", F.row_number().over(order)).filter(
        F.col("__rank") <= top).select("column", "shape", "n")
    told = _pooled(ranked, totals, "shape").join(sensitive.select("column", F.lit(True).alias("__guarded")), "column", "left")
    long = F.col("__guarded") & (F.length("shape") > SENSITIVE_SHAPE) & (F.col("shape") != OTHER)
    band = F.when(F.length("shape") <= 2 * SENSITIVE_SHAPE, "TEXTO_21-40").otherwise("TEXTO_MAS_DE_40")
    told = told.withColumn("shape", F.when(long, band).otherwise(F.col("shape")))
    return told.groupBy("column", "shape").agg(F.bround(F.sum("pct"), 1).alias("pct"))


def _pooled(visible: DataFrame, totals: DataFrame, label: str) -> DataFrame:
    """The visible groups with their share, and one pooled row for what is left of the total."""
    shown = visible.groupBy("column").agg(F.sum("n").alias("__shown"))
    rest = totals.join(shown, "column", "left").withColumn("n", F.col("total") - F.coalesce("__shown", F.lit(0))).filter(
        F.col("n") > 0)
    rows = visible.join(totals, "column").select("column", label, "n", "total").unionByName(
        rest.select("column", F.lit(OTHER).alias(label), "n", "total"))
    return rows.select("column", label, share(F.col("n"), F.col("total")).alias("pct"))


def categories(counts: DataFrame, maximum: int = MAX_CATEGORIES, sensitive: DataFrame | None = None) -> DataFrame:
    """Values of the columns with few distinct ones, never of sensitive ones; groups under 20 are pooled."""
    counts, sensitive = _guarded(counts, sensitive)
    # A row per column goes to all tasks: dealt by column, all values of a column would be sorted in one
    open_columns = counts.join(F.broadcast(sensitive.select("column")), "column", "left_anti")
    present = open_columns.filter(F.col("value").isNotNull()).groupBy("column", F.trim("value").alias("value")).agg(
        F.sum("n").alias("n"))
    sizes = present.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    few = sizes.filter(F.col("distinct") <= maximum).select("column", "total")
    visible = present.filter(F.col("n") >= MINIMUM_GROUP).join(F.broadcast(few), "column", "left_semi")
    return _pooled(visible, few, "value")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Publishable quantiles with two digits, and the share of zeros, negatives and whole numbers.

    A quantile is published only where it leaves at least 20 observations on either side. Values are
    counted per distinct value first, so the exact percentile works on the counts.
    """
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(items).alias("i")).select("i.column", "i.x").filter(F.col("x").isNotNull())
    from tallyhound.operators.skew import group_quantiles

    quantiles = group_quantiles(long, ["column"], "x", QUANTILES, hot_rows=0)
    shares = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == 0).alias("zeros"),
        F.count_if(F.col("x") < 0).alias("negatives"), F.count_if(F.col("x") == F.rint("x")).alias("whole"))
    joined = shares.join(quantiles, "column")
    published = [
        F.when(F.lit(min(q, 1 - q)) * F.col("n") >= MINIMUM_GROUP, two_digits(F.col(name))).alias(name)
        for name, q in QUANTILES.items()
    ]
    return joined.select("column", *published, *[
        share(F.col(c), F.col("n")).alias(f"{c}_pct") for c in ("zeros", "negatives", "whole")])


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """Counts per month (rounded to tens) and shares per weekday; groups under 20 are left out."""
    at = F.col(column)
    days = df.filter(at.isNotNull()).groupBy(F.to_date(at).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    months = days.groupBy(F.date_format("d", "yyyy-MM").alias("key")).agg(total.alias("n"))
    weekdays = days.groupBy(F.date_format("d", "EEEE").alias("key")).agg(total.alias("n"))
    rows = days.agg(total.alias("n")).scalar()
    return months.filter(F.col("n") >= MINIMUM_GROUP).select(
        F.lit("month").alias("section"), "key", F.bround(F.col("n").cast("double"), -1).alias("value")
    ).unionByName(weekdays.filter(F.col("n") >= MINIMUM_GROUP).select(
        F.lit("weekday_pct").alias("section"), "key", share(F.col("n"), rows).alias("value")))


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Row band, rows in two digits, columns, share of duplicate rows and the candidate keys."""
    types = dict(df.dtypes)
    flat = [c for c in df.columns if not types[c].startswith(("array", "map", "struct"))]
    as_row = df.withColumn("__h", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    repeats = as_row.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    sums = repeats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct"))
    facts = column_overview(value_counts(df, flat))
    key = (F.col("present") == F.col("rows")) & (F.col("distinct") == F.col("rows")) & (F.col("rows") >= MINIMUM_GROUP)
    keys = facts.agg(F.array_join(F.sort_array(F.collect_list(F.when(key, F.col("column")))), ", ").alias("k")).scalar()
    enough = F.col("rows") >= MINIMUM_GROUP
    return sums.select(
        F.lit(name).alias("table"), count_band(F.col("rows")).alias("rows"),
        F.when(enough, two_digits(F.col("rows").cast("double"))).alias("rows_approx"),
        F.lit(len(df.columns)).alias("columns"),
        F.when(enough, share(F.col("rows") - F.col("distinct"), F.col("rows"))).alias("duplicate_rows_pct"),
        keys.alias("candidate_keys"))


# Shapes of dates and times.
_DATE_SHAPE = r"^9{1,4}[-/.]9{1,2}[-/.]9{1,4}([ T]9{1,2}:9{2}(:9{2})?(\.9+)?)?$"
_TIME_SHAPE = r"^9{1,2}:9{2}(:9{2})?(\.9+)?$"


def text_types(counts: DataFrame) -> DataFrame:
    """What text columns hold and why they count as sensitive beyond their name: ``column, type, sensitive_by_value``."""
    present = counts.filter(F.col("value").isNotNull())
    shapes = present.groupBy("column", "shape").agg(F.sum("n").alias("n"))
    ranks = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("shape"))
    top3 = shapes.withColumn("__rank", F.row_number().over(ranks)).filter(F.col("__rank") <= 3).groupBy("column").agg(
        F.max(F.col("shape").isin(PLATE_SHAPES)).alias("plates"),
        F.max(F.when(F.col("__rank") == 1, F.length("shape"))).alias("main_length"))
    code = (F.length("shape") >= 6) & ~F.col("shape").rlike(_TIME_SHAPE) & (
        F.length(F.regexp_replace("shape", "[^9]", "")) / F.length("shape") >= 0.6)
    weigh = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    about = shapes.groupBy("column").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("shapes"), weigh(F.col("shape").rlike(_DATE_SHAPE)).alias("dates"),
        weigh(code).alias("codes"))
    numbers = present.groupBy("column").agg(weigh(F.col("number").isNotNull()).alias("numbers"),
                                            F.count(F.lit(1)).alias("distinct"))
    rows = about.join(numbers, "column").join(top3, "column")
    unique = F.col("distinct") / F.col("total")
    free = (F.col("main_length") > FREE_TEXT_SHAPE) | (F.col("shapes") > FREE_TEXT_SHAPES)
    kind = F.when(F.col("total") < MINIMUM_GROUP, "desconocido").when(F.col("dates") / F.col("total") >= 0.9, "fecha como texto").when(
        share(F.col("numbers"), F.col("total")) >= 90, "número como texto").otherwise("texto")
    reason = F.when(kind.isin("texto", "número como texto"), F.when(F.col("plates"), "vehiculo").when(
        free & (unique > 0.5), "texto libre").when((unique > 0.95) & (F.col("distinct") > MAX_CATEGORIES), "identificador").when(
        F.col("codes") / F.col("total") >= 0.5, "identificador"))
    return rows.select("column", kind.alias("type"), reason.alias("sensitive_by_value"))


def sensitive_columns(counts: DataFrame) -> DataFrame:
    """``column, sensitive`` of the columns that are sensitive by their name or by what their values look like."""
    named = counts.select("column").distinct().select("column", name_sensitivity(F.col("column")).alias("__name"))
    both = named.join(text_types(counts), "column", "left").select("column", F.coalesce("__name", "sensitive_by_value").alias("sensitive"))
    return both.filter(F.col("sensitive").isNotNull())


def column_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, type, sensitive, true_pct, with_time_pct`` of every column, from one table of distinct values.

    Each type is a condition on all present values, counted in one aggregate: boolean within integer within decimal;
    dates by their declared type; text by its shapes. A column under 20 values is not typed. Sensitive are columns by
    name, decimals that look like coordinates, integers as long as device or account numbers, and texts by ``text_types``.
    """
    counts = value_counts(df, columns)
    kinds = {"boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "string": "text"}
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    declared = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, kinds.get(t, "number" if t.startswith(numeric) else "other"))])
    number = F.col("value").try_cast("double")
    n = F.col("n")
    facts = counts.filter(F.col("value").isNotNull()).groupBy("column").agg(
        F.sum("n").alias("total"), F.min(F.coalesce(number.isin(0.0, 1.0), F.lit(False))).alias("flags"),
        F.sum(F.when((number == 1) | (F.col("value") == "true"), n).otherwise(0)).alias("true"),
        F.min(F.coalesce(number == F.rint(number), F.lit(False))).alias("whole"), F.min(F.coalesce(number.between(-90, 90), F.lit(False))).alias("angle"),
        F.percentile(F.length(F.substring_index("value", ".", -1)), 0.5, n).alias("decimals"),
        F.percentile(F.length(F.col("value").try_cast("decimal(38,0)").cast("string")), 0.5, n).alias("digits"),
        F.sum(F.when(F.col("value").rlike(" (?!00:00:00$)"), n).otherwise(0)).alias("timed"))
    rows = facts.join(text_types(counts), "column").withColumns({"kind": declared[F.col("column")], "name": name_sensitivity(F.col("column"))})
    kind, few = F.col("kind"), F.col("total") < MINIMUM_GROUP
    typed = (
        F.when(few, "desconocido").when((kind == "boolean") | ((kind == "number") & F.col("flags")), "booleano").when(kind == "date", "fecha")
        .when((kind == "number") & F.col("whole"), "entero").when(kind == "number", "decimal").otherwise(F.col("type"))
    )
    rows = rows.withColumn("typed", typed)
    amount = F.nullif(F.col("name"), F.lit("organizacion"))  # the price of a place is an amount, not the place's name
    sensitive = (
        F.when(F.col("typed") == "decimal", F.coalesce(amount, F.when(F.col("angle") & (F.col("decimals") >= 4), "ubicacion")))
        .when(F.col("typed") == "entero", F.coalesce(amount, F.when(F.col("digits") >= 11, "identificador")))
        .when(F.col("typed").isin("texto", "número como texto"), F.coalesce("name", "sensitive_by_value")).otherwise(F.col("name"))
    )
    told = lambda c, when: F.when(when, share(F.col(c), F.col("total")))
    return rows.select("column", F.col("typed").alias("type"), sensitive.alias("sensitive"), told("true", F.col("typed") == "booleano").alias("true_pct"),
                       told("timed", F.col("typed") == "fecha").alias("with_time_pct"))


def discover_relations(tables: dict[str, DataFrame], minimum: float = 0.5, minimum_distinct: int = 50) -> DataFrame:
    """Share of the distinct values of a column found in a nearly unique column of another table.

    Exact and after normalising. All columns become one long table of (column, value); one equi-join on the
    value meets every pair of columns that share values, instead of one comparison per pair. A value that
    occurs in a column counts once, so the join sees at most one row per column and value.
    """
    parts = []
    for name, df in tables.items():
        for column, kind in df.dtypes:
            usable = kind in ("string", "varchar") or (
                kind in ("bigint", "int", "smallint") and sensitivity_of_name(column) in ("identificador", "vehiculo"))
            if usable:
                parts.append(df.select(F.lit(f"{name}.{column}").alias("column"), F.lit(name).alias("table"),
                                       F.trim(F.col(column).cast("string")).alias("value")))
    values = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("value").isNotNull())
    counted = values.groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows")).filter(
        (F.col("rows") >= MINIMUM_GROUP) & (F.col("distinct") >= 2))
    sources = sizes.filter(F.col("distinct") >= minimum_distinct).select("column", "distinct")
    targets = sizes.filter(F.col("distinct") / F.col("rows") >= 0.9).select("column")

    def coverage(key: Column, label: str) -> DataFrame:
        keyed = counted.select("table", "column", key.alias("__key")).distinct()
        left = keyed.join(sources.select("column"), "column", "left_semi")
        right = keyed.join(targets, "column", "left_semi")
        base = left.groupBy("column").agg(F.count(F.lit(1)).alias("__base"))
        # How often each key meets each target column is summed per pair; the key itself is not kept.
        met = left.select("__key", F.col("table").alias("from_table"), F.col("column").alias("origin")).join(
            right.select("__key", F.col("table").alias("to_table"), F.col("column").alias("target")), "__key"
        ).filter(F.col("from_table") != F.col("to_table")).groupBy("origin", "target").agg(F.count(F.lit(1)).alias("__met"))
        return met.join(base.withColumnRenamed("column", "origin"), "origin").select(
            "origin", "target", (F.col("__met") / F.col("__base")).alias(label))

    exact, normal = coverage(F.col("value"), "exact"), coverage(normalise_id(F.col("value")), "normalised")
    return normal.join(exact, ["origin", "target"], "left").filter(F.col("normalised") >= minimum).select(
        "origin", "target", F.bround(F.coalesce("exact", F.lit(0.0)) * 100, 1).alias("exact_pct"),
        F.bround(F.col("normalised") * 100, 1).alias("normalised_pct"))


def small_table_shares(df: DataFrame, column: str) -> DataFrame:
    """Shares of a numeric column of a small table, largest first, tied to no row; for tables under 20 rows."""
    total = df.agg(F.sum(column).alias("t")).scalar()
    rows = df.agg(F.count(column).alias("n")).scalar()
    small = df.filter((rows < MINIMUM_GROUP) & F.col(column).isNotNull())
    return small.agg(
        F.sort_array(F.collect_list(F.bround(F.col(column) * 100.0 / total, 0).cast("long")), asc=False).alias("share_pct"),
        two_digits(F.sum(column).cast("double")).alias("total_approx"))


def replace_texts(long: DataFrame, column: str, replacements: dict[str, str]) -> DataFrame:
    """Replace names in one pass, longest first, whatever their case; a replacement is not replaced again."""
    if not replacements:
        return long
    ordered = sorted(replacements, key=len, reverse=True)
    lower = {k.lower(): v for k, v in replacements.items()}
    pattern = "(?i)(" + "|".join(re.escape(k) for k in ordered) + ")"
    pieces = F.split(F.regexp_replace(F.col(column), pattern, "\u0001$1\u0001"), "\u0001")
    mapping = F.create_map(*[F.lit(x) for pair in lower.items() for x in pair])
    told = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(mapping, F.lower(p)), p)), "")
    return long.withColumn(column, told)


def suggest_pairing(left: dict[str, list[str]], right: dict[str, list[str]], minimum: float = 0.2) -> dict[str, str]:
    """Tables of two profiles paired by the overlap of their normalised column names."""
    names = {k: {normalise_name(c) for c in v} for k, v in right.items()}
    out = {}
    for table, columns in left.items():
        mine = {normalise_name(c) for c in columns}
        best = max(names, key=lambda t: (len(mine & names[t]) / max(len(mine | names[t]), 1), t), default=None)
        if best is not None and len(mine & names[best]) / max(len(mine | names[best]), 1) >= minimum:
            out[table] = best
    return out


def pair_columns(left: DataFrame, right: DataFrame, minimum: float = 0.8) -> DataFrame:
    """Columns of two overviews paired by equal name, else by the closest name; ``column, other``.

    Closeness is one minus the edit distance over the longer name. All names are compared whose
    lengths allow the minimum.
    """
    tidy = lambda c: F.lower(F.regexp_replace(fold_accents(c), "[^A-Za-z0-9]+", " "))
    a = left.select(F.col("column"), tidy(F.col("column")).alias("__a")).withColumn("__n", F.length("__a"))
    a = a.withColumn("__k", F.explode(F.sequence(F.ceil(F.col("__n") * minimum).cast("int"), F.floor(F.col("__n") / minimum).cast("int"))))
    b = right.select(F.col("column").alias("other"), tidy(F.col("column")).alias("__b")).withColumn("__k", F.length("__b"))
    near = 1 - F.levenshtein("__a", "__b") / F.greatest(F.length("__a"), F.length("__b"))
    pairs = a.join(b, "__k").withColumn("__near", near).filter(F.col("__near") >= minimum)
    return pairs.groupBy("column").agg(F.max_by("other", F.struct("__near", "other")).alias("other"))


# Differences from which two profiles disagree.
MISSING_POINTS = 2.0
QUALITY_PCT = 1.0
DUPLICATE_POINTS = 0.5
LINK_POINTS = 2.0
SEVERITY = {"alta": 0, "media": 1, "baja": 2}
_QUALITY = ["extra_spaces_pct", "textual_empty_pct", "mixed_case_pct", "numbers_as_text_pct"]


def compare_profiles(real: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gaps between two column overviews: ``severity, column, aspect, real, other``.

    Columns without a partner, missing shares, quality defects that the other side lacks, cardinality and
    scale (``p50``) where both overviews have them.
    """
    have = set(real.columns) & set(other.columns)
    facts = [c for c in ["missing_pct", "cardinality", "p50", "type", *_QUALITY] if c in have]
    l = real.select("column", *[F.col(c).alias(f"l_{c}") for c in facts], F.lit(True).alias("__l"))
    r = other.select(F.col("column").alias("other"), *[F.col(c).alias(f"r_{c}") for c in facts], F.lit(True).alias("__r"))
    joined = l.join(pairs, "column", "left").join(r, "other", "full")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()

    def gap(when: Column, severity: str, aspect: str, left: Column, right: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(aspect).alias("aspect"),
                                     left.cast("string").alias("real_value"), right.cast("string").alias("other_value")))

    nothing = F.lit(None).cast("string")
    pct = lambda side, c: F.coalesce(F.col(f"{side}_{c}"), F.lit(0.0))
    found = [
        gap(F.col("__l").isNotNull() & F.col("__r").isNull(), "alta", "columna no modelada", F.col("column"), nothing),
        gap(F.col("__l").isNull(), "baja", "columna solo sintética", nothing, F.col("other")),
        gap(both & (F.abs(pct("l", "missing_pct") - pct("r", "missing_pct")) >= MISSING_POINTS), "media", "faltantes",
            F.col("l_missing_pct"), F.col("r_missing_pct")),
        gap(both & ~F.col("l_cardinality").eqNullSafe(F.col("r_cardinality")), "baja", "cardinalidad", F.col("l_cardinality"),
            F.col("r_cardinality")),
    ]
    found += [gap(both & (pct("l", c) >= QUALITY_PCT) & (pct("r", c) < pct("l", c) / 2), "media", f"calidad {c}",
                  F.col(f"l_{c}"), F.col(f"r_{c}")) for c in _QUALITY if c in facts]
    if "type" in facts:
        known = (F.col("l_type") != F.col("r_type")) & ~F.array_contains(F.array("l_type", "r_type"), "desconocido")
        found.append(gap(both & known, "media", "tipo", F.col("l_type"), F.col("r_type")))
    if "p50" in facts:
        scale = F.try_divide("l_p50", "r_p50")
        found.append(gap(both & (F.col("l_p50") != 0) & ~scale.between(0.5, 2.0), "media", "escala (mediana)",
                         F.col("l_p50"), F.col("r_p50")))
    return joined.select(F.coalesce("column", "other").alias("column"), F.inline(F.array_compact(F.array(*found))))


def compare_relations(real: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gaps between relations: what normalising wins, relations one side lacks, and coverage apart.

    ``pairs`` maps ``column`` to ``other``, both as ``table.column``.
    """
    a, b = pairs.select(F.col("column").alias("origin"), F.col("other").alias("__o")), pairs.select(
        F.col("column").alias("target"), F.col("other").alias("__t"))
    there = other.select(F.col("origin").alias("__o"), F.col("target").alias("__t"), F.col("exact_pct").alias("__exact"))
    joined = real.join(a, "origin", "left").join(b, "target", "left").join(there, ["__o", "__t"], "left")
    mapped = F.col("__o").isNotNull() & F.col("__t").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(F.col("normalised_pct") - F.col("exact_pct") >= LINK_POINTS, F.struct(
            F.lit("alta").alias("severity"), F.lit("vinculación").alias("aspect"))),
        F.when(mapped & F.col("__exact").isNull(), F.struct(
            F.lit("media").alias("severity"), F.lit("relación no modelada").alias("aspect"))),
        F.when(mapped & (F.abs(F.col("__exact") - F.col("exact_pct")) >= LINK_POINTS), F.struct(
            F.lit("media").alias("severity"), F.lit("cobertura de la relación").alias("aspect")))))
    return joined.select("origin", "target", "exact_pct", "normalised_pct", F.inline(kinds))
