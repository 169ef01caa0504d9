"""Alerts against labelled truth: metrics, errors, hypotheses and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.operators.skew import ranged_running_sums

MINIMUM_GAIN = 0.10  # fixed value: F1 a hypothesis must gain to hold


def metric_columns(tp: Column, fp: Column, fn: Column, undefined: float | None = None) -> dict[str, Column]:
    """Precision, recall and F1; ``undefined`` (null or 0) where there is nothing to divide by."""
    nothing = F.lit(undefined).cast("double")
    precision = F.coalesce(F.try_divide(tp, tp + fp), nothing)
    recall = F.coalesce(F.try_divide(tp, tp + fn), nothing)
    f1 = F.when(tp + fp + fn == 0, nothing).otherwise(tp * 2.0 / (tp * 2 + fp + fn))
    return {"precision": precision, "recall": recall, "f1": f1}


def _counted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts from rows flagged ``alerted`` and ``real``."""
    sums = pairs.groupBy(*keys).agg(
        F.count_if("real").alias("real"), F.count_if("alerted").alias("alerts"),
        F.count_if(F.col("real") & F.col("alerted")).alias("tp"),
    ).withColumns({"fp": F.col("alerts") - F.col("tp"), "fn": F.col("real") - F.col("tp")})
    return sums.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def _flagged(alerted: DataFrame, real: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides with the side they come from; one aggregation instead of an outer join."""
    yes, no = F.lit(True), F.lit(False)
    both = alerted.select(*keys, yes.alias("alerted"), no.alias("real")).unionByName(
        real.select(*keys, no.alias("alerted"), yes.alias("real")))
    return both.groupBy(*keys).agg(F.max("alerted").alias("alerted"), F.max("real").alias("real"))


def by_type(alerts: DataFrame, truth: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Metrics per anomaly type over distinct (record, type); rules of one type count together."""
    alerted = alerts if rules is None else alerts.filter(F.col("rule").isin(rules))
    return _counted(_flagged(alerted, truth, ["record_id", "anomaly_type"]), ["anomaly_type"])


def by_rule(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics of each rule against its type; a rule on empty fields only answers for its own field."""
    alerted = alerts.select("rule", "anomaly_type", "record_id").distinct()
    rules = alerted.select("rule", "anomaly_type").distinct()
    field = F.regexp_replace("rule", "^nulo_", "")
    own_field = (F.col("anomaly_type") != "VALOR_NULO") | F.coalesce(F.col("column_name") == field, F.lit(False))
    real = truth.select("anomaly_type", "record_id", "column_name").distinct().join(rules, "anomaly_type").filter(own_field)
    keys = ["rule", "anomaly_type", "record_id"]
    return _counted(_flagged(alerted, real, keys), ["rule", "anomaly_type"])


def errors(alerts: DataFrame, truth: DataFrame, anomaly_type: str, rules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(false positives, false negatives) of a type."""
    alerted = alerts if rules is None else alerts.filter(F.col("rule").isin(rules))
    a, g = (df.filter(F.col("anomaly_type") == anomaly_type) for df in (alerted, truth))
    return (a.join(g.select("record_id").distinct(), "record_id", "left_anti"),
            g.join(a.select("record_id").distinct(), "record_id", "left_anti"))


def binary(alerted: DataFrame, anomalous: DataFrame, universe: DataFrame) -> DataFrame:
    """One row of metrics over records, with the true negatives of the universe."""
    size = universe.select("record_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    out = _counted(_flagged(alerted, anomalous, ["record_id"]), [])
    return out.withColumn("tn", size - F.col("tp") - F.col("fp") - F.col("fn"))


def rule_union(alerts: DataFrame, truth: DataFrame, benign: DataFrame | None, rules: list[str], types: list[str],
               unit: DataFrame | None = None) -> DataFrame:
    """A union of rules against a set of types, its false positives split by what they are.

    ``unit`` (``record_id, unit_id``) maps records to the unit of evaluation, such as line to invoice.
    """
    def units(df: DataFrame, flag: str) -> DataFrame:
        rows = df.select("record_id")
        if unit is not None:
            rows = rows.join(unit, "record_id", "left").select(F.coalesce("unit_id", "record_id").alias("record_id"))
        return rows.select("record_id", *[F.lit(f == flag).alias(f) for f in ("alerted", "real", "other", "benign")])

    rows = units(alerts.filter(F.col("rule").isin(rules)), "alerted").unionByName(
        units(truth.filter(F.col("anomaly_type").isin(types)), "real")).unionByName(units(truth, "other"))
    if benign is not None:
        rows = rows.unionByName(units(benign, "benign"))
    flags = rows.groupBy("record_id").agg(*[F.max(f).alias(f) for f in ("alerted", "real", "other", "benign")])
    wrong = F.col("alerted") & ~F.col("real")
    out = flags.agg(
        F.count_if("real").alias("real"), F.count_if("alerted").alias("alerts"),
        F.count_if(F.col("alerted") & F.col("real")).alias("tp"),
        F.count_if(wrong & F.col("benign")).alias("fp_benign"), F.count_if(wrong & F.col("other")).alias("fp_other_anomaly"),
        F.count_if(wrong & ~F.col("benign") & ~F.col("other")).alias("fp_normal"),
    ).withColumns({"fp": F.col("alerts") - F.col("tp"), "fn": F.col("real") - F.col("tp")})
    return out.withColumns({**metric_columns(F.col("tp"), F.col("fp"), F.col("fn")),
                            "f1": F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("alerts") + F.col("real")), F.lit(0.0))})


# Hypotheses with their types and, from the naive to the one with context, their rules.
HYPOTHESES: dict[str, dict] = {
    "H1": {"types": ["DOMINIO_INVALIDO"],
           "rules": [["dominio_sin_vinculo"], ["dominio_sin_vinculo_normalizado"], ["carga_sin_movil_identificado"]]},
    "H2b": {"types": ["ODOMETRO_REGRESIVO", "ODOMETRO_REGRESIVO_LEVE"],
            "rules": [["odometro_disminuye"], ["retroceso_con_contexto"]]},
    "H2c": {"types": ["ODOMETRO_SALTO"],
            "rules": [["salto_umbral_fijo"], ["salto_historial_vehiculo"], ["salto_con_contexto"]]},
    "H3b": {"types": ["EXCESO_VOLUMETRICO", "CAPACIDAD_MAL_REGISTRADA"],
            "rules": [["litros_mayor_a_tanque"], ["exceso_sin_antecedente"]]},
    "H4": {"types": ["FRACCIONAMIENTO"],
           "rules": [["litros_mayor_a_tanque"], ["cargas_menos_de_6_horas"], ["fraccionamiento_diario"],
                     ["fraccionamiento_sin_recorrido"]]},
    "H5": {"types": ["CONSUMO_ATIPICO"],
           "rules": [["litros_mayor_a_tanque"], ["rendimiento_fuente"], ["rendimiento_bajo_odometro"],
                     ["rendimiento_bajo_gps"]]},
    "H6": {"types": ["CARGA_VEHICULO_INACTIVO"], "rules": [[], ["carga_vehiculo_inactivo"]]},
    "H7": {"types": ["CARGA_FUERA_DE_ZONA"], "rules": [["carga_lejos_de_base"], ["carga_lejos_del_gps"]]},
    "H8": {"types": ["CARGA_SIN_REGISTRO", "ANULADA_CON_CARGA", "RENDIDA_SIN_CARGA", "DESACUERDO_DE_LITROS",
                     "CARGA_SUPERA_AUTORIZADO", "ERROR_PROVEEDOR", "ERROR_DOMINIO", "ERROR_TARJETA"],
           "rules": [["cruce_por_dominio_y_dia"],
                     ["carga_sin_registro", "carga_de_registro_anulado", "rendida_sin_carga", "desacuerdo_de_litros",
                      "supera_autorizado_con_tolerancia"]]},
    "H9": {"types": ["TOTAL_INFLADO", "LINEA_SIN_CONSUMO", "LINEA_DUPLICADA", "SOBREPRECIO",
                     "FACTURADA_A_PRECIO_DE_SURTIDOR", "DIFERENCIA_DEUDA_PDF", "PRODUCTO_NO_COMBUSTIBLE"],
           "rules": [["conciliacion_mensual"],
                     ["factura_no_concilia", "pdf_no_concilia", "linea_sin_consumo", "linea_duplicada", "sobreprecio",
                      "precio_de_surtidor", "producto_no_combustible"]], "unit": "invoice"},
    "H10": {"types": ["CARGA_CON_CUPO_AGOTADO", "TRANSFERENCIA_SIN_NECESIDAD"],
            "rules": [["ejecucion_supera_tope"], ["carga_con_saldo_agotado", "transferencia_no_justificada"]]},
    "H11": {"types": ["DISPOSITIVO_ACTIVO_EN_BAJA"], "rules": [["baja_con_dispositivo"], ["dispositivo_activo_en_baja"]]},
    "H12": {"types": ["ODOMETRO_SIN_AVANCE"],
            "rules": [["odometro_sin_avance"], ["avance_menor_a_5_km"], ["sin_avance_sin_excepcion"]]},
    "H13": {"types": ["DOBLE_COBRO"], "rules": [["contingencia"], ["doble_cobro"]]},
}


def contrast_hypotheses(alerts: DataFrame, truth: DataFrame, benign: DataFrame | None = None,
                        lines: DataFrame | None = None, hypotheses: dict[str, dict] | None = None) -> DataFrame:
    """Metrics of every rule step of every hypothesis that has cases in the truth.

    The catalogue becomes two small lists attached to alerts and truth by rule and type, so all
    hypotheses are counted in one aggregation.
    """
    catalogue = HYPOTHESES if hypotheses is None else hypotheses
    spark = alerts.sparkSession
    steps = [(h, i, r) for h, d in catalogue.items() for i, rules in enumerate(d["rules"]) for r in rules]
    all_steps = [(h, i, "+".join(rules) or "—") for h, d in catalogue.items() for i, rules in enumerate(d["rules"])]
    kinds = [(h, t) for h, d in catalogue.items() for t in d["types"]]
    by_invoice = [h for h, d in catalogue.items() if d.get("unit") == "invoice"]
    step_rules = spark.createDataFrame(steps, "hypothesis string, step int, rule string")
    step_list = spark.createDataFrame(all_steps, "hypothesis string, step int, rules string")
    step_types = spark.createDataFrame(kinds, "hypothesis string, anomaly_type string")
    counts = {h: len(d["rules"]) for h, d in catalogue.items()}
    step_no = F.explode(F.element_at(F.create_map(*[
        x for h, n in counts.items() for x in (F.lit(h), F.array(*[F.lit(i) for i in range(n)]))]), F.col("hypothesis")))

    def in_unit(df: DataFrame) -> DataFrame:
        if lines is None or not by_invoice:
            return df
        unit = lines.select(F.col("line").cast("string").alias("record_id"), F.col("number").cast("string").alias("__unit"))
        unit = unit.groupBy("record_id").agg(F.min("__unit").alias("__unit"))
        mapped = F.when(F.col("hypothesis").isin(by_invoice), F.coalesce("__unit", "record_id")).otherwise(F.col("record_id"))
        return df.join(unit, "record_id", "left").withColumn("record_id", mapped).drop("__unit")

    flags = ("alerted", "real", "other", "benign")

    def flagged(df: DataFrame, flag: str) -> DataFrame:
        return in_unit(df).select("hypothesis", "step", "record_id", *[F.lit(f == flag).alias(f) for f in flags])

    real = truth.select("record_id", "anomaly_type").join(step_types, "anomaly_type").withColumn("step", step_no)
    alerted = alerts.select("record_id", "rule").join(step_rules, "rule")
    # Truth and benign records of any kind only matter where they meet an alert of the step.
    touched = in_unit(alerted).select("hypothesis", "step", "record_id").distinct()

    def touching(df: DataFrame, flag: str) -> DataFrame:
        marked = in_unit(df.select("record_id").withColumn(
            "hypothesis", F.explode(F.array(*[F.lit(h) for h in catalogue]))))
        return touched.join(marked.distinct(), ["hypothesis", "record_id"], "left_semi").select(
            "hypothesis", "step", "record_id", *[F.lit(f == flag).alias(f) for f in flags])

    rows = flagged(alerted, "alerted").unionByName(flagged(real, "real")).unionByName(touching(truth, "other"))
    if benign is not None:
        rows = rows.unionByName(touching(benign, "benign"))
    per_record = rows.groupBy("hypothesis", "step", "record_id").agg(*[F.max(f).alias(f) for f in flags])
    wrong = F.col("alerted") & ~F.col("real")
    counted = per_record.groupBy("hypothesis", "step").agg(
        F.count_if("real").alias("real"), F.count_if("alerted").alias("alerts"),
        F.count_if(F.col("alerted") & F.col("real")).alias("tp"),
        F.count_if(wrong & F.col("benign")).alias("fp_benign"), F.count_if(wrong & F.col("other")).alias("fp_other_anomaly"),
        F.count_if(wrong & ~F.col("benign") & ~F.col("other")).alias("fp_normal"),
    ).filter(F.col("real") > 0)
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("alerts") + F.col("real")), F.lit(0.0))
    out = counted.join(step_list, ["hypothesis", "step"]).withColumns({
        "fp": F.col("alerts") - F.col("tp"), "fn": F.col("real") - F.col("tp")})
    return out.withColumns({**metric_columns(F.col("tp"), F.col("fp"), F.col("fn")), "f1": f1})


def verdicts(contrast: DataFrame, minimum_gain: float = MINIMUM_GAIN) -> DataFrame:
    """A hypothesis holds when its last rule gains ``minimum_gain`` of F1 over its first."""
    first, last = F.min_by("f1", "step"), F.max_by("f1", "step")
    out = contrast.groupBy("hypothesis").agg(
        first.alias("f1_naive"), last.alias("f1_context"), F.min_by("fp_benign", "step").alias("fp_benign_naive"),
        F.max_by("fp_benign", "step").alias("fp_benign_context"), F.max_by("recall", "step").alias("recall_context"))
    holds = F.col("f1_context") - F.col("f1_naive") >= minimum_gain
    return out.withColumn("verdict", F.when(holds, "Se sostiene").otherwise("No se sostiene"))


def confusion(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Confusion and metrics of boolean columns ``real`` and ``predicted``; 0 where undefined."""
    real, predicted = F.col("real"), F.col("predicted")
    sums = labelled.groupBy(*(keys or [])).agg(
        F.count_if(real & predicted).alias("tp"), F.count_if(~real & predicted).alias("fp"),
        F.count_if(real & ~predicted).alias("fn"), F.count_if(~real & ~predicted).alias("tn"))
    return sums.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), undefined=0.0))


def ordering_quality(scored: DataFrame, keys: list[str], order: str = "record_id") -> DataFrame:
    """Average precision, ties together, and precision within the first k, k the number of real ones.

    Scores are first counted per distinct value and added up over ranges of the score, each in its own task however close
    the scores lie. Where the k-th place falls into equal scores, the order of the ids' MD5 decides.
    """
    counts = scored.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("real").alias("tp"))
    ranked = counts.withColumn("__neg", -F.col("score"))
    sums = ranged_running_sums(ranked, keys, ["__neg"], {"cum_n": F.col("n"), "cum_tp": F.col("tp")})
    totals = counts.groupBy(*keys).agg(F.sum("tp").alias("k"))
    joined = sums.join(totals, keys)
    ap = F.sum(F.col("tp") / F.col("k") * F.col("cum_tp") / F.col("cum_n"))
    before_n, before_tp = F.col("cum_n") - F.col("n"), F.col("cum_tp") - F.col("tp")
    whole = joined.filter(F.col("k") > 0).groupBy(*keys).agg(
        ap.alias("average_precision"), F.max("k").alias("k"),
        # The score group in which the k-th place falls; inside it the order of ids decides.
        F.max(F.when((before_n < F.col("k")) & (F.col("cum_n") >= F.col("k")),
                     F.struct(F.col("score"), before_n.alias("n"), before_tp.alias("tp")))).alias("cut"))
    tied = scored.join(whole.select(*keys, F.col("cut.score").alias("score"), (F.col("k") - F.col("cut.n")).alias("room")),
                       [*keys, "score"])
    spread = tied.withColumn("__place", F.md5(F.col(order).cast("string")))
    placed = ranged_running_sums(spread, keys, ["__place", order], {"__rank": F.lit(1)})
    taken = placed.filter(F.col("__rank") <= F.col("room")).groupBy(*keys).agg(F.count_if("real").alias("__tied"))
    return whole.join(taken, keys, "left").select(
        *keys, "average_precision",
        ((F.col("cut.tp") + F.coalesce("__tied", F.lit(0))) / F.col("k")).alias("precision_at_k"), "k")


def over_runs(runs: DataFrame, method: str = "method") -> DataFrame:
    """Confusions of several runs summed, with the mean and spread of their F1."""
    sums = runs.groupBy(method).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_spread"))
    return sums.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), undefined=0.0))
