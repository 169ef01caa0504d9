"""Invoice and contract queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.operators import balance
from tallyhound.operators.rules import invoices
from tallyhound.plans.registry import Inputs, query


def plain(alerts: DataFrame, digits: int = 4) -> DataFrame:
    """Alerts with the measure rounded for comparison and without the spelled-out detail."""
    return alerts.select("record_id", "anomaly_type", "rule", F.round("measure", digits).alias("measure"))


_GAP = """
SELECT cast(number as varchar) AS record_id, 'TOTAL_INFLADO' AS anomaly_type, 'factura_no_concilia' AS rule,
       round((total - lt) / greatest(abs(lt), 1), 4) AS measure
FROM (SELECT i.number, i.total, coalesce(s.lt, 0) AS lt FROM invoice i
      LEFT JOIN (SELECT number, sum(amount) AS lt FROM invoice_line GROUP BY number) s ON s.number = i.number)
WHERE abs((total - lt) / greatest(abs(lt), 1)) > 0.005"""


@query("r14a_invoice_header_vs_lines", ["invoice", "invoice_line"], _GAP)
def _(x: Inputs):
    return plain(invoices.header_mismatch(x.view("invoice"), x.view("invoice_line")))


@query("r14b_document_vs_debt", ["invoice"], """
SELECT cast(number as varchar) AS record_id, 'DIFERENCIA_DEUDA_PDF' AS anomaly_type, 'pdf_no_concilia' AS rule,
       round((pdf_total - total) / greatest(abs(total), 1), 4) AS measure
FROM invoice WHERE pdf_total IS NOT NULL AND abs((pdf_total - total) / greatest(abs(total), 1)) > 0.001""")
def _(x: Inputs):
    return plain(invoices.document_mismatch(x.view("invoice")))


@query("r14c_line_irregularities", ["invoice_line"], """
WITH refuel AS (SELECT p_partkey AS id, min(p_retailprice) AS price FROM part GROUP BY p_partkey),
fuel AS (SELECT l.*, r.id AS rid, r.price,
                row_number() OVER (PARTITION BY refuel_ref ORDER BY line) AS n
         FROM invoice_line l LEFT JOIN refuel r ON r.id = l.refuel_ref WHERE concept = 'COMBUSTIBLE')
SELECT line AS record_id, 'LINEA_SIN_CONSUMO' AS anomaly_type, 'linea_sin_consumo' AS rule, cast(NULL as double) AS measure
FROM fuel WHERE rid IS NULL
UNION ALL SELECT line, 'LINEA_DUPLICADA', 'linea_duplicada', NULL FROM fuel WHERE rid IS NOT NULL AND n > 1
UNION ALL SELECT line, 'SOBREPRECIO', 'sobreprecio', round(unit_price / price, 4) FROM fuel WHERE unit_price > price * (1 + 0.02)
UNION ALL SELECT line, 'FACTURADA_A_PRECIO_DE_SURTIDOR', 'precio_de_surtidor', round(unit_price / price, 4) FROM fuel
WHERE unit_price >= price * (1 - 0.005) AND NOT unit_price > price * (1 + 0.02)
UNION ALL SELECT line, 'PRODUCTO_NO_COMBUSTIBLE', 'producto_no_combustible', NULL FROM invoice_line
WHERE concept NOT IN ('COMBUSTIBLE', 'AJUSTE')""")
def _(x: Inputs):
    parts = x.table("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("unit_price"))
    return plain(invoices.line_irregularities(parts, x.view("invoice_line")))


@query("r14n_month_reconciliation", ["invoice", "spend"], """
WITH used AS (SELECT contract, strftime(date, '%Y-%m') AS period, sum(amount) AS used FROM spend GROUP BY 1, 2),
billed AS (SELECT contract, period, sum(total) AS billed FROM invoice GROUP BY 1, 2)
SELECT cast(i.number as varchar) AS record_id, 'TOTAL_INFLADO' AS anomaly_type, 'conciliacion_mensual' AS rule,
       round((billed - coalesce(used, 0)) / greatest(coalesce(used, 0), 1), 4) AS measure
FROM invoice i JOIN billed USING (contract, period) LEFT JOIN used USING (contract, period)
WHERE abs((billed - coalesce(used, 0)) / greatest(coalesce(used, 0), 1)) > 0.01""")
def _(x: Inputs):
    return plain(invoices.month_reconciliation(x.view("spend"), x.view("invoice")))


@query("r25_triple_reconciliation", ["invoice", "invoice_line"], """
WITH s AS (SELECT number, sum(amount) AS la,
                  cast(sum(CASE WHEN concept NOT IN ('COMBUSTIBLE', 'AJUSTE') THEN 1 ELSE 0 END) as bigint) AS nf
           FROM invoice_line GROUP BY number)
SELECT i.number, contract, period, total AS debt, pdf_total, round(la, 2) AS lines_total,
       round(total - la, 2) AS debt_minus_lines, round(pdf_total - total, 2) AS pdf_minus_debt, nf AS non_fuel_lines,
       (abs(total - la) > 0.005 * abs(la) OR (pdf_total IS NOT NULL AND abs(pdf_total - total) > 0.001 * abs(total))
        OR nf > 0) AS observed
FROM invoice i JOIN s ON s.number = i.number""")
def _(x: Inputs):
    return invoices.triple_reconciliation(x.view("invoice"), x.view("invoice_line"))


@query("r26_lines_without_refuel", ["invoice_line"], """
SELECT line, number, refuel_ref, litres, amount FROM invoice_line
WHERE concept = 'COMBUSTIBLE' AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = refuel_ref)""")
def _(x: Inputs):
    parts = x.table("part").select(F.col("p_partkey").alias("id"))
    return invoices.lines_without_refuel(x.view("invoice_line"), parts).select(
        "line", "number", "refuel_ref", "litres", "amount")


@query("ag02_monthly_invoices", ["refuel"], """
SELECT contract, substr(date, 1, 7) AS period, count(*) AS refuels, round(sum(litres), 2) AS litres,
       round(sum(amount), 2) AS net, round(round(sum(amount), 2) * 0.21, 2) AS tax,
       round(round(sum(amount), 2) * 1.21, 2) AS total
FROM refuel GROUP BY 1, 2""")
def _(x: Inputs):
    return invoices.monthly_invoices(x.view("refuel").withColumn("date", F.col("date").cast("date")))


@query("ag20_contract_rollup", ["refuel"], """
SELECT contract, count(*) AS refuels, round(sum(litres), 2) AS litres, round(sum(amount), 2) AS amount,
       round(sum(amount) / sum(litres), 4) AS unit_price,
       CASE WHEN avg(CASE WHEN product = 'DIESEL' THEN 1 ELSE 0 END) > 0.5 THEN 'DIESEL' ELSE 'NAFTA' END AS family
FROM refuel GROUP BY contract""")
def _(x: Inputs):
    return invoices.contract_rollup(x.view("refuel"))


@query("r15n_spend_over_cap", ["spend", "contract"], """
SELECT concat('CTO-', s.contract, '|', month) AS record_id, 'CARGA_CON_CUPO_AGOTADO' AS anomaly_type,
       'ejecucion_supera_tope' AS rule, round(used / monthly_cap * 100, 0) AS measure
FROM (SELECT contract, strftime(date, '%Y-%m') AS month, sum(amount) AS used FROM spend GROUP BY 1, 2) s
JOIN contract c ON c.contract = s.contract WHERE used > monthly_cap""")
def _(x: Inputs):
    return plain(balance.spend_over_cap(x.view("spend"), x.view("contract")))


_BALANCE = """
used AS (SELECT contract, date, sum(amount) AS used FROM spend GROUP BY 1, 2),
net AS (SELECT contract, date, sum(amount) AS moved FROM (
          SELECT to_contract AS contract, date, amount FROM transfer
          UNION ALL SELECT from_contract, date, -amount FROM transfer) GROUP BY 1, 2),
calendar AS (SELECT cast(unnest(generate_series(date_trunc('month', (SELECT min(date) FROM spend)),
                                (SELECT max(date) FROM spend), INTERVAL '1' DAY)) as date) AS date),
daily AS (SELECT c.contract, d.date, strftime(d.date, '%Y-%m') AS month, c.monthly_cap AS cap,
                 coalesce(n.moved, 0) AS transferred, coalesce(u.used, 0) AS used
          FROM contract c CROSS JOIN calendar d
          LEFT JOIN net n ON n.contract = c.contract AND n.date = d.date
          LEFT JOIN used u ON u.contract = c.contract AND u.date = d.date),
balance AS (SELECT *, cap + sum(transferred) OVER w - (sum(used) OVER w - used) AS available,
                   cap + sum(transferred) OVER w - sum(used) OVER w AS closing
            FROM daily WINDOW w AS (PARTITION BY contract, month ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query("win07_daily_balance", ["spend", "transfer", "contract"], f"""WITH {_BALANCE}
SELECT contract, date, month, cap, round(transferred, 2) AS transferred, round(used, 2) AS used,
       round(available, 2) AS available, round(closing, 2) AS closing FROM balance""")
def _(x: Inputs):
    days = balance.daily_balance(x.view("spend"), x.view("transfer"), x.view("contract"))
    return days.select("contract", "date", "month", "cap",
                       *[F.round(c, 2).alias(c) for c in ("transferred", "used", "available", "closing")])


@query("r24_exhausted_months", ["spend", "transfer", "contract"], f"""WITH {_BALANCE}
SELECT contract, month, count(*) AS days, round(sum(used), 2) AS used_without_balance
FROM balance WHERE available <= 0 AND used > 0 GROUP BY contract, month""")
def _(x: Inputs):
    return balance.exhausted_months(balance.daily_balance(x.view("spend"), x.view("transfer"), x.view("contract")))


@query("r15c_quota_irregularities", ["spend", "transfer", "contract"], """
WITH months AS (SELECT DISTINCT cast(date_trunc('month', date) as date) AS m FROM spend),
complete AS (SELECT m FROM months WHERE m < (SELECT max(m) FROM months) OR (SELECT count(*) FROM months) = 1),
hist AS (SELECT contract, sum(amount) / (SELECT count(*) FROM complete) AS mean FROM spend
         WHERE date_trunc('month', date) IN (SELECT m FROM complete) GROUP BY contract),
used AS (SELECT contract, date, sum(amount) AS used FROM spend GROUP BY 1, 2),
rec AS (SELECT to_contract AS contract, date, sum(amount) AS received FROM transfer GROUP BY 1, 2),
ced AS (SELECT from_contract AS contract, date, sum(amount) AS ceded FROM transfer GROUP BY 1, 2),
days AS (SELECT c.contract, c.monthly_cap, m, cast(unnest(generate_series(m, last_day(m), INTERVAL '1' DAY)) as date) AS date
         FROM contract c CROSS JOIN months),
mv AS (SELECT d.*, coalesce(used, 0) AS used, coalesce(received, 0) AS received, coalesce(ceded, 0) AS ceded,
              coalesce(mean, 0) AS mean
       FROM days d LEFT JOIN used USING (contract, date) LEFT JOIN rec USING (contract, date)
       LEFT JOIN ced USING (contract, date) LEFT JOIN hist USING (contract)),
run AS (SELECT *, coalesce(sum(used) OVER w, 0) AS so_far, monthly_cap + coalesce(sum(received - ceded - used) OVER w, 0) AS opening,
               day(last_day(m)) AS n, day(date) AS k
        FROM mv WINDOW w AS (PARTITION BY contract, m ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
proj AS (SELECT *, (so_far + mean / n * 7) / (k - 1 + 7) * (n - k + 1) AS projection FROM run)
SELECT concat('CTO-', contract, '|', strftime(m, '%Y-%m')) AS record_id, 'CARGA_CON_CUPO_AGOTADO' AS anomaly_type,
       'carga_con_saldo_agotado' AS rule, cast(count(*) as double) AS measure
FROM proj WHERE opening + received - ceded <= 0 AND used > 0 GROUP BY contract, m
UNION ALL
SELECT DISTINCT concat('CTO-', p.contract, '|', strftime(m, '%Y-%m')), 'TRANSFERENCIA_SIN_NECESIDAD',
       'transferencia_no_justificada', cast(NULL as double)
FROM proj p JOIN transfer t ON t.to_contract = p.contract AND t.date = p.date
WHERE projection * 1.05 < 0.9 * (opening - ceded) AND used <= opening - ceded""")
def _(x: Inputs):
    return plain(balance.quota_irregularities(x.view("spend"), x.view("transfer"), x.view("contract")))
