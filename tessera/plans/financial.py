"""Queries over financial figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import financial as fin
from tessera.session import table

FY = ("2020-12-31", "2021-12-31", "2022-12-31", "2023-12-31")
CUTOFF = "2024-06-30"


def _figures(spark: SparkSession, sf: str, cutoff: str | None = None) -> DataFrame:
    facts = table(spark, sf, "financial_metrics").select("company_id", "report_period", "metric_code", "value", "currency", "announcement_date", "evidence_id")
    return fin.current_figures(facts, cutoff=cutoff)


def fin_current_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _figures(spark, sf, CUTOFF)


def fin_metric_query(spark: SparkSession, sf: str) -> DataFrame:
    figures = _figures(spark, sf)
    return fin.metric_query(figures, fin.requested(table(spark, sf, "listed_company_entities"), FY[2:], ["REVENUE", "NET_PROFIT_PARENT", "CURRENT_LIABILITIES"]))


def fin_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Requested minus found."""
    figures = _figures(spark, sf)
    wanted = fin.requested(table(spark, sf, "listed_company_entities"), FY, ["REVENUE", "INVENTORY"])
    return wanted.join(figures.select("company_id", "report_period", "metric_code"), ["company_id", "report_period", "metric_code"], "left_anti")


def fin_available_periods(spark: SparkSession, sf: str) -> DataFrame:
    return fin.available_periods(table(spark, sf, "financial_metrics"))


def fin_compare_periods(spark: SparkSession, sf: str) -> DataFrame:
    return fin.compare_periods(_figures(spark, sf), "REVENUE", FY)


def fin_compare_companies(spark: SparkSession, sf: str) -> DataFrame:
    return fin.compare_companies(_figures(spark, sf), "REVENUE", "2022-12-31")


def fin_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Wide statements back to narrow facts."""
    wide = _figures(spark, sf).groupBy("company_id", "report_period").pivot("metric_code", list(fin.METRIC_CODES)).agg(F.first("value"))
    renamed = wide.select("company_id", "report_period", *[F.col(m[0]).alias(m[3]) for m in fin.METRICS])
    return fin.unpivot_statement(renamed, ["company_id", "report_period"]).select("company_id", "report_period", "metric_code", "statement_name", "value")


def fin_risk_observations(spark: SparkSession, sf: str) -> DataFrame:
    return fin.risk_observations(_figures(spark, sf), FY)


def fin_risk_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return fin.risk_rollup(fin_risk_observations(spark, sf))


def fin_negative_runs(spark: SparkSession, sf: str) -> DataFrame:
    return fin.negative_runs(_figures(spark, sf), "OPERATING_CASHFLOW", FY)


def fin_comparable_periods(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "listed_company_entities").select("company_id", F.lit("2023-06-30").cast("date").alias("target"))
    return fin.comparable_periods(table(spark, sf, "financial_metrics"), targets)


def _cur(cutoff: str | None = None) -> str:
    bound = f"AND announcement_date <= DATE '{cutoff}'" if cutoff else ""
    return f"""cur AS (
  SELECT company_id, report_period, metric_code, value, announcement_date, evidence_id FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, report_period, metric_code ORDER BY announcement_date DESC, evidence_id DESC) AS rn
    FROM financial_metrics WHERE currency = 'CNY' {bound}) WHERE rn = 1)"""


def _dates(periods) -> str:
    return ", ".join(f"DATE '{p}'" for p in periods)


_WIDE = f"""keys AS (SELECT DISTINCT company_id, unnest([{_dates(FY)}]) AS report_period FROM cur),
wide AS (SELECT k.company_id, k.report_period, {", ".join(f"max(value) FILTER (WHERE metric_code = '{m}') AS {m}" for m in fin.METRIC_CODES)}
  FROM keys k LEFT JOIN cur USING (company_id, report_period) GROUP BY 1, 2),
lagged AS (SELECT *, row_number() OVER w AS n, lag(REVENUE) OVER w AS prev_rev, lag(NET_PROFIT_PARENT) OVER w AS prev_np, lag(OPERATING_CASHFLOW) OVER w AS prev_cf,
  lag(ACCOUNTS_RECEIVABLE) OVER w AS prev_ar, lag(INVENTORY) OVER w AS prev_inv, lag(OPERATING_COST) OVER w AS prev_cost, lag(OPERATING_PROFIT) OVER w AS prev_op,
  CASE WHEN REVENUE > 0 THEN CASH_RECEIVED_FROM_SALES / REVENUE END AS sr, CASE WHEN TOTAL_ASSETS > 0 THEN TOTAL_LIABILITIES / TOTAL_ASSETS END AS dr
  FROM wide WINDOW w AS (PARTITION BY company_id ORDER BY report_period)),
l2 AS (SELECT *, lag(sr) OVER w AS prev_sr, lag(dr) OVER w AS prev_dr FROM lagged WINDOW w AS (PARTITION BY company_id ORDER BY report_period)),
obs AS ({{union}})"""


def _pair_rule(metric: str, prev: str, name: str) -> str:
    g = f"CASE WHEN {prev} <> 0 THEN ({metric} - {prev}) / abs({prev}) END"
    r = "CASE WHEN prev_rev <> 0 THEN (REVENUE - prev_rev) / abs(prev_rev) END"
    return f"""SELECT company_id, '{name}' AS rule_id, report_period, CASE WHEN {metric} IS NULL OR {prev} IS NULL OR REVENUE IS NULL OR prev_rev IS NULL THEN 'insufficient_data'
  WHEN {prev} <= 0 OR prev_rev <= 0 THEN 'not_applicable' WHEN {g} > 0 AND round({g} - {r}, 12) >= 0.3 THEN 'triggered' ELSE 'not_triggered' END AS status, round({g} - {r}, 9) AS measure FROM l2 WHERE n > 1"""


_OBS = " UNION ALL ".join(
    [
        _pair_rule("ACCOUNTS_RECEIVABLE", "prev_ar", "RECEIVABLE_REVENUE_DIVERGENCE"),
        _pair_rule("INVENTORY", "prev_inv", "INVENTORY_REVENUE_DIVERGENCE"),
        """SELECT company_id, 'CASH_PROFIT_DIVERGENCE', report_period, CASE WHEN NET_PROFIT_PARENT IS NULL OR prev_np IS NULL OR OPERATING_CASHFLOW IS NULL OR prev_cf IS NULL THEN 'insufficient_data'
  WHEN prev_np <= 0 OR NET_PROFIT_PARENT <= 0 THEN 'not_applicable'
  WHEN ((NET_PROFIT_PARENT - prev_np) / abs(prev_np) > 0 AND prev_cf <> 0 AND (OPERATING_CASHFLOW - prev_cf) / abs(prev_cf) <= -0.2) OR OPERATING_CASHFLOW / NET_PROFIT_PARENT < 0.5 THEN 'triggered' ELSE 'not_triggered' END,
  round(CASE WHEN NET_PROFIT_PARENT <> 0 THEN OPERATING_CASHFLOW / NET_PROFIT_PARENT END, 9) FROM l2 WHERE n > 1""",
        """SELECT company_id, 'LIQUIDITY_PRESSURE', report_period, CASE WHEN CURRENT_ASSETS IS NULL OR CURRENT_LIABILITIES IS NULL OR MONETARY_CAPITAL IS NULL THEN 'insufficient_data' WHEN CURRENT_LIABILITIES <= 0 THEN 'not_applicable'
  WHEN CURRENT_ASSETS / CURRENT_LIABILITIES < 1 OR MONETARY_CAPITAL / CURRENT_LIABILITIES < 0.2 THEN 'triggered' ELSE 'not_triggered' END, round(CURRENT_ASSETS / nullif(CURRENT_LIABILITIES, 0), 9) FROM l2""",
        """SELECT company_id, 'MARGIN_VOLATILITY', report_period, CASE WHEN REVENUE IS NULL OR prev_rev IS NULL OR OPERATING_COST IS NULL OR prev_cost IS NULL OR OPERATING_PROFIT IS NULL OR prev_op IS NULL THEN 'insufficient_data'
  WHEN REVENUE <= 0 OR prev_rev <= 0 THEN 'not_applicable' WHEN abs((REVENUE - OPERATING_COST) / REVENUE - (prev_rev - prev_cost) / prev_rev) >= 0.1 OR abs(OPERATING_PROFIT / REVENUE - prev_op / prev_rev) >= 0.1 THEN 'triggered' ELSE 'not_triggered' END,
  round(CASE WHEN REVENUE > 0 AND prev_rev > 0 THEN (REVENUE - OPERATING_COST) / REVENUE - (prev_rev - prev_cost) / prev_rev END, 9) FROM l2 WHERE n > 1""",
        """SELECT company_id, 'SALES_CASH_REVENUE_DIVERGENCE', report_period, CASE WHEN REVENUE IS NULL OR CASH_RECEIVED_FROM_SALES IS NULL THEN 'insufficient_data' WHEN REVENUE <= 0 THEN 'not_applicable'
  WHEN sr < 0.8 OR coalesce(round(sr - prev_sr, 12) <= -0.2, false) THEN 'triggered' ELSE 'not_triggered' END, round(sr, 9) FROM l2""",
        """SELECT company_id, 'LEVERAGE_PRESSURE', report_period, CASE WHEN TOTAL_ASSETS IS NULL OR TOTAL_LIABILITIES IS NULL THEN 'insufficient_data' WHEN TOTAL_ASSETS <= 0 THEN 'not_applicable'
  WHEN dr >= 0.7 OR coalesce(round(dr - prev_dr, 12) >= 0.1, false) THEN 'triggered' ELSE 'not_triggered' END, round(dr, 9) FROM l2""",
    ]
)
_RISK = f"WITH {_cur()}, " + _WIDE.replace("{union}", _OBS)

SQL = {
    "fin_current_figures": f"WITH {_cur(CUTOFF)} SELECT * FROM cur",
    "fin_metric_query": f"""WITH {_cur()}, want AS (SELECT DISTINCT company_id, p AS report_period, m AS metric_code FROM listed_company_entities, (SELECT unnest([{_dates(FY[2:])}]) AS p), (SELECT unnest(['REVENUE', 'NET_PROFIT_PARENT', 'CURRENT_LIABILITIES']) AS m))
SELECT company_id, report_period, metric_code, value, evidence_id IS NULL AS missing FROM want LEFT JOIN cur USING (company_id, report_period, metric_code)""",
    "fin_missing": f"""WITH {_cur()}, want AS (SELECT DISTINCT company_id, p AS report_period, m AS metric_code FROM listed_company_entities, (SELECT unnest([{_dates(FY)}]) AS p), (SELECT unnest(['REVENUE', 'INVENTORY']) AS m))
SELECT company_id, report_period, metric_code FROM want EXCEPT SELECT company_id, report_period, metric_code FROM cur""",
    "fin_available_periods": "SELECT DISTINCT company_id, report_period, period_type FROM financial_metrics",
    "fin_compare_periods": f"""WITH {_cur()}, pts AS (SELECT k.company_id, k.report_period, c.value FROM (SELECT DISTINCT company_id, unnest([{_dates(FY)}]) AS report_period FROM cur) k
  LEFT JOIN cur c ON c.company_id = k.company_id AND c.report_period = k.report_period AND c.metric_code = 'REVENUE'),
x AS (SELECT *, lag(value) OVER w AS prev, first_value(value) OVER a AS f, last_value(value) OVER a AS l FROM pts
  WINDOW w AS (PARTITION BY company_id ORDER BY report_period), a AS (PARTITION BY company_id ORDER BY report_period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT company_id, report_period, value, value - prev AS change, CASE WHEN prev <> 0 THEN (value - prev) / abs(prev) END AS change_rate, l - f AS cumulative_change, CASE WHEN f <> 0 THEN (l - f) / abs(f) END AS cumulative_rate FROM x""",
    "fin_compare_companies": f"""WITH {_cur()}, r AS (SELECT company_id, value FROM cur WHERE metric_code = 'REVENUE' AND report_period = DATE '2022-12-31' AND value IS NOT NULL)
SELECT company_id, value, rank() OVER (ORDER BY value DESC) AS rank, (SELECT max(value) - min(value) FROM r) AS spread FROM r""",
    "fin_unpivot": f"""WITH {_cur()} SELECT company_id, report_period, metric_code, CASE WHEN metric_code IN ('OPERATING_CASHFLOW', 'CASH_RECEIVED_FROM_SALES') THEN 'cashflow_statement'
  WHEN metric_code IN ('REVENUE', 'OPERATING_COST', 'NET_PROFIT_PARENT', 'OPERATING_PROFIT', 'R_AND_D_EXPENSE') THEN 'income_statement' ELSE 'balance_sheet' END AS statement_name, value FROM cur WHERE value IS NOT NULL""",
    "fin_risk_observations": _RISK + " SELECT * FROM obs",
    "fin_risk_rollup": _RISK
    + """, isl AS (SELECT *, sum(CASE WHEN status = 'triggered' THEN 0 ELSE 1 END) OVER (PARTITION BY company_id, rule_id ORDER BY report_period) AS island FROM obs),
runs AS (SELECT company_id, rule_id, island, count(*) FILTER (WHERE status = 'triggered') AS run FROM isl GROUP BY 1, 2, 3),
mx AS (SELECT company_id, rule_id, max(run) AS max_consecutive FROM runs GROUP BY 1, 2),
agg AS (SELECT company_id, rule_id, count(*) AS n_observations, count(*) FILTER (WHERE status = 'triggered') AS n_triggered, count(*) FILTER (WHERE status = 'not_triggered') AS n_not, count(*) FILTER (WHERE status = 'not_applicable') AS n_na FROM obs GROUP BY 1, 2)
SELECT company_id, rule_id, CASE WHEN n_triggered > 0 THEN 'triggered' WHEN n_not > 0 THEN 'not_triggered' WHEN n_na > 0 THEN 'not_applicable' ELSE 'insufficient_data' END AS status, n_observations, n_triggered, max_consecutive,
  CASE WHEN n_triggered = 0 THEN NULL WHEN max_consecutive >= 2 THEN 'high' ELSE 'medium' END AS severity FROM agg JOIN mx USING (company_id, rule_id)""",
    "fin_negative_runs": f"""WITH {_cur()}, pts AS (SELECT k.company_id, k.report_period, c.value FROM (SELECT DISTINCT company_id, unnest([{_dates(FY)}]) AS report_period FROM cur) k
  LEFT JOIN cur c ON c.company_id = k.company_id AND c.report_period = k.report_period AND c.metric_code = 'OPERATING_CASHFLOW'),
isl AS (SELECT *, sum(CASE WHEN value < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY company_id ORDER BY report_period) AS island FROM pts),
runs AS (SELECT company_id, island, count(*) FILTER (WHERE value < 0) AS run, count(value) AS known FROM isl GROUP BY 1, 2),
o AS (SELECT company_id, max(run) AS longest_negative_run, CAST(sum(known) AS BIGINT) AS known_periods FROM runs GROUP BY 1)
SELECT *, CASE WHEN known_periods < 2 THEN 'insufficient_data' WHEN longest_negative_run >= 2 THEN 'triggered' ELSE 'not_triggered' END AS status FROM o""",
    "fin_comparable_periods": """SELECT DISTINCT f.company_id, DATE '2023-06-30' AS target, f.report_period FROM financial_metrics f JOIN listed_company_entities l USING (company_id)
WHERE f.period_type = 'H1' AND f.report_period <= DATE '2023-06-30'""",
}
QUERIES = {k: globals()[k] for k in SQL}
