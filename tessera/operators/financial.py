"""Financial figures: unpivot, point-in-time selection, comparisons, missing combinations and risk observations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import growth, hash_id, period_type

# Metric code, name, statement, source column, nature.
METRICS = (
    ("TOTAL_ASSETS", "总资产", "balance_sheet", "tot_assets", "instant"),
    ("TOTAL_LIABILITIES", "总负债", "balance_sheet", "tot_liab", "instant"),
    ("CURRENT_ASSETS", "流动资产合计", "balance_sheet", "tot_cur_assets", "instant"),
    ("CURRENT_LIABILITIES", "流动负债合计", "balance_sheet", "tot_cur_liab", "instant"),
    ("INVENTORY", "存货", "balance_sheet", "inventories", "instant"),
    ("ACCOUNTS_RECEIVABLE", "应收账款", "balance_sheet", "acct_rcv", "instant"),
    ("MONETARY_CAPITAL", "货币资金", "balance_sheet", "monetary_cap", "instant"),
    ("REVENUE", "营业收入", "income_statement", "oper_rev", "year_to_date"),
    ("OPERATING_COST", "营业成本", "income_statement", "less_oper_cost", "year_to_date"),
    ("NET_PROFIT_PARENT", "归属于母公司股东的净利润", "income_statement", "net_profit_excl_min_int_inc", "year_to_date"),
    ("OPERATING_PROFIT", "营业利润", "income_statement", "oper_profit", "year_to_date"),
    ("R_AND_D_EXPENSE", "研发费用", "income_statement", "rd_expense", "year_to_date"),
    ("OPERATING_CASHFLOW", "经营活动现金流量净额", "cashflow_statement", "net_cash_flows_oper_act", "year_to_date"),
    ("CASH_RECEIVED_FROM_SALES", "销售商品、提供劳务收到的现金", "cashflow_statement", "cash_recp_sg_and_rs", "year_to_date"),
)
METRIC_CODES = tuple(m[0] for m in METRICS)


def visible(df: DataFrame, cutoff: str | None, column: str = "announcement_date") -> DataFrame:
    """Rows announced by the cutoff; all of them without one. Applied before any ranking, so nothing later leaks in."""
    return df if cutoff is None else df.where(F.col(column) <= F.lit(cutoff).cast("date"))


def unpivot_statement(wide: DataFrame, ids: Sequence[str], metrics: Sequence[tuple] = METRICS) -> DataFrame:
    """One row per statement row and metric that is not null: ids, source_column, value, and the catalog's columns."""
    have = [m for m in metrics if m[3] in wide.columns]
    tall = wide.unpivot(list(ids), [F.col(m[3]).cast("double").alias(m[3]) for m in have], "source_column", "value").where("value IS NOT NULL")
    pick = lambda k: F.create_map(*[x for m in have for x in (F.lit(m[3]), F.lit(m[k]))])[F.col("source_column")]
    return tall.select("*", pick(0).alias("metric_code"), pick(1).alias("metric_name"), pick(2).alias("statement_name"), pick(4).alias("value_nature"))


def build_metrics(wide: DataFrame) -> DataFrame:
    """The narrow fact table of a wide statement: unpivot, period type, ids and quality flags; repeated source rows once.

    wide: object_id, company_id, wind_code, report_period, announcement_date, statement columns.
    """
    tall = unpivot_statement(wide.dropDuplicates(["object_id"]), ["object_id", "company_id", "wind_code", "report_period", "announcement_date"])
    flags = F.array_compact(F.array(F.when(F.col("wind_code").isNotNull() & (F.col("wind_code") != F.col("company_id")), F.lit("wind_code_mismatch")), F.when(period_type(F.col("report_period")) == "NON_STANDARD", F.lit("non_standard_period"))))
    return tall.withColumns({"period_type": period_type(F.col("report_period")), "evidence_id": hash_id("EVID-FIN-", 24, F.col("object_id"), F.col("source_column")), "quality_flags": flags})


def current_figures(facts: DataFrame, *, cutoff: str | None = None, currency: str | None = "CNY") -> DataFrame:
    """(company_id, report_period, metric_code, value, announcement_date, evidence_id): of restated figures the one announced last."""
    rows = visible(facts, cutoff)
    if currency is not None:
        rows = rows.where(F.col("currency") == currency)
    latest = rows.groupBy("company_id", "report_period", "metric_code").agg(F.max(F.struct("announcement_date", "evidence_id", "value")).alias("x"))
    return latest.select("company_id", "report_period", "metric_code", "x.value", "x.announcement_date", "x.evidence_id")


def requested(companies: DataFrame, periods: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Every company with every asked period and metric: literal arrays are exploded, no join is needed."""
    return companies.select("company_id").distinct().select("company_id", F.explode(F.array(*[F.lit(p).cast("date") for p in periods])).alias("report_period")).select("*", F.explode(F.array(*map(F.lit, metrics))).alias("metric_code"))


def metric_query(figures: DataFrame, wanted: DataFrame) -> DataFrame:
    """The asked combinations with their values; ``missing`` marks those without one."""
    return wanted.join(figures, ["company_id", "report_period", "metric_code"], "left").select("company_id", "report_period", "metric_code", "value", F.col("evidence_id").isNull().alias("missing"))


def available_periods(facts: DataFrame) -> DataFrame:
    return facts.select("company_id", "report_period", "period_type").distinct()


def compare_periods(figures: DataFrame, metric: str, periods: Sequence[str]) -> DataFrame:
    """Values of a metric over the asked periods with the change to the period before (which may be missing) and to the first."""
    points = requested(figures, periods, [metric]).join(figures, ["company_id", "report_period", "metric_code"], "left")
    w = Window.partitionBy("company_id").orderBy("report_period")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev, first, last = F.lag("value").over(w), F.first("value").over(whole), F.last("value").over(whole)
    return points.select("company_id", "report_period", "value", (F.col("value") - prev).alias("change"), growth(F.col("value"), prev).alias("change_rate"), (last - first).alias("cumulative_change"), growth(last, first).alias("cumulative_rate"))


def compare_companies(figures: DataFrame, metric: str, period: str) -> DataFrame:
    """Companies ranked by a figure, with the spread between the greatest and the least.

    The rank is competition rank; to compute it without one task for all rows, values are counted once and their
    cumulative counts run over distinct values by range.
    """
    rows = figures.where((F.col("metric_code") == metric) & (F.col("report_period") == F.lit(period).cast("date")) & F.col("value").isNotNull()).select("company_id", "value")
    ranked = global_rank(rows, "value")
    hi, lo = rows.agg(F.max("value"), F.min("value")).first()
    return ranked.select("company_id", "value", "rank", F.lit(None if hi is None else hi - lo).cast("double").alias("spread"))


def global_rank(rows: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """Competition rank by a number, greatest first, over all rows, without one task for all of them.

    Rows are counted per value first (map-side), so a value that a third of all rows share is one row from there on. Values
    are dealt to ranges between approximate quantiles, ranked within a range, and moved by the counts of the ranges above;
    only the bounds and one count a range are collected.
    """
    bounds = sorted(set(rows.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.001)))
    above = F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>"), lambda b: b <= F.col(column))
    values = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c")).withColumn("__b", F.lit(len(bounds)) - F.size(above))
    sizes = {r[0]: r[1] for r in values.groupBy("__b").agg(F.sum("__c")).collect()}
    total, base = 0, []
    for b in range(len(bounds) + 1):
        base.append(total)
        total += sizes.get(b, 0)
    w = Window.partitionBy("__b").orderBy(F.col(column).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.select(F.col(column), (F.coalesce(F.sum("__c").over(w), F.lit(0)) + F.array(*map(F.lit, base))[F.col("__b")] + 1).cast("bigint").alias("rank"))
    return rows.join(ranks, column).select(*rows.columns, "rank")


# --- risk observations --------------------------------------------------------------------------------------------

# Thresholds of the rules.
THRESHOLDS = {"growth_gap_min": 0.3, "cashflow_growth_max": -0.2, "cashflow_to_profit_max": 0.5, "current_ratio_min": 1.0, "cash_coverage_min": 0.2, "margin_change_min": 0.1, "cash_to_revenue_min": 0.8, "ratio_change_max": -0.2, "debt_ratio_max": 0.7, "debt_ratio_increase_max": 0.1, "negative_run_min": 2}


def wide_figures(figures: DataFrame, periods: Sequence[str]) -> DataFrame:
    """One row per company and asked period, a column per metric; periods without figures are there with nulls."""
    wanted = F.col("report_period").isin([F.lit(p).cast("date") for p in periods])
    found = figures.where(wanted).groupBy("company_id", "report_period").pivot("metric_code", list(METRIC_CODES)).agg(F.first("value"))
    keys = requested(figures, periods, ["REVENUE"]).select("company_id", "report_period")
    return keys.join(found, ["company_id", "report_period"], "left")


def _status(missing: Column, not_applicable: Column, hit: Column) -> Column:
    return F.when(missing, "insufficient_data").when(not_applicable, "not_applicable").when(hit, "triggered").otherwise("not_triggered")


def risk_observations(figures: DataFrame, periods: Sequence[str]) -> DataFrame:
    """(company_id, rule_id, report_period, status, measure): every rule at every period, three-valued through nulls.

    One scan and one window per company serve all rules; the rules are columns of an array that is exploded at the end.
    """
    t = THRESHOLDS
    w = Window.partitionBy("company_id").orderBy("report_period")
    c = F.col
    base = wide_figures(figures, periods)
    lagged = base.select("*", F.row_number().over(w).alias("n"), *[F.lag(m).over(w).alias(f"prev_{m}") for m in ("REVENUE", "NET_PROFIT_PARENT", "OPERATING_CASHFLOW", "ACCOUNTS_RECEIVABLE", "INVENTORY", "OPERATING_COST", "OPERATING_PROFIT")])
    # ratios that only count while the period before was valid
    sales = F.when(c("REVENUE") > 0, c("CASH_RECEIVED_FROM_SALES") / c("REVENUE"))
    debt = F.when(c("TOTAL_ASSETS") > 0, c("TOTAL_LIABILITIES") / c("TOTAL_ASSETS"))
    lagged = lagged.withColumns({"sales_ratio": sales, "debt_ratio": debt})
    lagged = lagged.withColumns({"prev_sales_ratio": F.lag("sales_ratio").over(w), "prev_debt_ratio": F.lag("debt_ratio").over(w)})
    null = lambda *names: reduce(lambda a, b: a | b, [c(n).isNull() for n in names])
    pair = c("n") > 1
    rules = []

    def rule(name: str, scope: Column, status: Column, measure: Column) -> None:
        rules.append(F.when(scope, F.struct(F.lit(name).alias("rule_id"), status.alias("status"), F.round(measure, 9).alias("measure"))))

    for metric, name in (("ACCOUNTS_RECEIVABLE", "RECEIVABLE_REVENUE_DIVERGENCE"), ("INVENTORY", "INVENTORY_REVENUE_DIVERGENCE")):
        g = growth(c(metric), c(f"prev_{metric}"))
        gap = g - growth(c("REVENUE"), c("prev_REVENUE"))
        rule(name, pair, _status(null(metric, f"prev_{metric}", "REVENUE", "prev_REVENUE"), (c(f"prev_{metric}") <= 0) | (c("prev_REVENUE") <= 0), (g > 0) & (F.round(gap, 12) >= t["growth_gap_min"])), gap)
    profit, cash = growth(c("NET_PROFIT_PARENT"), c("prev_NET_PROFIT_PARENT")), growth(c("OPERATING_CASHFLOW"), c("prev_OPERATING_CASHFLOW"))
    coverage = F.when(c("NET_PROFIT_PARENT") != 0, c("OPERATING_CASHFLOW") / c("NET_PROFIT_PARENT"))
    rule(
        "CASH_PROFIT_DIVERGENCE",
        pair,
        _status(null("NET_PROFIT_PARENT", "prev_NET_PROFIT_PARENT", "OPERATING_CASHFLOW", "prev_OPERATING_CASHFLOW"), (c("prev_NET_PROFIT_PARENT") <= 0) | (c("NET_PROFIT_PARENT") <= 0), F.coalesce((profit > 0) & (cash <= t["cashflow_growth_max"]), F.lit(False)) | (coverage < t["cashflow_to_profit_max"])),
        coverage,
    )
    current = F.when(c("CURRENT_LIABILITIES") != 0, c("CURRENT_ASSETS") / c("CURRENT_LIABILITIES"))
    cover = F.when(c("CURRENT_LIABILITIES") != 0, c("MONETARY_CAPITAL") / c("CURRENT_LIABILITIES"))
    rule("LIQUIDITY_PRESSURE", F.lit(True), _status(null("CURRENT_ASSETS", "CURRENT_LIABILITIES", "MONETARY_CAPITAL"), c("CURRENT_LIABILITIES") <= 0, (current < t["current_ratio_min"]) | (cover < t["cash_coverage_min"])), current)
    gross = lambda p: (c(f"{p}REVENUE") - c(f"{p}OPERATING_COST")) / F.when(c(f"{p}REVENUE") > 0, c(f"{p}REVENUE"))
    operating = lambda p: c(f"{p}OPERATING_PROFIT") / F.when(c(f"{p}REVENUE") > 0, c(f"{p}REVENUE"))
    dg, do = gross("") - gross("prev_"), operating("") - operating("prev_")
    rule("MARGIN_VOLATILITY", pair, _status(null("REVENUE", "prev_REVENUE", "OPERATING_COST", "prev_OPERATING_COST", "OPERATING_PROFIT", "prev_OPERATING_PROFIT"), (c("REVENUE") <= 0) | (c("prev_REVENUE") <= 0), (F.abs(dg) >= t["margin_change_min"]) | (F.abs(do) >= t["margin_change_min"])), dg)
    drop = c("sales_ratio") - c("prev_sales_ratio")
    rule("SALES_CASH_REVENUE_DIVERGENCE", F.lit(True), _status(null("REVENUE", "CASH_RECEIVED_FROM_SALES"), c("REVENUE") <= 0, (c("sales_ratio") < t["cash_to_revenue_min"]) | F.coalesce(F.round(drop, 12) <= t["ratio_change_max"], F.lit(False))), c("sales_ratio"))
    rise = c("debt_ratio") - c("prev_debt_ratio")
    rule("LEVERAGE_PRESSURE", F.lit(True), _status(null("TOTAL_ASSETS", "TOTAL_LIABILITIES"), c("TOTAL_ASSETS") <= 0, (c("debt_ratio") >= t["debt_ratio_max"]) | F.coalesce(F.round(rise, 12) >= t["debt_ratio_increase_max"], F.lit(False))), c("debt_ratio"))
    return lagged.select("company_id", "report_period", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("company_id", "r.rule_id", "report_period", "r.status", "r.measure")


def negative_runs(figures: DataFrame, metric: str, periods: Sequence[str]) -> DataFrame:
    """Longest run of negative values on end over the asked periods; a missing value breaks a run."""
    rows = requested(figures, periods, [metric]).join(figures, ["company_id", "report_period", "metric_code"], "left")
    w = Window.partitionBy("company_id").orderBy("report_period")
    negative = F.coalesce(F.col("value") < 0, F.lit(False))
    marked = rows.select("company_id", negative.alias("neg"), F.sum((~negative).cast("int")).over(w).alias("island"), "value")
    runs = marked.groupBy("company_id", "island").agg(F.count_if("neg").alias("run"), F.count("value").alias("known"))
    return runs.groupBy("company_id").agg(F.max("run").alias("longest_negative_run"), F.sum("known").alias("known_periods")).withColumn("status", F.when(F.col("known_periods") < THRESHOLDS["negative_run_min"], "insufficient_data").when(F.col("longest_negative_run") >= THRESHOLDS["negative_run_min"], "triggered").otherwise("not_triggered"))


def risk_rollup(observations: DataFrame) -> DataFrame:
    """Per company and rule: the strongest status, counts by status, the longest run of triggered periods, severity."""
    w = Window.partitionBy("company_id", "rule_id").orderBy("report_period")
    hit = F.col("status") == "triggered"
    marked = observations.withColumn("island", F.sum((~hit).cast("int")).over(w))
    runs = marked.groupBy("company_id", "rule_id", "island").agg(F.count_if(hit).alias("run"), F.count_if(hit).alias("n_triggered"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "not_triggered").alias("n_not"), F.count_if(F.col("status") == "not_applicable").alias("n_na"))
    out = runs.groupBy("company_id", "rule_id").agg(F.max("run").alias("max_consecutive"), F.sum("n_triggered").alias("n_triggered"), F.sum("n").alias("n_observations"), F.sum("n_not").alias("n_not"), F.sum("n_na").alias("n_na"))
    status = F.when(F.col("n_triggered") > 0, "triggered").when(F.col("n_not") > 0, "not_triggered").when(F.col("n_na") > 0, "not_applicable").otherwise("insufficient_data")
    return out.select("company_id", "rule_id", status.alias("status"), "n_observations", "n_triggered", "max_consecutive", F.when(F.col("n_triggered") == 0, F.lit(None)).when(F.col("max_consecutive") >= 2, "high").otherwise("medium").alias("severity"))


def comparable_periods(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(company_id, target, report_period): periods of the target's own type up to it, for each (company_id, target)."""
    have = available_periods(facts)
    return targets.withColumn("period_type", period_type(F.col("target"))).join(have, ["company_id", "period_type"]).where("report_period <= target").select("company_id", "target", "report_period")
