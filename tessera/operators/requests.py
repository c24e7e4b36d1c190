"""Questions read as requests: what kind of task, which parts are given or missing, which operations answer it; checks of
proposed actions and of the evidence that came back. All are columns over whole tables of questions, actions or results.

Rules are ordered lists of SQL conditions over the flags and counts of a question, so that they are read in one place; the
same conditions hold in any SQL engine.

Defined results: a null question has no flags and is of the family ``unknown``; null lists count as empty; an empty table
gives no rows; repeated rows are answered each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import contains_any, mentioned_periods

# Words that mark what a question is about.
FLAGS = {
    "explains": ("为什么", "原因", "如何", "怎么看", "意味着", "是否异常", "合理吗", "背后"),
    "investigates": ("分析", "调查", "排查", "诊断", "综合", "尽调", "风险画像", "结合", "并评估", "研判"),
    "compares": ("变化", "比较", "对比", "同比增长", "同比下降", "趋势", "涨了", "跌了", "增长多少", "下降多少", "变动"),
    "realtime": ("股价", "市值", "行情", "涨跌幅", "K线", "盘口", "实时", "今日净值", "现价"),
    "predicts": ("会涨", "会跌", "能涨", "目标价是多少", "值不值得买", "买入建议", "预测未来", "明年会"),
    "research": ("机构", "券商", "分析师", "研报", "评级", "目标价", "盈利预测", "风险提示"),
    "detail": ("原文", "出处", "依据", "理由", "为什么", "详细", "具体怎么说"),
    "finds": ("找", "查找", "检索"),
    "views": ("观点",),
    "financial_risk": ("金融风险", "财务风险", "风险评估", "风险分析", "财务排雷", "风险扫描"),
    "ownership": ("股东", "持股", "十大", "实控人", "减持", "增持", "质押"),
    "moves": ("变化", "减持", "增持", "进入", "退出", "比较"),
    "penetrates": ("穿透",),
    "document": ("公告", "问询函", "年报", "研报", "原文", "披露", "检索", "查找", "找出"),
    "named_source": ("公告", "研报"),
    "event": ("事件", "时间线", "处罚", "立案", "违规记录", "警示函", "经过"),
    "digs": ("调查", "梳理"),
}
# Metrics, kinds of documents, events, topics and claims by the words that name them.
METRIC_WORDS = [
    ("INVENTORY", ("存货", "库存")),
    ("ACCOUNTS_RECEIVABLE", ("应收", "回款")),
    ("OPERATING_CASHFLOW", ("经营现金流", "现金流")),
    ("NET_PROFIT_PARENT", ("归母净利润", "净利润", "利润")),
    ("REVENUE", ("营收", "营业收入", "收入")),
    ("OPERATING_COST", ("营业成本", "成本")),
    ("TOTAL_ASSETS", ("总资产", "资产规模")),
    ("TOTAL_LIABILITIES", ("总负债", "负债")),
    ("CURRENT_LIABILITIES", ("流动负债", "偿债")),
    ("CURRENT_ASSETS", ("流动资产",)),
    ("MONETARY_CAPITAL", ("货币资金", "现金余额")),
    ("OPERATING_PROFIT", ("营业利润",)),
    ("R_AND_D_EXPENSE", ("研发费用", "研发投入")),
]
DOCUMENT_WORDS = [
    ("announcement", ("问询函", "监管问询", "年报", "年度报告", "审计报告", "审计意见", "公告", "原文", "披露", "违规", "处罚")),
    ("research_report", ("研报", "研究报告", "机构观点")),
]
EVENT_WORDS = [
    ("regulatory_inquiry", ("问询函", "监管问询")),
    ("regulatory_penalty", ("处罚", "监管处罚", "立案", "警示函")),
    ("controller_change", ("控制权", "实控人变更", "股权变更")),
    ("share_pledge", ("质押",)),
    ("major_litigation", ("诉讼",)),
    ("risk_warning", ("退市风险", "风险警示", "违规", "立案调查")),
    ("public_opinion", ("舆情", "新闻")),
]
TOPIC_WORDS = [
    ("asset_quality", ("存货", "跌价准备", "库存", "应收", "应收账款")),
    ("earnings_quality", ("现金流", "经营现金流", "回款", "利润质量", "净利润", "非经常性损益")),
    ("profitability", ("毛利率", "毛利", "盈利能力")),
    ("solvency", ("偿债", "负债", "债务")),
]
CLAIM_WORDS = [
    ("investment_rating", ("评级", "买入", "增持", "减持", "目标价")),
    ("earnings_forecast", ("盈利预测", "利润预测", "业绩预测", "预期")),
    ("risk_opinion", ("风险提示", "担忧", "风险")),
    ("analyst_judgment", ("怎么看", "观点", "认为", "评价", "如何看待")),
]
# How holders and institutions stand in a question.
HOLDER_PATTERNS = (r"股东\s*([一-鿿A-Za-z0-9（）()·]{2,30}?)\s*(?:持有|持股|减持|增持|是)", r"([一-鿿·]{2,4})(?:持有|减持|增持)")
NO_HOLDERS = ("公司持有", "股东持")
INSTITUTION_PATTERN = r"([一-鿿]{2,12}(?:证券|研究所|基金))"

#: The first condition that holds decides the family of the task.
FAMILIES = [
    ("realtime_market_query", "realtime"),
    ("document_retrieval", "research AND detail AND finds AND NOT views"),
    ("research_investigation", "research AND detail"),
    ("research_view_query", "research"),
    ("prediction_request", "predicts"),
    ("ownership_penetration", "penetrates"),
    ("ownership_compare", "ownership AND moves"),
    ("ownership_snapshot", "ownership AND NOT document"),
    ("event_investigation", "event AND (explains OR digs)"),
    ("event_query", "event"),
    ("financial_investigation", "financial_risk"),
    ("document_retrieval", "document AND n_metrics = 0"),
    ("financial_metric_compare", "n_metrics > 0 AND compares"),
    ("financial_metric_query", "n_metrics > 0"),
    ("financial_investigation", "explains AND NOT document"),
    ("document_retrieval", "document"),
]
_FIGURES = "family IN ('financial_metric_query', 'financial_metric_compare')"
COMPARISON = [
    ("none", "NOT (compares OR family IN ('financial_metric_compare', 'ownership_compare'))"),
    ("cross_entity", "n_entities > 1 AND n_periods <= 1"),
    ("cross_period", "n_periods > 1"),
]
#: Parts that a task needs and the question doesn't give.
MISSING = [
    ("company_ids", f"n_entities = 0 AND ({_FIGURES} OR family IN ('financial_investigation', 'ownership_compare', 'ownership_penetration', 'event_query', 'research_view_query') OR (family = 'ownership_snapshot' AND n_people = 0) OR (family = 'document_retrieval' AND NOT named_source))"),
    ("metric_codes", f"{_FIGURES} AND n_metrics = 0"),
    ("report_periods", f"{_FIGURES} AND (n_periods = 0 OR (family = 'financial_metric_compare' AND n_periods < 2 AND n_entities < 2))"),
    ("start_date_and_end_date", "family = 'ownership_compare' AND n_periods < 2"),
    ("source_entity_id", "family = 'ownership_penetration' AND n_people = 0"),
    ("as_of_date", "family = 'ownership_penetration' AND n_periods = 0"),
]
_BOUNDED = "family IN ('event_investigation', 'research_investigation', 'general_financial_explanation', 'unknown')"
INVESTIGATION = f"explains OR investigates OR family = 'financial_investigation' OR {_BOUNDED}"
STATUS = [
    ("unsupported", "realtime OR family IN ('realtime_market_query', 'user_account_query', 'prediction_request')"),
    ("clarification_required", "family = 'financial_investigation' AND n_entities = 0"),
    ("routeable", INVESTIGATION),
    ("clarification_required", "missing <> ''"),
]
#: The one operation that answers a question whose parts are all given.
DIRECT = [
    ("metric_query", "family = 'financial_metric_query' AND n_entities > 0 AND n_metrics > 0 AND n_periods > 0"),
    ("metric_compare", "family = 'financial_metric_compare' AND n_metrics > 0 AND ((n_entities = 1 AND n_periods >= 2) OR (n_entities >= 2 AND n_periods = 1))"),
    ("holding_query", "family = 'ownership_snapshot' AND n_entities + n_people > 0"),
    ("holding_compare", "family = 'ownership_compare' AND n_entities = 1 AND n_periods >= 2"),
    ("search", "family = 'document_retrieval'"),
    ("event_query", "family = 'event_query' AND n_entities = 1"),
    ("view_query", "family = 'research_view_query' AND n_entities > 0"),
]
_GIVEN = "n_entities > 0 AND n_metrics > 0 AND n_periods > 0"
_OPEN = f"({_FIGURES} OR family = 'unknown')"
_HELD = "family IN ('ownership_snapshot', 'ownership_compare', 'ownership_penetration')"
#: Operations of a bounded investigation, in the order in which they are tried.
STEPS = [
    ("risk_scan", "family = 'financial_investigation' AND n_entities = 1 AND n_periods > 0"),
    ("event_query", "family IN ('event_investigation', 'event_query') AND n_entities > 0"),
    ("view_query", "family IN ('research_investigation', 'research_view_query') AND n_entities > 0"),
    ("metric_query", f"({_OPEN} OR family = 'financial_investigation') AND {_GIVEN}"),
    ("metric_compare", f"({_OPEN} OR family = 'financial_investigation') AND {_GIVEN} AND n_entities = 1 AND n_periods >= 2"),
    ("event_query", "family = 'financial_investigation' AND n_entities > 0"),
    ("holding_query", f"({_HELD} AND n_entities + n_people > 0) OR (({_OPEN} OR family = 'financial_investigation') AND n_entities = 0 AND n_people > 0)"),
    ("holding_compare", f"{_HELD} AND n_entities = 1 AND n_periods >= 2"),
    ("penetration", "family = 'ownership_penetration' AND n_entities = 1 AND n_people = 1 AND n_periods > 0"),
    ("search", f"{_HELD} OR family IN ('event_investigation', 'research_investigation', 'document_retrieval', 'general_financial_explanation') OR (family = 'event_query' AND n_entities = 0) OR (({_OPEN} OR family = 'financial_investigation') AND (n_entities > 0 OR n_people = 0))"),
    ("event_query", f"{_OPEN} AND n_entities > 0"),
    ("metric_query", f"family IN ('event_investigation', 'document_retrieval', 'general_financial_explanation') AND {_GIVEN}"),
]
# Capabilities, their tool and operation, and the arguments they need; the last two have no data behind them.
CAPABILITIES = [
    ("financial_metric_query", "financial_analysis", "metric_query", ("company_ids", "metric_codes", "report_periods")),
    ("financial_metric_compare", "financial_analysis", "metric_compare", ("company_ids", "metric_codes", "report_periods")),
    ("financial_risk_scan", "financial_analysis", "risk_scan", ("company_ids", "report_periods")),
    ("ownership_snapshot", "ownership_analysis", "holding_query", ("company_ids_or_holder_ids",)),
    ("ownership_compare", "ownership_analysis", "holding_compare", ("company_ids", "start_date", "end_date")),
    ("ownership_penetration", "ownership_analysis", "penetration", ("source_entity_id", "target_entity_id", "as_of_date")),
    ("document_retrieval", "document_search", "search", ("query",)),
    ("event_query", "event_timeline", "event_query", ("entity_ids",)),
    ("event_cluster", "event_timeline", "event_cluster", ("entity_ids",)),
    ("research_view_query", "research_analysis", "view_query", ("company_ids",)),
    ("realtime_market_price", None, None, ()),
    ("user_portfolio", None, None, ()),
]


def case_sql(rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{label}'" for label, condition in rules) + f" ELSE {otherwise} END"


def list_sql(rules: list[tuple[str, str]]) -> str:
    """Labels of all conditions that hold, joined by commas; an argument that is null is left out by concat_ws."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {condition} THEN '{label}' END" for label, condition in rules) + ")"


def labels_of(text: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(label)) for label, words in rules]))


def holder_names(text: Column) -> Column:
    """Names that stand as holders in a question, in order of the two patterns."""
    first, second = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in HOLDER_PATTERNS)
    first = F.filter(F.transform(first, lambda x: F.regexp_replace(x, "^[的 了]+|[的 了]+$", "")), lambda x: F.length(x).between(2, 30))
    return F.array_distinct(F.concat(first, F.filter(second, lambda x: ~x.isin(list(NO_HOLDERS)))))


def read_questions(questions: DataFrame, *, question: str = "question", entities: str | None = None) -> DataFrame:
    """``questions`` with the parts each names: metrics, periods, people, institutions, document_types, event_types, topics,
    claim_types (arrays); the flags and counts of the rules; family, comparison, missing, status, direct and steps.

    ``entities``: a column with the resolved companies of a question (array<string>).
    """
    q = F.coalesce(F.col(question), F.lit(""))
    parts = {
        "metrics": labels_of(q, METRIC_WORDS),
        "periods": mentioned_periods(q),
        "people": holder_names(q),
        "institutions": F.array_distinct(F.regexp_extract_all(q, F.lit(INSTITUTION_PATTERN), F.lit(1))),
        "document_types": labels_of(q, DOCUMENT_WORDS),
        "event_types": labels_of(q, EVENT_WORDS),
        "topics": labels_of(q, TOPIC_WORDS),
        "claim_types": labels_of(q, CLAIM_WORDS),
    }
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    counts = {"n_entities": size(entities) if entities else F.lit(0), "n_metrics": size("metrics"), "n_periods": F.size("periods"), "n_people": size("people")}
    out = questions.withColumns(parts).withColumns({**{k: contains_any(q, words) for k, words in FLAGS.items()}, **counts})
    out = out.withColumn("family", F.expr(case_sql(FAMILIES, "'unknown'")))
    out = out.withColumns({"comparison": F.expr(case_sql(COMPARISON, "'ambiguous'")), "missing": F.expr(list_sql(MISSING))})
    out = out.withColumns({"status": F.expr(case_sql(STATUS, "'routeable'")), "direct": F.expr(f"CASE WHEN {INVESTIGATION} OR realtime OR (n_entities > 1 AND family IN ('document_retrieval', 'event_query', 'ownership_snapshot')) THEN NULL ELSE {case_sql(DIRECT)} END"), "steps": F.expr(list_sql(STEPS))})
    return out


def capabilities(spark: SparkSession) -> DataFrame:
    """(capability, tool, operation, required array<string>, implemented)."""
    return spark.createDataFrame([(c, t, o, list(r), t is not None) for c, t, o, r in CAPABILITIES], "capability string, tool string, operation string, required array<string>, implemented boolean")


def check_actions(actions: DataFrame, companies: DataFrame, *, order: str = "step") -> DataFrame:
    """``actions`` with ``errors`` array<string>, empty where an action may run.

    actions: action_id, run_id, ``order``, capability, tool, operation, and their arguments as a map<string,string> whose
    lists are joined by commas. companies: company_id of those that exist. An action that repeats an earlier one of its run
    with the same arguments, ``query`` aside, brings nothing.
    """
    arg = lambda k: F.nullif(F.trim(F.col("arguments")[k]), F.lit(""))
    n = lambda k: F.coalesce(F.size(F.split(arg(k), ",")), F.lit(0))
    known = capabilities(actions.sparkSession).select("capability", F.col("tool").alias("__tool"), F.col("operation").alias("__operation"), "required", F.col("implemented").alias("__on"))
    named = actions.select("action_id", F.explode(F.split(arg("company_ids"), ",")).alias("company_id")).withColumn("company_id", F.upper(F.trim("company_id")))
    lost = named.join(companies.select(F.upper(F.trim("company_id")).alias("company_id")).distinct(), "company_id", "left_anti").groupBy("action_id").agg(F.count(F.lit(1)).alias("__lost"))
    same = F.map_filter("arguments", lambda k, _: ~k.isin("query", "operation", "reason"))
    key = F.xxhash64("capability", F.to_json(F.array_sort(F.map_entries(same))))
    w = Window.partitionBy("run_id", "__key").orderBy(order, "action_id")
    rows = actions.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).join(F.broadcast(known), "capability", "left").join(lost, "action_id", "left")
    cap, on = F.col("capability"), F.coalesce(F.col("__on"), F.lit(False))
    lacks = lambda k: F.array_contains(F.coalesce("required", F.array().cast("array<string>")), k)
    slots = [k for k in sorted({s for *_, r in CAPABILITIES for s in r}) if k != "company_ids_or_holder_ids"]
    rules = [
        ("unknown_capability", F.col("__on").isNull()),
        ("not_implemented", ~F.coalesce(F.col("__on"), F.lit(True))),
        ("operation_mismatch", on & ~(F.col("tool").eqNullSafe(F.col("__tool")) & F.col("operation").eqNullSafe(F.col("__operation")))),
        ("sets_knowledge_cutoff", on & F.map_contains_key("arguments", "knowledge_cutoff")),
        ("unknown_company", on & (F.col("__lost") > 0)),
        ("ambiguous_dimension", (cap == "financial_metric_compare") & (n("company_ids") > 1) & (n("report_periods") > 1)),
        ("not_one_company", (cap == "financial_risk_scan") & (n("company_ids") != 1)),
        ("too_deep", (cap == "ownership_penetration") & (F.coalesce(arg("max_depth").try_cast("int"), F.when(arg("max_depth").isNull(), 4)).isNull() | (arg("max_depth").try_cast("int") > 6))),
        ("too_many_paths", (cap == "ownership_penetration") & (F.coalesce(arg("max_paths").try_cast("int"), F.when(arg("max_paths").isNull(), 10)).isNull() | (arg("max_paths").try_cast("int") > 50))),
        ("no_target_code", (cap == "ownership_penetration") & ~F.coalesce(arg("target_entity_id").rlike(r"(?i)^\d{6}\.(SZ|SH|BJ)$"), F.lit(False))),
        ("missing_company_ids_or_holder_ids", on & lacks("company_ids_or_holder_ids") & arg("company_ids").isNull() & arg("holder_ids").isNull()),
        *[(f"missing_{k}", on & lacks(k) & arg(k).isNull()) for k in slots],
        ("repeats_earlier", on & (F.col("__n") > 1)),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(label)) for label, c in rules]))
    return rows.select(*[F.col(c) for c in actions.columns], errors.alias("errors"))


def repair_actions(checked: DataFrame) -> DataFrame:
    """Of ``check_actions`` the rows whose errors are mended by leaving out a cutoff, or all companies but the first; their
    arguments are changed accordingly. The rest has to be planned anew."""
    cut, lost = F.array_contains("errors", "sets_knowledge_cutoff"), F.array_contains("errors", "unknown_company")
    several = F.size(F.split(F.col("arguments")["company_ids"], ",")) > 1
    first = F.substring_index(F.col("arguments")["company_ids"], ",", 1)
    args = F.map_filter("arguments", lambda k, _: (k != "knowledge_cutoff"))
    args = F.when(lost & several, F.transform_values(args, lambda k, v: F.when(k == "company_ids", first).otherwise(v))).otherwise(args)
    return checked.where(cut | (lost & several)).withColumn("arguments", args).drop("errors")


def review_evidence(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_calls, n_failed, n_empty, n_covered, review, answer_status) of tool results (keys, succeeded boolean,
    n_evidence); one aggregation, map-side first."""
    ok = F.coalesce(F.col("succeeded"), F.lit(False))
    has = F.coalesce(F.col("n_evidence"), F.lit(0)) > 0
    agg = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(~ok).alias("n_failed"), F.count_if(ok & ~has).alias("n_empty"), F.count_if(ok & has).alias("n_covered"))
    review = F.when(F.col("n_covered") == 0, "insufficient").when((F.col("n_failed") == 0) & (F.col("n_empty") == 0), "sufficient").otherwise("partial")
    return agg.withColumn("review", review).withColumn("answer_status", F.when(F.col("review") == "sufficient", "answered").when(F.col("review") == "partial", "partially_answered").otherwise("insufficient_evidence"))
