"""Questions read as requests, checks of actions, review of evidence."""

from pyspark.sql import functions as F

from tessera.operators import requests as req


def _read(spark, rows):
    df = spark.createDataFrame(rows, "id long, question string, entities array<string>")
    return {r.id: r for r in req.read_questions(df, entities="entities").collect()}


def test_families_and_steps(spark):
    one, two = ["600000.SH"], ["600000.SH", "000001.SZ"]
    r = _read(
        spark,
        [
            (1, "该公司2023年年报营业收入是多少", one),
            (2, "比较2022年年报和2023年年报的净利润变化", one),
            (3, "股价会涨吗", one),
            (4, "前十大股东是谁", one),
            (5, "张三丰持有多少股东权益并穿透到2023-12-31", one),
            (6, "券商怎么看评级", one),
            (7, "评估财务风险", None),
            (8, "查找问询函公告", []),
            (9, None, None),
            (10, "营业收入是多少", []),
            (11, "警示函", two),
        ],
    )
    assert [r[i].family for i in range(1, 12)] == ["financial_metric_query", "financial_metric_compare", "realtime_market_query", "ownership_snapshot", "ownership_penetration", "research_view_query", "financial_investigation", "document_retrieval", "unknown", "financial_metric_query", "event_query"]
    assert r[1].direct == "metric_query" and r[1].status == "routeable" and r[1].metrics == ["REVENUE"] and r[1].missing == ""
    assert r[2].direct == "metric_compare" and r[2].comparison == "cross_period" and r[2].steps.split(",")[:2] == ["metric_query", "metric_compare"]
    assert r[3].status == "unsupported" and r[4].direct == "holding_query" and r[5].people == ["张三丰"] and "penetration" in r[5].steps
    assert r[6].direct is None and r[6].claim_types == ["investment_rating", "analyst_judgment"]  # it asks for reasons
    assert r[7].status == "clarification_required" and r[8].direct == "search" and r[9].status == "routeable"
    assert r[10].missing == "company_ids,report_periods" and r[10].status == "clarification_required" and r[11].direct is None
    assert _read(spark, []) == {}


def test_holders_named_as_such(spark):
    r = _read(spark, [(1, "股东 甲乙投资（有限合伙） 持股多少", None), (2, "李四减持了多少", None), (3, "公司持有什么", None)])
    assert r[1].people[0] == "甲乙投资（有限合伙）" and r[2].people == ["李四"] and r[3].people == ["公司"]


def test_actions_are_checked_and_mended(spark):
    metric = ("financial_metric_query", "financial_analysis", "metric_query")
    ok = {"company_ids": "600000.SH", "metric_codes": "REVENUE", "report_periods": "2023-12-31", "query": "q"}
    rows = [
        ("a1", "r", 1, *metric, ok),
        ("a2", "r", 2, *metric, ok | {"query": "other words"}),
        ("a3", "r", 3, *metric, ok | {"company_ids": "600000.SH,9", "knowledge_cutoff": "2024-01-01"}),
        ("a4", "r", 4, "financial_metric_compare", "financial_analysis", "metric_compare", ok | {"company_ids": "600000.SH,000001.SZ", "report_periods": "2023-12-31,2022-12-31"}),
        ("a5", "r", 5, "nothing", None, None, {}),
        ("a6", "r", 6, "realtime_market_price", None, None, {}),
        ("a7", "r", 7, "ownership_penetration", "ownership_analysis", "penetration", {"target_entity_id": "x", "source_entity_id": "s", "as_of_date": "2023-12-31", "max_depth": "9", "max_paths": "many"}),
        ("a8", "r", 8, "ownership_snapshot", "ownership_analysis", "search", {}),
        ("a9", "s", 1, *metric, ok),
    ]
    actions = spark.createDataFrame(rows, "action_id string, run_id string, step int, capability string, tool string, operation string, arguments map<string,string>")
    checked = req.check_actions(actions, spark.createDataFrame([("600000.SH",), ("000001.sz ",)], "company_id string"))
    got = {r.action_id: r.errors for r in checked.collect()}
    assert got == {"a1": [], "a2": ["repeats_earlier"], "a3": ["sets_knowledge_cutoff", "unknown_company"], "a4": ["ambiguous_dimension"], "a5": ["unknown_capability"], "a6": ["not_implemented"], "a7": ["too_deep", "too_many_paths", "no_target_code"], "a8": ["operation_mismatch", "missing_company_ids_or_holder_ids"], "a9": []}
    mended = {r.action_id: r.arguments for r in req.repair_actions(checked).collect()}
    assert mended == {"a3": ok}
    assert req.check_actions(actions.where("false"), actions.select(F.col("run_id").alias("company_id"))).count() == 0


def test_review(spark):
    rows = [("a", True, 2), ("a", True, 1), ("b", True, 1), ("b", False, None), ("c", True, 0), ("c", None, None)]
    got = {r.run: (r.review, r.answer_status, r.n_failed, r.n_empty) for r in req.review_evidence(spark.createDataFrame(rows, "run string, succeeded boolean, n_evidence long"), ["run"]).collect()}
    assert got == {"a": ("sufficient", "answered", 0, 0), "b": ("partial", "partially_answered", 1, 0), "c": ("insufficient", "insufficient_evidence", 1, 1)}
