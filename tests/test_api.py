"""The public operations over the smallest tables: checks of arguments, cutoffs and shapes."""

import pytest
from pyspark.sql import functions as F

from tessera.api import ArgumentError, Engine
from tessera.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF)


@pytest.fixture(scope="module")
def company(spark):
    return table(spark, SF, "financial_metrics").groupBy("company_id").count().orderBy(F.desc("count"), "company_id").first().company_id


def test_figures(engine, company):
    periods = ["2021-12-31", "2022-12-31"]
    got = engine.metric_query([company.lower()], ["REVENUE", "CURRENT_LIABILITIES"], periods).collect()
    assert len(got) == 4 and all(r.missing for r in got if r.metric_code == "CURRENT_LIABILITIES")
    assert all(r.missing for r in engine.metric_query([company], ["REVENUE"], periods, knowledge_cutoff="1990-01-01").collect())
    assert engine.metric_compare([company], "REVENUE", periods).count() in (0, 2)
    assert {r.rule_id for r in engine.risk_scan(company, periods, rule_ids=["LEVERAGE_PRESSURE"]).collect()} <= {"LEVERAGE_PRESSURE"}
    assert engine.comparable_periods(company, "2022-12-31").where("report_period > target").count() == 0


def test_holders(engine, spark):
    r = table(spark, SF, "holder_records").first()
    rows = engine.holding_query(company_ids=[r.target_company_id], top_n=3).collect()
    assert 0 < len(rows) <= 3 and rows[0].target_company_id == r.target_company_id
    assert engine.holding_query(holder_ids=[r.holder_entity_id]).where(F.col("holder_entity_id") != r.holder_entity_id).count() == 0
    changes = engine.holding_compare(r.target_company_id, "2021-01-01", "2023-12-31")
    assert set(changes.columns) >= {"change", "ratio_before", "ratio_after"}
    paths = engine.penetration(r.holder_entity_id, r.target_company_id, str(r.announcement_date))
    assert all(p.nodes[0] == r.holder_entity_id and p.nodes[-1] == r.target_company_id for p in paths.collect())


def test_events(engine, spark):
    c = table(spark, SF, "event_records").first().company_id
    n = engine.event_query(c).count()
    assert n > 0 and engine.event_cluster(c).count() >= n and engine.event_query(c, knowledge_cutoff="1990-01-01").count() == 0
    assert engine.event_relations(c).count() >= 0


def test_search(engine):
    got = engine.search("存货周转天数", top_k=5).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and got and got[0].score >= got[-1].score
    only = engine.search("存货周转天数", document_types=["research_report"], knowledge_cutoff="2021-12-31").collect()
    assert all(r.text for r in only)


def test_claims(engine, spark):
    c = table(spark, SF, "research_claims").first().company_id
    got = engine.view_query([c], limit=5).collect()
    assert 0 < len(got) <= 5 and got == sorted(got, key=lambda r: (-r.publish_date.toordinal(), r.claim_id))


@pytest.mark.parametrize(
    "call",
    [
        lambda e: e.metric_query([], ["REVENUE"], ["2021-12-31"]),
        lambda e: e.metric_query(["A", "a "], ["REVENUE"], ["2021-12-31"]),
        lambda e: e.metric_query(["A"], ["NOPE"], ["2021-12-31"]),
        lambda e: e.metric_query(["A"], ["REVENUE"], ["2021-13-31"]),
        lambda e: e.metric_compare(["A"], "REVENUE", ["2021-12-31"]),
        lambda e: e.metric_compare(["A"], "REVENUE", ["2021-12-31", "2022-06-30"]),
        lambda e: e.holding_query(),
        lambda e: e.holding_query(company_ids=["A"], top_n=51),
        lambda e: e.holding_compare("A", "2022-01-01", "2021-01-01"),
        lambda e: e.penetration("A", "A", "2022-01-01"),
        lambda e: e.event_query("A", event_types=["nope"]),
        lambda e: e.event_cluster("A", window_days=0),
        lambda e: e.search(" "),
        lambda e: e.search("x", mode="vector"),
        lambda e: e.search("x", document_types=["nope"]),
        lambda e: e.view_query(["A"], claim_types=["nope"]),
    ],
)
def test_arguments_are_checked(engine, call):
    with pytest.raises(ArgumentError):
        call(engine)
