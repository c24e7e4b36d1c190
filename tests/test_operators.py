"""Operators on small fixtures: edge cases that the queries' SQL doesn't show."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import legal_core_name
from tessera.operators import entities as ent
from tessera.operators import events as ev
from tessera.operators import financial as fin
from tessera.operators import ownership as own
from tessera.operators import research as res
from tessera.operators import retrieval as ret
from tessera.operators import runlog as rl
from tessera.plans import documents, research

D = dt.date


def test_build_metrics_flags_and_repeats(spark):
    w = spark.createDataFrame([("o1", "A", "B", D(2023, 12, 31), D(2024, 4, 1), 1.0, None), ("o1", "A", "B", D(2023, 12, 31), D(2024, 4, 1), 1.0, None), ("o2", "A", None, D(2023, 11, 30), D(2024, 4, 1), 2.0, 3.0)], "object_id string, company_id string, wind_code string, report_period date, announcement_date date, tot_assets double, oper_rev double")
    got = {(r.object_id, r.metric_code): (r.period_type, r.quality_flags) for r in fin.build_metrics(w).collect()}
    assert got == {("o1", "TOTAL_ASSETS"): ("FY", ["wind_code_mismatch"]), ("o2", "TOTAL_ASSETS"): ("NON_STANDARD", ["non_standard_period"]), ("o2", "REVENUE"): ("NON_STANDARD", ["non_standard_period"])}


def test_cutoff_is_applied_before_ranking(spark):
    f = spark.createDataFrame([("A", D(2023, 12, 31), "REVENUE", 1.0, "CNY", D(2024, 4, 1), "e1"), ("A", D(2023, 12, 31), "REVENUE", 2.0, "CNY", D(2024, 8, 1), "e2"), ("A", D(2023, 12, 31), "REVENUE", 9.0, "USD", D(2024, 9, 1), "e3")], "company_id string, report_period date, metric_code string, value double, currency string, announcement_date date, evidence_id string")
    assert fin.current_figures(f, cutoff="2024-05-01").first().value == 1.0
    assert fin.current_figures(f).first().value == 2.0
    assert fin.current_figures(f, cutoff="2020-01-01").count() == 0


def test_global_rank_equals_sorting(spark):
    rnd = random.Random(1)
    values = [float(rnd.randrange(50)) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, value double").repartition(5)
    got = {r.i: r["rank"] for r in fin.global_rank(df, "value", 8).collect()}
    assert all(got[i] == 1 + sum(x > v for x in values) for i, v in enumerate(values))


def test_missing_breaks_a_negative_run(spark):
    rows = [("A", D(2020, 12, 31), -1.0), ("A", D(2022, 12, 31), -1.0), ("A", D(2023, 12, 31), -2.0), ("B", D(2020, 12, 31), -1.0)]
    f = spark.createDataFrame([(a, p, "OPERATING_CASHFLOW", v) for a, p, v in rows], "company_id string, report_period date, metric_code string, value double")
    got = {r.company_id: (r.longest_negative_run, r.status) for r in fin.negative_runs(f, "OPERATING_CASHFLOW", ["2020-12-31", "2021-12-31", "2022-12-31", "2023-12-31"]).collect()}
    assert got == {"A": (2, "triggered"), "B": (1, "insufficient_data")}


H = "record_id string, target_company_id string, holder_entity_id string, holder_name string, holder_category string, holding_quantity long, holding_ratio double, holder_end_date date, announcement_date date"


def test_snapshot_is_visible_only_after_its_announcement(spark):
    rows = [("r1", "T", "h", "h", "PERSON", 1, 0.1, D(2023, 9, 30), D(2023, 10, 30)), ("r2", "T", "h", "h", "PERSON", 1, 0.2, D(2023, 12, 31), D(2024, 4, 1)), ("r2", "T", "h", "h", "PERSON", 1, 0.2, D(2023, 12, 31), D(2024, 4, 1))]
    df = spark.createDataFrame(rows, H)
    assert own.snapshot_rows(df, "2023-12-31").first().record_id == "r1"
    assert own.snapshot_rows(df, "2023-12-31", "2024-06-30").collect()[0].record_id == "r2"


def test_compare_is_symmetric_and_takes_missing_quantities(spark):
    a = spark.createDataFrame([("r1", "T", "x", "x", "PERSON", None, 0.1, D(2023, 1, 1), D(2023, 1, 1)), ("r2", "T", "y", "y", "PERSON", 5, 0.3, D(2023, 1, 1), D(2023, 1, 1))], H)
    b = spark.createDataFrame([("r3", "T", "x", "x", "PERSON", 4, 0.1, D(2024, 1, 1), D(2024, 1, 1)), ("r4", "T", "z", "z", "PERSON", 5, 0.3, D(2024, 1, 1), D(2024, 1, 1))], H)
    go = lambda p, q: {r.holder_entity_id: r.change for r in own.compare_snapshots(p, q).collect()}
    assert go(a, b) == {"x": "unchanged", "y": "exited", "z": "entered"}
    assert go(b, a) == {"x": "unchanged", "y": "entered", "z": "exited"}


def test_paths_are_simple_and_bounded(spark):
    e = spark.createDataFrame([("A", "B", 0.5, "1"), ("B", "C", 0.5, "2"), ("C", "A", 0.5, "3"), ("C", "D", 0.1, "4")], "src string, dst string, ratio double, record_id string")
    got = sorted((r.target, r.depth, r.path_ratio) for r in own.holding_paths(e, spark.createDataFrame([("A",)], "node string"), 4).collect())
    assert got == [("B", 1, 0.5), ("C", 2, 0.25), ("D", 3, 0.025)]
    with pytest.raises(ValueError):
        own.holding_paths(e, spark.createDataFrame([("A",)], "node string"), 7)


def test_shareholder_builder(spark):
    cols = ["s_info_windcode", "ann_dt", "s_holder_enddate", "s_holder_holdercategory", "s_holder_name", "s_holder_aname", "s_holder_quantity", "s_holder_pct", "s_holder_sharecategory", "s_info_compcode", "report_period"]
    good = ("T", "2023-10-01", "2023-09-30", "1", "甲", None, "5", "1.5", "1", None, None)
    raw = spark.createDataFrame([good, good, ("T", "2023-10-01", "2023-09-30", "2", "乙", None, None, "2", "1", "77", "2023-09-30"), ("T", "x", "2023-09-30", "1", "丙", None, "5", "1.5", "1", None, None), ("T", "2023-10-01", "2023-09-30", "1", " ", None, "5", "1.5", "1", None, None), ("T", "2023-10-01", "2023-09-30", "1", "丁", None, "5", "0", "1", None, None)], ", ".join(f"{c} string" for c in cols))
    records, entities, skipped = own.build_holder_records(raw)
    assert records.count() == 2 and {r.skip_reason: r.n for r in skipped.collect()} == {"invalid_announcement_date": 1, "missing_holder_name": 1, "invalid_holding_ratio": 1}
    e = {r.name: (r.holder_entity_id.split(":")[0], r.compcode, r.record_count) for r in entities.collect()}
    assert e == {"甲": ("PERSON_UNRESOLVED", None, 2), "乙": ("COMPANY", "77", 1)}
    flags = {r.holder_name: r.quality_flags_json for r in records.collect()}
    assert flags["甲"] == '["missing_compcode","missing_report_period"]' and flags["乙"] == '["missing_quantity"]'


def brute_clusters(rows, days):
    def like(a, b):
        if not a or not b:
            return 0
        g = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}
        return 1 if a == b else len(g(a) & g(b)) / len(g(a) | g(b))

    clusters, out = [], {}
    for r in rows:
        for c in clusters:
            last = c["members"][-1]
            if abs((r[1] - c["end"]).days) <= days and (set(r[2]) & set(last[2]) or like(r[3], last[3]) >= 0.45):
                c["members"].append(r)
                c["end"] = max(c["end"], r[1])
                break
        else:
            c = {"members": [r], "end": r[1]}
            clusters.append(c)
        out[r[0]] = c["members"][0][0]
    return out


def test_clusters_against_brute_force(spark):
    rnd = random.Random(7)
    rows = sorted(((f"e{i:03d}", D(2022, 1, 1) + dt.timedelta(days=rnd.randrange(400)), [rnd.choice("pqr")] if rnd.random() < 0.3 else [], "".join(rnd.choice("abcd") for _ in range(rnd.randrange(5)))) for i in range(80)), key=lambda r: (r[1], r[0]))
    assert dict(ev.assign_clusters(rows, 30)) == brute_clusters(rows, 30)
    df = spark.createDataFrame([(r[0], "A", "t", r[1], r[2], r[3]) for r in rows], "event_id string, company_id string, event_type string, event_date date, reference_ids array<string>, topic_signature string")
    got, want = {}, {}
    for r in ev.cluster_events(df, 30).collect():
        got.setdefault(r.cluster_id, set()).add(r.event_id)
    for k, v in brute_clusters(rows, 30).items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_relations(spark):
    e = spark.createDataFrame([("1", "A", D(2022, 1, 1), "initial", ["x"]), ("2", "A", D(2022, 2, 1), "response", ["x", "y"]), ("3", "A", D(2022, 3, 1), "progress", ["y", "y"]), ("4", "B", D(2022, 3, 1), "response", ["x"]), ("5", "A", D(2022, 4, 1), "progress", None)], "event_id string, company_id string, event_date date, event_stage string, reference_ids array<string>")
    assert sorted(map(tuple, ev.relations(e).collect())) == [("2", "1", "RESPONDS_TO"), ("2", "3", "FOLLOWED_BY")]


def test_event_titles(spark):
    rows = [("d1", "A", D(2022, 1, 1), "甲：关于收到证监会问询函〔2022〕 12号的公告"), ("d2", "A", D(2022, 1, 1), "不存在被处罚的说明"), ("d3", "A", D(2022, 1, 1), "年度报告"), ("d4", None, D(2022, 1, 1), "处罚"), ("d5", "A", D(2022, 1, 1), None)]
    got = {r.document_id: r for r in ev.build_events(spark.createDataFrame(rows, "document_id string, company_id string, announcement_date date, title string")).collect()}
    assert [got[f"d{i}"].row_status for i in range(1, 6)] == ["event", "non_event", "unclassified", "invalid", "invalid"]
    assert (got["d1"].event_type, got["d1"].event_stage, got["d1"].agencies, got["d1"].reference_ids) == ("regulatory_inquiry", "initial", ["证监会"], ["〔2022〕 12号"])


def test_bm25_counts_repeated_query_tokens_and_empty_sides(spark):
    c = spark.createDataFrame([("1", "alpha beta"), ("2", "beta"), ("3", "gamma"), ("4", None)], "chunk_id string, text string")
    q = lambda t: spark.createDataFrame([(1, t)], "query_id long, query string")
    one = {r.chunk_id: r.score for r in ret.bm25_scores(c, q("alpha")).collect()}
    two = {r.chunk_id: r.score for r in ret.bm25_scores(c, q("alpha alpha")).collect()}
    assert list(one) == ["1"] and abs(two["1"] - 2 * one["1"]) < 1e-8
    assert ret.bm25_scores(c, q("")).count() == 0 and ret.bm25_scores(c.where("false"), q("alpha")).count() == 0


def test_bm25_top_equals_scores(spark):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice(["alpha", "beta", "收入", "收入增长", "x.y"]) for _ in range(rnd.randrange(6)))
    c = spark.createDataFrame([(f"c{i:02d}", text()) for i in range(60)] + [("n", None)], "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame([(i, text() + " alpha") for i in range(7)] + [(99, ""), (98, None)], "query_id long, query string")
    want = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in ret.top_k(ret.bm25_scores(c, q), 5).collect())
    assert want == sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in ret.bm25_top(c, q, 5).collect())
    assert want == sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in ret.bm25_top(c, q, 5, block=2, rows_at_once=7).collect())
    assert ret.bm25_top(c.where("false"), q, 5).count() == 0
    pairs = c.where("text IS NOT NULL").select("text", ret.tokenize(F.col("text")).alias("tokens")).collect()
    assert all(r.tokens == ret.token_list(r.text) for r in pairs)


def test_rrf_bounds_and_cap(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank long")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 2)], "query_id long, chunk_id string, rank long")
    got = {r.chunk_id: r.score for r in ret.rrf_merge(a, b).collect()}
    assert got["x"] == 1.0 and 0 < got["y"] < 1 and got["y"] == got["z"]
    hits = ret.rrf_merge(a, b).withColumn("doc_id", F.when(F.col("chunk_id") == "z", 2).otherwise(1))
    assert [r.chunk_id for r in ret.cap_per_document(hits, 1, 5).orderBy("rank").collect()] == ["x", "z"]


def test_vectors_in_blocks_equal_brute_force(spark):
    rnd = random.Random(2)
    v = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(100, None), (101, [0.0] * 4), (102, [1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    q = df.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted((r.query_id, r["rank"], r.vec_id) for r in ret.vector_scores(df, q, 3).collect())
    assert whole == sorted((r.query_id, r["rank"], r.vec_id) for r in ret.vector_scores(df, q, 3, block=3).collect())
    assert all(i == q for q, r, i in whole if r == 1) and len(whole) == 30


def test_claims(spark):
    d = spark.createDataFrame([(1, "甲方：业绩增长", "事件：甲公告。盈利预测：稳步。风险提示：需求不及预期；价格波动；价格波动；短"), (2, None, None)], "doc_id long, title string, text string")
    got = sorted((r.claim_type, r.topic, r.stance, r.claim_text) for r in res.extract_claims(d).collect())
    assert got == [("analyst_judgment", "核心判断", "positive", "业绩增长"), ("cited_fact", "研报引用事实", "neutral", "甲公告。"), ("earnings_forecast", "盈利预测", "neutral", "稳步。"), ("risk_opinion", "价格", "negative", "价格波动"), ("risk_opinion", "需求", "negative", "需求不及预期")]


def test_views_reject_reasons(spark):
    cols = "report_id string, sec_code string, exchange_code string, publish_date string, org_name string, author string, title string, abstract string, rating_org string"
    rows = [("1", "600000", "XSHG", "2024-01-01", "o", "a,b；c", "t", "x", "买入"), ("2", "83", "XSHG", "2024-01-01", "o", "a", "t", "x", None), ("3", "830001", "XBEI", "2024-13-01", "o", "a", "t", "x", None), ("4", "830001", "XBSE", "2024-01-01", None, "a", "t", "x", None)]
    got = [(r.reject_reason, r.company_id, r.rating_stance) for r in res.build_views(spark.createDataFrame(rows, cols)).orderBy("report_id").collect()]
    assert got == [(None, "600000.SH", "positive"), ("invalid_identity", "83.SH", "neutral"), ("invalid_date", "830001.BJ", "neutral"), ("missing_content", "830001.BJ", "neutral")]


def test_locate_chunks(spark):
    c = spark.createDataFrame([("c1", 1, "甲乙丙"), ("c2", 1, "甲乙丙丁戊X"), ("c3", 1, "无关文字内容"), ("c4", 1, None)], "claim_id string, doc_id long, source_span string")
    k = spark.createDataFrame([(1, "k1", "零\n甲乙 丙一"), (1, "k2", "甲乙丙丁戊")], "doc_id long, chunk_id string, text string")
    assert sorted(map(tuple, res.locate_chunks(c, k).collect())) == [("c1", "k1", True), ("c2", "k2", False)]


def test_links_by_priority(spark):
    h = spark.createDataFrame([("h1", "甲股份有限公司"), ("h2", "乙有限公司"), ("h3", "丙集团有限公司"), ("h4", None)], "holder_entity_id string, name string")
    c = spark.createDataFrame([("c1", "甲股份有限公司", True), ("c2", "乙有限公司", False), ("c3", "乙有限公司", False), ("c4", "丙股份有限公司", True)], "company_id string, name string, is_legal boolean")
    got = sorted((r.holder_entity_id, r.company_id, r.match_method, r.linked) for r in ent.link_holders(h, c).collect())
    assert got == [("h1", "c1", "exact_legal_name", True), ("h2", "c2", "ambiguous_exact_normalized_name", False), ("h2", "c3", "ambiguous_exact_normalized_name", False), ("h3", "c4", "unique_legal_core", True)]


def test_every_document_has_its_visible_text(spark, tmp_path):
    texts = [(1, "<p>甲</p>乙"), (2, "甲<br>乙"), (3, "甲&amp;乙"), (4, "甲 乙"), (5, "3 < 5"), (6, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.visible for r in documents.doc_html(spark, str(tmp_path)).collect()}
    assert got == {1: "甲\n乙", 2: "甲\n乙", 3: "甲&乙", 4: "甲 乙", 5: "3 < 5", 6: None}


def test_audit_equals_all_pairs(spark):
    rnd = random.Random(5)
    name = lambda: "".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randrange(1, 6))) + rnd.choice(["", "股份", "科技股份有限公司", "集团有限公司"])
    holders, companies = [(f"h{i:02d}", name()) for i in range(40)], [(f"c{i:03d}", name()) for i in range(150)]
    core = {r.x: r.core for r in spark.createDataFrame([(n,) for _, n in holders + companies], "x string").select("x", legal_core_name(F.col("x")).alias("core")).distinct().collect()}

    def score(a, b):
        grams = [{s[i : i + 2] for i in range(max(1, len(s) - 1))} for s in (a, b)]
        s = 0.55 * SequenceMatcher(None, a, b, autojunk=False).ratio() + 0.45 * 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1]))
        short, long = sorted((core[a], core[b]), key=len)
        return 1.0 if a == b else round(max(s, 0.88 + 0.08 * len(short) / len(long)) if len(short) >= 4 and short in long else s, 6)

    want = set()
    for h, a in holders:
        near = sorted((-score(a, b), c) for c, b in companies if score(a, b) >= 0.62)[:3]
        want |= {(h, c, i + 1, -s) for i, (s, c) in enumerate(near)} or {(h, None, None, None)}
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} string, name string")
    for options in ({}, {"block": 40}):
        got = ent.audit_unlinked(frame(holders, "holder_entity_id"), frame(companies, "company_id"), frame([], "holder_entity_id"), **options)
        assert {(r.holder_entity_id, r.company_id, r["rank"], r.score) for r in got.collect()} == want


def test_audit_takes_the_best_pair_of_aliases(spark, tmp_path):
    rows = {
        "holder_entities": ([("h1", "甲乙丙丁商社", "COMPANY"), ("h2", "己庚商社", "COMPANY"), ("h3", None, "COMPANY")], "holder_entity_id string, name string, entity_type string"),
        "listed_company_entities": ([("c1", "600000.SH"), ("c2", "戊己股份有限公司")], "company_id string, canonical_name string"),
        "entity_aliases": ([("c1", "甲乙丙丁戊己股份有限公司", "FORMER_SECURITY_NAME"), ("h1", "甲乙丙丁戊己股份公司", "TYPED_NAME"), ("h2", "己庚一号证券投资基金", "DISCLOSED_NAME")], "entity_id string, alias string, alias_type string"),
    }
    for name, (data, ddl) in rows.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.holder_entity_id: (r.company_id, r.finding) for r in research.ent_audit(spark, str(tmp_path)).where("coalesce(rank, 1) = 1").collect()}
    assert got == {"h1": ("c1", "legal_core_collision"), "h2": (None, "institution_or_vehicle"), "h3": (None, "insufficient_candidate")}


def test_names_in_texts_longest_wins(spark):
    t = spark.createDataFrame([(1, "甲乙丙丁公司 与甲乙丙丁"), (2, None), (3, "")], "doc_id long, text string")
    n = spark.createDataFrame([("甲乙丙丁",), ("甲乙丙丁公司",), ("短",)], "alias string")
    assert sorted(r.alias for r in ent.names_in_texts(t, n).collect()) == ["甲乙丙丁", "甲乙丙丁公司"]
    assert ent.names_in_texts(t, n.where("false")).count() == 0


def test_log_helpers(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "")], "k string, v string")
    b = spark.createDataFrame([("2", "y"), ("3", None)], "k string, v string")
    assert sorted((r.k, r.v) for r in rl.merge_logs(a, b, "k", ["v"]).collect() if r.v) == [("1", "x"), ("2", "y")]
    t = spark.createDataFrame([("s", 1, "completed"), ("s", 2, "pending"), ("s", 4, "pending")], "s string, t int, status string")
    assert [r.ready for r in rl.prior_turns_done(t, "s", "t", "status").orderBy("t").collect()] == [True, True, False]
    assert not rl.turns_contiguous(t, "s", "t").first().contiguous
    with pytest.raises(ValueError):
        rl.page(t, [F.col("t")], 0)


def test_stored_index_answers_like_a_scan(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "营业收入", "存货"]) for _ in range(rnd.randrange(1, 9)))
    c = spark.createDataFrame([(f"c{i:02d}", text()) for i in range(50)] + [("n", None), ("e", "")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "alpha 营业收入"), (2, "beta beta"), (3, "nothing here"), (4, None)], "query_id long, query string")
    ret.write_index(c, str(tmp_path / "i"), buckets=4)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    assert rows(ret.search_index(spark, str(tmp_path / "i"), q, 6)) == rows(ret.bm25_top(c, q, 6))
    ret.write_index(c.where("false"), str(tmp_path / "empty"))
    assert ret.search_index(spark, str(tmp_path / "empty"), q, 3).count() == 0


def test_running_best_keeps_what_one_sort_would():
    import numpy as np

    rnd = np.random.default_rng(2)
    best, hits = ret.Best(3, 4), []
    best.most = 20
    for _ in range(30):
        q, s, i = rnd.integers(0, 4, 15), rnd.integers(0, 9, 15).astype(float), rnd.permutation(10_000)[:15]
        best.add(q, s, i)
        hits += zip(q.tolist(), (-s).tolist(), i.tolist(), strict=True)
    q, s, i = best.rows()
    assert sorted(zip(q.tolist(), (-s).tolist(), i.tolist(), strict=True)) == sorted(x for k in range(4) for x in sorted(h for h in hits if h[0] == k)[:3])


def test_written_tables_are_deleted(spark):
    from tessera.session import delete_written, materialize

    materialize(spark.range(3))
    assert delete_written(spark) >= 1 and delete_written(spark) == 0


def test_store_is_numbered_without_gaps(spark):
    from tessera.operators import documents as docs

    c = spark.createDataFrame([(f"c{i % 40:02d}", i % 7, "t") for i in range(80)] + [(None, 1, "t"), ("z", 99, "t")], "chunk_id string, doc_id long, text string")
    d = spark.createDataFrame([(i, f"title {i}", "other") for i in range(7)] * 2, "doc_id long, title string, text string")
    store = docs.corpus_store(c, d)
    rows = store.orderBy("vector_row").collect()
    assert [r.vector_row for r in rows] == list(range(40)) and [r.chunk_id for r in rows] == [f"c{i:02d}" for i in range(40)] and rows[0].text == "t"
    assert docs.check_store(store).first().dense and docs.check_store(store.where("false")).first().dense
    assert tuple(docs.index_coverage(d, c, "doc_id").first()) == (7, 7, 0, 1.0, None)
    assert docs.index_coverage(d, c.where("doc_id < 2"), "doc_id").first().warning == "5 of 7 are not in the index"
    docs.check_embedding({"model": "m", "dimension": 4}, model="m", dimension=4, mode="x")
    with pytest.raises(ValueError):
        docs.check_embedding({"dimension": 4}, model="m", dimension=8)


def test_profiles_are_merged_by_the_last_success(spark):
    from tessera.operators import entities

    c = spark.createDataFrame([("600000.SH", ["b", "a"]), ("000001.SZ", []), ("430001.BJ", ["x"])], "company_id string, names array<string>")
    rows = [("600000.SH", "success", 1, "Old", "S", None, "p"), ("600000.SH", "success", 2, "Legal", " ", ["F1", ""], "p"), ("600000.SH", "failed", 3, "Bad", None, None, "p"), ("999999.SH", "success", 1, "N", None, None, "p")]
    p = spark.createDataFrame(rows, "company_id string, fetch_status string, fetched_at int, legal_name string, security_name string, former_names array<string>, source string")
    named, aliases = entities.merge_profiles(c, p)
    assert {r.company_id: (r.name, r.resolution_status) for r in named.collect()} == {"600000.SH": ("Legal", "profiled"), "000001.SZ": ("000001.SZ", "code_only"), "430001.BJ": ("x", "named")}
    assert {(r.alias, r.alias_type) for r in aliases.collect()} == {("Legal", "LEGAL_NAME"), ("F1", "FORMER_SECURITY_NAME")}
