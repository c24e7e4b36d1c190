"""Company events: classification of titles, queries with diagnosis, clusters and relations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import CJK, contains_any, extract_distinct, first_label, grams, hash_id, ilike_any, jaccard

# Event types, statements that are no event, stages; the first rule that fits counts.
EVENT_TYPES = [
    ("regulatory_inquiry", ("问询", "关注函", "监管函")),
    ("audit_opinion", ("审计意见", "保留意见", "无法表示意见", "否定意见")),
    ("controller_change", ("控制权变更", "实际控制人变更", "实控人变更")),
    ("share_pledge", ("股份质押", "股权质押", "解除质押")),
    ("financial_restated", ("会计差错", "财务报表更正", "前期差错更正", "更正公告")),
    ("major_litigation", ("重大诉讼", "重大仲裁", "诉讼进展", "仲裁进展")),
    ("regulatory_penalty", ("行政处罚", "处罚决定", "监管措施", "警示函", "立案", "纪律处分", "违规", "处罚")),
    ("risk_warning", ("退市风险", "风险警示", "实施其他风险警示", "撤销风险警示")),
]
NON_EVENTS = ("不存在被", "未被证券监管", "未受到证券监管", "未受过", "无被处罚", "不存在处罚")
STAGES = [
    ("correction", ("更正", "补充公告", "修订")),
    ("remediation", ("整改报告", "整改完成", "整改情况")),
    ("response", ("回复", "答复")),
    ("resolution", ("结案", "终结", "判决", "处罚决定书", "撤销")),
    ("progress", ("进展", "延期", "听证")),
    ("initial", ("收到", "立案", "受理", "提起诉讼", "质押")),
]
# Patterns of agencies, reference numbers and boilerplate of titles.
AGENCY = rf"([{CJK}]{{2,20}}?(?:证监会|证监局|证券交易所|交易所|监管局|人民法院|法院|仲裁委员会))"
REFERENCES = (r"([〔\[（(]\d{4}[〕\]）)]\s*\d+号)", r"((?:问询函|关注函|监管函|警示函|处罚字)\s*[A-Za-z0-9_-]{2,24}号)")
BOILERPLATE = r"^.*?[:：]|关于|公司|收到|出具|有关|相关|公告|报告|决定书|通知书|回复|答复|整改|进展|情况|的"
RELATIONS = {"response": "RESPONDS_TO", "remediation": "REMEDIATES", "resolution": "RESOLVES", "correction": "CORRECTS"}
MIN_TOPIC_SIMILARITY = 0.45


def classify_event(title: Column, categories: Column | None = None) -> Column:
    """The first type whose words stand in the title or in a category (array<string>) of the announcement."""
    text = title if categories is None else F.concat_ws(" ", title, categories)
    return first_label(text, EVENT_TYPES)


def is_non_event(title: Column) -> Column:
    return contains_any(F.regexp_replace(title, r"\s+", ""), NON_EVENTS)


def classify_stage(title: Column) -> Column:
    return first_label(title, STAGES, "unknown")


def extract_agencies(title: Column) -> Column:
    """Agencies named in a title, each without what stands before its last introducing word."""
    found = F.regexp_extract_all(title, F.lit(AGENCY), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^.*(?:收到|来自|由|被|对)(?=.)", "")))


def extract_references(title: Column) -> Column:
    return extract_distinct(title, *REFERENCES)


def topic_signature(title: Column) -> Column:
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(title, BOILERPLATE, ""), rf"[^{CJK}A-Za-z0-9]", "")), 1, 160)


def build_events(announcements: DataFrame) -> DataFrame:
    """Event rows of announcements (document_id, company_id, announcement_date, title, and where the source has them
    categories array<string>) with ``row_status``: event, non_event, unclassified or invalid."""
    t = F.trim("title")
    invalid = F.col("document_id").isNull() | F.col("company_id").isNull() | F.col("announcement_date").isNull() | F.coalesce(t == "", F.lit(True))
    kind = classify_event(t, F.col("categories") if "categories" in announcements.columns else None)
    return announcements.select(
        "document_id",
        "company_id",
        "announcement_date",
        F.when(invalid, "invalid").when(is_non_event(t), "non_event").when(kind.isNull(), "unclassified").otherwise("event").alias("row_status"),
        kind.alias("event_type"),
        classify_stage(t).alias("event_stage"),
        F.coalesce(extract_agencies(t), F.array().cast("array<string>")).alias("agencies"),
        F.coalesce(extract_references(t), F.array().cast("array<string>")).alias("reference_ids"),
        topic_signature(t).alias("topic_signature"),
        hash_id("EVT-", 20, F.col("document_id"), kind).alias("event_id"),
    )


def query_events(events: DataFrame, *, company_ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None, types: Sequence[str] | None = None, keywords: Sequence[str] | None = None, cutoff: str | None = None) -> DataFrame:
    """Events that pass every given filter; dates are inclusive, keywords are plain text in title or summary."""
    q = events
    if company_ids:
        q = q.where(F.col("company_id").isin(list(company_ids)))
    if types:
        q = q.where(F.col("event_type").isin(list(types)))
    if start:
        q = q.where(F.col("event_date") >= F.lit(start).cast("date"))
    if end:
        q = q.where(F.col("event_date") <= F.lit(end).cast("date"))
    if cutoff:
        q = q.where(F.col("announcement_date") <= F.lit(cutoff).cast("date"))
    if keywords:
        q = q.where(ilike_any([F.col("title"), F.col("summary")], list(keywords)))
    return q


def timeline(events: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` events by date and id, as the operation returns them."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return events.orderBy("event_date", "event_id").limit(limit)


def diagnose(events: DataFrame, companies: DataFrame, *, types: Sequence[str], start: str, end: str, cutoff: str) -> DataFrame:
    """Per company why a query with these filters has no result, or matched; one aggregation for all companies."""
    d = lambda x: F.lit(x).cast("date")
    fits = F.col("event_type").isin(list(types)) & F.col("event_date").between(d(start), d(end))
    seen = fits & (F.col("announcement_date") <= d(cutoff))
    agg = events.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.count_if(F.col("event_type").isin(list(types))).alias("n_type"), F.count_if(fits).alias("n_without_cutoff"), F.count_if(seen).alias("n_matched"))
    n = F.coalesce("n_events", F.lit(0))
    reason = F.when(n == 0, "company_not_present_in_event_index").when(F.col("n_matched") > 0, "matched").when(F.col("n_type") == 0, "event_type_not_available_for_company").when(F.col("n_without_cutoff") > 0, "all_matches_after_knowledge_cutoff").otherwise("date_or_keyword_filters_not_matched")
    return companies.select("company_id").distinct().join(agg, "company_id", "left").select("company_id", reason.alias("reason"), n.alias("n_events"), "first_date", "last_date", F.coalesce("n_without_cutoff", F.lit(0)).alias("n_without_cutoff"))


def validate_events(events: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, ids of several rows, rows without a required field."""
    required = ["event_id", "company_id", "event_type", "event_date", "title"]
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    per = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_repeated_ids"), F.sum("bad").alias("n_incomplete"))


def relations(events: DataFrame) -> DataFrame:
    """Each event with the latest earlier one of its company that shares a reference number.

    References are exploded and the nearest earlier event of each (company, reference) is one lag, so nothing is paired
    within a reference; the latest over an event's references counts. events: event_id, company_id, event_date,
    event_stage, reference_ids array<string>.
    """
    e = events.select("event_id", "company_id", "event_date", "event_stage", "reference_ids").dropDuplicates(["event_id"])
    w = Window.partitionBy("company_id", "ref").orderBy("event_date", "event_id")
    near = e.select("*", F.explode(F.array_distinct("reference_ids")).alias("ref")).select("event_id", "company_id", "event_stage", F.lag(F.struct("event_date", "event_id")).over(w).alias("prev")).where("prev IS NOT NULL")
    best = near.groupBy("event_id").agg(F.max("prev").alias("prev"), F.first("event_stage").alias("event_stage"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in RELATIONS.items() for x in p])[F.col("event_stage")], F.lit("FOLLOWED_BY"))
    back = kind != "FOLLOWED_BY"
    return best.select(F.when(back, F.col("event_id")).otherwise(F.col("prev.event_id")).alias("source_event_id"), F.when(back, F.col("prev.event_id")).otherwise(F.col("event_id")).alias("target_event_id"), kind.alias("relation_type"))


def gap_clusters(events: DataFrame, window_days: int = 30) -> DataFrame:
    """Clusters by date alone: a gap of more than ``window_days`` to the event before of (company, type) begins a new one."""
    w = Window.partitionBy("company_id", "event_type").orderBy("event_date", "event_id")
    gap = F.datediff("event_date", F.lag("event_date").over(w))
    marked = events.dropDuplicates(["event_id"]).withColumn("n", F.sum(F.when(gap <= window_days, 0).otherwise(1)).over(w))
    return marked.groupBy("company_id", "event_type", "n").agg(F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"), F.count(F.lit(1)).alias("n_events"))


def _bigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 2] for i in range(max(1, len(s) - 1)))


class Assigner:
    """Sequential assignment of the events of one company and type, fed in order.

    An event joins the first open cluster whose end is near enough and whose last member shares a reference or a similar
    topic. Only clusters that ended within the window are kept, so the state stays small however many events come.
    """

    def __init__(self, window_days: int):
        self.days = window_days
        self.open: list[list] = []  # seed, end, references, bigrams and topic of the last member

    def place(self, event_id: str, day, references, topic: str | None) -> str:
        """The first event of the cluster the event belongs to."""
        # events come in order of date: a cluster that ended too long ago can't match again
        self.open = [c for c in self.open if (day - c[1]).days <= self.days]
        refs, mine = frozenset(references or ()), _bigrams(topic) if topic else frozenset()
        for c in self.open:
            both = bool(mine) and bool(c[3])
            if refs & c[2] or (both and (topic == c[4] or len(mine & c[3]) / len(mine | c[3]) >= MIN_TOPIC_SIMILARITY)):
                c[1:] = max(c[1], day), refs, mine, topic
                return c[0]
        self.open.append([event_id, day, refs, mine, topic])
        return event_id


def assign_clusters(rows: list[tuple], window_days: int) -> list[tuple[str, str]]:
    """(event id, id of the cluster's first event) for rows (id, date, references, topic) in order."""
    a = Assigner(window_days)
    return [(r[0], a.place(*r)) for r in rows]


def cluster_events(events: DataFrame, window_days: int = 30) -> DataFrame:
    """(event_id, cluster_id): the sequential assignment, per company and type.

    The assignment depends on the order, so events of a run go through one task one after the other; runs are cut wherever
    the gap is longer than the window, where no event can join an earlier cluster. Rows are sorted by Spark (which
    spills) and streamed in Arrow batches past a state of the clusters still open, so no group is ever held as a whole.
    """
    e = events.select("event_id", "company_id", "event_type", "event_date", "reference_ids", "topic_signature").where("event_date IS NOT NULL").dropDuplicates(["event_id"])
    w = Window.partitionBy("company_id", "event_type").orderBy("event_date", "event_id")
    gap = F.datediff("event_date", F.lag("event_date").over(w))
    runs = e.withColumn("run", F.sum(F.when(gap <= window_days, 0).otherwise(1)).over(w))
    key = ["company_id", "event_type", "run"]
    ordered = runs.repartition(*key).sortWithinPartitions(*key, "event_date", "event_id")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            seeds = []
            for company, kind, run, eid, day, refs, topic in zip(*(b[c] for c in (*key, "event_id", "event_date", "reference_ids", "topic_signature")), strict=True):
                if (company, kind, run) != at:
                    at, state = (company, kind, run), Assigner(window_days)
                seeds.append(state.place(eid, day, [] if refs is None else list(refs), topic))
            yield b[["event_id", "company_id", "event_type"]].assign(seed=seeds)

    found = ordered.mapInPandas(assign, "event_id string, company_id string, event_type string, seed string")
    return found.select("event_id", hash_id("CLUSTER-", 16, F.col("company_id"), F.col("event_type"), F.col("seed")).alias("cluster_id"))


def topic_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(jaccard(F.array_distinct(grams(a)), F.array_distinct(grams(b))))


