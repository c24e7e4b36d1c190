"""Queries over company events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.session import table

ARGS = {"types": ["share_pledge", "regulatory_penalty"], "start": "2021-01-01", "end": "2021-12-31", "cutoff": "2021-09-30"}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "event_records").drop("reference_ids").withColumn("reference_ids", F.from_json("reference_ids_json", "array<string>"))
    return e.dropDuplicates(["event_id"])


def _announcements(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("document_type = 'announcement'")
    return d.select("document_id", "company_id", F.col("published_date").alias("announcement_date"), "title")


def ev_query(spark: SparkSession, sf: str) -> DataFrame:
    return ev.query_events(_events(spark, sf), keywords=["问询", "质押"], **ARGS).select("event_id", "company_id", "event_type", "event_date", "title")


def ev_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return ev.timeline(ev.query_events(_events(spark, sf), start="2022-01-01"), 100).select("event_id", "event_date", "event_type")


def ev_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("company_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


def ev_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return ev.diagnose(_events(spark, sf), table(spark, sf, "listed_company_entities"), **ARGS)


def ev_validation(spark: SparkSession, sf: str) -> DataFrame:
    return ev.validate_events(table(spark, sf, "event_records"))


def ev_relations(spark: SparkSession, sf: str) -> DataFrame:
    return ev.relations(_events(spark, sf))


def ev_topic_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the topic signature as the shared reference."""
    return ev.relations(_events(spark, sf).withColumn("reference_ids", F.array(F.col("event_type"))))


def ev_gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return ev.gap_clusters(_events(spark, sf), 30).select("company_id", "event_type", "start_date", "end_date", "n_events")


def ev_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return ev.cluster_events(_events(spark, sf), 90)


def ev_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Announcement titles as events."""
    b = ev.build_events(_announcements(spark, sf))
    return b.select("document_id", "row_status", "event_type", "event_stage", F.array_join("reference_ids", "|").alias("reference_ids"), "topic_signature")


def ev_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements as events by their titles and tags."""
    a = table(spark, sf, "documents").where("document_type = 'announcement'")
    a = a.select("document_id", "company_id", F.col("published_date").alias("announcement_date"), "title", F.col("tags").alias("categories"))
    return ev.build_events(a).select("document_id", "row_status", "event_type")


def ev_build_report(spark: SparkSession, sf: str) -> DataFrame:
    return ev.build_events(_announcements(spark, sf)).groupBy("row_status", "event_type", "event_stage").agg(F.count(F.lit(1)).alias("n"))


def _case(rules, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rules)
    return f"CASE {whens} ELSE {default} END"


_E = "WITH e AS (SELECT DISTINCT ON (event_id) *, CAST(reference_ids_json AS VARCHAR[]) AS refs FROM event_records)"
_TYPES = ", ".join(f"'{t}'" for t in ARGS["types"])
_BUILD = f"""WITH a AS (SELECT document_id, company_id, published_date, trim(title) AS t FROM documents WHERE document_type = 'announcement'),
b AS (SELECT document_id, CASE WHEN company_id IS NULL OR published_date IS NULL OR coalesce(t, '') = '' THEN 'invalid' WHEN {" OR ".join(f"contains(regexp_replace(t, '[[:space:]]+', '', 'g'), '{w}')" for w in ev.NON_EVENTS)} THEN 'non_event'
  WHEN {_case(ev.EVENT_TYPES, "NULL")} IS NULL THEN 'unclassified' ELSE 'event' END AS row_status, {_case(ev.EVENT_TYPES, "NULL")} AS event_type, {_case(ev.STAGES, "'unknown'")} AS event_stage, t FROM a)"""
_RELATION = """, x AS (SELECT event_id, company_id, event_stage, unnest({refs}) AS ref, event_date FROM e),
n AS (SELECT event_id, event_stage, lag({{'d': event_date, 'i': event_id}}) OVER (PARTITION BY company_id, ref ORDER BY event_date, event_id) AS p FROM x),
m AS (SELECT event_id, any_value(event_stage) AS event_stage, max(p) AS p FROM n WHERE p IS NOT NULL GROUP BY 1),
k AS (SELECT *, CASE event_stage WHEN 'response' THEN 'RESPONDS_TO' WHEN 'remediation' THEN 'REMEDIATES' WHEN 'resolution' THEN 'RESOLVES' WHEN 'correction' THEN 'CORRECTS' ELSE 'FOLLOWED_BY' END AS relation_type FROM m)
SELECT CASE WHEN relation_type <> 'FOLLOWED_BY' THEN event_id ELSE p.i END AS source_event_id, CASE WHEN relation_type <> 'FOLLOWED_BY' THEN p.i ELSE event_id END AS target_event_id, relation_type FROM k"""

SQL = {
    "ev_query": f"{_E} SELECT event_id, company_id, event_type, event_date, title FROM e WHERE event_type IN ({_TYPES}) AND event_date BETWEEN DATE '2021-01-01' AND DATE '2021-12-31' AND announcement_date <= DATE '2021-09-30' AND (contains(title, '问询') OR contains(title, '质押') OR contains(summary, '问询') OR contains(summary, '质押'))",
    "ev_timeline": f"{_E} SELECT event_id, event_date, event_type FROM e WHERE event_date >= DATE '2022-01-01' ORDER BY event_date, event_id LIMIT 100",
    "ev_summary": f"{_E} SELECT company_id, event_type, count(*) AS n, min(event_date) AS first_date, max(event_date) AS last_date FROM e GROUP BY 1, 2",
    "ev_diagnosis": f"""{_E}, g AS (SELECT company_id, count(*) AS n_events, min(event_date) AS first_date, max(event_date) AS last_date, count(*) FILTER (WHERE event_type IN ({_TYPES})) AS n_type,
  count(*) FILTER (WHERE event_type IN ({_TYPES}) AND event_date BETWEEN DATE '2021-01-01' AND DATE '2021-12-31') AS nw, count(*) FILTER (WHERE event_type IN ({_TYPES}) AND event_date BETWEEN DATE '2021-01-01' AND DATE '2021-12-31' AND announcement_date <= DATE '2021-09-30') AS nm FROM e GROUP BY 1)
SELECT company_id, CASE WHEN n_events IS NULL THEN 'company_not_present_in_event_index' WHEN nm > 0 THEN 'matched' WHEN n_type = 0 THEN 'event_type_not_available_for_company' WHEN nw > 0 THEN 'all_matches_after_knowledge_cutoff' ELSE 'date_or_keyword_filters_not_matched' END AS reason,
  coalesce(n_events, 0) AS n_events, first_date, last_date, coalesce(nw, 0) AS n_without_cutoff FROM listed_company_entities LEFT JOIN g USING (company_id)""",
    "ev_validation": "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_ids, count(*) FILTER (WHERE n > 1) AS n_repeated_ids, CAST(sum(bad) AS BIGINT) AS n_incomplete FROM (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE event_id IS NULL OR company_id IS NULL OR event_type IS NULL OR event_date IS NULL OR title IS NULL) AS bad FROM event_records GROUP BY 1)",
    "ev_relations": _E + _RELATION.format(refs="list_distinct(refs)"),
    "ev_topic_relations": _E + _RELATION.format(refs="[event_type]"),
    "ev_gap_clusters": f"""{_E}, g AS (SELECT *, CASE WHEN date_diff('day', lag(event_date) OVER w, event_date) <= 30 THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY company_id, event_type ORDER BY event_date, event_id)),
c AS (SELECT *, sum(s) OVER (PARTITION BY company_id, event_type ORDER BY event_date, event_id) AS n FROM g)
SELECT company_id, event_type, min(event_date) AS start_date, max(event_date) AS end_date, count(*) AS n_events FROM c GROUP BY company_id, event_type, n""",
    "ev_classified": _BUILD
    + f""" SELECT document_id, row_status, event_type, event_stage,
  array_to_string(list_distinct(list_concat(regexp_extract_all(t, '([〔\\[（(]\\d{{4}}[〕\\]）)]\\s*\\d+号)', 1), regexp_extract_all(t, '((?:问询函|关注函|监管函|警示函|处罚字)\\s*[A-Za-z0-9_-]{{2,24}}号)', 1))), '|') AS reference_ids,
  substr(lower(regexp_replace(regexp_replace(t, '{ev.BOILERPLATE}', '', 'g'), '[^一-鿿A-Za-z0-9]', '', 'g')), 1, 160) AS topic_signature FROM b""",
    "ev_categories": f"""WITH a AS (SELECT document_id, company_id, published_date, trim(title) AS own, concat_ws(' ', trim(title), array_to_string(tags, ' ')) AS t FROM documents WHERE document_type = 'announcement')
SELECT document_id, CASE WHEN company_id IS NULL OR published_date IS NULL OR coalesce(own, '') = '' THEN 'invalid' WHEN {" OR ".join(f"contains(regexp_replace(own, '[[:space:]]+', '', 'g'), '{w}')" for w in ev.NON_EVENTS)} THEN 'non_event'
  WHEN {_case(ev.EVENT_TYPES, "NULL")} IS NULL THEN 'unclassified' ELSE 'event' END AS row_status, {_case(ev.EVENT_TYPES, "NULL")} AS event_type FROM a""",
    "ev_build_report": _BUILD + " SELECT row_status, event_type, event_stage, count(*) AS n FROM b GROUP BY 1, 2, 3",
}
QUERIES = {k: globals()[k] for k in [*SQL, "ev_clusters"]}
