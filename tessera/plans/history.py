"""Queries of the general training-data problems: point-in-time joins, histories, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.asof import known_at
from tessera.operators.orphans import Reference, orphan_references, orphan_report
from tessera.operators.scd2 import scd2_history, scd2_merge
from tessera.session import table


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "evaluation_cases").select("batch_id", "case_id", "annotation_json").distinct()
    batches = table(spark, sf, "evaluation_batches").select("batch_id", "knowledge_cutoff").distinct()
    asked = F.from_json("annotation_json", "company_id string, metric_code string, report_period string")
    # Batches are joined with cases without a hint: their size is checked by AQE and the broadcast threshold.
    return cases.join(batches, "batch_id").select("batch_id", "case_id", "knowledge_cutoff", F.upper(F.trim(asked["company_id"])).alias("company_id"), F.trim(asked["metric_code"]).alias("metric_code"), F.to_date(asked["report_period"]).alias("report_period"))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "financial_metrics").select("company_id", "metric_code", "report_period", "announcement_date", "evidence_id")
    return known_at(
        _requests(spark, sf),
        facts,
        request_keys=[F.col("company_id"), F.col("metric_code")],
        request_period=F.col("report_period"),
        cutoff=F.col("knowledge_cutoff"),
        fact_keys=[F.upper(F.trim("company_id")), F.col("metric_code")],
        fact_period=F.col("report_period"),
        available_on=F.col("announcement_date"),
        row_id=F.col("evidence_id"),
        out_col="evidence_id",
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf).where("evidence_id IS NOT NULL").select("batch_id", "case_id", "evidence_id")


def p2_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Cases per batch, with and without a figure known at the cutoff."""
    return _known(spark, sf).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_cases"), F.count("evidence_id").alias("n_known"))


_P2_KNOWN = """
WITH cases AS (
  SELECT DISTINCT c.batch_id, c.case_id, b.knowledge_cutoff,
         upper(trim(json_extract_string(annotation_json, '$.company_id'))) AS company_id,
         json_extract_string(annotation_json, '$.metric_code') AS metric_code,
         CAST(json_extract_string(annotation_json, '$.report_period') AS DATE) AS report_period
  FROM evaluation_cases c JOIN evaluation_batches b USING (batch_id)
), known AS (
  SELECT c.batch_id, c.case_id, f.evidence_id,
         row_number() OVER (PARTITION BY c.batch_id, c.case_id ORDER BY f.report_period DESC, f.announcement_date DESC, f.evidence_id DESC) AS rn
  FROM cases c LEFT JOIN financial_metrics f
    ON f.company_id = c.company_id AND f.metric_code = c.metric_code AND f.announcement_date <= c.knowledge_cutoff
   AND (c.report_period IS NULL OR f.report_period = c.report_period)
)
"""
P2_SQL = _P2_KNOWN + "SELECT batch_id, case_id, evidence_id FROM known WHERE rn = 1 AND evidence_id IS NOT NULL"
P2_COVERAGE_SQL = _P2_KNOWN + "SELECT batch_id, count(*) AS n_cases, count(evidence_id) AS n_known FROM known WHERE rn = 1 GROUP BY 1"


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return scd2_history(table(spark, sf, "holder_records"), group="target_company_id", key="holder_entity_id", snapshot="holder_end_date", announced="announcement_date", attributes=["holding_ratio"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _history(spark, sf).select("target_company_id", "holder_entity_id", day("valid_from"), day("valid_to"))


def p3_open_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions and open versions per company, with the sum of the ratios that are open."""
    is_open = F.col("valid_to") == F.lit("9999-12-31").cast("date")
    return _history(spark, sf).groupBy("target_company_id").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(is_open).alias("n_open"), F.round(F.sum(F.when(is_open, F.col("holding_ratio").cast("decimal(38,12)"))), 6).cast("double").alias("open_ratio"))


def p3_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The incremental merge: the dimension of each company's lists before 2023 takes the last list before 2024 as a batch of updates."""
    rows = table(spark, sf, "holder_records").select("target_company_id", "holder_entity_id", "holder_end_date", "announcement_date", "holding_ratio")
    past = scd2_history(rows.where("holder_end_date < DATE'2023-01-01'"), group="target_company_id", key="holder_entity_id", snapshot="holder_end_date", announced="announcement_date", attributes=["holding_ratio"])
    year = rows.where("holder_end_date >= DATE'2023-01-01' AND holder_end_date < DATE'2024-01-01'")
    batch = year.groupBy("target_company_id", "holder_entity_id").agg(F.max(F.struct("holder_end_date", "announcement_date", "holding_ratio"))["holding_ratio"].alias("holding_ratio"))
    return scd2_merge(past, batch, keys=["target_company_id", "holder_entity_id"], attributes=["holding_ratio"], as_of="2023-12-31", full_snapshot=False)


def _p3_history(where: str = "TRUE") -> str:
    return f"""
  last AS (
    SELECT target_company_id, holder_end_date, max(announcement_date) AS announcement_date FROM holder_records WHERE {where} GROUP BY 1, 2
  ), cal AS (
    SELECT *, row_number() OVER (PARTITION BY target_company_id ORDER BY holder_end_date) AS i,
           lead(holder_end_date) OVER (PARTITION BY target_company_id ORDER BY holder_end_date) AS nxt FROM last
  ), rows_ AS (
    SELECT DISTINCT r.target_company_id, r.holder_entity_id, r.holder_end_date, r.holding_ratio, c.i, c.nxt
    FROM holder_records r JOIN cal c USING (target_company_id, holder_end_date, announcement_date)
  ), runs AS (
    SELECT *, i - row_number() OVER (PARTITION BY target_company_id, holder_entity_id, holding_ratio ORDER BY i) AS run FROM rows_
  ), history AS (
    SELECT target_company_id, holder_entity_id, holding_ratio, min(holder_end_date) AS valid_from, max(i) AS last_i
    FROM runs GROUP BY target_company_id, holder_entity_id, holding_ratio, run
  ), versions AS (
    SELECT h.target_company_id, h.holder_entity_id, h.holding_ratio, h.valid_from, coalesce(c.nxt, DATE '9999-12-31') AS valid_to
    FROM history h JOIN cal c ON c.target_company_id = h.target_company_id AND c.i = h.last_i
  )"""


P3_SQL = f"WITH {_p3_history()} SELECT target_company_id, holder_entity_id, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to FROM versions"
P3_OPEN_SQL = f"""WITH {_p3_history()}
SELECT target_company_id, count(*) AS n_versions, count(*) FILTER (WHERE valid_to = DATE '9999-12-31') AS n_open,
       CAST(round(sum(CAST(holding_ratio AS DECIMAL(38,12))) FILTER (WHERE valid_to = DATE '9999-12-31'), 6) AS DOUBLE) AS open_ratio
FROM versions GROUP BY 1"""
P3_MERGE_SQL = f"""WITH {_p3_history("holder_end_date < DATE '2023-01-01'")}, batch AS (
  SELECT target_company_id, holder_entity_id, arg_max(holding_ratio, {{'a': holder_end_date, 'b': announcement_date, 'c': holding_ratio}}) AS n
  FROM holder_records WHERE holder_end_date >= DATE '2023-01-01' AND holder_end_date < DATE '2024-01-01' GROUP BY 1, 2
), cur AS (SELECT * FROM versions WHERE valid_to = DATE '9999-12-31')
SELECT target_company_id, holder_entity_id, holding_ratio, valid_from, valid_to FROM versions WHERE valid_to <> DATE '9999-12-31'
UNION ALL
SELECT c.target_company_id, c.holder_entity_id, c.holding_ratio, c.valid_from, CASE WHEN b.n IS NOT NULL AND b.n <> c.holding_ratio THEN DATE '2023-12-31' ELSE c.valid_to END
FROM cur c LEFT JOIN batch b USING (target_company_id, holder_entity_id)
UNION ALL
SELECT b.target_company_id, b.holder_entity_id, b.n, DATE '2023-12-31', DATE '9999-12-31'
FROM batch b LEFT JOIN cur c USING (target_company_id, holder_entity_id) WHERE c.holding_ratio IS NULL OR c.holding_ratio <> b.n"""


def _references(spark: SparkSession, sf: str) -> list[Reference]:
    chunks, documents = table(spark, sf, "chunks"), table(spark, sf, "documents")
    return [
        Reference("research_claims", table(spark, sf, "research_claims"), "claim_id", "chunk_id", "loaded_at", chunks, "chunk_id", "loaded_at"),
        Reference("chunks", chunks, "chunk_id", "doc_id", "loaded_at", documents, "doc_id", "loaded_at", "deleted_at"),
        Reference("event_records", table(spark, sf, "event_records"), "event_id", "source_document_id", "loaded_at", documents, "document_id", "loaded_at", "deleted_at"),
    ]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    first, *rest = [orphan_references(r) for r in _references(spark, sf)]
    for df in rest:
        first = first.unionByName(df)
    return first


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_references(spark, sf))


_P4 = r"""
WITH r AS (
  SELECT 'research_claims' AS source_table, claim_id AS source_key, lower(regexp_replace(chunk_id, '^\s+|\s+$', '', 'g')) AS fk, loaded_at AS used_at FROM research_claims
  UNION ALL SELECT 'chunks', chunk_id, CAST(doc_id AS VARCHAR), loaded_at FROM chunks
  UNION ALL SELECT 'event_records', event_id, lower(regexp_replace(source_document_id, '^\s+|\s+$', '', 'g')), loaded_at FROM event_records
), t AS (
  SELECT DISTINCT 'research_claims' AS source_table, lower(regexp_replace(chunk_id, '^\s+|\s+$', '', 'g')) AS fk, loaded_at AS t_at, CAST(NULL AS TIMESTAMP) AS gone FROM chunks
  UNION ALL SELECT 'chunks', CAST(doc_id AS VARCHAR), loaded_at, deleted_at FROM documents
  UNION ALL SELECT 'event_records', lower(regexp_replace(document_id, '^\s+|\s+$', '', 'g')), loaded_at, deleted_at FROM documents
), j AS (
  SELECT r.*, t.fk AS tk, t.t_at, t.gone FROM r LEFT JOIN t ON r.source_table = t.source_table AND r.fk = t.fk WHERE r.fk IS NOT NULL
), found AS (
  SELECT DISTINCT source_table, source_key, strftime(used_at, '%Y-%m') AS period, 'missing' AS orphan_kind FROM j WHERE tk IS NULL
  UNION SELECT DISTINCT source_table, source_key, strftime(used_at, '%Y-%m'), 'deleted' FROM j WHERE gone IS NOT NULL
  UNION SELECT DISTINCT source_table, source_key, strftime(used_at, '%Y-%m'), 'late' FROM j WHERE t_at > used_at
)
"""
P4_SQL = _P4 + "SELECT * FROM found"
P4_REPORT_SQL = (
    _P4
    + """, totals AS (
  SELECT source_table, period, count(*) AS n_rows FROM (SELECT DISTINCT source_table, source_key, strftime(used_at, '%Y-%m') AS period FROM r) GROUP BY 1, 2
)
SELECT f.source_table, f.period, f.orphan_kind, count(*) AS n_orphans, any_value(n_rows) AS n_rows
FROM found f JOIN totals t USING (source_table, period) GROUP BY 1, 2, 3"""
)

QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage, "p3_found": p3_found, "p3_open_versions": p3_open_versions, "p3_merge": p3_merge, "p4_found": p4_found, "p4_report": p4_report}
SQL = {"p2_found": P2_SQL, "p2_coverage": P2_COVERAGE_SQL, "p3_found": P3_SQL, "p3_open_versions": P3_OPEN_SQL, "p3_merge": P3_MERGE_SQL, "p4_found": P4_SQL, "p4_report": P4_REPORT_SQL}
