"""Queries over holder snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ownership as own
from tessera.session import table

AS_OF, BEFORE = "2023-12-31", "2022-12-31"


def _rows(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    return own.snapshot_rows(table(spark, sf, "holder_records").select(*own.ROW), as_of)


def own_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return own.snapshot_meta(_rows(spark, sf))


def own_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return own.ranked(_rows(spark, sf)).select("record_id", "target_company_id", "holder_rank", "position")


def own_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return own.concentration(_rows(spark, sf))


def own_top_holders(spark: SparkSession, sf: str) -> DataFrame:
    """The three greatest holders per company and whether there are more."""
    n = F.col("n_rows")
    rows = own.ranked(_rows(spark, sf))
    size = rows.groupBy("target_company_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.where("position <= 3").join(size, "target_company_id").select("target_company_id", "position", "holder_name", "holding_ratio", (n > 3).alias("truncated"))


def own_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """The companies that resolved organisations hold."""
    holders = table(spark, sf, "holder_entities").where("entity_type = 'COMPANY' AND identity_quality = 'resolved'")
    return own.holdings_of(_rows(spark, sf), holders).select("holder_entity_id", "target_company_id", "record_id", "holder_rank", "holding_ratio")


def own_changes(spark: SparkSession, sf: str) -> DataFrame:
    return own.compare_snapshots(_rows(spark, sf, BEFORE), _rows(spark, sf, AS_OF))


def own_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of up to three holdings between companies, through confirmed identities."""
    links = own.confirmed_links(table(spark, sf, "entity_links"))
    edges = own.holding_edges(_rows(spark, sf), links)
    sources = links.select(F.col("company_id").alias("node"))
    p = own.holding_paths(edges, sources, 3)
    return p.select("source", "target", "depth", F.array_join("nodes", ">").alias("nodes"), F.round("path_ratio", 12).alias("path_ratio"))


def own_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Typed names of manual entries, resolved as holders."""
    terms = table(spark, sf, "entity_aliases").where("alias_type = 'TYPED_NAME'").select(F.col("alias").alias("term")).distinct()
    return own.resolve_terms(terms, table(spark, sf, "holder_entities"))


def own_names(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "entity_links")
    nodes = links.select(F.col("source_entity_id").alias("node")).union(links.select("canonical_entity_id")).distinct()
    return own.node_names(nodes, table(spark, sf, "listed_company_entities"), table(spark, sf, "holder_entities"))


def own_flags(spark: SparkSession, sf: str) -> DataFrame:
    return own.row_flags(table(spark, sf, "holder_records").dropDuplicates(["record_id"]))


def own_unresolved_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Unresolved ids computed again from typed names."""
    r = table(spark, sf, "holder_records").where(F.col("holder_entity_id").contains("_UNRESOLVED:")).select("holder_category", "holder_name", "target_company_id").distinct()
    return r.select("holder_name", "target_company_id", own.unresolved_id(F.col("holder_category"), F.col("holder_name"), F.col("target_company_id")).alias("computed_id"))


def own_rollup(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "holder_records").dropDuplicates(["record_id"])
    code = F.when(~F.col("holder_entity_id").contains("_UNRESOLVED:"), F.split("holder_entity_id", ":")[1])
    return own.holder_rollup(r.withColumn("compcode", code))


def _eff(as_of: str, tag: str = "") -> str:
    return f"""eff{tag} AS (SELECT target_company_id, holder_end_date, announcement_date FROM (
  SELECT target_company_id, holder_end_date, announcement_date, row_number() OVER (PARTITION BY target_company_id ORDER BY holder_end_date DESC, announcement_date DESC) AS rn
  FROM holder_records WHERE announcement_date <= DATE '{as_of}' AND holder_end_date <= DATE '{as_of}') WHERE rn = 1),
r{tag} AS (SELECT DISTINCT record_id, target_company_id, holder_entity_id, holder_name, holder_category, holding_quantity, holding_ratio, holder_end_date, announcement_date FROM holder_records JOIN eff{tag} USING (target_company_id, holder_end_date, announcement_date))"""


_R = f"WITH {_eff(AS_OF)}"
_RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY target_company_id ORDER BY holding_ratio DESC) AS holder_rank, row_number() OVER (PARTITION BY target_company_id ORDER BY holding_ratio DESC, holder_name, record_id) AS position FROM r)"
_TOP = ", ".join(f"CAST(round(coalesce(sum(CAST(holding_ratio AS DECIMAL(38,12))) FILTER (WHERE {c}), 0), 6) AS DOUBLE) AS {n}" for c, n in [*((f"position <= {k}", f"top{k}") for k in (1, 3, 5, 10)), ("holder_category = 'COMPANY'", "company_sum"), ("holder_category = 'PERSON'", "person_sum")])
_EDGES = """lk AS (SELECT DISTINCT source_entity_id AS holder_entity_id, canonical_entity_id AS company_id FROM entity_links WHERE review_status IN ('auto_confirmed', 'human_confirmed')),
e0 AS (SELECT holder_entity_id AS src, target_company_id AS dst, holding_ratio AS ratio FROM r UNION ALL SELECT company_id, target_company_id, holding_ratio FROM r JOIN lk USING (holder_entity_id)),
e AS (SELECT src, dst, max(ratio) AS ratio FROM e0 WHERE src <> dst GROUP BY 1, 2)"""

SQL = {
    "own_snapshots": _R
    + """, m AS (SELECT target_company_id, holder_end_date, announcement_date, count(*) AS record_count, CAST(round(sum(CAST(holding_ratio AS DECIMAL(38,12))), 6) AS DOUBLE) AS ratio_sum FROM r GROUP BY 1, 2, 3)
SELECT *, CASE WHEN record_count = 10 THEN 'top_ten' WHEN record_count < 10 THEN 'partial' ELSE 'extended_roster' END AS scope,
  concat_ws(',', CASE WHEN record_count < 10 THEN 'snapshot_less_than_ten' END, CASE WHEN record_count > 10 THEN 'snapshot_more_than_ten' END, CASE WHEN ratio_sum > 1 THEN 'snapshot_ratio_sum_over_100' END) AS flags FROM m""",
    "own_ranked": f"{_R}, {_RANKED} SELECT record_id, target_company_id, holder_rank, position FROM rk",
    "own_concentration": f"{_R}, {_RANKED} SELECT target_company_id, {_TOP} FROM rk GROUP BY 1",
    "own_top_holders": f"{_R}, {_RANKED}, n AS (SELECT target_company_id, count(*) AS k FROM r GROUP BY 1) SELECT target_company_id, position, holder_name, holding_ratio, k > 3 AS truncated FROM rk JOIN n USING (target_company_id) WHERE position <= 3",
    "own_reverse": f"{_R}, {_RANKED} SELECT holder_entity_id, target_company_id, record_id, holder_rank, holding_ratio FROM rk WHERE holder_entity_id IN (SELECT holder_entity_id FROM holder_entities WHERE entity_type = 'COMPANY' AND identity_quality = 'resolved')",
    "own_changes": f"""WITH {_eff(BEFORE, "b")}, {_eff(AS_OF, "a")},
b AS (SELECT target_company_id, holder_entity_id, arg_max(holding_ratio, record_id) AS hr, arg_max(holding_quantity, record_id) AS hq FROM rb GROUP BY 1, 2),
a AS (SELECT target_company_id, holder_entity_id, arg_max(holding_ratio, record_id) AS hr, arg_max(holding_quantity, record_id) AS hq FROM ra GROUP BY 1, 2)
SELECT target_company_id, holder_entity_id, CASE WHEN b.hr IS NULL THEN 'entered' WHEN a.hr IS NULL THEN 'exited' WHEN a.hr = b.hr AND coalesce(a.hq - b.hq, 0) = 0 THEN 'unchanged' WHEN a.hr > b.hr OR coalesce(a.hq - b.hq, 0) > 0 THEN 'increased' ELSE 'decreased' END AS change,
  b.hr AS ratio_before, a.hr AS ratio_after, round(a.hr - b.hr, 9) AS ratio_delta FROM b FULL JOIN a USING (target_company_id, holder_entity_id)""",
    "own_paths": f"""{_R}, {_EDGES}, src AS (SELECT DISTINCT company_id AS source FROM lk),
p1 AS (SELECT source, dst AS node, [source, dst] AS nodes, ratio AS path_ratio FROM src JOIN e ON src = source),
p2 AS (SELECT source, dst AS node, list_append(nodes, dst) AS nodes, path_ratio * ratio AS path_ratio FROM p1 JOIN e ON src = node WHERE NOT list_contains(nodes, dst)),
p3 AS (SELECT source, dst AS node, list_append(nodes, dst) AS nodes, path_ratio * ratio AS path_ratio FROM p2 JOIN e ON src = node WHERE NOT list_contains(nodes, dst))
SELECT source, node AS target, depth, array_to_string(nodes, '>') AS nodes, round(path_ratio, 12) AS path_ratio FROM (SELECT *, 1 AS depth FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3)""",
    "own_terms": """WITH t AS (SELECT DISTINCT alias AS term FROM entity_aliases WHERE alias_type = 'TYPED_NAME'),
h AS (SELECT term, count(DISTINCT holder_entity_id) AS n, min(holder_entity_id) AS id FROM t JOIN holder_entities ON name = term GROUP BY 1)
SELECT term, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN id END AS holder_entity_id FROM t LEFT JOIN h USING (term)""",
    "own_names": """WITH n AS (SELECT source_entity_id AS node FROM entity_links UNION SELECT canonical_entity_id FROM entity_links)
SELECT node, coalesce(canonical_name, name, node) AS name FROM n LEFT JOIN listed_company_entities ON company_id = node LEFT JOIN holder_entities ON holder_entity_id = node""",
    "own_flags": """SELECT DISTINCT record_id, concat_ws(',', CASE WHEN contains(holder_entity_id, '_UNRESOLVED:') THEN 'missing_compcode' END, CASE WHEN holding_quantity IS NULL THEN 'missing_quantity' END,
  CASE WHEN report_period IS NULL THEN 'missing_report_period' END, CASE WHEN announcement_date < holder_end_date THEN 'announcement_before_holder_end' END) AS flags FROM holder_records""",
    "own_unresolved_ids": """SELECT DISTINCT holder_name, target_company_id, holder_category || '_UNRESOLVED:' || upper(substr(sha1(holder_name), 1, 12)) || ':' || target_company_id AS computed_id FROM holder_records WHERE contains(holder_entity_id, '_UNRESOLVED:')""",
    "own_rollup": """WITH r AS (SELECT DISTINCT ON (record_id) * FROM holder_records)
SELECT holder_entity_id, arg_min(holder_name, {'a': holder_end_date, 'b': announcement_date, 'c': record_id}) AS name, min(holder_category) AS entity_type,
  max(CASE WHEN NOT contains(holder_entity_id, '_UNRESOLVED:') THEN split_part(holder_entity_id, ':', 2) END) AS compcode, count(*) AS record_count FROM r GROUP BY 1""",
}
QUERIES = {k: globals()[k] for k in SQL}
