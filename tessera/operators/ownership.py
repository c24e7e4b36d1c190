"""Holder snapshots: point-in-time selection, ranking, concentration, comparison, paths and the record builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hash_id, short_sha1
from tessera.session import materialize

ROW = ["record_id", "target_company_id", "holder_entity_id", "holder_name", "holder_category", "holding_quantity", "holding_ratio", "holder_end_date", "announcement_date"]


def effective_snapshots(records: DataFrame, as_of: str, cutoff: str | None = None) -> DataFrame:
    """(target_company_id, holder_end_date, announcement_date): per company the latest list date known at the bound, and its
    latest announcement. Visibility is filtered before anything is ranked; one aggregation decides both."""
    bound = F.lit(cutoff or as_of).cast("date")
    seen = records.where((F.col("announcement_date") <= bound) & (F.col("holder_end_date") <= F.lit(as_of).cast("date")))
    return seen.groupBy("target_company_id").agg(F.max(F.struct("holder_end_date", "announcement_date")).alias("s")).select("target_company_id", "s.holder_end_date", "s.announcement_date")


def snapshot_rows(records: DataFrame, as_of: str, cutoff: str | None = None) -> DataFrame:
    """Rows of the effective snapshots; repeated rows once."""
    return records.join(effective_snapshots(records, as_of, cutoff), ["target_company_id", "holder_end_date", "announcement_date"], "left_semi").dropDuplicates(["record_id"])


def snapshot_meta(rows: DataFrame) -> DataFrame:
    """Per snapshot: rows, sum of ratios, scope and flags."""
    m = rows.groupBy("target_company_id", "holder_end_date", "announcement_date").agg(F.count(F.lit(1)).alias("record_count"), F.round(F.sum(F.col("holding_ratio").cast("decimal(38,12)")), 6).cast("double").alias("ratio_sum"))
    n = F.col("record_count")
    flags = F.array_compact(F.array(F.when(n < 10, F.lit("snapshot_less_than_ten")), F.when(n > 10, F.lit("snapshot_more_than_ten")), F.when(F.col("ratio_sum") > 1, F.lit("snapshot_ratio_sum_over_100"))))
    return m.select("*", F.when(n == 10, "top_ten").when(n < 10, "partial").otherwise("extended_roster").alias("scope"), F.array_join(flags, ",").alias("flags"))


def ranked(rows: DataFrame) -> DataFrame:
    """Competition rank by ratio and row order by (ratio, name, id) within each company's snapshot."""
    by = Window.partitionBy("target_company_id")
    return rows.select("*", F.rank().over(by.orderBy(F.col("holding_ratio").desc())).cast("bigint").alias("holder_rank"), F.row_number().over(by.orderBy(F.col("holding_ratio").desc(), "holder_name", "record_id")).cast("bigint").alias("position"))


def concentration(rows: DataFrame) -> DataFrame:
    """Sums of the greatest 1, 3, 5 and 10 ratios and by category, over whole snapshots."""
    r = ranked(rows)
    ratio = F.col("holding_ratio").cast("decimal(38,12)")
    total = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, ratio)), F.lit(0)), 6).cast("double")
    return r.groupBy("target_company_id").agg(*[total(F.col("position") <= k).alias(f"top{k}") for k in (1, 3, 5, 10)], total(F.col("holder_category") == "COMPANY").alias("company_sum"), total(F.col("holder_category") == "PERSON").alias("person_sum"))


def holdings_of(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """Reverse direction: the companies given holders (holder_entity_id) stand in, with ranks from the whole snapshots.

    The semi-join that keeps only companies with such a holder runs before the window, so the window sees few rows.
    """
    wanted = holders.select("holder_entity_id").distinct()
    companies = rows.join(wanted, "holder_entity_id", "left_semi").select("target_company_id").distinct()
    return ranked(rows.join(companies, "target_company_id", "left_semi")).join(wanted, "holder_entity_id", "left_semi")


def compare_snapshots(before: DataFrame, after: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(target_company_id, holder_entity_id, change, ratio_before, ratio_after, ratio_delta): entered, exited, increased,
    decreased or unchanged. A repeated holder counts by its last record; a missing quantity leaves the ratio to decide.
    ``threshold``: changes of a smaller ratio (in points of percent) are below_threshold."""
    def one(rows: DataFrame, tag: str) -> DataFrame:
        return rows.groupBy("target_company_id", "holder_entity_id").agg(F.max_by(F.struct("holding_ratio", "holding_quantity"), "record_id").alias(tag))

    both = one(before, "b").join(one(after, "a"), ["target_company_id", "holder_entity_id"], "full_outer")
    dr = F.col("a.holding_ratio") - F.col("b.holding_ratio")
    dq = F.coalesce(F.col("a.holding_quantity") - F.col("b.holding_quantity"), F.lit(0))
    change = (
        F.when(F.col("b").isNull(), "entered")
        .when(F.col("a").isNull(), "exited")
        .when((dr == 0) & (dq == 0), "unchanged")
        .when(F.abs(dr) * 100 < F.lit(threshold), "below_threshold")
        .when((dr > 0) | (dq > 0), "increased")
        .otherwise("decreased")
    )
    return both.select("target_company_id", "holder_entity_id", change.alias("change"), F.col("b.holding_ratio").alias("ratio_before"), F.col("a.holding_ratio").alias("ratio_after"), F.round(dr, 9).alias("ratio_delta"))


def holding_edges(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, ratio, record_id): holdings as edges; a holder linked with a company (holder_entity_id, company_id) is that
    company as a source, whether it is asked for as one or as the other."""
    own = rows.select(F.col("holder_entity_id").alias("src"), F.col("target_company_id").alias("dst"), F.col("holding_ratio").alias("ratio"), "record_id")
    bridged = rows.join(links, "holder_entity_id").select(F.col("company_id").alias("src"), F.col("target_company_id").alias("dst"), F.col("holding_ratio").alias("ratio"), "record_id")
    return own.unionByName(bridged).where("src <> dst").groupBy("src", "dst").agg(F.max("ratio").alias("ratio"), F.max_by("record_id", "ratio").alias("record_id"))


def holding_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 4) -> DataFrame:
    """(source, target, depth, nodes, path_ratio, record_ids): simple paths of up to ``max_depth`` holdings from each source.

    A loop of joins, one per level; levels are written out so that each level's plan starts from rows. Only edges whose
    target is itself a source go on, which a semi-join decides before the next level.
    """
    if not 1 <= max_depth <= 6:
        raise ValueError("max_depth must be between 1 and 6")
    level = sources.select(F.col("node").alias("source")).distinct().join(edges.withColumnRenamed("src", "source"), "source").select("source", F.col("dst").alias("node"), F.array("source", "dst").alias("nodes"), F.col("ratio").alias("path_ratio"), F.array("record_id").alias("record_ids"))
    heads = edges.select(F.col("src").alias("node")).distinct()
    levels = []
    for depth in range(1, max_depth + 1):
        if depth > 1:
            go_on = levels[-1].join(heads, "node", "left_semi")
            level = (
                go_on.join(edges.withColumnRenamed("src", "node"), "node")
                .where(~F.array_contains("nodes", F.col("dst")))
                .select("source", F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), (F.col("path_ratio") * F.col("ratio")).alias("path_ratio"), F.array_append("record_ids", F.col("record_id")).alias("record_ids"))
            )
        levels.append(materialize(level))
    out = None
    for depth, rows in enumerate(levels, 1):
        one = rows.select("source", F.col("node").alias("target"), F.lit(depth).alias("depth"), "nodes", "path_ratio", "record_ids")
        out = one if out is None else out.unionByName(one)
    return out


def resolve_terms(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(term, status, n, holder_entity_id): exact name first, then id where the term has a colon; resolved, ambiguous or
    not_found."""
    by_name = terms.join(entities.select(F.col("name").alias("term"), "holder_entity_id"), "term")
    by_id = terms.where(F.col("term").contains(":")).join(entities.select(F.col("holder_entity_id").alias("term")), "term").select("term", F.col("term").alias("holder_entity_id"))
    hits = by_name.unionByName(by_id.join(by_name.select("term").distinct(), "term", "left_anti")).groupBy("term").agg(F.count_distinct("holder_entity_id").alias("n"), F.min("holder_entity_id").alias("holder_entity_id"))
    n = F.coalesce("n", F.lit(0))
    return terms.distinct().join(hits, "term", "left").select("term", F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), n.alias("n"), F.when(n == 1, F.col("holder_entity_id")).alias("holder_entity_id"))


def node_names(nodes: DataFrame, companies: DataFrame, entities: DataFrame) -> DataFrame:
    """(node, name): a company's name, else a holder's, else the node itself."""
    return nodes.join(companies.select(F.col("company_id").alias("node"), "canonical_name"), "node", "left").join(entities.select(F.col("holder_entity_id").alias("node"), F.col("name").alias("holder_name")), "node", "left").select("node", F.coalesce("canonical_name", "holder_name", "node").alias("name"))


def confirmed_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("review_status").isin("auto_confirmed", "human_confirmed")).select(F.col("source_entity_id").alias("holder_entity_id"), F.col("canonical_entity_id").alias("company_id")).distinct()


# --- builder ------------------------------------------------------------------------------------------------------

def parse_shareholders(raw: DataFrame) -> DataFrame:
    """Raw shareholder rows (all text) with record columns, ``skip_reason`` where a row can't be taken, and quality flags."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    announced, end = F.try_to_date(text("ann_dt"), "yyyy-MM-dd"), F.try_to_date(text("s_holder_enddate"), "yyyy-MM-dd")
    pct = F.col("s_holder_pct").cast("string").try_cast("double")
    reason = (
        F.when(text("s_info_windcode").isNull(), "missing_target_company")
        .when(announced.isNull(), "invalid_announcement_date")
        .when(end.isNull(), "invalid_holder_end_date")
        .when(text("s_holder_name").isNull(), "missing_holder_name")
        .when(pct.isNull() | F.isnan(pct) | (pct <= 0) | (pct > 100), "invalid_holding_ratio")
    )
    category = F.when(text("s_holder_holdercategory") == "1", "PERSON").otherwise("COMPANY")
    quantity = F.col("s_holder_quantity").cast("string").try_cast("double").cast("bigint")
    comp, name, company = text("s_info_compcode"), text("s_holder_name"), text("s_info_windcode")
    holder = F.when(comp.isNotNull(), F.concat(category, F.lit(":"), comp)).otherwise(unresolved_id(category, name, company))
    flags = F.array_compact(
        F.array(
            F.when(~F.coalesce(text("s_holder_holdercategory").isin("1", "2"), F.lit(False)), F.lit("missing_holder_category")),
            F.when(comp.isNull(), F.lit("missing_compcode")),
            F.when(quantity.isNull(), F.lit("missing_quantity")),
            F.when(text("report_period").isNull(), F.lit("missing_report_period")),
            F.when(announced < end, F.lit("announcement_before_holder_end")),
        )
    )
    parts = [company, text("ann_dt"), text("s_holder_enddate"), name, text("s_holder_sharecategory"), quantity, pct, comp]
    return raw.select(
        reason.alias("skip_reason"), hash_id("REC-OWN-", 24, *parts).alias("record_id"), company.alias("target_company_id"), announced.alias("announcement_date"), end.alias("holder_end_date"), F.try_to_date(text("report_period"), "yyyy-MM-dd").alias("report_period"),
        holder.alias("holder_entity_id"), name.alias("holder_name"), text("s_holder_aname").alias("holder_aname"), category.alias("holder_category"), quantity.alias("holding_quantity"), (pct / 100).alias("holding_ratio"), pct.alias("holding_ratio_raw"),
        comp.alias("compcode"), F.to_json(flags).alias("quality_flags_json"), hash_id("EVID-OWN-", 24, *parts).alias("evidence_id"),
    )


def build_holder_records(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, entities, skipped): records once per content hash, entities rolled up, skipped rows counted by reason."""
    parsed = parse_shareholders(raw)
    good = parsed.where("skip_reason IS NULL").drop("skip_reason")
    records = good.drop("compcode").dropDuplicates(["record_id"])
    return records, holder_rollup(good), parsed.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def unresolved_id(category: Column, name: Column, company: Column) -> Column:
    return F.concat(category, F.lit("_UNRESOLVED:"), short_sha1(name), F.lit(":"), company)


def holder_rollup(rows: DataFrame) -> DataFrame:
    """One row per holder: the name met first (by date and record), rows, and the last code that is known."""
    order = F.struct("holder_end_date", "announcement_date", "record_id")
    return rows.groupBy("holder_entity_id").agg(F.min_by("holder_name", order).alias("name"), F.min("holder_category").alias("entity_type"), F.max_by("compcode", F.when(F.col("compcode").isNotNull(), order)).alias("compcode"), F.count(F.lit(1)).alias("record_count"))


def row_flags(records: DataFrame) -> DataFrame:
    """(record_id, flags) recomputed from the record's own columns."""
    flags = F.array_compact(F.array(F.when(F.col("holder_entity_id").contains("_UNRESOLVED:"), F.lit("missing_compcode")), F.when(F.col("holding_quantity").isNull(), F.lit("missing_quantity")), F.when(F.col("report_period").isNull(), F.lit("missing_report_period")), F.when(F.col("announcement_date") < F.col("holder_end_date"), F.lit("announcement_before_holder_end"))))
    return records.select("record_id", F.array_join(flags, ",").alias("flags"))
