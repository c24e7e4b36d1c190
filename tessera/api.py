"""The ten public operations over a folder of tables: arguments are checked on the driver, results are DataFrames.

Every operation takes ``knowledge_cutoff`` (yyyy-MM-dd): nothing announced later is seen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.operators import financial as fin
from tessera.operators import ownership as own
from tessera.operators import research as res
from tessera.operators import retrieval as ret
from tessera.session import table

CLAIM_TYPES = ("investment_rating", "earnings_forecast", "risk_opinion", "analyst_judgment", "cited_fact")


class ArgumentError(ValueError):
    """An argument that no operation accepts."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ArgumentError(message)


def _codes(name: str, values: Sequence[str] | None, least: int = 1, most: int | None = None) -> list[str]:
    out = [str(v).strip().upper() for v in values or []]
    _need(len(out) >= least, f"{name}: at least {least}")
    _need(most is None or len(out) <= most, f"{name}: at most {most}")
    _need(all(out), f"{name}: blank value")
    _need(len(set(out)) == len(out), f"{name}: repeated value")
    return out


def _day(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    try:
        return dt.date.fromisoformat(str(value)).isoformat()
    except ValueError:
        raise ArgumentError(f"{name}: no date of the form yyyy-MM-dd") from None


def _days(name: str, values: Sequence[str] | None) -> list[str]:
    _need(bool(values), f"{name}: at least 1")
    out = [_day(name, v) for v in values]
    _need(len(set(out)) == len(out), f"{name}: repeated value")
    return sorted(out)


def _between(name: str, value: int, low: int, high: int) -> int:
    _need(low <= value <= high, f"{name}: between {low} and {high}")
    return value


def _kind(day: str) -> str:
    return {"03-31": "Q1", "06-30": "H1", "09-30": "Q3_YTD", "12-31": "FY"}.get(day[5:], "NON_STANDARD")


def unknown_values(rows: DataFrame, column: str, wanted: Sequence[str]) -> list[str]:
    """The wanted values that the column doesn't have; only matches are collected."""
    have = {r[0] for r in rows.where(F.col(column).isin(list(wanted))).select(column).distinct().collect()}
    return [w for w in wanted if w not in have]


class Engine:
    """Operations over ``path``, a folder with one Parquet table per name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    # --- figures

    def _figures(self, companies: list[str], cutoff: str | None, currency: str = "CNY") -> DataFrame:
        return fin.current_figures(self._t("financial_metrics").where(F.col("company_id").isin(companies)), cutoff=_day("knowledge_cutoff", cutoff), currency=currency)

    def metric_query(self, company_ids: Sequence[str], metric_codes: Sequence[str], report_periods: Sequence[str], *, currency: str = "CNY", knowledge_cutoff: str | None = None) -> DataFrame:
        """Asked combinations with value, evidence_id and whether they are missing."""
        companies, metrics, periods = _codes("company_ids", company_ids), _codes("metric_codes", metric_codes), _days("report_periods", report_periods)
        _need(set(metrics) <= set(fin.METRIC_CODES), "metric_codes: unknown metric")
        figures = self._figures(companies, knowledge_cutoff, currency)
        wanted = fin.requested(self.spark.createDataFrame([(c,) for c in companies], "company_id string"), periods, metrics)
        return wanted.join(figures, ["company_id", "report_period", "metric_code"], "left").withColumn("missing", F.col("evidence_id").isNull())

    def metric_compare(self, company_ids: Sequence[str], metric_code: str, report_periods: Sequence[str], *, knowledge_cutoff: str | None = None) -> DataFrame:
        """One company over two periods or more, or several companies at one period."""
        companies, periods = _codes("company_ids", company_ids), _days("report_periods", report_periods)
        metric = _codes("metric_code", [metric_code])[0]
        _need(metric in fin.METRIC_CODES, "metric_code: unknown metric")
        _need((len(companies) == 1) != (len(periods) == 1), "either one company and several periods or several companies and one period")
        nature = next(m[4] for m in fin.METRICS if m[0] == metric)
        _need(nature == "instant" or len({_kind(p) for p in periods}) == 1, "report_periods: figures of the year to date need periods of one type")
        figures = self._figures(companies, knowledge_cutoff)
        return fin.compare_periods(figures, metric, periods) if len(companies) == 1 else fin.compare_companies(figures, metric, periods[0])

    def risk_scan(self, company_id: str, report_periods: Sequence[str], *, rule_ids: Sequence[str] | None = None, knowledge_cutoff: str | None = None) -> DataFrame:
        """Rules of one company over periods of one type, rolled up."""
        company, periods = _codes("company_id", [company_id]), _days("report_periods", report_periods)
        _need(len({_kind(p) for p in periods}) == 1, "report_periods: one period type")
        figures = self._figures(company, knowledge_cutoff)
        out = fin.risk_rollup(fin.risk_observations(figures, periods)).unionByName(
            fin.negative_runs(figures, "OPERATING_CASHFLOW", periods).select("company_id", F.lit("NEGATIVE_OPERATING_CASHFLOW_PERSISTENCE").alias("rule_id"), "status", F.col("known_periods").alias("n_observations"), F.col("longest_negative_run").alias("n_triggered"), F.col("longest_negative_run").alias("max_consecutive"), F.when(F.col("status") == "triggered", F.when(F.col("longest_negative_run") >= 3, "high").otherwise("medium")).alias("severity"))
        )
        return out if rule_ids is None else out.where(F.col("rule_id").isin(_codes("rule_ids", rule_ids)))

    def comparable_periods(self, company_id: str, target: str) -> DataFrame:
        t = self.spark.createDataFrame([(_codes("company_id", [company_id])[0],)], "company_id string").withColumn("target", F.lit(_day("target", target)).cast("date"))
        return fin.comparable_periods(self._t("financial_metrics"), t)

    # --- holders

    def holding_query(self, *, company_ids: Sequence[str] | None = None, holder_ids: Sequence[str] | None = None, as_of_date: str | None = None, holder_types: Sequence[str] | None = None, top_n: int = 10, knowledge_cutoff: str | None = None) -> DataFrame:
        """Holders of companies or companies of holders; ranks come from whole snapshots, filters and ``top_n`` after them."""
        _need(bool(company_ids) or bool(holder_ids), "company_ids or holder_ids: one is needed")
        _between("top_n", top_n, 1, 50)
        r = self._t("holder_records").select(*own.ROW)
        if company_ids:
            r = r.where(F.col("target_company_id").isin(_codes("company_ids", company_ids)))
        as_of = _day("as_of_date", as_of_date) or "9999-12-31"
        rows = own.snapshot_rows(r, as_of, _day("knowledge_cutoff", knowledge_cutoff))
        out = own.ranked(rows)
        if holder_ids:
            wanted = self.spark.createDataFrame([(h,) for h in holder_ids], "holder_entity_id string")
            out = own.holdings_of(rows, wanted)
        if holder_types:
            kinds = _codes("holder_types", holder_types)
            _need(set(kinds) <= {"PERSON", "COMPANY"}, "holder_types: PERSON or COMPANY")
            out = out.where(F.col("holder_category").isin(kinds))
        return out if holder_ids else out.where(F.col("position") <= top_n)

    def holding_compare(self, company_id: str, start_date: str, end_date: str, *, holder_ids: Sequence[str] | None = None, change_threshold: float = 0.0, knowledge_cutoff: str | None = None) -> DataFrame:
        a, b = _day("start_date", start_date), _day("end_date", end_date)
        _need(a < b, "start_date: before end_date")
        _need(0 <= change_threshold <= 100, "change_threshold: between 0 and 100")
        r = self._t("holder_records").select(*own.ROW).where(F.col("target_company_id").isin(_codes("company_id", [company_id])))
        if holder_ids:
            r = r.where(F.col("holder_entity_id").isin(list(holder_ids)))
        cutoff = _day("knowledge_cutoff", knowledge_cutoff)
        return own.compare_snapshots(own.snapshot_rows(r, a, cutoff), own.snapshot_rows(r, b, cutoff), change_threshold)

    def penetration(self, source_entity_id: str, target_entity_id: str, as_of_date: str, *, max_depth: int = 4, max_paths: int = 10, knowledge_cutoff: str | None = None) -> DataFrame:
        """Paths from source to target by depth and ratio."""
        _need(source_entity_id != target_entity_id, "source and target are one")
        _between("max_depth", max_depth, 1, 6)
        _between("max_paths", max_paths, 1, 50)
        rows = own.snapshot_rows(self._t("holder_records").select(*own.ROW), _day("as_of_date", as_of_date), _day("knowledge_cutoff", knowledge_cutoff))
        edges = own.holding_edges(rows, own.confirmed_links(self._t("entity_links")))
        paths = own.holding_paths(edges, self.spark.createDataFrame([(source_entity_id,)], "node string"), max_depth)
        return paths.where(F.col("target") == target_entity_id).orderBy("depth", F.col("path_ratio").desc(), F.array_join("nodes", ">")).limit(max_paths)

    # --- events

    def _events(self, entity_id: str, kw: dict) -> DataFrame:
        types = kw.get("event_types")
        if types:
            _need(set(types) <= {t for t, _ in ev.EVENT_TYPES}, "event_types: unknown type")
        a, b = _day("start_date", kw.get("start_date")), _day("end_date", kw.get("end_date"))
        _need(a is None or b is None or a <= b, "start_date: not after end_date")
        e = self._t("event_records").dropDuplicates(["event_id"]).withColumn("reference_ids", F.from_json("reference_ids_json", "array<string>"))
        return ev.query_events(e, company_ids=_codes("entity_id", [entity_id]), start=a, end=b, types=types, keywords=kw.get("keywords"), cutoff=_day("knowledge_cutoff", kw.get("knowledge_cutoff")))

    def event_query(self, entity_id: str, *, limit: int = 100, **filters) -> DataFrame:
        """filters: event_types, start_date, end_date, keywords, knowledge_cutoff."""
        return ev.timeline(self._events(entity_id, filters), _between("limit", limit, 1, 500))

    def event_cluster(self, entity_id: str, *, window_days: int = 30, **filters) -> DataFrame:
        """Events with their cluster; clusters are formed before any limit."""
        e = self._events(entity_id, filters)
        return e.join(ev.cluster_events(e, _between("window_days", window_days, 1, 365)), "event_id")

    def event_relations(self, entity_id: str, **filters) -> DataFrame:
        return ev.relations(self._events(entity_id, filters))

    # --- documents

    def search(self, query: str, *, query_vector: Sequence[float] | None = None, mode: str = "bm25", company_id: str | None = None, document_types: Sequence[str] | None = None, start_date: str | None = None, end_date: str | None = None, top_k: int = 8, pool_k: int | None = None, max_per_document: int = 3, knowledge_cutoff: str | None = None) -> DataFrame:
        """Chunks for a query by ``bm25``, ``vector`` or ``hybrid``; statistics over all chunks, filters before ranking.

        vector and hybrid need ``query_vector`` and a table ``chunk_vectors`` (chunk_id, embedding).
        """
        _need(bool(query.strip()), "query: blank")
        _need(mode in ("bm25", "vector", "hybrid"), "mode: bm25, vector or hybrid")
        _between("top_k", top_k, 1, 20)
        pool = _between("pool_k", pool_k or max(5 * top_k, 50), top_k, 500)
        docs = self._t("documents").select("doc_id", "company_id", "document_type", "published_date", "title")
        if document_types:
            missing = unknown_values(docs, "document_type", document_types)
            _need(not missing, f"document_types: unknown {missing}")
            docs = docs.where(F.col("document_type").isin(list(document_types)))
        if company_id:
            docs = docs.where(F.col("company_id") == _codes("company_id", [company_id])[0])
        if start_date:
            docs = docs.where(F.col("published_date") >= F.lit(_day("start_date", start_date)).cast("date"))
        end = min((d for d in (_day("end_date", end_date), _day("knowledge_cutoff", knowledge_cutoff)) if d), default=None)
        if end:
            docs = docs.where(F.col("published_date") <= F.lit(end).cast("date"))
        chunks = self._t("chunks").select("chunk_id", "doc_id", "section_title", "text").dropDuplicates(["chunk_id"])
        allowed = chunks.join(docs, "doc_id").select("chunk_id", "doc_id", "title", "section_title")
        ranked = []
        if mode != "vector":
            scores = ret.bm25_scores(chunks, self.spark.createDataFrame([(0, query)], "query_id long, query string"))
            ranked.append(ret.top_k(scores.join(allowed.select("chunk_id"), "chunk_id", "left_semi"), pool))
        if mode != "bm25":
            _need(query_vector is not None, "query_vector: needed for this mode")
            q = self.spark.createDataFrame([(0, [float(x) for x in query_vector])], "query_id long, query_vector array<double>")
            v = self._t("chunk_vectors").join(allowed.select("chunk_id"), "chunk_id", "left_semi")
            ranked.append(ret.vector_scores(v, q, pool, id_col="chunk_id"))
        hits = ranked[0] if len(ranked) == 1 else ret.rrf_merge(*ranked)
        best = ret.cap_per_document(hits.select("query_id", "chunk_id", "score").join(allowed, "chunk_id"), max_per_document, top_k)
        return best.join(chunks.select("chunk_id", "text"), "chunk_id").select("rank", "chunk_id", "doc_id", "title", "section_title", "text", "score").orderBy("rank")

    # --- research

    def view_query(self, company_ids: Sequence[str], *, claim_types: Sequence[str] | None = None, institutions: Sequence[str] | None = None, topics: Sequence[str] | None = None, start_date: str | None = None, end_date: str | None = None, limit: int = 20, knowledge_cutoff: str | None = None) -> DataFrame:
        if claim_types:
            _need(set(claim_types) <= set(CLAIM_TYPES), "claim_types: unknown type")
        q = res.query_claims(self._t("research_claims").dropDuplicates(["claim_id"]), company_ids=_codes("company_ids", company_ids, 1, 10), start=_day("start_date", start_date), end=_day("end_date", end_date), institutions=institutions, types=claim_types, topics=topics, cutoff=_day("knowledge_cutoff", knowledge_cutoff))
        return q.orderBy(F.col("publish_date").desc(), "claim_id").limit(_between("limit", limit, 1, 200))
