"""Run and evaluation logs: order, status, completeness, sessions, upserts and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the row that is last by the order, as an upsert that replaces leaves it."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the row that is first, as an upsert that ignores leaves it."""
    w = Window.partitionBy(*keys).orderBy(*[c.asc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be between 1 and 200, offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def batch_status(cases: DataFrame) -> DataFrame:
    """Counts by status and the status of a batch: completed, running, failed, partial or pending."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    c = cases.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_cases"), *[n(s) for s in ("completed", "failed", "pending", "running")])
    status = F.when(F.col("n_completed") == F.col("n_cases"), "completed").when((F.col("n_pending") + F.col("n_running") > 0) & (F.col("n_completed") + F.col("n_failed") > 0), "running").when(F.col("n_failed") == F.col("n_cases"), "failed").when(F.col("n_completed") + F.col("n_failed") == F.col("n_cases"), "partial").otherwise("pending")
    return c.withColumn("status", status)


def prior_turns_done(turns: DataFrame, session: str, turn: str, status: str) -> DataFrame:
    """Each turn with ``ready``: no earlier turn of its session is open."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.sum((F.col(status) != "completed").cast("int")).over(w), F.lit(0))
    return turns.withColumn("ready", open_before == 0)


def turns_contiguous(turns: DataFrame, session: str, turn: str) -> DataFrame:
    """(session, n_turns, contiguous): turns are 1..n without gaps or repeats."""
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("n_turns"), ((F.min(turn) == 1) & (F.max(turn) == F.count(F.lit(1))) & (F.count_distinct(turn) == F.count(F.lit(1)))).alias("contiguous"))


def recent_turns(turns: DataFrame, session: str, turn: str, n: int = 8) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.col(turn).desc())
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def session_summary(turns: DataFrame, session: str, turn: str, text: str, at: str) -> DataFrame:
    """First question, first and last time and turns per session."""
    return turns.groupBy(session).agg(F.min_by(text, turn).alias("title"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count(F.lit(1)).alias("n_turns"))


def session_messages(turns: DataFrame, session: str, turn: str, question: str, answer: str) -> DataFrame:
    """Two messages a turn, in order."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("text")), F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("text")))
    return turns.select(session, turn, F.posexplode(pair).alias("k", "m")).select(session, (F.col(turn) * 2 + F.col("k") - 1).alias("position"), "m.role", "m.text")


def carry_forward(turns: DataFrame, session: str, turn: str, *columns: str) -> DataFrame:
    """State across turns: the last known value of each column up to a turn."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"known_{c}") for c in columns])


def merge_logs(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer merge of two logs by key; of a field the first side that has something counts."""
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    y = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return x.join(y, key, "full_outer").select(key, *[F.coalesce(filled(f"a_{c}"), filled(f"b_{c}")).alias(c) for c in columns])


def nested_runs(runs: DataFrame, children: DataFrame, key: str, order: str, fields: Sequence[str], name: str = "children") -> DataFrame:
    """Runs with their child rows as one ordered array (a run's children are bounded by its own steps)."""
    packed = children.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__order"), *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
    return runs.join(packed, key, "left")


def unpack_children(runs: DataFrame, key: str, array: str) -> DataFrame:
    """Child rows of a nested array, numbered from 1."""
    return runs.select(key, F.posexplode(array).alias("n", "item")).select(key, (F.col("n") + 1).alias("sequence"), "item.*")


def same_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, n_before, n_after, ok) of two (table_name, n) frames: no table may lose rows in a merge."""
    j = before.withColumnRenamed("n", "n_before").join(after.withColumnRenamed("n", "n_after"), "table_name", "full_outer")
    return j.select("table_name", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), (F.coalesce("n_after", F.lit(0)) >= F.coalesce("n_before", F.lit(0))).alias("ok"))
