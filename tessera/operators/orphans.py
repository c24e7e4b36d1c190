"""References to records that do not exist: missing, deleted or late targets.

The distinct non-null foreign keys (with the earliest moment each is used) meet the parent keys once. Those without a
parent come from a left anti join; those whose parent is withdrawn or loaded after that moment are kept beside them. Only
these suspect keys are joined back to the referring rows, so a key that holds a third of all references is aggregated
map-side first and costs nothing later unless it is suspect itself; then AQE splits its partition.

Defined results: null references are no case; a reference that is deleted and late gives one row of each kind; keys are
compared without outer white space and in lower case; repeated rows count once; a null load time is never late; empty
tables give no rows (no parents: all references are missing).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space stripped around keys; Spark's trim() alone takes blanks only.
_OUTER = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def normal_key(col: Column) -> Column:
    text = col.cast("string")
    odd = F.length(text) != F.length(F.trim(text))
    return F.lower(F.when(odd | text.rlike(_OUTER), F.regexp_replace(text, _OUTER, "")).otherwise(text))


@dataclass(frozen=True)
class Reference:
    """One foreign key: which rows refer, by which column, to which parents."""

    name: str
    rows: DataFrame
    row_key: str
    foreign_key: str
    loaded_at: str
    parents: DataFrame
    parent_key: str
    parent_loaded_at: str | None = None
    parent_deleted_at: str | None = None


def orphan_references(ref: Reference) -> DataFrame:
    """(source_table, source_key, period, orphan_kind), one row per referring key, period and kind."""
    stamp = "timestamp_ntz"
    rows = ref.rows.select(F.col(ref.row_key).cast("string").alias("source_key"), normal_key(F.col(ref.foreign_key)).alias("fk"), F.col(ref.loaded_at).cast(stamp).alias("at")).where("fk IS NOT NULL")
    null = F.lit(None).cast(stamp)
    parents = (
        ref.parents.select(normal_key(F.col(ref.parent_key)).alias("fk"), (F.col(ref.parent_loaded_at).cast(stamp) if ref.parent_loaded_at else null).alias("p_at"), (F.col(ref.parent_deleted_at).cast(stamp) if ref.parent_deleted_at else null).alias("p_gone"))
        .where("fk IS NOT NULL")
        .groupBy("fk")
        .agg(F.min("p_at").alias("p_at"), (F.count("p_gone") == F.count(F.lit(1))).alias("gone"))
    )
    used = rows.groupBy("fk").agg(F.min("at").alias("first_use"))
    missing = used.join(parents.select("fk"), "fk", "left_anti").select("fk", F.lit(True).alias("missing"), F.lit(False).alias("gone"), null.alias("p_at"))
    doubtful = used.join(parents, "fk").where("gone OR p_at > first_use").select("fk", F.lit(False).alias("missing"), "gone", "p_at")
    found = rows.join(missing.unionByName(doubtful), "fk")
    kinds = F.array_compact(F.array(F.when(F.col("missing"), F.lit("missing")), F.when(F.col("gone"), F.lit("deleted")), F.when(F.col("p_at") > F.col("at"), F.lit("late"))))
    return found.select(F.lit(ref.name).alias("source_table"), "source_key", F.date_format("at", "yyyy-MM").alias("period"), F.explode(kinds).alias("orphan_kind")).distinct()


def orphan_report(refs: list[Reference]) -> DataFrame:
    """Counts per table, period and kind beside the rows of that table and period."""
    out = None
    for ref in refs:
        total = ref.rows.select(F.col(ref.row_key).cast("string").alias("k"), F.date_format(F.col(ref.loaded_at).cast("timestamp_ntz"), "yyyy-MM").alias("period")).distinct().groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"))
        counts = orphan_references(ref).groupBy("source_table", "period", "orphan_kind").agg(F.count(F.lit(1)).alias("n_orphans"))
        one = counts.join(total.withColumnRenamed("period", "__p"), F.col("period").eqNullSafe(F.col("__p"))).select("source_table", "period", "orphan_kind", "n_orphans", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
