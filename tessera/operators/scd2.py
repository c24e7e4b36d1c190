"""History of changing entity attributes: a type-two dimension.

``scd2_merge`` applies one batch to a dimension: attribute hashes are compared with the open versions, changed or
vanished rows are closed with an end date, new and changed ones open a version.

``scd2_history`` is the same merge folded over all snapshots of every group in one pass. The open version a snapshot row
meets is the one its key had in the group's previous snapshot, so a window over (group, key) in snapshot order replaces
one join per snapshot; rows to which nothing changed are absorbed, each other row closes one version and opens the next.

Scale: per key the window holds at most one row per snapshot date, since equal dates are reduced to their last announced
list first (partial aggregation), so neither a hot group nor a hot key gathers more rows in a task than there are dates.

Defined results: rows with a null group, key or snapshot date are left out, a null announcement counts as the earliest,
null attributes are equal to each other, repeated rows count once; of two different rows of one key in one announced list
the one with the greater attributes wins; empty input gives an empty history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def attribute_hash(cols: Sequence[str]):
    """Hash over the attributes; a null and an empty string differ."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def effective_lists(records: DataFrame, group: str, snapshot: str, announced: str) -> DataFrame:
    """Of each (group, snapshot) only the rows announced last."""
    floor = F.coalesce(F.col(announced), F.lit("0001-01-01").cast("date"))
    rows = records.where(F.col(group).isNotNull() & F.col(snapshot).isNotNull()).withColumn("__announced", floor)
    last = rows.groupBy(group, snapshot).agg(F.max("__announced").alias("__announced"))
    return rows.join(last, [group, snapshot, "__announced"], "left_semi").drop("__announced")


def scd2_history(records: DataFrame, *, group: str, key: str, snapshot: str, announced: str, attributes: Sequence[str], valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """One row per version: group, key, attributes, valid_from, valid_to (``OPEN_END`` while it is open)."""
    attrs = list(attributes)
    narrow = records.select(group, key, snapshot, announced, *attrs)
    lists = effective_lists(narrow, group, snapshot, announced)
    # The snapshot calendar of a group: one row per date, so it is as small as the calendar.
    dates = lists.select(group, snapshot).distinct()
    by_date = Window.partitionBy(group).orderBy(snapshot)
    calendar = dates.select(group, snapshot, F.lag(snapshot).over(by_date).alias("__before"), F.lead(snapshot).over(by_date).alias("__after"))
    rows = lists.where(F.col(key).isNotNull()).groupBy(group, key, snapshot).agg(F.max(F.struct(*attrs)).alias("__a")).select(group, key, snapshot, *[F.col(f"__a.{a}").alias(a) for a in attrs])
    rows = rows.join(calendar, [group, snapshot]).withColumn("__hash", attribute_hash(attrs))
    by_key = Window.partitionBy(group, key).orderBy(snapshot)
    current, seen = F.lag("__hash").over(by_key), F.lag(snapshot).over(by_key)
    # equal hashes are only likely to mean equal attributes
    equal = F.lag(F.struct(*attrs)).over(by_key).eqNullSafe(F.struct(*attrs))
    unchanged = F.coalesce((seen == F.col("__before")) & (current == F.col("__hash")) & equal, F.lit(False))
    opened = rows.withColumn("__opens", ~unchanged).withColumn("__version", F.sum(F.col("__opens").cast("int")).over(by_key))
    return (
        opened.groupBy(group, key, "__version")
        .agg(F.min(snapshot).alias(valid_from), F.max(F.struct(snapshot, "__after")).alias("__last"), *[F.first(a).alias(a) for a in attrs])
        .select(group, key, *attrs, valid_from, F.coalesce(F.col("__last.__after"), F.lit(OPEN_END).cast("date")).alias(valid_to))
    )


def scd2_merge(dimension: DataFrame, batch: DataFrame, *, keys: Sequence[str], attributes: Sequence[str], as_of: str, full_snapshot: bool = True, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """The dimension after a batch taken at ``as_of`` (yyyy-MM-dd).

    ``full_snapshot``: keys that the batch lacks are closed too; else they stay open (a batch of updates). Rows of the
    batch with a null key are left out; of repeated keys the greatest attributes win. Closed versions pass untouched.
    """
    keys, attrs = list(keys), list(attributes)
    open_end = F.lit(OPEN_END).cast("date")
    day = F.lit(as_of).cast("date")
    is_open = F.col(valid_to) == open_end
    closed, current = dimension.where(~is_open), dimension.where(is_open)
    present = batch
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    fresh = present.groupBy(*keys).agg(F.max(F.struct(*attrs)).alias("__a")).select(*keys, *[F.col(f"__a.{a}").alias(f"__n_{a}") for a in attrs], F.lit(True).alias("__in"))
    fresh = fresh.withColumn("__new", attribute_hash([f"__n_{a}" for a in attrs]))
    both = current.withColumn("__old", attribute_hash(attrs)).withColumn("__had", F.lit(True)).join(fresh, keys, "full_outer")
    had, came = F.col("__had").isNotNull(), F.col("__in").isNotNull()
    equal = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"__n_{a}")) for a in attrs], F.lit(True))  # hashes may collide
    same = had & came & (F.col("__old") == F.col("__new")) & equal
    ends = had & ~F.coalesce(same, F.lit(False)) & (came | F.lit(full_snapshot))
    begins = came & ~F.coalesce(same, F.lit(False))
    old = F.when(had, F.struct(*[F.col(a).alias(a) for a in attrs], F.col(valid_from).alias(valid_from), F.when(ends, day).otherwise(F.col(valid_to)).alias(valid_to)))
    new = F.when(begins, F.struct(*[F.col(f"__n_{a}").alias(a) for a in attrs], day.alias(valid_from), open_end.alias(valid_to)))
    merged = both.select(*keys, F.explode(F.filter(F.array(old, new), lambda x: x.isNotNull())).alias("v")).select(*keys, "v.*")
    return closed.select(*keys, *attrs, valid_from, valid_to).unionByName(merged.select(*keys, *attrs, valid_from, valid_to))
