"""Attributes as known at event time.

Each request (an entity key, optionally a period, and a knowledge cutoff) gets the attribute row that was known at the
cutoff. Requests and facts are hash-partitioned by entity into buckets; each bucket runs an embedded DuckDB
``ASOF LEFT JOIN`` against versions ordered by availability.

The number of buckets follows from the counted rows: a bucket has some ``rows_per_bucket`` of them, and DuckDB runs within
``MEMORY`` without spilling. What can't be split is one entity, which has at most one version per period and day.

Ties are resolved before the join: among rows of one (entity, period, available-on) the greatest row id wins, so the
join sees one version per instant. This aggregation also runs map-side, which bounds a hot entity to one row per period
and day whatever its share of the input; equal requests are collapsed in the same way and joined back afterwards.

Defined results: rows with a null in entity, availability or (for facts) period never match; a request without a match
keeps a null id; an empty side gives requests without ids; repeated requests each get the answer; a column of requests
that has the name of ``out_col`` is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import parallelism

#: Rows of both sides that one bucket has on average, and what DuckDB may use for it.
ROWS_PER_BUCKET = 200_000
MEMORY = "768MB"

_SQL = """
WITH state AS (  -- the latest period known at each availability date, then its latest announcement
    SELECT entity, available_on,
           max({{'period': period, 'available_on': available_on, 'row_id': row_id}}) OVER (
               PARTITION BY entity ORDER BY available_on RANGE UNBOUNDED PRECEDING) AS best
    FROM facts
), current_state AS (
    SELECT DISTINCT entity, available_on, best.row_id AS row_id FROM state
)
SELECT r.entity, r.period, r.cutoff, v.row_id
FROM (SELECT * FROM requests WHERE period IS NULL) r
ASOF LEFT JOIN current_state v ON r.entity = v.entity AND r.cutoff >= v.available_on
UNION ALL
SELECT r.entity, r.period, r.cutoff, v.row_id
FROM (SELECT * FROM requests WHERE period IS NOT NULL) r
ASOF LEFT JOIN facts v ON r.entity = v.entity AND r.period = v.period AND r.cutoff >= v.available_on
""".replace("{{", "{").replace("}}", "}")

_OUT = "entity string, period date, cutoff date, row_id string"


def _bucket_join(requests: pa.Table, facts: pa.Table) -> pa.Table:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
        con.register("requests", requests)
        con.register("facts", facts)
        out = con.sql(_SQL).to_arrow_table()
    return out.cast(pa.schema([("entity", pa.string()), ("period", pa.date32()), ("cutoff", pa.date32()), ("row_id", pa.string())]))


def known_at(
    requests: DataFrame,
    facts: DataFrame,
    *,
    request_keys: Sequence[Column],
    request_period: Column,
    cutoff: Column,
    fact_keys: Sequence[Column],
    fact_period: Column,
    available_on: Column,
    row_id: Column,
    out_col: str = "row_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``requests`` with ``out_col``: the id of the fact known at the cutoff, for the asked period or the latest one.

    A bucket of some ``rows_per_bucket`` rows is what one DuckDB call holds; there are at least four per shuffle partition.
    """
    # repeated rows are counted too: the buckets are rather too small
    n = max(4 * parallelism(requests.sparkSession), -(-(facts.count() + requests.count()) // rows_per_bucket))
    sep = "\x1f"
    # concat() is null if any part is: such rows can't match and are left out here
    entity = lambda keys: F.concat(*[x for k in keys for x in (k.cast("string"), F.lit(sep))])
    asked = requests.withColumns({"__entity": entity(request_keys), "__period": request_period.cast("date"), "__cutoff": cutoff.cast("date")})
    wanted = asked.where("__entity IS NOT NULL AND __cutoff IS NOT NULL").select(F.col("__entity").alias("entity"), F.col("__period").alias("period"), F.col("__cutoff").alias("cutoff")).distinct()
    versions = (
        facts.select(entity(fact_keys).alias("entity"), fact_period.cast("date").alias("period"), available_on.cast("date").alias("available_on"), row_id.cast("string").alias("row_id"))
        .where("entity IS NOT NULL AND period IS NOT NULL AND available_on IS NOT NULL")
        .groupBy("entity", "period", "available_on")
        .agg(F.max("row_id").alias("row_id"))
    )
    bucket = F.pmod(F.xxhash64("entity"), F.lit(n)).alias("bucket")
    drop = lambda t: t.drop_columns(["bucket"])
    answers = (
        wanted.select("*", bucket).groupBy("bucket").cogroup(versions.select("*", bucket).groupBy("bucket")).applyInArrow(lambda left, right: _bucket_join(drop(left), drop(right)), _OUT)
    )
    answers = answers.where("row_id IS NOT NULL").select(F.col("entity").alias("__entity"), F.col("period").alias("__p"), F.col("cutoff").alias("__cutoff"), F.col("row_id").alias("__row_id"))
    joined = asked.join(answers.withColumnRenamed("__entity", "__e").withColumnRenamed("__cutoff", "__c"), (F.col("__entity") == F.col("__e")) & (F.col("__cutoff") == F.col("__c")) & F.col("__period").eqNullSafe(F.col("__p")), "left")
    return joined.select(*[asked[c] for c in requests.columns if c != out_col], F.col("__row_id").alias(out_col))
