"""Sharded requests and their answers: grouping, order restoration and completeness, as for batch embedding jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def make_requests(inputs: DataFrame, *, id_col: str = "chunk_id", text_col: str = "input", per_request: int = 10, per_shard: int = 20_000, buckets: int = 64) -> DataFrame:
    """(custom_id, idx, shard, id, text): inputs dealt to requests of up to ``per_request`` texts. Numbers run within hash
    buckets, so no single task orders all rows."""
    dealt = inputs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("b"))
    n = F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1
    numbered = dealt.withColumn("n", n)
    return numbered.select(F.format_string("req-%04d-%08d", "b", F.floor(F.col("n") / per_request)).alias("custom_id"), (F.col("n") % per_request).cast("int").alias("idx"), F.format_string("%04d-%04d", "b", F.floor(F.col("n") / per_shard)).alias("shard"), "id", "text")


def collect_answers(requests: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors by id, problems): answers (custom_id, idx, embedding) in whatever order they came, put back to their ids;
    repeated, missing, unknown and non-finite ones are problems with a reason."""
    key = ["custom_id", "idx"]
    bad_number = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    per = answers.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("embedding").alias("embedding"))
    j = requests.join(per, key, "full_outer")
    reason = F.when(F.col("id").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.coalesce(bad_number, F.lit(True)), "not_finite")
    marked = j.withColumn("reason", reason)
    return marked.where("reason IS NULL").select("id", "embedding"), marked.where("reason IS NOT NULL").select("custom_id", "idx", "id", "reason")


def shard_status(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(shard, n_requests, n_answered, state): pending, partial or complete."""
    got = answers.select("custom_id", "idx").distinct().withColumn("ok", F.lit(1))
    s = requests.join(got, ["custom_id", "idx"], "left").groupBy("shard").agg(F.count(F.lit(1)).alias("n_requests"), F.count("ok").alias("n_answered"))
    return s.withColumn("state", F.when(F.col("n_answered") == 0, "pending").when(F.col("n_answered") < F.col("n_requests"), "partial").otherwise("complete"))
