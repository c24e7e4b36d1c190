"""Session and scratch-space helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: application id -> paths written into the shared folder
_written: dict[str, list[str]] = {}


def build_session(app: str = "tessera", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is there."""
    n = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and Spark runs on one
    machine. Elsewhere a missing folder is an error: no executor could read what another one wrote."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is deleted with the session's other tables."""
    path = f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete_written(spark: SparkSession) -> int:
    """Delete the tables this session wrote into the shared folder; how many there were. What was read from them can't be
    computed again afterwards, so this is for the end of a job."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so that a lost executor costs no recomputation of what went before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back: column pruning and file splits survive."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the unit in which bucket counts are given."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
