"""Session helpers: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import functools
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "factline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a table that one task of a join by row keys gets, on average.
TASK_ROWS = 500_000


def tasks_for(table: DataFrame) -> int:
    """So many tasks that what one sorts and groups stays the same however large a stored table is; only footers are read to count it."""
    return max(1, math.ceil(table.count() / TASK_ROWS))


@functools.cache
def _own_folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="factline-steps-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names.

    Only a session on this machine alone (master ``local[...]``) that names none gets one of its own, deleted when Python
    ends; any other is refused, since executors would not see it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = _own_folder()
    sc.setCheckpointDir(named)
    return named


def steps_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/factline-steps"


def cut_lineage(df: DataFrame, group: int | None = None) -> DataFrame:
    """Write a step to shared storage and read it back.

    A lost executor then re-reads files instead of replaying an iterative plan, the step is computed
    once, and its size is known to the planner of the next step.  A step just read back is left alone.
    ``group`` is the size in bytes of a row group, the least that a task reads.
    """
    if getattr(df, "_factline_step", False):
        return df
    spark = df.sparkSession
    folder = f"{steps_folder(spark)}/{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", group) if group else df.write).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._factline_step = True
    out._factline_folder = folder
    return out


def again(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A written step as another session reads it."""
    return spark.read.schema(df.schema).parquet(df._factline_folder)


def drop_step(df: DataFrame) -> None:
    """Delete a written step, once everything that is built on it has been written itself."""
    folder = getattr(df, "_factline_folder", None)
    if folder:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_steps(spark: SparkSession) -> bool:
    """Delete the written steps of this session, once nothing built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(steps_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
