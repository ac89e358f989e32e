"""Sinks: a fact table merged by partition, and quarantine, staging and report writers.

All of them can be repeated: a load that is retried, or run again, leaves the same files' worth of rows behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators.loading import upsert
from factline.session import cut_lineage


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def merge_facts(spark: SparkSession, folder: str, new: DataFrame, partition: str = "financial_year", key: str = "fact_key") -> None:
    """Upsert ``new`` into the Parquet table at ``folder``, which is partitioned by ``partition``.

    Only partitions that ``new`` has rows of are read, merged and replaced, so a load costs what it touches, not the table.  A key
    belongs to one partition, since keys hold the year.  Rows without a partition value are a partition like any other.
    """
    if exists(spark, folder):
        old = spark.read.parquet(folder)
        years = new.select(F.col(partition).cast(old.schema[partition].dataType).alias("_touched")).distinct()
        touched = old.join(years, F.col(partition).eqNullSafe(F.col("_touched")), "left_semi")
        # written beside the table first: a table can't be replaced while it is read
        new = cut_lineage(upsert(touched, new, key))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)


def write_quarantine(df: DataFrame, folder: str, load_id: str) -> None:
    """Rejected rows of one load with their reasons as JSON lines, in place of what an earlier try of it wrote."""
    df.write.mode("overwrite").json(f"{folder}/load={load_id}")


def write_staging(df: DataFrame, folder: str, source: str = "source_id") -> None:
    """One CSV folder per source; the folders of other sources stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).option("header", True).csv(folder)


def write_report(df: DataFrame, folder: str) -> None:
    """A report as JSON lines stamped with the time it was made."""
    df.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(folder)
