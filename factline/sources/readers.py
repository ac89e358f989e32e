"""Scans: registers, cell grids, award releases, page text, and multi-file corpora with provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Shape of one award release line.
AWARD_SCHEMA = (
    "ocid string, date string, awards array<struct<id:string,title:string,date:string,"
    "value:struct<amount:double,currency:string>,suppliers:array<struct<name:string>>,buyer:struct<name:string>>>"
)


def read_register(spark: SparkSession, path: str | Sequence[str], fmt: str, schema: str | None = None) -> DataFrame:
    """CSV (header, schema inferred unless given), Parquet or newline JSON (gz read as is)."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.option("header", True).csv(paths)
    if fmt == "parquet":
        return reader.parquet(*paths)
    if fmt == "json":
        return reader.json(paths)
    raise ValueError(f"unsupported format: {fmt}")


def read_awards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AWARD_SCHEMA).json(path)


def read_corpus(spark: SparkSession, pattern: str, fmt: str = "text") -> DataFrame:
    """Many files as one frame, each row with the file it came from."""
    return spark.read.format(fmt).load(pattern).select("*", F.col("_metadata.file_path").alias("file_path"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length, modified)`` of every file below a folder, from the listing alone: none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_chosen(spark: SparkSession, folder: str, chosen: DataFrame, fmt: str, schema: StructType | str | None = None, path: str = "path") -> DataFrame:
    """The chosen files or folders below ``folder`` as one frame, each row with the file it came from; the others are not opened.

    The paths pass through the driver, as those of any scan do.  ``schema`` is needed where nothing may be chosen.
    """
    paths = sorted({r[0] for r in chosen.select(path).collect()})
    reader = spark.read.format(fmt).option("basePath", folder)
    if not paths:
        if schema is None:
            raise FileNotFoundError(f"no file chosen below {folder}")
        return spark.createDataFrame([], schema).withColumn("file_path", F.lit(None).cast("string"))
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(paths).select("*", F.col("_metadata.file_path").alias("file_path"))


def latest_or_glob(manifest: DataFrame, listing: DataFrame, source: str = "source_id", path: str = "path") -> DataFrame:
    """Files of each source's latest manifest; sources without one fall back to what lies on disk."""
    newest = manifest.groupBy(source).agg(F.max("snapshot").alias("snapshot"))
    named = manifest.join(newest, [source, "snapshot"], "left_semi").select(source, path)
    fallback = listing.join(newest, source, "left_anti").select(source, path)
    return named.unionByName(fallback)


def text_lines(pages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Page text -> numbered lines."""
    return pages.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and order-free checksums per table, for comparing a copy with its original.

    A row's hash takes each value with its column's place and whether it is null, so that a value can't move to another column
    unseen; the second checksum sums products of two hashes, so that changes of several rows do not cancel in both.
    """
    out = None
    for name, df in tables.items():
        parts = [p for i, c in enumerate(df.columns) for p in (F.lit(i), F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
        first, second = F.xxhash64(*parts), F.hash(*parts)
        row = df.select(first.alias("_a"), second.alias("_b")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col("_a").cast("decimal(38,0)")).cast("string").alias("checksum"),
            F.sum(F.shiftright("_a", 32).cast("decimal(38,0)") * F.col("_b").cast("decimal(20,0)")).cast("string").alias("checksum_2"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "checksum", "checksum_2")
        out = row if out is None else out.unionByName(row)
    return out
