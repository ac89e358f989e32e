"""Set operations over years and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=allow_missing)
    return out


def newly_missing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.join(after.select(key), key, "left_anti")


def common_values(df: DataFrame, member: str, value: str, n_members: int) -> DataFrame:
    """Values that every member has."""
    pairs = df.select(member, value).distinct()
    return pairs.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n_members).select(value)


def common_names(df: DataFrame, member: str, name: str, n_members: int) -> DataFrame:
    """Case-insensitive intersection of names; the least member's least spelling is shown."""
    pairs = df.groupBy(F.lower(name).alias("_k"), member).agg(F.min(name).alias(name))
    both = pairs.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min_by(name, F.struct(member, name)).alias(name))
    return both.where(F.col("_n") == n_members).select(name)


def top_names(nodes: DataFrame, level: str = "level") -> DataFrame:
    """Names just below the jurisdictions of each level (a lone federal jurisdiction is unwrapped too)."""
    return nodes.where(F.size("path") >= 2).select(level, F.element_at("path", 2).alias("name")).distinct()
