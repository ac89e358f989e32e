"""Grouped totals, counts, coverage and vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.guards import require_triple
from factline.rules import LEVEL_ORDER


def triple_totals(facts: DataFrame, group: str | None, basis: str | None, status: str | None) -> DataFrame:
    """Sum, count and one citable fact per year, only inside a full triple."""
    require_triple(group, basis, status)
    rows = facts.where(
        (F.col("compatibility_group") == group)
        & (F.col("accounting_basis") == basis)
        & (F.col("estimate_status") == status)
    )
    return rows.groupBy("financial_year").agg(
        F.sum("amount_aud").alias("total_aud"), F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("sample_fact_id")
    )


def level_counts(facts: DataFrame) -> DataFrame:
    """Facts per level in display order, national folded into federal."""
    folded = F.when(F.col("government_level") == "national", "federal").otherwise(F.col("government_level"))
    order = F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), F.col("level"))
    return (
        facts.groupBy(folded.alias("level"))
        .agg(F.count(F.lit(1)).alias("n_facts"))
        .withColumn("position", order.cast("int"))
        .where(F.col("position") > 0)
        .orderBy("position")
    )


def top_counts(df: DataFrame, key: str, n: int = 40) -> DataFrame:
    """The ``n`` most frequent keys; ties go to the lesser key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def count_matrix(df: DataFrame, key: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """One row per key with a count column per status; the status list is given, so no extra pass."""
    return df.groupBy(key).agg(
        *[F.count(F.when(F.col(status) == s, 1)).alias(s) for s in statuses], F.count(F.lit(1)).alias("total")
    )


def keyed_by_pattern(df: DataFrame, text: Column, pattern: str, name: str) -> DataFrame:
    return df.withColumn(name, F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def folder_rows(leaf: DataFrame, keys: Sequence[str], path: str = "path", value: str = "amount_aud") -> DataFrame:
    """Totals of immediate leaves for folders that have no row of their own."""
    keys = list(keys)
    parents = (
        leaf.where(F.size(path) > 1)
        .groupBy(*keys, F.slice(F.col(path), F.lit(1), F.size(path) - 1).alias(path))
        .agg(F.sum(value).alias(value))
    )
    return parents.join(leaf.select(*keys, path), [*keys, path], "left_anti")


def vocabulary(facts: DataFrame, name: str = "node_name") -> DataFrame:
    """Search labels: whole names and their last two segments, each with its largest amount.

    The citing fact of a name is the one with the largest amount, ties to the larger id.
    """
    per_name = facts.groupBy(name, "level").agg(
        F.sum("amount_aud").alias("amount_aud"), F.max_by("fact_id", F.struct("amount_aud", "fact_id")).alias("fact_id")
    )
    parts = F.split(F.col(name), " / ")
    tails = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    labels = F.array_distinct(F.concat(F.array(F.col(name)), tails))
    spread = per_name.withColumn("label", F.explode(labels))
    best = F.struct("amount_aud", "fact_id", "level")
    return spread.groupBy("label").agg(F.max(best).alias("b")).select(
        "label", F.col("b.amount_aud").alias("amount_aud"), F.col("b.fact_id").alias("fact_id"), F.col("b.level").alias("level")
    )
