"""Which fact stands for a node in a year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.ordered import first_per_key
from factline.rules import GROUP_RANK, STATUS_RANK


def _rank(col: str, ranks: dict[str, int]) -> Column:
    out = F.lit(max(ranks.values()) + 1)
    for value, n in ranks.items():
        out = F.when(F.col(col) == value, n).otherwise(out)
    return out


def best_fact(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Budget before actual before the rest, then the edition order of statuses, then the id."""
    return first_per_key(
        facts, keys, [_rank("compatibility_group", GROUP_RANK), _rank("estimate_status", STATUS_RANK), F.col("fact_id")]
    )


def fact_or_fallback(
    facts: DataFrame, node: str, start: str, source: str, wanted: DataFrame | None = None, target: int | None = None
) -> DataFrame:
    """The exact year when a node has it, else its nearest earlier year; later years never stand in.

    ``target`` is one year for all nodes; else ``wanted`` names ``(node, target)`` rows.  Among equally
    near facts one whose source has another earlier fact of the node is preferred.
    """
    rows = facts.withColumn("_g", _rank("compatibility_group", GROUP_RANK)).withColumn("_s", _rank("estimate_status", STATUS_RANK))
    if wanted is None:
        rows = rows.withColumn("target", F.lit(target))
    else:
        rows = rows.join(wanted.select(node, "target"), node)
    rows = rows.where(F.col(start) <= F.col("target"))
    exact = rows.where(F.col(start) == F.col("target"))
    earlier = rows.where(F.col(start) < F.col("target"))
    keep = F.struct(
        "fact_id", "amount_aud", "financial_year", F.col(source).alias("source"), "compatibility_group", "estimate_status"
    )
    key = [node, "target"]
    hit = exact.groupBy(*key).agg(F.min_by(keep, F.struct("_g", "_s", "fact_id")).alias("row"))
    # one row per (node, source): count of earlier facts and the nearest of them, before any ranking
    per_source = earlier.groupBy(*key, F.col(source).alias("src")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(start).alias("near"),
        F.min_by(keep, F.struct(-F.col(start), "_g", "fact_id")).alias("row"),
        F.min(F.struct((-F.col(start)).alias("d"), F.col("_g"), F.col("fact_id"))).alias("ord"),
    )
    fall = per_source.groupBy(*key).agg(
        F.min_by(
            F.struct("row", (F.col("n") > 1).alias("same")),
            F.struct(-F.col("near"), F.when(F.col("n") > 1, 0).otherwise(1), F.col("ord._g"), F.col("ord.fact_id")),
        ).alias("f")
    )
    j = hit.join(fall, key, "full_outer")
    row = F.coalesce(F.col("row"), F.col("f.row"))
    out = j.select(
        *key,
        *[row[c].alias(c) for c in ("fact_id", "amount_aud", "financial_year", "source", "compatibility_group", "estimate_status")],
        F.col("row").isNull().alias("is_year_fallback"),
        F.when(F.col("row").isNotNull(), "exact_year_match")
        .when(F.col("f.same"), "nearest_earlier_year_same_edition")
        .otherwise("nearest_earlier_year_other_edition")
        .alias("fallback_reason"),
    )
    return out
