"""Reconciliation of totals that must never be added together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.rules import ROLL_UP_TAG

# Thresholds.
EXACT = 1e-9
PASS_PERCENT, WARN_PERCENT = 0.5, 2.0


def source_totals(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Left totals against right ones; a missing right side is unresolved with the whole amount."""
    keys = list(keys)
    a = left.groupBy(*keys).agg(F.round(F.sum("amount_aud"), 2).alias("left_total"))
    b = right.groupBy(*keys).agg(F.round(F.sum("amount_aud"), 2).alias("right_total"))
    j = a.join(b, keys, "left")
    diff = F.round(F.col("left_total") - F.coalesce("right_total", F.lit(0.0)), 2)
    status = (
        F.when(F.col("right_total").isNull(), "unresolved")
        .when(F.abs(diff) < EXACT, "balanced")
        .when(F.abs(diff) <= tolerance, "within_tolerance")
        .otherwise("explained_difference")
    )
    return j.withColumn("difference_amount_aud", diff).withColumn("status", status).withColumn("stored_difference_aud", F.abs(diff))


def status_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("stored_difference_aud"), 2).alias("difference_aud"))


def control_against_detail(control: DataFrame, detail: DataFrame, keys: Sequence[str], tolerance_pct: float = 5.0) -> DataFrame:
    keys = list(keys)
    c = control.groupBy(*keys).agg(F.round(F.sum("amount_aud"), 2).alias("control_amount"))
    d = detail.groupBy(*keys).agg(F.round(F.sum("amount_aud"), 2).alias("detail_sum"))
    j = c.join(d, keys, "left").withColumn("detail_sum", F.coalesce("detail_sum", F.lit(0.0)))
    diff = F.round(F.col("detail_sum") - F.col("control_amount"), 2)
    pct = F.when(F.col("control_amount") != 0, F.abs(diff) / F.col("control_amount") * 100)
    status = F.when(F.col("control_amount") <= 0, "no_control").when(pct > tolerance_pct, "warning").otherwise("ok")
    return j.withColumn("difference", diff).withColumn("difference_percentage", F.round(pct, 4)).withColumn("status", status)


def is_debt_leaf(granularity: Column, name: Column, locator: Column) -> Column:
    """Single securities, deep type aggregates, and untyped deep rows that are no roll-up."""
    g, n, loc = (F.coalesce(c, F.lit("")) for c in (granularity, name, locator))
    slashes = F.length(n) - F.length(F.replace(n, F.lit("/"), F.lit("")))
    deep_type = (g == "instrument_type_aggregate") & (slashes >= 3)
    untyped = (g == "") & (slashes >= 2) & ~loc.contains("roll_up:")
    single = (g == "individual_security") | loc.contains("amount_granularity:individual_security")
    return ~loc.contains(ROLL_UP_TAG) & ~((g == "instrument_type_aggregate") & (slashes < 3)) & (single | deep_type | untyped)


def leaves_against_control(facts: DataFrame, control: DataFrame, key: str) -> DataFrame:
    leaf = facts.where(is_debt_leaf(F.col("amount_granularity"), F.col("node_name"), F.col("locator")))
    sums = leaf.groupBy(key).agg(F.round(F.sum("amount_aud"), 2).alias("leaf_sum"), F.count(F.lit(1)).alias("n_leaves"))
    j = control.join(sums, key, "left").withColumn("leaf_sum", F.coalesce("leaf_sum", F.lit(0.0))).withColumn("n_leaves", F.coalesce("n_leaves", F.lit(0)))
    pct = F.when(F.col("control_aud") != 0, F.abs(F.col("leaf_sum") - F.col("control_aud")) / F.col("control_aud") * 100).otherwise(0.0)
    status = F.when(pct <= PASS_PERCENT, "pass").when(pct <= WARN_PERCENT, "warning").otherwise("failure")
    return j.withColumn("percentage_difference", F.round(pct, 4)).withColumn("status", status)
