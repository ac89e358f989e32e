"""Audits of parent and child rows, accepted residuals, and staged rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions import labels as L

# Smells of a bad label in the defect report, and the slack on "more than its parent".
HEADER_SMELL = r"(?i)\b(EXPENSES|ASSETS|LIABILITIES|REVENUE|EQUITY|CASH FLOW)\b"
NUMERIC_SEQUENCE = r"(?:\d{1,3}(?:,\d{3})+\s+){2,}"
MAX_LABEL = 160
OVER_PARENT = 1e-9


def additive(kind: Column) -> Column:
    return ~F.coalesce(kind == "related_breakdown", F.lit(False))


def traversal_failures(rows: DataFrame) -> DataFrame:
    """One row per broken rule of a parent-child pair.

    Needs ``kind, requested_level, child_level, requested_jurisdiction, child_jurisdiction, parent_group,
    child_group, parent_amount, child_amount, parent_fy, child_fy, label, locator``.  A label is judged
    once per node when the rows bring ``label_class`` along, else once per row.
    """
    add = additive(F.col("kind"))
    share = F.when(F.col("parent_amount") != 0, F.col("child_amount") / F.col("parent_amount"))
    later = F.col("child_fy") > F.col("parent_fy")
    outside = F.col("requested_jurisdiction").isNotNull() & ~F.lower("child_jurisdiction").contains(F.lower("requested_jurisdiction"))
    buckets = F.array_compact(
        F.array(
            F.when(add & (F.col("child_level") != F.col("requested_level")), "scope"),
            F.when(add & outside, "jurisdiction"),
            F.when(add & (F.col("parent_group") != F.col("child_group")), "edge_kind"),
            F.when(add & (share > 1 + OVER_PARENT), "additive_over_parent"),
            F.when(add & (F.col("parent_fy") != F.col("child_fy")), F.when(later, "cross_year_future").otherwise("cross_year")),
            F.when(~L.publishable(F.col("label_class")), "label_quality"),
            F.when(F.coalesce(F.col("locator"), F.lit("")) == "", "citation"),
        )
    )
    if "label_class" not in rows.columns:
        rows = L.with_class(rows, F.col("label"), "_class").withColumn("label_class", F.col("_class.label_class")).drop("_class")
    return rows.withColumn("share", share).withColumn("bucket", F.explode(buckets))


def accept_residuals(over: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over-parent rows accepted where an entry has all keys and allows at least the variance."""
    keys = list(keys)
    allowed = registry.groupBy(*keys).agg(F.max("expected_max_variance").alias("_max"))
    j = over.join(allowed, keys, "left")
    ok = F.coalesce((F.col("share") - 1) <= F.col("_max") + OVER_PARENT, F.lit(False))
    return j.withColumn("verdict", F.when(ok, "accepted").otherwise("failure")).drop("_max")


def defect_rows(rows: DataFrame) -> DataFrame:
    """Defect classes of the baseline report, one row each."""
    add = additive(F.col("kind"))
    label = F.coalesce("label", F.lit(""))
    smell = (
        F.when(label.rlike(HEADER_SMELL), "label_quality_header_or_financial_statement_line")
        .when(label.rlike(NUMERIC_SEQUENCE), "label_quality_concatenated_numeric_row")
        .when(F.length(label) > MAX_LABEL, "label_quality_excessive_length")
    )
    defects = F.array(
        F.when(add & (F.col("child_level") != F.col("requested_level")), "cross_government_leak"),
        F.when(add & F.col("requested_jurisdiction").isNotNull() & ~F.lower("child_jurisdiction").contains(F.lower("requested_jurisdiction")), "cross_jurisdiction_leak"),
        F.when(add & (F.col("parent_fy") != F.col("child_fy")), "cross_year_silent_mismatch"),
        F.when(add & (F.col("parent_amount") != 0) & (F.col("child_amount") / F.col("parent_amount") > 1), "additive_over_100pct"),
        smell,
    )
    return rows.withColumn("defect", F.explode(F.array_compact(defects)))


def staging_audit(rows: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unknown labels and repeated cells made unpublishable, reasons joined by ``;``."""
    keys = list(keys)
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = labels.select("label", "measure_type").distinct()
    j = rows.join(known, "label", "left").join(repeated, keys)
    reason = F.concat_ws(";", F.when(F.col("measure_type").isNull(), "unrecognized_label"), F.when(F.col("_n") > 1, "duplicate_cell_in_sheet"))
    return j.withColumn("quarantine_reason", reason).withColumn("publishable", reason == "").drop("_n")
