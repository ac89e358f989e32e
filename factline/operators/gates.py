"""Gates that decide whether a row may be published."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gate numbers, names and the columns they ask for.
REQUIRED = ("financial_year", "amount_aud", "locator")
FY_PATTERN = r"^\d{4}-\d{2}$"
CITATION = (
    ("landing_url", "landing_url"),
    ("original_resource_url", "original_resource_url"),
    ("cached_copy_path", "cached_copy_path"),
    ("locator", "locator"),
    ("sha256", "sha256"),
    ("retrieved_at", "retrieved_at"),
)


def _repr(items: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), c.cast("string"), F.lit("'")), F.lit("None"))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def gate_messages(rows: DataFrame, mapping: Mapping[str, Any]) -> tuple[Column, Column]:
    """(messages of gates 1-5, message of gate 6); nulls where a gate passes."""
    have = set(rows.columns)
    hard: list[Column] = []
    missing = [c for c in REQUIRED if c not in have]
    if missing:
        hard.append(F.lit(f"Gate 1 schema: missing columns: {_repr(missing)}"))
    if "amount_aud" in have:
        amount = F.col("amount_aud")
        hard.append(
            F.when(amount.isNull(), "Gate 2 types: amount_aud is null").when(
                amount.cast("string").try_cast("double").isNull(),
                F.concat(F.lit("Gate 2 types: amount_aud not numeric: "), _quoted(amount)),
            )
        )
    else:
        hard.append(F.lit("Gate 2 types: amount_aud is null"))
    fy = F.col("financial_year") if "financial_year" in have else F.lit(None).cast("string")
    bad_year = F.coalesce(~F.trim(fy).rlike(FY_PATTERN), F.lit(True))
    hard.append(F.when(bad_year, F.concat(F.lit("Gate 3 period: bad financial_year: "), _quoted(fy))))
    names = [F.nullif(F.col(c), F.lit("")) for c in ("node_name", "category") if c in have]
    name = F.coalesce(*names) if names else F.lit(None).cast("string")
    hard.append(F.when(_blank(name), "Gate 4 node: missing node_name/category"))
    for key in ("measure_type", "accounting_basis", "estimate_status"):
        if not mapping.get(key):
            hard.append(F.lit(f"Gate 5 measure: mapping missing {key}"))
            break
    lacks = [
        F.when(_blank(F.col(c)) if c in have else F.lit(True), F.lit(f"'{shown}'")) for c, shown in CITATION
    ]
    gone = F.array_compact(F.array(*lacks))
    soft = F.when(
        F.size(gone) > 0,
        F.concat(F.lit("Gate 6 attribution: incomplete citation: ["), F.array_join(gone, ", "), F.lit("]")),
    )
    return F.array_compact(F.array(*hard)), soft


def decide(rows: DataFrame, mapping: Mapping[str, Any]) -> DataFrame:
    """Add ``publishable`` and ``quarantine_reason``; one narrow pass, no shuffle."""
    hard, soft = gate_messages(rows, mapping)
    reasons = F.array_compact(F.concat(hard, F.array(soft)))
    out = rows.withColumn("_reasons", reasons)
    return out.select(
        *rows.columns,
        (F.size("_reasons") == 0).alias("publishable"),
        F.nullif(F.array_join("_reasons", "; "), F.lit("")).alias("quarantine_reason"),
    )


def published(decided: DataFrame) -> DataFrame:
    return decided.where("publishable").drop("publishable", "quarantine_reason")


def quarantined(decided: DataFrame) -> DataFrame:
    """Rejected rows; the amount column of the quarantine is never null."""
    amount = F.coalesce(F.col("amount_aud").cast("string").try_cast("double"), F.lit(0.0))
    year = F.coalesce(F.nullif("financial_year", F.lit("")), F.lit("0000-00"))
    return decided.where(~F.col("publishable")).drop("publishable").withColumn("amount_aud", amount).withColumn("financial_year", year)
