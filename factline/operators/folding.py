"""Top rows per group with an explicit remainder; groups are combined before they are ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.operators.ordered import top_per_key


def top_with_remainder(
    rows: DataFrame,
    keys: Sequence[str],
    item: str,
    value: str,
    n: int,
    label: str,
    min_total: float = 0.0,
) -> DataFrame:
    """Per key the ``n`` largest items and one remainder row, only for keys worth at least ``min_total``."""
    keys = list(keys)
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    totals = totals.where(F.col("_sum") >= min_total)
    head = top_per_key(rows.select(*keys, item, value), keys, [F.desc(value), F.asc(item)], n, "_rank").drop("_rank")
    head = head.join(totals.select(*keys), keys, "left_semi")
    sums = head.groupBy(*keys).agg(F.sum(value).alias("_head"))
    other = totals.where(F.col("_n") > n).join(sums, keys)
    rest = (F.col("_sum") - F.col("_head")).alias(value)
    name = F.concat(F.lit(f"{label} ("), (F.col("_n") - n).cast("string"), F.lit(")")).alias(item)
    return head.unionByName(other.select(*keys, name, rest).where(F.col(value) > 0))


def folder_category_contract(
    rows: DataFrame, parent: str, category: str, contract: str, value: str, categories: int = 12, contracts: int = 3
) -> DataFrame:
    """Three layers: folder total over everything, the top categories, the top contracts of each.

    The folder counts all categories, not only those shown.
    """
    per_category = rows.groupBy(parent, category).agg(F.sum(value).alias("amount"))
    folders = per_category.groupBy(parent).agg(F.sum("amount").alias("amount"))
    shown = top_per_key(per_category, [parent], [F.desc("amount"), F.asc(category)], categories, "_rank").drop("_rank")
    items = rows.join(shown.select(parent, category), [parent, category], "left_semi")
    best = top_per_key(
        items.select(parent, category, contract, F.col(value).alias("amount")),
        [parent, category],
        [F.desc("amount"), F.asc(contract)],
        contracts,
        "_rank",
    ).drop("_rank")
    none = F.lit(None).cast("string")
    return (
        folders.select(F.lit("folder").alias("layer"), parent, none.alias(category), none.alias(contract), "amount")
        .unionByName(shown.select(F.lit("category").alias("layer"), parent, category, none.alias(contract), "amount"))
        .unionByName(best.select(F.lit("contract").alias("layer"), parent, category, contract, "amount"))
    )
