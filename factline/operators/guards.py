"""Checks that run before figures are put together."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.rules import FLOW_KINDS, NEUTRAL_PRICE_BASES, STOCK_KINDS, VIEW_FAMILIES


def display_value(row_value: Column, row_aud: Column) -> Column:
    return F.coalesce(row_value, row_aud)


def _list_text(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def compatibility(rows: DataFrame, family: str, keys: Sequence[str] = (), valuation_filter: str | None = None) -> DataFrame:
    """Decide per key whether rows may be shown together: one aggregate over small domains.

    The sets collected are enumerations (units, bases, measures); dates are judged by min and max.
    """
    spec = VIEW_FAMILIES[family]

    def names(col: str, default: str) -> Column:
        filled = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default)) if col in rows.columns else F.lit(default)
        return F.array_sort(F.collect_set(filled))

    dates = F.nullif(F.col("observation_date"), F.lit("")) if "observation_date" in rows.columns else F.lit(None)
    agg = [
        names("unit", "AUD").alias("units"),
        names("price_basis", "unspecified").alias("price_bases"),
        names("valuation_basis", "unspecified").alias("valuation_bases"),
        F.array_sort(F.collect_set("measure_type")).alias("measures"),
        F.coalesce(F.min(dates) != F.max(dates), F.lit(False)).alias("mixed_dates"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    d = rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)
    d = d.withColumn("mixed_valuation", F.size("valuation_bases") > 1)
    concrete = F.filter("price_bases", lambda p: ~p.isin(*NEUTRAL_PRICE_BASES))

    def not_in(col: Column, allowed: Iterable[str]) -> Column:
        return F.array_except(col, F.array(*[F.lit(a) for a in allowed]))

    bad_units = not_in(F.col("units"), spec["units"])
    bad_prices = not_in(concrete, spec["price_bases"])
    errors = [
        F.when(
            F.size(bad_units) > 0,
            F.concat(F.lit("Incompatible unit(s) "), _list_text(bad_units), F.lit(f" for view_family={family}")),
        ),
        F.when(
            F.size("units") > 1,
            F.concat(F.lit("Cannot combine multiple units in one tree: "), _list_text(F.col("units"))),
        ),
        F.when(
            F.array_contains("units", "percent") & F.array_contains("units", "AUD"),
            "Cannot mix percent and AUD in one additive tree",
        ),
        F.when(
            F.size(concrete) > 1,
            F.concat(F.lit("Cannot mix price bases "), _list_text(concrete), F.lit(f" under {family}")),
        ),
        F.when(
            F.size(bad_prices) > 0,
            F.concat(F.lit("Price basis "), _list_text(bad_prices), F.lit(f" not allowed for {family}")),
        ),
    ]
    if "measures" in spec:
        bad_measures = not_in(F.col("measures"), spec["measures"])
        errors.append(
            F.when(
                F.size(bad_measures) > 0,
                F.concat(
                    F.lit("Measure type(s) "), _list_text(bad_measures), F.lit(f" not allowed in view_family={family}")
                ),
            )
        )
    for mine, other in (("gdp_current", "gdp_chain_volume"), ("gdp_chain_volume", "gdp_current")):
        if family == mine:
            errors.append(F.when(F.array_contains("measures", other), f"{mine} cannot include {other} facts"))
    if family != "ratios":
        errors.append(
            F.when(
                F.array_contains("measures", "tax_to_gdp_ratio"), "tax_to_gdp_ratio belongs only in view_family=ratios"
            )
        )
    d = d.withColumn("errors", F.array_compact(F.array(*errors)))

    one_basis = valuation_filter and valuation_filter not in ("all", "comparison")
    if spec.get("one_valuation_for_total") and not one_basis:
        clash = F.col("mixed_valuation")
    else:
        clash = F.lit(False)
    date_clash = F.col("mixed_dates") if not spec.get("mix_dates", True) else F.lit(False)
    additive = F.lit(spec.get("additive", True)) & ~clash
    total = F.lit(spec.get("root_total", True) and spec.get("additive", True)) & ~clash & ~date_clash
    d = d.withColumn("allowed", F.size("errors") == 0).withColumn("additive_across_nodes", additive)
    d = d.withColumn("root_total_allowed", total)
    empty = F.col("n_rows") == 0
    warnings = F.array_compact(
        F.array(
            F.when(empty, "No facts matched the query filters."),
            F.when(clash, "Mixed valuation bases: comparison only, no unqualified total."),
            F.when(date_clash, "Mixed observation dates: not one as-at stock."),
            F.when(
                ~F.col("root_total_allowed") & F.col("allowed") & ~empty, f"Root total not allowed for view_family={family}"
            ),
        )
    )
    return d.withColumn("warnings", warnings)


def require_compatible(decision: DataFrame) -> None:
    """Raise with every message of the first refused key; reads one row, never the facts."""
    refused = decision.where(~F.col("allowed")).select(F.array_join("errors", "; ").alias("e")).take(1)
    if refused:
        raise ValueError(refused[0]["e"] or "Incompatible fact set")


def require_triple(group: str | None, basis: str | None, status: str | None, view: str | None = None) -> None:
    if view == "reconciliation":
        return
    given = {"compatibility_group": group, "accounting_basis": basis, "estimate_status": status}
    missing = [name for name, value in given.items() if not value]
    if missing:
        raise ValueError("missing: " + ", ".join(missing) + "; cross-group totals need view=reconciliation")


def require_comparable(kinds: Mapping[str, str], requested: Sequence[str]) -> str | None:
    """Refuse stock beside flow and more than six series; return a warning for mixed kinds."""
    if not requested:
        raise ValueError("name at least one measure")
    if len(requested) > 6:
        raise ValueError("compare at most 6 measures at once")
    unknown = [m for m in requested if m not in kinds]
    if unknown:
        raise ValueError(f"unknown measure(s): {unknown}")
    seen = {kinds[m] for m in requested}
    if seen & set(STOCK_KINDS) and seen & set(FLOW_KINDS):
        raise ValueError("a stock and a flow cover different kinds of period and are never compared in one request")
    return "series mix balances with raw flows or stocks and are never summed" if len(seen) > 1 else None


def shared_groups(measures: DataFrame) -> DataFrame:
    """Compatibility groups claimed by more than one measure of an isolated family."""
    return (
        measures.select("family", "compatibility_group", "measure_type")
        .distinct()
        .groupBy("family", "compatibility_group")
        .agg(F.count(F.lit(1)).alias("n_measures"), F.min("measure_type").alias("first_measure"))
        .where(F.col("n_measures") > 1)
    )
