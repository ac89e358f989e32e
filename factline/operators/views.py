"""Dashboard selections: mode filters, preferred basis, path building, series and comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators import tree as T
from factline.operators.guards import require_comparable
from factline.rules import (
    ECONOMY_MEASURES,
    EXPENDITURE_NAMES,
    INDUSTRY_NAMES,
    INDUSTRY_SUFFIX,
    LIABILITY_SKIP,
    MODES,
    NAVIGATION_FOLDERS,
    PURPOSE_PARENT,
    PURPOSE_SKIP,
    PURPOSE_TOTAL,
    RATIO_NAMES,
    REVENUE_SKIP,
    ROLL_UP_TAG,
)


def mode_rows(facts: DataFrame, mode: str) -> DataFrame:
    """Facts of one mode: its group and its statuses."""
    group, statuses, _, _ = MODES[mode]
    return facts.where((F.col("compatibility_group") == group) & F.col("estimate_status").isin(*statuses))


def economy_rows(facts: DataFrame, mode: str, name: str = "node_name") -> DataFrame:
    """National-accounts sub-filter: measure list plus the industry and expenditure name rules."""
    eco = MODES[mode][3]
    if eco is None:
        return facts
    rows = facts.where(F.col("measure_type").isin(*ECONOMY_MEASURES[eco]))
    industry = F.col(name).rlike(INDUSTRY_SUFFIX)
    if eco == "gdp_current":
        return rows.where(~industry & ~F.col(name).rlike(RATIO_NAMES))
    if eco == "gdp_chain_volume":
        return rows.where(~industry)
    if eco == "gdp_expenditure":
        return rows.where(~industry & F.col(name).rlike(EXPENDITURE_NAMES))
    if eco in ("gva_current", "gva_chain_volume"):
        return rows.where(industry | F.col(name).rlike(INDUSTRY_NAMES))
    return rows


def preferred_basis(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """gfs where a key has any, else accrual, else no preference."""
    has = lambda b: F.max(F.when(F.col("accounting_basis") == b, 1).otherwise(0)) == 1
    return rows.groupBy(*keys).agg(
        F.when(has("gfs"), "gfs").when(has("accrual"), "accrual").alias("preferred_basis")
    )


def with_preferred_basis(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    joined = rows.join(preferred_basis(rows, keys), keys)
    keep = F.col("preferred_basis").isNull() | (F.col("accounting_basis") == F.col("preferred_basis"))
    return joined.where(keep).drop("preferred_basis")


def good_quality(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("quality_status", F.lit("ok")).isin("quarantined", "rejected"))


def valuation_rows(rows: DataFrame, basis: str | None) -> DataFrame:
    if not basis or basis in ("all", "comparison"):
        return rows
    return rows.where(F.coalesce("valuation_basis", F.lit("unspecified")) == basis)


def without_roll_ups(rows: DataFrame, locator: str = "locator", granularity: str = "amount_granularity") -> DataFrame:
    tagged = F.coalesce(F.col(locator), F.lit("")).contains(ROLL_UP_TAG)
    typed = (F.coalesce(F.col(granularity), F.lit("")) == "instrument_type_aggregate") & F.coalesce(
        F.col(locator), F.lit("")
    ).contains("roll_up:")
    return rows.where(~(tagged | typed))


def _map(rules: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])


def ancestor_paths(parents: Mapping[str, str]) -> dict[str, list[str]]:
    """Path of every configured label from its topmost ancestor; a repeated parent ends the climb."""
    paths = {}
    for label in parents:
        path = [label]
        while (up := parents.get(path[0])) is not None and up not in path:
            path.insert(0, up)
        paths[label] = path
    return paths


def climb(name: Column, parents: Mapping[str, str]) -> Column:
    """Path down to ``name``; the rule table is closed once, so a row costs one lookup."""
    pairs = []
    for label, path in ancestor_paths(parents).items():
        pairs += [F.lit(label), F.array(*[F.lit(p) for p in path])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.array(name))


def gdp_path(name: Column) -> Column:
    """Where a national-accounts label hangs; null for totals."""
    parts = T.split_path(name)
    lower_last = F.lower(F.element_at(parts, -1))
    state = lower_last.rlike(r"\bgsp\b|gross state product")
    nested = (
        F.when(F.lower(parts[0]).startswith("expenditure on gdp"), F.concat(F.array(F.lit("GDP (current prices)")), parts))
        .when((F.size(parts) >= 2) & state, F.concat(F.array(F.lit("GSP (current prices)")), parts))
        .otherwise(parts)
    )

    def under(top: str) -> Column:
        return F.array(F.lit(top), name)

    flat = (
        F.when(name.rlike(r"(?i)gdp current|gross domestic product.*current"), under("GDP (current prices)"))
        .when(name.rlike(r"(?i)chain.?volume|real gdp"), under("GDP (chain volume)"))
        .when(name.rlike(r"(?i)\bgsp\b|gross state product"), under("GSP (current prices)"))
        .when(name.rlike(r"(?i)tax.*gdp|% of gdp"), under("Derived ratios"))
        .when(
            name.rlike(r"(?i)\bgdp\b|expenditure on gdp|gross value added|gva\b|final consumption|gross fixed capital"),
            under("GDP components"),
        )
        .otherwise(F.array(name))
    )
    return F.when((name == "") | name.rlike(r"(?i)^total\b"), F.lit(None)).when(name.contains(T.SEP), nested).otherwise(flat)


def purpose_path(
    name: Column,
    parents: Mapping[str, str] = PURPOSE_PARENT,
    totals: Mapping[str, str] = PURPOSE_TOTAL,
    skip: Sequence[str] = PURPOSE_SKIP,
) -> Column:
    total, parent = F.try_element_at(_map(totals), name), F.try_element_at(_map(parents), name)
    return (
        F.when((name == "") | name.isin(*skip), F.lit(None))
        .when(total.isNotNull(), F.array(total))
        .when(parent.isNotNull(), F.array(parent, name))
        .otherwise(F.array(name))
    )


def source_path(
    source: Column,
    name: Column,
    mode: str | None = None,
    revenue_parents: Mapping[str, str] | None = None,
    purpose_parents: Mapping[str, str] = PURPOSE_PARENT,
    purpose_totals: Mapping[str, str] = PURPOSE_TOTAL,
) -> Column:
    """Path parts by source kind: instruments, superannuation, liabilities, revenue, purpose, GDP, rest."""
    name = F.trim(F.coalesce(name, F.lit("Uncategorized")))
    parts = T.split_path(name)
    debt = F.when(parts[0].startswith("Debt securities"), parts).otherwise(F.concat(F.array(F.lit("Debt securities")), parts))
    liability = F.when((name != "") & ~name.isin(*LIABILITY_SKIP), F.array(name))
    revenue = F.when((name != "") & ~name.isin(*REVENUE_SKIP), climb(name, revenue_parents or {"": ""}))
    gfs = source.startswith("abs_gfs_")
    rest = gdp_path(name) if mode is not None and MODES[mode][3] else parts
    return (
        F.when(source.startswith("aofm_"), debt)
        .when(name.startswith("Provisions for defined-benefit superannuation"), parts)
        .when(gfs & source.endswith("_liabilities"), liability)
        .when(gfs & source.endswith("_revenue"), revenue)
        .when(gfs, purpose_path(name, purpose_parents, purpose_totals))
        .otherwise(rest)
    )


def additive_children(nodes: DataFrame, name: str = "name", value: str = "value", kind: str = "kind") -> DataFrame:
    """Children that count in their parent: related rows only when they are neither empty nor folders."""
    folder = F.lit(False)
    for head in NAVIGATION_FOLDERS:
        folder = folder | F.col(name).startswith(head)
    return nodes.where(~((F.col(kind) == "related_breakdown") & ((F.col(value) == 0) | folder)))


def root_totals(nodes: DataFrame, decision: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the top nodes when the set is additive and a total is allowed, else zero and a warning."""
    keys = list(keys)
    tops = nodes.where(F.col("depth") == 1).groupBy(*keys).agg(F.sum("value").alias("_sum"))
    ok = F.col("root_total_allowed") & F.col("additive_across_nodes")
    return tops.join(decision, keys).select(
        *keys,
        F.when(ok, F.col("_sum")).otherwise(F.lit(0.0)).alias("value"),
        F.when(F.size("units") == 1, F.col("units")[0]).alias("unit"),
        "root_total_allowed",
        F.array_join(
            F.concat(
                "warnings",
                F.when(F.col("root_total_allowed"), F.array().cast("array<string>")).otherwise(
                    F.array(F.lit("Root total suppressed (non-additive or incompatible set)."))
                ),
            ),
            "; ",
        ).alias("warning"),
    )


def measure_series(
    facts: DataFrame, measure: str, financial_year: str | None = None, month: str | None = None
) -> DataFrame:
    """One measure only, ordered by year and period."""
    rows = facts.where(F.col("measure_type") == measure)
    if financial_year:
        rows = rows.where(F.col("financial_year") == financial_year)
    if month:
        rows = rows.where(F.col("reporting_month") == month)
    return rows.orderBy("financial_year", "period_end")


def compare_series(facts: DataFrame, kinds: Mapping[str, str], requested: Sequence[str]) -> DataFrame:
    """Parallel series of up to six measures; refused when a stock meets a flow."""
    require_comparable(kinds, requested)
    return facts.where(F.col("measure_type").isin(*requested)).orderBy("measure_type", "financial_year", "period_end")


def year_on_year(facts: DataFrame, this_year: str, last_year: str, keys: Sequence[str]) -> DataFrame:
    """Two years of a measure aligned on the reporting month: one conditional aggregate, no join."""
    pair = facts.where(F.col("financial_year").isin(this_year, last_year))
    pick = lambda fy: F.sum(F.when(F.col("financial_year") == fy, F.col("amount_aud")))
    return pair.groupBy(*keys).agg(pick(this_year).alias("current"), pick(last_year).alias("previous")).where(
        F.col("current").isNotNull() & F.col("previous").isNotNull()
    )


def actual_budget_pairs(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount_aud")))
    actual = F.col("estimate_status").isin("actual", "audited_actual")
    rows = facts.withColumn("side", F.when(actual, "actual").when(F.col("estimate_status") == "budget", "budget"))
    return rows.groupBy(*keys).agg(side("actual").alias("actual"), side("budget").alias("budget"))


def scale_to_parent(nodes: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale children so that they sum to their parent's published amount, ratios multiplied down."""
    keys = list(keys)
    linked = T.with_parent_path(nodes)
    sums = linked.groupBy(*keys, "parent_path").agg(F.sum("value").alias("child_sum"))
    ratios = sums.join(published.select(*keys, F.col("path").alias("parent_path"), "published"), [*keys, "parent_path"])
    usable = (F.col("child_sum") > 0) & (F.col("published") > 0) & (F.abs(F.col("child_sum") - F.col("published")) >= 0.5)
    ratios = ratios.select(
        *keys,
        F.col("parent_path").alias("prefix"),
        F.when(usable, F.col("published") / F.col("child_sum")).otherwise(F.lit(1.0)).alias("ratio"),
    )
    spread = T.prefix_rows(nodes.select(*keys, "path", "value")).where(F.col("depth") < F.size("path"))
    return (
        spread.join(ratios, [*keys, "prefix"], "left")
        .groupBy(*keys, "path", "value")
        .agg(F.product(F.coalesce("ratio", F.lit(1.0))).alias("ratio"))
        .select(*keys, "path", (F.col("value") * F.col("ratio")).alias("value"))
    )


def nestable(nodes: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children that may be drawn inside their parent.

    When they overshoot by more than a quarter: keep all unless one alone does, then drop those
    above the parent itself (one percent of slack).
    """
    keys = list(keys)
    linked = T.with_parent_path(nodes.where(F.col("value") > 0))
    stats = linked.groupBy(*keys, "parent_path").agg(F.sum("value").alias("_sum"), F.max("value").alias("_max"))
    parents = published.select(*keys, F.col("path").alias("parent_path"), "published")
    j = linked.join(stats, [*keys, "parent_path"]).join(parents, [*keys, "parent_path"], "left")
    pub = F.coalesce("published", F.lit(0.0))
    drop = (pub > 0) & (F.col("_sum") > pub * 1.25) & (F.col("_max") > pub * 1.25) & (F.col("value") > pub * 1.01)
    return j.where(~drop).select(*keys, "path", "value")
