"""Registers, awards, instruments: columns by role, schema variance, typing, enrichment, dedupe."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions.years import fy_of_date
from factline.operators.ordered import dense_ordinal, first_per_key

# Words that give a register column its role, in order of preference.
ROLES = {
    "amount": ("amount", "expenditure", "value", "total"),
    "agency": ("agency", "department", "entity"),
    "category": ("category", "description", "supplier", "program"),
}
DOMINANT_SHARE = 0.9
# Words that type a debt instrument, first match wins.
INSTRUMENT_TYPES = (
    ("floating_rate_note", ("floating", "frn", "bbsw", "aonia")),
    ("indexed_bond", ("index", "cib", "capital indexed", "annuity")),
    ("short_term", ("short", "promissory", "commercial paper", "note programme", "pn ")),
    ("fixed_bond", ("benchmark", "fixed", "bond", "green")),
)
# Bounds of the portfolio remap.
REMAP_LOW, REMAP_HIGH = 1e5, 2e11


def normalise_header(name: str) -> str:
    return re.sub(r"[^a-z0-9 ]", "", re.sub(r"\s+", " ", name.strip().lower()))


def by_role(df: DataFrame, roles: Mapping[str, Sequence[str]] = ROLES) -> DataFrame:
    """Rename the first column matching each role; works on names only, reads no data."""
    taken: dict[str, str] = {}
    for role, words in roles.items():
        for c in df.columns:
            if c not in taken and any(w in normalise_header(c) for w in words):
                taken[c] = role
                break
    return df.withColumnsRenamed(taken)


def normal_header(columns: Column) -> Column:
    """A file's header list in the form that schemas are compared in."""
    return F.transform(columns, lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), "[^a-z0-9 ]", ""))


def stride_sample(files: DataFrame, key: str, n: int, position: str = "position") -> DataFrame:
    """Every k-th file in key order with its position, at most ``n`` of them (a sampling operator)."""
    total = files.agg(F.count(F.lit(1))).scalar()
    ranked = dense_ordinal(files, [], [key], position).withColumn("_total", total)
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / n))
    return ranked.where((F.col(position) % step == 0) & (F.col(position) < step * n)).drop("_total")


def schema_decision(files: DataFrame) -> DataFrame:
    """One row: number of schemas, share of the dominant one, and whether one mapping is enough.

    ``files`` holds ``path`` and ``schema`` (normalised header as text).
    """
    counts = files.groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
    d = counts.agg(F.sum("n").alias("n_files"), F.count(F.lit(1)).alias("n_schemas"), F.max("n").alias("_top"), F.max_by("schema", F.struct("n", "schema")).alias("dominant"))
    share = F.col("_top") / F.col("n_files")
    return d.select("n_files", "n_schemas", "dominant", share.alias("dominant_share"), F.when(share >= DOMINANT_SHARE, "single_mapping").otherwise("split_mappings").alias("decision"))


def dominant_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of files with the dominant schema, or of all files when mappings are split."""
    d = schema_decision(files)
    keep = files.withColumn("_dec", d.select("decision").scalar()).withColumn("_dom", d.select("dominant").scalar())
    keep = keep.where((F.col("_dec") != "single_mapping") | (F.col("schema") == F.col("_dom")))
    return rows.join(keep.select("path"), "path", "left_semi")


def wide_to_long(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """Chosen metric columns as rows; empty and non-numeric cells drop out."""
    picked = df.select(*ids, *[F.col(c).try_cast("double").alias(n) for c, n in metrics.items()])
    return picked.unpivot(list(ids), list(metrics.values()), "metric", "amount").where(F.col("amount").isNotNull())


def award_facts(releases: DataFrame, default_fy: str) -> DataFrame:
    """One row per award: first supplier, amount, and the year of the award date (else the default)."""
    a = releases.select("ocid", F.explode("awards").alias("a"))
    # bound, since the year asks for it many times: each date is parsed once
    day = F.try_to_timestamp(F.substring("a.date", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    a = a.select("*", F.inline(F.array(F.struct(day.alias("_day")))))
    return a.select(
        "ocid", F.col("a.id").alias("award_id"), F.coalesce(F.get("a.suppliers", F.lit(0))["name"], F.lit("Unknown supplier")).alias("supplier"),
        F.col("a.buyer.name").alias("buyer"), F.col("a.value.amount").alias("amount_aud"), F.coalesce(fy_of_date(F.col("_day")), F.lit(default_fy)).alias("financial_year"),
    )


def register_facts(rows: DataFrame, entity: Column, description: Column, day: Column, amount: Column) -> DataFrame:
    """Invoice or contract rows as facts on ``entity / description``."""
    from factline.functions.labels import clean_label

    name = F.concat_ws(" / ", clean_label(entity), clean_label(description))
    return rows.select("*", fy_of_date(day).alias("financial_year"), name.alias("node_name"), amount.alias("amount_aud")).where(F.col("amount_aud").isNotNull())


def instrument_type(text: Column) -> Column:
    out = F.lit("other")
    low = F.lower(F.coalesce(text, F.lit("")))
    for name, words in reversed(INSTRUMENT_TYPES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def dedupe_instruments(rows: DataFrame, keys: Sequence[str], amount: str, order: str) -> DataFrame:
    """First of equal (type, name, rounded amount); an aggregate, so repeats vanish map-side."""
    keyed = rows.withColumn("_a", F.round(amount, 2))
    return first_per_key(keyed, [*keys, "_a"], [F.col(order)]).drop("_a")


def enrich(rows: DataFrame, ids: DataFrame, name: str, fallback: str, value: str) -> DataFrame:
    """Identifier by security name, else by maturity; an ambiguous maturity gives none."""
    by_name = ids.groupBy(F.col(name).alias("_n")).agg(F.min(value).alias("_v1"))
    by_rest = ids.groupBy(F.col(fallback).alias("_m")).agg(F.min(value).alias("_v2"), F.count_distinct(value).alias("_k")).where("_k = 1").drop("_k")
    j = rows.join(by_name, F.col(name) == F.col("_n"), "left").join(by_rest, F.col(fallback) == F.col("_m"), "left")
    return j.withColumn(value, F.coalesce("_v1", "_v2")).drop("_n", "_m", "_v1", "_v2")


def prefer_best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The preferred row per key: flags first, then longer text, then larger amounts, as ``order`` says."""
    return first_per_key(rows, keys, order)


def remap_portfolio(rows: DataFrame, hints: Sequence[tuple[str, str]], preferred: Sequence[str], noise: str, years: Sequence[str]) -> DataFrame:
    """Function of each program by the first matching hint; other years, odd amounts, noise and labels without one get a reason."""
    label = F.lower("label")
    target = F.lit(None).cast("string")
    for needle, function in reversed(list(hints)):
        target = F.when(label.contains(needle), function).otherwise(target)
    noisy = label.rlike(noise) & ~F.col("label").isin(*preferred) if preferred else label.rlike(noise)
    reason = (
        F.when(~F.coalesce(F.col("financial_year").isin(*years), F.lit(False)), "other_year")
        .when(~F.coalesce(F.col("amount_aud").between(REMAP_LOW, REMAP_HIGH), F.lit(False)), "amount_out_of_bounds")
        .when(noisy, "noise_label")
        .when(target.isNull(), "no_function")
    )
    return rows.withColumn("function", target).withColumn("reason", reason)


def source_of_legacy(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Source of a legacy row by level and jurisdiction; a rule ending in ``*`` is a prefix."""
    source = F.lit(None).cast("string")
    for level, where, name in reversed(list(rules)):
        at = F.col("jurisdiction").startswith(where[:-1]) if where.endswith("*") else F.col("jurisdiction") == where
        source = F.when((F.col("level") == level) & at, name).otherwise(source)
    return rows.withColumn("source_key", source)


def context_locator(json: Column) -> Column:
    """``sheet | cell | range | unit`` out of a stored context object."""
    get = lambda k: F.nullif(F.get_json_object(json, f"$.{k}"), F.lit(""))
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}:"), get(k)) for k in ("sheet", "cell", "range", "unit")])


def keep_largest(rows: DataFrame, keys: Sequence[str], label: str, value: str, least: float, n: int | None = None) -> DataFrame:
    """Largest value per label above a floor, and at most ``n`` labels per key where a report asks so."""
    from factline.operators.ordered import top_per_key

    best = rows.where(F.col(value) >= least).groupBy(*keys, label).agg(F.max(value).alias(value))
    if n is None:
        return best
    return top_per_key(best, keys, [F.desc(value), F.asc(label)], n, "_rank").drop("_rank")
