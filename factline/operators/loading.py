"""Merging new facts into old ones: upsert, revision conflicts, replacement and derived facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.session import cut_lineage

# What an upsert overwrites, and what keeps the old value when the new one is null.
OVERWRITTEN = ("amount_aud", "source_retrieval_id", "locator", "retrieved_at")
KEPT_WHEN_NULL = ("observation_date", "publication_date", "valuation_basis", "amount_granularity")
CONFLICT_TOLERANCE = 0.01
#: Parts of a task's even share of rows: what a key has beyond one part is dealt to further tasks.
PIECES = 16


def upsert(old: DataFrame, new: DataFrame, key: str = "fact_key") -> DataFrame:
    """One full outer join on the key (the table swap is the store's job)."""
    new_only = [c for c in new.columns if c not in old.columns]
    a = old.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias("o"))
    b = new.select(F.col(key), F.struct(*[c for c in new.columns if c != key]).alias("n"))
    j = a.join(b, key, "full_outer")
    cols: list[Column] = [F.col(key)]
    for c in [*old.columns, *new_only]:
        if c == key:
            continue
        before = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        after = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in OVERWRITTEN:
            value = F.when(F.col("n").isNotNull(), after).otherwise(before)
        elif c in KEPT_WHEN_NULL:
            value = F.coalesce(after, before)
        else:
            value = F.when(F.col("o").isNotNull(), before).otherwise(after)
        cols.append(value.alias(c))
    return j.select(*cols)


def clear_twins(pending: DataFrame, published: DataFrame, key: str = "fact_key") -> DataFrame:
    """A published key removes its quarantined twin."""
    return pending.join(published.select(key), key, "left_anti")


def replace_sources(old: DataFrame, new: DataFrame, source: str = "source_key") -> DataFrame:
    """Drop everything a reloaded source had before, then add what it has now."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new, allowMissingColumns=True)


def surrogate(key: Column) -> Column:
    """Stable id of a natural key; needs no counter and no driver."""
    return F.xxhash64(key)


def get_or_create(existing: DataFrame, wanted: DataFrame, key: str, id_col: str) -> DataFrame:
    """Existing dimension rows plus one new row per unknown key, of its rows the least by all columns.

    Ids are hashes of the keys; two keys with one id, new or old, are an error.
    """
    from factline.operators.ordered import first_per_key

    fresh = first_per_key(wanted, [key], [F.col(c) for c in wanted.columns if c != key]).join(existing.select(key), key, "left_anti")
    both = existing.unionByName(fresh.withColumn(id_col, surrogate(F.col(key))), allowMissingColumns=True)
    clash = both.groupBy(id_col).agg(F.count_distinct(key).alias("n")).where(F.col("n") > 1)
    if not clash.isEmpty():
        raise ValueError(f"two keys share one {id_col}: {clash.first()[id_col]}")
    return both


def classify_labels(rows: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Attach the measure a label stands for; unknown and ambiguous labels get a reason instead."""
    per_label = labels.groupBy(label).agg(
        F.min("measure_type").alias("measure_type"), F.count_distinct("measure_type").alias("_claims")
    )
    j = rows.join(per_label, label, "left")
    reason = F.when(F.col("_claims").isNull(), "unrecognized_label").when(F.col("_claims") > 1, "ambiguous_label")
    return j.withColumn("reason", reason).withColumn("measure_type", F.when(F.col("_claims") == 1, F.col("measure_type"))).drop("_claims")


# Units of money in statements, and the reasons why a row of one is not loaded, in the order of the tests.
STATEMENT_UNITS = ("$m", "$b")


def statement_reasons(rows: DataFrame, labels: DataFrame, months: Sequence[str], sheets: Sequence[str], statuses: Sequence[str], files: DataFrame) -> DataFrame:
    """``classify_labels`` with every reason why a row can't be loaded; null where it can.

    ``rows`` have label, sheet, reporting_month, financial_year, unit, estimate_status, locator and cached_copy_path; ``labels`` have label,
    measure_type and excluded; ``files`` have the paths that are there.
    """
    excluded = labels.where("excluded").select("label").distinct().withColumn("_excluded", F.lit(True))
    there = files.select(F.col("path").alias("cached_copy_path")).distinct().withColumn("_there", F.lit(True))
    j = classify_labels(rows, labels.where(~F.col("excluded"))).join(excluded, "label", "left").join(there, "cached_copy_path", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = (
        F.when(F.col("_excluded"), "excluded_label")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~F.coalesce(F.col("sheet").isin(*sheets), F.lit(False)), "wrong_sheet")
        .when(~F.coalesce(F.col("estimate_status").isin(*statuses), F.lit(False)), "wrong_status")
        .when(~F.coalesce(F.col("reporting_month").isin(*months), F.lit(False)), "invalid_reporting_month")
        .when(~F.coalesce(F.col("financial_year").rlike(r"^\d{4}-\d{2}$"), F.lit(False)), "period_end_undeterminable")
        .when(~F.coalesce(F.col("unit").isin(*STATEMENT_UNITS), F.lit(False)), "unit_undeterminable")
        .when(blank("locator") | blank("cached_copy_path"), "missing_source_cell")
        .when(F.col("_there").isNull(), "source_file_missing_on_disk")
    )
    return j.withColumn("reason", reason).withColumn("measure_type", F.when(reason.isNull(), F.col("measure_type"))).drop("_excluded", "_there")


def revision_outcomes(new: DataFrame, existing: DataFrame, key: str = "fact_key", with_citation: bool = True) -> DataFrame:
    """insert, skip, citation_update or conflict for each new fact; nothing is ever overwritten silently."""
    old = existing.select(
        key,
        F.col("amount_aud").alias("existing_amount_aud"),
        *([F.col("locator").alias("existing_locator")] if with_citation else []),
        F.lit(True).alias("_known"),
    )
    j = new.join(old, key, "left")
    same = F.coalesce(F.abs(F.col("existing_amount_aud") - F.col("amount_aud")) < CONFLICT_TOLERANCE, F.lit(False))
    outcome = F.when(F.col("_known").isNull(), "insert")
    if with_citation:
        outcome = outcome.when(same & ~F.col("existing_locator").eqNullSafe(F.col("locator")), "citation_update")
    outcome = outcome.when(same, "skip").otherwise("conflict")
    return j.withColumn("outcome", outcome).drop("_known")


def same_load_outcomes(new: DataFrame, order: str, key: str = "fact_key") -> DataFrame:
    """Within one load the first row of a key stands; equal repeats are skipped, others conflict.

    The first amount per key is an aggregate with map-side combine, which also counts the key's rows.  It joins back spread: see
    ``join_spread``.  A null key is a key like any other.
    """
    first = new.groupBy(key).agg(F.min_by("amount_aud", order).alias("first_amount_aud"), F.min(order).alias("_first"), F.count("*").alias("_n"))
    j = join_spread(new, first, key, "_n", F.xxhash64(order))
    outcome = (
        F.when(F.col(order) == F.col("_first"), "insert")
        .when(F.abs(F.col("amount_aud") - F.col("first_amount_aud")) < CONFLICT_TOLERANCE, "skip")
        .otherwise("conflict")
    )
    return j.withColumn("outcome", outcome).drop("_first")


def join_spread(rows: DataFrame, per_key: DataFrame, key: str, count: str, by: Column) -> DataFrame:
    """Inner join of ``rows`` with one row per key, in which no key's rows need one task, whatever the session's settings.

    ``per_key`` has the number of the key's rows in ``count``, which goes.  A key with more than a PIECES-th of a task's even share is dealt
    by ``by`` to as many pieces as it has such parts, and its row of ``per_key`` is given to each.  Such keys are fewer than PIECES times the
    shuffle partitions, so their hashes are broadcast; two keys with one hash are only dealt to more pieces.  Null keys join.
    """
    per_key = cut_lineage(per_key)
    pieces = PIECES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = (per_key.agg(F.sum(count)).first()[0] or 0) / pieces
    hashed = F.xxhash64(key)
    shares = F.when(F.col(count) > part, F.ceil(F.col(count) / F.lit(max(part, 1.0)))).otherwise(F.lit(1))
    hot = F.broadcast(per_key.where(F.col(count) > part).groupBy(hashed.alias("_hash")).agg(F.max(shares).alias("_pieces")))
    dealt = rows.join(hot, hashed == F.col("_hash"), "left").withColumn("_piece", F.coalesce(F.pmod(by, F.col("_pieces")), F.lit(0))).drop("_hash", "_pieces")
    given = per_key.join(hot, hashed == F.col("_hash"), "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1)))
    given = given.select(F.struct(F.col(key), F.col("_piece")).alias("_at"), *[c for c in per_key.columns if c not in (key, count)])
    return dealt.withColumn("_at", F.struct(F.col(key), F.col("_piece").cast("long").alias("_piece"))).drop("_piece").join(given, "_at").drop("_at")


def outcome_counts(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return outcomes.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))


def downgrade(decided: DataFrame, refused: Column, reason: Column) -> DataFrame:
    """Take publishable rows back, with a reason, when a later check refuses them."""
    hit = F.col("publishable") & F.coalesce(refused, F.lit(False))
    return decided.withColumn(
        "quarantine_reason", F.when(hit, reason).otherwise(F.col("quarantine_reason"))
    ).withColumn("publishable", F.col("publishable") & ~hit)


# Semantics of the economy measures.
ECONOMY_SEMANTICS = {
    "gdp_current": ("gdp_current", "current_prices"),
    "gdp_chain_volume": ("gdp_chain_volume", "chain_volume"),
    "gsp_current": ("gsp_current", "current_prices"),
}
RATIO_MEASURE = "tax_to_gdp_ratio"


def backfill_semantics(facts: DataFrame) -> DataFrame:
    """Fill the semantic columns of older facts; a ratio moves out of the money column."""
    ratio = F.col("measure_type") == RATIO_MEASURE
    value = F.coalesce("amount_value", "amount_aud", "quantity")
    family, price = F.col("view_family"), F.col("price_basis")
    unset = F.coalesce(F.col("view_family") == "", F.lit(True))
    for measure, (fam, basis) in ECONOMY_SEMANTICS.items():
        hit = (F.col("measure_type") == measure) & unset
        family = F.when(hit, fam).otherwise(family)
        price = F.when(hit, basis).otherwise(price)
    return facts.select(
        *[c for c in facts.columns if c not in ("amount_value", "scale", "price_basis", "quality_status", "quantity", "amount_aud", "unit", "view_family")],
        value.alias("amount_value"),
        F.coalesce("scale", F.lit("units")).alias("scale"),
        F.when(ratio, "not_applicable").otherwise(F.coalesce(price, F.lit("unspecified"))).alias("price_basis"),
        F.coalesce("quality_status", F.lit("ok")).alias("quality_status"),
        F.when(ratio, F.coalesce("quantity", "amount_aud")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(~ratio, F.col("amount_aud")).alias("amount_aud"),
        F.when(ratio, "percent").otherwise(F.col("unit")).alias("unit"),
        F.when(ratio, "ratios").otherwise(family).alias("view_family"),
    )


def regroup_measures(facts: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """Rows of some measures enter another group."""
    lookup = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return facts.withColumn(
        "compatibility_group", F.coalesce(F.try_element_at(lookup, F.col("measure_type")), F.col("compatibility_group"))
    )


def seed_entities(rows: DataFrame, name: str, fy: str) -> DataFrame:
    """One open-ended entity per name, valid from 1 July of its first year."""
    first = F.min(F.substring(fy, 1, 4))
    return rows.where(F.col(fy).isNotNull()).groupBy(F.col(name).alias("canonical_name")).agg(
        F.concat(first, F.lit("-07-01")).alias("valid_from")
    ).withColumn("valid_to", F.lit(None).cast("string"))


def ratio_facts(numerator: DataFrame, denominator: DataFrame, fy: str = "financial_year") -> DataFrame:
    """Sum over maximum per year in percent, with the keys of both sides as lineage."""
    top = denominator.groupBy(fy).agg(
        F.max("amount_aud").alias("denominator_aud"), F.max_by("fact_key", F.struct("amount_aud", "fact_key")).alias("denominator_key")
    )
    tax = numerator.groupBy(fy).agg(F.sum("amount_aud").alias("numerator_aud"), F.min("fact_key").alias("numerator_key"))
    return tax.join(top.where("denominator_aud > 0"), fy).withColumn(
        "ratio_percent", F.round(F.col("numerator_aud") / F.col("denominator_aud") * 100, 4)
    )


def with_type_totals(leaves: DataFrame, keys: Sequence[str], kind: str, value: str) -> DataFrame:
    """Instrument leaves plus one tagged total per type; the tag keeps totals out of trees."""
    from factline.rules import ROLL_UP_TAG

    totals = leaves.groupBy(*keys, kind).agg(F.sum(value).alias(value)).withColumn("locator", F.lit(ROLL_UP_TAG))
    return leaves.unionByName(totals, allowMissingColumns=True)


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens; text without any gets the head of its hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.substring(F.sha1(name), 1, 12))
