"""Coverage and inventory reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = " / "


def breakdown_coverage(
    crosswalk: DataFrame, nodes: DataFrame, facts: DataFrame, edges: DataFrame, purpose: str, functions: str, components: str, programs: str
) -> DataFrame:
    """Per crosswalk row the size of each layer and the deepest one that exists; one pass over nodes."""
    head = F.split("name", SEP)
    layer = nodes.where(F.size(head) > 1).select(head[0].alias("function"), "source_key", "name", F.size(head).alias("d")).distinct()

    def n(cond):
        return F.count(F.when(cond, 1))

    src = F.col("source_key")
    sizes = layer.groupBy("function").agg(
        n((src == functions) & (F.col("d") == 2)).alias("n_subfunctions"),
        n(src == components).alias("n_components"),
        n(src == programs).alias("n_programs"),
    )
    tops = nodes.where(src.startswith(purpose)).select("node_id", F.col("name").alias("purpose"))
    n_facts = facts.join(tops, "node_id").groupBy("purpose").agg(F.count(F.lit(1)).alias("n_facts"))
    rel = edges.where("edge_kind = 'related_breakdown'").join(tops, edges.parent_id == tops.node_id).groupBy("purpose").agg(F.count_distinct("child_id").alias("n_related"))
    j = crosswalk.join(sizes, "function", "left").join(n_facts, "purpose", "left").join(rel, "purpose", "left")
    j = j.fillna(0, ["n_subfunctions", "n_components", "n_programs", "n_facts", "n_related"])
    deepest = (
        F.when(F.col("n_programs") > 0, "program")
        .when(F.col("n_components") > 0, "component")
        .when(F.col("n_subfunctions") > 0, "subfunction")
        .when(F.col("n_related") > 0, "related_total")
        .otherwise("purpose_only")
    )
    return j.withColumn("deepest", deepest)


# Value buckets of sources, in rank order; the first match wins.
VALUE_RANKS = (
    (10, r"^federal_pbs_|_pbs_", "commonwealth_pbs_program_depth"),
    (20, r"^abs_asna_|^abs_qna_|^abs_state_accounts", "gdp_gva_gsp"),
    (25, r"^abs_taxation", "tax_revenue_detail"),
    (30, r"borrowing|tcorp|tcv|qtc|safa|watc|nttc|tascorp|aofm_", "debt_instruments"),
    (35, r"cfs_|csc_|superannuation|pss_css", "superannuation_liabilities"),
    (40, r"_sds_|agency_statements|budget_tables|budget_paper|budgeted_financial", "state_budget_depth"),
    (50, r"local_|lggc|qao_local|vgc|olg_", "local_government"),
    (60, r"^federal_mfs_", "monthly_financial_statements_slice"),
    (70, r"grantconnect|austender|dss_|ndis_|invoice", "grants_contracts_payments"),
    (90, r".*", "other"),
)


def value_rank(source):
    """Struct ``(rank, bucket)`` of a source id."""
    out = F.lit(None).cast("struct<rank:int,bucket:string>")
    for rank, pattern, bucket in reversed(VALUE_RANKS):
        out = F.when(source.rlike(pattern), F.struct(F.lit(rank).alias("rank"), F.lit(bucket).alias("bucket"))).otherwise(out)
    return out


def family_adapters(rows: DataFrame, datasets: Sequence[Mapping], fact_counts: DataFrame) -> DataFrame:
    """Add ``family`` and ``family_status``: the declared dataset whose shared adapter serves a source, if it has loaded facts.

    A dataset names parts of source ids (``prefixes``), formats it handles (none: all), the keys its facts have, and its status; the
    first that fits counts.  ``rows`` have ``source_id`` and ``formats``, an array; ``fact_counts`` have ``source_key`` and ``n``.
    """
    family, status = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ds in reversed(list(datasets)):
        named = F.lit(False)
        for part in ds["prefixes"]:
            named = named | F.col("source_id").contains(part)
        handled = F.arrays_overlap("formats", F.array(*[F.lit(f) for f in ds["formats"]])) if ds.get("formats") else F.lit(True)
        loaded = fact_counts.where(F.col("source_key").isin(*ds["keys"])).agg(F.coalesce(F.sum("n"), F.lit(0)) > 0).scalar()
        fits = named & F.coalesce(handled, F.lit(False)) & loaded
        family = F.when(fits, ds["dataset_id"]).otherwise(family)
        status = F.when(fits, ds.get("status") or "partially_ingested").otherwise(status)
    return rows.withColumn("family", family).withColumn("family_status", status)


def with_alias_and_origin_counts(rows: DataFrame, aliases: Mapping[str, str], fact_counts: DataFrame, origin_counts: DataFrame) -> DataFrame:
    """Facts of sources that have none of their own: those of the source they duplicate, else those that name them as origin."""
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    canonical = F.try_element_at(pairs, F.col("source_id")) if aliases else F.lit(None).cast("string")
    j = rows.withColumn("canonical_of", canonical)
    j = j.join(fact_counts.select(F.col("source_key").alias("canonical_of"), F.col("n").alias("_alias")), "canonical_of", "left")
    j = j.join(origin_counts.select(F.col("source_key").alias("source_id"), F.col("n").alias("_origin")), "source_id", "left")
    own = F.nullif(F.col("n_facts"), F.lit(0))
    return j.withColumn("n_facts", F.coalesce(own, F.col("_alias"), F.col("_origin"), F.lit(0))).drop("_alias", "_origin")


def classify_sources(
    rows: DataFrame, no_bulk=(), reference=(), aliases: Mapping[str, str] | Sequence[str] = (), aggregator_prefix: str = "federal_pbs_", own_adapter=()
) -> DataFrame:
    """Ingestion status by ordered rules, why there are no facts, what to do next, and the rank of the source's value.

    Needs ``source_id, n_files, n_facts, has_mapping, family_status`` (the status a shared adapter of the
    source's family declares, else null) and may have ``family``, that adapter's dataset.
    """
    sid = F.col("source_id")
    files, facts, mapped = F.col("n_files") > 0, F.col("n_facts") > 0, F.col("has_mapping")
    shared = sid.startswith(aggregator_prefix) & ~sid.isin(*own_adapter) if own_adapter else sid.startswith(aggregator_prefix)
    family = F.col("family") if "family" in rows.columns else F.lit(None).cast("string")
    canonical = F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), sid) if isinstance(aliases, Mapping) and aliases else F.lit("")

    def verdict(status, reason, action):
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(as_column(status).alias("status"), as_column(reason).alias("reason"), as_column(action).alias("action"))

    # Statuses, reasons and actions.
    v = (
        F.when(sid.isin(*no_bulk), verdict("officially_unavailable", "no_public_bulk_export", "leave_as_no_bulk"))
        .when(sid.isin(*reference) & files, verdict("reference_only", "classification_or_index_asset_not_fiscal_time_series", "keep_as_reference"))
        .when(sid.isin(*aliases), verdict("duplicate_source", F.concat(F.lit("canonical="), canonical), "do_not_double_ingest"))
        .when(~files, verdict("not_acquired", "no_latest_json", "acquire_or_exclude"))
        .when(F.col("family_status").isNotNull(), verdict(F.col("family_status"), F.concat(F.lit("covered_via_family_adapter:"), F.coalesce(family, F.lit(""))), "maintain_family_adapter"))
        .when(facts & mapped & shared, verdict("partially_ingested", "covered_via_pbs_programs_all_aggregator", "improve_per_portfolio_lineage"))
        .when(facts & mapped, verdict("fully_ingested", None, "maintain"))
        .when(facts, verdict("partially_ingested", "facts_present_without_dedicated_mapping_file", "add_explicit_mapping"))
        .when(mapped, verdict("adapter_broken", "mapping_or_adapter_exists_but_zero_facts", "fix_or_re_run_adapter"))
        .otherwise(verdict("adapter_missing", "acquired_on_disk_no_ingest_wiring", "build_adapter"))
    )
    out = rows.withColumn("_v", v).withColumn("_r", value_rank(sid))
    return out.select(
        *rows.columns, F.col("_v.status").alias("status"), F.when(~facts, F.col("_v.reason")).alias("reason_for_zero_facts"), F.col("_v.action").alias("next_action"),
        F.col("_r.rank").alias("value_rank"), F.col("_r.bucket").alias("value_bucket"),
    )


def lineage_coverage(datasets: DataFrame, facts: DataFrame) -> DataFrame:
    """Declared status of each dataset, corrected by the facts its keys have."""
    counts = facts.groupBy("source_key").agg(F.count(F.lit(1)).alias("_n"))
    keys = datasets.select("dataset_id", F.explode("source_keys").alias("source_key"))
    n = keys.join(counts, "source_key", "left").groupBy("dataset_id").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("fact_count"))
    j = datasets.join(n, "dataset_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0)))
    has = F.size("source_keys") > 0
    status = (
        F.when(has & (F.col("fact_count") == 0) & (F.col("coverage_status") == "fully_ingested"), "adapter_failed")
        .when(has & (F.col("fact_count") > 0) & (F.col("coverage_status") == "not_acquired"), "partially_ingested")
        .otherwise(F.col("coverage_status"))
    )
    return j.withColumn("coverage_status", status).drop("source_keys")


def cutover(facts: DataFrame, required: DataFrame, reconciliations: DataFrame, citation: list[str]) -> DataFrame:
    """One row of booleans: required sources non-empty, citations complete, nothing unresolved."""
    have = facts.select("source_key").distinct()
    missing = required.join(have, "source_key", "left_anti").agg(F.count(F.lit(1)).alias("n_missing_sources"))
    lacks = F.lit(False)
    for c in citation:
        lacks = lacks | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    out = facts.agg(F.count(F.lit(1)).alias("exposed_facts"), F.count(F.when(lacks, 1)).alias("incomplete_citations"))
    unresolved = reconciliations.where("status = 'unresolved'").agg(F.count(F.lit(1)))
    out = out.withColumn("n_missing_sources", missing.scalar()).withColumn("n_unresolved", unresolved.scalar())
    ok = (F.col("n_missing_sources") == 0) & (F.col("incomplete_citations") == 0) & (F.col("n_unresolved") == 0)
    return out.withColumn("passed", ok)


def quarantine_listing(pending: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a limit is only what a screen shows."""
    rows = pending.orderBy(F.desc("quarantined_at"), "fact_key")
    return rows.limit(limit) if limit else rows


def asset_inventory(manifest: DataFrame, listing: DataFrame, source: str = "source_id", path: str = "path") -> DataFrame:
    """Declared assets against files on disk: present, missing, bytes and a status per source."""
    j = manifest.join(listing.select(path, "n_bytes", F.lit(True).alias("_on")), path, "left")
    g = j.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_assets"),
        F.count("_on").alias("n_present"),
        F.count(F.when(F.col("_on").isNull(), 1)).alias("n_missing"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"),
    )
    status = F.when(F.col("n_missing") == 0, "complete").when(F.col("n_present") > 0, "partial").otherwise("missing")
    return g.withColumn("status", status)


def corpus_inventory(documents: DataFrame, facts: DataFrame, pending: DataFrame, key: str = "source_key") -> DataFrame:
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    j = documents.join(n(facts, "n_facts"), key, "left").join(n(pending, "n_quarantined"), key, "left")
    return j.fillna(0, ["n_facts", "n_quarantined"])


def reprocess_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts before and after a rerun; what each document yielded now."""
    b = before.select(key, F.col("n_facts").alias("before_facts"))
    a = after.select(key, F.col("n_facts").alias("after_facts"), F.col("n_quarantined").alias("after_quarantined"))
    j = b.join(a, key, "full_outer")
    outcome = (
        F.when(F.coalesce("after_facts", F.lit(0)) > 0, "facts").when(F.coalesce("after_quarantined", F.lit(0)) > 0, "quarantine_only").otherwise("zero_yield")
    )
    return j.withColumn("outcome", outcome)


def acquisition_status(rows: DataFrame, no_bulk=(), flaky=(), candidate=()) -> DataFrame:
    """done, flaky, candidate, need, no_bulk or automated, by ordered rules."""
    sid, latest = F.col("source_id"), F.col("has_latest")
    manual = F.col("is_blocked") | F.col("access_method").isin("manual", "web_portal")
    status = (
        F.when(sid.isin(*no_bulk), "no_bulk")
        .when(sid.isin(*flaky) | F.col("known_flaky"), F.when(latest, "done").otherwise("flaky"))
        .when(sid.isin(*candidate) & (F.col("access_method") != "direct_file"), F.when(latest, "done").otherwise("candidate"))
        .when(latest, "done")
        .when(manual, "need")
        .otherwise("automated")
    )
    return rows.withColumn("status", status)


def workbook_inventory(cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shape, title row and header row of every sheet, all their cells whole; files named but absent show as missing."""
    def row(r: int) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("row_no") == r, F.struct("col_no", "value"))))
        return F.array_join(F.transform(found, lambda c: c["value"]), " | ")

    shape = cells.groupBy("source_id", "sheet").agg(
        (F.max("row_no") + 1).alias("n_rows"), (F.max("col_no") + 1).alias("n_cols"), row(0).alias("title_row"), row(1).alias("header_row")
    )
    j = manifest.join(shape, "source_id", "left")
    return j.withColumn("error", F.when(F.col("sheet").isNull(), "file_missing_on_disk"))


def handoff_status(rows: DataFrame, fact_counts: DataFrame) -> DataFrame:
    """Where each handed-over source stands, with facts by exact key, else by containment.

    Containment is tested on source keys, which are few, after an exact match has failed.
    """
    exact = rows.join(fact_counts.select(F.col("source_key").alias("source_id"), F.col("n").alias("_n")), "source_id", "left")
    open_ = exact.where(F.col("_n").isNull()).select("source_id").distinct()
    heads = open_.withColumn("_stem", F.regexp_replace("source_id", "_facts", ""))
    # a key that contains a stem has it among its substrings of that length; only lengths that stems have are cut out
    sizes = heads.agg(F.collect_set(F.length("_stem"))).scalar()
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("source_key") - n + 1), lambda i: F.col("source_key").substr(i, n))
    fitting = F.filter("_sizes", lambda n: (n > 0) & (n <= F.length("source_key")))
    pieces = fact_counts.withColumn("_sizes", sizes).select("source_key", "n", F.explode(F.array_distinct(F.flatten(F.transform(fitting, at)))).alias("_stem"))
    near = heads.join(pieces, "_stem").groupBy("source_id").agg(F.sum("n").alias("_m"))
    j = exact.join(near, "source_id", "left").withColumn("n_facts", F.coalesce("_n", "_m", F.lit(0)))
    status = (
        F.when((F.col("action") == "REFERENCE_ONLY") & ~F.col("present"), "reference_only")
        .when(F.col("present"), F.when(F.col("on_disk"), "already_on_disk").otherwise("downloaded"))
        .when(F.col("action").contains("MANUAL") | F.col("action").contains("BLOCKED"), "blocked_or_manual")
        .otherwise("missing")
    )
    return j.withColumn("status", status).drop("_n", "_m")
