"""Scans, mapping projection, gates and loads (families S, P1-P5, L)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factline.operators import gates, loading
from factline.plans.model import Model, fy_sql, sql
from factline.plans.registry import plan
from factline.session import steps_folder
from factline.sources import mapping as M
from factline.sources import readers, store


def scratch(m: Model, name: str) -> str:
    """A fresh folder on shared storage for what a query writes and reads back."""
    return f"{steps_folder(m.spark)}/{name}-{uuid.uuid4().hex}"


@plan("s1_csv_scan", sql("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL"))
def s1(m: Model):
    folder = scratch(m, "csv")
    m.table("orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount")).write.option("header", True).csv(folder)
    r = readers.read_register(m.spark, folder, "csv")
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@plan("s2_parquet_scan", sql("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL"))
def s2(m: Model):
    li = readers.read_register(m.spark, f"{m.folder}/lineitem.parquet", "parquet")
    return li.where("l_shipdate < timestamp '1998-01-01'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@plan("s3_cell_grid_scan", sql("SELECT 'doc' || doc_id % 7 AS sheet, count(*) AS n_cells, count(DISTINCT line_no) AS n_rows FROM (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS c FROM t) GROUP BY ALL", "t"))
def s3(m: Model):
    sheet = F.concat(F.lit("doc"), (F.col("doc_id") % 7).cast("string"))
    cells = m.text_lines.select(sheet.alias("sheet"), F.col("line_no").alias("row_no"), F.posexplode(F.split("text", " ")).alias("col_no", "value"))
    return cells.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("row_no").alias("n_rows"))


AWARD_SQL = f"""aw AS (SELECT l_orderkey, l_suppkey, l_linenumber, amount, {fy_sql('l_shipdate')} AS financial_year FROM (
  SELECT l_orderkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, l_linenumber, l_shipdate, l_quantity FROM lineitem))"""


def releases(m: Model):
    """One release per item as a JSON line with two awards, as wide as the item itself: nothing is gathered."""
    key = F.col("l_orderkey").cast("string")

    def award(n: str, amount: str):
        return F.struct(
            F.concat_ws("-", key, F.col("l_linenumber").cast("string"), F.lit(n)).alias("id"),
            F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("title"),
            F.when(F.col("l_linenumber") < 7, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
            F.struct(F.col(amount).alias("amount"), F.lit("AUD").alias("currency")).alias("value"),
            F.array(F.struct(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("name"))).alias("suppliers"),
            F.struct(F.concat(F.lit("Buyer "), key).alias("name")).alias("buyer"),
        )

    awards = F.array(award("a", "l_extendedprice"), award("b", "l_quantity"))
    line = F.to_json(F.struct(F.concat(F.lit("ocds-"), key).alias("ocid"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), awards.alias("awards")))
    return m.table("lineitem").select(line.alias("value"))


@plan("s4_json_release_scan", sql("SELECT count(*) AS n_releases, 2 * count(*) AS n_awards, round(sum(l_extendedprice) + sum(l_quantity), 2) AS amount FROM lineitem"))
def s4(m: Model):
    folder = scratch(m, "releases")
    releases(m).write.option("compression", "gzip").text(folder)
    r = readers.read_awards(m.spark, folder)
    per = r.select(F.size("awards").alias("n"), F.aggregate("awards", F.lit(0.0), lambda s, a: s + a["value"]["amount"]).alias("v"))
    return per.agg(F.count(F.lit(1)).alias("n_releases"), F.sum("n").alias("n_awards"), F.round(F.sum("v"), 2).alias("amount"))


@plan("s5_page_text_lines", sql("SELECT source_id, count(*) AS n_lines, sum(length(text)) AS n_chars FROM t GROUP BY ALL", "t").replace("sum(length(text))", "CAST(sum(length(text)) AS BIGINT)"))
def s5(m: Model):
    pages = m.table("documents").select(F.col("source").alias("source_id"), "text")
    return readers.text_lines(pages, ["source_id"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@plan(
    "s6_corpus_scan_with_provenance",
    sql("SELECT 'snapshot=' || CASE WHEN source < 'src15' THEN 2 ELSE 1 END || '/source=' || source AS file_group, count(*) AS n FROM documents GROUP BY ALL"),
)
def s6(m: Model):
    """A corpus in two snapshots; sources up to src15 have a manifest, whose latest snapshot counts, the others fall back to what lies there."""
    folder = scratch(m, "corpus")
    d = m.table("documents").select("doc_id", "source")
    named = F.col("source") < "src15"
    both = d.withColumn("snapshot", F.lit(1)).unionByName(d.where(named).withColumn("snapshot", F.lit(2)))
    both.write.partitionBy("snapshot", "source").parquet(folder)
    group = r"(snapshot=[^/]+/source=[^/]+)/"
    listing = readers.list_files(m.spark, folder).select(F.regexp_extract("path", group, 1).alias("group")).distinct()
    listing = listing.select(F.regexp_extract("group", r"source=(.+)$", 1).alias("source_id"), F.regexp_extract("group", r"snapshot=(\d+)", 1).alias("snapshot"), F.concat(F.lit(f"{folder}/"), "group").alias("path"))
    files = readers.latest_or_glob(listing.where("source_id < 'src15'"), listing)
    corpus = readers.read_chosen(m.spark, folder, files, "parquet")
    return corpus.groupBy(F.regexp_extract("file_path", group, 1).alias("file_group")).agg(F.count(F.lit(1)).alias("n"))


@plan("s8_quarantine_rows", sql("SELECT quarantine_reason, count(*) AS n FROM (SELECT 'Gate 2 types: amount_aud is null' AS quarantine_reason FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL"))
def s8(m: Model):
    folder = scratch(m, "quarantine")
    decided = gates.decide(gate_input(m), GATE_MAPPING)
    bad = gates.quarantined(decided).where("quarantine_reason like '%Gate 2%'").select("fact_key", "quarantine_reason")
    for load in ("a", "a"):  # a load that is run again replaces its own rows
        store.write_quarantine(bad, folder, load)
    back = m.spark.read.schema("fact_key string, quarantine_reason string").json(folder)
    reason = F.regexp_extract("quarantine_reason", r"(Gate 2 types: amount_aud is null)", 1)
    return back.groupBy(reason.alias("quarantine_reason")).agg(F.count(F.lit(1)).alias("n"))


@plan("s9_staging_rows", sql("SELECT source_key, fact_id || ',' || financial_year || ',' || estimate_status AS line FROM f", "f"))
def s9(m: Model):
    folder = scratch(m, "staging")
    rows = m.facts.select("source_key", "fact_id", "financial_year", "estimate_status")
    store.write_staging(rows, folder, "source_key")
    store.write_staging(rows.where("source_key like 'asia%'"), folder, "source_key")  # one family again; the others stay
    back = m.spark.read.option("header", True).schema("fact_id long, financial_year string, estimate_status string, source_key string").csv(folder)
    return back.select("source_key", F.concat_ws(",", F.col("fact_id").cast("string"), "financial_year", "estimate_status").alias("line"))


@plan("s10_report_rows", sql("""SELECT '{"level":"' || level || '","n":' || count(*) || '}' AS value FROM f GROUP BY level""", "f"))
def s10(m: Model):
    folder = scratch(m, "report")
    store.write_report(m.facts.groupBy("level").agg(F.count(F.lit(1)).alias("n")), folder)
    back = m.spark.read.schema("level string, n long, generated_at string").json(folder).where(F.col("generated_at").isNotNull())
    return back.select(F.to_json(F.struct("level", "n")).alias("value"))


@plan(
    "s11_table_counts",
    sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "orders", "lineitem", "events", "documents"))),
)
def s11(m: Model):
    tables = {t: m.table(t) for t in ("region", "nation", "orders", "lineitem", "events", "documents")}
    return readers.table_counts(tables).drop("checksum", "checksum_2")


# Mapping projection

BASE_MAPPING = {
    "source_id": "base_orders",
    "measure_type": "expense_actual",
    "accounting_basis": "accrual",
    "estimate_status": "actual",
    "period_granularity": "financial_year",
    "input": {"path": "files/base.csv", "format": "parquet"},
    "columns": {"amount_aud": "o_totalprice", "node_name": "o_orderpriority", "estimate_status": "literal:", "locator": "o_orderstatus"},
    "attribution": {"landing_url": "https://example.org/a", "cached_copy_path": "files/base.csv"},
}
CHILD_MAPPING = {
    "extends": "base",
    "source_id": "child_orders",
    "columns": {"financial_year": "fy", "unit": "literal:AUD", "file": "file"},
    "attribution": {"cached_copy_path_column": "file"},
}


def order_input(m: Model):
    from factline.functions.years import fy_of_date

    o = m.table("orders")
    file = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("files/"), F.substring("o_orderpriority", 1, 1))).otherwise(" ")
    return o.select("*", fy_of_date(F.col("o_orderdate")).alias("fy"), file.alias("file"))


def file_manifest(m: Model):
    o = m.table("orders")
    per = o.select(F.concat(F.lit("files/"), F.substring("o_orderpriority", 1, 1)).alias("path")).where("path <> 'files/5'").distinct()
    per = per.unionByName(m.local([("files/base.csv",)], "path string"))
    now = per.select("path", F.sha2("path", 256).alias("sha256"), F.lit("2026-01-01T00:00:00Z").alias("retrieved_at"))
    # an earlier retrieval of every path, with a hash that would win by its text
    return now.unionByName(per.select("path", F.repeat(F.lit("f"), 64).alias("sha256"), F.lit("2025-01-01T00:00:00Z").alias("retrieved_at")))


@plan("p1_logical_projection", sql(f"SELECT {fy_sql('o_orderdate')} AS financial_year, o_orderpriority AS node_name, 'AUD' AS unit, count(*) AS n, round(sum(o_totalprice), 2) AS amount_aud FROM orders GROUP BY ALL"))
def p1(m: Model):
    rows = M.project(order_input(m), M.inherit(CHILD_MAPPING, BASE_MAPPING)["columns"])
    return rows.groupBy("financial_year", "node_name", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_aud"), 2).alias("amount_aud"))


@plan("p2_mapping_inheritance", sql("SELECT 'child_orders' AS source_id, 'expense_actual' AS measure_type, count(*) AS n FROM orders"))
def p2(m: Model):
    mapping = M.inherit(CHILD_MAPPING, BASE_MAPPING)
    rows = M.stamp(M.project(order_input(m), mapping["columns"]), mapping)
    return rows.groupBy("source_id", "measure_type").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "p3_row_stamping",
    sql("SELECT CASE WHEN o_orderstatus = 'P' THEN 'budget' ELSE 'actual' END AS estimate_status, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 1 END) AS n_located FROM orders GROUP BY ALL"),
)
def p3(m: Model):
    o = m.table("orders")
    rows = o.select(
        F.when(F.col("o_orderstatus") == "P", " budget ").otherwise("").alias("estimate_status"),
        F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderpriority")).alias("locator"),
    )
    return M.stamp(rows, BASE_MAPPING).groupBy("estimate_status").agg(F.count(F.lit(1)).alias("n"), F.count("locator").alias("n_located"))


@plan(
    "p4_attribution_per_row",
    sql(
        """WITH a AS (SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority NOT LIKE '5%' THEN 'files/' || substr(o_orderpriority, 1, 1) ELSE 'files/base.csv' END AS cached_copy_path FROM orders)
SELECT cached_copy_path, sha256(cached_copy_path) AS sha256, count(*) AS n FROM a GROUP BY ALL"""
    ),
)
def p4(m: Model):
    mapping = M.inherit(CHILD_MAPPING, BASE_MAPPING)
    rows = M.attribute(M.stamp(M.project(order_input(m), mapping["columns"]), mapping), mapping, file_manifest(m))
    return rows.groupBy("cached_copy_path", "sha256").agg(F.count(F.lit(1)).alias("n"))


@plan("p5_fact_key_template", sql(f"SELECT 'child_orders|' || {fy_sql('o_orderdate')} || '|' || o_orderpriority || '|expense_actual|actual' AS fact_key, count(*) AS n FROM orders GROUP BY ALL"))
def p5(m: Model):
    rows = M.extract(order_input(m), M.inherit(CHILD_MAPPING, BASE_MAPPING), file_manifest(m))
    return rows.groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"))


# Gates and loads

GATE_MAPPING = {"measure_type": "expense", "accounting_basis": "cash", "estimate_status": "actual"}
GATE_SQL = """g AS (SELECT fact_key, level, CASE WHEN estimate_status = 'audited_actual' THEN NULL ELSE amount_aud END AS amount_aud,
  CASE WHEN price_basis = 'current_prices' THEN replace(financial_year, '-', '/') ELSE financial_year END AS financial_year,
  CASE WHEN valuation_basis = 'fair_value' THEN ' ' ELSE node_name END AS node_name,
  CASE WHEN accounting_basis = 'accrual' THEN NULL ELSE 'https://example.org' END AS landing_url,
  CASE WHEN quality_status = 'ok' THEN ' ' ELSE locator END AS locator FROM f),
d AS (SELECT *, concat_ws('; ', CASE WHEN amount_aud IS NULL THEN 'Gate 2 types: amount_aud is null' END,
  CASE WHEN NOT regexp_matches(financial_year, '^\\d{4}-\\d{2}$') THEN 'Gate 3 period: bad financial_year: ''' || financial_year || '''' END,
  CASE WHEN trim(node_name) = '' THEN 'Gate 4 node: missing node_name/category' END,
  CASE WHEN landing_url IS NULL AND trim(locator) = '' THEN 'Gate 6 attribution: incomplete citation: [''landing_url'', ''locator'']'
   WHEN landing_url IS NULL THEN 'Gate 6 attribution: incomplete citation: [''landing_url'']'
   WHEN trim(locator) = '' THEN 'Gate 6 attribution: incomplete citation: [''locator'']' END) AS reason FROM g)"""


def gate_input(m: Model):
    c = F.col
    return m.facts.select(
        "fact_key",
        "level",
        F.when(c("estimate_status") != "audited_actual", c("amount_aud")).alias("amount_aud"),
        F.when(c("price_basis") == "current_prices", F.regexp_replace("financial_year", "-", "/")).otherwise(c("financial_year")).alias("financial_year"),
        F.when(c("valuation_basis") == "fair_value", " ").otherwise(c("node_name")).alias("node_name"),
        F.when(c("accounting_basis") != "accrual", "https://example.org").alias("landing_url"),
        F.when(c("quality_status") == "ok", " ").otherwise(c("locator")).alias("locator"),
        F.lit("https://example.org/r").alias("original_resource_url"),
        F.lit("files/a").alias("cached_copy_path"),
        F.lit("ab").alias("sha256"),
        F.lit("2026-01-01").alias("retrieved_at"),
    )


@plan("l2_gate_reasons", sql("WITH " + GATE_SQL + " SELECT level, reason AS quarantine_reason, count(*) AS n FROM d WHERE reason <> '' GROUP BY ALL", "f"))
def l2(m: Model):
    return gates.decide(gate_input(m), GATE_MAPPING).where(~F.col("publishable")).groupBy("level", "quarantine_reason").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "l3_publish_quarantine_split",
    sql("WITH " + GATE_SQL + " SELECT reason = '' AS publishable, financial_year, round(sum(coalesce(amount_aud, 0)), 2) AS amount_aud, count(*) AS n FROM d GROUP BY ALL", "f"),
)
def l3(m: Model):
    decided = gates.decide(gate_input(m), GATE_MAPPING)
    both = (
        gates.published(decided).select(F.lit(True).alias("publishable"), "financial_year", "amount_aud")
        .unionByName(gates.quarantined(decided).select(F.lit(False).alias("publishable"), "financial_year", "amount_aud"))
    )
    return both.groupBy("publishable", "financial_year").agg(F.round(F.sum("amount_aud"), 2).alias("amount_aud"), F.count(F.lit(1)).alias("n"))


OLD_NEW_SQL = """old AS (SELECT o_orderkey AS fact_id, CAST(o_orderkey AS VARCHAR) AS fact_key, 's' || o_orderstatus AS source_key, o_totalprice AS amount_aud, 'old' AS locator,
   CASE WHEN o_orderpriority LIKE '1%' THEN 'face_value' END AS valuation_basis, '2020' AS observation_date FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
neu AS (SELECT o_orderkey AS fact_id, CAST(o_orderkey AS VARCHAR) AS fact_key, 's' || o_orderstatus AS source_key, o_totalprice + CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.004 WHEN '2' THEN 10 ELSE 0 END AS amount_aud,
   CASE WHEN o_orderpriority LIKE '3%' THEN 'new' ELSE 'old' END AS locator, CASE WHEN o_orderpriority LIKE '2%' THEN 'fair_value' END AS valuation_basis, NULL::VARCHAR AS observation_date
   FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P')"""


def old_new(m: Model):
    o, p = m.table("orders"), F.substring("o_orderpriority", 1, 1)
    base = [F.col("o_orderkey").alias("fact_id"), F.col("o_orderkey").cast("string").alias("fact_key"), F.concat(F.lit("s"), "o_orderstatus").alias("source_key")]
    old = o.where("o_orderdate < timestamp '2000-01-01'").select(
        *base, F.col("o_totalprice").alias("amount_aud"), F.lit("old").alias("locator"), F.when(p == "1", "face_value").alias("valuation_basis"), F.lit("2020").alias("observation_date")
    )
    bump = F.when(p == "1", 0.004).when(p == "2", 10.0).otherwise(0.0)
    new = o.where("o_orderdate >= timestamp '1998-01-01' and o_orderstatus <> 'P'").select(
        *base,
        (F.col("o_totalprice") + bump).alias("amount_aud"),
        F.when(p == "3", "new").otherwise("old").alias("locator"),
        F.when(p == "2", "fair_value").alias("valuation_basis"),
        F.lit(None).cast("string").alias("observation_date"),
    )
    return old, new


@plan(
    "l1_keyed_upsert",
    sql(
        "WITH " + OLD_NEW_SQL + """ SELECT coalesce(o.fact_key, n.fact_key) AS fact_key, round(CASE WHEN n.fact_key IS NOT NULL THEN n.amount_aud ELSE o.amount_aud END, 2) AS amount_aud,
 coalesce(n.locator, o.locator) AS locator, coalesce(n.valuation_basis, o.valuation_basis) AS valuation_basis, coalesce(n.observation_date, o.observation_date) AS observation_date
FROM old o FULL JOIN neu n ON o.fact_key = n.fact_key"""
    ),
)
def l1(m: Model):
    old, new = old_new(m)
    merged = loading.upsert(old, new)
    return merged.select("fact_key", F.round("amount_aud", 2).alias("amount_aud"), "locator", "valuation_basis", "observation_date")


@plan("s7_fact_table_after_merge", sql("WITH " + OLD_NEW_SQL + " SELECT source_key, count(*) AS n, round(sum(amount), 1) AS amount_aud FROM (SELECT coalesce(n.source_key, o.source_key) AS source_key, coalesce(n.amount_aud, o.amount_aud) AS amount FROM old o FULL JOIN neu n ON o.fact_key = n.fact_key) GROUP BY ALL"))
def s7(m: Model):
    folder = scratch(m, "facts")
    old, new = (df.withColumn("bucket", F.pmod(F.xxhash64("fact_key"), F.lit(8))) for df in old_new(m))
    for load in (old, new, new):  # the second run of a load changes nothing
        store.merge_facts(m.spark, folder, load, "bucket")
    return m.spark.read.parquet(folder).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_aud"), 1).alias("amount_aud"))


@plan("l4_clear_quarantine_twin", sql("WITH " + OLD_NEW_SQL + " SELECT fact_key FROM old WHERE fact_key NOT IN (SELECT fact_key FROM neu)"))
def l4(m: Model):
    old, new = old_new(m)
    return loading.clear_twins(old.select("fact_key"), new)


@plan("l5_replace_on_reload", sql("WITH " + OLD_NEW_SQL + " SELECT source_key, count(*) AS n, round(sum(amount_aud), 1) AS amount_aud FROM (SELECT * FROM old WHERE source_key NOT IN (SELECT source_key FROM neu) UNION ALL SELECT * FROM neu) GROUP BY ALL"))
def l5(m: Model):
    r = loading.replace_sources(*old_new(m))
    return r.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_aud"), 1).alias("amount_aud"))


@plan("l6_surrogate_dimensions", sql("SELECT count(DISTINCT source_key || '|' || node_name) AS n_nodes, count(DISTINCT source_key || '|' || node_name) AS n_ids FROM f", "f"))
def l6(m: Model):
    key = F.concat_ws("|", "source_key", "node_name").alias("canonical_key")
    wanted = m.facts.select(key, "node_name")
    have = wanted.where("node_name like 'Total%'").dropDuplicates(["canonical_key"]).withColumn("node_id", loading.surrogate(F.col("canonical_key")))
    dim = loading.get_or_create(have, wanted, "canonical_key", "node_id")
    return dim.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("node_id").alias("n_ids"))


@plan(
    "l7_label_to_measure",
    sql(
        """WITH lab AS (SELECT p_name AS label, min(p_type) AS m, count(DISTINCT p_type) AS c FROM part WHERE p_size > 47 GROUP BY ALL)
SELECT CASE WHEN c IS NULL THEN 'unrecognized_label' WHEN c > 1 THEN 'ambiguous_label' END AS reason, CASE WHEN c = 1 THEN m END AS measure_type, count(*) AS n
FROM l LEFT JOIN lab ON p_name = label GROUP BY ALL""",
        "l",
    ),
)
def l7(m: Model):
    labels = m.table("part").where("p_size > 47").select(F.col("p_name").alias("label"), F.col("p_type").alias("measure_type")).distinct()
    rows = m.lines.select(F.col("p_name").alias("label"))
    return loading.classify_labels(rows, labels).groupBy("reason", "measure_type").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "l7_statement_reasons",
    sql(
        """WITH lab AS (SELECT p_name AS label, min(p_type) AS m, count(DISTINCT p_type) AS c FROM part WHERE p_size BETWEEN 48 AND 50 GROUP BY ALL), ex AS (SELECT DISTINCT p_name AS label FROM part WHERE p_size = 1),
r AS (SELECT p_name AS label, fact_id % 10 AS k, l_quantity AS q FROM l)
SELECT CASE WHEN ex.label IS NOT NULL THEN 'excluded_label' WHEN c IS NULL THEN 'unrecognized_label' WHEN c > 1 THEN 'ambiguous_label' WHEN k = 1 THEN 'wrong_sheet' WHEN k = 2 THEN 'wrong_status' WHEN k = 3 THEN 'invalid_reporting_month'
 WHEN k = 4 THEN 'period_end_undeterminable' WHEN k = 5 THEN 'unit_undeterminable' WHEN k = 6 THEN 'missing_source_cell' WHEN q > 25 THEN 'source_file_missing_on_disk' END AS reason, count(*) AS n FROM r LEFT JOIN lab USING (label) LEFT JOIN ex USING (label) GROUP BY ALL""",
        "l",
    ),
)
def l7_reasons(m: Model):
    p = m.table("part").select(F.col("p_name").alias("label"), F.col("p_type").alias("measure_type"), "p_size")
    labels = p.where("p_size >= 48").select("label", "measure_type", F.lit(False).alias("excluded")).unionByName(p.where("p_size = 1").select("label", "measure_type", F.lit(True).alias("excluded"))).distinct()
    k = F.col("fact_id") % 10
    rows = m.lines.select(
        F.col("p_name").alias("label"),
        F.when(k == 1, "Cover").otherwise("Table 1").alias("sheet"),
        F.when(k == 2, "draft").otherwise("actual").alias("estimate_status"),
        F.when(k == 3, "Smarch").otherwise("July").alias("reporting_month"),
        F.when(k == 4, "next year").otherwise(F.col("financial_year")).alias("financial_year"),
        F.when(k == 5, "kg").otherwise("$m").alias("unit"),
        F.when(k == 6, " ").otherwise("A1").alias("locator"),
        F.when(F.col("l_quantity") > 25, "files/gone").otherwise("files/here").alias("cached_copy_path"),
    )
    out = loading.statement_reasons(rows, labels, ["July"], ["Table 1"], ["actual"], m.local([("files/here",)], "path string"))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "l6_document_and_retrieval_dimensions",
    sql("SELECT source_key AS document, count(DISTINCT financial_year) AS n_retrievals, count(*) AS n_facts FROM f GROUP BY ALL", "f"),
)
def l6_documents(m: Model):
    """Documents and their retrievals, part of them known before, looked up for every fact by natural key."""
    facts = m.facts.select("source_key", "financial_year", F.concat_ws("|", "source_key", "financial_year").alias("retrieval_key"))
    known = facts.where("source_key like 'asia%'").select("source_key").distinct().withColumn("document_id", loading.surrogate(F.col("source_key")))
    documents = loading.get_or_create(known, facts.select("source_key"), "source_key", "document_id")
    none = facts.select("retrieval_key").limit(0).withColumn("retrieval_id", loading.surrogate(F.col("retrieval_key")))
    retrievals = loading.get_or_create(none, facts.select("retrieval_key"), "retrieval_key", "retrieval_id")
    j = facts.join(documents, "source_key").join(retrievals, "retrieval_key")
    per = j.groupBy("document_id").agg(F.count_distinct("retrieval_id").alias("n_retrievals"), F.count(F.lit(1)).alias("n_facts"))
    return per.join(documents, "document_id").select(F.col("source_key").alias("document"), "n_retrievals", "n_facts")


@plan(
    "l8_revision_conflicts",
    sql(
        "WITH " + OLD_NEW_SQL + """ SELECT CASE WHEN o.fact_key IS NULL THEN 'insert' WHEN abs(o.amount_aud - n.amount_aud) < 0.01 THEN 'skip' ELSE 'conflict' END AS outcome, n.source_key, count(*) AS n
FROM neu n LEFT JOIN old o USING (fact_key) GROUP BY ALL"""
    ),
)
def l8(m: Model):
    old, new = old_new(m)
    return loading.outcome_counts(loading.revision_outcomes(new, old, with_citation=False), ["source_key"])


SAME_LOAD_SQL = """s AS (SELECT l_orderkey * 100 + l_linenumber AS k, l_partkey * 1000 + l_suppkey AS pos, l_quantity AS a FROM lineitem),
s2 AS (SELECT k, a, pos FROM (SELECT *, row_number() OVER (PARTITION BY k, pos ORDER BY a) AS r FROM s) WHERE r = 1),
fst AS (SELECT k, min(pos) AS fp, arg_min(a, pos) AS fa FROM s2 GROUP BY k)"""


@plan(
    "l9_same_load_conflicts",
    sql("WITH " + SAME_LOAD_SQL + " SELECT CASE WHEN pos = fp THEN 'insert' WHEN abs(a - fa) < 0.01 THEN 'skip' ELSE 'conflict' END AS outcome, count(*) AS n FROM s2 JOIN fst USING (k) GROUP BY ALL"),
)
def l9(m: Model):
    li = m.table("lineitem")
    s = li.groupBy(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("fact_key"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos")
    ).agg(F.min("l_quantity").alias("amount_aud"))
    return loading.outcome_counts(loading.same_load_outcomes(s, "pos"))


@plan(
    "l10_citation_only_update",
    sql(
        "WITH " + OLD_NEW_SQL + """ SELECT n.fact_key, n.locator FROM neu n JOIN old o USING (fact_key) WHERE abs(o.amount_aud - n.amount_aud) < 0.01 AND o.locator IS DISTINCT FROM n.locator"""
    ),
)
def l10(m: Model):
    old, new = old_new(m)
    return loading.revision_outcomes(new, old).where("outcome = 'citation_update'").select("fact_key", "locator")


@plan(
    "l11_load_summary",
    sql(
        "WITH " + OLD_NEW_SQL + """ SELECT CASE WHEN o.fact_key IS NULL THEN 'insert' WHEN abs(o.amount_aud - n.amount_aud) < 0.01 AND o.locator IS DISTINCT FROM n.locator THEN 'citation_update'
 WHEN abs(o.amount_aud - n.amount_aud) < 0.01 THEN 'skip' ELSE 'conflict' END AS outcome, count(*) AS n FROM neu n LEFT JOIN old o USING (fact_key) GROUP BY ALL"""
    ),
)
def l11(m: Model):
    old, new = old_new(m)
    return loading.outcome_counts(loading.revision_outcomes(new, old))


@plan(
    "l13_semantic_backfill",
    sql(
        """WITH b AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'tax_to_gdp_ratio' WHEN 'O' THEN 'gdp_current' ELSE 'other' END AS measure_type, o_totalprice AS a FROM orders)
SELECT measure_type, CASE WHEN measure_type = 'tax_to_gdp_ratio' THEN 'percent' ELSE 'AUD' END AS unit, CASE measure_type WHEN 'tax_to_gdp_ratio' THEN 'not_applicable' WHEN 'gdp_current' THEN 'current_prices' ELSE 'unspecified' END AS price_basis,
 CASE measure_type WHEN 'tax_to_gdp_ratio' THEN 'ratios' WHEN 'gdp_current' THEN 'gdp_current' END AS view_family, round(sum(a), 2) AS amount_value, count(CASE WHEN measure_type <> 'tax_to_gdp_ratio' THEN 1 END) AS n_money FROM b GROUP BY ALL"""
    ),
)
def l13(m: Model):
    none = F.lit(None).cast("string")
    measure = F.when(F.col("o_orderstatus") == "F", "tax_to_gdp_ratio").when(F.col("o_orderstatus") == "O", "gdp_current").otherwise("other")
    facts = m.table("orders").select(
        measure.alias("measure_type"), F.col("o_totalprice").alias("amount_aud"), F.lit("AUD").alias("unit"),
        none.cast("double").alias("amount_value"), none.cast("double").alias("quantity"), none.alias("scale"), none.alias("price_basis"), none.alias("quality_status"), none.alias("view_family"),
    )
    out = loading.backfill_semantics(facts)
    return out.groupBy("measure_type", "unit", "price_basis", "view_family").agg(F.round(F.sum("amount_value"), 2).alias("amount_value"), F.count("amount_aud").alias("n_money"))


@plan("l14_regroup_measure", sql("SELECT CASE WHEN measure_type = 'expense_budget' THEN 'gfs_revenue' ELSE compatibility_group END AS compatibility_group, count(*) AS n FROM f GROUP BY ALL", "f"))
def l14(m: Model):
    return loading.regroup_measures(m.facts, {"expense_budget": "gfs_revenue"}).groupBy("compatibility_group").agg(F.count(F.lit(1)).alias("n"))


@plan("l15_entity_seeding", sql(f"SELECT c_name AS canonical_name, min(substr({fy_sql('o_orderdate')}, 1, 4)) || '-07-01' AS valid_from, NULL::VARCHAR AS valid_to FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"))
def l15(m: Model):
    from factline.functions.years import fy_of_date

    o, c = m.table("orders"), m.table("customer")
    return loading.seed_entities(o.join(c, o.o_custkey == c.c_custkey).select("c_name", fy_of_date(F.col("o_orderdate")).alias("fy")), "c_name", "fy")


@plan(
    "l16_derived_ratio",
    sql(
        """WITH t AS (SELECT financial_year, sum(amount_aud) AS a, min(fact_key) AS k FROM f WHERE estimate_status = 'actual' GROUP BY ALL),
g AS (SELECT financial_year, max(amount_aud) AS b, arg_max(fact_key, {'a': amount_aud, 'k': fact_key}) AS dk FROM f WHERE estimate_status = 'audited_actual' GROUP BY ALL)
SELECT financial_year, round(round(a, 2) / b * 100, 4) AS ratio_percent, k AS numerator_key, dk AS denominator_key FROM t JOIN g USING (financial_year) WHERE b > 0""",
        "f",
    ),
)
def l16(m: Model):
    num, den = m.facts.where("estimate_status = 'actual'"), m.facts.where("estimate_status = 'audited_actual'")
    r = loading.ratio_facts(num, den)
    exact = F.round(F.round("numerator_aud", 2) / F.col("denominator_aud") * 100, 4)
    return r.select("financial_year", exact.alias("ratio_percent"), "numerator_key", "denominator_key")


@plan(
    "l17_instrument_totals",
    sql(
        """WITH g AS (SELECT l_suppkey AS authority, p_type AS instrument_type, p_name AS name, sum(amount_aud) AS amount_aud FROM l GROUP BY ALL)
SELECT authority, instrument_type, name, NULL::VARCHAR AS locator, round(amount_aud, 2) AS amount_aud FROM g
UNION ALL SELECT authority, instrument_type, NULL, 'roll_up:sum_instruments', round(sum(amount_aud), 2) FROM g GROUP BY ALL""",
        "l",
    ),
)
def l17(m: Model):
    g = m.lines.groupBy(F.col("l_suppkey").alias("authority"), F.col("p_type").alias("instrument_type"), F.col("p_name").alias("name")).agg(F.sum("amount_aud").alias("amount_aud"))
    out = loading.with_type_totals(g, ["authority"], "instrument_type", "amount_aud")
    return out.select("authority", "instrument_type", "name", "locator", F.round("amount_aud", 2).alias("amount_aud"))


@plan(
    "l18_slug_identity",
    sql("SELECT coalesce(nullif(regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') AS slug, count(*) AS n FROM customer GROUP BY ALL"),
)
def l18(m: Model):
    c = m.table("customer")
    return c.groupBy(loading.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))
