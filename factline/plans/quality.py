"""Reconciliation, integrity, hygiene and coverage (family Q), with the label classifier they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import labels as L
from factline.operators import gates, loading
from factline.plans.model import Model, sql
from factline.plans.registry import plan
from factline.quality import audit as AU
from factline.quality import coverage as CO
from factline.quality import hygiene as H
from factline.quality import integrity as I
from factline.quality import reconcile as R
from factline.session import cut_lineage, tasks_for

# Label shapes made from parts; each shape has a known class.
LABEL_SQL = """lab AS (SELECT p_partkey, p_type, p_brand, p_size, CASE p_size % 13
  WHEN 0 THEN 'Program ' || p_size || '.1: ' || p_name WHEN 1 THEN 'Outcome 3 - ' || p_name WHEN 2 THEN '1.2.' || p_size || ' - Component 2 ' || p_name WHEN 3 THEN 'Total ' || p_name
  WHEN 4 THEN p_name WHEN 5 THEN 'EXPENSES ' || p_name WHEN 6 THEN 'Employee benefits' WHEN 7 THEN p_brand || ' 1,234 2,345,678 (12)' WHEN 8 THEN '2024-25  2025-26'
  WHEN 9 THEN '$''000 $m' WHEN 10 THEN 'Key cost category / Workforce' WHEN 11 THEN 'Farm Support Act 2014' ELSE p_type || ' ' || p_name END AS label,
  CASE p_size % 13 WHEN 0 THEN 'program' WHEN 1 THEN 'outcome' WHEN 2 THEN 'component' WHEN 3 THEN 'total' WHEN 4 THEN 'narrative_fragment' WHEN 5 THEN 'table_header'
  WHEN 6 THEN 'financial_statement_line' WHEN 7 THEN 'malformed_concatenated_row' WHEN 8 THEN 'year_header' WHEN 9 THEN 'unit_header' WHEN 10 THEN 'unknown' WHEN 11 THEN 'narrative_fragment' ELSE 'program' END AS label_class,
  CASE p_size % 13 WHEN 3 THEN 'total_or_subtotal_line' WHEN 4 THEN 'starts_lowercase' WHEN 5 THEN 'accounting_heading_no_values' WHEN 6 THEN 'known_line_item_vocabulary' WHEN 7 THEN 'three_or_more_embedded_value_tokens'
  WHEN 8 THEN 'year_sequence_only' WHEN 9 THEN 'unit_marker_only' WHEN 10 THEN 'key_cost_category_not_in_verified_whitelist' WHEN 11 THEN 'bare_legislative_citation' END AS rejection FROM part)"""


def labelled(m: Model):
    c, size = F.col, F.col("p_size")
    shapes = [
        F.concat(F.lit("Program "), size.cast("string"), F.lit(".1: "), c("p_name")),
        F.concat(F.lit("Outcome 3 - "), c("p_name")),
        F.concat(F.lit("1.2."), size.cast("string"), F.lit(" - Component 2 "), c("p_name")),
        F.concat(F.lit("Total "), c("p_name")),
        c("p_name"),
        F.concat(F.lit("EXPENSES "), c("p_name")),
        F.lit("Employee benefits"),
        F.concat(c("p_brand"), F.lit(" 1,234 2,345,678 (12)")),
        F.lit("2024-25  2025-26"),
        F.lit("$'000 $m"),
        F.lit("Key cost category / Workforce"),
        F.lit("Farm Support Act 2014"),
        F.concat_ws(" ", "p_type", "p_name"),
    ]
    return m.table("part").select("p_partkey", "p_type", "p_brand", "p_size", F.element_at(F.array(*shapes), size % 13 + 1).alias("label"))


@plan("p42_label_classifier", sql("WITH " + LABEL_SQL + " SELECT label, label_class, rejection, count(*) AS n FROM lab GROUP BY ALL"))
def p42(m: Model):
    c = L.with_class(labelled(m).groupBy("label").agg(F.count(F.lit(1)).alias("n")), F.col("label"))
    return c.select("label", "c.label_class", "c.rejection", "n")


@plan(
    "p42_document_line_classes",
    sql(
        r"""WITH s AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM t), k AS (SELECT x, len(regexp_extract_all(x, '-?\(?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(\d+(?:\.\d+)?\)')) AS v FROM s)
SELECT CASE WHEN x = '' THEN 'empty' WHEN v >= 3 THEN 'values' WHEN regexp_matches(x, '(^|[^\d.])-?\d{1,4}(\s+-?\d{1,4}){2,}($|[^\d.])') THEN 'run' ELSE 'rest' END AS first_test, count(*) AS n FROM k GROUP BY ALL""",
        "t",
    ),
)
def p42_lines(m: Model):
    rejection = F.coalesce("c.rejection", F.lit("none"))
    first = (
        F.when(rejection == "empty_label", "empty")
        .when(rejection == "three_or_more_embedded_value_tokens", "values")
        .when(rejection == "embedded_bare_numeric_run", "run")
        .otherwise("rest")
    )
    # equal lines are classified once, and the shuffle that finds them deals the rest evenly
    lines = m.text_lines.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return L.with_class(lines, F.col("text")).groupBy(first.alias("first_test")).agg(F.sum("n").alias("n"))


@plan("p43_classified_segment", sql("WITH " + LABEL_SQL + """ SELECT CASE WHEN p_size % 13 = 10 THEN label ELSE label END AS segment, count(*) AS n FROM lab GROUP BY ALL"""))
def p43(m: Model):
    path = F.concat_ws(" / ", "p_type", "p_brand", "label")
    return labelled(m).groupBy(L.classified_segment(path).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "l12_label_quality_gate",
    sql(
        "WITH " + LABEL_SQL + """ SELECT p_size > 3 AND label_class IN ('program', 'outcome', 'component') AS publishable, CASE WHEN p_size <= 3 THEN 'Gate 2 types: amount_aud is null'
 WHEN label_class NOT IN ('program', 'outcome', 'component') THEN 'label:' || label_class || ':' || rejection END AS quarantine_reason, count(*) AS n FROM lab GROUP BY ALL"""
    ),
)
def l12(m: Model):
    rows = labelled(m).select(
        "label", F.lit("1999-00").alias("financial_year"), F.when(F.col("p_size") > 3, 1.0).alias("amount_aud"), F.col("label").alias("node_name"), F.lit("x").alias("locator"),
        *[F.lit("x").alias(c) for c in ("landing_url", "original_resource_url", "cached_copy_path", "sha256", "retrieved_at")],
    )
    decided = L.with_class(gates.decide(rows, {"measure_type": "a", "accounting_basis": "b", "estimate_status": "c"}), F.col("label"))
    out = loading.downgrade(decided, ~L.publishable(F.col("c.label_class")), F.concat_ws(":", F.lit("label"), "c.label_class", "c.rejection"))
    return out.groupBy("publishable", "quarantine_reason").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q1_constraint_violations",
    sql(
        """SELECT 'enum:estimate_status' AS rule, count(*) FILTER (estimate_status NOT IN ('actual', 'audited_actual', 'estimated_actual', 'budget', 'revised_estimate', 'award', 'contract')) AS n_violations FROM f
UNION ALL SELECT 'enum:accounting_basis', count(*) FILTER (accounting_basis NOT IN ('accrual', 'cash', 'gfs', 'commitment')) FROM f
UNION ALL SELECT 'not_null:valuation_basis', count(*) FILTER (valuation_basis IS NULL) FROM f
UNION ALL SELECT 'either:observation_date,quality_status', count(*) FILTER (observation_date IS NULL AND quality_status IS NULL) FROM f""",
        "f",
    ),
)
def q1(m: Model):
    enums = dict(I.ENUMS)
    enums["estimate_status"] = tuple(s for s in enums["estimate_status"] if s != "forward_estimate")
    return I.constraint_violations(m.facts, enums, ["valuation_basis"], ["observation_date", "quality_status"])


RECON_SQL = """b AS (SELECT source_key, financial_year, CASE WHEN source_key LIKE '%machinery' THEN amount_aud * 1.01 ELSE amount_aud END AS amount_aud, fact_id FROM f WHERE NOT (source_key LIKE '%furniture' AND financial_year = '1998-99')),
lt AS (SELECT source_key, financial_year, round(sum(amount_aud), 2) AS left_total FROM f GROUP BY ALL),
rt AS (SELECT source_key, financial_year, round(sum(CASE WHEN source_key LIKE '%building' THEN amount_aud + 0.01 ELSE amount_aud END), 2) AS right_total FROM b GROUP BY ALL),
rec AS (SELECT source_key, financial_year, left_total, right_total, round(left_total - coalesce(right_total, 0), 2) AS difference_amount_aud, CASE WHEN right_total IS NULL THEN 'unresolved' WHEN abs(round(left_total - right_total, 2)) < 1e-9 THEN 'balanced'
  WHEN abs(round(left_total - right_total, 2)) <= 5 THEN 'within_tolerance' ELSE 'explained_difference' END AS status FROM lt LEFT JOIN rt USING (source_key, financial_year))"""


def reconciliation(m: Model):
    s = F.col("source_key")
    right = m.facts.where(~(s.endswith("furniture") & (F.col("financial_year") == "1998-99")))
    amount = F.when(s.endswith("machinery"), F.col("amount_aud") * 1.01).when(s.endswith("building"), F.col("amount_aud") + 0.01).otherwise(F.col("amount_aud"))
    return R.source_totals(m.facts, right.withColumn("amount_aud", amount), ["source_key", "financial_year"], 5.0)


@plan("q2_source_total_reconciliation", sql("WITH " + RECON_SQL + " SELECT source_key, financial_year, left_total, status FROM rec", "f"))
def q2(m: Model):
    return reconciliation(m).select("source_key", "financial_year", "left_total", "status")


@plan(
    "q3_control_against_detail",
    sql(
        """WITH c AS (SELECT jurisdiction, financial_year, round(sum(amount_aud), 2) AS control_amount FROM f WHERE estimate_status = 'audited_actual' GROUP BY ALL),
d AS (SELECT jurisdiction, financial_year, round(sum(amount_aud), 2) AS detail_sum FROM f WHERE estimate_status = 'actual' GROUP BY ALL)
SELECT jurisdiction, financial_year, control_amount, coalesce(detail_sum, 0) AS detail_sum, CASE WHEN control_amount <= 0 THEN 'no_control' WHEN abs(round(coalesce(detail_sum, 0) - control_amount, 2)) / control_amount * 100 > 5 THEN 'warning' ELSE 'ok' END AS status
FROM c LEFT JOIN d USING (jurisdiction, financial_year)""",
        "f",
    ),
)
def q3(m: Model):
    out = R.control_against_detail(m.facts.where("estimate_status = 'audited_actual'"), m.facts.where("estimate_status = 'actual'"), ["jurisdiction", "financial_year"])
    return out.select("jurisdiction", "financial_year", "control_amount", "detail_sum", "status")


@plan(
    "q4_leaves_against_control",
    sql(
        """WITH d AS (SELECT region AS source_key, amount_aud, 'Debt / A / ' || node_name AS node_name, CASE WHEN p_type = 'PROMO' THEN 'individual_security' WHEN p_type IN ('SMALL', 'LARGE') THEN 'instrument_type_aggregate' END AS g,
  CASE WHEN p_brand = 'Brand#1' THEN 'roll_up:sum_instruments' ELSE 'x' END AS loc FROM l),
lf AS (SELECT source_key, round(sum(amount_aud), 2) AS leaf_sum, count(*) AS n_leaves FROM d WHERE loc = 'x' AND (g = 'individual_security' OR (g = 'instrument_type_aggregate' AND length(node_name) - length(replace(node_name, '/', '')) >= 3)
  OR (g IS NULL AND length(node_name) - length(replace(node_name, '/', '')) >= 2)) GROUP BY ALL),
c AS (SELECT region AS source_key, round(sum(amount_aud) * 0.9, 2) AS control_aud FROM l GROUP BY ALL)
SELECT source_key, leaf_sum, n_leaves, CASE WHEN abs(leaf_sum - control_aud) / control_aud * 100 <= 0.5 THEN 'pass' WHEN abs(leaf_sum - control_aud) / control_aud * 100 <= 2 THEN 'warning' ELSE 'failure' END AS status FROM c JOIN lf USING (source_key)""",
        "l",
    ),
)
def q4(m: Model):
    facts = m.lines.select(
        F.col("region").alias("source_key"),
        "amount_aud",
        F.concat(F.lit("Debt / A / "), "node_name").alias("node_name"),
        F.when(F.col("p_type") == "PROMO", "individual_security").when(F.col("p_type").isin("SMALL", "LARGE"), "instrument_type_aggregate").alias("amount_granularity"),
        F.when(F.col("p_brand") == "Brand#1", "roll_up:sum_instruments").otherwise("x").alias("locator"),
    )
    control = m.lines.groupBy(F.col("region").alias("source_key")).agg(F.round(F.sum("amount_aud") * 0.9, 2).alias("control_aud"))
    return R.leaves_against_control(facts, control, "source_key").select("source_key", "leaf_sum", "n_leaves", "status")


@plan("q5_reconciliation_summary", sql("WITH " + RECON_SQL + " SELECT status, count(*) AS n FROM rec GROUP BY ALL", "f"))
def q5(m: Model):
    return R.status_summary(reconciliation(m)).select("status", "n")


DUP_SQL = """fa AS (SELECT fact_id, jurisdiction AS source_key, node_name AS node_path, financial_year, measure_type, estimate_status, l_quantity AS amount_aud FROM l),
dup AS (SELECT source_key, node_path, financial_year, measure_type, estimate_status, amount_aud, count(DISTINCT fact_id) AS n_facts, min(fact_id) AS first_fact, max(fact_id) AS last_fact FROM fa GROUP BY ALL HAVING count(DISTINCT fact_id) > 1)"""


def dup_groups(m: Model):
    fa = m.lines.select("fact_id", F.col("jurisdiction").alias("source_key"), F.col("node_name").alias("node_path"), "financial_year", "measure_type", "estimate_status", F.col("l_quantity").alias("amount_aud"))
    return I.duplicate_facts(fa, ["source_key", "node_path", "financial_year", "measure_type", "estimate_status", "amount_aud"])


@plan("q6_duplicate_facts", sql("WITH " + DUP_SQL + " SELECT * FROM dup", "l"))
def q6(m: Model):
    return dup_groups(m)


@plan(
    "q7_reviewed_duplicates",
    sql("WITH " + DUP_SQL + " SELECT financial_year, CASE WHEN estimate_status = 'actual' AND amount_aud < 10 THEN 'reviewed' ELSE 'unresolved' END AS review, CASE WHEN estimate_status = 'actual' AND amount_aud < 10 THEN 'distinct awards' END AS reason, count(*) AS n FROM dup GROUP BY ALL", "l"),
)
def q7(m: Model):
    g = dup_groups(m)
    near = F.when(F.col("amount_aud") < 10, F.col("amount_aud") + 1e-7).otherwise(F.col("amount_aud") + 0.5)
    registry = g.where("estimate_status = 'actual'").select("source_key", "node_path", "financial_year", "measure_type", "estimate_status", near.alias("amount_aud"), F.lit("distinct awards").alias("reason"))
    return I.partition_reviewed(g, registry).groupBy("financial_year", "review", "reason").agg(F.count(F.lit(1)).alias("n"))


@plan("q8_null_safe_duplicate_edges", sql("SELECT user_id AS parent_id, event_type AS child_id, CASE WHEN value > 50 THEN '2024' END AS financial_year, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1"))
def q8(m: Model):
    e = m.table("events").select(
        F.col("user_id").alias("parent_id"), F.col("event_type").alias("child_id"), F.lit("same_group").alias("edge_kind"),
        F.when(F.col("value") > 50, "2024").alias("financial_year"), F.lit(None).cast("string").alias("crosswalk_id"),
    )
    return I.duplicate_edges(e).select("parent_id", "child_id", "financial_year", "n")


@plan(
    "q9_orphans",
    sql(
        """SELECT 'orphan_facts' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'orphan_nodes', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey NOT IN (SELECT l_suppkey FROM lineitem) AND c_custkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)
UNION ALL SELECT 'orphan_edges', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer) OR l_suppkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'dangling_documents', count(*) FROM (SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) AND source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 8000))"""
    ),
)
def q9(m: Model):
    d, lab, li = m.table("documents").select("doc_id", "source", "lang", "n_chars"), m.table("labels"), m.table("lineitem")
    facts = I.orphan_facts(d.select(F.col("doc_id").alias("fact_id")), lab.select(F.col("doc_id").alias("fact_id")))
    nodes = m.table("customer").select(F.col("c_custkey").alias("node_id"))
    bridge = m.table("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("node_id"))
    e1 = li.select(F.col("l_suppkey").alias("parent_id"), F.col("l_suppkey").alias("child_id"))
    e2 = li.where("l_quantity > 30").select(F.col("l_partkey").alias("parent_id"), F.col("l_partkey").alias("child_id"))
    edges = li.select(F.col("l_suppkey").alias("parent_id"), F.col("l_partkey").alias("child_id")).distinct()
    toxic = d.join(lab.where("toxic = 1"), "doc_id", "left_semi").select(F.col("source").alias("source_key"))
    long_es = d.where("lang = 'es' and n_chars > 8000").select(F.col("source").alias("source_key"))
    docs = I.dangling_documents(d.select(F.col("source").alias("source_key")).distinct(), toxic, long_es)
    parts = {"orphan_facts": facts, "orphan_nodes": I.orphan_nodes(nodes, bridge, e1, e2), "orphan_edges": I.orphan_edges(edges, nodes), "dangling_documents": docs}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


TRADE_SQL = """e AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
x AS (SELECT ps.level AS pl, pc.level AS cl, ps.jurisdiction AS pj, pc.jurisdiction AS cj FROM e JOIN supplier ON s = s_suppkey JOIN customer ON c = c_custkey JOIN p AS ps ON s_nationkey = ps.nation_key JOIN p AS pc ON c_nationkey = pc.nation_key)"""


def trade(m: Model):
    li, o = m.table("lineitem").where("l_returnflag = 'A'"), m.table("orders")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("parent_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("child_id")).distinct()
    pl = m.places.select("nation_key", "level", "jurisdiction")
    s = m.table("supplier").join(pl, F.col("s_nationkey") == F.col("nation_key")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), "level", "jurisdiction")
    c = m.table("customer").join(pl, F.col("c_nationkey") == F.col("nation_key")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), "level", "jurisdiction")
    return e.withColumn("edge_kind", F.lit("same_group")), s.unionByName(c)


@plan("q10_crossing_additive_edges", sql("WITH " + TRADE_SQL + " SELECT 'level' AS attribute, pl AS parent_value, cl AS child_value, count(*) AS n FROM x WHERE pl <> cl GROUP BY ALL UNION ALL SELECT 'jurisdiction', pj, cj, count(*) FROM x WHERE pj <> cj GROUP BY ALL", "p"))
def q10(m: Model):
    e, n = trade(m)
    parts = [I.crossing_edges(e, n, a).groupBy(F.lit(a).alias("attribute"), "parent_value", "child_value").agg(F.count(F.lit(1)).alias("n")) for a in ("level", "jurisdiction")]
    return parts[0].unionByName(parts[1])


# Only the last path segment is shown and judged, so "Key cost category / Workforce" is judged as "Workforce".
@plan("q11_rejected_labels_on_edges", sql("WITH " + LABEL_SQL + " SELECT p_type AS parent, label_class, count(*) AS n FROM lab WHERE label_class NOT IN ('program', 'outcome', 'component') AND label_class <> 'unknown' GROUP BY ALL"))
def q11(m: Model):
    c = L.with_class(labelled(m), F.element_at(F.split(F.concat_ws(" / ", "p_type", "label"), " / "), -1))
    bad = c.where(~L.publishable(F.col("c.label_class")))
    return bad.groupBy(F.col("p_type").alias("parent"), F.col("c.label_class").alias("label_class")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q12_hard_failures",
    sql(
        "WITH " + DUP_SQL + """, c AS (SELECT 'duplicate_facts' AS "check", count(*) AS n FROM dup WHERE NOT (estimate_status = 'actual' AND amount_aud < 10) UNION ALL SELECT 'orphan_facts', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT * FROM c UNION ALL SELECT 'hard_failures', CAST(sum(n) AS BIGINT) FROM c""",
        "l",
    ),
)
def q12(m: Model):
    g = dup_groups(m)
    registry = g.where("estimate_status = 'actual' and amount_aud < 10").withColumn("reason", F.lit("x"))
    open_ = I.partition_reviewed(g, registry).where("review = 'unresolved'")
    orphans = m.table("documents").select("doc_id").join(m.table("labels"), "doc_id", "left_anti")
    return I.hard_failures({"duplicate_facts": open_, "orphan_facts": orphans})


def pairs(m: Model):
    """Orders as parents and their items as children, with the item's label shape."""
    li, s = m.table("lineitem"), m.table("supplier")
    pl = m.places.select("nation_key", F.col("level").alias("child_level"), F.col("jurisdiction").alias("child_jurisdiction"))
    sup = s.join(pl, F.col("s_nationkey") == F.col("nation_key")).select("s_suppkey", "child_level", "child_jurisdiction")
    from factline.functions.years import fy_of_date

    f = m.facts.select(
        F.col("fact_id").alias("l_orderkey"), F.col("level").alias("requested_level"), F.when(F.col("price_basis") == "current_prices", F.col("jurisdiction")).alias("requested_jurisdiction"),
        F.col("compatibility_group").alias("parent_group"), F.col("amount_aud").alias("parent_amount"), F.col("financial_year").alias("parent_fy"),
        F.when(F.col("valuation_basis") == "fair_value", "").otherwise(F.col("locator")).alias("locator"), "source_key", F.col("node_name").alias("node_path"), "estimate_status",
    )
    judged = L.with_class(labelled(m), F.col("label")).withColumn("label_class", F.col("c.label_class")).drop("c")
    j = li.join(f, "l_orderkey").join(sup, li.l_suppkey == sup.s_suppkey).join(judged, li.l_partkey == F.col("p_partkey"))
    return j.select(
        "requested_level", "child_level", "requested_jurisdiction", "child_jurisdiction", "parent_group",
        F.when(F.col("l_returnflag") == "N", "budget_expense").otherwise("actual_expense").alias("child_group"),
        "parent_amount", (F.col("l_extendedprice") * 10).alias("child_amount"), "parent_fy", fy_of_date(F.col("l_shipdate")).alias("child_fy"),
        F.when(F.col("p_type") == "PROMO", "related_breakdown").otherwise("additive").alias("kind"), "label", "label_class", "locator", "source_key", "node_path", "estimate_status",
    )


PAIR2_SQL = """pr AS (SELECT f.level AS requested_level, p.level AS child_level, CASE WHEN f.price_basis = 'current_prices' THEN f.jurisdiction END AS requested_jurisdiction, p.jurisdiction AS child_jurisdiction, f.compatibility_group AS parent_group,
  CASE WHEN l_returnflag = 'N' THEN 'budget_expense' ELSE 'actual_expense' END AS child_group, f.amount_aud AS parent_amount, l_extendedprice * 10 AS child_amount, f.financial_year AS parent_fy, {fy} AS child_fy,
  CASE WHEN p_type = 'PROMO' THEN 'related_breakdown' ELSE 'additive' END AS kind, label, label_class, CASE WHEN f.valuation_basis = 'fair_value' THEN '' ELSE f.locator END AS locator, f.source_key, f.node_name AS node_path, f.estimate_status
  FROM lineitem JOIN f ON l_orderkey = f.fact_id JOIN supplier ON l_suppkey = s_suppkey JOIN p ON s_nationkey = p.nation_key JOIN lab ON lab.p_partkey = l_partkey)"""


def _pair_sql() -> str:
    from factline.plans.model import fy_sql

    return LABEL_SQL + ", " + PAIR2_SQL.format(fy=fy_sql("l_shipdate"))


@plan(
    "q13_traversal_audit",
    sql(
        "WITH " + _pair_sql() + """, b AS (SELECT 'scope' AS bucket FROM pr WHERE kind = 'additive' AND child_level <> requested_level UNION ALL SELECT 'jurisdiction' FROM pr WHERE kind = 'additive' AND requested_jurisdiction IS NOT NULL AND NOT contains(lower(child_jurisdiction), lower(requested_jurisdiction))
UNION ALL SELECT 'edge_kind' FROM pr WHERE kind = 'additive' AND parent_group <> child_group UNION ALL SELECT 'additive_over_parent' FROM pr WHERE kind = 'additive' AND child_amount / parent_amount > 1 + 1e-9
UNION ALL SELECT CASE WHEN child_fy > parent_fy THEN 'cross_year_future' ELSE 'cross_year' END FROM pr WHERE kind = 'additive' AND child_fy <> parent_fy UNION ALL SELECT 'label_quality' FROM pr WHERE label_class NOT IN ('program', 'outcome', 'component') UNION ALL SELECT 'citation' FROM pr WHERE locator = '')
SELECT bucket, count(*) AS n FROM b GROUP BY ALL""",
        "f", "p",
    ),
)
def q13(m: Model):
    return AU.traversal_failures(pairs(m)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q14_accepted_residuals",
    sql(
        "WITH " + _pair_sql() + """ SELECT source_key, CASE WHEN estimate_status = 'actual' AND child_amount / parent_amount - 1 <= 0.5 + 1e-9 THEN 'accepted' ELSE 'failure' END AS verdict, count(*) AS n
FROM pr WHERE kind = 'additive' AND child_amount / parent_amount > 1 + 1e-9 GROUP BY ALL""",
        "f", "p",
    ),
)
def q14(m: Model):
    keys = ["source_key", "node_path", "parent_fy", "estimate_status"]
    over = AU.traversal_failures(pairs(m)).where("bucket = 'additive_over_parent'")
    registry = m.facts.where("estimate_status = 'actual'").select("source_key", F.col("node_name").alias("node_path"), F.col("financial_year").alias("parent_fy"), "estimate_status").distinct().withColumn("expected_max_variance", F.lit(0.5))
    return AU.accept_residuals(over, registry, keys).groupBy("source_key", "verdict").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q15_duplicate_deletion_plan",
    sql(
        """WITH pr AS (SELECT o_orderkey // 2 AS g, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) AS p0, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END) AS s1, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS s0 FROM orders GROUP BY ALL),
rf AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 48)
SELECT CASE WHEN s1 IS NULL OR s1 = 'P' THEN 'already_resolved' WHEN s0 = 'P' THEN 'error:retain_missing' WHEN p0 LIKE '1%' THEN 'error:stale_identity' WHEN p0 LIKE '2%' THEN 'error:different_nodes' WHEN rf.l_orderkey IS NOT NULL THEN 'error:referenced' ELSE 'would_delete' END AS status, count(*) AS n
FROM pr LEFT JOIN rf ON rf.l_orderkey = g * 2 + 1 GROUP BY ALL"""
    ),
)
def q15(m: Model):
    o, k = m.table("orders"), F.col("o_orderkey")
    g = F.floor(k / 2).cast("long")
    odd = k % 2 == 1
    pair = o.groupBy(g.alias("g")).agg(F.max(F.when(~odd, F.col("o_orderpriority"))).alias("p0"))
    ident = lambda gcol: [
        F.lit("1999-00").alias("financial_year"), F.lit("m").alias("measure_type"), F.lit("actual").alias("estimate_status"), gcol.cast("double").alias("amount_aud"),
        F.concat(F.lit("n"), gcol.cast("string")).alias("node_path"), F.lit("s").alias("source_key"),
    ]
    live = o.where("o_orderstatus <> 'P'").withColumn("g", g).join(pair, "g")
    node = F.when(odd & F.col("p0").startswith("2"), F.concat(F.lit("other"), F.col("g").cast("string"))).otherwise(F.col("g").cast("string"))
    facts = live.select(k.cast("string").alias("fact_key"), node.alias("node_id"), *ident(F.col("g")))
    stale = F.when(F.col("p0").startswith("1"), F.col("g") + 1).otherwise(F.col("g"))
    entries = pair.select((F.col("g") * 2).cast("string").alias("retain_fact_key"), (F.col("g") * 2 + 1).cast("string").alias("delete_fact_key"), *ident(stale))
    refs = m.table("lineitem").where("l_quantity > 48").select(F.col("l_orderkey").cast("string").alias("fact_key"))
    return H.deletion_plan(entries, facts, refs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q16_orphan_node_plan",
    sql("SELECT c_mktsegment AS source_key, count(*) AS n_orphans, min('c' || c_custkey) AS first_node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 49) GROUP BY ALL"),
)
def q16(m: Model):
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("node_id")
    nodes = m.table("customer").select(key("c_custkey"), F.col("c_mktsegment").alias("source_key"))
    bridge = m.table("orders").where("o_totalprice > 400000").select(key("o_custkey"))
    li = m.table("lineitem").where("l_quantity > 49")
    edges = m.table("orders").join(li, F.col("o_orderkey") == li.l_orderkey).select(key("o_custkey").alias("parent_id"), key("o_custkey").alias("child_id"))
    return H.orphan_node_plan(nodes, bridge, edges)


@plan(
    "q17_stale_node_cleanup",
    sql(
        """WITH gone AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
SELECT (SELECT count(*) FROM gone) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c FROM gone))) AS n_edges"""
    ),
)
def q17(m: Model):
    o = m.table("orders")
    before = o.where("o_orderdate < timestamp '1996-01-01'").select(F.col("o_custkey").alias("node_id"))
    after = o.where("o_orderdate >= timestamp '2000-01-01'").select(F.col("o_custkey").alias("node_id")).distinct()
    li = m.table("lineitem")
    n = tasks_for(li)
    j = li.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey").join(o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = j.select((-F.col("l_suppkey") - 1).alias("parent_id"), F.col("o_custkey").alias("child_id"))  # repeated ones go with the touched
    gone, touched = H.stale_nodes(before, after, after, edges, n)
    return gone.agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("n_edges", touched.agg(F.count(F.lit(1))).scalar())


@plan("q18_rejected_facts_to_quarantine", sql("WITH " + LABEL_SQL + " SELECT label_class || ':' || rejection AS quarantine_reason, count(*) AS n FROM lab WHERE rejection IS NOT NULL AND label_class <> 'unknown' GROUP BY ALL"))
def q18(m: Model):
    facts = labelled(m).select(F.concat_ws(" / ", "p_type", "label").alias("node_name"))
    return H.rejected_to_quarantine(facts).groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q19_stray_source_safety",
    sql(
        """WITH fa AS (SELECT source_key, jurisdiction || node_name AS node_id, measure_type FROM f WHERE NOT (source_key LIKE 'asia%' AND measure_type = 'expense_budget')), ed AS (SELECT DISTINCT jurisdiction || node_name AS node_id FROM f WHERE source_key = 'asia_building' AND node_name LIKE '%Q1'),
s AS (SELECT source_key, count(*) FILTER (measure_type = 'expense_actual') AS n_stray, count(DISTINCT CASE WHEN measure_type <> 'expense_actual' THEN measure_type END) AS n_other_measures FROM fa GROUP BY ALL),
e AS (SELECT source_key, 2 * count(*) AS n_edges FROM (SELECT DISTINCT source_key, node_id FROM fa WHERE measure_type = 'expense_actual') JOIN ed USING (node_id) GROUP BY ALL)
SELECT source_key, n_stray, n_other_measures, coalesce(n_edges, 0) AS n_edges, n_other_measures = 0 AND coalesce(n_edges, 0) = 0 AS safe_to_remove FROM s LEFT JOIN e USING (source_key)""",
        "f",
    ),
)
def q19(m: Model):
    node = F.concat("jurisdiction", "node_name").alias("node_id")
    facts = m.facts.where("not (source_key like 'asia%' and measure_type = 'expense_budget')").select("source_key", node, "measure_type")
    ends = m.facts.where("source_key = 'asia_building' and node_name like '%Q1'").select(node).distinct()
    edges = ends.select(F.col("node_id").alias("parent_id"), F.col("node_id").alias("child_id"))
    return H.stray_source_state(facts, edges, "expense_actual")


SOURCE_SQL = """sr AS (SELECT source AS source_id, count(*) AS n_docs, count(quality) AS n_facts, sum(n_chars) AS n_bytes, bool_or(lang = 'es' AND n_chars > 9000) AS has_mapping FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)"""


def sources(m: Model):
    d = m.table("documents").select("doc_id", "source", "lang", "n_chars").join(m.table("labels"), "doc_id", "left")
    return d.groupBy(F.col("source").alias("source_id")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_facts"), F.sum("n_chars").alias("n_bytes"), F.max((F.col("lang") == "es") & (F.col("n_chars") > 9000)).alias("has_mapping")
    )


@plan(
    "q20_coverage_classification",
    sql(
        "WITH " + SOURCE_SQL + """ SELECT source_id, n_facts, CASE WHEN source_id = 'src0' THEN 'officially_unavailable' WHEN source_id = 'src1' THEN 'reference_only' WHEN source_id = 'src2' THEN 'duplicate_source' WHEN n_docs < 45 THEN 'not_acquired'
 WHEN source_id = 'src3' THEN 'partially_ingested' WHEN n_facts > 15 AND has_mapping AND source_id LIKE 'src1%' AND source_id <> 'src12' THEN 'partially_ingested' WHEN n_facts > 15 AND has_mapping THEN 'fully_ingested' WHEN n_facts > 15 THEN 'partially_ingested' WHEN has_mapping THEN 'adapter_broken' ELSE 'adapter_missing' END AS status FROM sr"""
    ),
)
def q20(m: Model):
    s = sources(m)
    rows = s.select(
        "source_id", F.when(F.col("n_docs") < 45, 0).otherwise(F.col("n_docs")).alias("n_files"), F.col("n_facts").alias("seen"), F.when(F.col("n_facts") > 15, F.col("n_facts")).otherwise(0).alias("n_facts"),
        "has_mapping", F.when(F.col("source_id") == "src3", "partially_ingested").alias("family_status"),
    )
    out = CO.classify_sources(rows, ["src0"], ["src1"], ["src2"], "src1", ["src12"])
    return out.select("source_id", F.col("seen").alias("n_facts"), "status")


@plan(
    "q20_coverage_reasons",
    sql(
        "WITH " + SOURCE_SQL + """, k AS (SELECT *, CASE WHEN n_docs < 40 THEN 0 ELSE n_docs END AS files, CASE WHEN source_id = 'src4' THEN (SELECT n_facts FROM sr WHERE source_id = 'src5') WHEN source_id = 'src6' THEN n_docs WHEN source_id IN ('src7', 'src8') THEN 0 ELSE n_facts END AS facts FROM sr)
SELECT source_id, facts AS n_facts, CASE WHEN source_id = 'src0' THEN 'officially_unavailable' WHEN source_id = 'src4' THEN 'duplicate_source' WHEN files = 0 THEN 'not_acquired' WHEN source_id LIKE '%src1%' THEN 'fully_ingested' WHEN facts > 0 AND has_mapping THEN 'fully_ingested' WHEN facts > 0 THEN 'partially_ingested' WHEN has_mapping THEN 'adapter_broken' ELSE 'adapter_missing' END AS status,
 CASE WHEN facts > 0 THEN NULL WHEN source_id = 'src0' THEN 'no_public_bulk_export' WHEN source_id = 'src4' THEN 'canonical=src5' WHEN files = 0 THEN 'no_latest_json' WHEN has_mapping THEN 'mapping_or_adapter_exists_but_zero_facts' ELSE 'acquired_on_disk_no_ingest_wiring' END AS reason_for_zero_facts,
 CASE WHEN source_id = 'src0' THEN 'leave_as_no_bulk' WHEN source_id = 'src4' THEN 'do_not_double_ingest' WHEN files = 0 THEN 'acquire_or_exclude' WHEN source_id LIKE '%src1%' THEN 'maintain_family_adapter' WHEN facts > 0 AND has_mapping THEN 'maintain' WHEN facts > 0 THEN 'add_explicit_mapping' WHEN has_mapping THEN 'fix_or_re_run_adapter' ELSE 'build_adapter' END AS next_action FROM k"""
    ),
)
def q20_reasons(m: Model):
    """Families by part of the id, format and loaded facts; one alias, one source known only as an origin, two without facts."""
    s = m.once("sources", lambda m: cut_lineage(sources(m)))
    counts = s.select(F.col("source_id").alias("source_key"), F.col("n_facts").alias("n"))
    origins = s.where("source_id = 'src6'").select(F.col("source_id").alias("source_key"), F.col("n_docs").alias("n"))
    datasets = [
        {"dataset_id": "none", "prefixes": ["src"], "formats": ["pdf"], "keys": ["src5"]},
        {"dataset_id": "empty", "prefixes": ["src"], "formats": [], "keys": ["nothing"]},
        {"dataset_id": "ones", "prefixes": ["src1"], "formats": ["csv", "xlsx"], "keys": ["src5", "src9"], "status": "fully_ingested"},
    ]
    own = F.when(F.col("source_id").isin("src4", "src6", "src7", "src8"), 0).otherwise(F.col("n_facts")).alias("n_facts")
    rows = s.select("source_id", F.when(F.col("n_docs") < 40, 0).otherwise(F.col("n_docs")).alias("n_files"), own, "has_mapping", F.array(F.lit("csv")).alias("formats"))
    rows = CO.with_alias_and_origin_counts(rows, {"src4": "src5"}, counts, origins)
    out = CO.classify_sources(CO.family_adapters(rows, datasets, counts), ["src0"], [], {"src4": "src5"})
    return out.select("source_id", F.col("n_facts").cast("long").alias("n_facts"), "status", "reason_for_zero_facts", "next_action")


@plan(
    "q21_lineage_coverage",
    sql(
        """WITH ds AS (SELECT region AS dataset_id, CASE region WHEN 'africa' THEN 'fully_ingested' WHEN 'asia' THEN 'not_acquired' ELSE 'partially_ingested' END AS st FROM p GROUP BY ALL)
SELECT dataset_id, CASE WHEN st = 'not_acquired' THEN 'partially_ingested' WHEN st = 'fully_ingested' THEN 'adapter_failed' ELSE st END AS coverage_status, CASE WHEN dataset_id = 'africa' THEN 0 ELSE (SELECT count(*) FROM f WHERE source_key LIKE dataset_id || '!_%' ESCAPE '!') END AS fact_count FROM ds""",
        "p", "f",
    ),
)
def q21(m: Model):
    keys = m.facts.select("source_key").distinct().withColumn("dataset_id", F.regexp_replace("source_key", r"_[a-z]+$", ""))
    ds = keys.groupBy("dataset_id").agg(F.collect_set("source_key").alias("source_keys"))
    status = F.when(F.col("dataset_id") == "africa", "fully_ingested").when(F.col("dataset_id") == "asia", "not_acquired").otherwise("partially_ingested")
    gone = F.when(F.col("dataset_id") == "africa", F.array(F.lit("none"))).otherwise(F.col("source_keys"))
    ds = ds.withColumn("coverage_status", status).withColumn("source_keys", gone)
    return CO.lineage_coverage(ds, m.facts).select("dataset_id", "coverage_status", "fact_count")


@plan(
    "q22_cutover_check",
    sql("WITH " + RECON_SQL + " SELECT count(*) AS exposed_facts, count(*) FILTER (observation_date IS NULL) AS incomplete_citations, 1::BIGINT AS n_missing_sources, (SELECT count(*) FROM rec WHERE status = 'unresolved') AS n_unresolved, false AS passed FROM f", "f"),
)
def q22(m: Model):
    required = m.facts.select("source_key").distinct().unionByName(m.local([("never_loaded",)], "source_key string"))
    return CO.cutover(m.facts, required, reconciliation(m), ["locator", "observation_date"])


@plan("q23_quarantine_listing", sql("SELECT fact_key, o_orderdate AS quarantined_at FROM f WHERE quality_status = 'quarantined'", "f").replace("o_orderdate AS quarantined_at", "strftime(o_orderdate, '%Y-%m-%d') AS quarantined_at"))
def q23(m: Model):
    rows = m.facts.where("quality_status = 'quarantined'").select("fact_key", F.date_format("o_orderdate", "yyyy-MM-dd").alias("quarantined_at"))
    return CO.quarantine_listing(rows)


@plan(
    "q24_asset_inventory",
    sql(
        """SELECT source AS source_id, count(*) AS n_assets, count(quality) AS n_present, count(*) - count(quality) AS n_missing, CAST(coalesce(sum(CASE WHEN quality IS NOT NULL THEN n_chars END), 0) AS BIGINT) AS n_bytes,
 CASE WHEN count(*) = count(quality) THEN 'complete' WHEN count(quality) > 0 THEN 'partial' ELSE 'missing' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"""
    ),
)
def q24(m: Model):
    d = m.table("documents").select("doc_id", "source", "n_chars")
    listing = d.join(m.table("labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("n_bytes"))
    return CO.asset_inventory(d.select(F.col("source").alias("source_id"), F.col("doc_id").alias("path")), listing)


@plan(
    "q25_corpus_inventory",
    sql("WITH s AS (SELECT DISTINCT source_key FROM f) SELECT source_key, (SELECT count(*) FROM f x WHERE x.source_key = s.source_key AND coalesce(quality_status, 'ok') <> 'quarantined') AS n_facts, (SELECT count(*) FROM f x WHERE x.source_key = s.source_key AND quality_status = 'quarantined') AS n_quarantined FROM s", "f"),
)
def q25(m: Model):
    docs = m.facts.select("source_key").distinct()
    bad = F.coalesce("quality_status", F.lit("ok")) == "quarantined"
    return CO.corpus_inventory(docs, m.facts.where(~bad), m.facts.where(bad))


@plan(
    "q26_reprocess_report",
    sql(
        """WITH b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY ALL), a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n, count(*) FILTER (o_orderstatus = 'P') AS q FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' GROUP BY ALL)
SELECT coalesce(b.o_custkey, a.o_custkey) AS source_key, b.n AS before_facts, a.n AS after_facts, a.q AS after_quarantined, CASE WHEN coalesce(a.n, 0) > 0 THEN 'facts' WHEN coalesce(a.q, 0) > 0 THEN 'quarantine_only' ELSE 'zero_yield' END AS outcome FROM b FULL JOIN a ON b.o_custkey = a.o_custkey"""
    ),
)
def q26(m: Model):
    o = m.table("orders").withColumnRenamed("o_custkey", "source_key")
    before = o.where("o_orderdate < timestamp '1998-06-01'").groupBy("source_key").agg(F.count(F.lit(1)).alias("n_facts"))
    after = o.where("o_orderdate >= timestamp '1998-06-01'").groupBy("source_key").agg(
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_facts"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("n_quarantined")
    )
    return CO.reprocess_report(before, after, "source_key")


@plan(
    "q27_defect_baseline",
    sql(
        "WITH " + _pair_sql() + r""", b AS (SELECT 'cross_government_leak' AS defect FROM pr WHERE kind = 'additive' AND child_level <> requested_level UNION ALL SELECT 'cross_jurisdiction_leak' FROM pr WHERE kind = 'additive' AND requested_jurisdiction IS NOT NULL AND NOT contains(lower(child_jurisdiction), lower(requested_jurisdiction))
UNION ALL SELECT 'cross_year_silent_mismatch' FROM pr WHERE kind = 'additive' AND child_fy <> parent_fy UNION ALL SELECT 'additive_over_100pct' FROM pr WHERE kind = 'additive' AND child_amount / parent_amount > 1
UNION ALL SELECT 'label_quality_header_or_financial_statement_line' FROM pr WHERE label LIKE 'EXPENSES%' UNION ALL SELECT 'label_quality_concatenated_numeric_row' FROM pr WHERE label LIKE '%1,234 2,345,678 %') SELECT defect, count(*) AS n FROM b GROUP BY ALL""",
        "f", "p",
    ),
)
def q27(m: Model):
    return AU.defect_rows(pairs(m)).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q28_staging_audit",
    sql(
        """WITH k AS (SELECT DISTINCT p_name AS label FROM part WHERE p_size > 30), r AS (SELECT p_name AS label, financial_year, jurisdiction, p_brand, count(*) OVER (PARTITION BY p_name, financial_year, jurisdiction, p_brand) AS c FROM l)
SELECT concat_ws(';', CASE WHEN k.label IS NULL THEN 'unrecognized_label' END, CASE WHEN c > 1 THEN 'duplicate_cell_in_sheet' END) AS quarantine_reason, k.label IS NOT NULL AND c = 1 AS publishable, count(*) AS n FROM r LEFT JOIN k USING (label) GROUP BY ALL""",
        "l",
    ),
)
def q28(m: Model):
    labels = m.table("part").where("p_size > 30").select(F.col("p_name").alias("label"), F.lit("m").alias("measure_type"))
    rows = m.lines.select(F.col("p_name").alias("label"), "financial_year", "jurisdiction", "p_brand")
    out = AU.staging_audit(rows, labels, ["label", "financial_year", "jurisdiction", "p_brand"])
    return out.groupBy("quarantine_reason", "publishable").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q29_acquisition_queue",
    sql(
        """WITH r AS (SELECT c_custkey, c_name AS source_id, c_acctbal > 5000 AS has_latest, c_mktsegment = 'BUILDING' AS is_blocked, CASE c_mktsegment WHEN 'MACHINERY' THEN 'manual' WHEN 'FURNITURE' THEN 'web_portal' ELSE 'api' END AS am, c_nationkey < 3 AS kf FROM customer)
SELECT CASE WHEN c_custkey = 7 THEN 'no_bulk' WHEN kf THEN CASE WHEN has_latest THEN 'done' ELSE 'flaky' END WHEN has_latest THEN 'done' WHEN is_blocked OR am <> 'api' THEN 'need' ELSE 'automated' END AS status, count(*) AS n FROM r GROUP BY ALL"""
    ),
)
def q29(m: Model):
    c = m.table("customer")
    method = F.when(F.col("c_mktsegment") == "MACHINERY", "manual").when(F.col("c_mktsegment") == "FURNITURE", "web_portal").otherwise("api")
    rows = c.select(F.col("c_name").alias("source_id"), (F.col("c_acctbal") > 5000).alias("has_latest"), (F.col("c_mktsegment") == "BUILDING").alias("is_blocked"), method.alias("access_method"), (F.col("c_nationkey") < 3).alias("known_flaky"))
    return CO.acquisition_status(rows, ["Customer#000000007"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "q30_workbook_inventory",
    sql(
        """WITH c AS (SELECT o_orderkey, l_linenumber, min(l_partkey) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL),
s AS (SELECT o_orderkey, max(l_linenumber) + 1 AS n_rows FROM c GROUP BY ALL)
SELECT 'w' || o.o_orderkey AS source_id, CAST(n_rows AS INTEGER) AS n_rows, CASE WHEN n_rows IS NOT NULL THEN 2 END AS n_cols, CASE WHEN n_rows IS NOT NULL THEN coalesce((SELECT l_linenumber || ' | ' || v FROM c WHERE c.o_orderkey = o.o_orderkey AND l_linenumber = 1), '') END AS header_row,
 CASE WHEN n_rows IS NULL THEN 'file_missing_on_disk' END AS error FROM orders o LEFT JOIN s ON s.o_orderkey = o.o_orderkey"""
    ),
)
def q30(m: Model):
    o, li = m.table("orders"), m.table("lineitem")
    src = F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("source_id")
    n = tasks_for(li)
    there = o.where("o_orderstatus <> 'P'").select("o_orderkey").repartition(n, "o_orderkey")
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey").repartition(n, "l_orderkey")
    rows = there.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("v"))
    cells = rows.select(src, F.lit("s").alias("sheet"), F.col("l_linenumber").alias("row_no"), F.posexplode(F.array(F.col("l_linenumber").cast("string"), F.col("v").cast("string"))).alias("col_no", "value"))
    return CO.workbook_inventory(cells, o.select(src)).select("source_id", "n_rows", "n_cols", "header_row", "error")


@plan(
    "q31_handoff_status",
    sql(
        """WITH fc AS (SELECT source AS source_key, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'src' || s_suppkey ELSE 'src' || s_suppkey || '_facts' END AS source_id, CASE s_nationkey % 4 WHEN 0 THEN 'REFERENCE_ONLY' WHEN 1 THEN 'MANUAL_DOWNLOAD' ELSE 'FETCH' END AS action,
 s_acctbal > 6000 AS present, s_acctbal > 8000 AS on_disk FROM supplier)
SELECT source_id, CAST(coalesce((SELECT n FROM fc WHERE source_key = source_id), (SELECT sum(n) FROM fc WHERE contains(source_key, replace(source_id, '_facts', ''))), 0) AS BIGINT) AS n_facts,
 CASE WHEN action = 'REFERENCE_ONLY' AND NOT present THEN 'reference_only' WHEN present AND on_disk THEN 'already_on_disk' WHEN present THEN 'downloaded' WHEN action LIKE '%MANUAL%' THEN 'blocked_or_manual' ELSE 'missing' END AS status FROM r"""
    ),
)
def q31(m: Model):
    counts = m.table("documents").groupBy(F.col("source").alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    s, k = m.table("supplier"), F.col("s_suppkey")
    sid = F.concat(F.lit("src"), k.cast("string"), F.when(k % 2 == 0, "").otherwise("_facts"))
    action = F.when(F.col("s_nationkey") % 4 == 0, "REFERENCE_ONLY").when(F.col("s_nationkey") % 4 == 1, "MANUAL_DOWNLOAD").otherwise("FETCH")
    rows = s.select(sid.alias("source_id"), action.alias("action"), (F.col("s_acctbal") > 6000).alias("present"), (F.col("s_acctbal") > 8000).alias("on_disk"))
    return CO.handoff_status(rows, counts).select("source_id", "n_facts", "status")
