"""Breakdown graph (family G) over part paths: types, brands, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.graph import descent as D
from factline.graph import edges as E
from factline.plans.model import Model, sql
from factline.plans.registry import plan
from factline.session import cut_lineage

YEAR = "1999-00"

NODES_SQL = """np AS (SELECT DISTINCT p_type AS t, p_brand AS b, p_name AS n, p_size AS s FROM part),
nodes AS (SELECT source_key || '|' || name AS node_id, source_key, name FROM (
  SELECT DISTINCT 'a61' AS source_key, t AS name FROM np UNION SELECT DISTINCT 'a61', t || ' / ' || b FROM np
  UNION SELECT DISTINCT 'components', t || ' / ' || b || ' / ' || n FROM np WHERE s <= 40
  UNION SELECT DISTINCT 'pbs', t || ' / ' || b || ' / ' || n FROM np WHERE s >= 20
  UNION SELECT DISTINCT 'abs_gfs', 'Total ' || lower(t) FROM np))"""
FACTS_SQL = """nf AS (SELECT node_id || '|' || financial_year || '|' || st || '|' || e AS fact_id, node_id, financial_year, CASE WHEN st = 'budget' THEN 'budget_expense' ELSE 'actual_expense' END AS compatibility_group,
  st AS estimate_status, source_key || '_' || e AS source_key, round(a, 2) AS amount_aud FROM (
  SELECT 'a61|' || p_type AS node_id, 'a61' AS source_key, financial_year, estimate_status AS st, 'x' AS e, sum(amount_aud) AS a FROM l GROUP BY ALL
  UNION ALL SELECT 'a61|' || p_type || ' / ' || p_brand, 'a61', financial_year, estimate_status, 'x', sum(amount_aud) FROM l GROUP BY ALL
  UNION ALL SELECT 'components|' || p_type || ' / ' || p_brand || ' / ' || p_name, 'components', financial_year, estimate_status, 'x', sum(amount_aud) FROM l WHERE l_quantity > 25 GROUP BY ALL
  UNION ALL SELECT 'pbs|' || p_type || ' / ' || p_brand || ' / ' || p_name, 'pbs', financial_year, estimate_status, CASE WHEN level = 'federal' THEN 'f' ELSE 's' END, sum(amount_aud) FROM l WHERE l_quantity <= 25 GROUP BY ALL
  UNION ALL SELECT 'abs_gfs|Total ' || lower(p_type), 'abs_gfs', financial_year, estimate_status, 'x', sum(amount_aud) FROM l WHERE estimate_status = 'actual' GROUP BY ALL)
  WHERE node_id IN (SELECT node_id FROM nodes))"""
EDGES_SQL = """edges AS (SELECT 'a61|' || t AS parent_id, 'a61|' || t || ' / ' || b AS child_id, 'same_group' AS edge_kind FROM (SELECT DISTINCT t, b FROM np)
  UNION ALL SELECT 'a61|' || regexp_replace(name, ' / [^/]*$', ''), node_id, 'same_group' FROM nodes WHERE source_key = 'components'
  UNION ALL SELECT c.node_id, p.node_id, 'same_group' FROM nodes c JOIN nodes p ON c.name = p.name WHERE c.source_key = 'components' AND p.source_key = 'pbs'
  UNION ALL SELECT DISTINCT 'abs_gfs|Total ' || lower(t), 'a61|' || t || ' / ' || b, 'related_breakdown' FROM np)"""
CHOSEN_SQL = f"""rk AS (SELECT *, CASE compatibility_group WHEN 'budget_expense' THEN 0 ELSE 1 END AS g, CASE estimate_status WHEN 'budget' THEN 0 WHEN 'actual' THEN 4 ELSE 5 END AS sr, CAST(substr(financial_year, 1, 4) AS INT) AS y FROM nf),
ex AS (SELECT * FROM rk WHERE y = {YEAR[:4]} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY g, sr, fact_id) = 1),
ea AS (SELECT *, count(*) OVER (PARTITION BY node_id, source_key) AS c FROM rk WHERE y < {YEAR[:4]}),
fb AS (SELECT * FROM ea QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY y DESC, CASE WHEN c > 1 THEN 0 ELSE 1 END, g, fact_id) = 1),
near AS (SELECT node_id, fact_id, amount_aud, financial_year AS fact_financial_year, estimate_status, false AS is_year_fallback, 'exact_year_match' AS fallback_reason FROM ex
  UNION ALL SELECT node_id, fact_id, amount_aud, financial_year, estimate_status, true, CASE WHEN c > 1 THEN 'nearest_earlier_year_same_edition' ELSE 'nearest_earlier_year_other_edition' END FROM fb WHERE node_id NOT IN (SELECT node_id FROM ex))"""
GRAPH = f"{NODES_SQL}, {FACTS_SQL}, {EDGES_SQL}, {CHOSEN_SQL}"


def node_frames(m: Model):
    return m.once("nodes", _node_frames)


def node_facts(m: Model):
    return m.once("node_facts", _node_facts)


def edge_frame(m: Model):
    return m.once("edges", _edge_frame)


def _node_frames(m: Model):
    p = m.table("part")
    t2 = F.concat_ws(E.SEP, "p_type", "p_brand")
    t3 = F.concat_ws(E.SEP, "p_type", "p_brand", "p_name")

    def layer(df, source, name):
        return df.select(F.lit(source).alias("source_key"), name.alias("name")).distinct()

    nodes = (
        layer(p, "a61", F.col("p_type"))
        .unionByName(layer(p, "a61", t2))
        .unionByName(layer(p.where("p_size <= 40"), "components", t3))
        .unionByName(layer(p.where("p_size >= 20"), "pbs", t3))
        .unionByName(layer(p, "abs_gfs", F.concat(F.lit("Total "), F.lower("p_type"))))
    )
    return cut_lineage(nodes.select(E.node_key(F.col("source_key"), F.col("name")).alias("node_id"), "source_key", "name"))


def _node_facts(m: Model):
    """Facts per node and year, one grouped pass over the items for all layers."""
    t2 = F.concat_ws(E.SEP, "p_type", "p_brand")
    t3 = F.concat_ws(E.SEP, "p_type", "p_brand", "p_name")
    q = F.col("l_quantity")
    none = F.lit(None).cast("struct<source:string,name:string,e:string>")

    def tag(source, name, e, cond=None):
        s = F.struct(F.lit(source).alias("source"), name.alias("name"), e.alias("e"))
        return s if cond is None else F.when(cond, s).otherwise(none)

    x = F.lit("x")
    tags = F.array_compact(
        F.array(
            tag("a61", F.col("p_type"), x),
            tag("a61", t2, x),
            tag("components", t3, x, q > 25),
            tag("pbs", t3, F.when(F.col("level") == "federal", "f").otherwise("s"), q <= 25),
            tag("abs_gfs", F.concat(F.lit("Total "), F.lower("p_type")), x, F.col("estimate_status") == "actual"),
        )
    )
    # items are combined by their finest key before they are copied to the layers
    fine = m.lines.groupBy("p_type", "p_brand", "p_name", "level", "l_quantity", "financial_year", "estimate_status").agg(F.sum("amount_aud").alias("a"))
    spread = fine.select("financial_year", "estimate_status", "a", F.explode(tags).alias("t"))
    g = spread.groupBy(
        E.node_key(F.col("t.source"), F.col("t.name")).alias("node_id"), F.concat_ws("_", "t.source", "t.e").alias("source_key"), F.col("t.e").alias("e"), "financial_year", "estimate_status"
    ).agg(F.round(F.sum("a"), 2).alias("amount_aud"))
    g = g.select(
        F.concat_ws("|", "node_id", "financial_year", "estimate_status", "e").alias("fact_id"),
        "node_id",
        "financial_year",
        F.when(F.col("estimate_status") == "budget", "budget_expense").otherwise("actual_expense").alias("compatibility_group"),
        "estimate_status",
        "source_key",
        "amount_aud",
    )
    return cut_lineage(g.join(node_frames(m).select("node_id"), "node_id", "left_semi"))


def _edge_frame(m: Model):
    nodes = node_frames(m)
    _, paths = E.path_edges(nodes.where("source_key = 'a61'"))
    comp = E.component_edges(nodes, "a61", "components")
    prog = E.program_edges(nodes, ["pbs"], "a61", "components").where("crosswalk_id = 'program_on_component'")
    kinds = m.table("part").select(F.lower("p_type").alias("purpose"), F.col("p_type").alias("function")).distinct().withColumn("quality", F.lit("exact"))
    related = E.crosswalk_edges(nodes, kinds, "abs_gfs", "a61", "components", "purpose_to_function")
    return cut_lineage(paths.unionByName(comp).unionByName(prog).unionByName(related))


@plan("g1_path_edges", sql("WITH " + NODES_SQL + """, pre AS (SELECT DISTINCT array_to_string(string_split(name, ' / ')[1:d], ' / ') AS name FROM (SELECT name, unnest(range(1, len(string_split(name, ' / ')) + 1)) AS d FROM nodes WHERE source_key = 'pbs'))
SELECT 'pbs|' || regexp_replace(name, ' / [^/]*$', '') AS parent_id, 'pbs|' || name AS child_id, 'path:' || regexp_replace(name, ' / [^/]*$', '') AS notes FROM pre WHERE name LIKE '% / %'"""))
def g1(m: Model):
    _, e = E.path_edges(node_frames(m).where("source_key = 'pbs'"))
    return e.select("parent_id", "child_id", "notes")


@plan("g2_crosswalk_edges", sql("WITH " + NODES_SQL + """ SELECT DISTINCT 'abs_gfs|Total ' || lower(t) AS parent_id, 'a61|' || t || ' / ' || b AS child_id, lower(t) || '→' || t || ' / ' || b || '|exact' AS notes FROM np"""))
def g2(m: Model):
    kinds = m.table("part").select(F.lower("p_type").alias("purpose"), F.col("p_type").alias("function")).distinct().withColumn("quality", F.lit("exact"))
    return E.crosswalk_edges(node_frames(m), kinds, "abs_gfs", "a61", "components", "x").select("parent_id", "child_id", "notes")


CASCADE_SQL = """casc AS (SELECT f.node_id AS parent_id, c.node_id AS child_id, 90 AS priority FROM nodes c JOIN nodes f ON f.name = regexp_replace(c.name, ' / [^/]*$', '') WHERE c.source_key = 'components' AND f.source_key = 'a61'
 UNION ALL SELECT c.node_id, p.node_id, 70 FROM nodes p JOIN nodes c ON c.name = p.name WHERE p.source_key = 'pbs' AND c.source_key = 'components'
 UNION ALL SELECT f.node_id, p.node_id, 75 FROM nodes p JOIN nodes f ON f.name = regexp_replace(p.name, ' / [^/]*$', '') WHERE p.source_key = 'pbs' AND f.source_key = 'a61' AND p.name NOT IN (SELECT name FROM nodes WHERE source_key = 'components'))"""


@plan("g3_ordered_cascade", sql("WITH " + NODES_SQL + ", " + CASCADE_SQL + " SELECT parent_id, child_id, CAST(priority AS INTEGER) AS priority FROM casc"))
def g3(m: Model):
    nodes = node_frames(m)
    both = E.component_edges(nodes, "a61", "components").unionByName(E.program_edges(nodes, ["pbs"], "a61", "components"))
    return both.select("parent_id", "child_id", "priority")


@plan("g4_prune_direct_edges", sql("WITH " + NODES_SQL + ", " + CASCADE_SQL + " SELECT parent_id, child_id FROM casc"))
def g4(m: Model):
    nodes = node_frames(m)
    both = E.component_edges(nodes, "a61", "components").unionByName(E.program_edges(nodes, ["pbs"], "a61", "components"))
    p = nodes.where("source_key = 'pbs'").select(F.col("node_id").alias("child_id"), F.concat(F.lit("a61|"), E.parent_name(F.col("name"))).alias("parent_id"))
    extra = E._edges(p, "same_group", F.lit("direct"), F.lit(1), F.lit("direct"))
    covered = both.where("priority = 75").select("parent_id", "child_id")
    direct = extra.join(covered, ["parent_id", "child_id"], "left_anti").select(*both.columns)
    return E.prune_direct(both.unionByName(direct), nodes, "a61", "components", ["pbs"]).select("parent_id", "child_id")


@plan("g5_year_fallback", sql("WITH " + GRAPH + " SELECT node_id, fact_id, fact_financial_year, is_year_fallback, fallback_reason FROM near", "l"))
def g5(m: Model):
    return D.year_facts(node_facts(m), YEAR, True).select("node_id", "fact_id", "fact_financial_year", "is_year_fallback", "fallback_reason")


@plan("g6_child_edges", sql("WITH " + GRAPH + " SELECT parent_id, child_id FROM edges WHERE edge_kind = 'same_group'", "l"))
def g6(m: Model):
    e = edge_frame(m)
    doubled = e.unionByName(e.withColumn("priority", F.col("priority") - 1)).unionByName(e.withColumn("financial_year", F.lit("1900-01")))
    return D.child_edges(doubled, node_frames(m), "same_group", YEAR).select("parent_id", "child_id")


DESCENT_SQL = """r AS (SELECT node_id AS root_id, [node_id] AS path, node_id, 0 AS depth, NULL::VARCHAR AS fact_id, 0.0::DOUBLE AS amount_aud FROM nodes WHERE source_key = 'a61' AND name NOT LIKE '% / %'
  UNION ALL SELECT r.root_id, list_append(r.path, e.child_id), e.child_id, r.depth + 1, f.fact_id, f.amount_aud FROM r JOIN edges e ON e.parent_id = r.node_id AND e.edge_kind = 'same_group' JOIN {facts} f ON f.node_id = e.child_id WHERE NOT list_contains(r.path, e.child_id))"""


@plan("g7_same_group_descent", sql("WITH RECURSIVE " + GRAPH + ", " + DESCENT_SQL.format(facts="ex") + " SELECT root_id, node_id, CAST(depth AS INTEGER) AS depth, fact_id, amount_aud FROM r WHERE depth > 0", "l"))
def g7(m: Model):
    nodes = node_frames(m)
    roots = nodes.where("source_key = 'a61' and name not like '% / %'")
    t = D.same_group_tree(roots, nodes, edge_frame(m), node_facts(m), YEAR)
    return t.select("root_id", "node_id", "depth", "fact_id", "amount_aud")


RELATED_SQL = """r AS (SELECT e.parent_id AS root_id, [e.parent_id, e.child_id] AS path, e.child_id AS node_id, 1 AS depth, f.fact_id, f.amount_aud, f.fact_financial_year, f.is_year_fallback, f.fallback_reason
   FROM edges e JOIN near f ON f.node_id = e.child_id WHERE e.edge_kind = 'related_breakdown'
  UNION ALL SELECT r.root_id, list_append(r.path, e.child_id), e.child_id, r.depth + 1, f.fact_id, f.amount_aud, f.fact_financial_year, f.is_year_fallback, f.fallback_reason
   FROM r JOIN edges e ON e.parent_id = r.node_id AND e.edge_kind = 'same_group' JOIN near f ON f.node_id = e.child_id WHERE NOT list_contains(r.path, e.child_id))"""


def related(m: Model):
    nodes = node_frames(m)
    return D.related_tree(nodes.where("source_key = 'abs_gfs'"), nodes, edge_frame(m), node_facts(m), YEAR)


@plan("g8_related_subtree", sql("WITH RECURSIVE " + GRAPH + ", " + RELATED_SQL + " SELECT root_id, node_id, CAST(depth AS INTEGER) AS depth, fact_id, fact_financial_year, is_year_fallback, fallback_reason, 'exact' AS match_quality FROM r", "l"))
def g8(m: Model):
    return related(m).select("root_id", "node_id", "depth", "fact_id", "fact_financial_year", "is_year_fallback", "fallback_reason", "match_quality")


@plan(
    "g9_non_additive_tagging",
    sql(
        "WITH RECURSIVE " + GRAPH + ", " + RELATED_SQL + """, own AS (SELECT *, CASE WHEN is_year_fallback THEN fact_financial_year END AS own_fy FROM r),
d3 AS (SELECT *, own_fy AS eff FROM own WHERE depth = 3), m3 AS (SELECT path[1:3] AS path, min(eff) AS e FROM d3 GROUP BY ALL),
d2 AS (SELECT own.*, coalesce(own_fy, m3.e) AS eff FROM own LEFT JOIN m3 USING (path) WHERE depth = 2), m2 AS (SELECT path[1:2] AS path, min(eff) AS e FROM d2 GROUP BY ALL),
d1 AS (SELECT own.*, coalesce(own_fy, m2.e) AS eff FROM own LEFT JOIN m2 USING (path) WHERE depth = 1), al AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)
SELECT root_id, node_id, CAST(depth AS INTEGER) AS depth, eff AS disclosed_financial_year, is_year_fallback OR (eff IS NOT NULL AND own_fy IS NULL) AS disclosed_fallback,
 CASE WHEN own_fy IS NOT NULL THEN fallback_reason WHEN eff IS NOT NULL THEN 'nested_child_year_mismatch' WHEN depth = 1 THEN fallback_reason END AS disclosed_reason FROM al""",
        "l",
    ),
)
def g9(m: Model):
    t = D.tag_non_additive(related(m), YEAR)
    return t.select("root_id", "node_id", "depth", "disclosed_financial_year", "disclosed_fallback", "disclosed_reason")


@plan(
    "g10_related_parent_by_name",
    sql("WITH " + NODES_SQL + """ SELECT label, CASE WHEN t IS NOT NULL THEN 'abs_gfs|Total ' || lower(t) END AS parent_id FROM (SELECT DISTINCT lower(p_type) AS label FROM part UNION SELECT DISTINCT 'TOTAL ' || lower(p_type) FROM part UNION SELECT DISTINCT p_brand FROM part)
 LEFT JOIN (SELECT DISTINCT t FROM np) ON replace(label, 'TOTAL ', '') = lower(t)"""),
)
def g10(m: Model):
    p = m.table("part")
    labels = p.select(F.lower("p_type").alias("label")).unionByName(p.select(F.concat(F.lit("TOTAL "), F.lower("p_type")).alias("label"))).unionByName(p.select(F.col("p_brand").alias("label"))).distinct()
    return D.related_parent(labels, node_frames(m), edge_frame(m), "abs_gfs", {})


@plan(
    "g11_attach_related_folders",
    sql(
        "WITH RECURSIVE " + GRAPH + ", " + RELATED_SQL + """, tops AS (SELECT node_id, [name] AS tp, name IN ('Total promo', 'Total small') AS hc, amount_aud FROM nodes JOIN ex USING (node_id) WHERE nodes.source_key = 'abs_gfs')
SELECT array_to_string(tp, ' / ') || ' / Detail' AS path, 'related_folder' AS role, round(amount_aud, 2) AS amount_aud FROM tops WHERE hc
UNION ALL SELECT array_to_string(tp, ' / ') || CASE WHEN hc THEN ' / Detail' ELSE '' END || ' / ' || array_to_string(list_transform(r.path[2:], lambda x: string_split(x, ' / ')[-1]), ' / '), 'related_breakdown', round(r.amount_aud, 2) FROM r JOIN tops ON r.root_id = tops.node_id""",
        "l",
    ),
)
def g11(m: Model):
    facts = D.year_facts(node_facts(m), YEAR, False).select("node_id", "amount_aud")
    tops = node_frames(m).where("source_key = 'abs_gfs'").join(facts, "node_id").select("node_id", F.array("name").alias("tree_path"), F.col("name").isin("Total promo", "Total small").alias("has_children"), "amount_aud")
    out = D.attach_related(tops, D.with_label_paths(related(m)), "Detail", tops)
    return out.select(F.array_join("tree_path", E.SEP).alias("path"), "role", F.round("amount_aud", 2).alias("amount_aud"))


@plan(
    "g12_edge_cascade_replaces_paths",
    sql(
        "WITH RECURSIVE " + GRAPH + ", " + DESCENT_SQL.format(facts="ex") + """, tree AS (SELECT [name] AS path, nodes.node_id, amount_aud FROM nodes JOIN ex USING (node_id) WHERE nodes.source_key = 'a61' AND name NOT LIKE '% / %'
 UNION ALL SELECT [t, 'old ' || b], 'old|' || t || b, 1.0 FROM (SELECT DISTINCT t, b FROM np WHERE t <> 'x')
 UNION ALL SELECT ['Loose', b], 'loose|' || b, 2.0 FROM (SELECT DISTINCT b FROM np))
SELECT array_to_string(path, ' / ') AS path, node_id, round(amount_aud, 2) AS amount_aud, 'path' AS via FROM tree WHERE NOT node_id LIKE 'old|%'
UNION ALL SELECT array_to_string(list_prepend(substr(root_id, 5), list_transform(path[2:], lambda x: string_split(x, ' / ')[-1])), ' / '), node_id, round(amount_aud, 2), 'edge' FROM r WHERE depth > 0""",
        "l",
    ),
)
def g12(m: Model):
    nodes, p = node_frames(m), m.table("part")
    facts = node_facts(m)
    roots = nodes.where("source_key = 'a61' and name not like '% / %'")
    tops = roots.join(D.year_facts(facts, YEAR, False).select("node_id", "amount_aud"), "node_id").select(F.array("name").alias("path"), "node_id", "amount_aud")
    old = p.select(F.array("p_type", F.concat(F.lit("old "), "p_brand")).alias("path"), F.concat(F.lit("old|"), "p_type", "p_brand").alias("node_id"), F.lit(1.0).alias("amount_aud")).distinct()
    loose = p.select(F.array(F.lit("Loose"), "p_brand").alias("path"), F.concat(F.lit("loose|"), "p_brand").alias("node_id"), F.lit(2.0).alias("amount_aud")).distinct()
    cascade = D.with_label_paths(D.same_group_tree(roots, nodes, edge_frame(m), facts, YEAR))
    out = D.edges_replace_paths(tops.unionByName(old).unionByName(loose), cascade)
    return out.select(F.array_join("path", E.SEP).alias("path"), "node_id", F.round("amount_aud", 2).alias("amount_aud"), "via")


@plan("g13_display_names", sql("WITH " + NODES_SQL + " SELECT DISTINCT name, CASE WHEN name LIKE 'PROMO / %' THEN substr(name, 9) ELSE string_split(name, ' / ')[-1] END AS label FROM nodes"))
def g13(m: Model):
    return node_frames(m).select("name", E.display_name(F.col("name"), F.lit("PROMO")).alias("label")).distinct()


DECIDE_SQL = """prog AS (SELECT DISTINCT p_type AS portfolio, p_brand || ' / ' || p_name AS label FROM part),
dec AS (SELECT *, CASE WHEN portfolio = 'PROMO' AND contains(label, 'red') THEN 'SMALL' WHEN portfolio = 'PROMO' THEN 'PROMO' WHEN portfolio = 'SMALL' THEN 'Nowhere' END AS target,
  CASE WHEN portfolio IN ('PROMO', 'SMALL') THEN 'mapped' WHEN portfolio = 'LARGE' THEN 'ambiguous' ELSE 'unmapped' END AS status,
  CASE WHEN portfolio = 'PROMO' AND contains(label, 'red') THEN 'program_label_override' WHEN portfolio IN ('PROMO', 'SMALL', 'LARGE') THEN 'portfolio_default' END AS match_source FROM prog)"""


def decisions(m: Model):
    prog = m.table("part").select(F.col("p_type").alias("portfolio"), F.concat_ws(E.SEP, "p_brand", "p_name").alias("label")).distinct()
    prog = prog.withColumn("node_id", F.concat_ws("|", "portfolio", "label"))
    return E.decide_crosswalk(prog, [("PROMO", "Red", "SMALL")], [("PROMO", "PROMO", None), ("SMALL", "Nowhere", None), ("LARGE", None, "several functions")])


@plan("g14_crosswalk_decisions", sql("WITH " + DECIDE_SQL + " SELECT portfolio, label, status, target, match_source FROM dec"))
def g14(m: Model):
    return decisions(m).select("portfolio", "label", "status", "target", "match_source")


@plan(
    "g15_crosswalk_coverage",
    sql("WITH " + DECIDE_SQL + """ SELECT portfolio, CASE WHEN target = 'Nowhere' THEN 'unmapped' ELSE status END AS status, CASE WHEN target = 'Nowhere' THEN 'target_node_not_found:Nowhere' WHEN status = 'unmapped' THEN 'portfolio_not_in_crosswalk'
 WHEN status = 'ambiguous' THEN 'several functions' END AS reason, count(*) AS n FROM dec GROUP BY ALL"""),
)
def g15(m: Model):
    cov = E.crosswalk_coverage(decisions(m), node_frames(m).where("source_key = 'a61'"))
    return cov.groupBy("portfolio", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "g15_crosswalk_edges",
    sql("WITH " + DECIDE_SQL + ", tg AS (SELECT DISTINCT name, node_id FROM (" + "SELECT p_type AS name, 'ed' || p_size % 3 || '|' || p_type AS node_id FROM part" + """))
SELECT tg.node_id AS parent_id, dec.portfolio || '|' || dec.label AS child_id, 'crosswalk:' || target AS notes FROM dec JOIN tg ON tg.name = dec.target WHERE status = 'mapped' AND portfolio || '|' || label NOT LIKE 'PROMO|Brand#1%'"""),
)
def g15_edges(m: Model):
    """Edges from every edition of a target to its programs; those of one brand are there already and are not made twice."""
    targets = m.table("part").select(F.col("p_type").alias("name"), F.concat(F.lit("ed"), (F.col("p_size") % 3).cast("string"), F.lit("|"), "p_type").alias("node_id")).distinct()
    chosen = decisions(m)
    none = E.target_edges(chosen, targets, _no_edges(m), "cw")
    there = none.where("child_id like 'PROMO|Brand#1%'")
    return E.target_edges(chosen, targets, there, "cw").select("parent_id", "child_id", "notes")


def _no_edges(m: Model):
    return m.local([], "parent_id string, child_id string, edge_kind string, crosswalk_id string, financial_year string")


@plan(
    "g16_children_under_cascade",
    sql("WITH " + NODES_SQL + """ SELECT DISTINCT 'a61|' || regexp_replace(name, ' / [^/]*$', '') AS parent_id, node_id AS child_id FROM nodes WHERE source_key = 'pbs'"""),
)
def g16(m: Model):
    return E.children_under_cascade(node_frames(m), "pbs", ["a61", "abs_gfs"], "x").select("parent_id", "child_id")


@plan(
    "g17_item_children",
    sql(
        "WITH " + GRAPH + """, kids AS (SELECT e.parent_id, e.edge_kind, count(*) AS n FROM edges e JOIN near f ON f.node_id = e.child_id WHERE e.edge_kind = 'related_breakdown' OR e.child_id IN (SELECT node_id FROM ex) GROUP BY ALL)
SELECT node_id, CASE WHEN s.n > 0 THEN 'same_group' WHEN r.n > 0 THEN 'related_breakdown' ELSE 'empty' END AS kind, CAST(coalesce(s.n, r.n, 0) AS BIGINT) AS n_children
FROM nodes LEFT JOIN kids s ON s.parent_id = node_id AND s.edge_kind = 'same_group' LEFT JOIN kids r ON r.parent_id = node_id AND r.edge_kind = 'related_breakdown'""",
        "l",
    ),
)
def g17(m: Model):
    nodes, e, facts = node_frames(m), edge_frame(m), node_facts(m)
    exact = D.year_facts(facts, YEAR, False).select(F.col("node_id").alias("child_id"))
    near = D.year_facts(facts, YEAR, True).select(F.col("node_id").alias("child_id"))
    same = D.child_edges(e, nodes, "same_group", YEAR).join(exact, "child_id", "left_semi").select("parent_id", F.lit("same_group").alias("kind"))
    rel = D.child_edges(e, nodes, "related_breakdown", YEAR).join(near, "child_id", "left_semi").select("parent_id", F.lit("related_breakdown").alias("kind"))
    counts = same.unionByName(rel).groupBy("parent_id").agg(F.count(F.when(F.col("kind") == "same_group", 1)).alias("s"), F.count(F.when(F.col("kind") != "same_group", 1)).alias("r"))
    j = nodes.join(counts, nodes.node_id == counts.parent_id, "left")
    kind = F.when(F.col("s") > 0, "same_group").when(F.col("r") > 0, "related_breakdown").otherwise("empty")
    n = F.when(F.col("s") > 0, F.col("s")).otherwise(F.coalesce("r", F.lit(0)))
    return j.select("node_id", kind.alias("kind"), n.alias("n_children"))


@plan(
    "g18_coverage_matrix",
    sql(
        "WITH " + GRAPH + """, f AS (SELECT DISTINCT t FROM np), c AS (SELECT t, (SELECT count(*) FROM nf WHERE node_id = 'abs_gfs|Total ' || lower(t)) AS facts,
 (SELECT count(*) FROM nodes WHERE source_key = 'a61' AND name LIKE t || ' / %') AS subs, (SELECT count(*) FROM nodes WHERE source_key = 'components' AND name LIKE t || ' / %') AS comps,
 (SELECT count(*) FROM nodes WHERE source_key = 'pbs' AND name LIKE t || ' / %') AS progs, (SELECT count(DISTINCT child_id) FROM edges WHERE edge_kind = 'related_breakdown' AND parent_id = 'abs_gfs|Total ' || lower(t)) AS rel FROM f)
SELECT t AS function, facts AS n_facts, subs AS n_subfunctions, comps AS n_components, progs AS n_programs, rel AS n_related, CASE WHEN progs > 0 THEN 'program' WHEN comps > 0 THEN 'component' WHEN subs > 0 THEN 'subfunction' WHEN rel > 0 THEN 'related_total' ELSE 'purpose_only' END AS deepest FROM c""",
        "l",
    ),
)
def g18(m: Model):
    from factline.quality.coverage import breakdown_coverage

    cw = m.table("part").select(F.col("p_type").alias("function"), F.concat(F.lit("Total "), F.lower("p_type")).alias("purpose")).distinct()
    return breakdown_coverage(cw, node_frames(m), node_facts(m), edge_frame(m), "abs_gfs", "a61", "components", "pbs").drop("purpose")


@plan(
    "g19_hierarchy_rollup",
    sql(
        """WITH RECURSIVE he AS (SELECT DISTINCT p_type AS parent_id, p_type || ' / ' || p_brand AS child_id FROM part UNION SELECT DISTINCT p_type || ' / ' || p_brand, p_type || ' / ' || p_brand || ' / ' || p_name FROM part),
am AS (SELECT node_name AS node_id, sum(amount_aud) AS a FROM l GROUP BY ALL),
r AS (SELECT DISTINCT p_type AS root_id, p_type AS node_id, 0 AS depth FROM part UNION ALL SELECT root_id, child_id, depth + 1 FROM r JOIN he ON parent_id = node_id)
SELECT root_id, node_id, CAST(depth AS INTEGER) AS depth, round(coalesce(a, 0), 2) AS amount_aud FROM r LEFT JOIN am USING (node_id)""",
        "l",
    ),
)
def g19(m: Model):
    p = m.table("part")
    t2, t3 = F.concat_ws(E.SEP, "p_type", "p_brand"), F.concat_ws(E.SEP, "p_type", "p_brand", "p_name")
    he = p.select(F.col("p_type").alias("parent_id"), t2.alias("child_id")).unionByName(p.select(t2.alias("parent_id"), t3.alias("child_id"))).distinct()
    root = p.select(F.col("p_type").alias("node_id")).distinct()
    out = D.roll_up_hierarchy(root, he, m.lines.select(F.col("node_name").alias("node_id"), "amount_aud"))
    return out.withColumn("amount_aud", F.round("amount_aud", 2))
