"""Joins, aggregates, windows and set operations (families J, A, W, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.operators import aggregates as A
from factline.operators import folding, matching, sets
from factline.operators import tree as T
from factline.operators.ordered import dense_ordinal, first_per_key
from factline.operators.registers import stride_sample
from factline.quality.coverage import value_rank
from factline.operators.views import mode_rows
from factline.plans.model import Model, sql
from factline.plans.registry import plan

LK = ["level", "financial_year"]


@plan("a1_triple_totals", sql("SELECT financial_year, round(sum(amount_aud), 2) AS total_aud, count(*) AS n FROM f WHERE compatibility_group = 'budget_expense' AND accounting_basis = 'gfs' AND estimate_status = 'budget' GROUP BY ALL", "f"))
def a1(m: Model):
    return A.triple_totals(m.facts, "budget_expense", "gfs", "budget").select("financial_year", F.round("total_aud", 2).alias("total_aud"), "n")


@plan("a2_sample_fact_per_group", sql("SELECT financial_year, min(fact_id) AS sample_fact_id FROM f WHERE compatibility_group = 'actual_expense' AND accounting_basis = 'gfs' AND estimate_status = 'actual' GROUP BY ALL", "f"))
def a2(m: Model):
    return A.triple_totals(m.facts, "actual_expense", "gfs", "actual").select("financial_year", "sample_fact_id")


@plan("a3_level_counts", sql("SELECT level, count(*) AS n_facts, CASE level WHEN 'federal' THEN 1 WHEN 'state' THEN 2 WHEN 'territory' THEN 3 ELSE 4 END AS position FROM f GROUP BY ALL", "f"))
def a3(m: Model):
    return A.level_counts(m.facts)


@plan("a4_distinct_years_and_bases", sql("SELECT DISTINCT level, financial_year, accounting_basis FROM f", "f"))
def a4(m: Model):
    return m.facts.select("level", "financial_year", "accounting_basis").distinct()


@plan(
    "a5_node_statistics",
    sql(
        """SELECT jurisdiction, node_name, count(*) AS fact_count, min(amount_aud) AS min_amount, max(amount_aud) AS max_amount,
  array_to_string(list_sort(list_distinct(list(financial_year))), ';') AS years, array_to_string(list_sort(list_distinct(list(estimate_status))), ';') AS statuses FROM f GROUP BY ALL""",
        "f",
    ),
)
def a5(m: Model):
    return m.facts.groupBy("jurisdiction", "node_name").agg(
        F.count(F.lit(1)).alias("fact_count"),
        F.min("amount_aud").alias("min_amount"),
        F.max("amount_aud").alias("max_amount"),
        F.array_join(F.array_sort(F.collect_set("financial_year")), ";").alias("years"),
        F.array_join(F.array_sort(F.collect_set("estimate_status")), ";").alias("statuses"),
    )


@plan("a6_count_distinct_having", sql("SELECT jurisdiction, node_name, count(DISTINCT financial_year) AS n_years FROM f GROUP BY ALL HAVING count(DISTINCT financial_year) > 4", "f"))
def a6(m: Model):
    return m.facts.groupBy("jurisdiction", "node_name").agg(F.count_distinct("financial_year").alias("n_years")).where("n_years > 4")


@plan("a7_source_summary", sql("SELECT source_key, count(*) AS n_facts, array_to_string(list_sort(list_distinct(list(measure_type))), ',') AS measures, max(len(string_split(node_name, ' / '))) AS max_depth FROM f GROUP BY ALL", "f"))
def a7(m: Model):
    return m.facts.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.array_join(F.array_sort(F.collect_set("measure_type")), ",").alias("measures"),
        F.max(F.size(F.split("node_name", T.SEP))).cast("long").alias("max_depth"),
    )


@plan("a8_origin_inside_json", sql("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS origin, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL"))
def a8(m: Model):
    e = m.table("events")
    keyed = A.keyed_by_pattern(e, F.get_json_object("props", "$.k"), r"^(\d+)$", "origin")
    return keyed.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@plan("a9_depth_statistics", sql("SELECT jurisdiction, max(len(string_split(node_name, ' / '))) AS max_depth, round(avg(len(string_split(node_name, ' / '))), 4) AS mean_depth, count(*) AS n FROM l GROUP BY ALL", "l"))
def a9(m: Model):
    depth = F.size(F.split("node_name", T.SEP))
    return m.lines.groupBy("jurisdiction").agg(F.max(depth).cast("long").alias("max_depth"), F.round(F.avg(depth), 4).alias("mean_depth"), F.count(F.lit(1)).alias("n"))


@plan("a10_top_forty_counts", sql("SELECT node_name, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, node_name LIMIT 40", "l"))
def a10(m: Model):
    return A.top_counts(m.lines, "node_name", 40)


@plan(
    "a11_two_grain_sums",
    sql(
        """SELECT 'program' AS layer, p_type, p_brand, NULL::VARCHAR AS recipient, round(sum(amount_aud), 2) AS amount_aud FROM l GROUP BY ALL
UNION ALL SELECT 'recipient', p_type, p_brand, 'Supplier ' || l_suppkey, round(sum(amount_aud), 2) FROM l GROUP BY ALL""",
        "l",
    ),
)
def a11(m: Model):
    recipient = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    fine = m.lines.groupBy("p_type", "p_brand", recipient.alias("recipient")).agg(F.sum("amount_aud").alias("amount_aud"))
    coarse = fine.groupBy("p_type", "p_brand").agg(F.sum("amount_aud").alias("amount_aud"))
    both = coarse.select(F.lit("program").alias("layer"), "p_type", "p_brand", F.lit(None).cast("string").alias("recipient"), "amount_aud").unionByName(
        fine.withColumn("layer", F.lit("recipient"))
    )
    return both.withColumn("amount_aud", F.round("amount_aud", 2))


CONTRACT_SQL = """
cat AS (SELECT jurisdiction, p_brand, sum(amount_aud) AS amount FROM l GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY amount DESC, p_brand) AS r FROM cat) WHERE r <= 12),
con AS (SELECT * FROM (SELECT jurisdiction, p_brand, contract, amount_aud AS amount, row_number() OVER (PARTITION BY jurisdiction, p_brand ORDER BY amount_aud DESC, contract) AS r
  FROM (SELECT *, 'C' || l_orderkey || '-' || l_suppkey AS contract FROM l) WHERE (jurisdiction, p_brand) IN (SELECT jurisdiction, p_brand FROM top)) WHERE r <= 3)
SELECT 'folder' AS layer, jurisdiction, NULL::VARCHAR AS p_brand, NULL::VARCHAR AS contract, round(sum(amount), 2) AS amount FROM cat GROUP BY ALL
UNION ALL SELECT 'category', jurisdiction, p_brand, NULL, round(amount, 2) FROM top UNION ALL SELECT 'contract', jurisdiction, p_brand, contract, round(amount, 2) FROM con"""


@plan("a12_folder_category_contract", sql("WITH " + CONTRACT_SQL, "l"))
def a12(m: Model):
    rows = m.lines.withColumn("contract", F.concat(F.lit("C"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")))
    out = folding.folder_category_contract(rows, "jurisdiction", "p_brand", "contract", "amount_aud")
    return out.withColumn("amount", F.round("amount", 2))


@plan(
    "a13_folder_aggregates",
    sql(
        """WITH g AS (SELECT jurisdiction, node_name, sum(amount_aud) AS a FROM l GROUP BY ALL),
par AS (SELECT jurisdiction, array_to_string(string_split(node_name, ' / ')[1:-2], ' / ') AS node_name, sum(a) AS a FROM g WHERE node_name LIKE '% / %' GROUP BY ALL)
SELECT jurisdiction, node_name, round(a, 2) AS amount_aud FROM par ANTI JOIN g USING (jurisdiction, node_name)""",
        "l",
    ),
)
def a13(m: Model):
    g = m.lines.groupBy("jurisdiction", T.split_path(F.col("node_name")).alias("path")).agg(F.sum("amount_aud").alias("amount_aud"))
    return A.folder_rows(g, ["jurisdiction"]).select("jurisdiction", T.path_text().alias("node_name"), F.round("amount_aud", 2).alias("amount_aud"))


@plan(
    "a14_coverage_matrix",
    sql(
        """SELECT source_key, count(*) FILTER (estimate_status = 'actual') AS actual, count(*) FILTER (estimate_status = 'audited_actual') AS audited_actual,
  count(*) FILTER (estimate_status = 'budget') AS budget, count(*) FILTER (estimate_status = 'forward_estimate') AS forward_estimate, count(*) AS total FROM f GROUP BY ALL""",
        "f",
    ),
)
def a14(m: Model):
    return A.count_matrix(m.facts, "source_key", "estimate_status", ["actual", "audited_actual", "budget", "forward_estimate"])


@plan("a15_composite_score", sql("SELECT source, round(avg(coalesce(quality, 0)) * 10 + min(coalesce(quality, 0)) + least(count(*), 20), 4) AS score, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"))
def a15(m: Model):
    d = m.table("documents").select("doc_id", "source").join(m.table("labels"), "doc_id", "left")
    q = F.coalesce("quality", F.lit(0))
    return d.groupBy("source").agg(F.round(F.avg(q) * 10 + F.min(q) + F.least(F.count(F.lit(1)), F.lit(20)), 4).alias("score"), F.count(F.lit(1)).alias("n"))


@plan(
    "a16_class_histograms",
    sql(
        """SELECT 'all' AS portfolio, lang || ':' || coalesce(CAST(quality AS VARCHAR), 'none') AS class, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL
UNION ALL SELECT source, lang || ':' || coalesce(CAST(quality AS VARCHAR), 'none'), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"""
    ),
)
def a16(m: Model):
    d = m.table("documents").select("doc_id", "source", "lang").join(m.table("labels"), "doc_id", "left")
    klass = F.concat_ws(":", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("none")))
    fine = d.groupBy(F.col("source").alias("portfolio"), klass.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return fine.groupBy("class").agg(F.sum("n").alias("n")).select(F.lit("all").alias("portfolio"), "class", "n").unionByName(fine)


@plan(
    "a17_top_rows_total",
    sql(
        """WITH t AS (SELECT fact_id, node_name, amount_aud FROM f WHERE compatibility_group = 'actual_expense' AND financial_year = '1998-99' ORDER BY amount_aud DESC, fact_id LIMIT 100)
SELECT *, round((SELECT sum(amount_aud) FROM t), 2) AS total_aud FROM t""",
        "f",
    ),
)
def a17(m: Model):
    rows = m.facts.where((F.col("compatibility_group") == "actual_expense") & (F.col("financial_year") == "1998-99"))
    top = rows.select("fact_id", "node_name", "amount_aud").orderBy(F.desc("amount_aud"), "fact_id").limit(100)
    return top.withColumn("total_aud", top.agg(F.round(F.sum("amount_aud"), 2)).scalar())


@plan(
    "a18_vocabulary",
    sql(
        """WITH g AS (SELECT node_name, level, sum(amount_aud) AS a, arg_max(fact_id, {'a': amount_aud, 'f': fact_id}) AS fid FROM f GROUP BY ALL),
s AS (SELECT DISTINCT label, a, fid, level FROM (SELECT a, fid, level, unnest(list_concat([node_name], string_split(node_name, ' / ')[-2:])) AS label FROM g))
SELECT label, round(max(a), 2) AS amount_aud, arg_max(level, a) AS level FROM s GROUP BY ALL""",
        "f",
    ),
)
def a18(m: Model):
    return A.vocabulary(m.facts).select("label", F.round("amount_aud", 2).alias("amount_aud"), "level")


# Joins

@plan("j1_star_join", sql("SELECT jurisdiction, region, p_type, financial_year, count(*) AS n, round(sum(amount_aud), 2) AS amount_aud FROM l GROUP BY ALL", "l"))
def j1(m: Model):
    return m.lines.groupBy("jurisdiction", "region", "p_type", "financial_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_aud"), 2).alias("amount_aud"))


@plan("j2_left_outer", sql("SELECT lang, coalesce(quality, -1) AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"))
def j2(m: Model):
    d = m.table("documents").select("doc_id", "lang").join(m.table("labels"), "doc_id", "left")
    return d.groupBy("lang", F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@plan(
    "j3_latest_retrieval",
    sql(
        """SELECT c_custkey, c_name, o_orderkey AS latest_order, o_orderstatus AS status FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'O') ON o_custkey = c_custkey AND r = 1"""
    ),
)
def j3(m: Model):
    ok = m.table("orders").where(F.col("o_orderstatus") != "O").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    latest = matching.latest_per_key(ok, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    c = m.table("customer")
    return c.join(latest, c.c_custkey == latest.o_custkey, "left").select("c_custkey", "c_name", F.col("o_orderkey").alias("latest_order"), F.col("o_orderstatus").alias("status"))


@plan("j4_semi_join", sql("SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY ALL"))
def j4(m: Model):
    c, o = m.table("customer"), m.table("orders").where("o_totalprice > 400000").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@plan("j5_anti_join", sql("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)"))
def j5(m: Model):
    return m.table("documents").select("doc_id", "lang").join(m.table("labels").select("doc_id"), "doc_id", "left_anti")


@plan(
    "j6_null_safe_join",
    sql(
        """WITH g AS (SELECT jurisdiction, valuation_basis, compatibility_group, sum(amount_aud) AS a FROM f GROUP BY ALL)
SELECT a.jurisdiction, a.valuation_basis, round(a.a, 2) AS actual, round(b.a, 2) AS budget FROM g a JOIN g b ON a.jurisdiction = b.jurisdiction
 AND a.valuation_basis IS NOT DISTINCT FROM b.valuation_basis WHERE a.compatibility_group = 'actual_expense' AND b.compatibility_group = 'budget_expense'""",
        "f",
    ),
)
def j6(m: Model):
    g = m.facts.groupBy("jurisdiction", "valuation_basis", "compatibility_group").agg(F.sum("amount_aud").alias("a"))
    a = g.where("compatibility_group = 'actual_expense'").alias("a")
    b = g.where("compatibility_group = 'budget_expense'").alias("b")
    on = (F.col("a.jurisdiction") == F.col("b.jurisdiction")) & F.col("a.valuation_basis").eqNullSafe(F.col("b.valuation_basis"))
    return a.join(b, on).select("a.jurisdiction", "a.valuation_basis", F.round("a.a", 2).alias("actual"), F.round("b.a", 2).alias("budget"))


@plan("j7_case_insensitive_join", sql("SELECT p_type, count(*) AS n FROM part JOIN (SELECT DISTINCT upper(p_name) AS u FROM part WHERE p_size > 45) ON lower(p_name) = lower(u) GROUP BY ALL"))
def j7(m: Model):
    p = m.table("part")
    u = p.where("p_size > 45").select(F.upper("p_name").alias("u")).distinct()
    return p.join(u, F.lower("p_name") == F.lower("u")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "j8_prefix_join",
    sql(
        """WITH g AS (SELECT jurisdiction, node_name, sum(amount_aud) AS a FROM l GROUP BY ALL), pre AS (SELECT DISTINCT p_type || ' / ' || p_brand AS prefix FROM part)
SELECT prefix, count(*) AS n_below, round(sum(a), 2) AS amount_aud FROM g JOIN pre ON node_name LIKE prefix || ' / %' GROUP BY ALL""",
        "l",
    ),
)
def j8(m: Model):
    g = m.lines.groupBy("jurisdiction", "node_name").agg(F.sum("amount_aud").alias("a"))
    pre = m.table("part").select(F.concat_ws(T.SEP, "p_type", "p_brand").alias("prefix")).distinct()
    return matching.prefix_join(g, pre, "node_name", "prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("n_below"), F.round(F.sum("a"), 2).alias("amount_aud"))


@plan(
    "j9_longest_ancestor",
    sql(
        """WITH k AS (SELECT DISTINCT node_name FROM l), par AS (SELECT DISTINCT lower(node_name) AS parent FROM f UNION SELECT DISTINCT lower(p_type) FROM part UNION
  SELECT DISTINCT lower(p_type || ' / ' || p_brand) FROM part WHERE p_size > 40),
j AS (SELECT node_name, parent FROM k JOIN par ON lower(node_name) LIKE parent || ' / %')
SELECT node_name, arg_max(parent, length(parent)) AS parent FROM j GROUP BY ALL""",
        "l", "f",
    ),
)
def j9(m: Model):
    kids = m.lines.select("node_name").distinct().withColumn("id", F.col("node_name"))
    p = m.table("part")
    parents = (
        m.facts.select(F.lower("node_name").alias("parent"))
        .unionByName(p.select(F.lower("p_type").alias("parent")))
        .unionByName(p.where("p_size > 40").select(F.lower(F.concat_ws(T.SEP, "p_type", "p_brand")).alias("parent")))
    )
    return matching.longest_ancestor(kids, parents, "id", "node_name", "parent").select("node_name", "parent")


@plan(
    "j10_ranked_candidate_match",
    sql(
        """WITH lab AS (SELECT DISTINCT lower(p_type || ' ' || p_brand || ' ' || p_name) AS label FROM part UNION SELECT DISTINCT lower(p_brand || ' ' || p_name) FROM part WHERE p_size < 3),
nd AS (SELECT leaf, min({'p': priority, 'q': path}) AS b FROM (SELECT lower(p_brand || ' ' || p_name) AS leaf, p_type || ' / ' || p_name AS path, p_size % 3 AS priority FROM part WHERE p_size > 25) GROUP BY ALL),
c AS (SELECT label, 0 AS tier, 0 AS rk, 'seeded' AS parent, 'seed' AS quality FROM lab WHERE label = 'economy brand#17 red widget'
 UNION ALL SELECT label, 1, b.p, b.q, 'exact_leaf' FROM lab JOIN nd ON label = leaf
 UNION ALL SELECT label, 2, b.p, b.q, 'contains_leaf' FROM lab, nd WHERE length(label) >= 16 AND length(leaf) >= 16 AND (contains(label, leaf) OR contains(leaf, label))
   AND least(length(label), length(leaf)) / greatest(length(label), length(leaf)) >= 0.72
 UNION ALL SELECT label, 3, 0, coalesce((SELECT b.q FROM nd WHERE leaf = lower(fn)), fn), 'agency:' || fn FROM (SELECT label, CASE WHEN label LIKE 'small%' OR contains(' ' || label || ' ', ' small ') THEN 'Small goods' WHEN label LIKE 'ring%' OR contains(' ' || label || ' ', ' ring ') THEN 'Brand#11 blue rod' END AS fn FROM lab) WHERE fn IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tier, rk, parent) AS n FROM c)
SELECT lab.label, parent, coalesce(quality, 'unmatched') AS quality FROM lab LEFT JOIN r ON r.label = lab.label AND n = 1"""
    ),
)
def j10(m: Model):
    p = m.table("part")
    short = F.lower(F.concat_ws(" ", "p_brand", "p_name"))
    labels = (
        p.select(F.lower(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("label"))
        .unionByName(p.where("p_size < 3").select(short.alias("label")))
        .distinct()
    )
    nodes = p.where("p_size > 25").select(
        short.alias("leaf"), F.concat_ws(T.SEP, "p_type", "p_name").alias("path"), (F.col("p_size") % 3).alias("priority")
    )
    return matching.ranked_parent(labels, nodes, {"economy brand#17 red widget": "seeded"}, [("small", "Small goods"), ("ring", "Brand#11 blue rod")])


@plan(
    "j11_year_join",
    sql(
        """WITH a AS (SELECT financial_year, sum(amount_aud) AS t FROM f GROUP BY ALL), b AS (SELECT financial_year, sum(amount_aud) AS t FROM l GROUP BY ALL)
SELECT financial_year, round(a.t, 2) AS left_total, round(b.t, 2) AS right_total FROM a LEFT JOIN b USING (financial_year)""",
        "f", "l",
    ),
)
def j11(m: Model):
    a = m.facts.groupBy("financial_year").agg(F.round(F.sum("amount_aud"), 2).alias("left_total"))
    b = m.lines.groupBy("financial_year").agg(F.round(F.sum("amount_aud"), 2).alias("right_total"))
    return a.join(b, "financial_year", "left")


@plan(
    "j12_edge_ends_join",
    sql(
        """WITH e AS (SELECT DISTINCT l_suppkey AS parent, o_custkey AS child FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.region AS parent_region, c.region AS child_region, count(*) AS n FROM e JOIN supplier ON parent = s_suppkey JOIN customer ON child = c_custkey
 JOIN p ON s_nationkey = p.nation_key JOIN p AS c ON c_nationkey = c.nation_key GROUP BY ALL""",
        "p",
    ),
)
def j12(m: Model):
    li, o = m.table("lineitem"), m.table("orders")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("parent"), F.col("o_custkey").alias("child")).distinct()
    pl = m.places.select("nation_key", "region")
    sup = m.table("supplier").join(pl, F.col("s_nationkey") == F.col("nation_key")).select(F.col("s_suppkey").alias("parent"), F.col("region").alias("parent_region"))
    cus = m.table("customer").join(pl, F.col("c_nationkey") == F.col("nation_key")).select(F.col("c_custkey").alias("child"), F.col("region").alias("child_region"))
    return e.join(sup, "parent").join(cus, "child").groupBy("parent_region", "child_region").agg(F.count(F.lit(1)).alias("n"))


@plan("j13_membership", sql("SELECT estimate_status, count(*) AS n FROM f WHERE estimate_status IN ('actual', 'audited_actual') AND jurisdiction IN (SELECT n_name FROM nation WHERE n_regionkey = 2) GROUP BY ALL", "f"))
def j13(m: Model):
    wanted = m.table("nation").where("n_regionkey = 2").select(F.col("n_name").alias("jurisdiction"))
    return mode_rows(m.facts, "actuals").join(wanted, "jurisdiction", "left_semi").groupBy("estimate_status").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "j14_nearest_earlier_year",
    sql(
        """WITH g AS (SELECT jurisdiction, node_name, financial_year, round(sum(amount_aud), 2) AS amount_aud FROM f GROUP BY ALL)
SELECT jurisdiction, node_name, financial_year, amount_aud FROM g WHERE financial_year < '1999-00' QUALIFY row_number() OVER (PARTITION BY jurisdiction, node_name ORDER BY financial_year DESC) = 1""",
        "f",
    ),
)
def j14(m: Model):
    g = m.facts.groupBy("jurisdiction", "node_name", "financial_year").agg(F.round(F.sum("amount_aud"), 2).alias("amount_aud"))
    g = g.withColumn("start", F.substring("financial_year", 1, 4).cast("int"))
    return matching.nearest_earlier(g, ["jurisdiction", "node_name"], F.lit(1999), "start", ["financial_year", "amount_aud"])


# Windows, top-k, order

@plan("w1_first_row_per_child", sql("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_order FROM (SELECT *, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS mp FROM orders) WHERE o_orderpriority = mp GROUP BY ALL"))
def w1(m: Model):
    o = m.table("orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("first_order"))
    return first_per_key(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("first_order")])


@plan(
    "w2_best_fact_per_node_year",
    sql(
        """SELECT jurisdiction, node_name, financial_year, fact_id, estimate_status, amount_aud FROM f QUALIFY row_number() OVER (PARTITION BY jurisdiction, node_name, financial_year
 ORDER BY CASE compatibility_group WHEN 'budget_expense' THEN 0 WHEN 'actual_expense' THEN 1 ELSE 2 END, CASE estimate_status WHEN 'budget' THEN 0 WHEN 'forward_estimate' THEN 3 WHEN 'actual' THEN 4 ELSE 5 END, fact_id) = 1""",
        "f",
    ),
)
def w2(m: Model):
    from factline.graph.facts import best_fact

    return best_fact(m.facts, ["jurisdiction", "node_name", "financial_year"]).select(
        "jurisdiction", "node_name", "financial_year", "fact_id", "estimate_status", "amount_aud"
    )


FOLD_SQL = """g AS (SELECT jurisdiction, p_brand AS program, 'Supplier ' || l_suppkey AS recipient, sum(amount_aud) AS amount_aud FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction, program ORDER BY amount_aud DESC, recipient) AS k, count(*) OVER (PARTITION BY jurisdiction, program) AS n,
  sum(amount_aud) OVER (PARTITION BY jurisdiction, program) AS s FROM g)"""


@plan(
    "w3_top_recipients_with_remainder",
    sql(
        "WITH " + FOLD_SQL.replace("jurisdiction,", "").replace("p_brand AS program", "p_brand AS program").replace("jurisdiction, ", "") + """
SELECT program, recipient, round(amount_aud, 2) AS amount_aud FROM r WHERE s >= 1e6 AND k <= 10
UNION ALL SELECT program, 'Other recipients (' || (n - 10) || ')', round(sum(amount_aud), 2) FROM r WHERE s >= 1e6 AND k > 10 GROUP BY program, n""",
        "l",
    ),
)
def w3(m: Model):
    recipient = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    g = m.lines.groupBy(F.col("p_brand").alias("program"), recipient.alias("recipient")).agg(F.sum("amount_aud").alias("amount_aud"))
    out = folding.top_with_remainder(g, ["program"], "recipient", "amount_aud", 10, "Other recipients", 1e6)
    return out.withColumn("amount_aud", F.round("amount_aud", 2))


@plan(
    "w4_top_contracts_per_category",
    sql("WITH " + CONTRACT_SQL.split("SELECT 'folder'")[0] + " SELECT jurisdiction, p_brand, contract, round(amount, 2) AS amount FROM con", "l"),
)
def w4(m: Model):
    rows = m.lines.withColumn("contract", F.concat(F.lit("C"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")))
    out = folding.folder_category_contract(rows, "jurisdiction", "p_brand", "contract", "amount_aud")
    return out.where("layer = 'contract'").select("jurisdiction", "p_brand", "contract", F.round("amount", 2).alias("amount"))


@plan(
    "w5_fold_to_top_n",
    sql(
        """WITH g AS (SELECT jurisdiction, p_brand, sum(amount_aud) AS v FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY v DESC, p_brand) AS k, count(*) OVER (PARTITION BY jurisdiction) AS n FROM g)
SELECT jurisdiction, p_brand, round(v, 2) AS v FROM r WHERE k <= 7 OR n <= 8 UNION ALL SELECT jurisdiction, 'Other (' || (n - 7) || ')', round(sum(v), 2) FROM r WHERE k > 7 AND n > 8 GROUP BY jurisdiction, n""",
        "l",
    ),
)
def w5(m: Model):
    g = m.lines.groupBy("jurisdiction", "p_brand").agg(F.sum("amount_aud").alias("v"))
    return T.fold_top(g, ["jurisdiction"], "p_brand", "v", 7).withColumn("v", F.round("v", 2))


@plan(
    "w6_carry_forward",
    sql(
        """WITH s AS (SELECT doc_id, line_no, CASE WHEN length(text) > 120 THEN substr(text, 1, 20) END AS section FROM t)
SELECT section, count(*) AS n FROM (SELECT last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM s) GROUP BY ALL""",
        "t",
    ),
)
def w6(m: Model):
    from factline.operators.ordered import fill_forward

    s = m.text_lines.select("doc_id", "line_no", F.when(F.length("text") > 120, F.substring("text", 1, 20)).alias("section"))
    return fill_forward(s, ["doc_id"], ["line_no"], ["section"]).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


W7_FILES = 50


@plan(
    "w7_stride_sample",
    sql(
        """WITH n AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS total FROM documents)
SELECT doc_id, source, position FROM n WHERE position % greatest(1, total // 50) = 0 ORDER BY position LIMIT 50"""
    ),
)
def w7(m: Model):
    d = m.table("documents").select("doc_id", "source")
    return stride_sample(d, "doc_id", W7_FILES)


SEARCH_WHERE = "contains(lower(node_name), 'urgent') AND amount_aud BETWEEN 1000 AND 400000 AND financial_year BETWEEN '1996-97' AND '2000-01'"


@plan("w8_search_ordering", sql(f"SELECT fact_id, amount_aud, financial_year, node_name FROM f WHERE {SEARCH_WHERE} ORDER BY amount_aud DESC, financial_year DESC, lower(node_name), fact_id LIMIT 100", "f"))
def w8(m: Model):
    from factline.search.facts import find_facts, ordered

    rows = find_facts(m.facts, text="urgent", min_amount=1000, max_amount=400000, from_year="1996-97", to_year="2000-01")
    return ordered(rows, "amount_desc").limit(100).select("fact_id", "amount_aud", "financial_year", "node_name")


@plan("w9_page_and_total", sql(f"SELECT fact_id, amount_aud, (SELECT count(*) FROM f WHERE {SEARCH_WHERE}) AS total FROM f WHERE {SEARCH_WHERE} ORDER BY amount_aud, financial_year DESC, lower(node_name), fact_id LIMIT 50 OFFSET 50", "f"))
def w9(m: Model):
    from factline.search.facts import find_facts, page

    rows = find_facts(m.facts, text="urgent", min_amount=1000, max_amount=400000, from_year="1996-97", to_year="2000-01")
    return page(rows, "amount_asc", 50, 50).select("fact_id", "amount_aud", "total")


@plan(
    "w10_backlog_ranking",
    sql(
        """WITH g AS (SELECT source, count(*) AS n, count(quality) AS labelled, sum(coalesce(toxic, 0)) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL),
v AS (SELECT *, ['federal_pbs_', 'abs_qna_', 'state_tcv_', 'local_', 'other_'][1 + CAST(source[4:] AS INTEGER) % 5] || source AS source_id, [10, 20, 30, 50, 90][1 + CAST(source[4:] AS INTEGER) % 5] AS value_rank FROM g),
c AS (SELECT *, CASE WHEN toxic > 3 THEN 1 WHEN labelled * 3 < n THEN 2 WHEN labelled < n THEN 3 ELSE 4 END AS rule FROM v)
SELECT source_id, CAST(value_rank AS INTEGER) AS value_rank, CAST(rule AS INTEGER) AS rule, n, row_number() OVER (ORDER BY value_rank, rule, n DESC, source_id) AS place FROM c"""
    ),
)
def w10(m: Model):
    d = m.table("documents").select("doc_id", "source").join(m.table("labels"), "doc_id", "left")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    rule = F.when(F.col("toxic") > 3, 1).when(F.col("labelled") * 3 < F.col("n"), 2).when(F.col("labelled") < F.col("n"), 3).otherwise(4)
    kinds = F.array(*[F.lit(k) for k in ("federal_pbs_", "abs_qna_", "state_tcv_", "local_", "other_")])
    source_id = F.concat(F.element_at(kinds, (F.substring("source", 4, 9).cast("int") % 5 + 1)), "source")
    ranked = g.select(source_id.alias("source_id"), value_rank(source_id)["rank"].alias("value_rank"), rule.alias("rule"), "n", (-F.col("n")).alias("_less"))
    out = dense_ordinal(ranked, [], ["value_rank", "rule", "_less", "source_id"], "place")
    return out.select("source_id", "value_rank", "rule", "n", (F.col("place") + 1).alias("place"))


@plan(
    "w11_latest_snapshot",
    sql("SELECT user_id, event_type, max(ts)::VARCHAR[:10] AS updated_on, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, count(*) AS n FROM events GROUP BY user_id, event_type".replace("max(ts)::VARCHAR[:10]", "strftime(max(ts), '%Y-%m-%d')")),
)
def w11(m: Model):
    return m.table("events").groupBy("user_id", "event_type").agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("updated_on"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n")
    )


@plan("w12_content_dedupe", sql("SELECT source, sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL"))
def w12(m: Model):
    d = m.table("documents").select("source", F.sha2("text", 256).alias("sha"), "doc_id")
    return d.groupBy("source", "sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


# Sets

@plan("u1_union_all", sql("SELECT source, count(*) AS n FROM (SELECT lang AS source FROM documents UNION ALL SELECT role FROM conversations UNION ALL SELECT event_type FROM events) GROUP BY ALL"))
def u1(m: Model):
    parts = [m.table(t).select(F.col(c).alias("source")) for t, c in (("documents", "lang"), ("conversations", "role"), ("events", "event_type"))]
    return sets.union_all(parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@plan("u2_newly_missing", sql("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'"))
def u2(m: Model):
    o = m.table("orders")
    before = o.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return sets.newly_missing(before, o.where("o_orderstatus = 'P'"), "o_custkey")


@plan("u3_common_years", sql("SELECT financial_year FROM (SELECT DISTINCT level, financial_year FROM f) GROUP BY ALL HAVING count(*) = 4", "f"))
def u3(m: Model):
    return sets.common_values(m.facts, "level", "financial_year", 4)


@plan("u4_union_years", sql("SELECT financial_year FROM f UNION SELECT financial_year FROM l", "f", "l"))
def u4(m: Model):
    return m.facts.select("financial_year").unionByName(m.lines.select("financial_year")).distinct()


@plan(
    "u5_common_names",
    sql(
        """WITH s AS (SELECT CASE WHEN level = 'federal' THEN 'A' ELSE 'B' END AS m, CASE WHEN level = 'federal' THEN upper(p_name) ELSE p_name END AS name FROM l)
SELECT min(CASE WHEN m = 'A' THEN name END) AS name FROM s GROUP BY lower(name) HAVING count(DISTINCT m) = 2""",
        "l",
    ),
)
def u5(m: Model):
    fed = F.col("level") == "federal"
    s = m.lines.select(F.when(fed, "A").otherwise("B").alias("m"), F.when(fed, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return sets.common_names(s, "m", "name", 2)


@plan("u6_top_category_names", sql("SELECT DISTINCT level, string_split(node_name, ' / ')[1] AS name FROM l", "l"))
def u6(m: Model):
    return sets.top_names(m.lines.select("level", F.concat(F.array("jurisdiction"), T.split_path(F.col("node_name"))).alias("path")))
