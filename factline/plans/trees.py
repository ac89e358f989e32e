"""Trees, series, comparison and guards (families T and C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import years as Y
from factline.operators import guards as G
from factline.operators import tree as T
from factline.operators import views as V
from factline.plans.model import Model, sql
from factline.plans.registry import plan
from factline.rules import AGGREGATE_GRANULARITIES, LEVEL_LABELS

LK = ["level", "financial_year"]


def line_paths(m: Model):
    rows = V.mode_rows(m.lines, "actuals")
    return rows.withColumn("path", F.concat(F.array("jurisdiction"), T.split_path(F.col("node_name"))))


def tree_ctes(src: str, where: str = "true", keys: str = "level, financial_year") -> str:
    """SQL of the same tree, as CTEs ending in ``leaf`` and ``nodes``."""
    return f"""
own AS (SELECT {keys}, list_concat([jurisdiction], string_split(node_name, ' / ')) AS path, sum(amount_aud) AS own,
  max(fact_id) AS fact_id FROM {src} WHERE {where} GROUP BY ALL),
pn AS (SELECT {keys}, path, path[1:depth] AS prefix, path[1:depth - 1] AS parent, path[depth] AS seg
  FROM (SELECT *, unnest(range(1, len(path) + 1)) AS depth FROM own)),
nt AS (SELECT DISTINCT {keys}, parent FROM pn WHERE NOT regexp_matches(lower(seg), '^total\\b')),
bad AS (SELECT DISTINCT {keys}, path FROM pn WHERE regexp_matches(lower(seg), '^total\\b')
  AND ({keys}, parent) IN (SELECT {keys}, parent FROM nt)),
kept AS (SELECT * FROM own ANTI JOIN bad USING ({keys}, path)),
inn AS (SELECT DISTINCT {keys}, path[1:d] AS path FROM (SELECT *, unnest(range(1, len(path))) AS d FROM kept)),
leaf AS (SELECT * FROM kept ANTI JOIN inn USING ({keys}, path)),
nodes AS (SELECT {keys}, path[1:d] AS path, CAST(d AS INTEGER) AS depth, sum(own) AS value,
  max(CASE WHEN d = len(path) THEN fact_id END) AS fact_id, count(*) AS n_leaves
  FROM (SELECT *, unnest(range(1, len(path) + 1)) AS d FROM leaf) GROUP BY ALL)"""


ACTUAL = "compatibility_group = 'actual_expense'"


@plan(
    "t1_rollup_tree",
    sql(
        "WITH " + tree_ctes("l", ACTUAL) + """
SELECT level, financial_year, depth, array_to_string(path, ' / ') AS path, path[depth] AS name, round(value, 2) AS value,
  fact_id, n_leaves FROM nodes""",
        "l",
    ),
)
def t1(m: Model):
    rows = line_paths(m)
    nodes = T.tree(rows, LK)
    return nodes.withColumn("path", T.path_text()).withColumn("value", F.round("value", 2))


@plan(
    "t1_preserved_amounts",
    sql(
        """WITH own AS (SELECT level, financial_year, [p_type, p_brand, p_name] AS path, sum(amount_aud) AS own, false AS preserve FROM l GROUP BY ALL UNION ALL SELECT level, financial_year, [p_type], sum(amount_aud) * 2, true FROM l WHERE p_type = 'PROMO' GROUP BY ALL
 UNION ALL SELECT level, financial_year, [p_type, p_brand], 1000.0, true FROM l WHERE p_type = 'SMALL' AND p_brand LIKE '%1' GROUP BY ALL),
c AS (SELECT *, CASE WHEN len(path) = 3 AND path[1] = 'PROMO' THEN 1 WHEN len(path) = 3 AND path[1] = 'SMALL' AND path[2] LIKE '%1' THEN 2 ELSE 0 END AS stop FROM own)
SELECT level, financial_year, array_to_string(path[1:d], ' / ') AS path, round(sum(own), 2) AS value FROM (SELECT *, unnest(range(1, len(path) + 1)) AS d FROM c) WHERE d > stop GROUP BY ALL""",
        "l",
    ),
)
def t1_preserved(m: Model):
    """Nodes with a published amount of their own keep it, and stand for all below them further up."""
    keys = [*LK]
    rows = m.lines.select(*LK, "p_type", "p_brand", "p_name", "amount_aud")
    leaf = rows.groupBy(*keys, F.array("p_type", "p_brand", "p_name").alias("path")).agg(F.sum("amount_aud").alias("own")).withColumn("preserve", F.lit(False))
    tops = rows.where("p_type = 'PROMO'").groupBy(*keys, F.array("p_type").alias("path")).agg((F.sum("amount_aud") * 2).alias("own")).withColumn("preserve", F.lit(True))
    mids = rows.where("p_type = 'SMALL' and p_brand like '%1'").select(*keys, F.array("p_type", "p_brand").alias("path")).distinct().select("*", F.lit(1000.0).alias("own"), F.lit(True).alias("preserve"))
    own = leaf.unionByName(tops).unionByName(mids).withColumn("fact_id", F.lit(None).cast("long"))
    nodes = T.preserved_roll_up(own, keys)
    return nodes.select(*LK, T.path_text().alias("path"), F.round("value", 2).alias("value"))


@plan(
    "t2_total_pruning",
    sql("WITH " + tree_ctes("l", ACTUAL) + " SELECT level, financial_year, array_to_string(path, ' / ') AS path, round(own, 2) AS own FROM kept", "l"),
)
def t2(m: Model):
    own = T.pruned_amounts(line_paths(m), LK)
    return own.select(*LK, T.path_text().alias("path"), F.round("own", 2).alias("own"))


KIND_SQL = """
kids AS (SELECT jurisdiction, financial_year, CASE WHEN l_linestatus2 = 'N' THEN 'related_breakdown' ELSE 'same_group' END AS kind,
  CASE WHEN l_linestatus2 = 'N' AND p_type IN ('ECONOMY', 'SMALL') THEN 'Statement 6 ' || p_type
       WHEN l_linestatus2 = 'N' AND p_type = 'PROMO' THEN 'FBO Appendix A' ELSE p_type END AS name,
  sum(CASE WHEN l_linestatus2 = 'N' AND p_type = 'STANDARD' THEN 0 ELSE amount_aud END) AS value
  FROM (SELECT *, CASE WHEN compatibility_group = 'budget_expense' THEN 'N' ELSE 'A' END AS l_linestatus2 FROM l) GROUP BY ALL)"""


def kind_children(m: Model):
    related = F.col("compatibility_group") == "budget_expense"
    name = (
        F.when(related & F.col("p_type").isin("ECONOMY", "SMALL"), F.concat(F.lit("Statement 6 "), "p_type"))
        .when(related & (F.col("p_type") == "PROMO"), "FBO Appendix A")
        .otherwise(F.col("p_type"))
    )
    value = F.when(related & (F.col("p_type") == "STANDARD"), 0.0).otherwise(F.col("amount_aud"))
    return m.lines.groupBy(
        "jurisdiction",
        "financial_year",
        F.when(related, "related_breakdown").otherwise("same_group").alias("kind"),
        name.alias("name"),
    ).agg(F.sum(value).alias("value"))


@plan(
    "t3_additive_children",
    sql(
        "WITH " + KIND_SQL + """
SELECT jurisdiction, financial_year, round(sum(value), 2) AS value, count(*) AS n_children FROM kids
WHERE NOT (kind = 'related_breakdown' AND (value = 0 OR name LIKE 'Statement 6%' OR name LIKE 'FBO Appendix A%')) GROUP BY ALL""",
        "l",
    ),
)
def t3(m: Model):
    kept = V.additive_children(kind_children(m))
    return kept.groupBy("jurisdiction", "financial_year").agg(
        F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("n_children")
    )


@plan(
    "t4_mode_filter",
    sql(
        """SELECT CASE WHEN compatibility_group = 'actual_expense' THEN 'actuals' ELSE 'budget' END AS mode, level, financial_year,
  round(sum(amount_aud), 2) AS total_aud, count(*) AS n_facts FROM f GROUP BY ALL""",
        "f",
    ),
)
def t4(m: Model):
    parts = [V.mode_rows(m.facts, mode).withColumn("mode", F.lit(mode)) for mode in ("actuals", "budget")]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("mode", *LK).agg(
        F.round(F.sum("amount_aud"), 2).alias("total_aud"), F.count(F.lit(1)).alias("n_facts")
    )


ECO_SQL = """eco AS (SELECT fact_id, amount_aud, financial_year,
  CASE WHEN compatibility_group = 'actual_expense' THEN 'gdp_current' ELSE 'gva_current' END AS measure_type,
  CASE WHEN estimate_status = 'audited_actual' THEN p_brand || ' (' || substr(p_name, 1, 1) || ')' WHEN p_type = 'PROMO' THEN 'Tax as % of GDP ' || p_brand
    WHEN p_type = 'SMALL' THEN 'Gross fixed capital ' || p_brand WHEN p_type = 'LARGE' THEN 'Industry ' || p_brand
    WHEN p_type = 'ECONOMY' THEN p_brand || ' (' || upper(substr(p_name, 1, 1)) || ')' ELSE p_brand END AS node_name FROM l)"""


@plan(
    "t5_economy_filters",
    sql(
        "WITH " + ECO_SQL + r""", tagged AS (SELECT *, regexp_matches(node_name, '\([A-S]\)\s*($|/)') AS ind FROM eco), picked AS (
SELECT 'gdp_current' AS mode, * FROM tagged WHERE measure_type = 'gdp_current' AND NOT ind AND NOT regexp_matches(lower(node_name), 'tax.*%|% of gdp|derived ratio')
UNION ALL SELECT 'gdp_expenditure', * FROM tagged WHERE measure_type = 'gdp_current' AND NOT ind AND regexp_matches(lower(node_name), 'gross fixed')
UNION ALL SELECT 'gva_current', * FROM tagged WHERE ind OR regexp_matches(lower(node_name), 'industry'))
SELECT mode, node_name, round(sum(amount_aud), 2) AS amount_aud, count(*) AS n FROM picked GROUP BY ALL""",
        "l",
    ),
)
def t5(m: Model):
    initial = F.concat(F.lit(" ("), F.substring("p_name", 1, 1), F.lit(")"))
    name = (
        F.when(F.col("estimate_status") == "audited_actual", F.concat("p_brand", initial))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("Tax as % of GDP "), "p_brand"))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("Gross fixed capital "), "p_brand"))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("Industry "), "p_brand"))
        .when(F.col("p_type") == "ECONOMY", F.concat("p_brand", F.upper(initial)))
        .otherwise(F.col("p_brand"))
    )
    measure = F.when(F.col("compatibility_group") == "actual_expense", "gdp_current").otherwise("gva_current")
    eco = m.lines.select("amount_aud", measure.alias("measure_type"), name.alias("node_name"))
    # names and measures repeat far more than facts: combine first, then test patterns once per name
    eco = eco.groupBy("measure_type", "node_name").agg(F.sum("amount_aud").alias("amount_aud"), F.count(F.lit(1)).alias("n"))
    parts = [
        V.economy_rows(eco, mode).withColumn("mode", F.lit(mode)) for mode in ("gdp_current", "gdp_expenditure", "gva_current")
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("mode", "node_name").agg(
        F.round(F.sum("amount_aud"), 2).alias("amount_aud"), F.sum("n").alias("n")
    )


BASIS_SQL = """pref AS (SELECT level, financial_year, CASE WHEN bool_or(accounting_basis = 'gfs') THEN 'gfs'
  WHEN bool_or(accounting_basis = 'accrual') THEN 'accrual' END AS preferred_basis FROM f WHERE compatibility_group = 'actual_expense' GROUP BY ALL)"""


@plan(
    "t6_preferred_basis",
    sql(
        "WITH " + BASIS_SQL + """ SELECT level, financial_year, preferred_basis, count(*) AS n_facts, round(sum(amount_aud), 2) AS total_aud
FROM f JOIN pref USING (level, financial_year) WHERE compatibility_group = 'actual_expense' AND accounting_basis = preferred_basis GROUP BY ALL""",
        "f",
    ),
)
def t6(m: Model):
    rows = V.with_preferred_basis(V.mode_rows(m.facts, "actuals"), LK)
    return rows.groupBy(*LK, F.col("accounting_basis").alias("preferred_basis")).agg(
        F.count(F.lit(1)).alias("n_facts"), F.round(F.sum("amount_aud"), 2).alias("total_aud")
    )


T7_PARENTS = {"ECONOMY": "STANDARD", "STANDARD": "MEDIUM", "MEDIUM": "LARGE", "LARGE": "ECONOMY"}


@plan(
    "t7_path_builders",
    sql(
        """WITH src AS (SELECT CASE region WHEN 'africa' THEN 'aofm_x' WHEN 'america' THEN 'abs_gfs_x_revenue' WHEN 'asia' THEN 'abs_gfs_x_liabilities'
    WHEN 'europe' THEN 'abs_gfs_x' ELSE 'plain' END AS source_key,
  CASE WHEN region IN ('america', 'europe') THEN p_type WHEN region = 'asia' AND p_type = 'PROMO' THEN 'Total Liabilities'
    WHEN region = 'africa' AND p_type = 'PROMO' THEN 'Debt securities / ' || p_brand ELSE node_name END AS node_name, amount_aud FROM l),
paths AS (SELECT source_key, amount_aud, CASE
  WHEN source_key = 'aofm_x' THEN CASE WHEN node_name LIKE 'Debt securities%' THEN node_name ELSE 'Debt securities / ' || node_name END
  WHEN source_key = 'abs_gfs_x_liabilities' THEN CASE WHEN node_name <> 'Total Liabilities' THEN node_name END
  WHEN source_key = 'abs_gfs_x_revenue' THEN CASE node_name WHEN 'ECONOMY' THEN 'LARGE / MEDIUM / STANDARD / ECONOMY' WHEN 'STANDARD' THEN 'ECONOMY / LARGE / MEDIUM / STANDARD'
    WHEN 'MEDIUM' THEN 'STANDARD / ECONOMY / LARGE / MEDIUM' WHEN 'LARGE' THEN 'MEDIUM / STANDARD / ECONOMY / LARGE' ELSE node_name END
  WHEN source_key = 'abs_gfs_x' THEN CASE node_name WHEN 'PROMO' THEN 'SMALL / PROMO' WHEN 'LARGE' THEN 'SMALL' ELSE node_name END
  ELSE node_name END AS path FROM src)
SELECT source_key, path, round(sum(amount_aud), 2) AS amount_aud FROM paths WHERE path IS NOT NULL GROUP BY ALL""",
        "l",
    ),
)
def t7(m: Model):
    r = F.col("region")
    source = (
        F.when(r == "africa", "aofm_x")
        .when(r == "america", "abs_gfs_x_revenue")
        .when(r == "asia", "abs_gfs_x_liabilities")
        .when(r == "europe", "abs_gfs_x")
        .otherwise("plain")
    )
    name = (
        F.when(r.isin("america", "europe"), F.col("p_type"))
        .when((r == "asia") & (F.col("p_type") == "PROMO"), "Total Liabilities")
        .when((r == "africa") & (F.col("p_type") == "PROMO"), F.concat(F.lit("Debt securities / "), "p_brand"))
        .otherwise(F.col("node_name"))
    )
    named = m.lines.groupBy(source.alias("source_key"), name.alias("node_name")).agg(F.sum("amount_aud").alias("amount_aud"))
    path = V.source_path(
        F.col("source_key"), F.col("node_name"), None, T7_PARENTS, {"PROMO": "SMALL"}, {"LARGE": "SMALL"}
    )
    rows = named.withColumn("path", path).where(F.col("path").isNotNull())
    return rows.groupBy("source_key", T.path_text().alias("path")).agg(F.round(F.sum("amount_aud"), 2).alias("amount_aud"))


@plan(
    "t8_rollup_rows_excluded",
    sql(
        """WITH tagged AS (SELECT jurisdiction, amount_aud,
  CASE WHEN l_orderkey % 5 = 0 THEN 'roll_up:sum_instruments' WHEN p_type = 'PROMO' THEN 'roll_up:other' ELSE 'cell:B2' END AS locator,
  CASE WHEN p_brand < 'Brand#2' THEN 'instrument_type_aggregate' END AS amount_granularity FROM l)
SELECT jurisdiction, count(*) AS n, round(sum(amount_aud), 2) AS amount_aud FROM tagged WHERE NOT (locator LIKE '%roll_up:sum_instruments%'
  OR (coalesce(amount_granularity, '') = 'instrument_type_aggregate' AND locator LIKE '%roll_up:%')) GROUP BY ALL""",
        "l",
    ),
)
def t8(m: Model):
    rows = m.lines.select(
        "jurisdiction",
        "amount_aud",
        F.when(F.col("l_orderkey") % 5 == 0, "roll_up:sum_instruments")
        .when(F.col("p_type") == "PROMO", "roll_up:other")
        .otherwise("cell:B2")
        .alias("locator"),
        F.when(F.col("p_brand") < "Brand#2", AGGREGATE_GRANULARITIES[0]).alias("amount_granularity"),
    )
    return V.without_roll_ups(rows).groupBy("jurisdiction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_aud"), 2).alias("amount_aud")
    )


@plan(
    "t9_quality_and_valuation_filter",
    sql(
        """SELECT level, financial_year, count(*) AS n, round(sum(amount_aud), 2) AS amount_aud FROM f
WHERE coalesce(quality_status, 'ok') NOT IN ('quarantined', 'rejected') AND coalesce(valuation_basis, 'unspecified') = 'unspecified' GROUP BY ALL""",
        "f",
    ),
)
def t9(m: Model):
    rows = V.valuation_rows(V.good_quality(m.facts), "unspecified")
    return rows.groupBy(*LK).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_aud"), 2).alias("amount_aud"))


@plan(
    "t10_node_attributes_and_warnings",
    sql(
        """WITH a AS (SELECT level, financial_year, jurisdiction, node_name, count(DISTINCT observation_date) AS n_dates,
  array_to_string(list_sort(list_distinct(list(valuation_basis))), ',') AS valuation_bases FROM f GROUP BY ALL)
SELECT *, CASE WHEN n_dates > 1 AND valuation_bases LIKE '%,%' THEN 'mixed dates; mixed bases' WHEN n_dates > 1 THEN 'mixed dates'
  WHEN valuation_bases LIKE '%,%' THEN 'mixed bases' ELSE '' END AS warning FROM a""",
        "f",
    ),
)
def t10(m: Model):
    a = m.facts.groupBy(*LK, "jurisdiction", "node_name").agg(
        F.count_distinct("observation_date").alias("n_dates"),
        F.array_sort(F.collect_set("valuation_basis")).alias("bases"),
    )
    warning = F.concat_ws(
        "; ", F.when(F.col("n_dates") > 1, "mixed dates"), F.when(F.size("bases") > 1, "mixed bases")
    )
    return a.select(
        *LK, "jurisdiction", "node_name", "n_dates", F.array_join("bases", ",").alias("valuation_bases"), warning.alias("warning")
    )


@plan(
    "t11_root_total_or_suppression",
    sql(
        "WITH " + tree_ctes("f", "measure_type = 'expense_actual'") + """,
d AS (SELECT level, financial_year, count(DISTINCT coalesce(valuation_basis, 'unspecified')) > 1 AS clash,
   min(observation_date) <> max(observation_date) AS dates FROM f WHERE measure_type = 'expense_actual' GROUP BY ALL)
SELECT level, financial_year, round(sum(CASE WHEN clash OR coalesce(dates, false) THEN 0 ELSE value END), 2) AS value, 'AUD' AS unit,
  NOT (clash OR coalesce(dates, false)) AS root_total_allowed FROM nodes JOIN d USING (level, financial_year) WHERE depth = 1 GROUP BY ALL""",
        "f",
    ),
)
def t11(m: Model):
    rows = m.facts.where(F.col("measure_type") == "expense_actual")
    nodes = T.tree(rows.withColumn("path", F.concat(F.array("jurisdiction"), T.split_path(F.col("node_name")))), LK)
    roots = V.root_totals(nodes, G.compatibility(rows, "debt_stock", LK), LK)
    return roots.select(*LK, F.round("value", 2).alias("value"), "unit", "root_total_allowed")


@plan(
    "t12_level_series",
    sql(
        "WITH " + tree_ctes("l", ACTUAL) + """ SELECT level, financial_year, round(sum(value), 2) AS total_aud
FROM nodes WHERE depth = 1 GROUP BY ALL""",
        "l",
    ),
)
def t12(m: Model):
    leaf = T.leaf_amounts(line_paths(m), LK)
    return leaf.groupBy(*LK).agg(F.round(F.sum("own"), 2).alias("total_aud"))


@plan(
    "t13_named_node_sum",
    sql(
        "WITH " + tree_ctes("l", ACTUAL) + """ SELECT level, financial_year, round(sum(own), 2) AS total_aud, max(fact_id) AS fact_id
FROM leaf WHERE list_contains(list_transform(path, lambda x: lower(x)), 'brand#7') GROUP BY ALL""",
        "l",
    ),
)
def t13(m: Model):
    leaf = T.leaf_amounts(line_paths(m), LK)
    return T.named_total(leaf, LK, "BRAND#7").select(*LK, F.round("value", 2).alias("total_aud"), "fact_id")


@plan(
    "t14_levels_side_by_side",
    sql(
        "WITH " + tree_ctes("l", ACTUAL) + """ SELECT financial_year, CASE level WHEN 'federal' THEN 'Federal' WHEN 'state' THEN 'State'
  WHEN 'territory' THEN 'Territory' ELSE 'Local' END AS name, round(sum(value), 2) AS value, 0.0::DOUBLE AS root_value FROM nodes WHERE depth = 1 GROUP BY ALL""",
        "l",
    ),
)
def t14(m: Model):
    leaf = T.leaf_amounts(line_paths(m), LK)
    label = F.create_map(*[F.lit(x) for kv in LEVEL_LABELS.items() for x in kv])[F.col("level")]
    return leaf.groupBy("financial_year", label.alias("name")).agg(
        F.round(F.sum("own"), 2).alias("value"), F.lit(0.0).alias("root_value")
    )


@plan(
    "t15_unclassified_leaf",
    sql(
        """WITH r AS (SELECT level, financial_year, jurisdiction, string_split(node_name, ' / ')[1] AS category, string_split(node_name, ' / ')[2] AS subcategory,
   sum(amount_aud) AS amount FROM f GROUP BY ALL), s AS (SELECT *, count(subcategory) OVER (PARTITION BY level, financial_year, jurisdiction, category) AS n_sub FROM r)
SELECT level, financial_year, jurisdiction, category, CASE WHEN subcategory IS NULL AND n_sub > 0 THEN '(unclassified)' ELSE coalesce(subcategory, category) END AS leaf,
  round(amount, 2) AS value FROM s""",
        "f",
    ),
)
def t15(m: Model):
    keys = [*LK, "jurisdiction", "category"]
    parts = F.split("node_name", T.SEP)
    r = m.facts.groupBy(
        *LK, "jurisdiction", parts[0].alias("category"), F.get(parts, F.lit(1)).alias("subcategory")
    ).agg(F.sum("amount_aud").alias("amount"))
    nested = r.where(F.col("subcategory").isNotNull()).select(*keys).distinct().withColumn("nested", F.lit(True))
    j = r.join(nested, keys, "left")
    leaf = F.when(F.col("subcategory").isNull() & F.col("nested"), "(unclassified)").otherwise(
        F.coalesce("subcategory", "category")
    )
    return j.select(*keys, leaf.alias("leaf"), F.round("amount", 2).alias("value"))


def ring_frames(m: Model):
    """Published brand amounts (own rows) and the name-level children below them, per jurisdiction."""
    rows = line_paths(m).where(~F.col("node_name").startswith("Total"))
    own = rows.groupBy("jurisdiction", "path").agg(F.sum("amount_aud").alias("value"))
    published = own.where(F.size("path") == 3).select("jurisdiction", "path", F.col("value").alias("published"))
    return own.where(F.size("path") == 4), published


RING_SQL = """own AS (SELECT jurisdiction, node_name, sum(amount_aud) AS value FROM l WHERE compatibility_group = 'actual_expense'
  AND node_name NOT LIKE 'Total%' GROUP BY ALL),
pub AS (SELECT jurisdiction, node_name AS parent, value AS published FROM own WHERE len(string_split(node_name, ' / ')) = 2),
kids AS (SELECT jurisdiction, array_to_string(string_split(node_name, ' / ')[1:2], ' / ') AS parent, node_name, value FROM own WHERE len(string_split(node_name, ' / ')) = 3),
st AS (SELECT jurisdiction, parent, sum(value) AS s, max(value) AS mx FROM kids GROUP BY ALL)"""


@plan(
    "t16_nestable_children",
    sql(
        "WITH " + RING_SQL + """ SELECT jurisdiction, node_name, round(value, 2) AS value FROM kids JOIN st USING (jurisdiction, parent)
LEFT JOIN pub USING (jurisdiction, parent) WHERE NOT (coalesce(published, 0) > 0 AND s > published * 1.25 AND mx > published * 1.25 AND value > published * 1.01)""",
        "l",
    ),
)
def t16(m: Model):
    kids, published = ring_frames(m)
    kept = V.nestable(kids, published, ["jurisdiction"])
    return kept.select(
        "jurisdiction", F.array_join(F.slice("path", F.lit(2), F.size("path")), T.SEP).alias("node_name"), F.round("value", 2).alias("value")
    )


@plan(
    "t17_scale_to_published_parent",
    sql(
        "WITH " + RING_SQL + """ SELECT jurisdiction, node_name, round(value * CASE WHEN published IS NULL OR abs(s - published) < 0.5 THEN 1 ELSE published / s END, 2) AS value
FROM kids JOIN st USING (jurisdiction, parent) LEFT JOIN pub USING (jurisdiction, parent)""",
        "l",
    ),
)
def t17(m: Model):
    kids, published = ring_frames(m)
    scaled = V.scale_to_parent(kids, published, ["jurisdiction"])
    return scaled.select(
        "jurisdiction", F.array_join(F.slice("path", F.lit(2), F.size("path")), T.SEP).alias("node_name"), F.round("value", 2).alias("value")
    )


@plan(
    "t18_same_name_collapse",
    sql(
        """WITH base AS (SELECT jurisdiction, p_type, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE p_brand END AS mid, p_name, sum(amount_aud) AS value
  FROM l GROUP BY ALL), grp AS (SELECT jurisdiction, p_type, mid, sum(value) AS value FROM base GROUP BY ALL)
SELECT jurisdiction AS path, round(sum(value), 2) AS value FROM base GROUP BY ALL
UNION ALL SELECT jurisdiction || ' / ' || p_type, round(sum(value), 2) FROM base GROUP BY ALL
UNION ALL SELECT jurisdiction || ' / ' || p_type || ' / ' || mid, round(sum(value), 2) FROM base WHERE mid <> p_type GROUP BY ALL
UNION ALL SELECT jurisdiction || ' / ' || p_type || CASE WHEN mid <> p_type THEN ' / ' || mid ELSE '' END || ' / ' || p_name, round(sum(value), 2) FROM base GROUP BY ALL""",
        "l",
    ),
)
def t18(m: Model):
    mid = F.when(F.col("p_type").isin("PROMO", "SMALL"), F.col("p_type")).otherwise(F.col("p_brand"))
    leaf = m.lines.groupBy(F.array("jurisdiction", "p_type", mid, "p_name").alias("path")).agg(
        F.sum("amount_aud").alias("own"), F.max("fact_id").alias("fact_id")
    )
    nodes = T.collapse_repeats(T.roll_up(leaf, []), [])
    return nodes.select(T.path_text().alias("path"), F.round("value", 2).alias("value"))


@plan(
    "t19_ring_roots_and_depth",
    sql(
        "WITH " + tree_ctes("f", "measure_type = 'expense_actual'") + """
SELECT level, financial_year, path[1] AS jurisdiction, max(depth) - 1 AS depth, count(DISTINCT path[2]) AS n_roots FROM nodes WHERE value > 0 AND depth > 1 GROUP BY ALL""",
        "f",
    ),
)
def t19(m: Model):
    rows = m.facts.where(F.col("measure_type") == "expense_actual")
    nodes = T.tree(rows.withColumn("path", F.concat(F.array("jurisdiction"), T.split_path(F.col("node_name")))), LK)
    drawn = nodes.where((F.col("value") > 0) & (F.col("depth") > 1))
    return drawn.groupBy(*LK, F.col("path")[0].alias("jurisdiction")).agg(
        (F.max("depth") - 1).alias("depth"), F.count(F.when(F.col("depth") == 2, 1)).alias("n_roots")
    )


@plan(
    "t20_drill_path",
    sql(
        "WITH " + tree_ctes("l", ACTUAL) + """, hit AS (SELECT level, financial_year, depth, array_to_string(path, ' / ') AS path FROM nodes
 WHERE contains(lower(path[depth]), 'red bolt') OR contains('red bolt', lower(path[depth])))
SELECT level, financial_year, arg_max(path, {'d': depth, 'p': path}) AS path, max(depth) AS depth FROM hit GROUP BY ALL""",
        "l",
    ),
)
def t20(m: Model):
    wanted = F.lit("red bolt")
    nodes = T.tree(line_paths(m), LK).select(*LK, "depth", T.path_text().alias("path"), F.lower("name").alias("name"))
    hit = nodes.where(F.contains("name", wanted) | F.contains(wanted, F.col("name")))
    return hit.groupBy(*LK).agg(
        F.max_by("path", F.struct("depth", "path")).alias("path"), F.max("depth").alias("depth")
    )


@plan(
    "t20_drill_to_fact",
    sql(
        "WITH " + tree_ctes("l", ACTUAL) + """, w AS (SELECT level, financial_year, CASE WHEN level <> 'state' THEN max(fact_id) FILTER (WHERE depth = 2) END AS wf FROM nodes GROUP BY level, financial_year),
hit AS (SELECT level, financial_year, coalesce(fact_id = wf, false) AS exact, depth, array_to_string(path, ' / ') AS path FROM nodes JOIN w USING (level, financial_year) WHERE coalesce(fact_id = wf, false) OR contains(lower(path[depth]), 'red bolt') OR contains('red bolt', lower(path[depth])))
SELECT level, financial_year, arg_max(path, {'e': exact, 'd': depth, 'p': path}) AS path, arg_max(depth, {'e': exact, 'd': depth, 'p': path}) AS depth, max(exact) AS exact FROM hit GROUP BY ALL""",
        "l",
    ),
)
def t20_fact(m: Model):
    """A fact of the second layer wins over deeper nodes with the name; one level asks by name alone."""
    nodes = T.tree(line_paths(m), LK)
    second = F.max(F.when(F.col("depth") == 2, F.col("fact_id")))
    wanted = nodes.groupBy(*LK).agg(second.alias("f")).select(*LK, F.when(F.col("level") != "state", F.col("f")).alias("want_fact"), F.lit("red bolt").alias("want_name"))
    return T.drill_path(nodes, LK, wanted)


@plan(
    "t14_combined_trees",
    sql(
        "WITH " + tree_ctes("f", "measure_type = 'expense_actual' AND (level <> 'federal' OR jurisdiction = (SELECT min(jurisdiction) FROM f WHERE level = 'federal'))") + """
SELECT financial_year, level, CAST(CASE WHEN level = 'federal' THEN depth - 1 ELSE depth END AS INTEGER) AS depth, array_to_string(CASE WHEN level = 'federal' THEN path[2:] ELSE path END, ' / ') AS path, round(value, 2) AS value FROM nodes WHERE level <> 'federal' OR depth > 1""",
        "f",
    ),
)
def t14_trees(m: Model):
    """Whole trees beside each other; the federal level is cut to one jurisdiction, which is then taken off its paths."""
    one = m.facts.where("level = 'federal'").agg(F.min("jurisdiction")).scalar()
    rows = m.facts.where((F.col("measure_type") == "expense_actual")).withColumn("_one", one).where("level <> 'federal' or jurisdiction = _one")
    nodes = T.tree(rows.withColumn("path", F.concat(F.array("jurisdiction"), T.split_path(F.col("node_name")))), LK)
    return T.side_by_side(nodes).select("financial_year", "level", "depth", T.path_text().alias("path"), F.round("value", 2).alias("value"))


# Monthly year-to-date series made from events: one measure per event type, one jurisdiction per user block.
MEASURE_KINDS = {
    "ytd_click": "flow", "ytd_view": "flow", "ytd_purchase": "balance", "ytd_error": "stock", "ytd_signup": "stock_balance",
}
MONTHLY_SQL = """mo AS (SELECT 'ytd_' || event_type AS measure_type, 2010 + (user_id // 12) % 4 AS y, CAST(1 + user_id % 12 AS BIGINT) AS mnum, round(sum(value), 2) AS amount_aud,
  count(*) AS n FROM events GROUP BY ALL),
mfs AS (SELECT measure_type, CASE WHEN mnum >= 7 THEN printf('%d-%02d', y, (y + 1) % 100) ELSE printf('%d-%02d', y - 1, y % 100) END AS financial_year,
  monthname(make_date(2000, CAST(mnum AS INTEGER), 1)) AS reporting_month, strftime(last_day(make_date(CAST(y AS INTEGER), CAST(mnum AS INTEGER), 1)), '%Y-%m-%d') AS period_end, amount_aud, mnum FROM mo)"""


def monthly(m: Model):
    e = m.table("events")
    y, mnum = (F.lit(2010) + F.floor(F.col("user_id") / 12) % 4).cast("int"), (F.lit(1) + F.col("user_id") % 12).cast("int")
    g = e.groupBy(F.concat(F.lit("ytd_"), "event_type").alias("measure_type"), y.alias("y"), mnum.alias("mnum")).agg(
        F.round(F.sum("value"), 2).alias("amount_aud")
    )
    fy = Y.fy_label(F.col("y") - F.when(F.col("mnum") >= 7, 0).otherwise(1))
    name = F.element_at(F.array(*[F.lit(x) for x in Y.MONTHS]), F.col("mnum"))
    return g.select(
        "measure_type",
        fy.alias("financial_year"),
        name.alias("reporting_month"),
        F.date_format(Y.period_end(fy, name), "yyyy-MM-dd").alias("period_end"),
        "amount_aud",
    )


@plan(
    "t21_measure_catalogue",
    sql(
        """SELECT 'ytd_' || event_type AS measure_type, CASE event_type WHEN 'click' THEN 'flow' WHEN 'view' THEN 'flow' WHEN 'purchase' THEN 'balance'
  WHEN 'error' THEN 'stock' ELSE 'stock_balance' END AS flow_or_stock, event_type AS label, count(*) AS n_facts FROM events GROUP BY ALL"""
    ),
)
def t21(m: Model):
    spec = m.local(list(MEASURE_KINDS.items()), "measure_type string, flow_or_stock string")
    counts = m.table("events").groupBy(F.concat(F.lit("ytd_"), "event_type").alias("measure_type"), F.col("event_type").alias("label")).agg(
        F.count(F.lit(1)).alias("n_facts")
    )
    return spec.join(counts, "measure_type", "left")


@plan("t22_measure_series", sql("WITH " + MONTHLY_SQL + " SELECT financial_year, reporting_month, period_end, amount_aud FROM mfs WHERE measure_type = 'ytd_view'"))
def t22(m: Model):
    return V.measure_series(monthly(m), "ytd_view").drop("measure_type")


@plan(
    "t23_elapsed_months",
    sql("WITH " + MONTHLY_SQL + " SELECT measure_type, financial_year, reporting_month, CAST((mnum + 5) % 12 + 1 AS INTEGER) AS elapsed_months FROM mfs"),
)
def t23(m: Model):
    return monthly(m).select(
        "measure_type", "financial_year", "reporting_month", Y.elapsed_months(F.col("reporting_month")).alias("elapsed_months")
    )


@plan("t24_parallel_compare", sql("WITH " + MONTHLY_SQL + " SELECT measure_type, financial_year, period_end, amount_aud FROM mfs WHERE measure_type IN ('ytd_view', 'ytd_click', 'ytd_purchase')"))
def t24(m: Model):
    picked = V.compare_series(monthly(m), MEASURE_KINDS, ["ytd_view", "ytd_click", "ytd_purchase"])
    return picked.select("measure_type", "financial_year", "period_end", "amount_aud")


@plan(
    "t25_year_on_year",
    sql(
        "WITH " + MONTHLY_SQL + """ SELECT a.measure_type, a.reporting_month, a.amount_aud AS current, b.amount_aud AS previous, round(a.amount_aud - b.amount_aud, 2) AS change
FROM mfs a JOIN mfs b ON a.measure_type = b.measure_type AND a.reporting_month = b.reporting_month WHERE a.financial_year = '2011-12' AND b.financial_year = '2010-11'"""
    ),
)
def t25(m: Model):
    pairs = V.year_on_year(monthly(m), "2011-12", "2010-11", ["measure_type", "reporting_month"])
    return pairs.withColumn("change", F.round(F.col("current") - F.col("previous"), 2))


@plan(
    "t26_actual_budget_pairs",
    sql(
        """SELECT jurisdiction, financial_year, round(sum(CASE WHEN estimate_status IN ('actual', 'audited_actual') THEN amount_aud END), 2) AS actual,
  round(sum(CASE WHEN estimate_status = 'budget' THEN amount_aud END), 2) AS budget FROM f GROUP BY ALL""",
        "f",
    ),
)
def t26(m: Model):
    p = V.actual_budget_pairs(m.facts, ["jurisdiction", "financial_year"])
    return p.withColumn("actual", F.round("actual", 2)).withColumn("budget", F.round("budget", 2))


@plan("t27_years_per_measure", sql("SELECT DISTINCT measure_type, financial_year FROM f", "f"))
def t27(m: Model):
    return m.facts.select("measure_type", "financial_year").distinct().orderBy("measure_type", "financial_year")


@plan(
    "c1_fact_set_validation",
    sql(
        """WITH d AS (SELECT level, financial_year, array_to_string(list_sort(list_distinct(list(price_basis))), ',') AS price_bases,
  count(DISTINCT coalesce(valuation_basis, 'unspecified')) > 1 AS mixed_valuation, coalesce(min(observation_date) <> max(observation_date), false) AS mixed_dates,
  bool_or(price_basis = 'current_prices') AS cp FROM f WHERE compatibility_group = 'actual_expense' GROUP BY ALL)
SELECT level, financial_year, price_bases, mixed_valuation, mixed_dates, NOT cp AS allowed,
  NOT (mixed_valuation OR mixed_dates) AS root_total_allowed, NOT mixed_valuation AS additive_across_nodes,
  CASE WHEN cp THEN 'Price basis [current_prices] not allowed for debt_stock' ELSE '' END AS errors FROM d""",
        "f",
    ),
)
def c1(m: Model):
    d = G.compatibility(V.mode_rows(m.facts, "actuals"), "debt_stock", LK)
    return d.select(
        *LK,
        F.array_join("price_bases", ",").alias("price_bases"),
        "mixed_valuation",
        "mixed_dates",
        "allowed",
        "root_total_allowed",
        "additive_across_nodes",
        F.array_join("errors", "; ").alias("errors"),
    )


@plan(
    "c2_guarded_total",
    sql("SELECT level, financial_year, round(sum(amount_aud), 2) AS total_aud FROM f WHERE compatibility_group = 'budget_expense' GROUP BY ALL", "f"),
)
def c2(m: Model):
    rows = V.mode_rows(m.facts, "budget")
    G.require_compatible(G.compatibility(rows, "budget_expense", LK))
    return rows.groupBy(*LK).agg(F.round(F.sum("amount_aud"), 2).alias("total_aud"))


@plan(
    "c3_triple_guard",
    sql(
        """SELECT financial_year, round(sum(amount_aud), 2) AS total_aud, count(*) AS n FROM f WHERE compatibility_group = 'actual_expense'
AND accounting_basis = 'gfs' AND estimate_status = 'actual' GROUP BY ALL""",
        "f",
    ),
)
def c3(m: Model):
    from factline.operators.aggregates import triple_totals

    return triple_totals(m.facts, "actual_expense", "gfs", "actual").select(
        "financial_year", F.round("total_aud", 2).alias("total_aud"), "n"
    )


@plan(
    "c4_stock_flow_guard",
    sql(
        """WITH k AS (SELECT DISTINCT 'ytd_' || event_type AS measure, CASE WHEN event_type IN ('error', 'signup') THEN 'stock' ELSE 'flow' END AS side FROM events)
SELECT a.measure AS left_measure, b.measure AS right_measure, a.side = b.side AS comparable FROM k a JOIN k b ON a.measure < b.measure"""
    ),
)
def c4(m: Model):
    import itertools

    seen = m.table("events").select(F.concat(F.lit("ytd_"), "event_type").alias("measure")).distinct()
    verdicts = []
    for a, b in itertools.combinations(sorted(MEASURE_KINDS), 2):
        try:
            G.require_comparable(MEASURE_KINDS, [a, b])
            verdicts.append((a, b, True))
        except ValueError:
            verdicts.append((a, b, False))
    table = m.local(verdicts, "left_measure string, right_measure string, comparable boolean")
    left = seen.select(F.col("measure").alias("left_measure"))
    return table.join(left, "left_measure", "left_semi").join(
        seen.select(F.col("measure").alias("right_measure")), "right_measure", "left_semi"
    ).select("left_measure", "right_measure", "comparable")


@plan(
    "c5_display_value",
    sql(
        """SELECT o_orderpriority AS priority, round(sum(coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 2 END, o_totalprice)), 1) AS shown, count(*) AS n
FROM orders GROUP BY ALL"""
    ),
)
def c5(m: Model):
    o = m.table("orders")
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 2)
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.round(F.sum(G.display_value(value, F.col("o_totalprice"))), 1).alias("shown"), F.count(F.lit(1)).alias("n")
    )


@plan(
    "c6_group_isolation",
    sql(
        """WITH s AS (SELECT DISTINCT p_brand AS family, p_type AS compatibility_group, p_name AS measure_type FROM part)
SELECT family, compatibility_group, count(*) AS n_measures, min(measure_type) AS first_measure FROM s GROUP BY ALL HAVING count(*) > 1"""
    ),
)
def c6(m: Model):
    p = m.table("part")
    return G.shared_groups(
        p.select(F.col("p_brand").alias("family"), F.col("p_type").alias("compatibility_group"), F.col("p_name").alias("measure_type"))
    )
