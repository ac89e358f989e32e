"""Fact view over the driver's tables, once as DataFrames and once as SQL text for the checks.

Order facts: one fact per order; customer nation and region give jurisdiction and level.
Line facts:  one fact per line item; supplier nation gives jurisdiction, part gives the path.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.years import fy_of_date
from factline.session import read_table


def level_of_region(r: Column) -> Column:
    return (
        F.when(r == "AFRICA", "national")
        .when(r == "AMERICA", "federal")
        .when(r == "ASIA", "state")
        .when(r == "EUROPE", "territory")
        .otherwise("local")
    )


def fold_level(level: Column) -> Column:
    return F.when(level == "national", "federal").otherwise(level)


class Model:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make):
        """A frame that several steps of one query read, made a single time."""
        if name not in self._made:
            self._made[name] = make(self)
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def local(self, rows, schema: str) -> DataFrame:
        """A small frame of fixed rules, used only beside the tables."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def places(self) -> DataFrame:
        """Nation with its level and jurisdiction (a dimension; Spark sizes the join by itself)."""
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").alias("nation_key"),
            F.col("n_name").alias("jurisdiction"),
            F.lower(F.translate("r_name", " ", "_")).alias("region"),
            level_of_region(F.col("r_name")).alias("government_level"),
            fold_level(level_of_region(F.col("r_name"))).alias("level"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Order facts."""
        o, c = self.table("orders"), self.table("customer")
        prio = F.substring("o_orderpriority", 3, 100)
        seg = F.col("c_mktsegment")
        joined = o.join(c, o.o_custkey == c.c_custkey).join(self.places, F.col("c_nationkey") == F.col("nation_key"))
        month = F.month("o_orderdate")
        first = F.substring("o_orderpriority", 1, 1)
        status = (
            F.when(F.col("o_orderstatus") == "F", "actual")
            .when(F.col("o_orderstatus") == "P", "audited_actual")
            .when(month >= 7, "budget")
            .otherwise("forward_estimate")
        )
        actual = F.col("o_orderstatus") != "O"
        node = (
            F.when(F.col("o_orderstatus") == "P", seg)
            .when(first == "4", F.concat(F.lit("Total "), seg))
            .otherwise(F.concat_ws(" / ", seg, prio, F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))))
        )
        df = joined.select(
            F.col("o_orderkey").alias("fact_id"),
            "o_custkey",
            "o_orderdate",
            fy_of_date(F.col("o_orderdate")).alias("financial_year"),
            F.when(actual, "expense_actual").otherwise("expense_budget").alias("measure_type"),
            F.when(actual, "actual_expense").otherwise("budget_expense").alias("compatibility_group"),
            F.when(first == "5", "accrual").otherwise("gfs").alias("accounting_basis"),
            status.alias("estimate_status"),
            F.col("o_totalprice").alias("amount_aud"),
            F.lit("AUD").alias("unit"),
            F.when(first == "1", "current_prices").otherwise("unspecified").alias("price_basis"),
            F.when(first == "1", "face_value").when(first == "2", "fair_value").alias("valuation_basis"),
            F.when(first == "3", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("observation_date"),
            F.when(first == "2", "quarantined").when(first == "3", "ok").alias("quality_status"),
            F.concat_ws("_", F.col("region"), F.lower(seg)).alias("source_key"),
            "government_level",
            "level",
            "jurisdiction",
            node.alias("node_name"),
            F.concat(
                F.lit("sheet:"), seg, F.lit(" | cell:C"), F.col("o_orderkey").cast("string"),
                F.lit(" | page:"), F.month("o_orderdate").cast("string"),
                F.lit(" | row:"), (F.col("o_orderkey") + 1).cast("string"),
            ).alias("locator"),
        )
        return df.withColumn(
            "fact_key",
            F.concat_ws("|", "source_key", "financial_year", "node_name", "measure_type", "estimate_status", F.col("fact_id").cast("string")),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Line facts: path parts are part type, brand and name."""
        li, s, p = self.table("lineitem"), self.table("supplier"), self.table("part")
        joined = (
            li.join(s, li.l_suppkey == s.s_suppkey)
            .join(p, li.l_partkey == p.p_partkey)
            .join(self.places, F.col("s_nationkey") == F.col("nation_key"))
        )
        status = (
            F.when(F.col("l_returnflag") == "A", "actual")
            .when(F.col("l_returnflag") == "R", "audited_actual")
            .otherwise("budget")
        )
        node = (
            F.when(F.col("p_size") > 48, F.concat(F.lit("Total "), F.lower("p_type")))
            .when(
                (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.concat_ws(" / ", "p_type", "p_brand")
            )
            .otherwise(F.concat_ws(" / ", "p_type", "p_brand", "p_name"))
        )
        return joined.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
            "l_orderkey",
            "l_suppkey",
            "p_type",
            "p_brand",
            "p_name",
            "l_shipdate",
            "l_quantity",
            fy_of_date(F.col("l_shipdate")).alias("financial_year"),
            F.when(F.col("l_returnflag") == "N", "budget_expense").otherwise("actual_expense").alias("compatibility_group"),
            F.when(F.col("l_returnflag") == "N", "expense_budget").otherwise("expense_actual").alias("measure_type"),
            status.alias("estimate_status"),
            F.col("l_extendedprice").alias("amount_aud"),
            F.lit("AUD").alias("unit"),
            "government_level",
            "level",
            "jurisdiction",
            "region",
            node.alias("node_name"),
        )

    @cached_property
    def text_lines(self) -> DataFrame:
        """Documents cut into lines; the whole text is kept."""
        d = self.table("documents")
        return d.select(
            F.col("source").alias("source_id"),
            F.col("doc_id"),
            F.posexplode(F.split("text", "\n")).alias("line_no", "text"),
        )


def fy_sql(col: str) -> str:
    return (
        f"printf('%d-%02d', year({col}) - CASE WHEN month({col}) >= 7 THEN 0 ELSE 1 END, "
        f"(year({col}) + CASE WHEN month({col}) >= 7 THEN 1 ELSE 0 END) % 100)"
    )


PLACES_SQL = """
SELECT n_nationkey AS nation_key, n_name AS jurisdiction, lower(replace(r_name, ' ', '_')) AS region,
  CASE r_name WHEN 'AFRICA' THEN 'national' WHEN 'AMERICA' THEN 'federal' WHEN 'ASIA' THEN 'state'
    WHEN 'EUROPE' THEN 'territory' ELSE 'local' END AS government_level,
  CASE r_name WHEN 'AFRICA' THEN 'federal' WHEN 'AMERICA' THEN 'federal' WHEN 'ASIA' THEN 'state'
    WHEN 'EUROPE' THEN 'territory' ELSE 'local' END AS level
FROM nation JOIN region ON n_regionkey = r_regionkey"""

FACTS_SQL = f"""
SELECT *, source_key || '|' || financial_year || '|' || node_name || '|' || measure_type || '|' ||
  estimate_status || '|' || fact_id AS fact_key FROM (
SELECT o_orderkey AS fact_id, o_custkey, o_orderdate, {fy_sql('o_orderdate')} AS financial_year,
  CASE WHEN o_orderstatus <> 'O' THEN 'expense_actual' ELSE 'expense_budget' END AS measure_type,
  CASE WHEN o_orderstatus <> 'O' THEN 'actual_expense' ELSE 'budget_expense' END AS compatibility_group,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'accrual' ELSE 'gfs' END AS accounting_basis,
  CASE WHEN o_orderstatus = 'F' THEN 'actual' WHEN o_orderstatus = 'P' THEN 'audited_actual'
    WHEN month(o_orderdate) >= 7 THEN 'budget' ELSE 'forward_estimate' END AS estimate_status,
  o_totalprice AS amount_aud, 'AUD' AS unit,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'current_prices' ELSE 'unspecified' END AS price_basis,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'face_value' WHEN o_orderpriority LIKE '2%' THEN 'fair_value' END AS valuation_basis,
  CASE WHEN o_orderpriority LIKE '3%' THEN strftime(o_orderdate, '%Y-%m-%d') END AS observation_date,
  CASE WHEN o_orderpriority LIKE '2%' THEN 'quarantined' WHEN o_orderpriority LIKE '3%' THEN 'ok' END AS quality_status,
  region || '_' || lower(c_mktsegment) AS source_key, government_level, level, jurisdiction,
  CASE WHEN o_orderstatus = 'P' THEN c_mktsegment WHEN o_orderpriority LIKE '4%' THEN 'Total ' || c_mktsegment
    ELSE c_mktsegment || ' / ' || substr(o_orderpriority, 3) || ' / Q' || quarter(o_orderdate) END AS node_name,
  'sheet:' || c_mktsegment || ' | cell:C' || o_orderkey || ' | page:' || month(o_orderdate) || ' | row:' || (o_orderkey + 1) AS locator
FROM orders JOIN customer ON o_custkey = c_custkey JOIN ({PLACES_SQL}) ON c_nationkey = nation_key)"""

LINES_SQL = f"""
SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey, l_suppkey, p_type, p_brand, p_name, l_shipdate, l_quantity,
  {fy_sql('l_shipdate')} AS financial_year,
  CASE WHEN l_returnflag = 'N' THEN 'budget_expense' ELSE 'actual_expense' END AS compatibility_group,
  CASE WHEN l_returnflag = 'N' THEN 'expense_budget' ELSE 'expense_actual' END AS measure_type,
  CASE l_returnflag WHEN 'A' THEN 'actual' WHEN 'R' THEN 'audited_actual' ELSE 'budget' END AS estimate_status,
  l_extendedprice AS amount_aud, 'AUD' AS unit, government_level, level, jurisdiction, region,
  CASE WHEN p_size > 48 THEN 'Total ' || lower(p_type)
    WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN p_type || ' / ' || p_brand
    ELSE p_type || ' / ' || p_brand || ' / ' || p_name END AS node_name
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN ({PLACES_SQL}) ON s_nationkey = nation_key"""

TEXT_LINES_SQL = """
SELECT source AS source_id, doc_id, i - 1 AS line_no, parts[i] AS text FROM (
  SELECT source, doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
  FROM documents)"""


def sql(body: str, *views: str) -> str:
    """Prefix a query with the named views: f (facts), l (lines), t (text lines), p (places)."""
    known = {"f": FACTS_SQL, "l": LINES_SQL, "t": TEXT_LINES_SQL, "p": PLACES_SQL}
    heads = [f"{v} AS ({known[v]})" for v in views]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(heads) + (", " if heads else "") + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(heads) + (", " if heads else "") + body[5:]
    return ("WITH " + ", ".join(heads) + " " if heads else "") + body
