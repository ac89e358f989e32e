"""Normalisers for labels, dates, amounts, grids, registers and links (P6-P31, P39-P64)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import amounts as A
from factline.functions import labels as L
from factline.functions import years as Y
from factline.operators import cells as C
from factline.operators import discovery as D
from factline.operators import registers as R
from factline.plans.ingest import AWARD_SQL, releases
from factline.plans.model import Model, fy_sql, sql
from factline.plans.registry import plan
from factline.session import cut_lineage
from factline.sources.readers import AWARD_SCHEMA


def count():
    return F.count(F.lit(1))


@plan(
    "p6_label_cleaning",
    sql(
        r"""WITH c AS (SELECT coalesce(nullif(trim(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' / ', ' – ')), ''), 'Unknown') AS label FROM t) SELECT label, count(*) AS n FROM c GROUP BY ALL""",
        "t",
    ),
)
def p6(m: Model):
    return m.text_lines.groupBy(L.clean_label(F.col("text")).alias("label")).agg(count().alias("n"))


@plan("p7_date_to_financial_year", sql(f"SELECT {fy_sql('o_orderdate')} AS financial_year, count(*) AS n FROM orders GROUP BY ALL"))
def p7(m: Model):
    return m.table("orders").groupBy(Y.fy_of_date(F.col("o_orderdate")).alias("financial_year")).agg(count().alias("n"))


@plan(
    "p8_year_from_labels",
    sql(
        """WITH s AS (SELECT year(o_orderdate) AS y, o_orderpriority[1] AS k FROM orders) SELECT k, CASE k WHEN '1' THEN printf('%d-%02d', y, (y + 1) % 100) WHEN '2' THEN printf('%d-%02d', y, (y + 1) % 100) WHEN '3' THEN printf('%d-%02d', y - 1, y % 100) WHEN '4' THEN printf('%d-%02d', y - 1, y % 100) END AS financial_year, count(*) AS n FROM s GROUP BY ALL"""
    ),
)
def p8(m: Model):
    y, k = F.year("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    s = y.cast("string")
    text = (
        F.when(k == "1", F.concat(F.lit("report_"), s, F.lit("-"), (y + 1).cast("string"), F.lit(".csv")))
        .when(k == "2", F.concat(F.lit("Council "), s, F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0")))
        .when(k == "3", F.concat(F.lit("Jun-"), s))
        .when(k == "4", s)
        .otherwise("no year")
    )
    return m.table("orders").groupBy(k.alias("k"), Y.fy_from_label(text).alias("financial_year")).agg(count().alias("n"))


@plan("p9_year_token_normalise", sql("WITH s AS (SELECT year(o_orderdate) AS y, o_orderstatus AS k FROM orders) SELECT k, printf('%d-%02d', y, (y + 1) % 100) AS financial_year, count(*) AS n FROM s GROUP BY ALL"))
def p9(m: Model):
    y, k = F.year("o_orderdate"), F.col("o_orderstatus")
    two = F.lpad(((y + 1) % 100).cast("string"), 2, "0")
    token = F.when(k == "F", F.concat(y.cast("string"), F.lit("–"), two)).when(k == "O", F.concat(y.cast("string"), F.lit("­"), two)).otherwise(F.concat(y.cast("string"), F.lit(" - "), (y + 1).cast("string")))
    return m.table("orders").groupBy(k.alias("k"), Y.normalise_fy_token(token).alias("financial_year")).agg(count().alias("n"))


@plan(
    "p10_period_bounds",
    sql(f"""SELECT {fy_sql('o_orderdate')} AS financial_year, monthname(o_orderdate) AS month_name, strftime(last_day(o_orderdate), '%Y-%m-%d') AS period_end,
 CASE WHEN o_orderstatus <> 'P' THEN substr({fy_sql('o_orderdate')}, 1, 4) || '-07-01' END AS period_start, count(*) AS n FROM orders GROUP BY ALL"""),
)
def p10(m: Model):
    fy, name = Y.fy_of_date(F.col("o_orderdate")), F.date_format("o_orderdate", "MMMM")
    kind = F.when(F.col("o_orderstatus") == "P", "stock").otherwise("flow")
    rows = m.table("orders").select(fy.alias("financial_year"), name.alias("month_name"), kind.alias("kind"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy(
        "financial_year", "month_name", day(Y.period_end(F.col("financial_year"), F.col("month_name"))).alias("period_end"), day(Y.period_start(F.col("financial_year"), F.col("kind"))).alias("period_start")
    ).agg(count().alias("n"))


@plan("p11_unit_scaling", sql("SELECT o_orderpriority AS priority, round(sum(round(o_totalprice) * CASE o_orderpriority[1] WHEN '1' THEN 1000000 WHEN '2' THEN 1000000000 WHEN '3' THEN 1000 WHEN '4' THEN 1 END), 0) AS amount FROM orders GROUP BY ALL"))
def p11(m: Model):
    k = F.substring("o_orderpriority", 1, 1)
    unit = F.when(k == "1", "$m").when(k == "2", "$b").when(k == "3", "$'000").when(k == "4", "$").otherwise("?")
    return m.table("orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.sum(A.scale_amount(F.round("o_totalprice"), unit)), 0).alias("amount"))


@plan(
    "p12_messy_amounts",
    sql(
        """WITH s AS (SELECT o_orderpriority[1] AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT k, sum(CASE k WHEN '1' THEN v * 1000000000.0 WHEN '2' THEN v * 1000000.0 WHEN '3' THEN CASE WHEN v < 500000 THEN v * 1000000.0 ELSE v END WHEN '4' THEN v * 10.0 * 1000000 END)::DOUBLE AS amount, count(*) AS n FROM s GROUP BY ALL"""
    ),
)
def p12(m: Model):
    k, v = F.substring("o_orderpriority", 1, 1), F.floor("o_totalprice").cast("long")
    text = F.when(k == "1", F.concat(F.lit("$"), F.format_number(v, 0), F.lit("bn"))).when(k == "2", F.concat(F.lit("A$ "), v.cast("string"), F.lit(" million"))).when(k == "3", F.format_number(v, 0)).when(k == "4", F.concat(F.lit("-"), (v * 10).cast("string"), F.lit("m"))).otherwise("Total")
    return m.table("orders").groupBy(k.alias("k")).agg(F.sum(A.parse_amount(text)).alias("amount"), count().alias("n"))


@plan("p13_messy_dates", sql("SELECT o_orderpriority[1] AS k, CASE WHEN o_orderstatus <> 'P' THEN strftime(CASE WHEN o_orderpriority LIKE '1%' AND year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END, '%Y-%m-%d') END AS day, count(*) AS n FROM orders GROUP BY ALL"))
def p13(m: Model):
    k, d = F.substring("o_orderpriority", 1, 1), F.col("o_orderdate")
    o = m.table("orders")
    text = (
        F.when(F.col("o_orderstatus") == "P", "no date")
        .when(k == "1", F.date_format(d, "d-MMM-yy"))
        .when(k == "2", F.date_format(d, "dd/MM/yyyy"))
        .when(k == "3", F.date_format(d, "d MMMM yyyy"))
        .when(k == "4", F.date_format(d, "yyyy.MM.dd"))
        .otherwise(F.date_format(d, "d/MM/yy"))
    )
    return o.groupBy(k.alias("k"), F.date_format(A.parse_date(text), "yyyy-MM-dd").alias("day")).agg(count().alias("n"))


@plan("p14_as_at_date", sql("SELECT CASE o_orderstatus WHEN 'P' THEN '1999-12-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_at, count(*) AS n FROM orders GROUP BY ALL"))
def p14(m: Model):
    d = F.date_format("o_orderdate", "d MMM yyyy")
    k = F.col("o_orderstatus")
    text = F.when(k == "F", F.concat(F.lit("Debt outstanding as at "), d, F.lit("\n4.5% 21 Nov 2035 10"))).when(k == "O", F.concat(F.lit("title\nas_at_note,"), d, F.lit("\nrow 1 Jan 2030"))).otherwise("4.5% 21 Nov 2035 10")
    at = A.as_at_date(text, F.lit("1999-12-31").cast("date"))
    return m.table("orders").groupBy(F.date_format(at, "yyyy-MM-dd").alias("as_at")).agg(count().alias("n"))


@plan("p15_columns_by_role", sql("SELECT o_orderpriority AS category, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL"))
def p15(m: Model):
    odd = m.table("orders").select(F.col("o_orderkey").alias("Ref."), F.col("o_totalprice").alias(" Contract   Value ($) "), F.col("o_orderpriority").alias("Program / Title"), F.col("o_orderstatus").alias("Agency-Name"))
    named = R.by_role(odd)
    return named.groupBy("category").agg(count().alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


FILES_SQL = "fl AS (SELECT doc_id AS path, CASE WHEN lang = 'en' THEN 'agency,amount' WHEN lang = 'fr' THEN 'agency,value' ELSE 'agency,amount,' || lang END AS schema, n_chars FROM documents)"


def files(m: Model):
    lang = F.col("lang")
    raw = F.when(lang == "en", F.array(F.lit(" Agency"), F.lit("AMOUNT!"))).when(lang == "fr", F.array(F.lit("agency"), F.lit("Value"))).otherwise(F.array(F.lit("Agency"), F.lit("amount"), lang))
    return m.table("documents").select(F.col("doc_id").alias("path"), F.array_join(R.normal_header(raw), ",").alias("schema"), "n_chars")


@plan("p16_schema_decision", sql("WITH " + FILES_SQL + ", g AS (SELECT schema, count(*) AS n FROM fl GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_files, count(*) AS n_schemas, arg_max(schema, n) AS dominant, round(max(n) / sum(n), 4) AS dominant_share, CASE WHEN max(n) / sum(n) >= 0.9 THEN 'single_mapping' ELSE 'split_mappings' END AS decision FROM g"))
def p16(m: Model):
    return R.schema_decision(files(m)).select("n_files", "n_schemas", "dominant", F.round("dominant_share", 4).alias("dominant_share"), "decision")


@plan("p17_dominant_schema_rows", sql("WITH " + FILES_SQL + ", g AS (SELECT schema, count(*) AS n FROM fl GROUP BY ALL) SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM fl WHERE (SELECT max(n) / sum(n) FROM g) < 0.9 OR schema = (SELECT arg_max(schema, n) FROM g)"))
def p17(m: Model):
    f = files(m)
    return R.dominant_rows(f, f).agg(count().alias("n"), F.sum("n_chars").alias("n_chars"))


# A workbook per nation: a title, a year header, one section per part type, one row per brand.
SECTIONS = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]
GRID_SQL = """g AS (SELECT jurisdiction AS source_id, list_position(['ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'MEDIUM', 'LARGE'], p_type) AS sec, p_type, p_brand, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS b, financial_year,
  CAST(substr(financial_year, 1, 4) AS INTEGER) - 1990 AS col_no, round(sum(amount_aud), 2) AS amount FROM l GROUP BY ALL)"""


def grid_numbers(m: Model):
    return m.once("grid", _grid_numbers)


def _grid_numbers(m: Model):
    sec = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("p_type")).cast("int")
    g = m.lines.groupBy(F.col("jurisdiction").alias("source_id"), "p_type", "p_brand", "financial_year").agg(F.round(F.sum("amount_aud"), 2).alias("amount"))
    g = g.withColumn("sec", sec).withColumn("b", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")).withColumn("col_no", F.substring("financial_year", 1, 4).cast("int") - 1990)
    # every kind of cell is made from these sums: write them once instead of scanning the items per kind
    return cut_lineage(g)


def money(c):
    return c.cast("decimal(20,2)").cast("string")


def grid(m: Model):
    """Cells ``(source_id, sheet, row_no, col_no, value)`` made from the line facts."""
    g = grid_numbers(m)
    at = ((F.col("sec") * 100) + F.col("b")).alias("row_no")
    sheet = F.lit("Table_4").alias("sheet")

    def cells(df, row, col, value):
        return df.select("source_id", sheet, row.cast("int").alias("row_no"), col.cast("int").alias("col_no"), value.alias("value"))

    years = g.select("source_id", "col_no", "financial_year").distinct()
    ids = g.select("source_id").distinct()
    labels = g.select("source_id", "sec", "b", "p_brand").distinct()
    totals = g.groupBy("source_id", "sec", "col_no").agg(F.sum("amount").alias("amount"))
    parts = [
        cells(g, at, F.col("col_no"), money(F.col("amount"))),
        cells(labels, at, F.lit(0), F.concat(F.lit("  "), "p_brand", F.lit("  "))),
        cells(years, F.lit(3), F.col("col_no"), F.col("financial_year")),
        cells(ids, F.lit(0), F.lit(0), F.lit("Table 4 by function")),
        cells(g.select("source_id", "sec", "p_type").distinct(), F.col("sec") * 100, F.lit(0), F.col("p_type")),
        cells(totals.select("source_id", "sec").distinct(), F.col("sec") * 100 + 99, F.lit(0), F.lit("Total section")),
        cells(totals, F.col("sec") * 100 + 99, F.col("col_no"), money(F.col("amount"))),
        cells(ids, F.lit(9999), F.lit(0), F.lit("Released at 11.30")),
        cells(years, F.lit(9999), F.col("col_no"), F.lit("7.0")),
        cells(years, F.lit(9998), F.col("col_no"), F.lit("n.p.")),
        cells(ids, F.lit(9998), F.lit(0), F.lit("Not published")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("p18_header_row", sql("WITH " + GRID_SQL + " SELECT source_id, 'Table_4' AS sheet, 3 AS header_row FROM g GROUP BY ALL", "l"))
def p18(m: Model):
    return C.header_row(C.rows_of(grid(m)))


@plan("p19_melt_by_year", sql("WITH " + GRID_SQL + " SELECT source_id, p_brand AS label, financial_year AS header, round(sum(amount), 2) AS amount, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT source_id, 'Total section', financial_year, round(sum(amount), 2), count(DISTINCT sec) FROM g GROUP BY ALL", "l"))
def p19(m: Model):
    rows = C.rows_of(grid(m))
    out = C.melt(rows, C.header_cells(rows))
    return out.groupBy("source_id", "label", "header").agg(F.round(F.sum("amount"), 2).alias("amount"), count().alias("n"))


@plan("p20_section_melt", sql("WITH " + GRID_SQL + " SELECT source_id, p_type AS section, p_brand AS label, financial_year AS header, amount FROM g WHERE p_type IN ('PROMO', 'SMALL') AND p_brand <> 'Brand#3'", "l"))
def p20(m: Model):
    rows = C.rows_of(grid(m))
    marked = C.with_section(rows, F.when(F.col("label").isin(*SECTIONS), F.col("label")))
    keep = m.table("part").where("p_brand <> 'Brand#3'").select(F.col("p_brand").alias("label")).distinct()
    out = C.melt(marked.where(F.col("section").isin("PROMO", "SMALL")), C.header_cells(rows), ["section"])
    return out.join(keep, "label", "left_semi").select("source_id", "section", "label", "header", "amount")


@plan("p21_multi_sheet_melt", sql("WITH " + GRID_SQL + ", gx AS (SELECT g.*, p.level FROM g JOIN p ON p.jurisdiction = g.source_id) SELECT level, p_brand AS label, financial_year AS header, round(sum(amount), 2) AS amount FROM gx WHERE level <> 'local' GROUP BY ALL", "l", "p"))
def p21(m: Model):
    rows = C.rows_of(grid(m))
    sheets = m.places.where("level <> 'local'").select(F.col("jurisdiction").alias("source_id"), "level")
    skip = m.local([("Total section",)], "label string")
    out = C.melt(rows, C.header_cells(rows)).join(skip, "label", "left_anti").join(sheets, "source_id")
    return out.groupBy("level", "label", "header").agg(F.round(F.sum("amount"), 2).alias("amount"))


SERIES_SQL = """sr AS (SELECT jurisdiction AS source_id, date_trunc('month', l_shipdate) AS mth, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS col_no, round(sum(CASE WHEN p_type = 'PROMO' THEN amount_aud ELSE -amount_aud END), 2) AS v FROM l GROUP BY ALL)"""


def series_cells(m: Model):
    """A dated sheet per nation: one row per month, one column per brand."""
    mth = F.trunc("l_shipdate", "month")
    signed = F.when(F.col("p_type") == "PROMO", F.col("amount_aud")).otherwise(-F.col("amount_aud"))
    s = m.lines.groupBy(F.col("jurisdiction").alias("source_id"), mth.alias("mth"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("col_no")).agg(F.round(F.sum(signed), 2).alias("v"))
    row = ((F.year("mth") - 1990) * 12 + F.month("mth")).cast("int").alias("row_no")
    sheet = F.lit("Data1").alias("sheet")
    values = s.select("source_id", sheet, row, "col_no", money(F.col("v")).alias("value"))
    dates = s.select("source_id", sheet, row, F.lit(0).alias("col_no"), F.date_format("mth", "yyyy-MM-dd").alias("value")).distinct()
    return values.unionByName(dates)


@plan("p22_latest_june_value", sql("WITH " + SERIES_SQL + " SELECT source_id, col_no, strftime(max(mth), '%Y-%m-%d') AS day, arg_max(v, mth) AS amount FROM sr WHERE month(mth) = 6 GROUP BY ALL", "l"))
def p22(m: Model):
    return C.latest_month_row(series_cells(m)).select("source_id", "col_no", F.date_format("day", "yyyy-MM-dd").alias("day"), "amount")


@plan("p23_latest_liabilities", sql("WITH " + SERIES_SQL + ", x AS (SELECT * FROM sr WHERE (source_id, mth) IN (SELECT source_id, max(mth) FROM sr GROUP BY ALL) AND v < 0) SELECT source_id, col_no, abs(v) AS amount FROM x UNION ALL SELECT source_id, NULL, round(sum(abs(v)), 2) FROM x GROUP BY ALL", "l"))
def p23(m: Model):
    return C.latest_liabilities(series_cells(m)).select("source_id", "col_no", F.round("amount", 2).alias("amount"))


@plan("p24_council_metric_melt", sql("SELECT o_custkey AS council, metric, round(sum(o_totalprice), 2) AS amount FROM (SELECT o_custkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'Final costs' WHEN 'O' THEN 'Open costs' END AS metric FROM orders) WHERE metric IS NOT NULL GROUP BY ALL"))
def p24(m: Model):
    side = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    wide = m.table("orders").groupBy(F.col("o_custkey").alias("council")).agg(side("F").cast("string").alias("fin"), side("O").cast("string").alias("op"), side("P").alias("other"))
    return R.wide_to_long(wide, ["council"], {"fin": "Final costs", "op": "Open costs"})


@plan("p25_award_flatten", sql("WITH " + AWARD_SQL + " SELECT 'Supplier ' || l_suppkey AS supplier, CASE WHEN l_linenumber < 7 THEN financial_year ELSE '1900-01' END AS financial_year, count(*) AS n, round(sum(amount), 2) AS amount_aud FROM aw GROUP BY ALL"))
def p25(m: Model):
    # parsed once per line: bound, so that the filters before the explosion do not parse it again
    r = releases(m).select(F.inline(F.array(F.from_json("value", AWARD_SCHEMA))))
    return R.award_facts(r, "1900-01").groupBy("supplier", "financial_year").agg(count().alias("n"), F.round(F.sum("amount_aud"), 2).alias("amount_aud"))


@plan("p26_register_to_facts", sql(f"SELECT {fy_sql('o_orderdate')} AS financial_year, c_mktsegment || ' / ' || substr(o_orderpriority, 3) AS node_name, count(*) AS n, round(sum(o_totalprice), 2) AS amount_aud FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL"))
def p26(m: Model):
    o, c = m.table("orders"), m.table("customer")
    raw = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    rows = o.join(c, o.o_custkey == c.c_custkey)
    out = R.register_facts(rows, F.concat(F.lit(" "), "c_mktsegment"), F.substring("o_orderpriority", 3, 50), F.col("o_orderdate"), A.register_amount(raw))
    return out.groupBy("financial_year", "node_name").agg(count().alias("n"), F.round(F.sum("amount_aud"), 2).alias("amount_aud"))


@plan(
    "p27_sectioned_csv_split",
    sql(
        """WITH r AS (SELECT s_nationkey AS file_id, CASE WHEN s_nationkey % 5 = 0 THEN 'table' WHEN s_suppkey // 10 % 4 = 0 THEN 'table' ELSE 'section ' || (s_suppkey // 10 % 2) END AS section,
 CASE WHEN s_nationkey % 5 = 0 THEN -1 WHEN s_suppkey // 10 % 4 = 0 THEN -1 ELSE s_suppkey // 10 END AS part FROM supplier)
SELECT file_id, section, count(DISTINCT part) AS n_sections, count(*) AS n_rows FROM r GROUP BY ALL"""
    ),
)
def p27(m: Model):
    """Files of tens; names repeat, one file in five has no marker, and every fourth ten stands before the first marker."""
    from factline.operators.textlines import split_sections

    s, k = m.table("supplier"), F.col("s_suppkey")
    tens = F.floor(k / 10).cast("long")
    early = (tens % 4 == 0) | (F.col("s_nationkey") % 5 == 0)
    base = F.when(early, 0).otherwise(1_000_000_000) + tens * 100
    body = s.select(F.col("s_nationkey").alias("file_id"), (base + k % 10 + 2).alias("line_no"), F.concat_ws(",", "s_name", F.col("s_acctbal").cast("string")).alias("text"))
    heads = s.where(~early).select(F.col("s_nationkey").alias("file_id"), tens.alias("t")).distinct()
    at = lambda n: (F.lit(1_000_000_000) + F.col("t") * 100 + n).alias("line_no")
    marks = heads.select("file_id", at(0), F.concat(F.lit("#section "), (F.col("t") % 2).cast("string")).alias("text"))
    cols = heads.select("file_id", at(1), F.lit("name,balance").alias("text"))
    blank = heads.select("file_id", at(50), F.lit("  ").alias("text")).unionByName(heads.select("file_id", at(51), F.lit("as_at_note,30 June").alias("text")))
    top = s.where(early).select(F.col("s_nationkey").alias("file_id"), F.lit(-1).cast("long").alias("line_no"), F.lit("name,balance").alias("text")).distinct()
    rows = split_sections(body.unionByName(marks).unionByName(cols).unionByName(blank).unionByName(top), ["file_id"], r"^#(section.*)$")
    return rows.where("not is_header").groupBy("file_id", "section").agg(F.count_distinct("section_line").alias("n_sections"), count().alias("n_rows"))


TYPES_SQL = "CASE WHEN p_type IN ('PROMO') THEN 'floating_rate_note' WHEN p_type = 'SMALL' THEN 'indexed_bond' WHEN p_type = 'LARGE' THEN 'short_term' WHEN p_type = 'MEDIUM' THEN 'fixed_bond' ELSE 'other' END"


def coupon_text():
    t = F.col("p_type")
    return F.when(t == "PROMO", "90d BBSW + 35bp bond").when(t == "SMALL", "Capital Indexed Bonds").when(t == "LARGE", "Promissory Notes").when(t == "MEDIUM", "Benchmark Bonds").otherwise("Loans")


@plan("p28_instrument_typing", sql(f"SELECT {TYPES_SQL} AS instrument_type, count(*) AS n FROM part GROUP BY ALL"))
def p28(m: Model):
    return m.table("part").groupBy(R.instrument_type(coupon_text()).alias("instrument_type")).agg(count().alias("n"))


@plan(
    "p29_triple_extraction",
    sql(
        """WITH x AS (SELECT printf('%.2f%%', l_discount * 100) AS coupon, l_shipdate AS d, l_quantity AS q FROM lineitem UNION ALL SELECT printf('%.2f%%', l_tax * 100), l_shipdate, l_quantity * 1000 FROM lineitem)
SELECT coupon, strftime(d, '%Y-%m') AS month, count(*) AS n, CAST(sum(q) AS DOUBLE) AS amount FROM x GROUP BY ALL"""
    ),
)
def p29(m: Model):
    from factline.operators.textlines import debt_triples

    day = F.date_format("l_shipdate", "d MMM yyyy")
    pct = lambda c: F.concat(F.format_number(F.col(c) * 100, 2), F.lit("%"))
    text = F.concat_ws("  ", pct("l_discount"), day, F.format_number("l_quantity", 0), pct("l_tax"), F.date_format("l_shipdate", "d-MMM-yyyy"), F.format_number(F.col("l_quantity") * 1000, 0))
    t = debt_triples(m.table("lineitem").select(text.alias("text")))
    return t.groupBy("coupon", F.date_format("maturity", "yyyy-MM").alias("month")).agg(count().alias("n"), F.sum("amount").alias("amount"))


INST_SQL = f"inst AS (SELECT {TYPES_SQL} AS instrument_type, p_brand AS name, p_retailprice AS amount, p_partkey AS pos FROM part)"


@plan("p30_instrument_dedupe", sql("WITH " + INST_SQL + " SELECT instrument_type, name, round(amount) AS amount, min(pos) AS pos FROM inst GROUP BY ALL"))
def p30(m: Model):
    rows = m.table("part").select(R.instrument_type(coupon_text()).alias("instrument_type"), F.col("p_brand").alias("name"), F.round("p_retailprice").alias("amount"), F.col("p_partkey").alias("pos"))
    return R.dedupe_instruments(rows, ["instrument_type", "name"], "amount", "pos")


@plan(
    "p31_identifier_enrichment",
    sql(
        """WITH ids AS (SELECT p_name AS name, p_size AS maturity, 'AU' || p_partkey AS isin FROM part WHERE p_type = 'PROMO'), bn AS (SELECT name, min(isin) AS a FROM ids GROUP BY ALL), bm AS (SELECT maturity, min(isin) AS b FROM ids GROUP BY ALL HAVING count(DISTINCT isin) = 1)
SELECT p_partkey, coalesce(a, b) AS isin FROM (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'none' ELSE p_name END AS name, p_size AS maturity FROM part) LEFT JOIN bn USING (name) LEFT JOIN bm USING (maturity)"""
    ),
)
def p31(m: Model):
    p = m.table("part")
    ids = p.where("p_type = 'PROMO'").select(F.col("p_name").alias("name"), F.col("p_size").alias("maturity"), F.concat(F.lit("AU"), F.col("p_partkey").cast("string")).alias("isin"))
    rows = p.select("p_partkey", F.when(F.col("p_type") == "SMALL", "none").otherwise(F.col("p_name")).alias("name"), F.col("p_size").alias("maturity"))
    return R.enrich(rows, ids, "name", "maturity", "isin").select("p_partkey", "isin")


# A monthly statement per user: columns are event types with a month header, rows are labels.
MFS_SQL = """ev AS (SELECT user_id, event_type, round(sum(value), 2) AS v, count(*) AS n FROM events GROUP BY ALL),
hd AS (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS k FROM ev)"""


def month_rows(m: Model):
    e = m.table("events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("v"))
    k = F.array_position(F.array(*[F.lit(t) for t in ("click", "view", "purchase", "error", "signup")]), F.col("event_type")).cast("int")
    e = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), F.lit("S").alias("sheet"), k.alias("k"), "v")
    heads = ["ACTUAL\n2015-2016\nYTD August\n$m", "ACTUAL\n2015-2016\nJuly\n$b", "BUDGET\n2016-2017\nMay\n$m", "no header", "ACTUAL\n2016-2017\nYTD May\n$k"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), F.col("k"))

    def cells(df, row, col, value):
        return df.select("source_id", "sheet", F.lit(row).alias("row_no"), col.cast("int").alias("col_no"), value.alias("value"))

    ids = e.select("source_id", "sheet").distinct()
    out = cells(e, 1, F.col("k"), head)
    for row, label in ((2, "Revenue (a)"), (3, "Expenses"), (4, "(a) a note"), (5, "After the note")):
        out = out.unionByName(cells(ids, row, F.lit(0), F.lit(label))).unionByName(cells(e, row, F.col("k"), money(F.col("v") * (row - 1))))
    return C.rows_of(out)


@plan(
    "p39_month_headers",
    sql(
        "WITH " + MFS_SQL + """ SELECT 'facts' AS kind, lab AS detail, CASE k WHEN 1 THEN 'August' ELSE 'July' END AS month, round(sum(v * f * CASE k WHEN 1 THEN 1e6 ELSE 1e9 END), 0) AS amount, count(*) AS n FROM hd, (VALUES ('Revenue', 1), ('Expenses', 2)) AS z(lab, f) WHERE k IN (1, 2) GROUP BY ALL
UNION ALL SELECT 'non_ytd_column_not_supported', lab, NULL, NULL, count(*) FROM hd, (VALUES ('Revenue'), ('Expenses')) AS z(lab) WHERE k = 3 GROUP BY ALL UNION ALL SELECT 'unparsed_column_header', 'no header', NULL, NULL, count(*) FROM hd WHERE k = 4 UNION ALL SELECT 'unknown_unit', '$k', NULL, NULL, count(*) FROM hd WHERE k = 5"""
    ),
)
def p39(m: Model):
    facts, bad = C.monthly_melt(month_rows(m))
    f = facts.groupBy(F.lit("facts").alias("kind"), F.col("label").alias("detail"), "month").agg(F.round(F.sum("amount"), 0).alias("amount"), count().alias("n"))
    b = bad.groupBy(F.col("reason").alias("kind"), "detail").agg(F.lit(None).cast("string").alias("month"), F.lit(None).cast("double").alias("amount"), count().alias("n"))
    return f.unionByName(b)


# A two-column statement per customer: actual and budget of each priority.
STMT_SQL = """st AS (SELECT c_custkey, c_mktsegment, o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS a, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def statement(m: Model):
    side = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    o, c = m.table("orders"), m.table("customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_custkey", "c_mktsegment", "o_orderpriority").agg(side("F").alias("a"), side("O").alias("b"))


def statement_rows(m: Model):
    s = statement(m)
    base = s.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"), F.lit("S").alias("sheet"), "c_mktsegment", "o_orderpriority", "a", "b")
    ids = base.select("source_id", "sheet", "c_mktsegment").distinct()

    def cells(df, row, col, value):
        return df.select("source_id", "sheet", row.cast("int").alias("row_no"), F.lit(col).alias("col_no"), value.alias("value"))

    row = F.substring("o_orderpriority", 1, 1).cast("int") + 3
    paren = lambda c: F.concat(F.lit("("), F.format_number(c, 2), F.lit(")"))
    unit = F.when(F.col("c_mktsegment") == "BUILDING", "$b").otherwise("$m")
    out = cells(base, row, 0, F.concat(F.substring("o_orderpriority", 3, 50), F.lit(" (b)")))
    for part in (
        cells(base, row, 1, F.format_number("a", 2)), cells(base, row, 2, paren(F.col("b"))),
        cells(ids, F.lit(1), 1, F.when(F.col("c_mktsegment") == "MACHINERY", "Actuals").otherwise("Actual")), cells(ids, F.lit(1), 2, F.lit("Budget")),
        cells(ids, F.lit(2), 1, F.lit("$m")), cells(ids, F.lit(2), 2, unit), cells(ids, F.lit(90), 0, F.lit("(b) footnote")), cells(ids, F.lit(91), 0, F.lit("below")), cells(ids, F.lit(91), 1, F.lit("5")),
    ):
        out = out.unionByName(part)
    return C.rows_of(out)


@plan(
    "p40_two_column_statement",
    sql(
        "WITH " + STMT_SQL + """, ok AS (SELECT * FROM st WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) SELECT 'fact' AS kind, substr(o_orderpriority, 3) AS label, 'Actual' AS header, round(sum(a), 2) AS amount, count(a) AS n FROM ok GROUP BY ALL
UNION ALL SELECT 'fact', substr(o_orderpriority, 3), 'Budget', round(-sum(b), 2), count(b) FROM ok GROUP BY ALL UNION ALL SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'unexpected_unit' ELSE 'unexpected_header' END, NULL, NULL, NULL, count(DISTINCT c_custkey) FROM st WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL"""
    ),
)
def p40(m: Model):
    facts, bad = C.two_column_statement(statement_rows(m), "$m", ["Actual", "Budget"])
    f = facts.groupBy(F.lit("fact").alias("kind"), "label", "header").agg(F.round(F.sum("amount"), 2).alias("amount"), count().alias("n"))
    none = F.lit(None).cast("string")
    b = bad.groupBy(F.col("reason").alias("kind")).agg(count().alias("n")).select("kind", none.alias("label"), none.alias("header"), F.lit(None).cast("double").alias("amount"), "n")
    return f.unionByName(b)


@plan("p41_exactly_one_match", sql("WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderpriority LIKE '1%') AS k, max(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END) AS o FROM orders GROUP BY ALL) SELECT 'match' AS kind, o_custkey, o AS value FROM c WHERE k = 1 UNION ALL SELECT 'quarantine', o_custkey, k FROM c WHERE k <> 1"))
def p41(m: Model):
    o = m.table("orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    hit, bad = C.exactly_one(o, F.col("o_orderpriority").startswith("1"), ["o_custkey"])
    return hit.select(F.lit("match").alias("kind"), "o_custkey", F.col("o_orderkey").alias("value")).unionByName(bad.select(F.lit("quarantine").alias("kind"), "o_custkey", F.col("n_matches").alias("value")))


@plan(
    "p44_portfolio_remap",
    sql(
        """WITH r AS (SELECT p_name AS label, financial_year, round(sum(amount_aud), 2) AS a FROM l GROUP BY ALL)
SELECT label, financial_year, CASE WHEN contains(label, 'red') THEN 'Health' WHEN contains(label, 'bolt') THEN 'Defence' END AS function, a AS amount_aud,
CASE WHEN financial_year NOT IN ('1998-99', '1999-00') THEN 'other_year' WHEN a NOT BETWEEN 1e5 AND 2e11 THEN 'amount_out_of_bounds' WHEN contains(label, 'ring') AND label <> 'red ring' THEN 'noise_label' WHEN NOT (contains(label, 'red') OR contains(label, 'bolt')) THEN 'no_function' END AS reason FROM r""",
        "l",
    ),
)
def p44(m: Model):
    rows = m.lines.groupBy(F.col("p_name").alias("label"), "financial_year").agg(F.round(F.sum("amount_aud"), 2).alias("amount_aud"))
    return R.remap_portfolio(rows, [("red", "Health"), ("bolt", "Defence")], ["red ring"], "ring", ["1998-99", "1999-00"]).select("label", "financial_year", "function", "amount_aud", "reason")


@plan("p45_prefer_best", sql("SELECT p_name, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, length(p_brand) DESC, p_retailprice DESC, p_partkey) = 1"))
def p45(m: Model):
    p = m.table("part")
    order = [F.when(F.col("p_type") == "PROMO", 0).otherwise(1), -F.length("p_brand"), -F.col("p_retailprice"), F.col("p_partkey")]
    return R.prefer_best(p.select("p_name", "p_brand", "p_partkey", "p_type", "p_retailprice"), ["p_name"], order).select("p_name", "p_brand", "p_partkey")


@plan(
    "p45_prefer_program_totals",
    sql(
        """SELECT source_id, financial_year, lower(label) AS label_key, round(amount_aud, 2) AS amount_aud, page, line_no FROM (SELECT jurisdiction AS source_id, financial_year, p_name AS label, round(amount_aud) AS amount_aud, CAST(fact_id % 10 AS INTEGER) AS page, CAST(l_orderkey AS INTEGER) AS line_no, p_type = 'PROMO' AS prefer FROM l)
QUALIFY row_number() OVER (PARTITION BY source_id, financial_year, lower(label), amount_aud ORDER BY prefer DESC, length(label) DESC, page, line_no) = 1""",
        "l",
    ),
)
def p45_totals(m: Model):
    from factline.operators.textlines import prefer_program_totals

    rows = m.lines.select(
        F.col("jurisdiction").alias("source_id"), "financial_year", F.lit("actual").alias("estimate_status"), F.col("p_name").alias("label"), F.round("amount_aud").alias("amount_aud"),
        (F.col("fact_id") % 10).cast("int").alias("page"), F.col("l_orderkey").cast("int").alias("line_no"), (F.col("p_type") == "PROMO").alias("prefer"),
    )
    return prefer_program_totals(rows).select("source_id", "financial_year", F.lower("label").alias("label_key"), F.round("amount_aud", 2).alias("amount_aud"), "page", "line_no")


P46_HAZARD = "<a class=x href=a/../z/./b.html?p=1&amp;q=2#top><b>the &lt;one&gt;</b>\n two</a><a href='get?file=t.csv'>Download <i>report</i></a>"


@plan(
    "p46_link_discovery",
    sql(
        r"""WITH h AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>', 1) AS hs, regexp_extract_all(html, '(?is)<a\s[^>]*?href="[^"]*"[^>]*>([^<]*)', 1) AS ts FROM pages),
b AS (SELECT *, CASE WHEN regexp_extract(regexp_replace(page_url, '[?#].*$', ''), '^([a-z]+://[^/]+/(?:.*/)?)', 1) = '' THEN regexp_extract(page_url, '^([a-z]+://[^/?#]+)', 1) || '/' ELSE regexp_extract(regexp_replace(page_url, '[?#].*$', ''), '^([a-z]+://[^/]+/(?:.*/)?)', 1) END AS folder FROM h),
a AS (SELECT page_id, page_url, folder, unnest(list_transform(list_zip(hs, ts, range(1, len(hs) + 1)), lambda x: {'href': x[1], 'text': x[2], 'pos': x[3]})) AS c FROM b),
r AS (SELECT page_id, c.pos AS pos, trim(regexp_replace(c.text, '\s+', ' ', 'g')) AS text, regexp_replace(CASE WHEN regexp_matches(trim(c.href), '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN trim(c.href) WHEN starts_with(trim(c.href), '//') THEN regexp_extract(page_url, '^([a-z]+:)', 1) || trim(c.href)
  WHEN starts_with(trim(c.href), '/') THEN regexp_extract(page_url, '^([a-z]+://[^/?#]+)', 1) || trim(c.href) ELSE folder || trim(c.href) END, '#.*$', '') AS url FROM a
 UNION ALL SELECT page_id, 1000000, 'the <one> two', folder || 'z/b.html?p=1&q=2' FROM b UNION ALL SELECT page_id, 1000001, 'Download report', folder || 'get?file=t.csv' FROM b),
u AS (SELECT page_id, url, arg_min(text, pos) AS text FROM r WHERE regexp_matches(url, '^https?://') GROUP BY ALL),
j AS (SELECT *, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM u)
SELECT CASE WHEN NOT (h LIKE '%.example.com' OR h = 'example.com' OR h LIKE '%.gov.au') THEN 'domain_not_allowed' WHEN regexp_matches(lower(text || ' ' || url), 'der') THEN 'excluded_by_registry' WHEN NOT ends_with(url, 'get?file=t.csv') AND NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '/[^/]*\.html$') THEN 'format_not_expected' END AS reason, count(*) AS n FROM j GROUP BY ALL"""
    ),
)
def p46(m: Model):
    pages = m.table("pages").withColumn("html", F.concat("html", F.lit(">" + P46_HAZARD)))
    links = D.link_candidates(pages, "page_id", "url", "html")
    return D.judge_links(links, ["example.com"], exclude=["der"], suffixes=[".html"]).groupBy("reason").agg(count().alias("n"))


@plan(
    "p47_content_sniff",
    sql(
        """WITH c AS (SELECT html AS x, 'page' AS k FROM pages UNION ALL SELECT text, 'doc' FROM documents UNION ALL SELECT props, 'props' FROM events), s AS (SELECT k, x, CASE WHEN regexp_matches(lower(ltrim(x)), '^(<!doctype html|<html|<head|<body|<script)') THEN 'html' WHEN ltrim(x) LIKE '{%' OR ltrim(x) LIKE '[%' THEN 'json'
 WHEN contains(x, chr(9)) THEN 'tsv' WHEN contains(x, ',') OR contains(x, chr(10)) THEN 'csv' ELSE 'text' END AS detected FROM c)
SELECT k, detected, CASE WHEN detected = 'text' THEN 'unrecognized' WHEN detected = 'html' AND regexp_matches(lower(x), 'captcha|access denied|cloudflare|verify you are human|bot challenge|request blocked|sign in|log in') THEN 'challenge_page' END AS refusal, count(*) AS n FROM s GROUP BY ALL"""
    ),
)
def p47(m: Model):
    parts = [m.table(t).select(F.encode(c, "UTF-8").alias("content"), F.lit(k).alias("k")) for t, c, k in (("pages", "html", "page"), ("documents", "text", "doc"), ("events", "props", "props"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    s = rows.withColumn("detected", D.sniff(F.col("content")))
    return s.groupBy("k", "detected", D.validity(F.col("detected"), F.col("content"), F.length("content"), ["html"]).alias("refusal")).agg(count().alias("n"))


@plan("p48_legacy_source", sql("SELECT level, CASE WHEN level = 'federal' AND jurisdiction LIKE 'NATION_1%' THEN 'fed_one' WHEN level = 'federal' THEN 'fed_rest' WHEN level = 'state' AND jurisdiction = 'NATION_2' THEN 'state_two' END AS source_key, count(*) AS n FROM f GROUP BY ALL", "f"))
def p48(m: Model):
    rules = [("federal", "NATION_1*", "fed_one"), ("federal", "NATION*", "fed_rest"), ("state", "NATION_2", "state_two")]
    return R.source_of_legacy(m.facts.select("level", "jurisdiction"), rules).groupBy("level", "source_key").agg(count().alias("n"))


@plan("p49_context_locator", sql("SELECT 'sheet:S' || event_type || ' | cell:B' || json_extract(props, '$.k') AS locator, count(*) AS n FROM events GROUP BY ALL"))
def p49(m: Model):
    ctx = F.to_json(F.struct(F.concat(F.lit("S"), "event_type").alias("sheet"), F.concat(F.lit("B"), F.get_json_object("props", "$.k")).alias("cell"), F.lit("").alias("unit")))
    return m.table("events").groupBy(R.context_locator(ctx).alias("locator")).agg(count().alias("n"))


@plan("p53_year_row_melt", sql("SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'actual' WHEN 'O' THEN 'budget' END AS estimate_status, CASE WHEN o_orderstatus = 'P' THEN 'unknown_type' END AS reason, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL"))
def p53(m: Model):
    from factline.operators.textlines import melt_year_rows

    side = lambda p: F.round(F.sum(F.when(F.substring("o_orderpriority", 1, 1) == p, F.col("o_totalprice"))), 2)
    o = m.table("orders")
    label = F.when(F.col("o_orderstatus") == "F", "Actual").when(F.col("o_orderstatus") == "O", "Budget").otherwise("Other")
    wide = o.groupBy("o_custkey", label.alias("type")).agg(*[side(str(i)).alias(f"m{i}") for i in range(1, 6)])
    statuses = m.local([("Actual", "actual"), ("Budget", "budget")], "type string, estimate_status string")
    long = melt_year_rows(wide, ["o_custkey", "type"], {f"m{i}": f"m{i}" for i in range(1, 6)}, statuses, "type")
    return long.groupBy("o_custkey", "estimate_status", "reason").agg(F.round(F.sum("amount"), 2).alias("amount"))


@plan("p59_keep_largest_per_label", sql("WITH b AS (SELECT jurisdiction, p_name AS label, max(amount_aud) AS amount_aud FROM l WHERE amount_aud >= 60000 GROUP BY ALL) SELECT jurisdiction, label, amount_aud FROM b", "l"))
def p59(m: Model):
    rows = m.lines.select("jurisdiction", F.col("p_name").alias("label"), "amount_aud")
    return R.keep_largest(rows, ["jurisdiction"], "label", "amount_aud", 60000)


@plan("p38_largest_per_scheme", sql("SELECT p_type AS scheme, max(amount_aud) AS amount_aud FROM l WHERE amount_aud >= 50000 GROUP BY ALL", "l"))
def p38(m: Model):
    rows = m.lines.select(F.col("p_type").alias("scheme"), "amount_aud")
    return R.keep_largest(rows, [], "scheme", "amount_aud", 50000)


@plan("p60_estimate_table_melt", sql("WITH " + GRID_SQL + " SELECT source_id, p_brand AS label, financial_year, CASE WHEN financial_year < '1998-99' THEN 'actual' ELSE 'forward_estimate' END AS estimate_status, round(sum(amount) * 1000, 0) AS amount FROM g GROUP BY ALL", "l"))
def p60(m: Model):
    rows = C.rows_of(grid(m))
    out = C.melt(rows, C.header_cells(rows, least=3)).where(~F.col("label").rlike("(?i)^total"))
    status = F.when(F.col("header") < "1998-99", "actual").otherwise("forward_estimate")
    return out.groupBy("source_id", "label", F.col("header").alias("financial_year"), status.alias("estimate_status")).agg(F.round(F.sum("amount") * 1000, 0).alias("amount"))


@plan("p61_last_number_per_row", sql("WITH " + GRID_SQL + " SELECT source_id, sec, p_brand AS label, CAST(max(col_no) AS INTEGER) AS col_no, arg_max(amount, col_no) AS amount FROM g GROUP BY ALL", "l").replace("SELECT source_id, sec, p_brand", "SELECT source_id, CAST(sec AS INTEGER) AS sec, p_brand"))
def p61(m: Model):
    rows = C.rows_of(grid(m)).where("row_no between 100 and 9000")
    out = C.last_number_per_row(rows, ["total section"])
    return out.select("source_id", F.floor(F.col("row_no") / 100).cast("int").alias("sec"), "label", "col_no", "amount")


@plan("p62_two_axis_melt", sql("WITH c AS (SELECT jurisdiction AS sheet, p_type AS function, p_brand AS cost_type, round(sum(amount_aud), 2) AS v FROM l GROUP BY ALL) SELECT sheet, function, cost_type, round(v * 1000, 0) AS amount FROM c WHERE v <> 0", "l"))
def p62(m: Model):
    v = F.sum("amount_aud")
    g = m.lines.groupBy("jurisdiction", "p_type", "p_brand").agg(F.round(v, 2).alias("v"))
    col = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    row = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("p_type")).cast("int") + 1
    src, sheet = F.lit("w").alias("source_id"), F.col("jurisdiction").alias("sheet")
    cells = (
        g.select(src, sheet, row.alias("row_no"), col.alias("col_no"), money(F.col("v")).alias("value"))
        .unionByName(g.select(src, sheet, F.lit(0).alias("row_no"), col.alias("col_no"), F.col("p_brand").alias("value")).distinct())
        .unionByName(g.select(src, sheet, row.alias("row_no"), F.lit(0).alias("col_no"), F.col("p_type").alias("value")).distinct())
        .unionByName(g.select(src, sheet, F.lit(0).alias("row_no"), F.lit(99).alias("col_no"), F.lit("Total").alias("value")).distinct())
        .unionByName(g.groupBy("jurisdiction", "p_type").agg(F.sum("v").alias("v")).select(src, sheet, row.alias("row_no"), F.lit(99).alias("col_no"), money(F.col("v")).alias("value")))
    )
    rows = C.rows_of(cells)
    out = C.melt(rows, C.header_cells(rows, r"^(?!(?i)total$).+", 1)).where("amount <> 0")
    return out.select("sheet", F.col("label").alias("function"), F.col("header").alias("cost_type"), F.round(F.col("amount") * 1000, 0).alias("amount"))


@plan("p63_filtered_long_table", sql("SELECT jurisdiction, financial_year, round(sum(amount_aud), 2) AS amount_aud FROM l WHERE p_type = 'MEDIUM' GROUP BY ALL", "l"))
def p63(m: Model):
    return m.lines.where("p_type = 'MEDIUM'").groupBy("jurisdiction", "financial_year").agg(F.round(F.sum("amount_aud"), 2).alias("amount_aud"))


@plan(
    "p64_neighbour_cells",
    sql("WITH " + GRID_SQL + """, fa AS (SELECT source_id, sec, b, col_no FROM g WHERE sec = 3 AND b = 12), ce AS (SELECT source_id, sec, b, col_no FROM g UNION ALL SELECT DISTINCT source_id, sec, b, 0 FROM g)
SELECT fa.source_id, CAST(fa.col_no AS INTEGER) AS col_no, count(*) AS n_cells FROM fa JOIN ce ON ce.source_id = fa.source_id AND ce.sec = fa.sec AND abs(ce.b - fa.b) <= 1 AND abs(ce.col_no - fa.col_no) <= 2 GROUP BY ALL""", "l"),
)
def p64(m: Model):
    cells = grid(m)
    facts = cells.where("row_no = 312 and col_no > 0").select("source_id", "sheet", "row_no", "col_no")
    return C.context_window(facts, cells).select("source_id", F.col("fact_col").alias("col_no"), "n_cells")
