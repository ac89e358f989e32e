"""Melts of header-less cell grids ``(source_id, sheet, row_no, col_no, value)``.

Cells are grouped by row, so every shuffle key is a sheet row; a workbook with most of the cells is
spread over all tasks.  Only header rows travel by sheet, and they are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.ordered import fill_forward, within_distance

SHEET = ["source_id", "sheet"]
FY_CELL = r"^\d{4}-\d{2}$"


def rows_of(cells: DataFrame) -> DataFrame:
    """One row per sheet row: its label (first column) and its other cells as ``(col_no, value)``."""
    filled = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    return filled.groupBy(*SHEET, "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.trim(F.regexp_replace("value", r"\s+", " ")))).alias("label"),
        F.max(F.when(F.col("col_no") == 0, F.col("value"))).alias("raw_label"),
        F.collect_list(F.when(F.col("col_no") > 0, F.struct("col_no", "value"))).alias("cells"),
    )


def header_row(rows: DataFrame, pattern: str = FY_CELL, least: int = 2, first: int = 15) -> DataFrame:
    """First of the top rows with enough matching cells."""
    hits = F.size(F.filter("cells", lambda c: F.trim(c["value"]).rlike(pattern)))
    top = rows.where((F.col("row_no") < first) & (hits >= least))
    return top.groupBy(*SHEET).agg(F.min("row_no").alias("header_row"))


def header_cells(rows: DataFrame, pattern: str = FY_CELL, least: int = 2, first: int = 15) -> DataFrame:
    """``(sheet, header_row, headers)`` with headers as a map from column to its text."""
    h = header_row(rows, pattern, least, first)
    matched = F.filter("cells", lambda c: F.trim(c["value"]).rlike(pattern))
    j = rows.join(h, SHEET).where(F.col("row_no") == F.col("header_row"))
    return j.select(*SHEET, "header_row", F.map_from_entries(F.transform(matched, lambda c: F.struct(c["col_no"], F.trim(c["value"])))).alias("headers"))


def melt(rows: DataFrame, headers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric body cells with their header; blank, ``Released`` and non-numeric cells drop out."""
    j = rows.join(headers, SHEET).where((F.col("row_no") > F.col("header_row")) & F.col("label").isNotNull())
    j = j.where(~F.lower("label").startswith("released"))
    spread = j.select(*SHEET, "row_no", "label", *keep, "headers", F.explode("cells").alias("c"))
    out = spread.select(
        *SHEET, "row_no", F.col("c.col_no").alias("col_no"), "label", *keep,
        F.try_element_at("headers", F.col("c.col_no")).alias("header"), F.trim("c.value").try_cast("double").alias("amount"),
    )
    return out.where(F.col("header").isNotNull() & F.col("amount").isNotNull())


def locator(kind: str) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("sheet:"), "sheet"), F.concat(F.lit(f"{kind}:"), "label"), F.concat(F.lit("fy:"), "header"))


def with_section(rows: DataFrame, section: Column, name: str = "section") -> DataFrame:
    """Carry the running section down the rows of a sheet; a section row itself keeps its own."""
    return fill_forward(rows.withColumn(name, section), SHEET, ["row_no"], [name])


def latest_month_row(cells: DataFrame, month: int = 6) -> DataFrame:
    """Per series column the value of its last row in a month; rows are dated in the first column."""
    dated = rows_of(cells).select(*SHEET, F.to_date("label").alias("day"), F.explode("cells").alias("c"))
    hit = dated.where(F.month("day") == month).select(*SHEET, "day", F.col("c.col_no").alias("col_no"), F.col("c.value").try_cast("double").alias("v"))
    return hit.where(F.col("v").isNotNull()).groupBy(*SHEET, "col_no").agg(F.max("day").alias("day"), F.max_by("v", "day").alias("amount"))


def latest_liabilities(cells: DataFrame) -> DataFrame:
    """Negative cells of the last dated row with any value, as amounts, and one total per sheet."""
    dated = rows_of(cells).select(*SHEET, F.to_date("label").alias("day"), F.explode("cells").alias("c"))
    values = dated.select(*SHEET, "day", F.col("c.col_no").alias("col_no"), F.col("c.value").try_cast("double").alias("v")).where(F.col("v").isNotNull() & F.col("day").isNotNull())
    last = values.groupBy(*SHEET).agg(F.max("day").alias("day"))
    owed = values.join(last, [*SHEET, "day"], "left_semi").where(F.col("v") < 0).withColumn("amount", F.abs("v")).drop("v")
    total = owed.groupBy(*SHEET, "day").agg(F.sum("amount").alias("amount")).withColumn("col_no", F.lit(None).cast("int"))
    return owed.unionByName(total)


def last_number_per_row(rows: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Last numeric cell of each labelled row; rows without numbers are section rows and drop out."""
    numeric = F.filter(F.transform("cells", lambda c: F.struct(c["col_no"], F.trim(c["value"]).try_cast("double").alias("v"))), lambda c: c["v"].isNotNull())
    out = rows.withColumn("_n", F.array_sort(numeric)).where(F.size("_n") > 0).where(F.col("label").isNotNull() & ~F.lower("label").isin(*[s.lower() for s in skip]) if skip else F.size("_n") > 0)
    return out.select(*SHEET, "row_no", "label", F.element_at("_n", -1)["col_no"].alias("col_no"), F.element_at("_n", -1)["v"].alias("amount"))


def context_window(facts: DataFrame, cells: DataFrame, rows: int = 1, cols: int = 2) -> DataFrame:
    """Neighbour cells of each fact's cell as text, at most (2r+1)(2c+1) of them.

    Facts meet cells through row buckets of a sheet, never through the whole sheet.
    """
    target = facts.select(*SHEET, F.col("row_no").alias("fact_row"), F.col("col_no").alias("fact_col"))
    near = within_distance(target, cells, SHEET, "fact_row", "row_no", -rows, rows)
    near = near.where(F.abs(F.col("col_no") - F.col("fact_col")) <= cols)
    listed = F.array_sort(F.collect_list(F.struct("row_no", "col_no", "value")))
    return near.groupBy(*SHEET, "fact_row", "fact_col").agg(
        F.array_join(F.transform(listed, lambda c: c["value"]), " | ").alias("context"), F.count(F.lit(1)).alias("n_cells")
    )


# Month header of a monthly statement and what its parts mean.
MONTH_HEADER = r"^([A-Z]+)\s*\n(\d{4}-\d{4})\s*\n(YTD\s+)?([A-Za-z]+)\s*\n(\$[a-z]+)\s*$"
MONTH_UNITS = {"$m": 1e6, "$b": 1e9, "$": 1.0}


def monthly_melt(rows: DataFrame, header_row_no: int = 1) -> tuple[DataFrame, DataFrame]:
    """(facts, quarantine) of a monthly statement whose second row holds four-line headers.

    A bare month is refused, July excepted; the table ends at its first footnote row.
    """
    part = lambda i: F.regexp_extract(F.trim("text"), MONTH_HEADER, i)
    heads = rows.where(F.col("row_no") == header_row_no).select(*SHEET, F.explode("cells").alias("c")).select(*SHEET, F.col("c.col_no").alias("col_no"), F.col("c.value").alias("text"))
    heads = heads.withColumn("ok", F.trim("text").rlike(MONTH_HEADER))
    scale = F.try_element_at(F.create_map(*[x for k, v in MONTH_UNITS.items() for x in (F.lit(k), F.lit(v))]), part(5))
    known = heads.where("ok").select(
        *SHEET, "col_no", F.lower(part(1)).alias("estimate_status"), F.concat(F.substring(part(2), 1, 5), F.substring(part(2), 8, 2)).alias("financial_year"),
        ((part(3) != "") | (part(4) == "July")).alias("ytd"), part(4).alias("month"), part(5).alias("unit"), scale.alias("scale"),
    )
    bad_heads = heads.where(~F.col("ok")).select(*SHEET, F.lit("unparsed_column_header").alias("reason"), F.col("text").alias("detail"))
    bad_units = known.where(F.col("scale").isNull()).select(*SHEET, F.lit("unknown_unit").alias("reason"), F.col("unit").alias("detail"))
    body = rows.where((F.col("row_no") > header_row_no) & F.col("label").isNotNull())
    note = F.col("label").rlike(r"^\([a-z]\)")
    stop = body.where(note).groupBy(*SHEET).agg(F.min("row_no").alias("_stop"))
    body = body.join(stop, SHEET, "left").where(F.col("_stop").isNull() | (F.col("row_no") < F.col("_stop")))
    cells = body.select(*SHEET, F.trim(F.regexp_replace("label", r"\([a-z]\)\s*$", "")).alias("label"), F.explode("cells").alias("c"))
    cells = cells.select(*SHEET, "label", F.col("c.col_no").alias("col_no"), F.trim("c.value").try_cast("double").alias("v")).where(F.col("v").isNotNull())
    j = cells.join(known.where(F.col("scale").isNotNull()), [*SHEET, "col_no"])
    facts = j.where("ytd").withColumn("amount", F.col("v") * F.col("scale")).drop("v", "scale", "ytd", "col_no")
    bare = j.where(~F.col("ytd")).select(*SHEET, F.lit("non_ytd_column_not_supported").alias("reason"), F.col("label").alias("detail"))
    return facts, bad_heads.unionByName(bad_units).unionByName(bare)


def two_column_statement(rows: DataFrame, unit: str, headers: Sequence[str], header_row_no: int = 1, unit_row_no: int = 2) -> tuple[DataFrame, DataFrame]:
    """(facts, quarantined sheets): a sheet counts only when both headers and the unit cells are as expected."""
    values = F.transform(F.array_sort("cells"), lambda c: F.trim(c["value"]))
    check = rows.where(F.col("row_no").isin(header_row_no, unit_row_no)).groupBy(*SHEET).agg(
        F.max(F.when(F.col("row_no") == header_row_no, values)).alias("_h"), F.max(F.when(F.col("row_no") == unit_row_no, values)).alias("_u")
    )
    want = F.array(*[F.lit(h) for h in headers])
    reason = F.when(~F.coalesce(F.col("_h") == want, F.lit(False)), "unexpected_header").when(
        ~F.coalesce(F.forall("_u", lambda u: u == unit), F.lit(False)), "unexpected_unit"
    )
    check = check.withColumn("reason", reason)
    body = rows.where((F.col("row_no") > unit_row_no) & F.col("label").isNotNull())
    stop = body.where(F.col("label").rlike(r"^\([a-z]\)")).groupBy(*SHEET).agg(F.min("row_no").alias("_stop"))
    body = body.join(check.where("reason is null").select(*SHEET), SHEET, "left_semi").join(stop, SHEET, "left")
    body = body.where(F.col("_stop").isNull() | (F.col("row_no") < F.col("_stop")))
    spread = body.select(*SHEET, F.trim(F.regexp_replace("label", r"\s*\([a-z]\)\s*$", "")).alias("label"), F.explode("cells").alias("c"))
    name = F.element_at(want, F.col("c.col_no").cast("int"))
    from factline.functions.amounts import parse_number

    facts = spread.select(*SHEET, "label", name.alias("header"), parse_number(F.col("c.value")).alias("amount")).where(F.col("amount").isNotNull())
    return facts, check.where("reason is not null").select(*SHEET, "reason")


def exactly_one(rows: DataFrame, test: Column, keys: Sequence[str] = tuple(SHEET)) -> tuple[DataFrame, DataFrame]:
    """(the matching row of sheets that have just one, sheets with another count)."""
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count(F.when(test, 1)).alias("n_matches"))
    return rows.where(test).join(n.where("n_matches = 1").select(*keys), keys, "left_semi"), n.where("n_matches <> 1")
