"""Citations and the evidence they point to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.ordered import within_distance

CELL = r"^[A-Za-z]{1,3}\d{1,7}$"
# Suffixes by viewer.
SPREADSHEETS = (".xlsx", ".xls", ".csv", ".tsv", ".xlsm")
TEXTS = (".docx", ".txt", ".json", ".jsonl", ".md")
AMOUNT_COLUMN = r"(?i)amount|value|total|paid|invoice"


def locator_tokens(locator: Column) -> Column:
    """``key:value | key:value`` as a map; the last of equal keys wins, bare parts join under ``text``."""
    parts = F.filter(F.transform(F.split(F.coalesce(locator, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    is_pair = lambda p: p.rlike(r"^[a-zA-Z_]+\s*:\s*.+$")
    pairs = F.transform(
        F.filter(parts, is_pair),
        lambda p: F.struct(F.lower(F.regexp_extract(p, r"^([a-zA-Z_]+)", 1)).alias("k"), F.trim(F.regexp_extract(p, r"^[a-zA-Z_]+\s*:\s*(.+)$", 1)).alias("v")),
    )
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    keyed = F.map_from_entries(last)
    bare = F.array_join(F.filter(parts, lambda p: ~is_pair(p)), " | ")
    return F.when((bare != "") & ~F.map_contains_key(keyed, "text"), F.map_concat(keyed, F.create_map(F.lit("text"), bare))).otherwise(keyed)


def parse_locator(df: DataFrame, locator: str = "locator") -> DataFrame:
    t = df.withColumn("_t", locator_tokens(F.col(locator)))
    get = lambda k: F.try_element_at("_t", F.lit(k))
    digits = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("int"))
    cell = F.when(get("cell").rlike(CELL), F.upper(get("cell")))
    csv_row = F.when(F.lower(locator).startswith("csv:"), F.nullif(F.regexp_extract(F.col(locator), r"(?i)csv:row:(\d+)", 1), F.lit("")).cast("int"))
    table = F.coalesce(get("table"), F.nullif(F.regexp_extract(F.col(locator), r"(?i)(?:^|\|\s*)(Table\s+\d[^|]*?)\s*(?:\||$)", 1), F.lit("")))
    purpose = F.coalesce(get("purpose"), get("function"))
    text = F.when(table.isNull() | (F.lower(get("text")) != F.lower(table)), get("text"))
    anchor = F.array_join(F.array_distinct(F.array_compact(F.array(table, purpose, get("amount"), text))), " | ")
    return t.select(
        *df.columns,
        get("sheet").alias("sheet_name"),
        cell.alias("cell"),
        digits(get("page")).alias("page_number"),
        F.coalesce(digits(get("row")), csv_row).alias("row_number"),
        get("unit").alias("unit_label"),
        F.coalesce(get("fy"), get("col")).alias("financial_year_label"),
        F.nullif(anchor, F.lit("")).alias("text_anchor"),
    )


def media_type(path: Column, page: Column, sheet: Column, cell: Column, row: Column) -> Column:
    low = F.lower(path)
    suffix = F.regexp_extract(low, r"(\.[a-z0-9]+)$", 1)
    no_path = F.when(page > 0, "pdf").when(sheet.isNotNull() | cell.isNotNull() | (row > 0), "spreadsheet").otherwise("unsupported")
    return (
        F.when(path.isNull(), no_path)
        .when(suffix == ".gz", "text_chunk")
        .when(suffix.isin(*SPREADSHEETS), "spreadsheet")
        .when(suffix == ".pdf", "pdf")
        .when(suffix.isin(*TEXTS), "text_chunk")
        .when(page > 0, "pdf")
        .otherwise("unsupported")
    )


def row_windows(cited: DataFrame, staged: DataFrame, key: str, window: int = 5) -> DataFrame:
    """Staged rows within ``window`` of each cited row, through buckets of positions.

    Row 1 of a file is its header, so data row ``n`` lies on line ``n + 1``.
    """
    pairs = within_distance(cited, staged, [key], "cited_row", "row_no", -window, window)
    return pairs.withColumn("is_cited", F.col("row_no") == F.col("cited_row"))


def highlight_column(columns: Sequence[str]) -> int:
    """First amount-like column, else the second one, else the first."""
    import re

    for i, c in enumerate(columns):
        if re.search(AMOUNT_COLUMN[4:], c, re.I):
            return i
    return min(1, len(columns) - 1) if columns else 0


def citations(facts: DataFrame, documents: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Citation per fact: locator JSON over document over retrieval; incomplete ones are left out.

    Facts carry ``locator_json, document_id, retrieval_id, retrieved_at``.
    """
    j = facts.join(documents, "document_id").join(retrievals, "retrieval_id", "left")
    loc = lambda k: F.nullif(F.get_json_object("locator_json", f"$.{k}"), F.lit(""))
    landing = F.coalesce(loc("landing_url"), "doc_landing_url")
    original = F.coalesce(loc("original_resource_url"), "resolved_url", "canonical_resource_url")
    cached = F.coalesce(loc("cached_copy_path"), "local_path")
    locator = F.coalesce(loc("locator"), F.lit(""))
    out = j.select(
        "fact_id", "amount_aud", landing.alias("landing_url"), original.alias("original_resource_url"), cached.alias("cached_copy_path"),
        locator.alias("locator"), "sha256", F.coalesce("retrieval_retrieved_at", "retrieved_at").alias("retrieved_at"),
    )
    whole = F.lit(True)
    for c in ("landing_url", "original_resource_url", "cached_copy_path", "locator"):
        whole = whole & (F.trim(F.coalesce(c, F.lit(""))) != "")
    return out.where(whole)
