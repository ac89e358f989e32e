"""Keyword search over facts with filters, ordering and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.views import mode_rows
from factline.session import cut_lineage


def find_facts(
    facts: DataFrame,
    text: str | None = None,
    mode: str | None = None,
    level: str | None = None,
    jurisdiction: str | None = None,
    from_year: str | None = None,
    to_year: str | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
    title: str | None = None,
) -> DataFrame:
    """Every filter is a plain predicate, so it reaches the scan; years compare as text."""
    rows = mode_rows(facts, mode) if mode else facts
    tests: list[Column] = []
    if text:
        hit = F.lower("node_name").contains(text.lower())
        tests.append(hit | F.lower(title).contains(text.lower()) if title else hit)
    if level:
        tests.append(F.col("level") == ("federal" if level == "national" else level))
    if jurisdiction:
        tests.append(F.lower("jurisdiction").contains(jurisdiction.lower()))
    for col, low, high in (("financial_year", from_year, to_year), ("amount_aud", min_amount, max_amount)):
        if low is not None:
            tests.append(F.col(col) >= low)
        if high is not None:
            tests.append(F.col(col) <= high)
    for t in tests:
        rows = rows.where(t)
    return rows


#: Rows up to the end of a page that a bounded top-k may bring together; deeper pages are found by counts.
SHALLOW = 10_000


def _order(order: str) -> list[Column]:
    amount = {"amount_desc": [F.desc("amount_aud")], "amount_asc": [F.asc("amount_aud")], "year": []}[order]
    return [*amount, F.desc("financial_year"), F.lower("node_name"), F.col("fact_id")]


def ordered(rows: DataFrame, order: str = "amount_desc") -> DataFrame:
    return rows.orderBy(*_order(order))


def page(rows: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """One page with the total of all rows.

    A page near the start is a bounded top-k.  For a deep one the rows are placed by range of the order and written, their counts per
    place tell which places hold the page, and only those are sorted: no task gets the rows before it.
    """
    if offset + limit <= SHALLOW:
        total = rows.agg(F.count(F.lit(1)))
        return ordered(rows, order).offset(offset).limit(limit).withColumn("total", total.scalar())
    placed = cut_lineage(rows.repartitionByRange(*_order(order)).withColumn("_place", F.spark_partition_id()))
    counts = sorted((r["_place"], r["n"]) for r in placed.groupBy("_place").agg(F.count(F.lit(1)).alias("n")).collect())  # as many as partitions
    ahead, holds = 0, {}
    for place, n in counts:
        if ahead < offset + limit and ahead + n > offset:
            holds[place] = ahead
        ahead += n
    if not holds:
        return rows.withColumn("total", F.lit(ahead).cast("long")).limit(0)
    before = F.try_element_at(F.create_map(*[F.lit(x) for kv in holds.items() for x in kv]), F.col("_place"))
    number = before + F.row_number().over(Window.partitionBy("_place").orderBy(*_order(order))) - 1
    some = placed.where(F.col("_place").isin(list(holds))).withColumn("_no", number).where((F.col("_no") >= offset) & (F.col("_no") < offset + limit))
    return some.orderBy("_no").drop("_no", "_place").withColumn("total", F.lit(ahead).cast("long"))
