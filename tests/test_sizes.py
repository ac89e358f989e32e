"""Queries on tables whose keys or groups are larger than those of the given ones."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def agrees(spark, name, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    return sorted(map(str, (tuple(r[c] for c in cols) for r in entry.queries()[name](spark, folder).collect()))) == sorted(map(str, rel.fetchall()))


def test_sections_hold_with_keys_of_any_size(spark, tmp_path):
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    shifted = [part.withColumn("p_partkey", F.col("p_partkey") + n) for n in (0, 999_990, 2_500_000, 3_000_000_000)]
    out = shifted[0]
    for s in shifted[1:]:
        out = out.unionByName(s)
    out.write.parquet(str(tmp_path / "part.parquet"))
    assert agrees(spark, "p35_labelled_rows_by_section", str(tmp_path))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_program_tables_are_not_brought_together_by_their_header(spark):
    from factline.operators import textlines as T

    lines = [("q", 1, 0, "Program expenses")] + [("q", 1, i, f"Program 1.{i}: Some title of it 1,234 1,000 2,000") for i in range(1, 4)]
    lines += [("r", 1, 0, "Program expenses"), ("r", 1, 1, "2023-24 Actual 2024-25 Budget 2025-26 Forward estimate"), ("r", 1, 2, "Program 2.1: Another title 1,234 1,000 2,000")]
    facts, bad = T.program_tables(spark.createDataFrame(lines, "source_id string, page int, line_no int, text string"))
    for df in (facts, bad):  # most rows may have one header, or none
        assert not [x for x in optimized(df).splitlines() if "Join" in x and "_header" in x]
    assert bad.count() == 3 and [r.financial_year for r in facts.orderBy("financial_year").collect()] == ["2023-24", "2024-25", "2025-26"]
    assert {r.estimate_status for r in facts.collect()} == {"actual", "budget", "forward_estimate"}


def test_a_header_is_parsed_once_per_row_to_align(spark):
    from factline.operators import textlines as T

    rows = spark.createDataFrame([(2, "2020-21 2021-22 2022-23"), (3, "2020-21 2021-22 2022-23"), (4, "2020-21 2021-22 2022-23"), (1, ""), (2, "")], "n int, text string")
    out = rows.select(T.align_years(F.col("n"), T.year_header(F.col("text"))).alias("a"))
    uses = lambda df: optimized(df).count("forward\\s+estimate")
    assert 0 < uses(out) <= uses(rows.select(T.year_header(F.col("text"))))
    want = ["table_header_right_align", "table_header_exact", "header_column_count_mismatch", "too_few_numeric_columns", "no_year_evidence_quarantine"]
    assert sorted(r.a.reason for r in out.collect()) == sorted(want)


def test_postings_are_made_where_the_text_is(spark):
    from factline.search import index as X

    docs = spark.createDataFrame([(1, "b a b c b"), (2, "a"), (3, ""), (4, None), (5, "Z z \u00e9 z")], "id long, text string")
    made = X.postings(docs.select("id", X.terms_of(F.col("text")).alias("terms")), "id")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.term, r.id, r.dl, r.tf) for r in made.collect())
    assert got == [("a", 1, 5, 1), ("a", 2, 1, 1), ("b", 1, 5, 3), ("c", 1, 5, 1), ("z", 5, 4, 3), ("\u00e9", 5, 4, 1)]


def test_only_documents_with_hits_are_cut_up_to_be_shown(spark):
    from factline.plans import searching as S
    from factline.plans.model import Model

    m = Model(spark, FOLDER)
    every = {(r.id, r.text) for r in S.chunk_docs(m).collect()}
    ids = sorted(i for i, _ in every)[::25]
    some = {(r.id, r.text) for r in S.chunk_docs(m, spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    heads = {i.split(":")[0] for i in ids}
    assert some == {c for c in every if c[0].split(":")[0] in heads} != every


def test_the_date_of_an_award_is_parsed_once(spark):
    from factline.operators.registers import award_facts
    from factline.sources.readers import AWARD_SCHEMA

    awards = [("a", None, "2023-08-02T00:00:00Z"), ("b", None, None), ("c", None, "2023-13-02")]
    rows = spark.createDataFrame([("o", None, [(i, t, d, (5.0, "AUD"), [("S",)], ("B",)) for i, t, d in awards])], AWARD_SCHEMA)
    facts = award_facts(rows, "1900-01")
    assert optimized(facts).count("yyyy-MM-dd") == 1
    assert {r.award_id: r.financial_year for r in facts.collect()} == {"a": "2023-24", "b": "1900-01", "c": "1900-01"}


def test_workbook_cells_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr("factline.session.TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    plan = entry.queries()["q30_workbook_inventory"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {n}\n") == 2 and n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert agrees(spark, "q30_workbook_inventory", FOLDER)


def test_stale_edges_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr("factline.session.TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    dealt = []
    whole = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda df, *a: dealt.append(a) or whole(df, *a))
    assert agrees(spark, "q17_stale_node_cleanup", FOLDER)
    assert {(n, k) for k in ("l_orderkey", "o_orderkey", "parent_id", "child_id")} <= set(dealt)
