"""Registered queries against their SQL at the smallest scale (a spread of families; the rest by tools/check.py)."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
NAMES = ["t6_preferred_basis", "c1_fact_set_validation", "a12_folder_category_contract", "w3_top_recipients_with_remainder", "j10_ranked_candidate_match", "l11_load_summary", "g5_year_fallback", "q15_duplicate_deletion_plan", "e10_bm25_documents", "p29_triple_extraction", "p36_function_tables",
    "p4_attribution_per_row", "p13_messy_dates", "p27_sectioned_csv_split", "p46_link_discovery", "p44_portfolio_remap", "p35_labelled_rows_by_section", "p45_prefer_program_totals", "p34_program_tables",
    "l7_statement_reasons", "l6_document_and_retrieval_dimensions", "s1_csv_scan", "s4_json_release_scan", "s6_corpus_scan_with_provenance", "s7_fact_table_after_merge", "s8_quarantine_rows", "s9_staging_rows",
    "q30_workbook_inventory", "q31_handoff_status", "e7_spending_postings", "e11_vocabulary_ranking", "e13_unified_search_all", "e6_facts_by_id", "g7_same_group_descent", "g15_crosswalk_edges", "g19_hierarchy_rollup",
    "w7_stride_sample", "w10_backlog_ranking", "t1_preserved_amounts", "t16_nestable_children", "t14_combined_trees", "t20_drill_to_fact", "q20_coverage_reasons", "p42_document_line_classes"]


def norm(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def test_every_query_has_sql_and_a_neutral_name():
    from factline.plans import load_plans

    plans = load_plans()
    assert all(p.sql is not None for p in plans.values()) and len(plans) > 200
    assert not any("pipeline" in n for n in plans)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e
    from factline.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = e.queries()[name](spark, FOLDER)
    rel = con.execute(e.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect())
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    assert got == want
