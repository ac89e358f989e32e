"""Seconds per headline query, one per family; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from factline.plans import load_plans
from factline.plans.model import Model
from factline.plans.searching import chunk_index, vector_lists
from factline.session import build_session, remove_steps

HEADLINE = (
    "t1_rollup_tree", "t12_level_series", "c1_fact_set_validation", "a12_folder_category_contract", "a18_vocabulary",
    "w3_top_recipients_with_remainder", "w5_fold_to_top_n", "j1_star_join", "j9_longest_ancestor", "j10_ranked_candidate_match",
    "l1_keyed_upsert", "l2_gate_reasons", "l8_revision_conflicts", "g5_year_fallback", "g7_same_group_descent",
    "g9_non_additive_tagging", "q2_source_total_reconciliation", "q6_duplicate_facts", "q13_traversal_audit", "p19_melt_by_year",
    "p34_program_tables", "p36_function_tables", "p42_document_line_classes", "p46_link_discovery", "e8_document_chunks",
    "e10_bm25_documents", "e11_cosine_ranking", "e12_rank_fusion",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    plans = load_plans()
    # one run that is not counted, so that the first query does not pay for starting up
    plans["a18_vocabulary"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    # searches open an index that stays: making it is a figure of its own
    t0 = time.perf_counter()
    chunk_index(Model(spark, folder))
    seconds["e7_index_build"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    vector_lists(Model(spark, folder))
    seconds["e11_lists_build"] = round(time.perf_counter() - t0, 3)
    remove_steps(spark)
    for name in HEADLINE:
        t0 = time.perf_counter()
        plans[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        remove_steps(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "driver_memory": spark.conf.get("spark.driver.memory"),
            }
        )
    )


if __name__ == "__main__":
    main()
