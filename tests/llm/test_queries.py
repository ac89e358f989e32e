"""The registered queries at the smallest scale, and the pipeline stage by stage."""

import re

import pytest
from pyspark.sql import functions as F
from test_repeats import brute

import corpus_pipeline as P
from factline.llm import decontamination, mixing, queries, rules
from factline.session import read_table

COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_language": "doc_id held_out lang_pred score",
    "op6_extraction": "page_id url text n_chars",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_minhash": "doc_id n_shingles component_id kept",
    "op10_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


def test_names():
    numbered = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline"}
    assert numbered == set(range(1, 14)) and "pipeline" in queries.QUERIES and set(queries.sql()) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", COLUMNS)
def test_a_row_for_each_row_of_the_table(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    table = "pages" if "page_id" in df.columns else "documents"
    assert set(COLUMNS[name].split()) <= set(df.columns)
    assert df.count() == read_table(spark, folder, table).count()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, folder):
    docs = read_table(spark, folder, "documents")
    quality = P.quality_rules(spark, docs, folder)
    assert quality.columns == docs.columns
    kept = texts(quality)
    cutoffs = rules.fit_cutoffs(rules.with_counts(docs).select("doc_id", "lang", "_counts"), read_table(spark, folder, "labels"))
    assert not cutoffs.table  # too few labels here: only the base rules decide
    ok = lambda t: (c := rules.counts_of(t))[0] >= 20 and 100 * c[-1] <= 30 * c[0]
    assert kept == {i: t for i, t in texts(docs).items() if ok(t)}

    near = P.near_duplicates(spark, quality, folder)
    assert near.columns == docs.columns
    left = texts(near)
    assert len(set(left.values())) == len(left) and left.items() <= kept.items()
    shingles = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in kept.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for gone in kept.keys() - left.keys():
        assert max(alike(gone, other) for other in kept if other != gone) >= 0.8
    ids = sorted(left)
    assert not any(alike(a, b) >= 0.8 for a in ids for b in ids if a < b)

    unique = P.repeated_strings(spark, near, folder)
    assert unique.columns == docs.columns
    cut = texts(unique)
    want = dict(zip(ids, brute([left[i] for i in ids], 100), strict=True))
    assert cut.keys() == left.keys() and all(len(left[i].encode()) - want[i][1] - len(cut[i].encode()) in (0, 1, 2) or want[i][1] == 0 for i in ids)
    assert all(cut[i] == left[i] for i in ids if want[i][1] == 0)

    clean = P.benchmark_leaks(spark, unique, folder)
    assert clean.columns == docs.columns
    bad = {r["doc_id"] for r in decontamination.leaks(unique, read_table(spark, folder, "benchmark")).collect()}
    assert texts(clean) == {i: t for i, t in cut.items() if i not in bad}
    items = [r["text"] for r in read_table(spark, folder, "benchmark").collect()]
    assert not any(q in t for t in texts(clean).values() for q in items)

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", clean.toPandas())
    want = sorted(r for r in con.execute(mixing.MIX_SQL).fetchall() if r[4] > 0)
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in P.source_mix(spark, clean, folder).collect()) == want


def test_equal_ids_with_different_texts(spark, docs_of, folder):
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    item = read_table(spark, folder, "benchmark").where(F.length("text") > 60).first()["text"]
    rows = [(3, one, "en", "a"), (5, one, "en", "b"), (5, other, "de", "c"), (5, other, "en", "b"), (7, other, "en", "d"), (9, item, "en", "a"), (9, one[::-1], "en", "a")]
    for n in (1, 7):
        near = P.near_duplicates(spark, docs_of(rows).repartition(n), folder)
        assert sorted((r["doc_id"], r["text"], r["lang"]) for r in near.collect()) == sorted([(3, one, "en"), (5, other, "de"), (9, item, "en"), (9, one[::-1], "en")])
    assert sorted((r["doc_id"], r["text"]) for r in P.benchmark_leaks(spark, near, folder).collect()) == sorted([(3, one), (5, other), (9, one[::-1])])


def test_rows_without_id_are_judged_by_their_texts(spark, docs_of, folder):
    item = read_table(spark, folder, "benchmark").where(F.length("text") > 60).first()["text"]
    clean = " ".join(f"v{i}" for i in range(60))
    rows = docs_of([(None, item, "en", "a"), (None, clean, "en", "a"), (None, None), (4, clean, "en", "a")])
    assert {(r["doc_id"], r["text"]) for r in P.benchmark_leaks(spark, rows, folder).collect()} == {(None, clean), (None, None), (4, clean)}


def test_stages_take_odd_rows(spark, docs_of, folder):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (2, words, None, None), (None, words + " x", "en", "a"), (None, None), (3, None), (4, ""), (5, "long " + " ".join(f"v{i}" for i in range(30_000)), "en", "b")]
    df = docs_of(rows)
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == list(P.COLUMNS)
    got = P.source_mix(spark, df, folder).collect()
    assert {r["doc_id"] for r in got} >= {5}
    empty = docs_of([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, folder).where(F.lit(True)).collect() == []
