import math

import pytest
from pyspark.sql import functions as F

from factline.operators import matching
from factline.quality import coverage as CO
from factline.quality import hygiene as H
from factline.quality import integrity as I
from factline.search import evidence as EV
from factline.search import index as X
from factline.search import text as T
from factline.search import vectors as V


def test_bm25_against_plain_python(spark, tmp_path):
    docs = {1: "aged care aged", 2: "care home", 3: "agedness of care and care", 4: "roads", 5: "bridges and roads", 6: "ports", 7: "rail"}
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    got = {r.id: r.bm25 for r in T.bm25(X.refresh(df, "id", F.col("text"), str(tmp_path / "index")), "id", "aged care", 10).collect()}
    toks = {k: v.split() for k, v in docs.items()}
    n, avg = len(docs), sum(len(t) for t in toks.values()) / len(docs)
    phrases = [lambda t: t == "aged", lambda t: t.startswith("aged"), lambda t: t == "care", lambda t: t.startswith("care")]
    want = {}
    for k, ts in toks.items():
        f = [sum(map(p, ts)) for p in phrases]
        if not (f[1] and f[3]):
            continue
        s = 0.0
        for p, tf in zip(phrases, f):
            d = sum(any(map(p, x)) for x in toks.values())
            idf = math.log((n - d + 0.5) / (d + 0.5))
            s += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        want[k] = round(s, 9)
    assert got.keys() == want.keys() == {1, 3}
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_every_query_token_counts(spark, tmp_path):
    words = [f"tok{chr(97 + i)}" for i in range(14)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:12])), (3, "x")], "id long, text string")
    index = X.refresh(df, "id", F.col("text"), str(tmp_path / "index"))
    assert [r.id for r in T.bm25(index, "id", " ".join(words), 10).collect()] == [1]


def test_fusion_shows_the_highlighted_item(spark):
    text = spark.createDataFrame([("a", 1.0, "x «y»"), ("b", 0.5, "none")], "id string, order_score double, snippet string")
    vec = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 7.0)], "id string, order_score double")
    assert {r.id: (r.shown, r.n_lists) for r in V.fuse([text, vec], "id", 10).collect()} == {"a": (0, 2), "b": (1, 2), "c": (1, 1)}


def test_chunks_keep_the_whole_text(spark):
    text = "word " * 30_000
    rows = T.chunks(spark.createDataFrame([(1, text), (2, " "), (3, "short")], "id long, text string"), ["id"]).where("id = 1").orderBy("chunk_index").collect()
    flat = " ".join(text.split())
    assert len(rows) > 80 and rows[0].chunk_text + rows[1].chunk_text[150:] == flat[:2250]
    assert rows[-1].chunk_text == flat[(len(rows) - 1) * 1050:]


def test_fusion_rewards_agreement(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "k string, order_score double")
    b = spark.createDataFrame([("y", 0.9), ("z", 0.8)], "k string, order_score double")
    got = [(r.k, r.n_lists) for r in V.fuse([a, b], "k", 10).collect()]
    assert got == [("y", 2), ("x", 1), ("z", 1)]


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 1 / math.sqrt(2)) < 1e-12 and got[1:] == [0.0, 0.0]


def test_locator_last_key_wins_and_bare_parts(spark):
    df = spark.createDataFrame([("sheet:A | sheet:B | cell:zz12 | page:4 | Table 2 costs | fy:2024-25",), ("csv:row:951",), (None,)], "locator string")
    a, b, c = EV.parse_locator(df).collect()
    assert (a.sheet_name, a.cell, a.page_number, a.financial_year_label, a.text_anchor) == ("B", "ZZ12", 4, "2024-25", "Table 2 costs")
    assert b.row_number == 951 and c.sheet_name is None


def test_contains_match_equals_brute_force(spark):
    labels = ["support for older australians", "support for older australian people", "aged care quality program", "short", "care quality programs extra"]
    leaves = ["support for older australians", "older australian people", "aged care quality programs", "care quality program"]
    got = set()
    ldf, ndf = spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in leaves], "leaf string")
    for a, b, s, g in ((ldf, ndf, "label", "leaf"), (ndf, ldf, "leaf", "label")):
        got |= {(r.label, r.leaf) for r in matching._contained(a, b, s, g).collect()}
    want = {(x, y) for x in labels for y in leaves if min(len(x), len(y)) >= 16 and (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.72}
    assert got == want and want


def test_duplicate_edges_with_null_years(spark):
    e = spark.createDataFrame([("a", "b", "same_group", None, None)] * 2 + [("a", "b", "same_group", "2024-25", None)], "parent_id string, child_id string, edge_kind string, financial_year string, crosswalk_id string")
    assert [r.n for r in I.duplicate_edges(e).collect()] == [2]


def test_reviewed_duplicate_with_changed_key_stays_open(spark):
    s = "source_key string, node_path string, financial_year string, measure_type string, estimate_status string, amount_aud double"
    g = spark.createDataFrame([("s", "n", "2024-25", "m", "actual", 5.0), ("s", "n", "2023-24", "m", "actual", 5.0)], s)
    reg = spark.createDataFrame([("s", "n", "2024-25", "m", "actual", 5.0, "ok")], s + ", reason string")
    assert {(r.financial_year, r.review) for r in I.partition_reviewed(g, reg).collect()} == {("2024-25", "reviewed"), ("2023-24", "unresolved")}


def test_folder_with_edges_is_no_orphan(spark):
    nodes = spark.createDataFrame([("folder",), ("leaf",), ("gone",)], "node_id string")
    bridge = spark.createDataFrame([("leaf",)], "node_id string")
    edges = spark.createDataFrame([("folder", "leaf")], "parent_id string, child_id string")
    assert [r.node_id for r in I.orphan_nodes(nodes, bridge, edges).collect()] == ["gone"]


def test_stale_nodes_and_their_edges(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id string")
    edges = spark.createDataFrame([("p", "a"), ("p", "b")], "parent_id string, child_id string")
    gone, touched = H.stale_nodes(ids("a", "b"), ids("b"), ids("b"), edges)
    assert [r.node_id for r in gone.collect()] == ["a"] and [(r.parent_id, r.child_id) for r in touched.collect()] == [("p", "a")]


def test_value_rank_order(spark):
    df = spark.createDataFrame([("federal_pbs_x",), ("aofm_y",), ("zzz",)], "s string").select("s", CO.value_rank(F.col("s")).alias("r"))
    assert {r.s: r.r.rank for r in df.collect()} == {"federal_pbs_x": 10, "aofm_y": 30, "zzz": 90}


def postings_of(index):
    return sorted((r.term, r.id, r.tf, r.dl) for r in index.postings.collect()), [tuple(r) for r in index.corpus.collect()]


def test_a_refresh_touches_only_what_changed(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path / "index"), "id long, text string"
    rows = {1: "aged care payment", 2: "road works and care", 3: None, 4: "Health health"}
    make = lambda: spark.createDataFrame(list(rows.items()), schema)
    first = X.refresh(make(), "id", F.col("text"), folder)
    assert first.version == 1 and postings_of(first)[1] == [(4, 9 / 4)]
    rows |= {2: "rail works", 5: "new care"}
    del rows[4]
    second = X.refresh(make(), "id", F.col("text"), folder)
    assert {r.id for r in spark.read.parquet(f"{folder}/postings/g=2").collect()} == {2, 5}
    fresh = X.refresh(make(), "id", F.col("text"), str(tmp_path / "other"))
    assert postings_of(second) == postings_of(fresh) == postings_of(X.open_index(spark, folder, "id"))
    assert [r.id for r in T.bm25(second, "id", "care", 10).collect()] == [5, 1]
    same = X.refresh(make(), "id", F.col("text"), folder)
    assert same.version == 3 and spark.read.parquet(f"{folder}/postings/g=3").count() == 0 and postings_of(same) == postings_of(fresh)
    monkeypatch.setattr(X, "GENERATIONS", 2)
    rows[1] = "merged at last"
    merged = X.refresh(make(), "id", F.col("text"), folder)
    assert merged.version == 5 and X._latest(spark, folder)["generations"] == [5]
    assert postings_of(merged) == postings_of(X.refresh(make(), "id", F.col("text"), str(tmp_path / "again")))


def test_what_a_task_sorts_does_not_grow_with_the_corpus(spark, tmp_path):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.hex(F.xxhash64("id", i))))
    df = spark.range(0, 10_000, 1, 1).withColumn("text", words)  # 2 million postings, all different, from one task
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    index = X.refresh(df, "id", F.col("text"), str(tmp_path / "index"))
    per_file = [r["count"] for r in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 2_000_000 and max(per_file) < 1_200_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_kept_index_reads_texts_only_when_files_change(spark, tmp_path):
    import uuid

    table, name, calls = str(tmp_path / "t.parquet"), f"test-{uuid.uuid4().hex}", []
    spark.createDataFrame([(1, "aged care")], "id long, text string").write.parquet(table)

    def docs():
        calls.append(1)
        return spark.read.parquet(table)

    for _ in range(2):
        index = X.kept_index(spark, name, "id", docs, F.col("text"), [table])
    assert len(calls) == 1 and index.version == 1
    spark.createDataFrame([(2, "road care")], "id long, text string").write.mode("append").parquet(table)
    index = X.kept_index(spark, name, "id", docs, F.col("text"), [table])
    assert len(calls) == 2 and index.version == 2 and {r.id for r in T.bm25(index, "id", "care", 10).collect()} == {1, 2}


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_lists_give_what_a_scan_gives(spark, tmp_path, spread):
    """Clustered and unclustered vectors; odd rows have no angle and score 0."""
    import random

    from factline.search import vectors as V

    rnd = random.Random(5)
    hubs = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + spread * rnd.gauss(0, 1) for x in hubs[i % 12]]) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(5)] + [(700, None), (701, []), (702, [0.0] * 6), (703, [1.0, 2.0]), (705, [None, *[1.0] * 5])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    lists = V.store_lists(df, "id", str(tmp_path / "lists"))
    assert lists.vectors.count() == len(rows)
    shares = []
    for i in range(0, 600, 100):
        q = df.where(F.col("id") == i).first()["embedding"]
        column = F.array(*[F.lit(float(x)) for x in q])
        for limit, threshold in ((7, 0.28), (60, -1.0), (700, 0.0)):
            got, share = V.rank_by_lists(lists, "id", q, limit, threshold)
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in V.rank_by_vector(df, "id", column, limit, threshold).collect()]
            if limit == 7:
                shares.append(share)
    assert spread == 1.0 or max(shares) < 0.5
    odd, share = V.rank_by_lists(lists, "id", [1.0, 2.0], 1, 0.5)
    assert [r.id for r in odd.collect()] == [703] and share == 1.0


def test_deep_pages_are_the_pages_of_the_whole_order(spark, monkeypatch):
    import random

    from factline.search import facts as SF

    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, 1.0, 2.0, 5.5]), rnd.choice(["2020-21", "2021-22", None]), rnd.choice(["a", "B", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "fact_id long, amount_aud double, financial_year string, node_name string").repartition(7)
    for order in ("amount_desc", "amount_asc", "year"):
        whole = [r.fact_id for r in SF.ordered(df, order).collect()]
        monkeypatch.setattr(SF, "SHALLOW", 20)
        for limit, offset in ((10, 0), (10, 200), (300, 150), (10, 495), (5, 500), (5, 9000)):
            got = SF.page(df, order, limit, offset)
            assert got.columns == [*df.columns, "total"]
            found = got.collect()
            assert [r.fact_id for r in found] == whole[offset : offset + limit] and {r.total for r in found} <= {500}
