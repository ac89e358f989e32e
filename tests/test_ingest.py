from factline.operators import gates, loading
from factline.sources import mapping as M
from factline.sources import readers
from factline.sources.store import merge_facts, write_quarantine

MAPPING = {
    "source_id": "demo", "measure_type": "expense", "accounting_basis": "accrual", "estimate_status": "actual", "period_granularity": "financial_year",
    "input": {"path": "files/demo.csv", "format": "csv"},
    "columns": {"financial_year": "fy", "amount_aud": "amount", "node_name": "category", "locator": "locator", "landing_url": "landing_url", "original_resource_url": "resource_url"},
    "attribution": {"landing_url_column": "landing_url", "original_resource_url_column": "resource_url", "cached_copy_path": "files/demo.csv"},
}


def test_csv_to_published_and_quarantined(spark, tmp_path):
    src = tmp_path / "demo.csv"
    src.write_text(
        "fy,amount,category,locator,landing_url,resource_url\n2023-24,10.5,Health,sheet:Demo!B2,https://a,https://r\n"
        "2023-24,20,Education,sheet:Demo!B3,,https://r\n2024-25,30,Defence,sheet:Demo!B4,https://a,https://r\n"
    )
    raw = readers.read_register(spark, str(src), "csv")
    manifest = spark.createDataFrame([("files/demo.csv", "ab" * 32, "2026-01-01")], "path string, sha256 string, retrieved_at string")
    rows = M.extract(raw, MAPPING, manifest)
    decided = gates.decide(rows, MAPPING).cache()
    good, bad = gates.published(decided), gates.quarantined(decided)
    assert good.count() == 2
    row = bad.collect()[0]
    assert row.quarantine_reason == "Gate 6 attribution: incomplete citation: ['landing_url']"
    assert {r.fact_key for r in good.collect()} == {"demo|2023-24|Health|expense|actual", "demo|2024-25|Defence|expense|actual"}
    facts = str(tmp_path / "facts")
    for _ in range(2):
        merge_facts(spark, facts, good)
    assert spark.read.parquet(facts).count() == 2
    for _ in range(2):
        write_quarantine(bad, str(tmp_path / "quarantine"), "one")
    assert spark.read.json(str(tmp_path / "quarantine")).count() == 1


def test_merge_leaves_other_partitions_alone(spark, tmp_path):
    folder = str(tmp_path / "facts")
    s = "fact_key string, financial_year string, amount_aud double"
    merge_facts(spark, folder, spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], s))
    kept = sorted(f.name for f in (tmp_path / "facts" / "financial_year=y").glob("*.parquet"))
    merge_facts(spark, folder, spark.createDataFrame([("a", "x", 5.0), ("c", "x", 3.0)], s))
    assert sorted(f.name for f in (tmp_path / "facts" / "financial_year=y").glob("*.parquet")) == kept
    assert {tuple(r) for r in spark.read.parquet(folder).select("fact_key", "amount_aud").collect()} == {("a", 5.0), ("b", 2.0), ("c", 3.0)}


def test_hard_gates_come_first(spark):
    df = spark.createDataFrame([("24-25", None, " ", None)], "financial_year string, amount_aud double, node_name string, locator string")
    reason = gates.decide(df, {"measure_type": "m", "accounting_basis": "a"}).collect()[0].quarantine_reason
    assert reason.startswith("Gate 2 types: amount_aud is null; Gate 3 period: bad financial_year: '24-25'; Gate 4 node")
    assert "Gate 5 measure: mapping missing estimate_status" in reason and "Gate 6" in reason


def test_mapping_inheritance():
    base = {"input": {"format": "csv", "path": "a"}, "columns": {"x": "X"}, "title": "base"}
    got = M.inherit({"extends": "base", "input": {"path": "b"}, "title": "child"}, base)
    assert got == {"input": {"format": "csv", "path": "b"}, "columns": {"x": "X"}, "title": "child"}


def test_upsert_keeps_semantic_columns(spark):
    s = "fact_key string, amount_aud double, locator string, valuation_basis string"
    old = spark.createDataFrame([("a", 1.0, "l1", "face"), ("b", 2.0, "l2", None)], s)
    new = spark.createDataFrame([("a", 5.0, None, None), ("c", 3.0, "l3", "fair")], s)
    got = {r.fact_key: (r.amount_aud, r.locator, r.valuation_basis) for r in loading.upsert(old, new).collect()}
    assert got == {"a": (5.0, None, "face"), "b": (2.0, "l2", None), "c": (3.0, "l3", "fair")}


def test_revision_policy(spark):
    s = "fact_key string, amount_aud double, locator string"
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "x"), ("c", None, "x"), ("d", 1.0, "x")], s)
    new = spark.createDataFrame([("a", 1.005, "x"), ("b", 2.0, "x"), ("c", 1.0, "x"), ("d", 1.0, "y"), ("e", 1.0, "x")], s)
    got = {r.fact_key: r.outcome for r in loading.revision_outcomes(new, old).collect()}
    assert got == {"a": "skip", "b": "conflict", "c": "conflict", "d": "citation_update", "e": "insert"}


def test_latest_manifest_or_listing(spark):
    man = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "source_id string, snapshot int, path string")
    disk = spark.createDataFrame([("a", "old"), ("b", "only")], "source_id string, path string")
    assert {(r.source_id, r.path) for r in readers.latest_or_glob(man, disk).collect()} == {("a", "new"), ("b", "only")}


def test_award_json_lines(spark, tmp_path):
    import gzip

    from factline.operators.registers import award_facts

    line = '{"ocid":"o1","date":"2024-01-01","awards":[{"id":"1","date":"2023-08-02T00:00:00Z","value":{"amount":5.0},"suppliers":[{"name":"S"}],"buyer":{"name":"B"}},{"id":"2","value":{"amount":7.0}}]}'
    with gzip.open(tmp_path / "r.json.gz", "wt") as fh:
        fh.write(line + "\n")
    got = {r.award_id: (r.supplier, r.amount_aud, r.financial_year) for r in award_facts(readers.read_awards(spark, str(tmp_path / "r.json.gz")), "1999-00").collect()}
    assert got == {"1": ("S", 5.0, "2023-24"), "2": ("Unknown supplier", 7.0, "1999-00")}


def test_table_counts_see_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    one = {r.table_name: r.checksum for r in readers.table_counts({"t": a}).collect()}
    two = {r.table_name: r.checksum for r in readers.table_counts({"t": a.orderBy("s", ascending=False)}).collect()}
    three = {r.table_name: r.checksum for r in readers.table_counts({"t": a.limit(1)}).collect()}
    assert one == two != three


def test_table_counts_see_values_that_move_beside_a_null(spark):
    sums = lambda rows: [(r.checksum, r.checksum_2) for r in readers.table_counts({"t": spark.createDataFrame(rows, "a string, b string")}).collect()][0]
    assert sums([("x", None)]) != sums([(None, "x")]) and sums([(None, None)]) != sums([("", None)])
    assert sums([("x", "y"), ("p", "q")]) == sums([("p", "q"), ("x", "y")]) != sums([("x", "q"), ("p", "y")])


def test_loads_keep_rows_without_a_partition_value(spark, tmp_path):
    from factline.sources import store

    s, folder = "fact_key string, amount_aud double, locator string, financial_year string", str(tmp_path / "facts")
    load = lambda *rows: store.merge_facts(spark, folder, spark.createDataFrame(rows, s))
    load(("a", 1.0, "x", None), ("b", 2.0, "x", "2020-21"))
    load(("c", 3.0, "x", None))
    load(("a", 5.0, "x", None), ("d", 4.0, "x", "2021-22"))
    assert {r.fact_key: (r.amount_aud, r.financial_year) for r in spark.read.parquet(folder).collect()} == {"a": (5.0, None), "b": (2.0, "2020-21"), "c": (3.0, None), "d": (4.0, "2021-22")}


def test_only_chosen_files_are_opened(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    rows = [(i, s, f"s{i % 4}") for i in range(40) for s in (1, 2) if s == 1 or i % 4 < 2]
    spark.createDataFrame(rows, "id int, snapshot int, source string").repartition(1).write.partitionBy("snapshot", "source").parquet(folder)
    files = readers.list_files(spark, folder)
    listed = files.selectExpr("regexp_extract(path, 'source=([^/]+)', 1) as source_id", "cast(regexp_extract(path, 'snapshot=([0-9]+)', 1) as int) as snapshot", "path")
    assert files.count() == 6
    chosen = readers.latest_or_glob(listed.where("source_id = 's0'"), listed.where("snapshot = 1"))
    got = readers.read_chosen(spark, folder, chosen, "parquet")
    named = {r.path.removeprefix("file:").lstrip("/") for r in chosen.collect()}
    assert {p.removeprefix("file:").lstrip("/") for p in got.inputFiles()} == named and len(named) == 4
    assert sorted(r.id for r in got.collect()) == list(range(40)) and {(r.source, r.snapshot) for r in got.collect()} == {("s0", 2), ("s1", 1), ("s2", 1), ("s3", 1)}
    assert readers.read_chosen(spark, folder, chosen.limit(0), "parquet", "id int").collect() == []
    (tmp_path / "corpus" / "snapshot=2" / "source=s1" / "broken.parquet").write_bytes(b"not a table")  # an older one that nothing chooses may be broken
    assert readers.read_chosen(spark, folder, chosen, "parquet").count() == 40
