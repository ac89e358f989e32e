"""What used to be cut, and cases that were wrong, on small literal rows."""

import pytest
from pyspark.sql import functions as F

from factline.functions import amounts as A
from factline.functions import labels as L
from factline.graph import descent as G
from factline.operators import discovery as D
from factline.operators import loading
from factline.operators import registers as R
from factline.operators import textlines as T
from factline.operators import tree as TR
from factline.operators import views as V
from factline.quality import coverage as CO
from factline.sources import mapping as M


def chain(spark, n, cycle=False):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(n)] + ([(f"n{n}", "n0")] if cycle else [])
    return spark.createDataFrame(edges, "parent_id string, child_id string")


@pytest.mark.parametrize("cycle", [False, True])
def test_hierarchies_have_no_depth_limit(spark, cycle):
    root = spark.createDataFrame([("n0",)], "node_id string")
    amounts = spark.createDataFrame([("n14", 5.0)], "node_id string, amount_aud double")
    got = {r.node_id: (r.depth, r.amount_aud) for r in G.roll_up_hierarchy(root, chain(spark, 14, cycle), amounts).collect()}
    assert len(got) == 15 and got["n14"] == (14, 5.0)
    with pytest.raises(ValueError):
        G.roll_up_hierarchy(root, chain(spark, 14), amounts, max_depth=9)


def test_descent_ends_at_cycles_and_not_before(spark):
    edges = chain(spark, 12, cycle=True).select("parent_id", "child_id", F.col("child_id").alias("child_name"), F.lit("s").alias("child_source"), F.lit(1).alias("priority"), F.lit("").alias("notes"))
    nodes = spark.createDataFrame([(f"n{i}", f"name{i}") for i in range(13)], "node_id string, name string")
    facts = nodes.select("node_id", F.lit(1.0).alias("amount_aud"))
    tree = G.descend(G.as_roots(nodes.where("node_id = 'n0'")), edges, facts)
    assert sorted(r.depth for r in tree.collect()) == list(range(1, 13))


def test_numbers_are_repaired_until_nothing_joins(spark):
    text = "total 1,2 34,5 67,8 90,1 23,4 56 and 2, 374 plain 12 34"
    out = spark.createDataFrame([(text,), ("no numbers here",), (None,)], "t string").select(A.repair_thousands(F.col("t"))).collect()
    assert out[0][0] == "total 1,234,567,890,123,456 and 2,374 plain 12 34" and out[1][0] == "no numbers here" and out[2][0] is None


def test_two_digit_years(spark):
    cases = {"01/02/85": "1985-02-01", "1.2.68": "2068-02-01", "1-2-69": "1969-02-01", "17-Jul-26": "2026-07-17", "17 Jul 85": "2085-07-17", "2024-3-1": "2024-03-01", "x": None, "32/1/99": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", A.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


def test_names_are_never_cut(spark):
    long = "word " * 400
    df = spark.createDataFrame([(long + "a", "2023-24"), (long + "b", "2024-25")], "name string, fy string")
    assert loading.seed_entities(df, "name", "fy").count() == 2
    assert df.select(L.clean_label(F.col("name"))).distinct().count() == 2


def test_paths_climb_to_the_top():
    parents = {f"p{i}": f"p{i + 1}" for i in range(12)}
    assert V.ancestor_paths(parents)["p0"] == [f"p{i}" for i in range(12, -1, -1)]


def test_remap_gives_reasons(spark):
    df = spark.createDataFrame([("health a", "y", 2e5), ("health b", "y", 1.0), ("health c", "z", 2e5), ("noise health", "y", 2e5), ("else", "y", 2e5)], "label string, financial_year string, amount_aud double")
    got = {r.label: (r.function, r.reason) for r in R.remap_portfolio(df, [("health", "Health")], [], "noise", ["y"]).collect()}
    assert got["health a"] == ("Health", None) and got["else"] == (None, "no_function")
    assert [got[k][1] for k in ("health b", "health c", "noise health")] == ["amount_out_of_bounds", "other_year", "noise_label"]


def test_wide_sheets_are_inventoried_whole(spark):
    cells = spark.createDataFrame([("w", "s", 0, c, "v" * 300) for c in range(60)], "source_id string, sheet string, row_no int, col_no int, value string")
    row = CO.workbook_inventory(cells, spark.createDataFrame([("w",), ("gone",)], "source_id string")).orderBy("source_id").collect()
    assert row[0].error == "file_missing_on_disk" and row[1].n_cols == 60 and row[1].title_row == " | ".join(["v" * 300] * 60)


def test_stems_of_any_length_meet_their_keys(spark):
    rows = spark.createDataFrame([("ab_facts", "FETCH", True, True), ("a_rather_long_stem_facts", "FETCH", True, False), ("none", "MANUAL", False, False)], "source_id string, action string, present boolean, on_disk boolean")
    counts = spark.createDataFrame([("xab", 2), ("abab", 3), ("the_a_rather_long_stem_2024", 7)], "source_key string, n long")
    assert {r.source_id: r.n_facts for r in CO.handoff_status(rows, counts).collect()} == {"ab_facts": 5, "a_rather_long_stem_facts": 7, "none": 0}


def test_sections_of_a_file(spark):
    text = "x,y\n1,2\n\n#bonds\nname,v\na,1\nas_at_note,30 June\n#notes\nn\nb\n#bonds\nname,v\nc,3"
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"))] + [("g", 0, "h"), ("g", 1, "only")], "file string, line_no int, text string")
    out = T.split_sections(lines, ["file"], r"^#(.*)$").orderBy("file", "line_no").collect()
    assert [(r.file, r.section, r.text, r.is_header) for r in out] == [
        ("f", "table", "x,y", True), ("f", "table", "1,2", False), ("f", "bonds", "name,v", True), ("f", "bonds", "a,1", False),
        ("f", "notes", "n", True), ("f", "notes", "b", False), ("f", "bonds", "name,v", True), ("f", "bonds", "c,3", False), ("g", "table", "h", True), ("g", "table", "only", False),
    ]


def test_a_path_retrieved_twice_gives_one_row(spark):
    rows = spark.createDataFrame([("p", "x"), ("q", "y")], "file string, v string")
    files = spark.createDataFrame([("p", "ff", "2024"), ("p", "aa", "2025"), ("home", "hh", "2023"), ("home", "gg", "2024")], "path string, sha256 string, retrieved_at string")
    out = M.attribute(rows, {"attribution": {"cached_copy_path_column": "file", "cached_copy_path": "home"}}, files)
    assert {r.v: (r.cached_copy_path, r.sha256) for r in out.collect()} == {"x": ("p", "aa"), "y": ("home", "gg")} and out.count() == 2


def test_links_as_pages_write_them(spark):
    html = (
        "<a class=b href=x/../d/./f.csv?a=1&amp;b=2#t><b>Big &lt;data&gt;</b>\n table</a><a href='//h.example.com/z'>z<a href=\"?q=1\">q</a>"
        "<a href=\"../../up\">up</a><link rel=x href=\"/s.css\"><a name=n>none</a><div data-url='/get?filename=r.XLSX'></div><a href='mailto:a@b'>m</a>"
    )
    pages = spark.createDataFrame([(1, "https://site.example.com/a/b/page.html?x", html)], "id long, url string, html string")
    got = {r.url: r.text for r in D.link_candidates(pages, "id", "url", "html").collect()}
    assert got == {
        "https://site.example.com/a/b/d/f.csv?a=1&b=2": "Big <data> table", "https://h.example.com/z": "z", "https://site.example.com/a/b/page.html?q=1": "q",
        "https://site.example.com/up": "up", "https://site.example.com/s.css": "", "https://site.example.com/get?filename=r.XLSX": "",
    }
    suffix = spark.createDataFrame([(u,) for u in got], "u string").select("u", D.url_suffix(F.col("u")).alias("s")).collect()
    assert sorted(r.s for r in suffix) == ["", "", ".css", ".csv", ".html", ".xlsx"]


def test_new_ids_must_not_clash(spark):
    have = spark.createDataFrame([("old", 5)], "k string, id long")
    wanted = spark.createDataFrame([("a", "z"), ("a", "b")], "k string, v string")
    assert {(r.k, r.v) for r in loading.get_or_create(have, wanted, "k", "id").collect()} == {("old", None), ("a", "b")}
    clash = have.withColumn("id", loading.surrogate(F.lit("a")))
    with pytest.raises(ValueError):
        loading.get_or_create(clash, wanted, "k", "id")


def test_drilling_prefers_the_fact(spark):
    nodes = spark.createDataFrame([("k", 1, ["A"], None, 5.0), ("k", 2, ["A", "health"], 7, 2.0), ("k", 3, ["A", "x", "Health care"], 8, 3.0)], "level string, depth int, path array<string>, fact_id long, value double")
    want = lambda f, n: spark.createDataFrame([("k", f, n)], "level string, want_fact long, want_name string")
    got = lambda f, n: [tuple(r) for r in TR.drill_path(nodes, ["level"], want(f, n)).collect()]
    assert got(7, "care") == [("k", "A / health", 2, True)]
    assert got(99, "health") == [("k", "A / x / Health care", 3, False)]
    assert got(None, None) == []


def test_a_lone_federal_jurisdiction_is_taken_off(spark):
    s = "level string, financial_year string, depth int, path array<string>, value double"
    rows = [("federal", "y", 1, ["C"], 3.0), ("federal", "y", 2, ["C", "h"], 3.0), ("state", "y", 1, ["S"], 4.0), ("federal", "z", 1, ["C"], 1.0), ("federal", "z", 1, ["D"], 1.0)]
    out = {(r.level, r.financial_year, *r.path): r.value for r in TR.side_by_side(spark.createDataFrame(rows, s)).collect()}
    assert out == {("federal", "y", "h"): 3.0, ("state", "y", "S"): 4.0, ("federal", "z", "C"): 1.0, ("federal", "z", "D"): 1.0}
