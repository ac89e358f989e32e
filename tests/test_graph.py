from pyspark.sql import functions as F

from factline.graph import descent as D
from factline.graph import edges as E
from factline.graph.facts import fact_or_fallback

FS = "fact_id long, node_id string, financial_year string, source_key string, compatibility_group string, estimate_status string, amount_aud double"
ES = "parent_id string, child_id string, edge_kind string, crosswalk_id string, financial_year string, priority int, notes string"


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FS)


def chosen(spark, f, year=2024):
    f = f.withColumn("start", F.substring("financial_year", 1, 4).cast("int"))
    return {r.node_id: r for r in fact_or_fallback(f, "node_id", "start", "source_key", target=year).collect()}


def test_exact_year_wins(spark):
    f = facts(spark, (1, "n", "2024-25", "s", "actual_expense", "actual", 5.0), (2, "n", "2024-25", "s", "budget_expense", "budget", 6.0), (3, "n", "2023-24", "s", "x", "y", 1.0))
    r = chosen(spark, f)["n"]
    assert (r.fact_id, r.is_year_fallback, r.fallback_reason) == (2, False, "exact_year_match")


def test_only_earlier_years_stand_in(spark):
    f = facts(spark, (1, "late", "2026-27", "s", "g", "a", 1.0), (2, "n", "2021-22", "s", "g", "a", 1.0), (3, "n", "2022-23", "t", "g", "a", 2.0))
    got = chosen(spark, f)
    assert "late" not in got
    assert (got["n"].fact_id, got["n"].fallback_reason) == (3, "nearest_earlier_year_other_edition")


def test_corroborated_edition_breaks_ties(spark):
    f = facts(spark, (1, "n", "2022-23", "lone", "budget_expense", "a", 1.0), (2, "n", "2022-23", "twice", "g", "a", 1.0), (3, "n", "2020-21", "twice", "g", "a", 1.0))
    r = chosen(spark, f)["n"]
    assert (r.fact_id, r.fallback_reason) == (2, "nearest_earlier_year_same_edition")


def graph(spark):
    nodes = spark.createDataFrame([(i, "s", n) for i, n in (("p", "P"), ("a", "A"), ("b", "A / B"), ("c", "A / C"))], "node_id string, source_key string, name string")
    edges = spark.createDataFrame(
        [("p", "a", "related_breakdown", "x", None, 50, "P→A|exact"), ("a", "b", "same_group", None, None, 100, "n"), ("a", "b", "same_group", None, None, 90, "n"), ("b", "c", "same_group", None, None, 10, "n")], ES
    )
    f = facts(spark, (1, "a", "2024-25", "s", "g", "a", 9.0), (2, "b", "2024-25", "s", "g", "a", 5.0), (3, "c", "2022-23", "s", "g", "a", 4.0))
    return nodes, edges, f


def test_descent_stops_without_fact_and_dedupes_edges(spark):
    nodes, edges, f = graph(spark)
    got = D.same_group_tree(nodes.where("node_id = 'a'"), nodes, edges, f, "2024-25").collect()
    assert [(r.node_id, r.depth, r.label) for r in got] == [("b", 1, "B")]


def test_cycles_end_at_a_node_on_its_own_path(spark):
    nodes, _, f = graph(spark)
    loop = spark.createDataFrame([("a", "b", "same_group", None, None, 1, "n"), ("b", "a", "same_group", None, None, 1, "n")], ES)
    got = D.same_group_tree(nodes.where("node_id = 'a'"), nodes, loop, f, "2024-25").collect()
    assert [(r.node_id, r.depth) for r in got] == [("b", 1)]


def test_mismatch_year_bubbles_up(spark):
    nodes, edges, f = graph(spark)
    t = D.related_tree(nodes.where("node_id = 'p'"), nodes, edges, f, "2024-25")
    got = {r.node_id: r for r in D.tag_non_additive(t, "2024-25").collect()}
    assert got["c"].disclosed_financial_year == "2022-23" and got["c"].is_year_fallback
    for n in ("a", "b"):
        assert got[n].disclosed_financial_year == "2022-23" and got[n].disclosed_reason == "nested_child_year_mismatch" and got[n].disclosed_fallback
    assert all(r.kind == "related_breakdown" for r in got.values()) and got["a"].match_quality == "exact"


def test_path_edges_create_parents_once(spark):
    nodes = spark.createDataFrame([("1", "s", "A / B / C"), ("2", "s", "A")], "node_id string, source_key string, name string")
    made, edges = E.path_edges(nodes)
    assert {r.name for r in made.collect()} == {"A / B"}
    assert {(r.parent_id, r.child_id) for r in edges.collect()} == {("s|A", "s|A / B"), ("s|A / B", "s|A / B / C")}
    assert E.only_new(edges, edges).count() == 0


def test_crosswalk_prefers_subfunctions_then_components_then_total(spark):
    rows = [("abs_gfs_x", "Health"), ("abs_gfs_x", "Total education"), ("abs_gfs_x", "Defence"), ("fn", "Health / Hospitals"), ("fn", "Health"), ("co", "Education / Schools"), ("fn", "Education"), ("fn", "Defence")]
    nodes = spark.createDataFrame([(f"{s}|{n}", s, n) for s, n in rows], "node_id string, source_key string, name string")
    cw = spark.createDataFrame([(p, p, "exact") for p in ("Health", "Education", "Defence")], "purpose string, function string, quality string")
    got = {(r.parent_id, r.child_id) for r in E.crosswalk_edges(nodes, cw, "abs_gfs_", "fn", "co", "x").collect()}
    assert got == {("abs_gfs_x|Health", "fn|Health / Hospitals"), ("abs_gfs_x|Total education", "co|Education / Schools"), ("abs_gfs_x|Defence", "fn|Defence")}


def test_children_hang_under_longest_ancestor_of_best_source(spark):
    rows = [("g", "A / B / C / D"), ("g", "A / B / C"), ("p1", "a"), ("p2", "A / B"), ("p1", "A / b")]
    nodes = spark.createDataFrame([(f"{s}|{n}", s, n) for s, n in rows], "node_id string, source_key string, name string")
    got = {(r.parent_id, r.child_id) for r in E.children_under_cascade(nodes, "g", ["p1", "p2"], "x").collect()}
    assert got == {("p1|A / b", "g|A / B / C")}


def test_ways_of_a_ladder_of_diamonds_are_one_row_a_length(spark):
    """30 diamonds one after the other have 2 ** 30 paths from top to bottom, all of 60 hops."""
    from factline.graph import descent as D

    edges = [e for i in range(30) for e in ((f"t{i}", f"l{i}"), (f"t{i}", f"r{i}"), (f"l{i}", f"t{i + 1}"), (f"r{i}", f"t{i + 1}"))]
    df = spark.createDataFrame(edges, "parent_id string, child_id string")
    root = spark.createDataFrame([("t0",), ("t29",)], "node_id string")
    amounts = spark.createDataFrame([("t30", 2.0), ("t30", 3.0)], "node_id string, amount_aud double")
    got = {(r.root_id, r.node_id): (r.depth, r.amount_aud) for r in D.roll_up_hierarchy(root, df, amounts).collect()}
    assert len(got) == 91 + 4 and got[("t0", "t30")] == (60, 5.0) and got[("t29", "t30")] == (2, 5.0) and got[("t0", "t0")] == (0, 0.0)


def test_ancestry_equals_a_walk(spark):
    import random

    from factline.graph import descent as D

    rnd = random.Random(1)
    edges = sorted({(a, b) for a, b in ((rnd.randrange(25), rnd.randrange(25)) for _ in range(45)) if a < b})
    rows, deepest, cycle = D.ancestry(spark.createDataFrame(edges, "parent_id int, child_id int"))
    want, level = set(), {(a, b, 1) for a, b in edges}
    while level:
        want |= level
        level = {(a, c, h + 1) for a, b, h in level for x, c in edges if x == b}
    assert {(r.ancestor, r.node, r.hops) for r in rows.collect()} == want and rows.count() == len(want)
    assert deepest == max(h for _, _, h in want) and not cycle
    assert D.ancestry(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent_id int, child_id int"))[2]
    assert D.ancestry(spark.createDataFrame([], "parent_id int, child_id int"))[1:] == (0, False)
