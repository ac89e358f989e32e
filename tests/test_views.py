import pytest
from pyspark.sql import functions as F

from factline.operators import guards as G
from factline.operators import tree as T
from factline.operators import views as V

S = "measure_type string, unit string, price_basis string, valuation_basis string, observation_date string"


def decide(spark, rows, family, **kw):
    return G.compatibility(spark.createDataFrame(rows, S), family, **kw).collect()[0]


def test_units_never_mix(spark):
    d = decide(spark, [("gdp_current", "AUD", "current_prices", None, None), ("tax_to_gdp_ratio", "percent", "not_applicable", None, None)], "gdp_current")
    assert not d.allowed and any("percent and AUD" in e for e in d.errors)


def test_price_bases_never_mix(spark):
    d = decide(spark, [("gdp_current", "AUD", "current_prices", None, None), ("gdp_current", "AUD", "chain_volume", None, None)], "gdp_current")
    assert not d.allowed


def test_ratios_stand_alone(spark):
    d = decide(spark, [("tax_to_gdp_ratio", "percent", "not_applicable", None, None)], "ratios")
    assert d.allowed and not d.root_total_allowed and not d.additive_across_nodes


def test_mixed_valuation_only_compares(spark):
    rows = [("debt", "AUD", "unspecified", "face_value", None), ("debt", "AUD", "unspecified", "fair_value", None)]
    d = decide(spark, rows, "debt_stock", valuation_filter="all")
    assert d.allowed and d.mixed_valuation and not d.root_total_allowed
    assert decide(spark, rows[:1], "debt_stock").root_total_allowed


def test_argument_guards():
    with pytest.raises(ValueError, match="estimate_status"):
        G.require_triple("g", "b", None)
    G.require_triple(None, None, None, view="reconciliation")
    with pytest.raises(ValueError, match="stock"):
        G.require_comparable({"a": "stock", "b": "flow"}, ["a", "b"])
    assert G.require_comparable({"a": "balance", "b": "flow"}, ["a", "b"])
    with pytest.raises(ValueError):
        G.require_comparable({}, ["a"])


def test_parent_with_children_loses_its_amount(spark):
    rows = spark.createDataFrame([(["J", "A"], 100.0, 1), (["J", "A", "x"], 30.0, 2), (["J", "A", "y"], 20.0, 3), (["J", "Total"], 999.0, 4)], "path array<string>, amount_aud double, fact_id long")
    got = {"/".join(r.path): (r.value, r.fact_id) for r in T.tree(rows, []).collect()}
    assert got == {"J": (50.0, None), "J/A": (50.0, None), "J/A/x": (30.0, 2), "J/A/y": (20.0, 3)}


def test_lone_total_stays(spark):
    rows = spark.createDataFrame([(["J", "Total income"], 9.0, 1)], "path array<string>, amount_aud double, fact_id long")
    assert {"/".join(r.path) for r in T.tree(rows, []).collect()} == {"J", "J/Total income"}


def test_preserved_nodes_stop_the_climb(spark):
    own = spark.createDataFrame(
        [(["J", "A"], 100.0, True), (["J", "A", "x"], 30.0, False), (["J", "B"], 5.0, False)], "path array<string>, own double, preserve boolean"
    )
    got = {"/".join(r.path): r.value for r in T.preserved_roll_up(own, []).collect()}
    assert got == {"J": 105.0, "J/A": 100.0, "J/A/x": 30.0, "J/B": 5.0}


def test_named_total_counts_once(spark):
    leaf = spark.createDataFrame([(["J", "Health", "health"], 3.0, 1), (["K", "Other"], 4.0, 2)], "path array<string>, own double, fact_id long")
    assert T.named_total(leaf, [], "HEALTH").collect()[0].value == 3.0


def test_fold_needs_more_than_one_extra(spark):
    df = spark.createDataFrame([("k", f"i{i}", float(10 - i)) for i in range(4)], "k string, i string, v double")
    assert T.fold_top(df, ["k"], "i", "v", 3).count() == 4
    folded = {r.i: r.v for r in T.fold_top(df, ["k"], "i", "v", 2).collect()}
    assert folded == {"i0": 10.0, "i1": 9.0, "Other (2)": 15.0}


def test_gdp_paths(spark):
    names = ["Expenditure on GDP / Final consumption", "GDP current prices", "Real GDP", "Total GDP", "NSW / GSP total", "Tax as % of GDP", "Plain"]
    got = {r.n: r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", V.gdp_path(F.col("n")).alias("p")).collect()}
    assert got["Expenditure on GDP / Final consumption"][0] == "GDP (current prices)"
    assert got["GDP current prices"][0] == "GDP (current prices)" and got["Real GDP"][0] == "GDP (chain volume)"
    assert got["Total GDP"] is None and got["NSW / GSP total"][0] == "GSP (current prices)"
    assert got["Tax as % of GDP"][0] == "Derived ratios" and got["Plain"] == ["Plain"]


def test_ancestor_paths_stop_at_cycles():
    assert V.ancestor_paths({"a": "b", "b": "c", "c": "a"})["a"] == ["b", "c", "a"][::1] or V.ancestor_paths({"a": "b", "b": "c", "c": "a"})["a"] == ["c", "b", "a"]


def test_same_name_chain(spark):
    nodes = spark.createDataFrame([(["D"], 9.0, None), (["D", "D"], 8.0, 1), (["D", "D", "x"], 7.0, 2)], "path array<string>, value double, fact_id long")
    got = {"/".join(r.path): (r.value, r.fact_id) for r in T.collapse_repeats(nodes, []).collect()}
    assert got == {"D": (9.0, 1), "D/x": (7.0, 2)}


TREE = "level string, year string, path array<string>, amount_aud double, fact_id long"


def nodes_of(rows, keys=("level", "year")):
    return {(r.level, r.year, tuple(r.path)): r.value for r in T.tree(rows, list(keys)).collect()}


def test_trees_with_null_keys_count_nothing_twice(spark):
    rows = spark.createDataFrame([(lv, y, p, a, i) for i, (lv, y, p, a) in enumerate([
        (None, "y", ["A"], 10.0), (None, "y", ["A", "b"], 4.0), ("", "y", ["A"], 7.0), ("l", None, ["A"], 1.0), ("l", None, ["A", "b"], 2.0), ("l", None, ["A", "c"], 3.0),
        (None, "y", ["T", "Total of it"], 9.0), (None, "y", ["T", "part"], 8.0), ("l", None, ["T", "Total alone"], 5.0),
    ])], TREE)
    assert nodes_of(rows) == {
        (None, "y", ("A",)): 4.0, (None, "y", ("A", "b")): 4.0, ("", "y", ("A",)): 7.0, ("l", None, ("A",)): 5.0, ("l", None, ("A", "b")): 2.0, ("l", None, ("A", "c")): 3.0,
        (None, "y", ("T",)): 8.0, (None, "y", ("T", "part")): 8.0, ("l", None, ("T",)): 5.0, ("l", None, ("T", "Total alone")): 5.0,
    }
    own = T.own_amounts(rows, ["level", "year"]).withColumn("preserve", F.col("own") == 10.0)
    kept = {(r.level, r.year, tuple(r.path)): r.value for r in T.preserved_roll_up(own, ["level", "year"]).collect()}
    assert kept[(None, "y", ("A",))] == 10.0 and kept[("l", None, ("A",))] == 5.0


def test_chains_collapse_and_tops_fold_under_null_keys(spark):
    rows = spark.createDataFrame([(None, "y", ["A", "A", "x"], 1.0, 1), (None, "y", ["A", "A", "z"], 2.0, 2)], TREE)
    nodes = T.collapse_repeats(T.tree(rows, ["level", "year"]), ["level", "year"])
    assert {tuple(r.path): r.value for r in nodes.collect()} == {("A",): 3.0, ("A", "x"): 1.0, ("A", "z"): 2.0}
    items = spark.createDataFrame([(None, f"i{k}", float(k)) for k in range(6)] + [("k", "one", 1.0)], "k string, item string, v double")
    folded = {(r.k, r.item): r.v for r in T.fold_top(items, ["k"], "item", "v", 2).collect()}
    assert folded == {(None, "i5"): 5.0, (None, "i4"): 4.0, (None, "Other (4)"): 6.0, ("k", "one"): 1.0}
