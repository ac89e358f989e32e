"""Ordered operators against plain Python, with places and blocks small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from factline.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for key, n in (("hot", 60), ("b", 7), ("c", 1)):
        for page in range(3):
            for line in sorted(rnd.sample(range(200), n // 3 + 1)):
                out.append((key, page, line, rnd.choice([None, None, f"v{line}"])))
    return out


def test_fill_forward_crosses_blocks_and_pages(spark, rows):
    df = spark.createDataFrame(rows, "k string, page int, line int, v string")
    got = {(r.k, r.page, r.line): r.v for r in O.fill_forward(df, ["k"], ["page", "line"], ["v"], places=9).collect()}
    last = {}
    for k, page, line, v in sorted(rows, key=lambda r: r[:3]):
        last[k] = v if v is not None else last.get(k)
        assert got[(k, page, line)] == last[k]
    assert len(got) == len(rows)


def test_dense_ordinal_counts_from_zero(spark, rows):
    df = spark.createDataFrame(rows, "k string, page int, line int, v string")
    got = {(r.k, r.page, r.line): r.ordinal for r in O.dense_ordinal(df, ["k"], ["page", "line"], places=9).collect()}
    seen = {}
    for k, page, line, _ in sorted(rows, key=lambda r: r[:3]):
        assert got[(k, page, line)] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_neighbours_look_over_block_borders(spark):
    n = 23
    df = spark.createDataFrame([("a", i, f"t{i}") for i in range(n)], "k string, ordinal long, t string")
    out = O.with_neighbours(df, ["k"], "ordinal", {"p3": ("t", -3), "n2": ("t", 2)}, size=4).collect()
    assert len(out) == n
    for r in out:
        assert r.p3 == (f"t{r.ordinal - 3}" if r.ordinal >= 3 else None)
        assert r.n2 == (f"t{r.ordinal + 2}" if r.ordinal + 2 < n else None)


@pytest.mark.parametrize("low,high", [(-5, 5), (1, 15), (0, 0)])
def test_within_distance_equals_brute_force(spark, low, high):
    rnd = random.Random(3)
    a = [("x", rnd.randrange(100)) for _ in range(30)] + [("y", 4)]
    b = [("x", rnd.randrange(100)) for _ in range(40)] + [("z", 4)]
    got = O.within_distance(spark.createDataFrame(a, "k string, p long"), spark.createDataFrame(b, "k string, q long"), ["k"], "p", "q", low, high)
    want = sorted((k, p, q) for k, p in a for k2, q in b if k == k2 and low <= q - p <= high)
    assert sorted((r.k, r.p, r.q) for r in got.collect()) == want


def test_first_and_top_per_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, n int, v string")
    first = {r.k: r.v for r in O.first_per_key(df, ["k"], [F.col("n")]).collect()}
    assert first == {"a": "y", "b": "z"}
    top = O.top_per_key(df, ["k"], [F.desc("n")], 1).collect()
    assert {(r.k, r.v) for r in top} == {("a", "x"), ("b", "z")}


def test_one_key_with_sparse_ordinals_is_spread(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("page"), (F.col("id") * 100_003).alias("line"), F.when(F.col("id") % 900 == 0, F.col("id")).alias("v"))
    placed = O.place(df, ["k"], ["page", "line"], places=8)
    sizes = [r["count"] for r in placed.groupBy(O.PLACE).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 4000 / 3
    got = {r.page: r.v for r in O.fill_forward(placed, ["k"], ["page", "line"], ["v"]).collect()}
    assert got == {i: i // 900 * 900 for i in range(4000)}
    assert [r.at for r in O.dense_ordinal(df, [], ["line"], "at", places=8).orderBy("line").collect()] == list(range(4000))


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), ("k", 1, None), ("k", 2, "b"), (None, 3, None)], "k string, line int, v string")
    for n in (1, 4):
        filled = O.fill_forward(df, ["k"], ["line"], ["v"], places=n).collect()
        assert sorted((str(r.k), r.line, r.v) for r in filled) == [("None", 1, "a"), ("None", 2, "a"), ("None", 3, "a"), ("k", 1, None), ("k", 2, "b")]
        counted = O.dense_ordinal(df, ["k"], ["line"], places=n).collect()
        assert sorted((str(r.k), r.line, r.ordinal) for r in counted) == [("None", 1, 0), ("None", 2, 1), ("None", 3, 2), ("k", 1, 0), ("k", 2, 1)]
    near = O.within_distance(df.select("k", F.col("line").alias("a")), df.select("k", F.col("line").alias("b")), ["k"], "a", "b", 1, 1)
    assert sorted((str(r.k), r.a, r.b) for r in near.collect()) == [("None", 1, 2), ("None", 2, 3), ("k", 1, 2)]


@pytest.mark.parametrize("places", [1, 3, 17])
def test_switch_scan_equals_a_walk(spark, places):
    rnd = random.Random(places)
    moves = ["on", "off", "flip", "flip", "flip", None]
    rows = [(key, i, rnd.choice(moves if key != "flips" else ["flip", None])) for key, n in (("hot", 300), ("b", 9), (None, 20), ("flips", 60)) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, line int, m string")
    ends = lambda on: (F.col("m") == "off") | ((F.col("m") == "flip") & on)
    out = O.switch_scan(df, ["k"], ["line"], F.col("m"), lambda on: F.coalesce(ends(on), F.lit(False)), places=places)
    got = {(r.k, r.line): (r.before, r.group, r.ordinal) for r in out.collect()}
    assert len(got) == len(rows)
    state = {}
    for k, line, move in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        on, group, n = state.get(k, (False, 0, 0))
        assert got[(k, line)] == (on, group, n)
        end = move == "off" or (move == "flip" and on)
        state[k] = ({"on": True, "off": False, "flip": not on, None: on}[move], group + end, n + 1)
