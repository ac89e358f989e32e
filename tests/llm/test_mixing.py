import math

import pytest

from factline.llm.mixing import MIX_SQL, mix, source_targets


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess until none is above."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * left / total >= most * sizes[s]}
        if not over:
            target |= {s: w[s] * left / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 0}, {"a": 7}, {"a": 50, "b": 10, "c": 30, "d": 50, "e": 1000}, {"a": 1, "b": 1, "c": 10_000, "d": 3, "é": 8, "Z": 4}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(water(sizes))


def test_ties(spark):
    rows = [(s, 100) for s in "abcdef"]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long"), weights=(1, 1)).collect()}
    assert got == {s: 150.0 for s in "abcdef"}


def sample(n=400):
    return [(i, " ".join(["w"] * (i * 7 % 50)) + ("#" * (i % 9)), "en", ["a", "b", "c", None][i % 7 % 4]) for i in range(n)]


def test_taken_meets_targets_and_reruns_agree(docs_of):
    df = docs_of(sample() + [(None, None), (3, "x y z", "en", "a"), (3, "x y z", "en", "a"), (9, "", "en", "only blank")])
    rows = mix(df).collect()
    assert len(rows) == 404
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 1e-9)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows, key=key) == sorted(mix(df.repartition(7)).collect(), key=key)


def test_better_documents_come_first(docs_of):
    from pyspark.sql import functions as F

    df = docs_of([(i, "w " * 10, "en", "a" if i < 1000 else "b") for i in range(2000)])
    rows = mix(df, quality=F.when(F.col("doc_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(float("nan"))), weights=(1, 1)).collect()
    twice = [r["doc_id"] for r in rows if r["source"] == "a" and r["taken"] == 20]
    assert len(twice) == 500 and sum(i % 2 == 0 for i in twice) > 400
    assert all(r["taken"] >= 10 for r in rows)


def test_equals_sql(spark, docs_of):
    duckdb = pytest.importorskip("duckdb")
    documents = docs_of(sample()).toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(MIX_SQL).fetchall())
    got = sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mix(docs_of(sample())).collect())
    assert got == want


def test_empty_table(docs_of):
    assert mix(docs_of([])).collect() == []
