from pyspark.sql import functions as F

from factline.operators import loading


def test_a_hot_key_needs_no_task_of_its_own(spark):
    n = 60_000
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(kept, ("false", "-1", "32"), strict=True):
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id")))
        new = spark.range(n).select(key.alias("fact_key"), F.col("id").alias("pos"), (F.col("id") % 2).cast("double").alias("amount_aud"))
        out = loading.same_load_outcomes(new, "pos")
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        got = {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()}
        assert got == {"insert": 2 * n // 3 + 1, "skip": n // 6 - 1, "conflict": n // 6}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_null_keys_ties_and_empty_loads(spark):
    rows = [(None, 1, 5.0), (None, 2, 5.0), (None, 3, 6.0), ("a", 4, 1.0), ("a", 5, None)]
    schema = "fact_key string, pos long, amount_aud double"
    got = {r["pos"]: r["outcome"] for r in loading.same_load_outcomes(spark.createDataFrame(rows, schema), "pos").collect()}
    assert got == {1: "insert", 2: "skip", 3: "conflict", 4: "insert", 5: "conflict"}
    assert loading.same_load_outcomes(spark.createDataFrame([], schema), "pos").collect() == []
