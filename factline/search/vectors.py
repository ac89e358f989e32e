"""Vector ranking, by a scan or over stored lists with exact bounds, and rank fusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.search.index import indexes_folder, state_of
from factline.sources.store import exists

# Similarity thresholds and the fusion constant.
CATEGORY_THRESHOLD, CHUNK_THRESHOLD = 0.35, 0.28
FUSION_K = 60


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Zero for missing, unequal or zero vectors."""
    norms = _dot(a, a) * _dot(b, b)
    return F.when((F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / F.sqrt(norms)).otherwise(0.0)


def rank_by_vector(vectors: DataFrame, key: str, query: Column, limit: int, threshold: float, vector: str = "embedding") -> DataFrame:
    """Full scan with a bounded top-k per task; the threshold applies after the limit."""
    beside = vectors.select(key, F.col(vector).alias("_v"), query.alias("_q"))
    scored = beside.select(key, F.round(cosine(F.col("_v"), F.col("_q")), 9).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(limit).where(F.col("score") >= threshold)


#: Lists at most, and what rounding may do to an angle.
LISTS, SLACK = 256, 1e-6
#: The list of vectors that have no angle: missing, zero, with a component that is no number, or of another length than the centres.
APART = -1


@dataclass(frozen=True)
class Lists:
    """Vectors by nearest centre: rows (list, key, vector, theta), and centres (list, centre, low, high, n).

    theta is a vector's angle with its centre, ``low`` and ``high`` are the least and largest of a list.
    """

    vectors: DataFrame
    centres: DataFrame
    dim: int


def _unit(v: Column) -> Column:
    wide = F.transform(v, lambda x: x.cast("double"))
    return F.transform(wide, lambda x: x / F.sqrt(_dot(v, v)))


def _angle(cosine_: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_)))


def store_lists(vectors: DataFrame, key: str, folder: str, vector: str = "embedding", lists: int | None = None, made_from: str = "") -> Lists:
    """Write every vector beside its nearest centre, one folder per list, in order of angle.

    Centres are the vectors with the least hashes of their keys: as many as the root of the number of vectors, at most LISTS.
    """
    spark = vectors.sparkSession
    rows = vectors.select(key, F.col(vector).alias("vector"))
    square = _dot(F.col("vector"), F.col("vector"))
    sound = rows.where((square > 0) & (square < float("inf")))
    counted = sound.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    n, dim = (counted["n"], counted["dim"]) if counted else (0, 0)
    c = min(lists or LISTS, max(1, math.isqrt(n)))
    chosen = sound.where(F.size("vector") == dim).orderBy(F.xxhash64(key), key).limit(c)
    picked = [r["u"] for r in chosen.select(_unit(F.col("vector")).alias("u")).collect()]  # at most LISTS
    centres = spark.createDataFrame(list(enumerate(picked)), "list int, centre array<double>")
    table = centres.agg(F.collect_list(F.struct("list", "centre"))).scalar()
    fits = F.coalesce((square > 0) & (square < float("inf")) & (F.size("vector") == dim), F.lit(False))
    near = F.array_max(F.transform(F.col("_all"), lambda x: F.struct(_dot(F.col("_u"), x["centre"]).alias("cos"), (-x["list"]).alias("list"))))
    placed = rows.withColumn("_u", F.when(fits, _unit(F.col("vector")))).withColumn("_all", table).withColumn("_near", F.when(F.col("_u").isNotNull(), near))
    placed = placed.select(F.coalesce(-F.col("_near.list"), F.lit(APART)).alias("list"), key, "vector", _angle(F.col("_near.cos")).alias("theta"))
    placed.repartition("list").sortWithinPartitions("list", "theta").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/vectors")
    written = spark.read.schema(f"{key} {vectors.schema[key].dataType.simpleString()}, vector {vectors.schema[vector].dataType.simpleString()}, theta double, list int").parquet(f"{folder}/vectors")
    reach = written.groupBy("list").agg(F.min("theta").alias("low"), F.max("theta").alias("high"), F.count(F.lit(1)).alias("n"))
    reach = reach.join(centres, "list", "left").withColumn("dim", F.lit(dim)).withColumn("made_from", F.lit(made_from))
    reach.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    return open_lists(spark, folder)


def open_lists(spark: SparkSession, folder: str) -> Lists:
    centres = spark.read.parquet(f"{folder}/centres")
    first = centres.select("dim").first()
    return Lists(spark.read.parquet(f"{folder}/vectors"), centres, first["dim"] if first else 0)


def kept_lists(spark: SparkSession, name: str, key: str, vectors: Callable[[], DataFrame], made_from: list[str], vector: str = "embedding") -> Lists:
    """The lists ``name``, made anew only if the files they were made from have changed."""
    folder, state = f"{indexes_folder(spark)}/{name}", state_of(spark, made_from)
    if exists(spark, f"{folder}/centres/_SUCCESS"):
        first = spark.read.parquet(f"{folder}/centres").select("made_from").first()
        if first and first["made_from"] == state:
            return open_lists(spark, folder)
    return store_lists(vectors(), key, folder, vector, made_from=state)


def rank_by_lists(lists: Lists, key: str, query: Sequence[float] | None, limit: int, threshold: float) -> tuple[DataFrame, float]:
    """(what ``rank_by_vector`` gives, share of the vectors that were read).

    An angle is at least the difference of the angles that query and vector have with a centre.  So a list holds no vector nearer than the
    query's angle with its centre less the list's largest, or the list's least less that.  The nearest lists give a score that the result
    surely reaches; lists whose bound is below it are not opened, in the others only vectors whose own angle allows it count.
    """
    q = F.lit(None).cast("array<double>") if query is None else F.array(*[F.lit(float(x)) for x in query])
    size = lists.centres.select(F.sum("n")).first()[0] or 0
    norm = math.sqrt(sum(float(x) ** 2 for x in query)) if query is not None else 0.0
    if query is None or len(query) != lists.dim or not 0 < norm < math.inf:
        return rank_by_vector(lists.vectors, key, q, limit, threshold, "vector"), 1.0
    angle = _angle(_dot(F.col("centre"), q) / norm)
    rows = lists.centres.select("list", "low", "high", "n", F.when(F.col("list") != APART, angle).alias("theta")).collect()  # at most LISTS and one

    def least(r) -> float:
        return math.pi / 2 if r["theta"] is None else max(0.0, r["theta"] - r["high"], r["low"] - r["theta"]) - SLACK

    rows.sort(key=lambda r: (least(r), r["list"]))
    first, held = [], 0
    for r in rows:
        if held < limit:
            first.append(r["list"])
            held += r["n"]
    scored = lambda some: some.select(key, F.round(cosine(F.col("vector"), q), 9).alias("score"))
    sure = scored(lists.vectors.where(F.col("list").isin(first))).orderBy(F.desc("score"), key).limit(limit).agg(F.min("score"), F.count(F.lit(1))).first()
    floor = max(threshold, sure[0]) if sure[1] == limit else threshold
    widest = math.acos(max(-1.0, min(1.0, floor))) + SLACK
    opened = [r for r in rows if least(r) <= widest]
    keep = F.lit(False)
    for r in opened:
        inside = F.lit(True) if r["theta"] is None else F.col("theta").between(r["theta"] - widest, r["theta"] + widest)
        keep = keep | ((F.col("list") == r["list"]) & inside)
    found = scored(lists.vectors.where(F.col("list").isin([r["list"] for r in opened]) & keep))
    share = sum(r["n"] for r in rows if r["list"] in {*first, *(o["list"] for o in opened)}) / max(size, 1)
    return found.orderBy(F.desc("score"), key).limit(limit).where(F.col("score") >= threshold), share


def attach_vectors(items: DataFrame, vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """One stored vector and its dimension per item."""
    return items.join(vectors.select(key, vector), key).withColumn("dim", F.size(vector))


def fuse(lists: Sequence[DataFrame], key: str, limit: int, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of bounded result lists; ranks start at zero, ties keep the first seen.

    Each list is a finished top-k, so ranking it in one window is bounded by its limit.  An item that several lists have is shown as
    the one with a highlighted ``snippet``, else the one with a ``title``, else the one with the larger ``order_score``; ``shown`` is
    that item's list.
    """
    parts = None
    for i, df in enumerate(lists):
        w = Window.partitionBy("_list").orderBy(F.desc("score_order"), key)
        of = lambda c, df=df: F.col(c) if c in df.columns else F.lit(None).cast("string")
        ranked = df.select(key, F.col("order_score").alias("score_order"), of("snippet").alias("snippet"), of("title").alias("title"), F.lit(i).alias("_list")).withColumn("_rank", F.row_number().over(w) - 1)
        parts = ranked if parts is None else parts.unionByName(ranked)
    prefer = F.struct(F.coalesce(F.col("snippet").contains("«"), F.lit(False)), F.coalesce(F.col("title") != "", F.lit(False)), F.col("score_order"), -F.col("_list"))
    fused = parts.groupBy(key).agg(
        F.round(F.sum(1.0 / (k + F.col("_rank") + 1)), 9).alias("score"), F.min(F.struct("_list", "_rank")).alias("_first"), F.count(F.lit(1)).alias("n_lists"), F.max_by("_list", prefer).alias("shown")
    )
    return fused.orderBy(F.desc("score"), "_first._list", "_first._rank").limit(limit).select(key, "score", "n_lists", "shown")


def search(
    q: str, scope: str, limit: int, text_hits: dict[str, DataFrame], vector_hits: dict[str, DataFrame], key: str
) -> DataFrame:
    """Fused hits of one scope or both; each list carries ``order_score``."""
    if len(q.strip()) < 2:
        raise ValueError("q must be at least 2 characters")
    wanted = [s for s in ("spending", "documents") if scope in ("all", s)]
    if not wanted:
        raise ValueError(f"unknown scope {scope!r}")
    out = None
    for s in wanted:
        part = fuse([text_hits[s], vector_hits[s]], key, limit).withColumn("scope", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def vector_limit(limit: int) -> int:
    return max(8, limit // 2)
