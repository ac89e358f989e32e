"""Joins between labels, paths and years that never pair all with all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the contains match.
CONTAINS_MIN = 16
CONTAINS_RATIO = 0.72


def latest_per_key(right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key as an aggregate with map-side combine."""
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    best = right.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def path_prefixes(name: Column, sep: str = " / ") -> Column:
    """All strict ancestors of a path, as text."""
    parts = F.split(name, sep)
    n = F.size(parts) - 1
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))
    ).otherwise(F.array().cast("array<string>"))


def longest_ancestor(children: DataFrame, parents: DataFrame, child_key: str, child: str, parent: str) -> DataFrame:
    """Nearest existing ancestor of each child path, by equi join on its exploded prefixes."""
    spread = children.select(child_key, child, F.explode(path_prefixes(F.col(child))).alias("_pre"))
    hit = spread.join(parents.select(F.col(parent).alias("_par")).distinct(), F.lower("_pre") == F.lower("_par"))
    return hit.groupBy(child_key, child).agg(F.max_by("_par", F.length("_pre")).alias(parent))


def prefix_join(left: DataFrame, right: DataFrame, left_path: str, right_prefix: str, sep: str = " / ") -> DataFrame:
    """Rows of ``left`` below each prefix of ``right`` (``LIKE prefix || ' / %'``) as an equi join."""
    spread = left.withColumn("_pre", F.explode(path_prefixes(F.col(left_path), sep)))
    return spread.join(right, F.col("_pre") == F.col(right_prefix)).drop("_pre")


def _grams(text: str) -> Column:
    """Distinct runs of CONTAINS_MIN characters of a column at least that long."""
    starts = F.sequence(F.lit(1), F.length(text) - CONTAINS_MIN + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.col(text).substr(i, F.lit(CONTAINS_MIN))))


def _contained(short: DataFrame, long: DataFrame, s: str, lg: str) -> DataFrame:
    """Pairs where ``short`` lies inside ``long`` with the required overlap.

    A label that contains another has all its runs of 16 characters, so the short label meets only those that share its rarest
    run; a start that very many labels have in common pairs nothing by itself.  The full test runs on the few pairs that are left.
    """
    spread = long.where(F.length(lg) >= CONTAINS_MIN).withColumn("_g", F.explode(_grams(lg)))
    often = spread.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    own = short.where(F.length(s) >= CONTAINS_MIN).select(F.col(s).alias("_s"), F.explode(_grams(s)).alias("_g")).distinct()
    # a run that no long label has comes first, and then meets nothing
    rarest = own.join(often, "_g", "left").groupBy("_s").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), F.col("_g"))).alias("_g"))
    pairs = short.join(rarest, F.col(s) == F.col("_s")).drop("_s").join(spread, "_g").drop("_g")
    return pairs.where(F.col(lg).contains(F.col(s)) & (F.length(s) / F.length(lg) >= CONTAINS_RATIO))


def ranked_parent(
    labels: DataFrame,
    nodes: DataFrame,
    seeds: Mapping[str, str],
    agencies: Sequence[tuple[str, str]],
    label: str = "label",
    leaf: str = "leaf",
    path: str = "path",
    priority: str = "priority",
) -> DataFrame:
    """Parent path per label: seed, exact leaf, contained leaf, then the function of an agency it starts with or names.

    Within a tier the lowest source priority wins, then the lesser path.  A function that is a leaf itself stands for that leaf's
    path.
    """
    base = labels.select(label).distinct()
    seed_map = F.create_map(*[F.lit(x) for kv in seeds.items() for x in kv])
    none = F.lit(None).cast("string")

    def tier(df: DataFrame, n: int, quality: Column, parent: Column, rank: Column) -> DataFrame:
        return df.select(label, F.struct(F.lit(n).alias("tier"), rank.cast("int").alias("rank"), parent.alias("parent"), quality.alias("quality")).alias("c"))

    keyed = nodes.groupBy(leaf).agg(F.min(F.struct(priority, path)).alias("_b")).select(
        leaf, F.col(f"_b.{priority}").alias(priority), F.col(f"_b.{path}").alias(path)
    )
    seeded = base.withColumn("_s", F.try_element_at(seed_map, F.col(label))).where(F.col("_s").isNotNull())
    exact = base.join(keyed, F.col(label) == F.col(leaf))
    inside = _contained(base, keyed, label, leaf).unionByName(
        _contained(keyed, base, leaf, label).select(label, leaf, priority, path)
    )
    fallback = none
    for prefix, function in reversed(list(agencies)):
        named = F.concat(F.lit(" "), F.col(label), F.lit(" ")).contains(f" {prefix.strip()} ")
        fallback = F.when(F.col(label).startswith(prefix) | named, function).otherwise(fallback)
    agency = base.withColumn("_a", fallback).where(F.col("_a").isNotNull())
    paths = keyed.select(F.col(leaf).alias("_leaf"), F.col(path).alias("_path"))
    agency = agency.join(paths, F.lower("_a") == F.col("_leaf"), "left")
    found = (
        tier(seeded, 0, F.lit("seed"), F.col("_s"), F.lit(0))
        .unionByName(tier(exact, 1, F.lit("exact_leaf"), F.col(path), F.col(priority)))
        .unionByName(tier(inside, 2, F.lit("contains_leaf"), F.col(path), F.col(priority)))
        .unionByName(tier(agency, 3, F.concat(F.lit("agency:"), F.col("_a")), F.coalesce("_path", "_a"), F.lit(0)))
    )
    best = found.groupBy(label).agg(F.min("c").alias("c"))
    return labels.join(best, label, "left").select(
        *labels.columns, F.col("c.parent").alias("parent"), F.coalesce("c.quality", F.lit("unmatched")).alias("quality")
    )


def nearest_earlier(rows: DataFrame, keys: Sequence[str], target: Column, start: str, keep: Sequence[str]) -> DataFrame:
    """Latest row strictly before the target year per key: an aggregate, no range join."""
    earlier = rows.where(F.col(start) < target)
    rest = [c for c in keep if c not in keys]
    best = earlier.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(start, *rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
