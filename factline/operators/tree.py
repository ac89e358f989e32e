"""Roll-up trees in long form: one row per node, addressed by its path array.

A node with children takes the sum of its children and loses its own amount, so the value of a node
is the sum over the leaves below it.  That makes a whole tree two aggregates over path prefixes; no
step walks nodes one by one, and nothing depends on how many rows one jurisdiction holds.

Nodes meet by an id of fixed size, a hash of their keys and path, so shuffles carry no path arrays as keys; the
paths are joined back once.  Null keys are keys like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.ordered import join_on, top_per_key
from factline.session import cut_lineage

SEP = " / "
TOTAL = r"(?i)^\s*total\b"


def split_path(name: Column) -> Column:
    """Path parts of a node name; blanks dropped, an empty name becomes one placeholder part."""
    name = F.trim(F.coalesce(name, F.lit("Uncategorized")))
    parts = F.filter(F.transform(F.split(name, SEP), lambda p: F.trim(p)), lambda p: p != "")
    fallback = F.array(F.when(name == "", "Uncategorized").otherwise(name))
    return F.when(F.size(parts) > 0, parts).otherwise(fallback)


def node_id(keys: Sequence[str], path: Column) -> Column:
    """96 bits that stand for a node: its keys, null or not, and its path."""
    parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    return F.struct(F.xxhash64(*parts, path).alias("a"), F.hash(*parts, path).alias("b"))


def ancestor_ids(keys: Sequence[str], path: str = "path") -> Column:
    """Ids of the nodes above a path, the top one first; null for a path of one part."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda d: node_id(keys, F.slice(path, F.lit(1), d))))


def prefix_rows(df: DataFrame, path: str = "path", name: str = "prefix", depth: str = "depth") -> DataFrame:
    """One row per prefix of the path, the whole path included."""
    return df.withColumn(depth, F.explode(F.sequence(F.lit(1), F.size(path)))).withColumn(
        name, F.slice(F.col(path), F.lit(1), F.col(depth))
    )


def own_amounts(rows: DataFrame, keys: Sequence[str], amount: str = "amount_aud", fact: str = "fact_id") -> DataFrame:
    """Amount and citing fact per path (map-side combined before the only wide shuffle)."""
    return rows.groupBy(*keys, "path").agg(
        F.sum(amount).alias("own"), F.max(fact).alias("fact_id"), F.count(F.lit(1)).alias("n_facts")
    )


def prune_totals(own: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop a ``Total ...`` node, and all below it, when a sibling is not a total.

    Only paths that contain a total segment are looked at; the rest pass through untouched.
    """
    keys = list(keys)
    has_total = F.exists("path", lambda p: p.rlike(TOTAL))
    suspects = prefix_rows(own.where(has_total).select(*keys, "path")).where(F.element_at("prefix", -1).rlike(TOTAL))
    suspects = suspects.select(node_id(keys, F.slice("prefix", F.lit(1), F.col("depth") - 1)).alias("parent"), node_id(keys, F.col("path")).alias("_id"))
    wanted = suspects.select("parent").distinct()
    siblings = (
        prefix_rows(own.select(*keys, "path"))
        .where(~F.element_at("prefix", -1).rlike(TOTAL))
        .select(node_id(keys, F.slice("prefix", F.lit(1), F.col("depth") - 1)).alias("parent"))
    )
    # the few parents of totals sift the prefixes before anything is made distinct
    losing = siblings.join(wanted, "parent", "left_semi").distinct()
    bad = suspects.join(losing, "parent", "left_semi").select("_id").distinct()
    return own.withColumn("_id", node_id(keys, F.col("path"))).join(bad, "_id", "left_anti").drop("_id")


def leaves(own: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes with no children: the only ones whose own amount survives."""
    keys = list(keys)
    inner = own.select(F.explode(ancestor_ids(keys)).alias("_id")).distinct()
    return own.withColumn("_id", node_id(keys, F.col("path"))).join(inner, "_id", "left_anti").drop("_id")


def roll_up(leaf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node of the tree with its depth, value, citing fact (leaves only) and leaf count.

    Sums are grouped by node id alone; a node takes its path from one of the leaves below it.
    """
    keys = list(keys)
    own = node_id(keys, F.col("path"))
    every = leaf.withColumn("_leaf", own).withColumn("_ids", F.concat(F.coalesce(ancestor_ids(keys), F.array().cast("array<struct<a:bigint,b:int>>")), F.array(own)))
    spread = every.select("own", "fact_id", "_leaf", F.posexplode("_ids").alias("_at", "_id"))
    sums = spread.groupBy("_id").agg(
        F.sum("own").alias("value"),
        F.max(F.when(F.col("_id") == F.col("_leaf"), F.col("fact_id"))).alias("fact_id"),
        F.count(F.lit(1)).alias("n_leaves"),
        F.min(F.struct("_leaf.a", "_leaf.b", "_at")).alias("_of"),
    )
    sums = sums.select("value", "fact_id", "n_leaves", F.struct("_of.a", "_of.b").alias("_leaf"), (F.col("_of._at") + 1).alias("depth"))
    paths = leaf.select(*keys, F.col("path").alias("_path"), own.alias("_leaf"))
    named = sums.join(paths, "_leaf").withColumn("path", F.slice("_path", F.lit(1), F.col("depth")))
    return named.select(*keys, "depth", "path", F.element_at("path", -1).alias("name"), "value", "fact_id", "n_leaves")


def tree(rows: DataFrame, keys: Sequence[str], amount: str = "amount_aud", fact: str = "fact_id") -> DataFrame:
    """Rows with a ``path`` -> nodes of the pruned, rolled-up tree."""
    return roll_up(leaf_amounts(rows, keys, amount, fact), keys)


def pruned_amounts(rows: DataFrame, keys: Sequence[str], amount: str = "amount_aud", fact: str = "fact_id") -> DataFrame:
    """Own amounts without pruned totals.

    Facts are combined to one row per path and written once: pruning and leaf tests read the paths
    several times, the facts only here.
    """
    return prune_totals(cut_lineage(own_amounts(rows, keys, amount, fact)), keys)


def leaf_amounts(rows: DataFrame, keys: Sequence[str], amount: str = "amount_aud", fact: str = "fact_id") -> DataFrame:
    """The rows whose amounts survive: leaves of the pruned tree."""
    return leaves(cut_lineage(pruned_amounts(rows, keys, amount, fact)), keys)


def preserved_roll_up(own: DataFrame, keys: Sequence[str], preserve: str = "preserve") -> DataFrame:
    """Roll-up where flagged nodes keep their own amount and stand for everything below them.

    A contribution climbs until it meets a preserved ancestor, which already holds its own figure.
    """
    keys = list(keys)
    own = own.withColumn("_id", node_id(keys, F.col("path")))
    is_leaf = leaves(own.drop("_id"), keys).select(node_id(keys, F.col("path")).alias("_id"), F.lit(True).alias("is_leaf"))
    nodes = own.join(is_leaf, "_id", "left").where(F.col("is_leaf") | F.col(preserve))
    kept = own.where(F.col(preserve)).select(F.col("_id").alias("_above"), F.size("path").alias("stop"))
    stops = nodes.select("_id", F.explode(ancestor_ids(keys)).alias("_above")).join(kept, "_above").groupBy("_id").agg(F.max("stop").alias("stop"))
    return roll_up_from(nodes.join(stops, "_id", "left").drop("_id"), keys)


def roll_up_from(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    spread = prefix_rows(nodes).where(F.col("depth") > F.coalesce(F.col("stop"), F.lit(0)))
    return spread.groupBy(*keys, "prefix").agg(F.sum("own").alias("value")).select(
        *keys, F.size("prefix").alias("depth"), F.col("prefix").alias("path"), "value"
    )


def named_total(leaf: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Sum of the shallowest nodes called ``name``; nothing below a match counts again."""
    wanted = name.strip().lower()
    hit = leaf.where(F.exists("path", lambda p: F.lower(F.trim(p)) == wanted))
    return hit.groupBy(*keys).agg(F.sum("own").alias("value"), F.max("fact_id").alias("fact_id"))


def drill_path(nodes: DataFrame, keys: Sequence[str], wanted: DataFrame, fact: str = "fact_id", name: str = "name") -> DataFrame:
    """Path to one node of each tree: that of the ``wanted`` fact id; else the deepest one whose name matches ``wanted``'s.

    ``wanted`` has a row per tree with ``want_fact`` and ``want_name``, either may be null.  A name matches if it contains the other or
    lies in it.
    """
    keys = list(keys)
    j = join_on(nodes, wanted, keys).withColumn("_n", F.lower(F.trim(F.element_at("path", -1)))).withColumn("_w", F.lower(F.trim("want_name")))
    exact = F.coalesce(F.col(fact) == F.col("want_fact"), F.lit(False))
    named = F.coalesce((F.col("_w") != "") & (F.contains("_n", F.col("_w")) | F.contains("_w", F.col("_n"))), F.lit(False))
    hit = j.where(exact | named).groupBy(*keys).agg(F.max(F.struct(exact.alias("exact"), F.col("depth"), path_text().alias("path"))).alias("_b"))
    return hit.select(*keys, "_b.path", "_b.depth", "_b.exact")


def side_by_side(nodes: DataFrame, level: str = "level", year: str = "financial_year", lone: str = "federal") -> DataFrame:
    """Trees of all levels below a root of value zero; the single jurisdiction of the level ``lone`` is taken off its paths.

    Rows (year, level, depth, path, value); the levels themselves are never added up.
    """
    tops = nodes.where(F.col("depth") == 1).groupBy(level, year).agg(F.count(F.lit(1)).alias("_tops"))
    j = join_on(nodes, tops, [level, year]).withColumn("_cut", F.when((F.col(level) == lone) & (F.col("_tops") == 1), 1).otherwise(0))
    cut = j.withColumn("path", F.slice("path", F.col("_cut") + 1, F.size("path"))).withColumn("depth", F.col("depth") - F.col("_cut"))
    return cut.where(F.col("depth") > 0).select(year, level, "depth", "path", "value")


def with_parent_path(nodes: DataFrame, path: str = "path") -> DataFrame:
    return nodes.withColumn("parent_path", F.slice(F.col(path), F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))))


def path_text(path: str = "path") -> Column:
    return F.array_join(path, SEP)


def collapse_repeats(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A -> A -> A with an only child becomes one node: outer amount, inner fact and children.

    A segment is dropped when it repeats the one above it and is that node's only child.
    """
    keys = list(keys)
    linked = with_parent_path(nodes).withColumn("_above", node_id(keys, F.col("parent_path")))
    only = linked.groupBy("_above").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1)
    repeats = (
        linked.where((F.size("path") > 1) & (F.element_at("path", -1) == F.element_at("path", -2)) & (F.col("value") > 0))
        .join(only, "_above", "left_semi")
        .select(node_id(keys, F.col("path")).alias("_at"), F.size("path").alias("cut"))
    )
    nodes = nodes.withColumn("_id", node_id(keys, F.col("path")))
    ids = F.concat(F.coalesce(ancestor_ids(keys), F.array().cast("array<struct<a:bigint,b:int>>")), F.array("_id"))
    cuts = nodes.select("_id", F.explode(ids).alias("_at")).join(repeats, "_at").groupBy("_id").agg(F.collect_set("cut").alias("cuts"))
    moved = nodes.join(cuts, "_id", "left").drop("_id").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    kept = F.filter(
        F.transform(F.col("path"), lambda p, i: F.when(~F.array_contains(F.col("cuts"), i + 1), p)), lambda p: p.isNotNull()
    )
    moved = moved.withColumn("new_path", kept)
    return moved.groupBy(*keys, F.col("new_path").alias("path")).agg(
        F.min_by("value", F.size("path")).alias("value"),
        F.max_by("fact_id", F.when(F.col("fact_id").isNotNull(), F.size("path"))).alias("fact_id"),
    )


def fold_top(rows: DataFrame, keys: Sequence[str], item: str, value: str, n: int) -> DataFrame:
    """Largest ``n`` items per key and one ``Other (k)`` row; no fold when at most n+1 items.

    The remainder is the key's total less its head, so no task ever holds a whole key.
    """
    keys = list(keys)
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    head = top_per_key(rows.select(*keys, item, value), keys, [F.desc(value), F.asc(item)], n + 1, "_rank")
    head = join_on(head, totals, keys).where((F.col("_rank") <= n) | (F.col("_n") <= n + 1))
    shown = head.select(*keys, item, value)
    head_sum = head.where(F.col("_n") > n + 1).groupBy(*keys, "_sum", "_n").agg(F.sum(value).alias("_head"))
    other = head_sum.select(
        *keys,
        F.concat(F.lit("Other ("), (F.col("_n") - n).cast("string"), F.lit(")")).alias(item),
        (F.col("_sum") - F.col("_head")).alias(value),
    )
    return shown.unionByName(other)
