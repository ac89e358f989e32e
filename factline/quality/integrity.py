"""Constraints, duplicates, orphans and additive edges that leave their level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed vocabularies of the fact table.
ENUMS = {
    "estimate_status": ("actual", "audited_actual", "estimated_actual", "budget", "revised_estimate", "forward_estimate", "award", "contract"),
    "accounting_basis": ("accrual", "cash", "gfs", "commitment"),
}
IDENTITY = ("source_key", "node_path", "financial_year", "measure_type", "estimate_status")
AMOUNT_TOLERANCE = 1e-6


def constraint_violations(facts: DataFrame, enums: Mapping[str, Sequence[str]], required: Sequence[str], either: Sequence[str] = ()) -> DataFrame:
    """Rows that break each rule, all rules in one scan."""
    tests: dict[str, Column] = {f"enum:{c}": ~F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in enums.items()}
    tests |= {f"not_null:{c}": F.col(c).isNull() for c in required}
    if either:
        tests["either:" + ",".join(either)] = F.coalesce(*[F.col(c) for c in either]).isNull()
    counts = facts.agg(*[F.count(F.when(t, 1)).alias(n) for n, t in tests.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n_violations")) for n in tests])
    return counts.select(F.inline(pairs))


def duplicate_facts(facts: DataFrame, keys: Sequence[str], fact: str = "fact_id") -> DataFrame:
    """Groups with one identity under several facts; the ids are counted, with the least two shown."""
    unique = facts.groupBy(*keys, fact).agg(F.count(F.lit(1)).alias("_n"))
    return (
        unique.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_facts"), F.min(fact).alias("first_fact"), F.max(fact).alias("last_fact"))
        .where(F.col("n_facts") > 1)
    )


def partition_reviewed(groups: DataFrame, registry: DataFrame, identity: Sequence[str] = IDENTITY, amount: str = "amount_aud") -> DataFrame:
    """reviewed where a registry entry has the exact identity and amount, else unresolved."""
    r = registry.select(*identity, F.col(amount).alias("_a"), "reason")
    j = groups.join(r, list(identity), "left").withColumn("_hit", F.abs(F.col("_a") - F.col(amount)) < AMOUNT_TOLERANCE)
    rest = [c for c in groups.columns if c not in (*identity, amount)]
    out = j.groupBy(*identity, amount, *rest).agg(F.max(F.coalesce("_hit", F.lit(False))).alias("_ok"), F.min(F.when(F.col("_hit"), F.col("reason"))).alias("reason"))
    return out.withColumn("review", F.when(F.col("_ok"), "reviewed").otherwise("unresolved")).drop("_ok")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Null years and crosswalks group together, so they compare equal here."""
    key = ["parent_id", "child_id", "edge_kind", "financial_year", "crosswalk_id"]
    return edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphan_facts(facts: DataFrame, bridge: DataFrame) -> DataFrame:
    return facts.join(bridge.select("fact_id"), "fact_id", "left_anti")


def orphan_nodes(nodes: DataFrame, bridge: DataFrame, *edge_sets: DataFrame) -> DataFrame:
    """Nodes with no fact and no place in any edge set; a folder with edges is no orphan."""
    used = bridge.select("node_id")
    for e in edge_sets:
        used = used.unionByName(e.select(F.col("parent_id").alias("node_id"))).unionByName(e.select(F.col("child_id").alias("node_id")))
    return nodes.join(used.distinct(), "node_id", "left_anti")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id")
    whole = edges.join(ids, edges.parent_id == ids.node_id, "left_semi").join(ids, edges.child_id == ids.node_id, "left_semi")
    return edges.join(whole.select("parent_id", "child_id").distinct(), ["parent_id", "child_id"], "left_anti")


def dangling_documents(documents: DataFrame, facts: DataFrame, nodes: DataFrame, key: str = "source_key") -> DataFrame:
    used = facts.select(key).unionByName(nodes.select(key)).distinct()
    return documents.join(used, key, "left_anti")


def crossing_edges(edges: DataFrame, nodes: DataFrame, attribute: str) -> DataFrame:
    """Additive edges whose ends differ in level or jurisdiction."""
    a = nodes.select(F.col("node_id").alias("parent_id"), F.col(attribute).alias("parent_value"))
    b = nodes.select(F.col("node_id").alias("child_id"), F.col(attribute).alias("child_value"))
    same = edges.where("edge_kind = 'same_group'")
    return same.join(a, "parent_id").join(b, "child_id").where(F.col("parent_value") != F.col("child_value"))


def hard_failures(counts: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows per failing check and their sum; informational checks stay out of the mapping."""
    out = None
    for name, df in counts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out.unionByName(out.agg(F.sum("n").alias("n")).select(F.lit("hard_failures").alias("check"), "n"))
