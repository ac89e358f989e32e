"""Plans for removing duplicates, orphans and stale rows; each plan is safe to run twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.functions import labels as L
from factline.quality.integrity import orphan_nodes

IDENTITY = ("financial_year", "measure_type", "estimate_status", "amount_aud", "node_path", "source_key")


def deletion_plan(entries: DataFrame, facts: DataFrame, references: DataFrame) -> DataFrame:
    """would_delete, already_resolved or error with the reason, for each declared pair.

    ``entries`` hold the identity and ``retain_fact_key``, ``delete_fact_key``; ``facts`` the live rows with
    ``fact_key, node_id``; ``references`` every fact key something else points to.
    """
    live = F.struct(*IDENTITY).alias("identity")
    side = lambda p: facts.select(F.col("fact_key").alias(f"{p}_fact_key"), live.alias(f"{p}_identity"), F.col("node_id").alias(f"{p}_node"))
    held = references.select(F.col("fact_key").alias("delete_fact_key")).distinct().withColumn("_ref", F.lit(True))
    j = entries.withColumn("declared", F.struct(*IDENTITY)).join(side("delete"), "delete_fact_key", "left").join(side("retain"), "retain_fact_key", "left").join(held, "delete_fact_key", "left")
    status = (
        F.when(F.col("delete_identity").isNull(), "already_resolved")
        .when(F.col("retain_identity").isNull(), "error:retain_missing")
        .when(F.col("delete_identity") != F.col("declared"), "error:stale_identity")
        .when(F.col("retain_identity") != F.col("declared"), "error:stale_identity")
        .when(F.col("retain_node") != F.col("delete_node"), "error:different_nodes")
        .when(F.col("_ref"), "error:referenced")
        .otherwise("would_delete")
    )
    return j.select(*entries.columns, status.alias("status"))


def orphan_node_plan(nodes: DataFrame, bridge: DataFrame, edges: DataFrame, source: str = "source_key") -> DataFrame:
    """Orphans per source, checked against facts and both ends of the edges."""
    return orphan_nodes(nodes, bridge, edges).groupBy(source).agg(F.count(F.lit(1)).alias("n_orphans"), F.min("node_id").alias("first_node"))


def stale_nodes(before: DataFrame, after: DataFrame, bridge: DataFrame, edges: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes that bore facts before a reload and bear none now, and the edges that touch them.

    With ``tasks`` the edges are dealt to so many by each end; else Spark decides.
    """
    def touching(end: str) -> DataFrame:
        deal = lambda df: df.repartition(tasks, end) if tasks else df
        return deal(edges).join(deal(gone.withColumnRenamed("node_id", end)), end, "left_semi").select(*edges.columns)

    gone = before.select("node_id").distinct().join(after.select("node_id"), "node_id", "left_anti").join(bridge.select("node_id"), "node_id", "left_anti")
    return gone, touching("parent_id").unionByName(touching("child_id")).distinct()


def rejected_to_quarantine(facts: DataFrame, name: str = "node_name") -> DataFrame:
    """Live facts whose shown label the classifier refuses, with the reason they move."""
    c = L.with_class(facts, F.element_at(F.split(F.col(name), " / "), -1), "_c")
    return c.where(~L.publishable(F.col("_c.label_class"))).withColumn("quarantine_reason", F.concat_ws(":", "_c.label_class", "_c.rejection")).drop("_c")


def stray_source_state(facts: DataFrame, edges: DataFrame, measure: str, keys: Sequence[str] = ("source_key",)) -> DataFrame:
    """Per source: stray facts, other measures, edges on the stray nodes, and whether removal is safe."""
    keys = list(keys)
    per = facts.groupBy(*keys).agg(
        F.count(F.when(F.col("measure_type") == measure, 1)).alias("n_stray"),
        F.count_distinct(F.when(F.col("measure_type") != measure, F.col("measure_type"))).alias("n_other_measures"),
    )
    nodes = facts.where(F.col("measure_type") == measure).select(*keys, "node_id").distinct()
    ends = edges.select(F.col("parent_id").alias("node_id")).unionByName(edges.select(F.col("child_id").alias("node_id")))
    touched = nodes.join(ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("_e")), "node_id").groupBy(*keys).agg(F.sum("_e").alias("n_edges"))
    j = per.join(touched, keys, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return j.withColumn("safe_to_remove", (F.col("n_other_measures") == 0) & (F.col("n_edges") == 0))
