"""Building edges: paths, crosswalks, the ordered cascade and its pruning.

Nodes are ``(node_id, source_key, name)`` with names as ``" / "`` paths; edges are
``(parent_id, child_id, edge_kind, crosswalk_id, financial_year, priority, notes)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.matching import path_prefixes
from factline.operators.ordered import first_per_key

SEP = " / "
# Priorities of the edge families.
PATH_PRIORITY = 100
CROSSWALK_PRIORITY = 50
COMPONENT_PRIORITY = 90
PROGRAM_ON_LEAF, PROGRAM_ON_COMPONENT, PROGRAM_ON_FUNCTION = 70, 80, 75


def node_key(source: Column, name: Column) -> Column:
    return F.concat(source, F.lit("|"), name)


def depth(name: Column) -> Column:
    return F.size(F.split(name, SEP))


def parent_name(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*) / (?:(?! / ).)*$", 1)


def display_name(name: Column, parent: Column) -> Column:
    """Without the parent's prefix, else the last segment."""
    name = F.trim(F.coalesce(name, F.lit("")))
    prefix = F.concat(parent, F.lit(SEP))
    cut = name.substr(F.length(prefix) + 1, F.length(name))
    return F.when(F.coalesce(F.startswith(name, prefix), F.lit(False)), cut).otherwise(F.element_at(F.split(name, SEP), -1))


def _edges(df: DataFrame, kind: str, crosswalk: Column, priority: Column, notes: Column) -> DataFrame:
    return df.select(
        "parent_id",
        "child_id",
        F.lit(kind).alias("edge_kind"),
        crosswalk.cast("string").alias("crosswalk_id"),
        F.lit(None).cast("string").alias("financial_year"),
        priority.cast("int").alias("priority"),
        notes.alias("notes"),
    )


def only_new(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges not there yet; null years and crosswalks count as equal."""
    key = ["parent_id", "child_id", "edge_kind", "crosswalk_id", "financial_year"]
    a, b = candidates.dropDuplicates(key).alias("a"), existing.select(*key).alias("b")
    on = None
    for k in key:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    return a.join(b, on, "left_anti")


def path_edges(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents that have to be created, edges of every step of every path).

    All prefixes are exploded once, so no rounds to a fixed point are needed.
    """
    spread = nodes.select("source_key", F.explode(F.concat(path_prefixes(F.col("name")), F.array("name"))).alias("name")).distinct()
    made = spread.join(nodes.select("source_key", "name"), ["source_key", "name"], "left_anti")
    made = made.withColumn("node_id", node_key(F.col("source_key"), F.col("name")))
    steps = spread.where(F.col("name").contains(SEP)).withColumn("parent", parent_name(F.col("name")))
    edges = steps.select(
        node_key(F.col("source_key"), F.col("parent")).alias("parent_id"),
        node_key(F.col("source_key"), F.col("name")).alias("child_id"),
        "parent",
    )
    return made, _edges(edges, "same_group", F.lit(None), F.lit(PATH_PRIORITY), F.concat(F.lit("path:"), F.col("parent")))


def crosswalk_edges(nodes: DataFrame, crosswalk: DataFrame, purpose: str, functions: str, components: str, crosswalk_id: str) -> DataFrame:
    """Purpose nodes (also as ``Total x``) to the best layer below a function.

    Layer order: sub-functions, else two-step components, else three-step components, else the function.
    """
    cw = crosswalk.select(F.col("purpose").alias("_p"), F.col("function").alias("_f"), "quality").distinct()
    names = cw.select("*", F.explode(F.array(F.lower("_p"), F.lower(F.concat(F.lit("Total "), "_p")))).alias("_n"))
    left = nodes.where(F.col("source_key").startswith(purpose)).select(F.col("node_id").alias("parent_id"), F.lower("name").alias("_n"))
    parents = left.join(names, "_n").select("parent_id", "_p", "_f", "quality").distinct()
    below = nodes.withColumn("_d", depth(F.col("name"))).withColumn("_f", F.split("name", SEP)[0])
    fn, comp = F.col("source_key") == functions, F.col("source_key") == components
    tier = F.when(fn & (F.col("_d") == 2), 0).when(comp & (F.col("_d") == 2), 1).when(comp & (F.col("_d") == 3), 2).when(fn & (F.col("_d") == 1), 3)
    kids = below.select("_f", tier.alias("_t"), F.col("node_id").alias("child_id"), "name").where(F.col("_t").isNotNull())
    best = kids.groupBy("_f").agg(F.min("_t").alias("_t"))
    chosen = kids.join(best, ["_f", "_t"], "left_semi")
    return _edges(
        parents.join(chosen, "_f"),
        "related_breakdown",
        F.lit(crosswalk_id),
        F.lit(CROSSWALK_PRIORITY),
        F.concat(F.col("_p"), F.lit("→"), F.col("name"), F.lit("|"), F.col("quality")),
    )


def component_edges(nodes: DataFrame, functions: str, components: str) -> DataFrame:
    """Components under the function node of the same name, else under their parent path."""
    comp = nodes.where(F.col("source_key") == components).select(F.col("node_id").alias("child_id"), "name", F.lower("name").alias("_n"))
    fn = nodes.where(F.col("source_key") == functions).select(F.col("node_id").alias("parent_id"), F.lower("name").alias("_n"))
    exact = comp.join(fn, "_n").withColumn("note", F.lit("exact"))
    rest = comp.join(fn, "_n", "left_anti").where(depth(F.col("name")) >= 3)
    by_parent = rest.withColumn("_n", F.lower(parent_name(F.col("name")))).join(fn, "_n").withColumn("note", F.lit("parent"))
    both = exact.unionByName(by_parent)
    return _edges(both, "same_group", F.lit("functions_to_components"), F.lit(COMPONENT_PRIORITY), F.concat_ws(":", "note", "name"))


def program_edges(nodes: DataFrame, programs: Sequence[str], functions: str, components: str) -> DataFrame:
    """Programs under the component they name, else under their parent path among components, else functions."""
    prog = nodes.where(F.col("source_key").isin(*programs)).where(depth(F.col("name")) >= 2)
    prog = prog.select(F.col("node_id").alias("child_id"), "name", F.lower("name").alias("_n"), F.lower(parent_name(F.col("name"))).alias("_up"))
    comp = nodes.where(F.col("source_key") == components).select(F.col("node_id").alias("parent_id"), F.lower("name").alias("_n"))
    fn = nodes.where(F.col("source_key") == functions).select(F.col("node_id").alias("parent_id"), F.lower("name").alias("_n"))
    hits = (
        prog.join(comp, "_n").select("child_id", "name", "parent_id", F.lit(0).alias("tier"))
        .unionByName(prog.drop("_n").join(comp, F.col("_up") == F.col("_n")).select("child_id", "name", "parent_id", F.lit(1).alias("tier")))
        .unionByName(prog.drop("_n").join(fn, F.col("_up") == F.col("_n")).select("child_id", "name", "parent_id", F.lit(2).alias("tier")))
    )
    best = hits.groupBy("child_id").agg(F.min("tier").alias("tier"))
    chosen = hits.join(best, ["child_id", "tier"], "left_semi")
    priority = F.when(F.col("tier") == 0, PROGRAM_ON_LEAF).when(F.col("tier") == 1, PROGRAM_ON_COMPONENT).otherwise(PROGRAM_ON_FUNCTION)
    cross = F.when(F.col("tier") == 0, "program_on_component").otherwise("program_on_parent")
    return _edges(chosen, "same_group", cross, priority, F.concat(F.lit("program:"), "name"))


def prune_direct(edges: DataFrame, nodes: DataFrame, functions: str, components: str, programs: Sequence[str]) -> DataFrame:
    """Drop function -> program edges of programs that already hang under a component."""
    src = nodes.select("node_id", "source_key")
    e = edges.join(src.select(F.col("node_id").alias("parent_id"), F.col("source_key").alias("_ps")), "parent_id", "left")
    e = e.join(src.select(F.col("node_id").alias("child_id"), F.col("source_key").alias("_cs")), "child_id", "left")
    same = F.col("edge_kind") == "same_group"
    covered = e.where(same & (F.col("_ps") == components)).select("child_id").distinct().withColumn("_cov", F.lit(True))
    direct = F.coalesce(same & (F.col("_ps") == functions) & F.col("_cs").isin(*programs), F.lit(False))
    out = e.join(covered, "child_id", "left").where(~(direct & F.coalesce("_cov", F.lit(False))))
    return out.select(*edges.columns)


def children_under_cascade(nodes: DataFrame, child_source: str, parent_sources: Sequence[str], crosswalk_id: str, priority: int = 55) -> DataFrame:
    """Hang each child path under its longest ancestor that a ranked parent source holds.

    The attached node is the child source's own node one step below that ancestor; one edge per pair.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in parent_sources]), F.col("source_key"))
    tops = first_per_key(
        nodes.where(F.col("source_key").isin(*parent_sources)).select(F.lower("name").alias("_pre"), F.col("node_id").alias("parent_id"), rank.alias("_r")),
        ["_pre"],
        [F.col("_r"), F.col("parent_id")],
    )
    kids = nodes.where((F.col("source_key") == child_source) & F.col("name").contains(SEP)).select("node_id", "name")
    parts = F.split("name", SEP)
    cut = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("_c")
    spread = kids.select("name", parts.alias("_parts"), cut)
    text = lambda n: F.lower(F.array_join(F.slice("_parts", F.lit(1), n), SEP))
    spread = spread.select("name", "_c", text(F.col("_c")).alias("_pre"), text(F.col("_c") + 1).alias("_att"))
    own = nodes.where(F.col("source_key") == child_source).groupBy(F.lower("name").alias("_att")).agg(F.min("node_id").alias("child_id"))
    hit = spread.join(tops, "_pre").join(own, "_att")
    best = hit.groupBy("name").agg(F.max_by(F.struct("parent_id", "child_id"), F.col("_c")).alias("b"))
    pairs = best.groupBy(F.col("b.parent_id").alias("parent_id"), F.col("b.child_id").alias("child_id")).agg(F.min("name").alias("name"))
    return _edges(pairs, "same_group", F.lit(crosswalk_id), F.lit(priority), F.concat(F.lit(f"{crosswalk_id}:"), "name"))


def decide_crosswalk(programs: DataFrame, overrides: Sequence[tuple[str, str, str]], defaults: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    """mapped, ambiguous or unmapped per program.

    ``overrides`` are ``(portfolio, label contains, target)``, in order; ``defaults`` are
    ``(portfolio, target, reason)`` where a missing target marks the portfolio as ambiguous.
    """
    label = F.lower(F.coalesce("label", F.lit("")))
    target, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    status, reason = F.lit("unmapped"), F.lit("portfolio_not_in_crosswalk")
    for portfolio, to, why in reversed(list(defaults)):
        hit = F.col("portfolio") == portfolio
        target = F.when(hit, F.lit(to)).otherwise(target)
        source = F.when(hit, "portfolio_default").otherwise(source)
        status = F.when(hit, "mapped" if to else "ambiguous").otherwise(status)
        reason = F.when(hit, F.lit(why)).otherwise(reason)
    for portfolio, needle, to in reversed(list(overrides)):
        hit = (F.col("portfolio") == portfolio) & label.contains(needle.lower())
        target = F.when(hit, to).otherwise(target)
        source = F.when(hit, "program_label_override").otherwise(source)
        status = F.when(hit, "mapped").otherwise(status)
        reason = F.when(hit, F.lit(None)).otherwise(reason)
    return programs.select("*", status.alias("status"), target.alias("target"), source.alias("match_source"), reason.alias("reason"))


def crosswalk_coverage(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """A mapped program whose target node does not exist becomes unmapped, with the reason."""
    known = targets.select(F.col("name").alias("target")).distinct().withColumn("_k", F.lit(True))
    j = decisions.join(known, "target", "left")
    lost = (F.col("status") == "mapped") & F.col("_k").isNull()
    return (
        j.withColumn("reason", F.when(lost, F.concat(F.lit("target_node_not_found:"), "target")).otherwise(F.col("reason")))
        .withColumn("status", F.when(lost, "unmapped").otherwise(F.col("status")))
        .drop("_k")
    )


def target_edges(decisions: DataFrame, targets: DataFrame, existing: DataFrame, crosswalk_id: str) -> DataFrame:
    """One related edge from every edition of the target to the program."""
    t = targets.select(F.col("name").alias("target"), F.col("node_id").alias("parent_id"))
    pairs = decisions.where("status = 'mapped'").select("target", F.col("node_id").alias("child_id")).join(t, "target")
    made = _edges(pairs, "related_breakdown", F.lit(crosswalk_id), F.lit(CROSSWALK_PRIORITY), F.concat(F.lit("crosswalk:"), "target"))
    return only_new(made, existing)
