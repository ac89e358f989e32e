"""Descending edges level by level, for all roots at once.

The loop runs over depth until no level is left, never over nodes.  A node that is already on its own path is not
entered again, so cycles end.  Each level is written, so the plan stays short and a lost executor re-reads one level
instead of replaying the descent.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.graph.edges import display_name
from factline.graph.facts import fact_or_fallback
from factline.operators.ordered import first_per_key
from factline.session import cut_lineage

# What a year's fact brings along.
FACT_COLS = ("fact_id", "amount_aud", "fact_financial_year", "fact_source", "compatibility_group", "estimate_status", "is_year_fallback", "fallback_reason")


def child_edges(edges: DataFrame, nodes: DataFrame, kind: str, year: str) -> DataFrame:
    """Edges of a kind valid in a year, one per (parent, child): highest priority, then name, then note."""
    names = nodes.select(F.col("node_id").alias("child_id"), F.col("name").alias("child_name"), F.col("source_key").alias("child_source"))
    e = edges.where((F.col("edge_kind") == kind) & (F.col("financial_year").isNull() | (F.col("financial_year") == year)))
    e = e.join(names, "child_id").select("parent_id", "child_id", "child_name", "child_source", "priority", "notes")
    return first_per_key(e, ["parent_id", "child_id"], [-F.col("priority"), F.col("child_name"), F.col("notes")])


def year_facts(facts: DataFrame, year: str, nearest: bool) -> DataFrame:
    """The fact of every node for one year, with or without the nearest-earlier fallback."""
    f = facts.withColumn("_start", F.substring("financial_year", 1, 4).cast("int"))
    target = int(year[:4])
    if not nearest:
        f = f.where(F.col("_start") == target)
    chosen = fact_or_fallback(f, "node_id", "_start", "source_key", target=target)
    return chosen.drop("target").withColumnRenamed("financial_year", "fact_financial_year").withColumnRenamed("source", "fact_source")


def _step(frontier: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    own = edges.withColumnRenamed("parent_id", "node_id")
    j = frontier.select("root_id", F.col("path").alias("up"), "node_id", F.col("name").alias("parent_name")).join(own, "node_id")
    j = j.withColumnRenamed("node_id", "parent_id").withColumnRenamed("child_id", "node_id").withColumnRenamed("child_name", "name")
    j = j.where(~F.array_contains("up", F.col("node_id"))).join(facts, "node_id")
    j = j.withColumn("label", display_name(F.col("name"), F.col("parent_name")))
    # equal labels under one parent overwrite each other; the last in edge order stands
    j = first_per_key(j, ["root_id", "up", "label"], [F.col("priority"), F.col("node_id")])
    return j.withColumn("path", F.concat("up", F.array("node_id"))).drop("up", "parent_name")


def descend(roots: DataFrame, edges: DataFrame, facts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rows ``(root_id, path, node_id, parent_id, label, ...)`` of every node below the roots.

    A child without a fact stops its branch, and so does one that is on its own path.  ``roots`` needs
    ``root_id, path, node_id, name``.  If there is more below ``max_depth`` levels, that is an error, not a cut.
    """
    edges, facts = cut_lineage(edges), cut_lineage(facts)
    found: DataFrame | None = None
    frontier = roots
    for level in count(1):
        step = cut_lineage(_step(frontier, edges, facts))
        if step.isEmpty():
            break
        if max_depth is not None and level > max_depth:
            raise ValueError(f"nodes below level {max_depth}")
        found = step if found is None else found.unionByName(step)
        frontier = step
    if found is None:
        found = _step(frontier, edges, facts)
    return found.withColumn("depth", F.size("path") - 1)


def as_roots(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("root_id"), F.array("node_id").alias("path"), "node_id", "name")


def same_group_tree(roots: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, year: str, nearest: bool = False) -> DataFrame:
    return descend(as_roots(roots), child_edges(edges, nodes, "same_group", year), year_facts(facts, year, nearest))


def match_quality(notes):
    return F.when(notes.contains("|exact"), "exact").otherwise("approx")


def related_tree(
    roots: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, year: str, sources: Sequence[str] = ()
) -> DataFrame:
    """Related children of the roots and everything additive below them, years falling back when needed."""
    related = child_edges(edges, nodes, "related_breakdown", year)
    if sources:
        keep = F.lit(False)
        for s in sources:
            keep = keep | F.col("child_source").startswith(s)
        related = related.where(keep)
    chosen = cut_lineage(year_facts(facts, year, True))
    first = cut_lineage(_step(as_roots(roots), related, chosen).withColumn("match_quality", match_quality(F.col("notes"))))
    below = descend(first, child_edges(edges, nodes, "same_group", year), chosen)
    quality = first.select("root_id", F.element_at("path", 2).alias("_top"), "match_quality")
    below = below.withColumn("_top", F.element_at("path", 2)).join(quality, ["root_id", "_top"], "left").drop("_top")
    return first.withColumn("depth", F.size("path") - 1).unionByName(below)


def tag_non_additive(tree: DataFrame, year: str) -> DataFrame:
    """Disclosure on every row of a related tree, the year mismatch of a descendant included.

    A row with its own fallback reports it upwards as far as the next ancestor that has one of its own;
    that reach is known from the ancestors' rows, so one aggregate replaces a bottom-up walk.
    """
    rows = tree.withColumn("own_fy", F.when(F.col("is_year_fallback"), F.col("fact_financial_year")))
    own = rows.where(F.col("own_fy").isNotNull()).select("root_id", F.col("path").alias("anc"), F.size("path").alias("_at"))
    spread = rows.where(F.col("own_fy").isNotNull()).select("root_id", "path", "own_fy", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("_n"))
    spread = spread.where(F.col("_n") < F.size("path")).withColumn("anc", F.slice("path", F.lit(1), F.col("_n")))
    barrier = spread.join(own, ["root_id", "anc"]).groupBy("root_id", "path").agg(F.max("_at").alias("_stop"))
    reach = spread.join(barrier, ["root_id", "path"], "left").where(F.col("_n") > F.coalesce("_stop", F.lit(0)))
    nested = reach.groupBy("root_id", F.col("anc").alias("path")).agg(F.min("own_fy").alias("nested_fy"))
    j = rows.join(nested, ["root_id", "path"], "left")
    top = F.col("depth") == 1
    reason = F.when(top | F.col("is_year_fallback"), F.col("fallback_reason"))
    effective = F.coalesce("own_fy", "nested_fy")
    return j.select(
        *tree.columns,
        F.lit("related_breakdown").alias("kind"),
        effective.alias("disclosed_financial_year"),
        F.lit(year).alias("requested_financial_year"),
        (F.col("is_year_fallback") | (effective.isNotNull() & F.col("own_fy").isNull())).alias("disclosed_fallback"),
        F.when(F.col("own_fy").isNotNull(), reason)
        .otherwise(F.when(effective.isNotNull(), F.lit("nested_child_year_mismatch")).otherwise(reason))
        .alias("disclosed_reason"),
        F.col("fact_source").alias("source_budget_edition"),
        F.when(top | F.col("is_year_fallback"), F.col("estimate_status")).alias("disclosed_status"),
    )


def related_parent(labels: DataFrame, nodes: DataFrame, edges: DataFrame, source: str, aliases: dict[str, str]) -> DataFrame:
    """Node with related edges that stands for a purpose label: itself, an alias, a Total, a note."""
    has = edges.where("edge_kind = 'related_breakdown'").select(F.col("parent_id").alias("node_id"), "notes")
    own = nodes.where(F.col("source_key").startswith(source)).join(has, "node_id")
    named = own.groupBy(F.col("name").alias("_n")).agg(F.min("node_id").alias("parent_id"))
    noted = own.groupBy(F.split("notes", "→")[0].alias("_n")).agg(F.min("node_id").alias("parent_id"))
    rest = F.trim(F.regexp_replace("label", r"(?i)^total\s+", ""))
    base = F.concat(F.upper(F.substring(rest, 1, 1)), rest.substr(F.lit(2), F.length(rest)))
    if aliases:
        lookup = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        base = F.coalesce(F.try_element_at(lookup, F.lower(base)), base)
    lowered = F.concat(F.lower(F.substring("_base", 1, 1)), F.col("_base").substr(F.lit(2), F.length("_base")))
    spread = labels.withColumn("_base", base).withColumn(
        "_c", F.array(F.col("_base"), F.concat(F.lit("Total "), "_base"), F.concat(F.lit("Total "), lowered))
    )
    spread = spread.select("label", "_base", F.posexplode("_c").alias("_t", "_n"))
    hits = spread.join(named, "_n").select("label", "_t", "parent_id")
    by_note = spread.where("_t = 0").join(noted, "_n").select("label", F.lit(9).alias("_t"), "parent_id")
    best = hits.unionByName(by_note).groupBy("label").agg(F.min_by("parent_id", F.struct("_t", "parent_id")).alias("parent_id"))
    return labels.join(best, "label", "left").select("label", "parent_id")


def attach_related(leaves: DataFrame, related: DataFrame, folder: str, as_folder: DataFrame) -> DataFrame:
    """Related rows re-rooted under tree nodes: inside a named folder where the node has children of its own."""
    first = related.join(leaves.select(F.col("node_id").alias("root_id"), F.col("tree_path"), "has_children"), "root_id")
    mid = F.when(F.col("has_children"), F.array(F.lit(folder))).otherwise(F.array().cast("array<string>"))
    rows = first.withColumn("tree_path", F.concat("tree_path", mid, "label_path"))
    folders = as_folder.where("has_children").join(related.select(F.col("root_id").alias("node_id")).distinct(), "node_id", "left_semi")
    heads = folders.select(
        F.concat("tree_path", F.array(F.lit(folder))).alias("tree_path"), "amount_aud", F.lit("related_folder").alias("role")
    )
    return heads.unionByName(rows.select("tree_path", "amount_aud", F.lit("related_breakdown").alias("role")))


def edges_replace_paths(tree: DataFrame, cascade: DataFrame) -> DataFrame:
    """Nodes with additive edges take those children; their path children, and all below, drop out."""
    replaced = cascade.select("root_id").distinct()
    owners = tree.join(replaced, tree.node_id == replaced.root_id, "left_semi").select(F.col("path").alias("_anc"))
    spread = tree.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("_n"))
    spread = spread.where(F.col("_n") < F.size("path")).withColumn("_anc", F.slice("path", F.lit(1), F.col("_n")))
    gone = spread.join(owners, "_anc", "left_semi").select("path").distinct()
    kept = tree.join(gone, "path", "left_anti").select("path", "node_id", "amount_aud", F.lit("path").alias("via"))
    tops = kept.select(F.col("node_id").alias("root_id"), F.col("path").alias("_base"))
    hung = cascade.join(tops, "root_id").select(
        F.concat("_base", "label_path").alias("path"), "node_id", "amount_aud", F.lit("edge").alias("via")
    )
    return kept.unionByName(hung)


def with_label_paths(tree: DataFrame) -> DataFrame:
    """Labels along each row's path, by exploding its ancestors once."""
    spread = tree.select("root_id", "path", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("_n"))
    spread = spread.withColumn("_p", F.slice("path", F.lit(1), F.col("_n")))
    labels = tree.select("root_id", F.col("path").alias("_p"), "label")
    # the collected list is as long as the path that the row itself holds
    j = spread.join(labels, ["root_id", "_p"]).groupBy("root_id", "path").agg(F.collect_list(F.struct("_n", "label")).alias("_l"))
    j = j.select("root_id", "path", F.transform(F.array_sort("_l"), lambda s: s["label"]).alias("label_path"))
    return tree.join(j, ["root_id", "path"])


def ancestry(edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """(rows (ancestor, node, hops), longest hops, whether there is a cycle): one row for each number of hops between two nodes.

    Built by doubling: after k rounds all ways of up to 2 ** k hops are known, and the next round puts ways of just that many
    after all of them, so depth d takes about log d rounds.  However many ways lead between two nodes, those
    of one length are one row.  The rounds end at the first cycle, and the rows are then not complete.
    """
    known = cut_lineage(edges.select(F.col("parent_id").alias("ancestor"), F.col("child_id").alias("node"), F.lit(1).alias("hops")).where(F.col("ancestor").isNotNull() & F.col("node").isNotNull()).distinct())
    longest = 1
    while True:
        seen = known.agg(F.coalesce(F.max("hops"), F.lit(0)).alias("hops"), F.coalesce(F.max(F.col("ancestor") == F.col("node")), F.lit(False)).alias("cycle")).first()
        if seen["cycle"] or seen["hops"] < longest:
            return known, seen["hops"], seen["cycle"]
        onward = known.where(F.col("hops") == longest).select("ancestor", F.col("node").alias("_mid"))
        rest = known.select(F.col("ancestor").alias("_mid"), "node", "hops")
        longer = onward.join(rest, "_mid").select("ancestor", "node", (F.col("hops") + longest).alias("hops")).distinct()
        # ways longer than all known ones only: the others have been found
        known = cut_lineage(known.unionByName(longer))
        longest *= 2


def roll_up_hierarchy(root: DataFrame, edges: DataFrame, amounts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rows (root_id, node_id, depth, amount_aud): all nodes below each root with the sum of their direct facts, zero when none.

    A node that is reached at several depths has a row for each.  In a hierarchy with a cycle a node that is on its own path is
    not entered again.  If there is more below ``max_depth`` levels, that is an error, not a cut.
    """
    roots = root.select(F.col("node_id").alias("root_id")).distinct()
    reach, deepest, cycle = ancestry(edges)
    if cycle:
        below, deepest = _simple_paths(roots, edges)
    else:
        below = reach.join(roots, F.col("ancestor") == F.col("root_id")).select("root_id", F.col("node").alias("node_id"), F.col("hops").alias("depth"))
        if max_depth is not None and deepest > max_depth:
            deepest = below.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    if max_depth is not None and deepest > max_depth:
        raise ValueError(f"nodes below level {max_depth}")
    found = roots.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("depth")).unionByName(below)
    direct = amounts.groupBy("node_id").agg(F.sum("amount_aud").alias("amount_aud"))
    return found.join(direct, "node_id", "left").select("root_id", "node_id", "depth", F.coalesce("amount_aud", F.lit(0.0)).alias("amount_aud"))


def _simple_paths(roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Nodes and depths by paths that enter no node twice, level by level; only for hierarchies with a cycle."""
    step = edges.select(F.col("parent_id").alias("node_id"), "child_id")
    frontier = roots.select("root_id", F.col("root_id").alias("node_id"), F.array("root_id").alias("path"))
    found = frontier.select("root_id", "node_id", F.lit(0).alias("depth")).limit(0)
    for d in count(1):
        down = frontier.join(step, "node_id").where(~F.array_contains("path", F.col("child_id")))
        frontier = cut_lineage(down.select("root_id", F.col("child_id").alias("node_id"), F.concat("path", F.array("child_id")).alias("path")).distinct())
        if frontier.isEmpty():
            return found, d - 1
        found = found.unionByName(frontier.select("root_id", "node_id", F.lit(d).alias("depth")).distinct())
