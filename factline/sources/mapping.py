"""Mapping-driven projection: a mapping is a plain dict, the result is one lazy select."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default key template and the mapping sections that merge deeply.
KEY_TEMPLATE = "{source_id}|{financial_year}|{node_name}|{measure_type}|{estimate_status}"
DEEP_SECTIONS = ("input", "columns", "attribution")


def inherit(child: Mapping[str, Any], base: Mapping[str, Any]) -> dict[str, Any]:
    """Child over base: shallow, but input, columns and attribution merge key by key."""
    merged = {**base, **{k: v for k, v in child.items() if k != "extends"}}
    for section in DEEP_SECTIONS:
        if isinstance(child.get(section), Mapping) and isinstance(base.get(section), Mapping):
            merged[section] = {**base[section], **child[section]}
    return merged


def project(raw: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Logical names over physical columns; ``literal:x`` becomes a constant."""
    picked = []
    for logical, physical in columns.items():
        value = F.lit(physical[len("literal:"):]) if physical.startswith("literal:") else F.col(f"`{physical}`")
        picked.append(value.alias(logical))
    return raw.select(*picked)


def _blank_to_null(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.trim(text) == "", F.lit(None)).otherwise(c)


def stamp(rows: DataFrame, mapping: Mapping[str, Any]) -> DataFrame:
    """Mapping values on every row; a row's own status wins; NaN and blank citations become null."""
    out = rows
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            out = out.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    for name in ("landing_url", "original_resource_url", "locator"):
        if name in out.columns:
            out = out.withColumn(name, _blank_to_null(F.col(name)))
    own = F.nullif(F.trim("estimate_status"), F.lit("")) if "estimate_status" in out.columns else F.lit(None).cast("string")
    out = out.withColumn("estimate_status", F.coalesce(own, F.lit(mapping.get("estimate_status"))))
    for name in ("source_id", "measure_type", "accounting_basis", "period_granularity"):
        out = out.withColumn(name, F.lit(mapping.get(name)).cast("string"))
    attribution = mapping.get("attribution", {})
    for name in ("landing_url", "original_resource_url"):
        if name in attribution and f"{name}_column" not in attribution:
            out = out.withColumn(name, F.lit(attribution[name]))
    return out


def attribute(rows: DataFrame, mapping: Mapping[str, Any], files: DataFrame) -> DataFrame:
    """File path, hash and retrieval time per row, from a manifest ``(path, sha256, retrieved_at)``.

    A row names its own file when the mapping says which column holds it; a file the manifest does not
    know falls back to the mapping's file.  Rows meet the manifest by path, at any size; the mapping's
    own file is one value.  Of several retrievals of a path the latest counts.
    """
    attribution = mapping.get("attribution", {})
    fixed = attribution.get("cached_copy_path") or mapping.get("input", {}).get("path")
    column = attribution.get("cached_copy_path_column")
    entry = F.struct("sha256", "retrieved_at")
    latest = F.max_by(entry, F.struct("retrieved_at", "sha256"))
    home = files.where(F.col("path") == fixed).agg(latest).scalar()
    if column:
        known = files.groupBy(F.col("path").alias("_own")).agg(latest.alias("_file"))
        rows = rows.withColumn("_own", F.nullif(F.trim(column), F.lit(""))).join(known, "_own", "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("string")).withColumn("_file", F.lit(None).cast("struct<sha256:string,retrieved_at:string>"))
    j = rows.withColumn("_home", home)
    used = F.coalesce("_file", "_home")
    return (
        j.withColumn("cached_copy_path", F.when(F.col("_file").isNotNull(), F.col("_own")).when(F.col("_home").isNotNull(), F.lit(fixed)))
        .withColumn("sha256", used["sha256"])
        .withColumn("retrieved_at", used["retrieved_at"])
        .drop("_own", "_file", "_home")
    )


def fact_key(rows: DataFrame, template: str = KEY_TEMPLATE) -> Column:
    """The template as one concatenation; a missing node name falls back to the category, then to ''."""
    parts = []
    for literal, name in re.findall(r"([^{}]+)|\{(\w+)\}", template):
        if literal:
            parts.append(F.lit(literal))
        elif name == "node_name":
            options = [F.col(c) for c in ("node_name", "category") if c in rows.columns]
            parts.append(F.coalesce(*options, F.lit("")))
        else:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("None")))
    return F.concat(*parts)


def extract(raw: DataFrame, mapping: Mapping[str, Any], files: DataFrame) -> DataFrame:
    """Projection, stamping, attribution and key in one plan."""
    rows = attribute(stamp(project(raw, mapping["columns"]), mapping), mapping, files)
    return rows.withColumn("fact_key", fact_key(rows, mapping.get("fact_key_template", KEY_TEMPLATE)))
