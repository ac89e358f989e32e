"""The corpus pipeline: five stages over ``documents``, each by one operator of ``factline.llm``.

Every stage takes all its predecessor kept, with its texts as they are then, and is written as Parquet in the shared
folder before the next one reads it.  All but the last return the columns of ``documents``; n_chars follows the text.

Rows with a null id stay in every stage that compares documents by id; benchmark leaks are told by id and text, null ids included.  Rows with equal ids and texts
are one document given several times: near-duplicate removal keeps one of them.  If their texts differ, each is a document.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm import decontamination, mixing, repeats, rules, simhash
from factline.session import cut_lineage, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; cutoffs are fitted on the labelled ones among ``docs``."""
    docs = docs.select(*COLUMNS)
    counted = cut_lineage(rules.with_counts(docs).select("doc_id", "lang", "_counts"))
    cutoffs = rules.fit_cutoffs(counted, read_table(spark, sf_dir, "labels"))
    return rules.with_counts(docs).where(~rules.base_failed() & ~cutoffs.rejects()).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of equal ids the one with the smallest hash of its text.

    Of rows with equal ids and texts the least by the other columns stays.
    """
    docs = docs.select(*COLUMNS)
    groups = simhash.near_groups(docs.select("doc_id", "text"))
    heads = groups.select(F.col("component_id").alias("_id"), F.col("first_text").alias("_text")).distinct()
    kept = docs.join(heads, (F.col("doc_id") == F.col("_id")) & (simhash.text_key() == F.col("_text")), "left_semi")
    kept = kept.groupBy(F.col("doc_id").alias("_id"), simhash.text_key().alias("_text")).agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that also start earlier are cut out of the texts; no document goes."""
    cut = repeats.with_repeats_removed(docs.select(*COLUMNS))
    changed = F.col("_cut.n_removed") > 0
    return cut.select(
        "doc_id", F.when(changed, F.col("_cut.kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("_cut.kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go; rows with equal ids, or without one, are judged by their own texts."""
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = decontamination.leaks(docs.select(row.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    found = found.select(F.col("doc_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(found, row == F.col("_id"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each; those of which it takes nothing go."""
    return mixing.mix(docs).where(F.col("taken") > 0).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else cut_lineage(out)
    return docs
