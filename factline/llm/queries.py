"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.session import cut_lineage, read_table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.mixing import mix

    return mix(read_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _remainder(by: int):
    """crc32 of the id as text modulo ``by``; null ids have that of an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm import toxicity

    docs, held_out = read_table(spark, folder, "documents"), _remainder(3) == 1
    model = toxicity.fit(docs, read_table(spark, folder, "labels"), ~held_out)
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.simhash import fingerprint_hex, near_components

    near = near_components(read_table(spark, folder, "documents"), shingle=4, distance=4)
    return near.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm import langid

    docs, held_out = read_table(spark, folder, "documents"), _remainder(5) == 0
    model = langid.fit(docs, ~held_out)
    found = langid.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.chat import rotate

    return rotate(read_table(spark, folder, "conversations"))


def op6_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.extraction import with_main_text

    return with_main_text(read_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.decontamination import leaks

    return leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.warc import convert_pages, read_archives

    archive = convert_pages(read_table(spark, folder, "pages"), least_bytes=0)
    return read_archives(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.repeats import with_repeats_removed

    cut = with_repeats_removed(read_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", "_cut.kept_sha256")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm import rules as R

    counted = cut_lineage(R.with_counts(read_table(spark, folder, "documents")).select("doc_id", "lang", "_counts"))
    cutoffs = R.fit_cutoffs(counted, read_table(spark, folder, "labels"))
    out = counted.withColumn("base_failed", R.base_failed())
    return out.select(
        "doc_id", *[F.col(f"_counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", (~F.col("base_failed") & ~cutoffs.rejects()).alias("kept"),
    )


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.minhash import near_classes

    return near_classes(read_table(spark, folder, "documents"), shingle=2, percent=80)


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_ranking(spark: SparkSession, folder: str) -> DataFrame:
    from factline.llm.lexical import rank_documents

    return rank_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), take=20)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_simhash, op4_language, op5_chat, op6_extraction, op7_decontamination, op8_warc, op9_repeats, op10_quality, op11_minhash, op12_negatives, op13_ranking, pipeline)}


def sql() -> dict[str, str]:
    from factline.llm.chat import ROTATE_SQL
    from factline.llm.lexical import RANK_SQL
    from factline.llm.minhash import CLASSES_SQL
    from factline.llm.mixing import MIX_SQL
    from factline.llm.negatives import HARD_NEGATIVES_SQL

    return {"op1_mixing": MIX_SQL, "op5_chat": ROTATE_SQL, "op11_minhash": CLASSES_SQL, "op12_negatives": HARD_NEGATIVES_SQL, "op13_ranking": RANK_SQL}
