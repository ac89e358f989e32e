"""A text index that outlives its query: postings on shared storage, refreshed document by document.

Folder layout, all Parquet::

    postings/g=<generation>    (term, key, tf, dl): files of some documents each, every file sorted by the term
    documents/v=<version>      (key, digest, dl, g): every document, and the generation that holds its postings
    retired/v=<version>        (key, g): postings that no longer count
    versions/v=<version>       one row: generations, number of documents, their length, what they were made from

A refresh compares digests of the texts with those of the last version.  Only new and changed documents are tokenised, once, into a
generation of their own; changed and missing ones are retired.  No posting leaves the task that reads its text, and a task reads so few
texts that its postings are sorted in memory, whatever the size of the corpus: a search opens every file, but reads only the row groups and pages whose least and largest terms let its terms in.  The row under ``versions`` is written last: until then readers
open the version before, and a refresh that failed is simply run again.  A search reads its terms' postings, the
retired keys and that row, never a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factline.session import again, cut_lineage, drop_step, ensure_checkpoint_dir
from factline.sources.store import exists

TERM = r"[\p{L}\p{N}]+"
#: Generations, and the retired share of all documents ever added, from which a refresh merges all live postings into one.
GENERATIONS, RETIRED = 16, 0.5
#: Bytes of a file whose postings one task sorts, and of a row group of such a file; postings take some 17 times that in memory.
SORTED, GROUP = 16 << 20, 8 << 20


@dataclass(frozen=True)
class Index:
    """Live postings (term, key, tf, dl), and one row of corpus size and mean length."""

    postings: DataFrame
    corpus: DataFrame
    version: int


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)


def postings(lexed: DataFrame, key: str) -> DataFrame:
    """``(term, key, dl, tf)`` of rows with their ``terms``.

    A row's terms are all there: they are sorted in place, and where a term first stands and the next one begins gives how often it occurs.
    """
    sorted_ = lexed.select(key, F.size("terms").alias("dl"), F.inline(F.array(F.struct(F.array_sort("terms").alias("_t")))))
    at = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    first = sorted_.where("dl > 0").select(key, "dl", "_t", F.inline(F.array(F.struct(at.alias("_at")))))
    runs = F.transform("_at", lambda a, i: F.struct(F.get("_t", a).alias("term"), (F.coalesce(F.get("_at", i + 1), F.col("dl")) - a).cast("long").alias("tf")))
    return first.select(key, "dl", F.inline(runs)).select("term", key, "dl", "tf")


def _latest(spark: SparkSession, folder: str) -> Row | None:
    if not exists(spark, f"{folder}/versions"):
        return None
    return spark.read.parquet(f"{folder}/versions").orderBy(F.desc("v")).first()


def _small_tasks(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose tasks read little, for the sorts of postings alone."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for size in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        own.conf.set(size, str(SORTED))
    return own


def _store(rows: DataFrame, key: str, folder: str, generation: int) -> None:
    rows.sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{folder}/postings/g={generation}")


def _postings(spark: SparkSession, key: str, folder: str, row: Row) -> DataFrame:
    paths = [f"{folder}/postings/g={g}" for g in row["generations"]]
    every = spark.read.option("basePath", f"{folder}/postings").parquet(*paths)
    if not row["n_retired"]:
        return every
    gone = spark.read.parquet(f"{folder}/retired/v={row['v']}")
    return every.join(gone, [key, "g"], "left_anti")


def refresh(docs: DataFrame, key: str, text: Column, folder: str, made_from: str = "") -> Index:
    """Bring the index at ``folder`` up to ``docs``, which has one row per ``key``; builds it if there is none.

    Documents whose text is the same keep their postings; a null text is an empty one.  ``made_from`` is kept with the version.
    """
    spark, old = docs.sparkSession, _latest(docs.sparkSession, folder)
    version = old["v"] + 1 if old else 1
    now = docs.select(key, text.alias("_text"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))
    if old:
        known = spark.read.parquet(f"{folder}/documents/v={old['v']}")
        changed = now.join(known.select(key, "digest"), [key, "digest"], "left_anti")
    else:
        changed = now
    lexed = cut_lineage(changed.select(key, "digest", terms_of(F.col("_text")).alias("terms")), GROUP)
    _store(postings(again(_small_tasks(spark), lexed), key), key, folder, version)
    added = lexed.select(key, "digest", F.size("terms").alias("dl"), F.lit(version).alias("g"))
    generations, n_retired = [version], 0
    if old:
        kept = known.join(now.select(key, "digest"), [key, "digest"], "left_semi")
        added = kept.unionByName(added)
        gone = known.join(now.select(key, "digest"), [key, "digest"], "left_anti").select(key, "g")
        if old["n_retired"]:
            gone = gone.unionByName(spark.read.parquet(f"{folder}/retired/v={old['v']}"))
        gone.write.mode("overwrite").parquet(f"{folder}/retired/v={version}")
        n_retired = spark.read.parquet(f"{folder}/retired/v={version}").count()
        generations = [*old["generations"], version]
    added.write.mode("overwrite").parquet(f"{folder}/documents/v={version}")
    drop_step(lexed)
    documents = spark.read.parquet(f"{folder}/documents/v={version}")
    size = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    row = Row(v=version, generations=generations, n=size["n"], length=size["length"], n_retired=n_retired, made_from=made_from)
    if len(generations) > GENERATIONS or n_retired > RETIRED * (n_retired + size["n"]):
        row = _merged(spark, key, folder, row)
    _publish(spark, folder, row)
    return open_index(spark, folder, key)


def _merged(spark: SparkSession, key: str, folder: str, row: Row) -> Row:
    """All live postings as one generation of the next version, from postings alone."""
    to = row["v"] + 1
    _store(_postings(_small_tasks(spark), key, folder, row).drop("g"), key, folder, to)
    spark.read.parquet(f"{folder}/documents/v={row['v']}").withColumn("g", F.lit(to)).write.mode("overwrite").parquet(f"{folder}/documents/v={to}")
    return Row(**(row.asDict() | {"v": to, "generations": [to], "n_retired": 0}))


def _publish(spark: SparkSession, folder: str, row: Row) -> None:
    schema = "generations array<int>, n long, length long, n_retired long, made_from string"
    values = [(row["generations"], row["n"], row["length"], row["n_retired"], row["made_from"])]
    spark.createDataFrame(values, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/v={row['v']}")


def open_index(spark: SparkSession, folder: str, key: str) -> Index:
    row = _latest(spark, folder)
    if row is None:
        raise FileNotFoundError(f"no index at {folder}")
    corpus = spark.read.parquet(f"{folder}/versions").where(F.col("v") == row["v"]).select("n", (F.col("length") / F.col("n")).alias("avgdl"))
    return Index(_postings(spark, key, folder, row).drop("g"), corpus, row["v"])


def indexes_folder(spark: SparkSession) -> str:
    """Where indexes stay when the steps of a query are deleted."""
    return f"{ensure_checkpoint_dir(spark)}/factline-indexes"


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """One value for the files of some tables, from their listing; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    return str(files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first())


def kept_index(spark: SparkSession, name: str, key: str, docs, text: Column, made_from: list[str]) -> Index:
    """The index ``name`` over what ``docs()`` gives, opened if the files it was made from are as they were, else refreshed."""
    folder, state = f"{indexes_folder(spark)}/{name}", state_of(spark, made_from)
    row = _latest(spark, folder)
    if row is not None and row["made_from"] == state:
        return open_index(spark, folder, key)
    return refresh(docs(), key, text, folder, state)
