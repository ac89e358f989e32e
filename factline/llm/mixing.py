"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame operations only.

A source's target is filled by complete epochs of all its documents first.  What is left is filled by the documents with
the smallest exponential keys, ``-ln(u) / quality`` (the order of Efraimidis and Spirakis: the better a document, the
earlier it tends to come), up to the budget; the document on the edge gives its first words only.

No source is sorted as a whole.  Keys are dealt to buckets by their own value, bucket sums are added up within the
source, and only the documents of the one bucket that holds the edge of the budget are put in order.  A source of n
documents has about sqrt(n) buckets, so both the sums and the bucket stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.textual import word_count
from factline.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
LEAST_QUALITY = 0.05
#: Digits of a hash that make the uniform number of a document.
DIGITS = 13


def uniform(seed: str) -> Column:
    """A number in (0, 1) from the document's id: reruns agree, whatever the partitions."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def quality_weight(text: Column) -> Column:
    """Share of a text's characters that are letters, digits or blanks, twice penalised, at least LEAST_QUALITY."""
    odd = F.coalesce(F.regexp_count(text, F.lit(r"[^\p{L}\p{N} \n]")), F.lit(0))
    return F.greatest(F.lit(LEAST_QUALITY), 1 - 2 * odd / F.greatest(F.length(text), F.lit(1)))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """A row per source: source_size, n_docs, target.

    Sources by code point, null last, take the weights in turn.  Targets are ``weight * level``, cut at ``most`` times the
    source's size; the level is the one at which all targets add up to ``share`` of all words, which is where resharing the
    excess by weight ends.  It is found from the sources in the order in which they fill up.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    room = F.lit(float(most)) * F.col("source_size")
    ranked = sources.withColumn("w", weight).withColumn("room", room)
    by_fill = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("filled", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("turn", F.row_number().over(by_fill))
        .withColumn("fits", F.col("w") * (F.col("budget") - F.col("filled")) < F.col("room") * F.col("open_w"))
    )
    # the first source in this order that does not fill up gives the level for itself and all after it
    ranked = ranked.withColumn("at", F.min(F.when(F.col("fits"), F.struct("turn", (F.col("budget") - F.col("filled")).alias("left"), "open_w"))).over(everything))
    level = F.least(F.col("room"), F.col("w") * F.col("at.left") / F.col("at.open_w"))
    return ranked.select("source", "source_size", "n_docs", F.coalesce(level, F.col("room")).alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of ``docs`` (doc_id, text, source).

    ``taken`` counts the words that the mix takes of the document, repeats included; a source's ``taken`` add up to its
    target rounded down, and no document exceeds ``most`` times its size.  ``quality`` is any positive weight; null, NaN
    and anything below LEAST_QUALITY count as that.  Null and blank texts have size 0 and are taken 0 times; a null source
    is a source of its own, the last.  Equal keys are ordered by doc_id and size, so rows that are equal in both may
    exchange their shares and nothing else.  An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    quality = quality_weight(text) if quality is None else quality
    safe = F.greatest(F.when(F.isnan(quality), None).otherwise(quality), F.lit(LEAST_QUALITY))
    keyed = cut_lineage(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), (-F.ln(uniform(seed)) / safe).alias("key"))
    )
    plan = cut_lineage(
        source_targets(keyed.select("source", "size"), weights, share, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("buckets", F.ceil(F.sqrt(F.col("n_docs"))))
    )
    placed = keyed.join(plan, keyed["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")))
    sums = placed.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    edge = cut_lineage(
        sums.where((F.col("ahead") <= F.col("rest")) & (F.col("ahead") + F.col("words") > F.col("rest")))
        .groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", "ahead")).alias("edge"))
    )
    placed = placed.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    on_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    # without an edge the rest takes every document or none
    inside = F.when(F.col("edge").isNull(), F.col("rest") > 0).otherwise(F.col("bucket") < F.col("edge.bucket"))
    sure = placed.where(~on_edge).withColumn("more", F.when(inside, F.col("size")).otherwise(F.lit(0)))
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = placed.where(on_edge).withColumn("before", F.col("edge.ahead") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    split = split.withColumn("more", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))).drop("before")
    both = sure.unionByName(split)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken"))


#: The same mix on DuckDB, without buckets: each source is one ordered window.
MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5(concat('mix:', coalesce(doc_id::varchar, 'null'))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u,
         greatest(0.05, 1 - 2 * len(regexp_extract_all(coalesce(text, ''), '[^\p{L}\p{N} \n]'))::double / greatest(len(coalesce(text, '')), 1)) as q
  from documents),
s as (select source, sum(size)::double as z, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, case place % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2 * z as room, 1.5 * sum(z) over () as budget from s),
f as (select *, coalesce(sum(room) over o, 0) as filled, sum(w) over () - coalesce(sum(w) over o, 0) as open_w from w
      window o as (order by room / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select min((room / w)) filter (where w * (budget - filled) < room * open_w) as r from f),
a as (select max(budget - filled) as left_words, max(open_w) as open_w from f, l where room / w >= r),
t as (select source, z, case when a.open_w is null then room else least(room, f.w * a.left_words / a.open_w) end as target from f, a),
p as (select source, z, target, case when z > 0 then least(floor(target / z), 2) else 0 end as epochs from t),
k as (select d.doc_id, d.size, p.z, p.target, p.epochs, floor(p.target - p.epochs * p.z) as rest,
             coalesce(sum(d.size) over (partition by d.source order by -ln(d.u) / d.q, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join p on d.source is not distinct from p.source)
select doc_id, size, z::bigint as source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::bigint as taken from k
"""
