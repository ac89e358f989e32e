"""MinHash near-duplicates: one-permutation sketches with optimal densification, banded buckets, star-shaped candidates.

A set's hashes are dealt once to BINS bins by their upper half, and each bin keeps the least lower half.  For the bands, an empty bin takes
the value of the first filled bin in an order of its own, drawn at random once for all sets: this is the densification whose
bins agree with chance equal to the similarity and as little variance as can be.  Bands of r bins make bucket keys.  Two sets of
similarity s meet in one of b bands with chance 1 - (1 - s ** r) ** b; r and b are chosen so that MISS of the pairs at the limit do not.

A bucket gives a star, not all its pairs: each member is paired with the bucket's hub, the member whose buckets are the most
crowded, which among edited copies is most like the original.  Pairs are confirmed on full sets, and confirmed ones make
components.  Only where a bucket's members are still in several components can a link be missing.  There, members outside the
bucket's largest component are compared with all others by their sketches, block against block, and pairs of different
components whose sketches agree well enough are confirmed on full sets as well.  So stars bound the pairs, and nothing that
met is left unjudged: a pair at the limit is passed over with chance below 1 in 100,000, by SLACK standard deviations of the
share of agreeing bins among those that either set fills.

Sets are sets of 64-bit hashes, distinct sets are one row each however many documents have them, and a hub's set is sent
to as many tasks as its star needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.components import components
from factline.llm.textual import encoded
from factline.session import cut_lineage

SEED = 42
BINS = 640
#: Share of pairs at the limit that may meet in no band, and bands at most.
MISS, BANDS = 3e-6, 40
#: Standard deviations of the sketch's estimate that a pair at the limit may fall short.
SLACK = 4.3
#: Sets in a block of an open bucket, and members of a star that meet their hub in one group.
BLOCK, STAR = 512, 1024
#: Words whose hashes a task remembers.
KNOWN_WORDS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Row i: for each bin, its place in the order in which bin i looks for a filled one.
_PLACE = np.argsort(np.random.default_rng(SEED).random((BINS, BINS)), axis=1).astype(np.uint16)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, A-Z lowered; fewer words make one shingle of all, no word none."""
    words = encoded(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _WordHashes() if known is None else known
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _stir(out * _ODD + each[k : k + n])
    return np.unique(out)


def minima(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filled bins of a set that is not empty, in order, and their 32-bit minima."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    start = np.flatnonzero(np.diff(bins, prepend=-1))
    return bins[start], np.minimum.reduceat(hashes.astype(np.uint32), start)


def densified(filled: np.ndarray, least: np.ndarray, bins: int) -> np.ndarray:
    """Values of the first ``bins`` bins, empty ones filled."""
    out = np.zeros(BINS, np.uint32)
    out[filled] = least
    empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
    out[empty] = least[np.argmin(_PLACE[empty[:, None], filled[None, :]], axis=1)]
    return out[:bins]


def sketch(filled: np.ndarray, least: np.ndarray) -> bytes:
    """A byte of each bin's minimum, and a bit for each bin that is filled."""
    value, has = np.zeros(BINS, np.uint8), np.zeros(BINS, np.uint8)
    value[filled], has[filled] = least.astype(np.uint8), 1
    return value.tobytes() + np.packbits(has).tobytes()


def banding(similarity: float) -> tuple[int, int]:
    """Bands and bins in a band: as many bins as BANDS bands allow for, or one with a band for each bin."""
    for r in range(10, 0, -1):
        b = math.ceil(math.log(MISS) / math.log1p(-(similarity**r))) if similarity < 1 else 1
        if b <= BANDS:
            return b, r
    return BINS, 1


def band_keys(values: np.ndarray, bands: int) -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), band)) for band, r in enumerate(values.reshape(bands, -1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def least_agreement(either: np.ndarray, union: np.ndarray, similarity: float) -> np.ndarray:
    """Bins that must agree of those that either of two sets fills, for sets whose union has so many members at that similarity.

    The share of agreeing bins has the mean of the similarity; its variance falls to nothing as bins hold one member each.
    """
    rest = 1 / np.maximum(union - 1, 1)
    variance = similarity * (1 - similarity) * np.maximum(0, (1 + rest) / np.maximum(either, 1) - rest)
    return (similarity - SLACK * np.sqrt(variance)) * either - 1


def _sketched(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    bands, bins = banding(percent / 100)

    @F.pandas_udf("digest long, n long, sketch binary, keys array<long>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for texts in batches:
            rows = []
            for text in texts:
                found = shingle_set(text, shingle, known)
                if not len(found):
                    rows.append((None, 0, None, None))
                    continue
                filled, least = minima(found)
                digest = _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                rows.append((digest, len(found), sketch(filled, least), band_keys(densified(filled, least, bands * bins), bands)))
            digests, n, sketches, keys = zip(*rows, strict=True) if rows else [[]] * 4
            # a column of numbers and nulls must not become one of doubles
            yield pd.DataFrame({"digest": pd.array(digests, dtype="Int64"), "n": n, "sketch": sketches, "keys": keys})

    return docs.select("doc_id", prints("text").alias("p")).select("doc_id", "p.*")


def _full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Rows (digest, hashes) of the wanted digests; each is read from one document that has it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            digests, hashes = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(text, shingle, known)
                # rows with equal ids, or without one, may have other texts: only those with the wanted set count
                if _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)) == digest:
                    digests.append(digest)
                    hashes.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["digest", "hashes"])

    ids = cut_lineage(wanted.join(sets, "digest").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_wanted")))
    # the wanted ids grow with the table: they are never broadcast
    texts = docs.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("_wanted", "text")
    return texts.mapInArrow(read, "digest long, hashes array<long>").groupBy("digest").agg(F.any_value("hashes").alias("hashes"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) with 100 * intersection >= percent * union; b is the end that many pairs may share."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("shares"))
    hubs = known.join(shares, known["digest"] == shares["b"]).select("b", F.col("hashes").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = pairs.join(shares, "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int")).drop("shares")
    both = dealt.join(known.select(F.col("digest").alias("a"), F.col("hashes").alias("ha")), "a").join(hubs, ["b", "share"])
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * common >= percent * (F.size("ha") + F.size("hb") - common)).select("a", "b")


class _Members:
    """A block of a bucket's members."""

    def __init__(self, rows: pa.StructArray):
        self.digest, self.comp, self.n, self.main = (rows.field(f).to_numpy(zero_copy_only=False) for f in ("digest", "comp", "n", "main"))
        raw = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(rows), -1)
        self.value, self.has = raw[:, :BINS], np.unpackbits(raw[:, BINS:], axis=1).view(bool)
        self.keys = rows.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _agreeing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For two blocks of a bucket the pairs (a, b) of different components whose sizes and sketches allow the similarity.

    A pair is named only in the first of the bands where it meets.
    """
    for batch in batches:
        a, b = [], []
        for key, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            x, y = _Members(x.values), _Members(y.values)
            may = (x.comp[:, None] != y.comp[None, :]) & (y.main[None, :] | (x.digest[:, None] < y.digest[None, :]))
            may &= 100 * np.minimum(x.n[:, None], y.n[None, :]) >= percent * np.maximum(x.n[:, None], y.n[None, :])
            for at in np.flatnonzero(may.any(axis=1)):
                to = np.flatnonzero(may[at])
                agree = ((y.value[to] == x.value[at]) & y.has[to] & x.has[at]).sum(axis=1)
                either = (y.has[to] | x.has[at]).sum(axis=1)
                union = (x.n[at] + y.n[to]) / (1 + percent / 100)
                to = to[agree >= least_agreement(either, union, percent / 100)]
                met = y.keys[to] == x.keys[at]
                to = to[x.keys[at][np.argmax(met, axis=1)] == key] if len(to) else to
                a.append(np.full(len(to), x.digest[at]))
                b.append(y.digest[to])
        ends = [pa.array(np.concatenate(e) if e else np.zeros(0, np.int64)) for e in (a, b)]
        yield pa.RecordBatch.from_arrays(ends, ["a", "b"])


def _open_pairs(met: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Candidates that stars left open: members of a bucket outside its largest component against all of other components."""
    placed = cut_lineage(met.join(comps, "digest", "left").select("key", "digest", F.coalesce("root", "digest").alias("comp")))
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    buckets = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("in_main"))
    buckets = cut_lineage(buckets.where(F.col("all") > F.col("in_main")))
    several = placed.join(buckets, "key").select("key", "digest", "comp", (F.col("comp") == F.col("main")).alias("main"), "all", (F.col("all") - F.col("in_main")).alias("open"))
    several = cut_lineage(several.join(sets.select("digest", "n", "sketch", "keys"), "digest"))
    member = F.struct("digest", "comp", "n", "sketch", "main", "keys")

    def blocks(rows: DataFrame, count: str, name: str, no: str) -> DataFrame:
        dealt = rows.withColumn(no, F.pmod(F.xxhash64("digest"), F.ceil(F.col(count) / BLOCK)))
        return dealt.groupBy("key", no).agg(F.collect_list(member).alias(name))

    left = blocks(several.where(~F.col("main")), "open", "x", "i")
    pairs = left.join(blocks(several, "all", "y", "j"), "key").repartition("key", "i", "j").select("key", "x", "y")
    return pairs.mapInArrow(lambda x: _agreeing(x, percent), "a long, b long").distinct()


def near_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs`` (doc_id, text).

    Texts whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest doc_id reached
    over links, the document itself included.  Null, empty and blank texts have the empty set and no links: their component is
    their own id.  A very long text is one set like any other.  Rows with equal ids each keep their row.  A null id takes part;
    its component is that of the others, or null if none has an id.  ``kept`` is whether the two ids are the same, null-safe.
    Further columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    printed = cut_lineage(_sketched(docs, shingle, percent))
    some = printed.where(F.col("digest").isNotNull())
    sets = cut_lineage(some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys")))
    index = sets.select(F.explode("keys").alias("key"), "digest", "n")
    sizes = index.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    met = cut_lineage(index.join(sizes, "key"))
    crowd = met.groupBy("digest").agg(F.sum("members").alias("crowd"))
    ranked = met.join(crowd, "digest")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("crowd", "digest", "n")).alias("hub"))
    star = met.join(hubs, "key").where(F.col("digest") != F.col("hub.digest"))
    fits = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    pairs = cut_lineage(star.where(fits).select(F.col("digest").alias("a"), F.col("hub.digest").alias("b")).distinct())
    known = cut_lineage(_full_sets(docs, sets, _ends(pairs), shingle))
    links = cut_lineage(_confirmed(pairs, known, percent))
    comps = cut_lineage(components(links).select(F.col("node").alias("digest"), "root"))
    rest = cut_lineage(_open_pairs(met.select("key", "digest"), sets, comps, percent))
    if not rest.isEmpty():
        unread = _ends(rest).join(known, "digest", "left_anti")
        known = known.unionByName(cut_lineage(_full_sets(docs, sets, unread, shingle)))
        more = cut_lineage(_confirmed(rest, known, percent))
        comps = cut_lineage(components(links.unionByName(more)).select(F.col("node").alias("digest"), "root"))
    rooted = sets.select("digest", "doc_id").join(comps, "digest", "left").select("digest", "doc_id", F.coalesce("root", "digest").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = rooted.join(least, "root").select("digest", "component_id")
    out = printed.select("doc_id", "digest", "n").join(of, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same classes on DuckDB: sets meet on every shared shingle, links are followed to the end.
CLASSES_SQL = r"""
with recursive w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
d as (select r, doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
             else list_sort(list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))) end as t from w),
s as (select t, min(r) as k, len(t) as n from d where len(t) > 0 group by t),
e as (select k, n, unnest(t) as x from s),
l as (select a.k as a, b.k as b from e a join e b on a.x = b.x and a.k < b.k and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      group by a.k, b.k having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
u as (select a, b from l union all select b, a from l),
reach as (select k as a, k as b from s union select reach.a, u.b from reach join u on reach.b = u.a),
root as (select a as k, min(b) as root from reach group by a),
o as (select d.doc_id, len(d.t) as n, root.root from d left join s on s.t = d.t and s.n > 0 left join root using (k)),
c as (select root, min(doc_id) as component_id from o where root is not null group by root),
f as (select doc_id, n, case when o.root is null then doc_id else component_id end as component_id from o left join c on o.root = c.root)
select doc_id, n::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept from f
"""
