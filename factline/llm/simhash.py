"""SimHash fingerprints and their near pairs by the generalised pigeonhole principle; groups of texts by exact similarity.

The 64 bits are dealt to ``m`` parts, bits that go together into the same part.  If a fingerprint x probes part i with
radius t_i and the radii add up to ``distance - m + 1`` (a part may be left out with radius -1), then every y within
``distance`` of x lies within t_i of x in some part i: otherwise the distance would be at least the sum of t_i + 1.  Each
fingerprint chooses its own radii by dynamic programming over the parts, so as to make the estimated number of rows
it will look at smallest; parts where it shares its value with very many others are thereby avoided.

Candidates are verified on all 64 bits.  Only one row per distinct fingerprint takes part, so copies of a text
cost one aggregate.  Values that still gather many fingerprints are compared block against block, each pair of blocks in a
task of its own, and a block pair returns a spanning forest of its links instead of all of them.

``near_groups`` links texts by the Jaccard similarity of their shingle sets.  Every distinct set takes part, not one of a group.  Sets
meet in buckets of equal minima of ROWS hashes, in any of BANDS bands; those that meet are compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.components import components
from factline.llm.textual import encoded
from factline.session import cut_lineage

BITS = 64
SEED = 42
#: Fingerprints that share one value of a part and are still compared by a plain join; more, if CROWD times as many as evenly
#: spread ones would.
COLD, CROWD = 64, 2
#: Fingerprints in a block of a crowded value.
BLOCK = 2048
#: Rows looked at in a join that cost as much as one probe that is shuffled.
PROBE = 100
#: Sets of similarity s meet with chance 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8.
BANDS, ROWS = 24, 5
#: Sets in a bucket that are still compared pair by pair, and in a block of a larger bucket.
PAIRED, SETS = 32, 512
#: Columns of an incidence matrix that are multiplied at a time.
COLUMNS = 4096
#: A value held by more than a 1/HEAVY of all fingerprints is known to the estimate by itself; there are at most HEAVY a part.
HEAVY = 1000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a text of fewer words is one shingle, one without words has none.

    Only A-Z is lowered.
    """
    words = encoded(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)))
    begin = start[:n].tolist()
    end = (start[shingle : shingle + n] - 1).tolist() if len(words) > shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A long whose bit b is 1 if more than half of the hashes have it; 0 for none.  Signed, as Spark's."""
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, shingle: int, column: str = "_fp") -> DataFrame:
    @F.pandas_udf("long")
    def fingerprints(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")

    return docs.withColumn(column, fingerprints(F.col("text").cast("string")))


@dataclass(frozen=True)
class Parts:
    """Which bits make each part, how often each bit is set, and the values of each part that are crowded."""

    bits: tuple[tuple[int, ...], ...]
    mean: np.ndarray
    total: int
    heavy: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def values(self, fp: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(fp), np.uint64)
        for at, b in enumerate(self.bits[part]):
            out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(at)
        return out

    def crowd(self, part: int) -> int:
        return max(COLD, CROWD * self.total >> len(self.bits[part]))

    def costs(self, fp: np.ndarray, part: int, most: int) -> np.ndarray:
        """Row t + 1: estimated cost of radius t: rows to look at, and PROBE for each value probed.

        Bits are taken as independent with their own frequency, which gives the chance of each distance; crowded values
        within the radius are added with their true counts.
        """
        chance = np.zeros((most + 2, len(fp)))
        chance[0] = 1.0
        for b in self.bits[part]:
            differs = np.where((fp >> np.uint64(b)) & np.uint64(1) == 1, 1 - self.mean[b], self.mean[b])
            chance[1:] = chance[1:] * (1 - differs) + chance[:-1] * differs
            chance[0] *= 1 - differs
        within = np.cumsum(chance, axis=0)[: most + 1] * self.total
        if self.heavy:
            value, count = self.heavy[part]
            mine = self.values(fp, part)
            for v, c in zip(value, count, strict=True):
                far = np.bitwise_count(mine ^ v)
                for t in range(most + 1):
                    within[t] += np.where(far <= t, c, 0)
        balls = np.cumsum([_choose(len(self.bits[part]), t) for t in range(most + 1)])
        return np.vstack([np.zeros(len(fp)), within + PROBE * balls[:, None]])

    def radii(self, fp: np.ndarray, distance: int) -> np.ndarray:
        """The cheapest radii (part, fingerprint) that add up to distance - m + 1, by dynamic programming.

        State k after some parts: the radii so far plus one each add up to k; the end is distance + 1.
        """
        m, goal = len(self.bits), distance + 1
        best = np.full((goal + 1, len(fp)), np.inf)
        best[0] = 0
        came = np.zeros((m, goal + 1, len(fp)), np.int8)
        for i in range(m):
            cost = self.costs(fp, i, distance)
            new = np.full_like(best, np.inf)
            for k in range(goal + 1):
                for t in range(k + 1):
                    value = best[k - t] + cost[t]
                    better = value < new[k]
                    new[k] = np.where(better, value, new[k])
                    came[i, k] = np.where(better, t, came[i, k])
            best = new
        out = np.zeros((m, len(fp)), np.int8)
        left, at = np.full(len(fp), goal), np.arange(len(fp))
        for i in reversed(range(m)):
            took = came[i, left, at]
            out[i] = took - 1
            left = left - took
        return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def part_count(total: int, distance: int) -> int:
    """Parts for which evenly set bits and even radii cost least for so many fingerprints."""

    def cost(m: int) -> float:
        radii = [(distance + 1) // m - 1 + (i < (distance + 1) % m) for i in range(m)]
        width = [BITS // m + (i < BITS % m) for i in range(m)]
        balls = [sum(_choose(w, t) for t in range(r + 1)) for w, r in zip(width, radii, strict=True)]
        return sum(b * (PROBE + total / 2.0**w) for b, w in zip(balls, width, strict=True))

    return min(range(2, distance + 2), key=cost)


def grouped_bits(co: np.ndarray, total: int, m: int) -> tuple[tuple[int, ...], ...]:
    """Deal the bits to m parts of even width, each grown from its first bit by the bit most correlated with it.

    ``co[a, b]`` counts fingerprints with both bits set.
    """
    mean = np.diag(co) / max(total, 1)
    cov = co / max(total, 1) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        seed = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        part = [seed]
        left.discard(seed)
        while len(part) < width:
            b = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(b)
            left.discard(b)
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def _co_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    co = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        for at in range(0, len(fp), 65536):
            bits = ((fp[at : at + 65536, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            co += np.rint(bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(co.ravel())], ["cell", "n"])


def learn_parts(fps: DataFrame, distance: int) -> Parts:
    """Statistics over all fingerprints: 64 x 64 counts, then at most HEAVY crowded values a part."""
    cells = {r["cell"]: r["n"] for r in fps.select("fp").mapInArrow(_co_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    co = np.array([cells.get(i, 0) for i in range(BITS * BITS)], np.int64).reshape(BITS, BITS)
    total = fps.count()
    parts = Parts(grouped_bits(co, total, part_count(total, distance)), np.diag(co) / max(total, 1), total)
    crowded = (
        fps.select("fp").mapInArrow(lambda x: _indexed(x, parts), "key long, fp long").groupBy("key").count()
        .where((F.col("count") > F.lit(total // HEAVY)) & (F.col("count") > _crowd(parts))).collect()
    )
    heavy = []
    for i in range(len(parts.bits)):
        own = sorted((r["key"] & ((1 << 56) - 1), r["count"]) for r in crowded if r["key"] >> 56 == i)
        heavy.append((np.array([v for v, _ in own], np.uint64), np.array([c for _, c in own], np.float64)))
    return Parts(parts.bits, parts.mean, total, tuple(heavy))


def _crowd(parts: Parts):
    """The number of fingerprints above which the value in ``key`` is crowded."""
    return F.element_at(F.array(*[F.lit(parts.crowd(i)) for i in range(len(parts.bits))]), (F.shiftright("key", 56) + 1).cast("int"))


def _indexed(batches: Iterator[pa.RecordBatch], parts: Parts) -> Iterator[pa.RecordBatch]:
    """A row for each part of each fingerprint."""
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        fp = signed.astype(np.uint64)
        for i in range(len(parts.bits)):
            key = parts.values(fp, i).astype(np.int64) | (i << 56)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed)], ["key", "fp"])


def _probes(batches: Iterator[pa.RecordBatch], parts: Parts, distance: int) -> Iterator[pa.RecordBatch]:
    """A row for each value in the balls that a fingerprint looks into."""
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), 4096):
            signed = whole[at : at + 4096]
            fp = signed.astype(np.uint64)
            radii = parts.radii(fp, distance)
            for i, bits in enumerate(parts.bits):
                value = parts.values(fp, i)
                for t in range(distance + 1):
                    use = radii[i] >= t
                    if not use.any():
                        break
                    masks = np.array([sum(1 << b for b in c) for c in combinations(range(len(bits)), t)], np.uint64)
                    step = max(1, 1_000_000 // max(1, int(use.sum())))
                    for cut in range(0, len(masks), step):
                        some = masks[cut : cut + step]
                        key = (value[use][:, None] ^ some[None, :]).ravel().astype(np.int64) | (i << 56)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(signed[use], len(some)))], ["key", "fp"])


def _forests(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks (x, y) a forest of links (a, b) with the components of all links between the two blocks.

    A pair of blocks gives at most |x| + |y| links.
    """
    for batch in batches:
        a, b = [], []
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            x, y = (side.values.to_numpy(zero_copy_only=False) for side in (x, y))
            near = np.bitwise_count(x.astype(np.uint64)[:, None] ^ y.astype(np.uint64)[None, :]) <= distance
            for p, q in spanning(near):
                a.append(x[p])
                b.append(y[q])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of the bipartite graph ``near``, breadth first: each member is reached once."""
    rows, cols = np.arange(near.shape[0]), np.ones(near.shape[1], bool)
    open_rows = near.any(axis=1)
    out: list[tuple[int, int]] = []
    while open_rows.any():
        front = np.array([int(np.argmax(open_rows))])
        open_rows[front] = False
        while len(front):
            new_cols = near[front].any(axis=0) & cols
            at = np.flatnonzero(new_cols)
            by = front[np.argmax(near[np.ix_(front, at)], axis=0)] if len(at) else at
            out += zip(by.tolist(), at.tolist(), strict=True)
            cols[at] = False
            new_rows = near[:, at].any(axis=1) & open_rows if len(at) else np.zeros(len(rows), bool)
            front = np.flatnonzero(new_rows)
            by = at[np.argmax(near[np.ix_(front, at)], axis=1)] if len(front) else front
            out += zip(front.tolist(), by.tolist(), strict=True)
            open_rows[front] = False
    return out


def near_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints with the components of all pairs within ``distance``; ``fps`` has one row per fingerprint.

    Values that few fingerprints share give all their links, crowded ones only as many as their components need.  Within distance 0
    there is nothing to link.
    """
    if distance < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts = learn_parts(fps, distance)
    index = fps.select("fp").mapInArrow(lambda x: _indexed(x, parts), "key long, fp long")
    probes = fps.select("fp").mapInArrow(lambda x: _probes(x, parts, distance), "key long, fp long")
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    crowded = cut_lineage(sizes.where(F.col("n") > _crowd(parts)))
    is_crowded = not crowded.isEmpty()
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    left = probes.join(crowded, "key", "left_anti") if is_crowded else probes
    cold = left.withColumnRenamed("fp", "a").join(index.withColumnRenamed("fp", "b"), "key").where((F.col("a") < F.col("b")) & (far <= distance)).select("a", "b")
    if not is_crowded:
        return cold

    def blocks(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
        """The fingerprints of each crowded value in arrays of about BLOCK."""
        placed = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK)))
        return placed.groupBy("key", "block").agg(F.collect_list("fp").alias(name)).select("key", name)

    inward = cut_lineage(probes.join(crowded, "key", "left_semi"))
    looking = cut_lineage(inward.groupBy("key").agg(F.count("*").alias("n")))
    pairs = blocks(inward, looking, "x").join(blocks(index, crowded, "y"), "key").select("x", "y")
    hot = pairs.mapInArrow(lambda x: _forests(x, distance), "a long, b long").where(F.col("a") != F.col("b"))
    return cold.unionByName(hot)


def near_components(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """Rows (doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reached over fingerprints within ``distance``, the document itself included.
    Null, empty and blank texts have fingerprint 0 and are linked like any other; rows with equal ids each keep their row;
    a null id has the component of its fingerprint's others, or null if there are none.
    """
    printed = cut_lineage(with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text"), shingle, "fp").select("doc_id", "fp"))
    fps = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(fps, distance))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return printed.join(of, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    return np.unique(shingle_hashes(text, shingle))


def set_digest(hashes: np.ndarray) -> int:
    """One signed long for a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """For each band a signed long of ROWS minima, each over the set's hashes mixed in its own way; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = (hashes[at : at + 4096, None] ^ _MIX[0]) * _MIX[1]
        x ^= x >> np.uint64(29)
        low = np.minimum(low, (x * np.uint64(0x94D049BB133111EB)).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), band)).astype(np.int64)) for band, r in enumerate(rows)]


_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``, by products of their incidence matrices."""
    out = np.zeros((len(x), len(y)))
    flat = [np.concatenate(side) if side else np.zeros(0, np.int64) for side in (x, y)]
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (x, y)]
    both = np.intersect1d(*flat)
    at = [np.searchsorted(both, f) for f in flat]
    shared = [np.flatnonzero(both[np.minimum(a, len(both) - 1)] == f) if len(both) else np.zeros(0, np.int64) for a, f in zip(at, flat, strict=True)]
    for cut in range(0, len(both), COLUMNS):
        sides = []
        for side, a, o, keep in zip((x, y), at, owner, shared, strict=True):
            use = keep[(a[keep] >= cut) & (a[keep] < cut + COLUMNS)]
            has = np.zeros((len(side), min(COLUMNS, len(both) - cut)), np.float32)
            has[o[use], a[use] - cut] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of (set, hashes) a forest of links with the components of all pairs of at least ``similarity``."""
    for batch in batches:
        a, b = [], []
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            (ids_x, x), (ids_y, y) = (_sets(side.values) for side in (x, y))
            common = overlaps(x, y)
            either = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
            for p, q in spanning(common >= similarity * either):
                a.append(ids_x[p])
                b.append(ids_y[q])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])


def _sets(rows: pa.StructArray) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, hashes = rows.flatten()
    return ids.to_numpy(zero_copy_only=False), [h.values.to_numpy(zero_copy_only=False) for h in hashes]


def alike_links(docs: DataFrame, sets: DataFrame, candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of sets with the components of all met pairs of at least ``similarity``.

    ``docs`` has (doc_id, text); ``sets`` one row (digest, doc_id, keys) per distinct set, with a document that has it.  Small
    buckets give each pair once; large ones are compared block against block.  ``candidates`` are further pairs (a, b) to verify, a < b.
    """
    index = sets.select(F.explode("keys").alias("key"), "digest")
    sizes = cut_lineage(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    met = cut_lineage(index.join(sizes, "key"))
    each = met.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_list("digest").alias("own"))
    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = cut_lineage(each.select(F.explode(pairs).alias("p")).select("p.a", "p.b").unionByName(candidates).distinct())
    in_pairs = pairs.select(F.explode(F.array("a", "b")).alias("digest"))
    wanted = met.select("digest").unionByName(in_pairs).distinct().join(sets.select("digest", "doc_id"), "digest").select(F.col("doc_id").alias("id"), F.col("digest").alias("wanted"))

    @F.pandas_udf("digest long, hashes array<long>")
    def read(text: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, shingle) for t in text]
        return pd.DataFrame({"digest": [set_digest(h) for h in found], "hashes": [np.sort(h.astype(np.int64)) for h in found]})

    # rows with equal ids may have different texts: only those with the wanted set count
    texts = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("wanted", read(F.col("text").cast("string")).alias("s"))
    known = cut_lineage(texts.where(F.col("s.digest") == F.col("wanted")).groupBy("wanted").agg(F.any_value("s.hashes").alias("hashes")))
    one, other = (known.select(F.col("wanted").alias(n), F.col("hashes").alias(f"h{n}")) for n in ("a", "b"))
    common = F.size(F.array_intersect("ha", "hb"))
    cold = pairs.join(one, "a").join(other, "b").where(common >= similarity * (F.size("ha") + F.size("hb") - common)).select("a", "b")
    crowded = met.where(F.col("n") > PAIRED)
    if crowded.isEmpty():
        return cold
    placed = crowded.join(known, F.col("digest") == F.col("wanted")).withColumn("block", F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / SETS)))
    blocks = cut_lineage(placed.groupBy("key", "block").agg(F.collect_list(F.struct("digest", "hashes")).alias("x")))
    right = blocks.select(F.col("key").alias("k"), F.col("block").alias("other"), F.col("x").alias("y"))
    both = blocks.join(right, (F.col("key") == F.col("k")) & (F.col("block") <= F.col("other"))).repartition("key", "block", "other").select("x", "y")
    hot = both.mapInArrow(lambda x: _alike(x, similarity), "a long, b long").where(F.col("a") != F.col("b"))
    return cold.unionByName(hot)


def close_sets(printed_sets: DataFrame, close: int) -> DataFrame:
    """Pairs (a, b) of sets, a < b, whose fingerprints are linked within ``close`` bits, for verification.

    ``printed_sets`` has (fp, digest).  The sets of a fingerprint meet its least one, and the least ones of linked fingerprints meet.
    """
    least = cut_lineage(printed_sets.groupBy("fp").agg(F.min("digest").alias("least")))
    links = near_links(least.select("fp"), close).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    across = links.join(least, "fp").join(least.select(F.col("fp").alias("other"), F.col("least").alias("end")), "other").select(F.col("least").alias("x"), F.col("end").alias("y"))
    within = printed_sets.join(least, "fp").select(F.col("digest").alias("x"), F.col("least").alias("y"))
    both = across.unionByName(within).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, close: int = 4) -> DataFrame:
    """Rows (doc_id, component_id, first_text), one for each row of ``docs`` with an id, grouping texts by their shingle sets.

    Texts whose sets have a Jaccard similarity of at least ``similarity`` are linked.  Sets meet by fingerprints, which count repeats,
    within ``close`` bits and by minima of their hashes; every link is verified by the exact overlap.  Texts without words are alike.  A group's first row has the least (doc_id, ``text_key``); component_id and first_text are these.
    Rows with equal ids and different texts may be in different groups.
    """
    @F.pandas_udf("fp long, digest long, keys array<long>")
    def prints(text: pd.Series) -> pd.DataFrame:
        every = [shingle_hashes(t, shingle) for t in text]
        found = [np.unique(h) for h in every]
        return pd.DataFrame({"fp": [majority(h) for h in every], "digest": [set_digest(h) for h in found], "keys": [band_keys(h) for h in found]})

    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    printed = cut_lineage(docs.select("doc_id", text_key().alias("text_key"), prints("text").alias("p")).select("doc_id", "text_key", "p.fp", "p.digest", "p.keys"))
    first = F.min(F.struct("doc_id", "text_key"))
    sets = cut_lineage(printed.groupBy("digest").agg(first.alias("first"), F.any_value("keys").alias("keys")).select("digest", "first.doc_id", "first.text_key", "keys"))
    printed_sets = cut_lineage(printed.select("fp", "digest").distinct())
    roots = components(alike_links(docs, sets, close_sets(printed_sets, close), shingle, similarity))
    final = cut_lineage(sets.join(roots, sets["digest"] == roots["node"], "left").select("digest", "doc_id", "text_key", F.coalesce("root", "digest").alias("top")))
    least = final.groupBy("top").agg(first.alias("first"))
    of = final.select("digest", "top").join(least, "top").select("digest", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_text"))
    return printed.select("doc_id", "digest").join(of, "digest").select("doc_id", "component_id", "first_text")


def text_key(text: str = "text"):
    """A long that tells the texts of rows with equal ids apart."""
    return F.xxhash64(F.col(text).cast("string"))


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
