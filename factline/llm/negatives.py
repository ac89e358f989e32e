"""Hard negatives by exact integer products of packed vectors.

Components become integers.  Several candidates share one 64-bit integer for each component: candidate f has the field of WIDTH
bits from bit f * WIDTH on, and holds its component plus a bias, which makes it non-negative.  An anchor's component is multiplied
once with each such integer, and the sum over components holds in every field that candidate's product, from which
the bias times the sum of the anchor's components is taken away.  The width is that of the largest product that the measured
components allow, with a sign; sums modulo 2**64 are exact, since a further offset makes every field non-negative before it is cut out.

Anchors are a stated set of rows, held in blocks, and meet all rows, in packed blocks, by joins of blocks; no task holds more
than one block of each, whatever rows a label has.  Best rows of a block are merged by a window that keeps the first few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.session import cut_lineage

#: Components in a block of anchors and of candidates.
ANCHOR_CELLS, ROW_CELLS = 1 << 15, 1 << 18
WORD = 64


def whole_components(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column, label: Column) -> Column:
    """Rows that take part: a label, a vector, and only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def field_width(most_anchor: int, most: int) -> int:
    """Bits for a signed sum of products: ``most_anchor`` bounds an anchor's absolute sum, ``most`` a component."""
    return max(2, (most_anchor * 2 * most).bit_length() + 1)


def pack(rows: np.ndarray, width: int, bias: int) -> np.ndarray:
    """Components (row, component) to integers (component, group of WORD // width rows)."""
    per = WORD // width
    n, dim = rows.shape
    biased = np.zeros((-(-n // per) * per, dim), np.int64)
    biased[:n] = rows + bias
    fields = biased.astype(np.uint64).reshape(-(-n // per), per, dim) << (np.arange(per, dtype=np.uint64) * np.uint64(width))[None, :, None]
    return np.ascontiguousarray(np.bitwise_or.reduce(fields, axis=1).T)


def products(anchors: np.ndarray, packed: np.ndarray, n: int, width: int, bias: int) -> np.ndarray:
    """Exact inner products (anchor, candidate) of int64 anchors with packed candidates."""
    per = WORD // width
    place = np.arange(per, dtype=np.uint64) * np.uint64(width)
    half = np.uint64(1) << np.uint64(width - 1)
    total = np.zeros((len(anchors), packed.shape[1]), np.uint64)
    for component, wide in zip(anchors.T.astype(np.uint64), packed, strict=True):
        total += component[:, None] * wide[None, :]
    total += np.bitwise_or.reduce(half << place)
    mask = np.uint64((1 << width) - 1)
    fields = ((total[:, :, None] >> place) & mask) - half
    return fields.astype(np.int64).reshape(len(anchors), -1)[:, :n] - bias * anchors.sum(axis=1, keepdims=True)


def _matrix(values: pa.ListArray, n: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 0), np.int64)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and whether each is null; null ids count as the largest."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, np.iinfo(np.int64).max, column.fill_null(0).to_numpy(zero_copy_only=False)), null


def _packed(batches: Iterator[pa.RecordBatch], width: int, bias: int) -> Iterator[pa.RecordBatch]:
    """Candidate blocks (dim, label, block, members) with their members in order of id and their components packed."""
    for batch in batches:
        out = []
        for dim, label, block, members in zip(*(batch.column(i) for i in range(4)), strict=True):
            rows = members.values
            ids, null = _ids(rows.field("id"))
            order = np.lexsort((rows.field("row").to_numpy(zero_copy_only=False), null, ids))
            wide = pack(_matrix(rows.field("v"), len(rows))[order], width, bias)
            listed = pa.array(ids[order], mask=null[order])
            out.append((dim.as_py(), label.as_py(), block.as_py(), listed, rows.field("row").take(pa.array(order)), wide.tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["dim", "label", "block", "ids", "rows", "wide"])


class _Meeting:
    """Scores of a block of anchors with a packed block."""

    def __init__(self, anchors: pa.ListScalar, ids: pa.ListScalar, rows: pa.ListScalar, wide: pa.BinaryScalar, dim: int, width: int, bias: int):
        self.anchors = anchors.values
        v = _matrix(self.anchors.field("v"), len(self.anchors))
        self.anchor_rows = self.anchors.field("row").to_numpy(zero_copy_only=False)
        self.ids, self.null = _ids(ids.values)
        self.rows = rows.values.to_numpy(zero_copy_only=False)
        packed = np.frombuffer(wide.as_py(), np.uint64).reshape(dim, -1) if dim else np.zeros((0, -(-len(self.ids) // (WORD // width))), np.uint64)
        self.scores = products(v, packed, len(self.ids), width, bias)

    def batch(self, at: np.ndarray, pick: np.ndarray, extra: dict[str, np.ndarray]) -> list[pa.Array]:
        found = pa.array(self.ids[pick], mask=self.null[pick])
        return [pa.array(self.anchor_rows[at]), found, pa.array(self.rows[pick]), pa.array(self.scores[at, pick]), *map(pa.array, extra.values())]


def _first(scores: np.ndarray, allowed: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, candidate) of the first ``take`` allowed scores of each anchor, higher first, then the earlier candidate."""
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    n = masked.shape[1]
    if n > take:
        edge = np.partition(masked, n - take, axis=1)[:, n - take]
        at, pick = np.nonzero(allowed & (scores >= edge[:, None]))
    else:
        at, pick = np.nonzero(allowed)
    order = np.lexsort((pick, -scores[at, pick], at))
    at, pick = at[order], pick[order]
    begin = np.searchsorted(at, at)
    keep = np.arange(len(at)) - begin < take
    return at[keep], pick[keep]


_POSITIVE = "anchor long, id long, row long, score long"
_NEGATIVE = "anchor long, id long, row long, score long, positive long"


def _positives(batches: Iterator[pa.RecordBatch], take: int, width: int, bias: int) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "id", "row", "score"]
    for batch in batches:
        for dim, anchors, ids, rows, wide in zip(*(batch.column(i) for i in range(5)), strict=True):
            m = _Meeting(anchors, ids, rows, wide, dim.as_py(), width, bias)
            at, pick = _first(m.scores, m.anchor_rows[:, None] != m.rows[None, :], take)
            yield pa.RecordBatch.from_arrays(m.batch(at, pick, {}), names)


def _negatives(batches: Iterator[pa.RecordBatch], take: int, low: int, width: int, bias: int) -> Iterator[pa.RecordBatch]:
    """For each anchor and positive the block's first rows with low * positive <= 100 * score <= 100 * positive."""
    names = ["anchor", "id", "row", "score", "positive"]
    for batch in batches:
        for dim, anchors, ids, rows, wide in zip(*(batch.column(i) for i in range(5)), strict=True):
            m = _Meeting(anchors, ids, rows, wide, dim.as_py(), width, bias)
            wanted = m.anchors.field("positives").to_pylist()
            deepest = np.array([min(p) for p in wanted])[:, None]
            highest = np.array([max(p) for p in wanted])[:, None]
            at, pick = np.nonzero((100 * m.scores >= low * deepest) & (m.scores <= highest))
            score = m.scores[at, pick]
            order = np.lexsort((pick, -score, at))
            at, pick, score = at[order], pick[order], score[order]
            begin, end = np.searchsorted(at, np.arange(len(wanted))), np.searchsorted(at, np.arange(len(wanted)), "right")
            a, p, s = [], [], []
            for i, scores in enumerate(wanted):
                own = -score[begin[i] : end[i]]
                for top in set(scores):
                    start = int(np.searchsorted(own, -top))
                    found = [k for k in range(start, min(start + take, len(own))) if 100 * -int(own[k]) >= low * top]
                    a += [i] * len(found)
                    p += pick[begin[i] + np.array(found, np.int64)].tolist()
                    s += [top] * len(found)
            yield pa.RecordBatch.from_arrays(m.batch(np.array(a, np.int64), np.array(p, np.int64), {"positive": np.array(s, np.int64)}), names)


def _blocks(rows: DataFrame, by: tuple[str, ...], cells: int, name: str, *more: str) -> DataFrame:
    """Rows dealt to blocks of about ``cells`` components each, whatever the size of a group."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    per = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.greatest(F.lit(1), F.col("dim"))))
    dealt = rows.join(sizes, list(by)).withColumn("block", F.pmod(F.col("row"), F.ceil(F.col("_n") / per)))
    return dealt.groupBy(*by, "block").agg(F.collect_list(F.struct("id", "row", "v", *more)).alias(name))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256,
    id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on the id column.

    An anchor's positives are its first other rows of the same label; for each, the negatives are the first rows of other labels
    with low * positive_score <= 100 * negative_score <= 100 * positive_score.  Higher scores come first, then smaller ids.

    Rows without a label or vector, or with a null or non-finite component, take no part.  Rows equal in id, label and vector count
    once; rows with equal ids and different vectors are different rows, each an anchor of its own.  A row without an id is no
    anchor unless the condition says so, and comes after all ids among ties.  Vectors of different length have no score with each other; empty ones score 0.
    Further columns are not read.  Raises ValueError if components are so large that a product may not fit into 56 bits.
    """
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).alias("v0"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    own = own.where(usable(F.col("v0"), F.col("label"))).select("id", "label", "is_anchor", whole_components(F.col("v0"), scale).alias("v"))
    own = own.withColumn("row", F.xxhash64(F.coalesce("id", F.lit(0)), F.col("id").isNull(), "label", "v")).withColumn("dim", F.size("v"))
    own = cut_lineage(own.dropDuplicates(["row"]))
    size = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + F.abs(x))
    most = own.agg(F.max(F.when(F.col("is_anchor"), size)).alias("anchor"), F.max(F.array_max(F.transform("v", F.abs))).alias("any"), F.max(F.when(F.col("is_anchor"), F.array_max(F.transform("v", F.abs)))).alias("in_anchor"), F.max("dim").alias("dim")).first()
    bias, in_anchor = most["any"] or 0, most["in_anchor"] or 0
    if in_anchor * (most["dim"] or 0) >= 1 << 62 or (width := field_width(most["anchor"] or 0, bias)) > 56:
        raise ValueError("components too large: an exact product may not fit into 56 bits")
    packed = _blocks(own.select("id", "row", "v", "dim", "label"), ("dim", "label"), ROW_CELLS, "members")
    packed = cut_lineage(packed.select("dim", "label", "block", "members").mapInArrow(lambda x: _packed(x, width, bias), "dim int, label int, block long, ids array<long>, rows array<long>, wide binary"))
    anchors = own.where("is_anchor")
    blocks = _blocks(anchors, ("dim", "label"), ANCHOR_CELLS, "anchors").withColumnRenamed("block", "of")
    same = blocks.join(packed, ["dim", "label"]).repartition("dim", "label", "of", "block").select("dim", "anchors", "ids", "rows", "wide")
    found = same.mapInArrow(lambda x: _positives(x, positives, width, bias), _POSITIVE)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    chosen = cut_lineage(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).drop("place"))
    wanted = chosen.where("score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("positives"))  # at most ``positives``
    blocks = _blocks(anchors.join(wanted, "row"), ("dim", "label"), ANCHOR_CELLS, "anchors", "positives").select(F.col("dim"), F.col("label").alias("own"), F.col("block").alias("of"), "anchors")
    other = blocks.join(packed, "dim").where(F.col("own") != F.col("label")).repartition("dim", "label", "of", "block", "own").select("dim", "anchors", "ids", "rows", "wide")
    against = other.mapInArrow(lambda x: _negatives(x, negatives, low, width, bias), _NEGATIVE)
    best = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    against = against.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    against = against.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive"))
    out = named.join(against, ["anchor", "positive"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive").alias("positive_score"), "negative_score")


#: Hard negatives on DuckDB by all pairs of an anchor and a row, for the registered query.
HARD_NEGATIVES_SQL = """
with r as (
  select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))), 0) = 0),
n as (select *, row_number() over () as k from r),
s as (select a.k as a, a.id as anchor_id, c.k as c, c.id, a.label = c.label as same, coalesce(list_inner_product(a.v, c.v), 0)::bigint as score
      from n a join n c on a.k <> c.k and len(a.v) = len(c.v) where a.id % 100 = 0),
p as (select * from (select *, row_number() over (partition by a order by score desc, id nulls last) as place from s where same) where place <= 5),
m as (select p.a, p.c, p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
             row_number() over (partition by p.a, p.c order by s.score desc, s.id nulls last) as rank
      from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from m where rank <= 5
"""
