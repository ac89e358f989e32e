"""Ranked lexical search by branch and bound on trees of documents.

Documents keep only terms that some item asks for, in order of falling document frequency, as (term, tf).  A tree of documents
(an FP-tree whose nodes hold documents instead of counts) merges equal beginnings: sorted vectors share a path as far as they agree, paths
without branches are one node, and a leaf is a bucket of up to LEAF neighbouring documents.  Every node knows for each term the largest tf
in its subtree, and the least length norm m.  A term's part of a score grows with tf and falls with m, so these give an upper
bound for every document below.  An item walks the tree depth first, the child with the best bound first, and leaves out subtrees whose bound
is under its score at the last place; documents of the buckets it reaches are scored exactly, in integers.

Document frequencies come from one count of words, combined in each task before the shuffle.  Trees are built in tasks over at most
SHARD documents, an item carries its best documents from tree to tree of a task, and a window merges the tasks' lists.  Items are taken
in groups of at most GROUP_TERMS terms, with a pass over the restricted vectors for each group: what a task holds is
bounded by these parameters, not by the tables.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.textual import encoded
from factline.session import cut_lineage

#: Documents in a bucket of a tree, and documents and entries (term, tf) in a tree.
LEAF, SHARD, ENTRIES = 32, 16_384, 4_000_000
#: Numbers in a tree's tables of bounds.
CELLS = 24_000_000
#: Terms of all items of a group, repeats included.
GROUP_TERMS = 100_000
#: Different words a task counts before it hands them on.
COUNTED = 1_000_000

#: Bytes that part terms become spaces, A-Z become a-z; bytes of other characters belong to terms.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lowered."""
    return encoded(text).translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: int, n_docs: int, length: int) -> int:
    return 100 - 25 + (25 * n * n_docs) // length


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score without its weight, 0 where it does not occur."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """Documents as vectors of ranked terms; ``terms`` and ``tfs`` hold those of document i from ``start[i]`` to ``start[i + 1]``."""

    def __init__(self, ids: list, terms: np.ndarray, tfs: np.ndarray, start: np.ndarray, m: np.ndarray, vocabulary: int):
        key = terms.astype(">u4").tobytes()
        order = sorted(range(len(ids)), key=lambda i: key[4 * start[i] : 4 * start[i + 1]])
        size = np.diff(start)[order]
        at = np.repeat(start[:-1][order] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.ids, self.m = [ids[i] for i in order], m[order]
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.terms, self.tfs = terms[at], tfs[at]
        self.parts = part(self.tfs, np.repeat(self.m, size))
        #: Nodes as (first document, one past the last); children of node i by number, none for a bucket.
        self.spans: list[tuple[int, int]]
        self.children: list[list[int]]
        self.leaf = LEAF
        self._grow()
        while len(self.spans) > 1 and len(self.spans) * vocabulary > CELLS:  # a node has a row of bounds: fewer nodes where the vocabulary is wide
            self.leaf *= 2
            self._grow()
        self._bound(vocabulary)

    def _grow(self) -> None:
        self.spans, self.children = [], []
        todo = [(0, len(self.ids), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            me = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if hi - lo <= self.leaf:
                continue
            depth += self._shared(lo, hi, depth)
            cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(self._term(lo, hi, depth)))).tolist(), hi]
            if len(cuts) == 2:  # equal vectors: buckets of any of them
                cuts = [*range(lo, hi, self.leaf), hi]
            begin = lo
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - begin > self.leaf and a > begin:  # small branches side by side share a bucket
                    todo.append((begin, a, depth, me))
                    begin = a
            todo.append((begin, hi, depth, me))

    def _term(self, lo: int, hi: int, depth: int) -> np.ndarray:
        """The term at a depth of each document, -1 for those that end before."""
        at = self.start[lo:hi] + depth
        inside = at < self.start[lo + 1 : hi + 1]
        return np.where(inside, self.terms[np.minimum(at, len(self.terms) - 1)].astype(np.int64), -1)

    def _shared(self, lo: int, hi: int, depth: int) -> int:
        """Terms from ``depth`` on that all documents share; in sorted order the first and the last tell."""
        x = self.terms[self.start[lo] + depth : self.start[lo + 1]]
        y = self.terms[self.start[hi - 1] + depth : self.start[hi]]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def _bound(self, vocabulary: int) -> None:
        most = np.zeros((len(self.spans), vocabulary), np.int32)
        least = np.zeros(len(self.spans), np.int64)
        for node in reversed(range(len(self.spans))):  # children come after their parent
            lo, hi = self.spans[node]
            least[node] = self.m[lo:hi].min()
            if self.children[node]:
                most[node] = most[self.children[node]].max(axis=0)
            else:
                a, b = self.start[lo], self.start[hi]
                np.maximum.at(most[node], self.terms[a:b], self.tfs[a:b])
        for at in range(0, len(most), 64):
            most[at : at + 64] = part(most[at : at + 64], least[at : at + 64, None])
        self.bounds = most

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list, take: int) -> None:
        """Bring ``best``, a heap of (score, -id order, id), up to date with this tree's documents.

        ``dense`` has a zero for every term of the vocabulary, and is left so.
        """
        bound = self.bounds[:, terms].astype(np.int64) @ weights
        dense[terms] = weights
        todo = [0]
        while todo:
            node = todo.pop()
            if bound[node] <= 0 or len(best) == take and bound[node] < best[0][0]:
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=bound.__getitem__)
                continue
            lo, hi = self.spans[node]
            a, b = self.start[lo], self.start[hi]
            # every vector has a term, so no run of reduceat is empty
            scores = np.add.reduceat(dense[self.terms[a:b]] * self.parts[a:b], self.start[lo:hi] - a)
            least = best[0][0] if len(best) == take else 1
            for i in np.flatnonzero(scores >= least).tolist():
                id_ = self.ids[lo + i]
                entry = (int(scores[i]), -math.inf if id_ is None else -id_, id_)
                if len(best) < take:
                    heapq.heappush(best, entry)
                elif entry[:2] > best[0][:2]:
                    heapq.heapreplace(best, entry)
        dense[terms] = 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, df); and one without a term with the documents that have any, and all terms, as df and length."""
    counts: Counter = Counter()
    docs = length = 0

    def rows(more: list) -> pa.RecordBatch:
        every = [*((t, n, 0) for t, n in counts.items()), *more]
        columns = list(zip(*every, strict=True)) if every else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["term", "df", "length"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = terms_of(text)
            docs, length = docs + bool(found), length + len(found)
            counts.update(set(found))
            if len(counts) > COUNTED:
                yield rows([])
                counts.clear()
    yield rows([(None, docs, length)])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, term, times)."""
    for batch in batches:
        items, terms, times = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term, n in Counter(terms_of(text)).items():
                items.append(item)
                terms.append(term)
                times.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item", "term", "times"])


def _restricted(batches: Iterator[pa.RecordBatch], rank: dict[bytes, int], n_docs: int, length: int) -> Iterator[pa.RecordBatch]:
    """Documents with a term of the vocabulary: their ids, norms, ranked terms and tfs."""
    for batch in batches:
        ids, norms, starts, terms, tfs = [], [], [0], [], []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = terms_of(text)
            own = sorted((rank[t], n) for t, n in Counter(found).items() if t in rank)
            if own:
                ids.append(id_)
                norms.append(norm(len(found), n_docs, length))
                terms += [r for r, _ in own]
                tfs += [n for _, n in own]
                starts.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norms, pa.int64()), *lists], ["id", "m", "terms", "tfs"])


def _trees(batches: Iterator[pa.RecordBatch], vocabulary: int) -> Iterator[Tree]:
    ids, m, parts, held = [], [], [], 0

    def tree() -> Tree:
        size = np.concatenate([p[2] for p in parts])
        return Tree(ids, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(([0], np.cumsum(size))), np.array(m, np.int64), vocabulary)

    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            terms, tfs = batch.column(2), batch.column(3)
            size = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            parts.append((terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False), size))
            ids += batch.column(0).to_pylist()
            m += batch.column(1).to_pylist()
            held += int(size.sum())
            if len(ids) >= SHARD or held >= ENTRIES:
                yield tree()
                ids, m, parts, held = [], [], [], 0
    if ids:
        yield tree()


def _searched(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray, np.ndarray]], vocabulary: int, take: int) -> Iterator[pa.RecordBatch]:
    """Each item's best documents (item, doc_id, score) among those of a task."""
    best: list[list] = [[] for _ in items]
    dense = np.zeros(vocabulary, np.int64)
    for tree in _trees(batches, vocabulary):
        for (_, terms, weights), own in zip(items, best, strict=True):
            tree.search(terms, weights, dense, own, take)
    found = [(item, id_, score) for (item, _, _), own in zip(items, best, strict=True) for score, _, id_ in own]
    columns = list(zip(*found, strict=True)) if found else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item", "doc_id", "score"])


def _groups(weighted: DataFrame) -> list[tuple[int, int]]:
    """Ranges of item numbers, each with at most GROUP_TERMS terms unless one item alone has more."""
    step = 1000
    counts = weighted.groupBy(F.floor(F.col("item") / step).alias("k")).agg(F.count("*").alias("n")).orderBy("k")
    out, held = [], 0
    for r in counts.toLocalIterator():
        lo = r["k"] * step
        if out and held + r["n"] <= GROUP_TERMS:
            out[-1], held = (out[-1][0], lo + step), held + r["n"]
        elif r["n"] <= GROUP_TERMS:
            out.append((lo, lo + step))
            held = r["n"]
        else:
            few = max(1, step * GROUP_TERMS // r["n"])
            out += [(a, min(a + few, lo + step)) for a in range(lo, lo + step, few)]
            held = GROUP_TERMS
    return out


def rank_documents(docs: DataFrame, items: DataFrame, take: int = 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``take`` best of all ``docs`` (doc_id, text) with a score above 0.

    Equal scores come by ascending doc_id.  Null, empty and very long texts are texts like others: null has no term, a long one is read whole.  Each row
    of ``docs`` is a document, also with an id that others have or without one, which comes after all ids among ties.  Rows of ``items`` equal in (item_id, text) count once; rows with equal ids
    and different texts are ranked each by itself.  Items without terms, and empty tables, give no rows.  Further columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().where(F.col("text").isNotNull())
    asked = _numbered(asked)
    counts = cut_lineage(docs.select("text").mapInArrow(_counted, "term binary, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")))
    total = counts.where(F.col("term").isNull()).first()
    n_docs, length = (total["df"], total["length"]) if total else (0, 0)
    wanted = asked.select("item", "text").mapInArrow(_item_terms, "item long, term binary, times long")
    weighted = cut_lineage(wanted.join(counts.select("term", "df"), "term"))
    out = None
    for lo, hi in _groups(weighted):
        found = _group(docs, weighted.where((F.col("item") >= lo) & (F.col("item") < hi)), n_docs, length, take)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= take)
    return first.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``item``, numbers from 0 on without gaps: ranges are placed first, then each place is numbered."""
    placed = cut_lineage(rows.repartitionByRange("item_id", "text").withColumn("place", F.spark_partition_id()))
    sizes = placed.groupBy("place").agg(F.count("*").alias("n"))
    ahead = sizes.select("place", (F.sum("n").over(Window.orderBy("place")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("place").orderBy("item_id", "text"))
    return cut_lineage(placed.withColumn("own", own).join(ahead, "place").select((F.col("ahead") + F.col("own") - 1).alias("item"), "item_id", "text"))


def _group(docs: DataFrame, weighted: DataFrame, n_docs: int, length: int, take: int) -> DataFrame:
    rows = weighted.orderBy(F.desc("df"), "term", "item").collect()  # at most GROUP_TERMS, or one item's
    rank = {t: i for i, t in enumerate(dict.fromkeys(bytes(r["term"]) for r in rows))}
    asked: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        asked.setdefault(r["item"], []).append((rank[bytes(r["term"])], r["times"] * weight(n_docs, r["df"])))
    packed = [(item, np.array([t for t, _ in own]), np.array([w for _, w in own], np.int64)) for item, own in sorted(asked.items())]
    vocabulary = len(rank)
    vectors = docs.mapInArrow(lambda x: _restricted(x, rank, n_docs, length), "id long, m long, terms array<int>, tfs array<int>")
    return vectors.mapInArrow(lambda x: _searched(x, packed, vocabulary, take), "item long, doc_id long, score long")


#: The same ranking on DuckDB, by a join of all terms.
RANK_SQL = r"""
with d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents where text is not null),
n as (select count(*) as n_docs, sum(len(t)) as length from d where len(t) > 0),
e as (select r, doc_id, len(t) as n, unnest(t) as term from d),
p as (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from e group by r, term),
f as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, n group by term),
i as (select distinct item_id, text from benchmark where text is not null),
j as (select *, row_number() over () as k from i),
q as (select k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from j),
g as (select k, item_id, term, count(*) as times from q group by k, item_id, term),
s as (select k, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // length)))))::bigint as score
      from g join f using (term) join p using (term), n group by k, r)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by k order by score desc, doc_id nulls last) as rank from s where score > 0) where rank <= 20
"""
