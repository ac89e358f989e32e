"""Repeated byte strings of the whole corpus, found with suffix arrays built bucket by bucket.

Every string of ``length`` bytes (a window) belongs to one bucket: the smallest hash among its ``GRAM``-byte pieces.
Equal windows share their bucket, wherever they are, so buckets can be searched apart from each other.  Windows that follow one
another in a document and hold the same piece at the same place make a segment; no two windows of a segment are equal.

1. Buckets with a single segment hold nothing repeated.  They are told by one aggregate of two hashes and a count a bucket.
2. Of equal segments all but the first are repeated, window by window.
3. Where different segments share a bucket, their bytes are joined to one string, its suffix array is built by grouping
   (``grouping.suffix_orders``), and runs of neighbours that share ``length`` bytes are the repeated windows; all but
   a run's first are covered.
4. A bucket with very many different segments is crowded.  Its segments are cut into parts of at most ``PART`` windows, by the
   place of the bucket's piece in the window, and what all windows of a part may share, all but ``PART - 1`` of their bytes, decides
   the part's own bucket.  Equal windows still share it; what stands beside a passage that many texts have is alone there and
   goes no further.  Parts are then treated as segments were: 1, 2 and 3.
5. A bucket with very many different parts is dealt to blocks, each with a suffix array of its own.  What is first in its
   block may still repeat something of another block: these windows alone are grouped by two independent 64-bit hashes of
   their bytes, which Spark spreads over tasks however many there are.

Rows never carry more than a document's own positions; text crosses the network once to take out segments and once to cut.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.grouping import spread, suffix_orders
from factline.llm.textual import encoded
from factline.session import cut_lineage, drop_step

LENGTH = 100
GRAM = 24
#: Different segments that one suffix array takes, about; a bucket with more is cut into parts, one of parts is dealt to blocks.
MOST_SEGMENTS = 48
#: Windows of a part at most.
PART = 8
#: Symbols that are sorted in step, about.
SYMBOLS = 1 << 19
#: Bytes that are hashed at a time.
CHUNK = 1 << 18
#: Bits for a place among the bytes hashed at a time.
PLACE_BITS = 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Positions hold the number of the row among those with its id above this bit.
ROW_BIT = 40


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of the multiplier, and their inverses modulo 2**64; kept for the task."""
    if (multiplier, size) in _POWERS:
        return _POWERS[multiplier, size]
    values = np.random.default_rng(multiplier).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ones = np.ones(size, np.uint64)
    up, down = ones.copy(), ones
    up[1:] = np.uint64(multiplier)
    down[1:] = np.uint64(pow(multiplier, -1, 2**64))
    _POWERS[multiplier, size] = values, np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[multiplier, size]


class Hashes:
    """Hashes of all substrings of some bytes by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, multiplier: int):
        size = max(1 << 16, 1 << int(len(data) + 1).bit_length())
        values, up, self.down = _powers(multiplier, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def segments(data: np.ndarray, first: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie at ``first`` with ``size`` bytes in ``data``: (text, start in data, windows, bucket, hash)."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(data, MULTIPLIERS[0])
    pieces = hashes.all(gram)
    # the place in the low bits makes the first of equal pieces the least, and a segment end where that place changes
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((pieces & ~place) | np.arange(len(pieces), dtype=np.uint64), length - gram + 1)
    cut = np.zeros(n + 1, bool)
    cut[0] = True
    cut[1:n] = least[1:] != least[:-1]
    whole = size >= length
    begin, over = first[whole], np.minimum((first + size)[whole] - length + 1, n)
    cut[begin] = True
    cut[over] = True
    at = np.flatnonzero(cut[:n])
    run = np.diff(np.append(at, n))
    text = np.searchsorted(first, at, side="right") - 1
    keep = at + length <= first[text] + size[text]
    at, run, text = at[keep], run[keep], text[keep]
    return text, at, run, pieces[(least[at] & place).astype(np.int64)], hashes.of(at, at + run + length - 1) ^ run.astype(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], length: int):
    """Texts by the half megabyte: (keys, row numbers, offsets in the text, first byte, size, bytes).

    A longer text comes in several chunks, of which the next repeats the last ``length - 1`` bytes.
    """
    held: list[tuple] = []
    total = 0

    def joined():
        size = np.array([len(b) for *_, b in held], np.int64)
        first = np.cumsum(size) - size
        keys, rows, offs = (np.array([h[i] for h in held], np.int64) for i in range(3))
        return keys, rows, offs, first, size, np.frombuffer(b"".join(b for *_, b in held), np.uint8)

    for batch in batches:
        for key, row, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            data = encoded(text.as_py())
            for off in range(0, max(1, len(data) - length + 1), CHUNK):
                piece = data[off : off + CHUNK + length - 1]
                if len(piece) >= length:
                    held.append((key.as_py(), row.as_py(), off, piece))
                    total += len(piece)
                if total >= CHUNK:
                    yield joined()
                    held, total = [], 0
    if held:
        yield joined()


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for keys, rows, offs, first, size, data in _chunks(batches, length):
        text, at, run, bucket, digest = segments(data, first, size, length, gram)
        start = at - first[text] + offs[text] + (rows[text] << ROW_BIT)
        columns = [bucket.astype(np.int64), digest.astype(np.int64), keys[text], start, run]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "digest", "doc", "at", "n"])


def parts(data: np.ndarray, first: np.ndarray, size: np.ndarray, bucket: np.ndarray, length: int, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """Parts of segments that lie at ``first`` with ``size`` bytes in ``data``: (segment, start in data, windows, bucket, hash).

    A part's windows hold the piece of the segment's ``bucket`` at places from a multiple of ``width`` on, fewer than ``width`` further.
    """
    hashes = Hashes(data, MULTIPLIERS[0])
    windows = size - length + 1
    # the piece is the first with that hash among those that all windows of the segment hold
    owner = np.repeat(np.arange(len(size)), size)[: len(data) - gram + 1]
    beside = np.arange(len(owner)) - first[owner]
    at = np.flatnonzero((hashes.all(gram) == bucket[owner]) & (beside >= windows[owner] - 1) & (beside <= length - gram))
    _, head = np.unique(owner[at], return_index=True)
    piece = at[head]
    most = piece - first
    least = most - windows + 1
    count = most // width - least // width + 1
    of = np.repeat(np.arange(len(size)), count)
    step = spread(least // width, count)
    low, high = np.maximum(step * width, least[of]), np.minimum(step * width + width - 1, most[of])
    start, run = piece[of] - high, high - low + 1
    shared = hashes.of(piece[of] - step * width, piece[of] - np.minimum(step * width + width - 1, length - gram) + length)
    return of, start, run, shared + step.astype(np.uint64), hashes.of(start, start + run + length - 1) ^ run.astype(np.uint64)


def _part_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows as those of segments, and ``of``, where the segment starts."""
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            batch = whole.slice(i, 4096)
            bucket, doc, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            pieces = batch.column(3).to_pylist()
            size = np.array([len(p) for p in pieces], np.int64)
            first = np.cumsum(size) - size
            of, start, run, key, digest = parts(np.frombuffer(b"".join(pieces), np.uint8), first, size, bucket.astype(np.uint64), length, gram, width)
            columns = [key.astype(np.int64), digest.astype(np.int64), doc[of], at[of] + start - first[of], run, at[of]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "digest", "doc", "at", "n", "of"])


PIECES = "bucket long, block long, doc long, at long, crowded boolean, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments that texts, or pieces of them, are asked for: rows (doc, position of the first byte, bytes, wanted)."""
    names = ["bucket", "block", "doc", "at", "crowded", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        for key, start, text, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
            data, key, start = text.as_py(), key.as_py(), start.as_py()
            data = data if isinstance(data, bytes) else encoded(data)
            for w in wanted.as_py():
                at = w["at"] - start
                out.append((w["bucket"], w["block"], key, w["at"], w["crowded"], data[at : at + w["n"] + length - 1]))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def compared_windows(group: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, piece, place in piece, bytes) of all windows of some groups of pieces, by a suffix array for each group.

    Pieces of a group follow one another and make one string; a window is a suffix with ``length`` bytes left in its piece.
    Windows have the same class if their group and bytes are equal.  The last value is all bytes, each piece followed by one.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    last = np.append(group[1:] != group[:-1], True)
    stop = np.cumsum(size + 1)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    # symbol 0 ends a group's string, 1 a piece, bytes follow
    symbols = raw.astype(np.int64) + 2
    symbols[stop - 1] = np.where(last, 0, 1)
    order = suffix_orders(symbols, np.append(0, stop[last]))
    piece = np.repeat(np.arange(len(pieces)), size + 1)
    left = stop[piece] - 1 - np.arange(len(raw))
    windows = order[left[order] >= length]
    of = piece[windows]
    same = np.zeros(len(windows), bool)
    if len(windows) > 1:
        view = np.lib.stride_tricks.sliding_window_view(raw, length)
        near = np.flatnonzero((group[of[1:]] == group[of[:-1]]) & (raw[windows[1:]] == raw[windows[:-1]])) + 1
        for i in range(0, len(near), 1 << 14):
            k = near[i : i + (1 << 14)]
            same[k] = (view[windows[k]] == view[windows[k - 1]]).all(axis=1)
    return np.cumsum(~same), of, windows - (stop - size - 1)[of], raw


FOUND = "doc long, at long, n long, h1 long, h2 long"


def _search(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, block) to runs of covered windows, and, of crowded buckets, each class's first window with its hashes.

    Whole groups are taken at a time; the last one waits for the next batch.
    """
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        bucket, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        other = np.flatnonzero((bucket != bucket[-1]) | (block != block[-1])) if batch.num_rows else []
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from _solved(batch.slice(0, cut), length)
        held = batch.slice(cut)
    if held is not None and held.num_rows:
        yield from _solved(held, length)


def _solved(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Groups of about the same size are solved in step, at most SYMBOLS at a time."""
    bucket, block, doc, at, crowded = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    pieces = batch.column(5).to_pylist()
    group = np.cumsum(np.append(True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))) - 1
    size = np.bincount(group, weights=[len(p) + 1 for p in pieces]).astype(np.int64)
    by = np.lexsort((group, size[group]))
    total = np.cumsum([len(pieces[i]) + 1 for i in by])
    # a new part starts with a group of more than twice the size of the part's first, or beyond SYMBOLS
    starts, first, base = [0], size[group[by[0]]], 0
    heads = np.flatnonzero(np.append(False, group[by[1:]] != group[by[:-1]]))
    for h in heads.tolist():
        if size[group[by[h]]] > 2 * first or total[h - 1] - base > SYMBOLS:
            starts.append(h)
            first, base = size[group[by[h]]], total[h - 1]
    for a, b in zip(starts, [*starts[1:], len(by)], strict=True):
        rows = by[a:b]
        cls, of, place, raw = compared_windows(group[rows], [pieces[i] for i in rows], length)
        d, p, hot = doc[rows][of], at[rows][of] + place, crowded[rows][of].astype(bool)
        order = np.lexsort((p, d, cls))
        cls, d, p, hot, of, place = (x[order] for x in (cls, d, p, hot, of, place))
        later = np.append(False, cls[1:] == cls[:-1])
        yield _runs(d[later], p[later])
        ask = np.flatnonzero(~later & hot)
        if len(ask):
            size_of = np.array([len(pieces[i]) + 1 for i in rows])
            begin = (np.cumsum(size_of) - size_of)[of[ask]] + place[ask]
            h1, h2 = (Hashes(raw, m).of(begin, begin + length).astype(np.int64) for m in MULTIPLIERS)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[ask], p[ask], np.ones(len(ask), np.int64), h1, h2)], ["doc", "at", "n", "h1", "h2"])


def _runs(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Single windows as runs (doc, at, n)."""
    by = np.lexsort((at, doc))
    doc, at = doc[by], at[by]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    none = pa.nulls(len(first), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first]), pa.array(n.astype(np.int64)), none, none], ["doc", "at", "n", "h1", "h2"])


def numbered(docs: DataFrame) -> DataFrame:
    """Rows (_doc, _row, text, _all): ``_doc`` orders documents, ``_row`` tells rows with equal ids apart, ``_all`` is the whole row.

    Null ids come last.  Rows with equal ids are ordered by hashes of their text and of all their columns; rows equal in both are
    copies of each other, so it does not matter which is first.  Only ids that occur twice are put in order.
    """
    last = F.lit(2**63 - 1)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("_doc"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("_all"))
    twice = cut_lineage(docs.groupBy("_doc").count().where(F.col("count") > 1).select(F.col("_doc").alias("_twice")))
    only = F.lit(0).cast("long").alias("_row")
    if twice.isEmpty():
        return docs.select("_doc", only, "text", "_all")
    order = Window.partitionBy("_doc").orderBy(F.xxhash64("text"), F.xxhash64("_all"))
    one = docs.join(twice, F.col("_doc") == F.col("_twice"), "left_anti").select("_doc", only, "text", "_all")
    more = docs.join(twice, F.col("_doc") == F.col("_twice"), "left_semi").select("_doc", F.row_number().over(order).cast("long").alias("_row"), "text", "_all")
    return one.unionByName(more)


def _step(df: DataFrame) -> DataFrame:
    """Write a step; then let Spark drop the shuffle files of what led to it, which it does when the driver collects garbage."""
    out = cut_lineage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _sorted_out(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps of ``found`` (bucket, digest, doc, at, n and any others): what equals an earlier one, and the first of each kind as ``f``.

    Both are of buckets with several rows only; ``mixed`` tells those with several kinds.
    """
    others = [c for c in found.columns if c not in ("bucket", "digest")]
    shared = found.groupBy("bucket").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("c")).where(F.col("c") > 1)
    together = _step(found.join(shared.select("bucket", (F.col("lo") != F.col("hi")).alias("mixed")), "bucket"))
    firsts = _step(together.groupBy("bucket", "digest", "mixed").agg(F.min(F.struct(*others)).alias("f"), F.count("*").alias("c")))
    copied = firsts.where(F.col("c") > 1).select(F.col("bucket").alias("b"), F.col("digest").alias("d"), "f")
    same = (F.col("bucket") == F.col("b")) & (F.col("digest") == F.col("d"))
    copies = _step(together.join(copied, same).where((F.col("doc") != F.col("f.doc")) | (F.col("at") != F.col("f.at"))).select("doc", "at", "n"))
    drop_step(together)
    return copies, firsts


def _unlike(firsts: DataFrame) -> DataFrame:
    """The first of each kind in mixed buckets, with the number ``k`` of kinds in the bucket."""
    unlike = firsts.where("mixed").select("bucket", "f.*")
    return unlike.join(unlike.groupBy("bucket").agg(F.count("*").alias("k")), "bucket")


def _part_pieces(pieces: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of crowded segments, the parts that equal an earlier one, the pieces of those that are to be compared, with their blocks, and a step these read."""
    found = pieces.select("bucket", "doc", "at", "bytes").mapInArrow(
        lambda b: _part_rows(b, length, gram, PART), "bucket long, digest long, doc long, at long, n long, of long"
    )
    copies, firsts = _sorted_out(found)
    blocks = F.ceil(F.col("k") / MOST_SEGMENTS)
    placed = _unlike(firsts).select("bucket", F.pmod(F.xxhash64("doc", "at"), blocks).alias("block"), "doc", "at", "n", (blocks > 1).alias("crowded"), "of")
    wanted = placed.groupBy("doc", "of").agg(F.collect_list(F.struct("bucket", "block", "at", "n", "crowded")).alias("wanted"))
    asked = pieces.select(F.col("doc").alias("_doc"), F.col("at").alias("_at"), "bytes").join(wanted, (F.col("_doc") == F.col("doc")) & (F.col("_at") == F.col("of")))
    return copies, asked.select("_doc", "_at", "bytes", "wanted").mapInArrow(lambda b: _cut_out(b, length), PIECES), firsts


def covered_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc, at, n): n windows from ``at`` on that also start earlier.  ``docs`` is ``numbered``."""
    texts = docs.select("_doc", "_row", "text")
    found = texts.mapInArrow(lambda b: _segment_rows(b, length, gram), "bucket long, digest long, doc long, at long, n long")
    copies, firsts = _sorted_out(found)
    placed = _unlike(firsts).select("bucket", F.lit(0).cast("long").alias("block"), "doc", "at", "n", (F.col("k") > MOST_SEGMENTS).alias("crowded"))
    wanted = placed.groupBy("doc", F.shiftright("at", ROW_BIT).alias("row")).agg(F.collect_list(F.struct("bucket", "block", "at", "n", "crowded")).alias("wanted"))
    asked = texts.join(wanted, (F.col("_doc") == F.col("doc")) & (F.col("_row") == F.col("row")))
    pieces = _step(asked.select("_doc", F.shiftleft("_row", ROW_BIT).alias("_at"), "text", "wanted").mapInArrow(lambda b: _cut_out(b, length), PIECES))
    drop_step(firsts)
    compared, crowded, steps = pieces.where(~F.col("crowded")), pieces.where("crowded"), [copies, pieces]
    if not crowded.isEmpty():
        more, cut, firsts = _part_pieces(crowded, length, gram)
        copies, compared = copies.unionByName(more), compared.unionByName(cut)
        steps += [more, firsts]
    searched = _step(compared.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(lambda b: _search(b, length), FOUND))
    many = searched.where(F.col("h1").isNotNull()).select("h1", "h2", "doc", "at")
    earliest = many.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("f"), F.count("*").alias("c")).where(F.col("c") > 1)
    earliest = earliest.select(F.col("h1").alias("a"), F.col("h2").alias("b"), "f")
    across = (
        many.join(earliest, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
        .where((F.col("doc") != F.col("f.doc")) | (F.col("at") != F.col("f.at"))).select("doc", "at", F.lit(1).cast("long").alias("n"))
    )
    inside = searched.where(F.col("h1").isNull()).select("doc", "at", "n")
    out = _step(copies.unionByName(inside).unionByName(across))
    for step in (*steps, searched):
        drop_step(step)
    return out


def cut_text(data: bytes, runs: list[dict] | None, length: int) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs) for runs of covered windows (at, n)."""
    if not runs:
        return data, 0, 0
    low = (1 << ROW_BIT) - 1
    spans = sorted((r["at"] & low, (r["at"] & low) + r["n"] + length - 1) for r in runs)
    kept, end, removed, count, since = [], 0, 0, 0, 0
    for a, b in spans:
        if not count or a > end:
            kept.append(data[since if count else 0 : a])
            count += 1
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        since = end
    kept.append(data[end:])
    return b"".join(kept), removed, count


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def with_repeats_removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text and any others) with a struct ``_cut`` of n_bytes, n_removed, n_spans, kept_sha256 and kept.

    Texts are UTF-8 bytes.  A byte goes if some string of ``length`` bytes that covers it also starts earlier: in a document
    with a smaller id, or before in the same one; what is judged is the input.  Null and empty texts have no bytes;
    null ids come after all others; rows with equal ids count as different documents, in an order that their
    text decides, and of equal rows one is the first.  ``kept`` is the remaining text; bytes of a character of which a part
    is removed are left out of it, but not of the figures.
    """
    columns = [c for c in docs.columns if c != "_cut"]
    docs = numbered(docs)
    runs = covered_runs(docs, length, gram)
    by_doc = runs.groupBy("doc", F.shiftright("at", ROW_BIT).alias("row")).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    joined = docs.join(by_doc, (F.col("_doc") == F.col("doc")) & (F.col("_row") == F.col("row")), "left")

    @F.pandas_udf(REMOVED)
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(text, runs, strict=True):
            data = encoded(t)
            kept, removed, count = cut_text(data, None if r is None else list(r), length)
            rows.append((len(data), removed, count, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select(*[F.col("_all")[c].alias(c) for c in columns], cut("text", "runs").alias("_cut"))
