"""Benchmark decontamination by templates.

Words become canonical tokens: lower case, without marks at their ends, and numbers, names and units after a number become
typed placeholders.  Windows of tokens are hashed on both sides and joined on the hash; a re-parameterised question has the
same windows.  Every window also counts as its case-folded words, whatever they are, so that copies are found where a word has
another type than in the item, or where most words are placeholders.  Matches of a document and an item that lie on one diagonal (the
item's place shifted by one number) are put together by runs of neighbouring windows, and the placeholders of a run must fit: one value
of the item always stands for one value of the document.

Documents emit only windows that pass a bitmap of the benchmark's hashes.  The bitmap has a fixed size, whatever the size of the
benchmark; it only saves rows, the join decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.session import cut_lineage

WINDOW = 8
#: Tokens in a row that make a leak; a shorter item must be there in full.
RUN = 13
BITMAP_BITS = 24
SEED = 11

#: Words that are units after a number (fixed values).
UNITS = set(
    "% mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l litre litres "
    "liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz "
    "b kb mb gb tb v a w kw mw j kj cal kcal n pa kpa k c f mph kmh dollar dollars euro euros cent cents eur usd percent degree degrees".split()
)
EDGE = re.compile(r"^[^\w%]+|[^\w%]+$")
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
GLUED = re.compile(r"(?<=\d)(?=[^\W\d_]|%)")

NAME, ENDS, UNIT, NUM = 1, 2, 4, 8
#: Hashes of the placeholders; literal tokens have hashes of their own.
SLOT = {NUM: 0x1D8AF066 << 8, UNIT: 0x2545F491 << 8, NAME: 0x369DEA0F << 8}
M = 0x9E3779B97F4A7C15


class Tokens(dict):
    """Raw word to hash and flags in one number; 0 for a word without letters, digits or percent sign."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 500_000:
            self.clear()
        word = EDGE.sub("", raw)
        value = 0
        if word:
            low = word.lower()
            value = xxhash.xxh64_intdigest(word.casefold().encode("utf-8", "replace"), SEED) & ~15
            value |= ENDS if raw[-1] in ".!?:;" else 0
            value |= NAME if word[0].isupper() and word[1:].islower() else 0
            value |= UNIT if low in UNITS else 0
            value |= NUM if NUMBER.fullmatch(word) else 0
        self[raw] = value
        return value


def canonical(text: str | None, tokens: Tokens) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a text, their canonical hashes, and for each the kind of placeholder or 0."""
    words, literal, kind = typed(text, tokens)
    return words, templated(literal, kind), kind


def typed(text: str | None, tokens: Tokens) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a text, the hashes of the case-folded words, and for each the kind of placeholder or 0."""
    words = GLUED.sub(" ", text).split() if text else []
    value = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    keep = np.flatnonzero(value)
    if len(keep) < len(words):
        words, value = [words[i] for i in keep.tolist()], value[keep]
    flags = (value & np.uint64(15)).astype(np.int64)
    number = flags & NUM > 0
    after_number = np.append(False, number[:-1])[: len(flags)]
    inside = np.append(False, flags[:-1] & ENDS == 0)[: len(flags)]
    kind = np.where(number, NUM, np.where((flags & UNIT > 0) & after_number, UNIT, np.where((flags & NAME > 0) & inside, NAME, 0)))
    return words, value & ~np.uint64(15), kind


def templated(literal: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The hashes with those of the placeholders in their places."""
    hashes = literal.copy()
    for k, h in SLOT.items():
        hashes[kind == k] = np.uint64(h)
    return hashes


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window.  Without placeholders a window has the same as template and as words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = (total + hashes[i : i + n]) * np.uint64(M)
        total ^= total >> np.uint64(29)
    return total


def slot_counts(kind: np.ndarray, size: int) -> np.ndarray:
    """Placeholders in each window; as templates only windows count of which at least half the tokens are literal."""
    filled = np.append(0, np.cumsum(kind > 0))
    return filled[size:] - filled[:-size] if len(kind) >= size else np.zeros(0, np.int64)


#: ``literal``: the hash is of the words; ``fit``: the window counts as a template, of which the item has ``windows`` of ``every`` one.
ITEM = "item_id long, hash long, at int, size int, windows int, every int, literal boolean, fit boolean, slots array<string>"


def _items(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of benchmark items, as words and as templates; an item shorter than a window is one window."""
    tokens = Tokens()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, own, kind = typed(text, tokens)
            size = min(window, len(words))
            if item is None or not size:
                continue
            filled = slot_counts(kind, size)
            fit = 2 * filled <= size
            as_words, as_template = (window_hashes(h, size).astype(np.int64).tolist() for h in (own, templated(own, kind)))
            for at in range(len(filled)):
                rest = (at, size, int(fit.sum()), len(filled))
                values = slots(words, kind, at, size)
                rows.append((item, as_words[at], *rest, True, bool(fit[at]), values))
                if fit[at] and filled[at]:
                    rows.append((item, as_template[at], *rest, False, True, values))
        if rows:
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.bool_(), pa.list_(pa.string())]
            names = ["item_id", "hash", "at", "size", "windows", "every", "literal", "fit", "slots"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def slots(words: list[str], kind: np.ndarray, at: int, size: int) -> list[str]:
    """Values of a window's placeholders, with their type, in order."""
    return [f"{kind[i]}:{EDGE.sub('', words[i]).lower()}" for i in range(at, at + size) if kind[i]]


#: A document: its id, and for one without an id the hash of its text.
DOC = ("doc_id", "text_key")


def _hits(batches: Iterator[pa.RecordBatch], bitmap: bytes, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Windows of documents whose hash is in the bitmap: (doc_id, text_key, hash, at, slots); as words they are null if there are any."""
    tokens, bits = Tokens(), np.frombuffer(bitmap, np.uint8)
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words, own, kind = typed(text.as_py(), tokens)
            for size in sizes:
                filled = slot_counts(kind, size)
                as_words = window_hashes(own, size)
                found = _passing(as_words, bits)
                digest = as_words.astype(np.int64)
                rows += [(doc_id, text_key, int(digest[at]), at, None if filled[at] else []) for at in found.tolist()]
                if not filled.any():
                    continue
                digest = window_hashes(templated(own, kind), size)
                found = _passing(digest, bits)
                digest = digest.astype(np.int64)
                for at in found[(filled[found] > 0) & (2 * filled[found] <= size)].tolist():
                    rows.append((doc_id, text_key, int(digest[at]), at, slots(words, kind, at, size)))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*DOC, "hash", "doc_at", "doc_slots"])


def _passing(digest: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = digest & np.uint64((1 << BITMAP_BITS) - 1)
    return np.flatnonzero(bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)


def _bitmap(items: DataFrame) -> bytes:
    """2**BITMAP_BITS bits, from at most as many bytes as they fill."""
    low = F.col("hash").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bit = F.expr("shiftleft(1, cast(low & 7 as int))")
    found = items.select(low.alias("low")).distinct().groupBy(F.shiftright("low", 3).alias("byte")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in found:
        out[r["byte"]] = r["bits"]
    return out.tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, n_item_windows, reparameterised), one for each item that a document leaks.

    A leak needs as many matching windows in consistent runs on diagonals as ``run`` tokens in a row have, or all of the item if it
    has fewer; that holds for template windows by themselves, and for windows that match either way.  ``reparameterised`` is true if some placeholder has another value than in the item.  Null and empty texts and
    items without an id match nothing; rows of ``docs`` with equal ids count as one document, and so do rows without an id that have
    equal texts, each with a null doc_id; equal benchmark rows count as one item.
    """
    items = cut_lineage(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _items(b, window), ITEM))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    bitmap = _bitmap(items)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(0).alias("text_key"), text.alias("text"))
    hits = texts.mapInArrow(lambda b: _hits(b, bitmap, sizes), "doc_id long, text_key long, hash long, doc_at int, doc_slots array<string>")
    # a hash tells the length of its window, so windows of different lengths do not meet
    same = F.transform("slots", lambda s: F.struct(s.alias("slots"), s.alias("doc_slots")))
    as_template = F.when(F.col("literal"), F.col("fit") & (F.size("slots") == 0) & F.col("doc_slots").isNotNull()).otherwise(True)
    met = (
        hits.join(items, "hash").where(F.col("literal") | (F.size("slots") == F.size("doc_slots")))
        .withColumn("diagonal", F.col("doc_at") - F.col("at"))
        .withColumn("pairs", F.when(F.col("literal"), same).otherwise(F.arrays_zip("slots", "doc_slots")))
        .withColumn("way", F.explode(F.when(as_template, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
        .withColumn("windows", F.when(F.col("way") == 0, F.col("windows")).otherwise(F.col("every")))
    )
    # neighbouring windows of a diagonal are one run
    along = Window.partitionBy(*DOC, "item_id", "diagonal", "way").orderBy("at")
    runs = (
        met.withColumn("run", F.col("at") - F.dense_rank().over(along))
        .select(*DOC, "item_id", "way", "diagonal", "run", "at", "windows", F.explode_outer("pairs").alias("pair"))
        .groupBy(*DOC, "item_id", "way", "diagonal", "run")
        .agg(F.collect_set("at").alias("at"), F.max("windows").alias("windows"), F.collect_set("pair").alias("pairs"))
    )
    own = F.transform("pairs", lambda p: p["slots"])
    fits = F.size(F.array_distinct(own)) == F.size("pairs")
    other = F.exists("pairs", lambda p: p["slots"] != p["doc_slots"])
    found = (
        runs.where(fits).withColumn("other", other)
        .groupBy(*DOC, "item_id", "way")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_windows"), F.max("windows").alias("n_item_windows"), F.max("other").alias("reparameterised"))
        .where(F.col("n_windows") >= F.least(F.col("n_item_windows"), F.lit(run - window + 1)))
    )
    return found.groupBy(*DOC, "item_id").agg(*[F.max(c).alias(c) for c in ("n_windows", "n_item_windows", "reparameterised")]).drop("text_key")
