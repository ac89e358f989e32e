"""Text search over a stored index: chunks, BM25, matched terms and titles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.search.index import Index
from factline.session import cut_lineage

# Chunk size and overlap, shortest prefix, BM25 parameters.
CHUNK_CHARS, CHUNK_OVERLAP = 1200, 150
PREFIX_MIN = 3
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
QUERY_TOKEN = r"[A-Za-z0-9][A-Za-z0-9'_-]{1,}"


def chunks(docs: DataFrame, key: Sequence[str], text: str = "text", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping pieces of the whole text with a hash prefix each; no document is cut short."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    n = F.length("_flat")
    last = F.when(n <= size, 0).otherwise(F.floor((n - 1) / (size - overlap)).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * (size - overlap))
    spread = docs.select(*key, flat.alias("_flat")).where(n > 0).select(*key, "_flat", F.posexplode(starts).alias("chunk_index", "_at"))
    piece = F.col("_flat").substr(F.col("_at") + 1, F.lit(size))
    return spread.select(*key, "chunk_index", piece.alias("chunk_text")).withColumn("content_sha", F.substring(F.sha2("chunk_text", 256), 1, 16))


def query_tokens(q: str) -> list[str]:
    return [t.lower() for t in re.findall(QUERY_TOKEN, q)]


def bm25(index: Index, key: str, q: str, limit: int) -> DataFrame:
    """Best keys for a query; every token must occur, exactly or (three letters and more) as a prefix.

    The exact term and the prefix are two phrases, each with its own document frequency.  Only
    postings of the query's terms are read; corpus size and mean length are one stored row.
    """
    tokens = query_tokens(q)
    if not tokens:
        raise ValueError("no searchable token in the query")
    phrases: list[tuple[int, Column]] = []
    wanted = F.lit(False)
    for i, t in enumerate(tokens):
        phrases.append((i, F.col("term") == t))
        if len(t) >= PREFIX_MIN:
            phrases.append((i, F.col("term").startswith(t)))
        wanted = wanted | phrases[-1][1]
    hits = index.postings.where(wanted).groupBy(key, "dl").agg(
        *[F.sum(F.when(test, F.col("tf")).otherwise(0)).alias(f"f{j}") for j, (_, test) in enumerate(phrases)]
    )
    hits = cut_lineage(hits)  # only documents that hold a query term; read for statistics and for scores
    df = hits.agg(*[F.count(F.when(F.col(f"f{j}") > 0, 1)).alias(f"d{j}") for j in range(len(phrases))])
    stats = df.select(F.struct(*[F.col(f"d{j}") for j in range(len(phrases))])).scalar()
    c = index.corpus.select(F.struct("n", "avgdl")).scalar()
    full = hits.withColumn("_d", stats).withColumn("_c", c)
    for i in range(len(tokens)):
        any_phrase = F.lit(False)
        for j, (k, _) in enumerate(phrases):
            if k == i:
                any_phrase = any_phrase | (F.col(f"f{j}") > 0)
        full = full.where(any_phrase)
    score = F.lit(0.0)
    norm = K1 * (1 - B + B * F.col("dl") / F.col("_c.avgdl"))
    for j in range(len(phrases)):
        n, d, f = F.col("_c.n"), F.col(f"_d.d{j}"), F.col(f"f{j}")
        raw = F.log((n - d + 0.5) / (d + 0.5))
        idf = F.when(raw <= 0, IDF_FLOOR).otherwise(raw)
        score = score + idf * f * (K1 + 1) / (f + norm)
    ranked = full.select(key, F.round(score, 9).alias("bm25")).orderBy(F.desc("bm25"), key).limit(limit)
    return ranked.withColumn("score", 1 / (1 + F.abs("bm25")))


def matched_terms(text: Column, q: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in query_tokens(q)]))


def highlight(text: Column, q: str) -> Column:
    """Every query token wrapped in « », longest token first."""
    tokens = sorted(set(query_tokens(q)), key=lambda t: (-len(t), t))
    if not tokens:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(t) for t in tokens) + ")", "«$1»")


# What an identifier at the head of a name looks like.
ID_HEADS = (r"^[A-Z]{2,12}(?:-[A-Z0-9]{1,12})*$", r"^[A-Z]{1,6}-\d{2,4}(?:-\d{2,6})+$", r"^\d{4,}$")


def looks_like_id(segment: Column) -> Column:
    head = F.regexp_extract(F.trim(segment), r"^(\S+)", 1)
    return head.rlike("|".join(f"(?:{p})" for p in ID_HEADS))


def display_title(name: Column, q: str) -> Column:
    """The deepest path segment that holds a token; else the name without a leading id."""
    parts = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), " / "), lambda p: F.trim(p)), lambda p: p != "")
    tokens = query_tokens(q)

    def hit(p: Column) -> Column:
        test = F.lit(False)
        for t in tokens:
            test = test | F.lower(p).contains(t)
        return test

    matching = F.filter(parts, hit)
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " / ")
    tail = F.when((F.size(parts) >= 2) & looks_like_id(F.get(parts, F.lit(0))), rest).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("Spending item")))
    return F.when(F.size(matching) > 0, F.try_element_at(matching, F.lit(-1))).otherwise(tail)


# Dashboard mode of each compatibility group.
GROUP_MODE = {
    "actual_expense": "actuals", "budget_estimate": "budget", "estimated_actual": "budget", "budget_expense": "budget",
    "gfs_liability": "debt", "gfs_revenue": "revenue", "tax_revenue": "revenue", "gdp": "gdp",
}


def mode_of_group(group: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUP_MODE.items() for x in kv]), group)


def deep_link(group: Column, level: Column, year: Column, fact: Column, name: Column) -> Column:
    """Query string of the page that shows a fact; commitments go to the contract explorer."""

    def pairs(**params: Column) -> Column:
        return F.concat_ws("&", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in params.items()])

    f = fact.cast("string")
    contract = F.concat(F.lit("/explorers/contracts/?"), pairs(year=year, fact=f, q=name))
    mode = F.coalesce(mode_of_group(group), F.lit("actuals"))
    return F.when(group == "commitment", contract).otherwise(F.concat(F.lit("/?"), pairs(mode=mode, level=level, year=year, fact=f, highlight=name)))
