"""Main text of pages by wrappers inferred for each host.

A page is a stream of tokens: element paths and text.  The streams of a host's pages are aligned one after another into a
union-free regular expression.  Where texts differ, a slot takes their place; a unit that repeats becomes a repeated group; what
only some of the pages have becomes optional.  Texts that stay the same on all pages of a host, where the rest of the article
region varies, belong to the template and are no article text.

Every page of a host goes into its wrapper.  Each task folds the pages it reads into one wrapper a host; these
are merged by host and salt, then by host, so a host with a third of all pages is never one task's work.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.blocks import Block, blocks

#: Pages, and different texts elsewhere in the region, that must agree before a constant text counts as template.
SUPPORT = 5
#: Tokens of a repeated unit.
UNIT = 4
SALTS = 32
#: Wrappers held in a task before they are passed on.
HELD = 5000
#: Texts of a slot that are told apart; more make no difference.
DISTINCT = SUPPORT


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def token(block: Block) -> dict:
    """A token of the stream: its path, the pages it is on, whether it is optional or repeated, its texts, and those all pages have."""
    text = [digest(block.text)]
    return {"key": block.path, "n": 1, "opt": 0, "rep": 0, "texts": text, "same": text, "main": int(block.content and not block.noise)}


def add_texts(a: list[str], b: list[str]) -> list[str]:
    return sorted({*a, *b})[:DISTINCT] if a != b else a


def collapse(stream: list[dict]) -> list[dict]:
    """Units that follow themselves become one repeated group, shorter units first."""
    for unit in range(1, UNIT + 1):
        out: list[dict] = []
        at = 0
        while at < len(stream):
            end = at + unit
            keys = [t["key"] for t in stream[at:end]]
            merged = [dict(t) for t in stream[at:end]]
            again = end
            while len(keys) == unit and [t["key"] for t in stream[again : again + unit]] == keys:
                for t, u in zip(merged, stream[again : again + unit], strict=True):
                    t["texts"] = add_texts(t["texts"], u["texts"])
                    t["same"] = sorted({*t["same"], *u["same"]})
                    t["rep"] = 1
                again += unit
            if again > end:
                out += merged
                at = again
            else:
                out.append(stream[at])
                at += 1
        stream = out
    return stream


def merged(a: dict, b: dict) -> dict:
    """One token for two streams' tokens with the same path."""
    same = a["same"] if a["same"] == b["same"] else sorted({*a["same"]} & {*b["same"]})
    return {"key": a["key"], "n": a["n"] + b["n"], "opt": a["opt"] | b["opt"], "rep": a["rep"] | b["rep"], "texts": add_texts(a["texts"], b["texts"]), "same": same, "main": a["main"] & b["main"]}


def align(a: dict, b: dict) -> dict:
    """Two wrappers {n, stream} as one.  Tokens with equal paths meet in order; the others become optional where they stand."""
    x, y = a["stream"], b["stream"]
    kx, ky = [t["key"] for t in x], [t["key"] for t in y]
    if kx == ky:
        return {"n": a["n"] + b["n"], "stream": [merged(s, t) for s, t in zip(x, y, strict=True)]}
    out: list[dict] = []
    for op, i, j, k, m in SequenceMatcher(None, kx, ky, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merged(s, t) for s, t in zip(x[i:j], y[k:m], strict=True)]
        else:
            out += [t | {"opt": 1} for t in x[i:j] + y[k:m]]
    return {"n": a["n"] + b["n"], "stream": collapse_options(out)}


def collapse_options(stream: list[dict]) -> list[dict]:
    """Optional tokens with the same path side by side are one repeated, optional token."""
    out: list[dict] = []
    for t in stream:
        if out and t["opt"] and out[-1]["key"] == t["key"]:
            out[-1] = merged(out[-1], t) | {"rep": 1, "n": max(out[-1]["n"], t["n"])}
        else:
            out.append(t)
    return out


def wrapper_of(page: list[Block]) -> dict:
    return {"n": 1, "stream": collapse([token(b) for b in page if not b.noise])}


def template_texts(wrapper: dict) -> list[str]:
    """Digests of article-region texts that every page has unchanged, if enough pages differ in the rest of the region."""
    region = [t for t in wrapper["stream"] if t["main"]] or wrapper["stream"]
    if wrapper["n"] < SUPPORT or max((len(t["texts"]) for t in region), default=0) < DISTINCT:
        return []
    return [text for t in region if t["n"] == wrapper["n"] and not t["opt"] for text in t["same"]]


def main_text(page: list[Block], template: set[str]) -> str:
    """Blocks of the article joined by an empty line.

    That is what stands in article or main elements; a page without them gives all blocks that are not mostly links.
    Navigation, site headers, footers, asides, forms and what is named like an advert, a notice or comments are left out,
    and so are texts of the host's template.
    """
    own = [b for b in page if not b.noise]
    inside = [b for b in own if b.content]
    own = inside or [b for b in own if 2 * b.linked <= len(b.text)]
    return "\n\n".join(b.text for b in own if not template or digest(b.text) not in template)


def fold(wrappers: Iterator[tuple[str, dict]]) -> Iterator[tuple[str, dict]]:
    """One wrapper a host, or several if there are more hosts than are held at a time."""
    held: dict[str, dict] = {}
    for host, w in wrappers:
        held[host] = align(held[host], w) if host in held else w
        if len(held) > HELD:
            yield from held.items()
            held = {}
    yield from held.items()


def _packed(found: Iterator[tuple[str, dict]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, str]] = []
    for host, w in found:
        rows.append((host, json.dumps(w)))
        if len(rows) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "wrapper"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "wrapper"])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = ((h.as_py(), wrapper_of(blocks(p.as_py()))) for batch in batches for h, p in zip(batch.column(0), batch.column(1), strict=True))
    yield from _packed(fold(pages))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _packed(fold((h.as_py(), json.loads(w.as_py())) for batch in batches for h, w in zip(batch.column(0), batch.column(1), strict=True)))


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last merge: hosts come sorted, so each is complete when the next one starts."""
    rows: list[tuple[str, str]] = []

    def complete():
        host, w = None, None
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                other = json.loads(text)
                if h == host:
                    w = align(w, other)
                else:
                    if host is not None:
                        yield host, w
                    host, w = h, other
        if host is not None:
            yield host, w

    for host, w in complete():
        if found := template_texts(w):
            rows.append((host, json.dumps(found)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "template"])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, wrapper) from ``pages`` (url, html), partial: one or more for each host, salt and task."""
    partial = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_learned, "host string, wrapper string")
    salted = partial.repartition(F.col("host"), F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return salted.mapInArrow(_merged, "host string, wrapper string")


def with_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and any others) with ``text`` and ``n_chars``, its code points.

    A null or empty html has an empty text; a null url, or one without a host, belongs to the host "".  Rows with the same
    html have the same text if their host is the same.
    """
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    whole = wrappers(pages).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_templates, "host string, template string")
    rows = pages.select(host_of(F.col("url")).alias("_host"), F.col("html").cast("string").alias("html"), F.struct(*columns).alias("_all"))
    # the few template rows are copied to every salt, so that the pages of one host are dealt to many tasks
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_all"), F.lit(SALTS)))
    whole = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = rows.join(whole, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("salt")), "left")

    @F.pandas_udf("string")
    def extract(pages: pd.Series, templates: pd.Series) -> pd.Series:
        read: dict[str, set[str]] = {}
        out = []
        for page, template in zip(pages, templates, strict=True):
            if template and template not in read:
                read[template] = set(json.loads(template))
            out.append(main_text(blocks(page), read.get(template, set()) if template else set()))
        return pd.Series(out, dtype=object)

    found = known.select("_all", extract("html", "template").alias("text"))
    return found.select(*[F.col("_all")[c].alias(c) for c in columns], "text", F.length("text").cast("long").alias("n_chars"))
