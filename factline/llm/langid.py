"""Language identification in two levels: the family first, then the languages of that family one against one.

A text is its frequencies of hashed byte n-grams of the lower-cased text.  One linear support vector machine per family
tells it from the others; within a family, one per pair of languages votes.  Each machine is fitted by stochastic subgradient
steps in a task of its own on a bounded sample and is a row of weights.  Every language found is learned, however many there
are; the model grows with their number (33 kB a machine), not with the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.session import cut_lineage

UNKNOWN = "und"
BINS = 1 << 13
ORDERS = (1, 2, 3)
#: Documents of a language to learn from, on average, at most; the sample keeps those with the smallest hashes.
SAMPLE = 800
#: Documents on either side of a family's machine, on average, at most, as a multiple of ``SAMPLE``.
SIDE = 4
EPOCHS, REGULAR, BATCH, SCALE = 30, 1e-4, 32, 20.0

#: Families of languages by code (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().partition("-")[0], "=" + lang)


def frequencies(text: str) -> np.ndarray:
    """Shares of the bins among all n-grams of the text with a blank at either end; the whole text counts."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out, code = np.zeros(BINS, np.int64), np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        code = (code[: len(data) - order + 1] << np.uint32(8)) | data[order - 1 :]
        if order in ORDERS:
            out += np.bincount(((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=BINS)
    return (out / max(1, out.sum()) * SCALE).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


@dataclass(frozen=True)
class Model:
    """``families``: name -> languages; rows of weights (the last one the bias) for each family, then for each pair."""

    families: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        if not names:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        one = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margin = one @ self.family_weights.T
        best = margin.argmax(axis=1)
        rest = np.where(np.arange(len(names)) == best[:, None], -np.inf, margin).max(axis=1) if len(names) > 1 else np.full(len(x), -np.inf)
        score = 1 / (1 + np.exp(np.clip(rest - margin[np.arange(len(x)), best], -30, 30))) if len(names) > 1 else np.ones(len(x))
        lang = np.array([self.families[names[b]][0] for b in best], object)
        for b, name in enumerate(names):
            own, langs = np.flatnonzero(best == b), self.families[name]
            if len(langs) < 2 or not len(own):
                continue
            votes, sums = np.zeros((len(own), len(langs))), np.zeros((len(own), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                m = one[own] @ self.pair_weights[langs[i], langs[j]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
            # most votes; equal votes by the sum of margins
            rank = votes + 1 / (1 + np.exp(-np.clip(sums, -30, 30))) * 0.5
            pick = rank.argmax(axis=1)
            lang[own] = np.array(langs, object)[pick]
            score[own] *= 1 / (1 + np.exp(-np.clip(2 * sums[np.arange(len(own)), pick] / (len(langs) - 1), -30, 30)))
        return lang.tolist(), score


def svm(one: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine for y in {-1, 1}, classes weighted evenly, averaged over the last half.

    The last column of ``one`` is 1, for the bias.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, kept, t = np.zeros(one.shape[1]), np.zeros(one.shape[1]), 0, 0
    rng = np.random.default_rng(seed)
    steps = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            t += 1
            rate = 1 / (1 + REGULAR * 100 * t)
            hit = y[rows] * (one[rows] @ w) < 1
            pull = (share[rows] * y[rows] * hit) @ one[rows] / len(rows)
            w = (1 - rate * REGULAR) * w + rate * pull
            if 2 * t > steps:
                mean += w
                kept += 1
    return (mean / max(1, kept)).astype(np.float32)


@F.pandas_udf(T.StructType([T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())]))
def sparse(text: pd.Series) -> pd.DataFrame:
    """The bins that a text has, and their shares: at most 49 kB, however long the text."""
    out = []
    for t in text:
        x = frequencies(t)
        at = np.flatnonzero(x)
        out.append((at.astype(np.uint16).tobytes(), x[at].tobytes()))
    return pd.DataFrame(out, columns=["at", "share"])


MACHINE = "family string, a string, b string"


def machine(rows: pd.DataFrame) -> pd.DataFrame:
    """Fit the machine of a family, or of two languages of it, on the rows dealt to it."""
    rows = rows.sort_values(["place", "at", "share"], kind="stable")
    one = np.zeros((len(rows), BINS + 1), np.float32)
    one[:, BINS] = 1
    for i, (at, share) in enumerate(zip(rows["at"], rows["share"], strict=True)):
        one[i, np.frombuffer(at, np.uint16)] = np.frombuffer(share, np.float32)
    return rows[["family", "a", "b"]].head(1).assign(w=[svm(one, rows["y"].to_numpy()).tobytes()])


def fit(docs: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on documents with an id, a language and a letter in their text for which ``may_learn`` (of doc_id) holds.

    About ``sample`` documents of each language are taken, those with small hashes of id and text; counting the languages
    covers all rows.  A pair's machine sees the sample of both; a family's machine sees about ``SIDE * sample`` of its own and
    as many of the other documents of the sample.  One row per language and the weights reach the driver.
    """
    known = docs.where(may_learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").cast("string").rlike(r"\p{L}"))
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = cut_lineage(known.groupBy("lang").agg(F.count("*").alias("n")))
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40))
    chosen = known.withColumn("place", place).join(found, "lang").where(F.col("place") * F.col("n").cast("double") < F.lit(float(sample << 40)))
    chosen = cut_lineage(chosen.select("lang", "place", sparse("text").alias("x")).select("lang", "place", "x.*"))
    size = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    families: dict[str, list[str]] = {}
    for lang in sorted(size):
        families.setdefault(family_of(lang), []).append(lang)
    names = list(families)
    number = {f: i for i, f in enumerate(names)}
    inside = np.array([sum(size[lang] for lang in families[f]) for f in names], float)
    own, other = SIDE * sample / np.maximum(1, inside), SIDE * sample / np.maximum(1, inside.sum() - inside)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                out = []
                for lang, place, at, share in batch.iloc[start : start + 256].itertuples(index=False):
                    family = family_of(lang)
                    mine = number[family]
                    taken = np.random.default_rng(place).random(len(names)) < np.where(np.arange(len(names)) == mine, own, other)
                    if len(names) > 1:
                        out += [(names[f], "", "", 1 if f == mine else -1, place, at, share) for f in np.flatnonzero(taken)]
                    out += [(family, min(lang, o), max(lang, o), 1 if lang < o else -1, place, at, share) for o in families[family] if o != lang]
                yield pd.DataFrame(out, columns=["family", "a", "b", "y", "place", "at", "share"])

    rows = chosen.mapInPandas(dealt, f"{MACHINE}, y int, place long, at binary, share binary")
    fitted = rows.groupBy("family", "a", "b").applyInPandas(machine, f"{MACHINE}, w binary").collect() if len(size) > 1 else []
    vector = {(r["family"], r["a"], r["b"]): np.frombuffer(bytes(r["w"]), np.float32) for r in fitted}
    blank = np.zeros(BINS + 1, np.float32)
    weights = np.array([vector.get((f, "", ""), blank) for f in names], np.float32).reshape(len(names), BINS + 1)
    return Model(families, weights, {(a, b): v for (_, a, b), v in vector.items() if b})


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; a text that is null or has no letter is ``und`` with score 0."""

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            langs, scores = [UNKNOWN] * len(series), np.zeros(len(series))
            for at in range(0, len(series), 256):
                rows = [i for i in range(at, min(at + 256, len(series))) if has_letter(series.iat[i])]
                if rows:
                    found, score = model.predict(np.array([frequencies(series.iat[i]) for i in rows]))
                    scores[rows] = score
                    for i, lang in zip(rows, found, strict=True):
                        langs[i] = lang
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    found = identify(F.col("text").cast("string"))
    return docs.withColumn("_lang", found).withColumn("lang_pred", F.col("_lang.lang_pred")).withColumn("score", F.col("_lang.score")).drop("_lang")
