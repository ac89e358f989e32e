"""Quality rules whose cutoffs are chosen under a proven risk of rejecting good documents.

Every rule is a share in [0, 1], taken in hundredths (rounded up), its level, and rejects a text of a level above its cutoff.
The cutoffs are found on labelled documents, stratum by stratum, in two parts that share no document:

* A third of them ranks the levels of each rule by severity: those beyond every good document first, by their distance, then
  those that few good ones reach.  A rule that takes no more of the bad documents than the risk allows of the good ones takes
  no part.  A text is as severe as its most severe level, so that one number orders all cutoffs of all rules jointly.
* The other two thirds, the holdout, prove: from the laxest severity to stricter ones, the exact binomial test asks whether the
  share of good documents above it is under the allowed risk, and stops at the first that fails (a fixed sequence, so
  testing many costs nothing, and the whole risk goes to the joint cutoffs).

Strata that the first part ranks share the error rate by their good documents in it (Bonferroni with weights), so that with
confidence ``1 - error`` every stratum loses at most ``risk`` of its good documents.  Among the proven severities the one that
parts bad from good documents best is taken.  A stratum with too few labels to prove anything keeps all that the base rules
keep; it is not pooled with others, since a bound on a pool says nothing of one stratum in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm.textual import encoded
from factline.session import cut_lineage

WINDOW = 8
LEVELS = 100
RULES = ("symbol_share", "mark_share", "capital_share", "dup_line_share", "repeat_share", "shortness")
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")
COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CAPITALS = bytes(range(65, 91))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of words that is found twice or more in the text, its first finding included.

    Windows are numbered by pairing: equal numbers mean equal runs of 1, 2, 4, 8 words, so nothing rests on a hash.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    run, length = ids, 1
    while length < window:
        step = min(length, window - length)
        pair = run[: len(run) - step] * (int(run.max()) + 1) + run[step:]
        distinct, run = np.unique(pair, return_inverse=True)
        length += step
        if len(distinct) == len(run):
            return 0
    hit = np.bincount(run)[run] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    return int((np.cumsum(edge[:n]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The figures of ``COUNTS`` for one text; null and empty texts have none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    data = encoded(text)
    words = data.split()
    lines, seen, repeated = 0, set(), 0
    for line in data.split(b"\n"):
        if line.strip(BLANKS):
            lines += 1
            repeated += line in seen
            seen.add(line)
    blanks = len(data) - len(data.translate(None, BLANKS))
    return (
        len(words), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)),
        len(data) - len(data.translate(None, MARKS)), len(data) - len(data.translate(None, CAPITALS)),
        lines, repeated, repeated_words(words),
    )


@F.pandas_udf(COUNTS_TYPE)
def text_counts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in text], columns=list(COUNTS), dtype="int64")


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_counts``; the stratum is the language, null being one of its own."""
    return docs.withColumn("_counts", text_counts(F.col("text").cast("string")))


def base_failed() -> Column:
    words = F.col("_counts.n_words")
    return (words < MIN_WORDS) | (100 * F.col("_counts.n_repeat_words") > MAX_REPEAT_PERCENT * words)


def shares() -> dict[str, Column]:
    """The rules' shares; a text without words has none above zero."""
    c = {k: F.col(f"_counts.{k}") for k in COUNTS}

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(part / whole, F.lit(1.0))).otherwise(F.lit(0.0))

    return {
        "symbol_share": share(c["n_symbols"], c["word_chars"]),
        "mark_share": share(c["n_marks"], c["word_chars"]),
        "capital_share": share(c["n_capitals"], c["word_chars"]),
        "dup_line_share": share(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": share(c["n_repeat_words"], c["n_words"]),
        "shortness": share(c["n_words"], c["word_chars"]),
    }


def levels() -> dict[str, Column]:
    return {rule: F.ceil(share * LEVELS).cast("int") for rule, share in shares().items()}


def stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("none"))


@dataclass(frozen=True)
class Cutoffs:
    """``table[stratum][rule]`` is a level above which a text is rejected; what is missing rejects nothing."""

    table: dict[str, dict[str, int]]

    def rejects(self) -> Column:
        verdict = F.lit(False)
        for rule, level in levels().items():
            of = {s: row[rule] for s, row in self.table.items() if rule in row}
            if of:
                pairs = F.create_map(*[F.lit(x) for kv in sorted(of.items()) for x in kv])
                verdict = verdict | F.coalesce(level > F.try_element_at(pairs, stratum()), F.lit(False))
        return verdict


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method; some sqrt(max(a, b)) terms."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 100 + 20 * int(math.sqrt(max(a, b)))):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return total


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial: the regularised incomplete beta function of (n - k, k + 1) at 1 - p."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1 - front * _beta_fraction(b, a, p) / b)


def choose(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> float | None:
    """Cutoff, as a share of ``LEVELS``, from counts by severity (0 to ``LEVELS``): the best of those proven safe."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return None
    above_good = n_good - np.cumsum(good)  # at cutoff j/LEVELS: severities j+1 and up
    above_bad = n_bad - np.cumsum(bad)
    best, found = 0.0, None
    for j in range(LEVELS, -1, -1):
        if binomial_tail(int(above_good[j]), n_good, risk) > error:
            break
        gain = above_bad[j] / n_bad - above_good[j] / n_good
        if gain > best:
            best, found = gain, j / LEVELS
    return found


def severities(good: np.ndarray, bad: np.ndarray, risk: float) -> np.ndarray:
    """The severity of each level of a rule, never falling, from the first part's counts by level; 0 is never rejected.

    Upper half: beyond every good document, by the distance from the highest of them.  Lower half: at most ``2 * risk`` of
    the good documents reach the level, fewer being more severe.
    """
    out = np.zeros(LEVELS + 1, np.int64)
    n, half = int(good.sum()), LEVELS // 2
    reached = np.cumsum(good[::-1])[::-1]  # good documents of this level or a higher one
    allowed = reached <= risk * n
    if not n or not bad.sum() or not allowed.any():
        return out
    first = int(allowed.argmax())
    if bad[first:].sum() / bad.sum() - good[first:].sum() / n <= risk:
        return out
    top = int(np.flatnonzero(good).max())
    out[: top + 1] = np.maximum(0, np.floor(half * (1 - reached[: top + 1] / (2 * risk * n))))
    beyond = np.arange(1, LEVELS - top + 1)
    out[top + 1 :] = half + -(-half * beyond // max(1, LEVELS - top))
    return out


def labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """``_id, stratum, _good, at`` (an array of rule and level), one row per labelled document that passes the base rules.

    A document is one trial however often its label or its row is given; labels of 0 and 1 for one document, labels of other
    values and null ids count for nothing.  Of rows with equal ids that differ, the least by stratum and levels counts.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_good"), F.max("quality").alias("_most"))
        .where(F.col("_good") == F.col("_most")).drop("_most")
    )
    at = F.array(*[F.struct(F.lit(r).alias("rule"), level.alias("level")) for r, level in levels().items()])
    rows = counted.select("doc_id", "lang", "_counts").where(~base_failed()).join(known, F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min(F.struct(stratum().alias("stratum"), at.alias("at"), "_good")).alias("_row")).select("_id", "_row.*")


def _counted(rows: pd.DataFrame, by: str) -> np.ndarray:
    """Counts of [bad, good] by ``by``."""
    out = np.zeros((2, LEVELS + 1), np.int64)
    np.add.at(out, (rows["_good"].to_numpy(), rows[by].to_numpy()), rows["count"].to_numpy())
    return out


def fit_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> Cutoffs:
    """Fit on documents with a ``quality`` label that pass the base rules; ``labelled`` says which count.

    ``counted`` has doc_id, lang and ``_counts``.  Tasks see counts only: of a stratum by rule and level, then by severity.
    The cutoffs of proven strata reach the driver; a stratum needs at least ``log(error) / log(1 - risk)`` good labels.
    """
    rows = cut_lineage(labelled(counted, labels).withColumn("_first", F.pmod(F.xxhash64(F.lit("holdout"), "_id"), F.lit(3)) == 0))
    single = rows.select("_id", "stratum", "_good", "_first", F.explode("at").alias("_at")).select("_id", "stratum", "_good", "_first", "_at.*")

    def ranked(cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rule, own in cells.groupby("rule"):
            bad, good = _counted(own, "level")
            found = severities(good, bad, risk)
            if found.any():
                out += [(cells["stratum"].iat[0], rule, j, int(s), int(good.sum())) for j, s in enumerate(found)]
        return pd.DataFrame(out, columns=["stratum", "rule", "level", "severity", "n"])

    cells = single.where("_first").groupBy("stratum", "rule", "level", "_good").count()
    ladder = cut_lineage(cells.groupBy("stratum").applyInPandas(ranked, "stratum string, rule string, level int, severity int, n long"))
    total = ladder.select("stratum", "n").distinct().agg(F.sum("n").alias("n")).first()["n"]

    def proven(held: pd.DataFrame) -> pd.DataFrame:
        bad, good = _counted(held, "severity")
        cut = choose(good, bad, risk, error * held["n"].iat[0] / total)
        return pd.DataFrame([] if cut is None else [(held["stratum"].iat[0], round(cut * LEVELS))], columns=["stratum", "cut"])

    severe = (
        single.where(~F.col("_first")).join(ladder, ["stratum", "rule", "level"])
        .groupBy("_id").agg(F.first("stratum").alias("stratum"), F.first("_good").alias("_good"), F.max("severity").alias("severity"), F.first("n").alias("n"))
        .groupBy("stratum", "severity", "_good").agg(F.count("*").alias("count"), F.first("n").alias("n"))
    )
    cuts = severe.groupBy("stratum").applyInPandas(proven, "stratum string, cut int")
    found = ladder.join(cuts, "stratum").where(F.col("severity") <= F.col("cut")).groupBy("stratum", "rule").agg(F.max("level").alias("level"))
    table: dict[str, dict[str, int]] = {}
    for r in found.where(F.col("level") < LEVELS).collect():
        table.setdefault(r["stratum"], {})[r["rule"]] = r["level"]
    return Cutoffs(table)
