import random
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from factline.llm import rules as R

BLANK = set(" \t\n\x0b\x0c\r")


def slow(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in BLANK:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if set(x) - BLANK]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def figures(text):
    c = dict(zip(R.COUNTS, R.counts_of(text), strict=True))
    return c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]


def test_counts_equal_slow_ones():
    rng = random.Random(1)
    cases = [None, "", " \n\t ", "a", "a b c d", "x\x0by\x0cz\r\n", "é#* $%&|<> é", "one two\n\none two\none two ", "ab " * 300]
    for _ in range(60):
        cases.append(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))))
        cases.append("\n".join(rng.choice(["a b", "", " ", "c d e", "a b "]) for _ in range(rng.randint(0, 12))))
    for text in cases:
        assert figures(text) == slow(text), text


def test_very_long_text():
    text = " ".join(f"w{i}" for i in range(200_000)) + " w0 w1 w2 w3 w4 w5 w6 w7"
    assert figures(text)[0] == 200_008 and figures(text)[4] == 16


def test_binomial_tail_is_exact():
    assert R.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert R.binomial_tail(3, 3, 0.2) == 1.0
    assert R.binomial_tail(1, 4, 0.5) == pytest.approx(5 / 16)
    for n, p in ((1, 0.3), (7, 0.5), (60, 0.05), (400, 0.05), (400, 0.9)):
        part = Fraction(str(p))
        total = Fraction(0)
        for k in range(n):
            total += comb(n, k) * part**k * (1 - part) ** (n - k)
            assert R.binomial_tail(k, n, p) == pytest.approx(float(total), rel=1e-9, abs=1e-300)
    assert R.binomial_tail(500_000, 10_000_000, 0.05) == pytest.approx(0.5, abs=0.001)


def test_cutoffs_hold_the_risk_and_need_evidence():
    good, bad = np.zeros(101, np.int64), np.zeros(101, np.int64)
    good[2], bad[60], good[70] = 2000, 100, 1
    cut = R.choose(good, bad, 0.01, 0.01)
    assert 0.02 <= cut < 0.60
    assert R.choose(good // 100, bad, 0.01, 0.01) is None  # too few to prove anything
    good[70] = 300
    cut = R.choose(good, bad, 0.01, 0.01)
    assert cut is None or cut >= 0.70
    assert R.choose(good, np.zeros(101, np.int64), 0.01, 0.01) is None


def test_fit_and_apply(spark, docs_of):
    rng = random.Random(2)
    plain = lambda i: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) + f" d{i}"
    rows = [(i, plain(i), "en" if i % 4 else None, "s") for i in range(1600)]
    rows += [(i, plain(i).replace(" ", "### "), "en", "s") for i in range(1600, 1700)]
    rows += [(None, plain(0), "en", "s"), (1, plain(1), "en", "s"), (5000, "too short", "en", "s"), (5001, None, "en", "s"), (5002, "one two " * 40, "en", "s")]
    df = docs_of(rows)
    labels = spark.createDataFrame([(i, int(i < 1600), 0, "x") for i in range(1700)] + [(None, 1, 0, "x"), (3, None, 0, "x")], "doc_id long, quality int, toxic int, lang string")
    counted = R.with_counts(df)
    cutoffs = R.fit_cutoffs(counted, labels)
    assert set(cutoffs.table) == {"=en"} and "symbol_share" in cutoffs.table["=en"]
    out = [(r["doc_id"], r["kept"]) for r in counted.select("doc_id", (~R.base_failed() & ~cutoffs.rejects()).alias("kept")).collect()]
    assert len(out) == len(rows)
    lost = {i for i, kept in out if not kept}
    assert {5000, 5001, 5002} <= lost and len([i for i in lost if i is not None and i < 1600]) <= 0.05 * 1600
    assert len([i for i in lost if i is not None and 1600 <= i < 1700]) == 100


def test_severities_order_levels():
    good, bad = np.zeros(101, np.int64), np.zeros(101, np.int64)
    good[3], good[10], bad[40] = 195, 5, 50
    found = R.severities(good, bad, 0.05)
    assert (np.diff(found) >= 0).all() and found[3] == 0 < found[4] <= 50 < found[11] < found[40] < found[100] == 100
    assert not R.severities(good, good, 0.05).any()  # tells nothing apart
    assert not R.severities(good, np.zeros(101, np.int64), 0.05).any() and not R.severities(bad * 0, bad, 0.05).any()
    assert (R.severities(np.eye(101, dtype=np.int64)[100] * 9, good, 0.05) == 0).all()


def test_whole_risk_needs_fewer_labels():
    """59 good documents prove a risk of 0.05 at an error of 0.05; a share of the risk for each of six rules took 572."""
    good, bad = np.zeros(101, np.int64), np.zeros(101, np.int64)
    good[0], bad[80] = 59, 9
    assert R.choose(good, bad, 0.05, 0.05) is not None
    good[0] = 58
    assert R.choose(good, bad, 0.05, 0.05) is None


def test_stated_risk_holds_in_simulations():
    """Two rules on random documents; the chosen cutoffs reject more than the risk of good documents in at most 1 run of 20."""
    rng, risk, runs, broken, chosen = np.random.default_rng(5), 0.05, 400, 0, 0
    draw = lambda n, mean: np.minimum(100, rng.poisson(mean, (n, 2)))
    for _ in range(runs):
        first = [draw(60, m) for m in (12, 6)]
        ladders = [R.severities(*(np.bincount(part[:, r], minlength=101) for part in first[::-1]), risk) for r in range(2)]
        severe = lambda part: np.max([ladders[r][part[:, r]] for r in range(2)], axis=0)  # noqa: B023, E731
        counts = [np.bincount(severe(draw(200, m)), minlength=101) for m in (6, 12)]
        cut = R.choose(*counts, risk, 0.05)
        if cut is not None:
            chosen += 1
            broken += (severe(draw(20_000, 6)) > round(cut * 100)).mean() > risk
    assert chosen > runs / 4 and broken <= 0.05 * runs


def test_labels_given_again_prove_nothing_more(spark, docs_of):
    rng = random.Random(3)
    text = lambda i, mark: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + mark for _ in range(30)) + f" d{i}"
    rows = [(i, text(i, ""), "en", "s") for i in range(60)] + [(i, text(i, "###"), "en", "s") for i in range(60, 90)]
    counted = R.with_counts(docs_of(rows))
    one = [(i, int(i < 60)) for i in range(90)]
    schema = "doc_id long, quality int"
    assert R.fit_cutoffs(counted, spark.createDataFrame(one, schema)).table == {}
    assert R.fit_cutoffs(R.with_counts(docs_of(rows * 2)), spark.createDataFrame(one * 9, schema)).table == {}
    known = R.labelled(counted, spark.createDataFrame([*one, (0, 0), (70, 1), (1, 2), (None, 1), (2, None)], schema))
    assert {(r["_id"], r["_good"]) for r in known.collect()} == {x for x in one if x[0] not in (0, 70)}


def test_empty_tables(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert R.fit_cutoffs(R.with_counts(docs_of([])), labels).table == {}
    assert R.with_counts(docs_of([])).where(~R.base_failed()).collect() == []
