import random
import re

import numpy as np
import pytest
from graph_helper import components_of

from factline.llm import minhash as M


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """(doc_id, set size, component) by all pairs."""
    sets = [shingles(r[1], k) for r in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    of = components_of(range(len(rows)), links)
    comp = [of[i] for i in range(len(rows))]
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted(((r[0], len(s), least.get(c)) for r, s, c in zip(rows, sets, comp, strict=True)), key=str)


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def edited(text, rng, share):
    w = text.split()
    return " ".join(x if rng.random() > share else f"e{rng.randrange(10**6)}" for x in w)


def test_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for size in (5, 40, 300, 3000):
        dense, filled = [], []
        for _ in range(60):
            x = rng.integers(0, 2**64, size, np.uint64)
            y = x.copy()
            y[: size // 5] = rng.integers(0, 2**64, size // 5, np.uint64)
            x, y = (M.minima(np.unique(s)) for s in (x, y))
            dense.append((M.densified(*x, 165) == M.densified(*y, 165)).mean())
            (vx, hx), (vy, hy) = ((np.frombuffer(s[: M.BINS], np.uint8), np.unpackbits(np.frombuffer(s[M.BINS :], np.uint8)).view(bool)) for s in (M.sketch(*x), M.sketch(*y)))
            agree, either = ((vx == vy) & hx & hy).sum(), (hx | hy).sum()
            filled.append(agree / either)
            assert agree >= M.least_agreement(np.array([either]), np.array([size * 6 // 5]), (size - size // 5) / (size + size // 5))[0]
        same = size - size // 5
        for seen in (dense, filled):
            assert abs(np.mean(seen) - same / (2 * size - same)) < 0.03


def test_bins_of_one_hash_are_that_hash():
    assert set(M.densified(*M.minima(np.array([7 << 40 | 9], np.uint64)), 100)) == {9}


def test_bands_miss_almost_nothing_at_the_limit():
    for percent in (50, 60, 80, 95):
        bands, bins = M.banding(percent / 100)
        assert bands <= M.BANDS and bands * bins <= M.BINS and (1 - (percent / 100) ** bins) ** bands <= M.MISS


@pytest.mark.parametrize("shingle,percent", [(2, 80), (5, 80), (1, 60)])
def test_equals_brute_force(spark, docs_of, shingle, percent):
    rng = random.Random(shingle)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 12, 60, 200]))) for _ in range(40)]
    rows = []
    for i in range(400):
        t = rng.choice(base)
        rows.append((1000 - i, edited(t, rng, rng.choice([0, 0, 0.01, 0.03, 0.05, 0.08, 0.2]))))
    rows += [(5, None), (5, ""), (4, " \t\n"), (None, base[0]), (None, "only one of its kind"), (3, base[0].upper()), (2, "one"), (1, "ONE"), (1, "one"), (0, "é É")]
    assert found(M.near_classes(docs_of(rows), shingle, percent)) == brute(rows, shingle, percent)


def test_links_that_the_star_does_not_have_are_found(spark, docs_of):
    """Copies of one text, each a little different and often less than the limit alike, in buckets that they share."""
    rng = random.Random(3)
    base = " ".join(f"w{i}" for i in range(150))
    rows = [(i, edited(base, rng, rng.choice([0.02, 0.05, 0.07, 0.09]))) for i in range(500)]
    assert found(M.near_classes(docs_of(rows), 2, 80)) == brute(rows, 2, 80)


def test_open_buckets_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "STAR", 8)
    rng = random.Random(5)
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(i, edited(base, rng, 0.08)) for i in range(150)] + [(i, base) for i in range(1000, 1300)]
    assert found(M.near_classes(docs_of(rows), 2, 80)) == brute(rows, 2, 80)


def test_long_texts_and_empty_tables(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(2, long), (1, long + " more"), (3, long[: len(long) // 2])]
    assert found(M.near_classes(docs_of(rows), 2, 80)) == [(1, 60_000, 1), (2, 59_999, 1), (3, len(shingles(long[: len(long) // 2], 2)), 3)]
    assert M.near_classes(docs_of([]), 2, 80).collect() == []
