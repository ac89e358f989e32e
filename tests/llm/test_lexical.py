import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from factline.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, take=20):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in own:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // length))) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:take], 1)]
    return sorted(out, key=str)


@pytest.fixture
def items_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "item_id long, text string, rank string, score string, doc_id string")

    return make


def ranked(docs, items, take=20):
    df = L.rank_documents(docs, items, take)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 500)}"
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(100)]  # ties
    return rows, [(k, " ".join(word() for _ in range(rng.choice([1, 3, 20])))) for k in range(30)]


def test_terms():
    text = "Ünïcode-Wörd's A_b3 \x00c\x7f[D]{e}~10.5%É"
    assert [t.decode() for t in L.terms_of(text)] == terms(text)
    assert L.terms_of(None) == []


@pytest.mark.parametrize("leaf,shard", [(32, 16384), (2, 70), (1, 16384)])
def test_equals_brute_force(spark, docs_of, items_of, monkeypatch, leaf, shard):
    monkeypatch.setattr(L, "LEAF", leaf)
    monkeypatch.setattr(L, "SHARD", shard)
    docs, items = corpus(leaf)
    for n in (1, 5):
        assert ranked(docs_of(docs).repartition(n), items_of(items)) == brute(docs, items)


def test_groups_of_items_and_narrow_tables(spark, docs_of, items_of, monkeypatch):
    docs, items = corpus(8, 120)
    items = [(k * 7919, t) for k, t in items] + [(0, "w1 w2 w3 w4")]
    monkeypatch.setattr(L, "GROUP_TERMS", 40)
    monkeypatch.setattr(L, "CELLS", 500)
    assert ranked(docs_of(docs), items_of(items), 3) == brute(docs, items, 3)


def test_odd_rows(spark, docs_of, items_of):
    long = " ".join(f"t{i}" for i in range(50_000))
    docs = [(1, None), (2, ""), (3, " .,!"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (4, "Alpha"), (5, long + " alpha"), (6, "ALPHA alpha É é")]
    items = [(1, "alpha alpha beta"), (1, "alpha alpha beta"), (1, "é"), (2, None), (3, ""), (4, "nowhere"), (None, "beta"), (5, long)]
    assert ranked(docs_of(docs), items_of(items)) == brute(docs, items)
    assert ranked(docs_of([]), items_of(items)) == [] and ranked(docs_of(docs), items_of([])) == [] and ranked(docs_of([(1, None)]), items_of(items)) == []


def test_bounds_hold_and_subtrees_are_left_out():
    rng = np.random.default_rng(0)
    n, vocabulary = 2000, 60
    size = rng.integers(1, 12, n)
    vectors = [np.sort(rng.choice(vocabulary, k, replace=False)) for k in size]
    start = np.concatenate(([0], np.cumsum(size)))
    t = L.Tree(list(range(n)), np.concatenate(vectors).astype(np.int32), rng.integers(1, 9, start[-1]).astype(np.int32), start, rng.integers(80, 200, n), vocabulary)
    for node, (lo, hi) in enumerate(t.spans):
        for a, b in zip(t.start[lo:hi], t.start[lo + 1 : hi + 1], strict=True):
            assert (t.bounds[node, t.terms[a:b]] >= t.parts[a:b]).all()
    leaves = sorted(s for s, c in zip(t.spans, t.children, strict=True) if not c)
    assert leaves[0][0] == 0 and leaves[-1][1] == n and all(x[1] == y[0] for x, y in zip(leaves, leaves[1:], strict=False))
    reached = []
    dense = np.zeros(vocabulary, np.int64)
    t.parts = _Counting(t.parts, reached)
    best: list = []
    t.search(np.array([3, 50]), np.array([100, 900]), dense, best, 5)
    assert len(best) == 5 and not dense.any() and len(reached) < len(leaves)


class _Counting:
    def __init__(self, parts, reached):
        self.parts, self.reached = parts, reached

    def __getitem__(self, at):
        self.reached.append(at)
        return self.parts[at]
