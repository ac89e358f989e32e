import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, id string, row string, block string, v string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in rows], SCHEMA)


def brute(rows, every=10):
    rows = list(dict.fromkeys((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)))
    out = []
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a[1], c[1], strict=True)), c[0] is None, c[0], c[2]) for c in rows if c is not a and len(c[1]) == len(a[1])]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for p in [s for s in scored if s[3] == a[2]][:5]:
            fit = [s for s in scored if s[3] != a[2] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(a[0], p[2], rank, s[2], -p[0], -s[0]) for rank, s in enumerate(fit[:5], 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=10, parts=3):
    df = N.hard_negatives(table(spark, rows).repartition(parts), F.col("vec_id") % every == 0)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("most,anchor", [(1, 1), (255, 3000), (10**6, 10**9), (2**20, 2**31)])
def test_packed_products_are_exact(most, anchor):
    rng = np.random.default_rng(most)
    width = N.field_width(anchor * 6, most)
    for n in (0, 1, 2, 7):
        rows = rng.integers(-most, most + 1, (n, 6))
        anchors = rng.integers(-anchor, anchor + 1, (4, 6))
        rows[: n // 2] = most
        anchors[0] = -anchor
        got = N.products(anchors, N.pack(rows, width, most), n, width, most)
        assert (got == anchors @ rows.T).all() and N.WORD // width >= 1


def test_several_candidates_share_an_integer():
    assert N.pack(np.zeros((9, 4), np.int64), 20, 0).shape == (4, 3)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(8)], rng.randrange(3)) for i in range(300)]
    rows += [(1000 + i, rows[5][1], rng.randrange(3)) for i in range(40)]  # ties
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 50
    monkeypatch.setattr(N, "ROW_CELLS", 64)
    monkeypatch.setattr(N, "ANCHOR_CELLS", 32)
    assert mined(spark, rows, parts=7) == want


def test_odd_rows(spark):
    v, w = [1.0, 0.5], [0.9, 0.5]
    rows = [
        (0, v, 1), (0, v, 1), (0, w, 1), (10, None, 1), (20, v, None), (30, [1.0, None], 1), (40, [1.0, float("nan")], 1), (50, [float("-inf"), 1.0], 1),
        (None, w, 2), (None, w, 2), (60, [1.0, 1.0, 1.0], 1), (70, [], 1), (71, [], 1), (72, [], 2), (1, v, 1), (2, [0.95, 0.5], 2), (3, [0.95, 0.5], 2), (4, [-1.0, 0.0], 1), (80, [-1.0, 0.0], 3),
    ]
    got = mined(spark, rows)
    assert got == brute(rows) and (70, 71, 1, 72, 0, 0) in got and any(r[3] is None for r in got)
    assert mined(spark, []) == [] and mined(spark, [(1, v, 1)]) == []


def test_one_label_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "ROW_CELLS", 128)
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0 if i % 50 else 1) for i in range(1200)]
    assert mined(spark, rows, every=100) == brute(rows, every=100)


def test_components_too_large_are_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(0, [1e12, 1.0], 1), (1, [1e12, 2.0], 1)])
