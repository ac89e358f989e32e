import random

import numpy as np
import xxhash
from graph_helper import components_of

from factline.llm import simhash as S
from factline.llm.components import components


def slow_print(text, shingle):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in low.encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_majority_of_the_bits():
    for text in ("", None, " \n", "one", "A b", "a b c d", "Ä b C d E f", "x " * 20_000, "one two three four five six"):
        assert S.fingerprint(text, 4) % 2**64 == slow_print(text, 4)


def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    out = [None, "", " ", "one", "One", "one two", "a b c d e"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def check_components(spark, docs_of, texts, distance):
    got = {r["doc_id"]: r["component_id"] for r in S.near_components(docs_of(list(enumerate(texts))), 4, distance).collect()}
    fps = [S.fingerprint(t, 4) % 2**64 for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]
    assert got == components_of(range(len(texts)), links)


def test_components_equal_brute_force(spark, docs_of):
    for distance in (0, 1, 4, 9):
        check_components(spark, docs_of, near_texts(), distance)


def test_crowded_values_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "COLD", 2)
    monkeypatch.setattr(S, "CROWD", 0)
    monkeypatch.setattr(S, "BLOCK", 5)
    check_components(spark, docs_of, near_texts(), 4)


def test_radii_always_cover_the_distance():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**63, 200, dtype=np.uint64)
    bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    for m, distance in ((1, 0), (2, 4), (3, 4), (5, 4), (6, 12)):
        parts = S.Parts(S.grouped_bits(bits.T @ bits, len(fp), m), bits.mean(axis=0), len(fp))
        assert sorted(b for p in parts.bits for b in p) == list(range(64))
        radii = parts.radii(fp, distance)
        assert (radii >= -1).all() and (radii.sum(axis=0) == distance - m + 1).all()


def test_spanning_forest_keeps_components():
    rng = np.random.default_rng(1)
    for _ in range(50):
        near = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.15
        links = [(("r", i), ("c", j)) for i, j in S.spanning(near)]
        all_links = [(("r", i), ("c", j)) for i, j in zip(*np.nonzero(near), strict=True)]
        nodes = {n for e in all_links for n in e}
        assert components_of(nodes, links) == components_of(nodes, all_links) and len(links) <= sum(near.shape)


def test_rows_without_id_or_twice(docs_of):
    rows = S.near_components(docs_of([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "other words here now")]), 4, 4).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["component_id"] is not None) == [(False, 7), (False, 7), (True, 7)]
    assert S.near_components(docs_of([]), 4, 4).collect() == []


def test_groups_by_similarity(docs_of):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    half = base[:200] + [rng.choice(words) for _ in range(200)]
    other = [rng.choice(words) for _ in range(400)]
    df = docs_of([(5, " ".join(base)), (3, " ".join(near)), (4, " ".join(half)), (6, " ".join(other)), (8, " ".join(base)), (None, "x")])
    assert {r["doc_id"]: r["component_id"] for r in S.near_groups(df).collect()} == {5: 3, 3: 3, 8: 3, 4: 4, 6: 6}


def edited_pairs(rng, each):
    """Pairs of texts with their similarity, ``each`` in every band of 0.05 from 0.65 on."""
    jaccard = lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    bands = {k: [] for k in range(13, 20)}
    while any(len(found) < each for found in bands.values()):
        base = [f"w{rng.randrange(100_000)}" for _ in range(rng.randint(60, 300))]
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 20))):
            copy[at] = f"x{rng.randrange(100_000)}"
        alike = jaccard(grams(base), grams(copy))
        found = bands.get(int(alike * 20))
        if found is not None and len(found) < each:
            found.append((" ".join(base), " ".join(copy), alike))
    return [p for found in bands.values() for p in found]


def test_close_fingerprints_alone_link_nothing(docs_of):
    line = "one two three four five six seven"
    texts = [" ".join([f"{c}{i}" for i in range(60)] + [line] * 60) for c in "vw"]
    assert S.fingerprint(texts[0], 5) == S.fingerprint(texts[1], 5)
    assert {r["doc_id"]: r["component_id"] for r in S.near_groups(docs_of([(1, texts[0]), (2, texts[1]), (3, texts[1])])).collect()} == {1: 1, 2: 2, 3: 2}


def check_recall(docs_of, each):
    pairs = edited_pairs(random.Random(4), each)
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in S.near_groups(docs_of(rows)).collect()}
    wrong = [round(p[2], 3) for i, p in enumerate(pairs) if (got[2 * i] == got[2 * i + 1]) != (p[2] >= 0.8)]
    assert not wrong and len(got) == len(rows)


def test_recall_in_each_band_of_similarity(docs_of):
    check_recall(docs_of, 100)


def test_recall_in_large_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", 1)
    monkeypatch.setattr(S, "SETS", 1)
    check_recall(docs_of, 10)


def test_groups_of_chained_copies_equal_brute_force(docs_of):
    rng = random.Random(12)
    rows, w = [], [f"w{i}" for i in range(150)]
    for i in range(90):
        rows.append((i, " ".join(w)))
        w = list(w)
        for _ in range(rng.choice((1, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert {r["doc_id"]: r["component_id"] for r in S.near_groups(docs_of(rows)).collect()} == components_of(range(len(rows)), links)


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3), (200, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}}
