import hashlib
import random

import numpy as np
import pytest

from factline.llm import repeats as R


def brute(docs, length):
    """(n_bytes, n_removed, n_spans, sha256) by looking at every window of every text in order."""
    seen, out = set(), []
    for text in docs:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        spans = sum(1 for p in range(len(data)) if mark[p] and (p == 0 or not mark[p - 1]))
        out.append((len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **kw):
    rows = R.with_repeats_removed(df, **kw).select("doc_id", "_cut.*").collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}, rows


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = text(40), text(400)
    out = [None, "", "short", "a" * 700, text(60), passage, text(20) + passage + text(30), passage + passage, long]
    for _ in range(30):
        w = long.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out + [long, "ab" * 300, "xyz" * 100 + passage]


@pytest.mark.parametrize("most", [48, 3])
def test_equals_looking_at_every_window(docs_of, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_SEGMENTS", most)  # the smaller one deals buckets to blocks
    texts = corpus()
    got, _ = found(docs_of(list(enumerate(texts))))
    assert [got[i] for i in range(len(texts))] == brute(texts, 100)


def test_texts_longer_than_a_chunk(docs_of, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 512)
    texts = corpus()
    got, _ = found(docs_of(list(enumerate(texts))))
    assert [got[i] for i in range(len(texts))] == brute(texts, 100)


def test_repeated_rows_null_ids_and_kept_columns(docs_of):
    a, b = "one two three " * 10, "four five six " * 12
    df = docs_of([(1, a, "en", "s"), (1, a, "en", "s"), (1, b), (None, b), (None, "x"), (2, None)])
    rows = R.with_repeats_removed(df).select("doc_id", "text", "fp", "_cut.n_bytes", "_cut.n_removed", "_cut.kept").collect()
    assert len(rows) == 6 and {r["fp"] for r in rows} == {"x"}
    ones = [r for r in rows if r["doc_id"] == 1 and r["text"] == a]
    assert sorted(r["n_removed"] == r["n_bytes"] for r in ones) == [False, True]
    late = [r for r in rows if r["doc_id"] is None and r["text"] == b]
    assert late[0]["n_removed"] == late[0]["n_bytes"] and late[0]["kept"] == ""


def test_empty_table(docs_of):
    assert R.with_repeats_removed(docs_of([])).collect() == []


def test_characters_that_are_cut_in_part():
    kept, removed, spans = R.cut_text("aé".encode() * 3, [{"at": 2, "n": 1}], 3)
    assert (removed, spans, len(kept)) == (3, 1, 6)


def test_a_passage_in_many_texts_does_not_list_the_windows_beside_it(docs_of, monkeypatch):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage = text(40)
    texts = [f"{text(40)} {passage} {text(40)}" for _ in range(300)]
    listed, step = [], R._step

    def counted(df):
        out = step(df)
        if "h1" in out.columns:
            listed.append(out.where("h1 is not null").count())
        return out

    monkeypatch.setattr(R, "_step", counted)
    got, _ = found(docs_of(list(enumerate(texts))))
    assert [got[i] for i in range(len(texts))] == brute(texts, 100)
    assert sum(listed) < 30 * len(texts)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_parts_hold_every_window_once_and_equal_windows_meet(letters):
    rng, length, gram, width = random.Random(3), 20, 5, 4
    texts = ["".join(rng.choice(letters) for _ in range(60)).encode() for _ in range(40)]
    texts += [a[:30] + b[30:] for a, b in zip(texts, texts[1:], strict=False)] + [b"ab" * 30, b"a" * 60]
    size = np.array([len(t) for t in texts])
    data, first = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    _, at, run, bucket, _ = R.segments(data, first, size, length, gram)
    cut = [bytes(data[a : a + n + length - 1]) for a, n in zip(at, run, strict=True)]
    long = np.array([len(c) for c in cut])
    begin = np.cumsum(long) - long
    of, start, n, key, digest = R.parts(np.frombuffer(b"".join(cut), np.uint8), begin, long, bucket, length, gram, width)
    assert n.max() <= width
    places, meets, kinds = [], {}, {}
    for o, s, k, b, d in zip(of, start - begin[of], n, key, digest, strict=True):
        kinds.setdefault(d, set()).add(cut[o][s : s + k + length - 1])
        for w in range(s, s + k):
            places.append(at[o] + w)
            meets.setdefault(cut[o][w : w + length], set()).add(b)
    assert sorted(places) == sorted(p for a, k in zip(at, run, strict=True) for p in range(a, a + k))
    assert all(len(v) == 1 for v in meets.values()) and all(len(v) == 1 for v in kinds.values())
