import random

import numpy as np
from pyspark.sql import functions as F

from factline.llm import langid, toxicity


def toxic_rows(n=600):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Vile!", "nasty", "FOUL,"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs_of):
    rows, labels = toxic_rows()
    df = docs_of([*rows, (None, "nasty"), (900, None), (901, ""), (902, "w1 " * 50_000 + "vile nasty foul"), (903, "!!! ..."), (0, rows[0][1])])
    table = spark.createDataFrame([*labels, (None, 1), (700, 1), (1, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.fit(df, table, F.col("doc_id") % 2 == 0)
    assert 0 < len(model.at) < 5000
    got = [(r["doc_id"], r["score"]) for r in toxicity.with_score(df, model).select("doc_id", "score").collect()]
    assert len(got) == len(rows) + 6 and all(0 <= s <= 1 for _, s in got)
    held = {i: s for i, s in got if i is not None and i < 600 and i % 2}
    right = sum((held[i] >= 0.5) == (i % 3 == 0) for i in held)
    assert right >= 0.94 * len(held)
    scores = dict(got)
    assert scores[900] == scores[901] == scores[903] < 0.5 < scores[902]


def test_toxicity_without_labels(spark, docs_of):
    table = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs_of([(1, "a")]), table, F.lit(True))
    assert [r["score"] for r in toxicity.with_score(docs_of([(1, "a")]), model).collect()] == [0.5]
    assert toxicity.with_score(docs_of([]), model).collect() == []


def test_ftrl_is_sparse_and_per_coordinate():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 5000, 20), 3 if i % 2 else 4)).astype(np.int32) for i in range(400)]
    model = toxicity.train(rows, np.array([i % 2 for i in range(400)], float))
    weights = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))
    assert weights[3] > 1 and weights[4] < -1 and len(weights) < 200


def language_rows(n=240):
    rng = random.Random(6)
    parts = {"en": ["the", "th", "ing", "ou", "wh"], "de": ["sch", "ung", "ein", "ß", "ch"], "fr": ["eau", "ou", "é", "oi", "tre"], "es": ["ción", "os", "ñ", "ar", "ll"], "xx": ["kq", "zz", "vw", "qa", "jk"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 5]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_on_held_out_rows(docs_of):
    rows = language_rows()
    df = docs_of([*rows, (None, "the thing", "en"), (500, None, "en"), (501, "12 34 !", "en"), (502, "", None), (503, "thing " * 100_000, None)])
    model = langid.fit(df, F.col("doc_id") % 2 == 0)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "=xx": ["xx"]}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.with_language(df, model).select("doc_id", "lang_pred", "score").collect()}
    assert len(got) == len(rows) + 5 and all(0 <= s <= 1 for _, s in got.values())
    assert sum(got[i][0] == lang for i, _, lang in rows if i % 2) >= 0.98 * len(rows) / 2
    assert got[500] == got[501] == got[502] == ("und", 0.0) and got[503][0] == "en"


def test_language_with_one_or_none_to_learn(docs_of):
    one = docs_of([(1, "abc", "en"), (2, "xyz", "en")])
    model = langid.fit(one, F.lit(True))
    assert {r["lang_pred"] for r in langid.with_language(one, model).collect()} == {"en"}
    model = langid.fit(docs_of([(1, "abc", None)]), F.lit(True))
    assert {r["lang_pred"] for r in langid.with_language(one, model).collect()} == {"und"}
    assert langid.with_language(docs_of([]), model).collect() == []


def test_every_language_is_learned(docs_of):
    """More languages than one task would hold, one of them rare, in families of their own; a language is more than its first letters."""
    rng = random.Random(8)
    words = {f"q{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for i in range(230)}
    rows = []
    for lang, own in words.items():
        for _ in range(3 if lang == "q007" else 6):
            rows.append((len(rows), " ".join(rng.choice(own) for _ in range(40)), lang))
    df = docs_of([*rows, (9000, "123", "zz"), (9001, None, "zz"), (9002, "", "zy")])
    model = langid.fit(df, F.lit(True), sample=4)
    assert sorted(sum(model.families.values(), [])) == sorted(words)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.with_language(df, model).select("doc_id", "lang_pred").collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows) and got[9000] == got[9001] == got[9002] == "und"


def test_rows_given_again_and_hot_languages(docs_of):
    """A language given mostly by copies of one row, and one with most of the rows, are learned like any other."""
    rows = language_rows()
    df = docs_of([*rows, *[rows[0]] * 500, *[(1000 + i, r[1], r[2]) for i, r in enumerate(rows * 4) if r[2] == "de"]])
    model = langid.fit(df, F.lit(True), sample=30)
    assert sorted(sum(model.families.values(), [])) == ["de", "en", "es", "fr", "xx"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.with_language(df, model).where("doc_id < 240").select("doc_id", "lang_pred").collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows)
