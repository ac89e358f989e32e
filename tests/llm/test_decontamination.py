import random

import pytest

from factline.llm import decontamination as D

ITEM = "If Anna buys 12 apples of 3 kg each from Bruno and gives Anna 5 more, how many apples does the old farmer have left?"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' as hash", "'x' as doc_id", "'x' as slots")


def found(spark, docs, items, **kw):
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in D.leaks(docs, bench(spark, items), **kw).collect()}


def test_placeholders():
    words, hashes, kind = D.canonical("The day Anna ran 5km, 7 kg and 3.5% of it. Then Bob", D.Tokens())
    named = {D.NUM: "n", D.NAME: "p", D.UNIT: "u", 0: "."}
    assert [named[k] for k in kind.tolist()] == list("..p.nunu.nu....p")[: len(kind)] or "".join(named[k] for k in kind.tolist()) == "..p.nunu.nu...p"
    assert len(words) == len(hashes)


def test_verbatim_shouted_and_reparameterised(spark, docs_of):
    other = ITEM.replace("Anna", "Zoe").replace("12", "40").replace("Bruno", "Carl").replace(" 3 ", " 8 ").replace(" 5 ", " 9 ")
    mixed = ITEM.replace("Anna", "Zoe", 1)  # one name of the item has two values here
    rows = [(1, "before it. " + ITEM + " after"), (2, ITEM.upper().replace(" ", "!! ")), (3, "so: " + other), (4, mixed), (5, "nothing of it " * 30), (6, None), (7, ""), (None, ITEM), (1, ITEM), (9, "w " * 100_000 + ITEM)]
    got = found(spark, docs_of(rows), [(1, ITEM), (2, None), (3, ""), (None, ITEM), (1, ITEM), (4, "tiny item")])
    assert got.pop((3, 1)) is True and got.pop((1, 1)) is False and got.pop((9, 1)) is False
    assert got.pop((None, 1)) is False
    assert (4, 1) not in got and (5, 1) not in got and not any(i is None for i, _ in got)


def test_rows_without_an_id_are_judged_by_their_texts(spark, docs_of):
    """Windows of two such rows are not put together; equal texts are one document."""
    half = ITEM.split()
    rows = [(None, "a " + ITEM), (None, "a " + ITEM), (None, "b " + ITEM), (None, " ".join(half[:11])), (None, " ".join(half[11:22])), (None, None), (0, ITEM)]
    out = [(r["doc_id"], r["item_id"]) for r in D.leaks(docs_of(rows), bench(spark, [(1, ITEM), (None, ITEM)])).collect()]
    assert sorted(out, key=str) == [(0, 1), (None, 1), (None, 1)]


def test_short_items_must_be_there_in_full(spark, docs_of):
    got = found(spark, docs_of([(1, "x y some short question here z"), (2, "some short question"), (3, "short question here")]), [(8, "Some short question here?")])
    assert set(got) == {(1, 8)}


def test_copies_whatever_the_types_of_their_words(spark, docs_of):
    items = [(1, "What is the capital city of France and its river?"), (2, "Calculate 12 * 7 + 3 - 8 / 2"), (3, "The Old Man And The Sea By Ernest Hemingway"), (4, ITEM), (5, "Was heißt Straße auf Englisch?")]
    rows = [(1, "so What is the capital city of France and its river? yes"), (2, "please: Calculate 12 * 7 + 3 - 8 / 2 now"), (3, "read The Old Man And The Sea By Ernest Hemingway today")]
    rows += [(4, ITEM.upper()), (5, "and " + ITEM.lower()), (6, "x " + ITEM), (7, "WAS HEISST STRASSE AUF ENGLISCH?")]
    rows += [(8, "Calculate 12 * 7 + 3 - 9 / 2"), (9, "what is the capital city of Spain"), (10, "the old man and the sea by ernest")]
    got = found(spark, docs_of(rows), items)
    assert got == {(k, v): False for k, v in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 4), (7, 5))}


def test_runs_are_judged_by_themselves(spark, docs_of):
    first, last = " ".join(f"p{i}" for i in "abcdefghijklmno"), " ".join(f"q{i}" for i in "abcdefghi")
    item = f"see Anna {first} then Anna {last}"
    doc = f"see Zoe {first} gap Carl {last}"
    assert found(spark, docs_of([(1, doc)]), [(1, item)]) == {(1, 1): True}


def test_equals_comparing_all(spark, docs_of):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(40)]
    rows = []
    for i in range(200):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            item = rng.choice(items)[1].split()
            at = rng.randrange(len(item))
            w[5:5] = item[at : at + rng.randint(3, 30)]
        rows.append((i, " ".join(w)))

    def leaked(doc, item):
        doc, item = doc.split(), item.split()
        size = min(8, len(item))
        own = [tuple(item[i : i + size]) for i in range(len(item) - size + 1)]
        there = {tuple(doc[i : i + size]) for i in range(len(doc) - size + 1)}
        return sum(w in there for w in own) >= min(len(own), 6)

    got = set(found(spark, docs_of(rows), items))
    assert got == {(d, i) for d, t in rows for i, q in items if leaked(t, q)} and len(got) > 10


@pytest.mark.parametrize("docs,items", [([], [(1, ITEM)]), ([(1, ITEM)], [])])
def test_empty_tables(spark, docs_of, docs, items):
    assert found(spark, docs_of(docs), items) == {}
