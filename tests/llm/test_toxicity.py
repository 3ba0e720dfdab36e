import random

from tests.llm.helpers import clashing, documents
from vectorloom.llm import toxicity as T


def corpus(seed, n):
    rng, plain = random.Random(seed), [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    for i in range(n):
        ws, bad = [rng.choice(plain) for _ in range(rng.randint(5, 200))], rng.random() < 0.2
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "scum", "moron"]))
        elif rng.random() < 0.1:
            ws += ["pond", "scum"]
        yield i, " ".join(ws), int(bad)


def test_folding():
    assert T.fold("You 1D10T!") == " you idiot "
    assert T.fold("іdiоt") == " idiot "  # Cyrillic letters
    assert T.fold("st​up1d") == " stupid "
    assert T.fold("ＩＤＩＯＴ") == " idiot "
    assert T.fold("in 1998 at 10") == " in 1998 at 10 "
    assert T.fold(None) == T.fold("") == "  "


def test_exception_phrases():
    lexicon = T.Lexicon(((" scum ", 5.0), (" scu", 4.0)), ("pond scum",))
    assert T.matches(lexicon, T.fold("pond scum")) == {}
    assert [w for w, _ in T.matches(lexicon, T.fold("scum of pond scum")).values()] == [5.0]
    assert [w for w, _ in T.matches(lexicon, T.fold("scumbag")).values()] == [4.0]


def test_held_out_accuracy(spark):
    rows = list(corpus(5, 1500))
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i < 1000], "doc_id long, toxic int")
    lexicon = T.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in T.score(docs, lexicon).collect()}
    held = [(got[i] >= T.THRESHOLD, b) for i, _, b in rows if i >= 1000]
    assert sum(a == bool(b) for a, b in held) / len(held) > 0.97
    obfuscated = documents(spark, [(1, "worda 1d10t wordb"), (2, "worda wordb"), (3, "worda MОRОN")])
    flags = {r["doc_id"]: r["score"] >= T.THRESHOLD for r in T.score(obfuscated, lexicon).collect()}
    assert flags == {1: True, 2: False, 3: True}
    kept = T.accept(clashing(obfuscated), lexicon)
    assert [r["doc_id"] for r in kept.collect()] == [2] and "score" in kept.columns


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x " * 50_000), (3, "x " * 50_000), (None, "idiot")]
    docs = clashing(documents(spark, rows))
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    none = T.learn(docs, nothing)
    assert [r["score"] for r in T.score(docs, none).collect()] == [0.0] * 5
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, toxic int")
    out = T.score(docs, T.learn(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert T.score(documents(spark, []), none).count() == 0
