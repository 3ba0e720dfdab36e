import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ascii_lower, clashing, crc, documents, words
from vectorloom.llm import brown_lm as B
from vectorloom.llm.shared import crc_mod


def train():
    return crc_mod(F.col("doc_id"), 10) != 0


def corpus(seed, n):
    """Two kinds of sentences with words of their own: what came before tells what comes next."""
    rng = random.Random(seed)
    kinds = [([f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]), ([f"c{i}" for i in range(30)], [f"d{i}" for i in range(30)])]
    rows = []
    for i in range(n):
        first, second = rng.choice(kinds)
        rows.append((i, " ".join(w for _ in range(rng.randint(1, 40)) for w in (rng.choice(first), rng.choice(second)))))
    return rows


@pytest.mark.parametrize("rate", [1e-7, 0.002, 1.0])
def test_counts_and_base_score(spark, rate):
    rows = [*corpus(1, 120), (200, None), (201, ""), (202, "NEW word ÄÖ"), (203, "a1 " * 30_000)]
    out = {r["doc_id"]: r for r in B.scores(clashing(documents(spark, rows)), train(), rate=rate).collect()}
    tokens = {i: [*words(ascii_lower(t)), None] for i, t in rows}
    c = Counter(x for i, ts in tokens.items() if crc(i) % 10 for x in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 10 == 0, len(ts), sum(c[x] > 0 for x in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts))
        assert r["score"] < 0 and r["perplexity"] > 1


def test_held_out_perplexity_is_better_than_base(spark):
    out = [r for r in B.scores(documents(spark, corpus(2, 600)), train(), classes=8).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.9


def learned(spark, rows, classes=4, **how):
    held = documents(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train().alias("train"))
    return B.learn(held, B._word_counts(held.where("train").select("text")).cache(), classes, **how)


def names_of(model):
    return model.vocabulary.words.to_pylist()


@pytest.mark.parametrize("rate", [1e-7, 0.005])
def test_probabilities_sum_to_one(spark, rate):
    model = learned(spark, corpus(3, 80), rate=rate)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    p = 10 ** model.emission()
    for k in set(model.label.tolist()):
        assert p[model.label == k].sum() == pytest.approx(1)
    # RARE: what was seen has its share by counts, what was not the rest.
    assert 0 < model.unseen <= 1 and (model.rare > 0 or model.unseen == 1)


@pytest.mark.parametrize("rate", [1e-7, 0.004])
def test_scores_equal_a_plain_scorer(spark, rate):
    rows = [*corpus(4, 150), (300, "unseen0 a1"), (301, ""), (302, None), (303, "b1 once0 unseen0 unseen1"), (304, "once1")]
    model = learned(spark, rows, rate=rate)
    monkey = {"classes": 4, "rate": rate}
    out = {r["doc_id"]: r["score"] for r in B.scores(documents(spark, rows), train(), **monkey).collect()}
    c = Counter(w for i, t in rows if crc(i) % 10 for w in words(ascii_lower(t)))
    names = names_of(model)
    assert names == [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= rate * model.tokens]
    label = dict(zip(names, model.label.tolist(), strict=True))
    end, rare, once = 4, 5, sum(n == 1 for n in c.values())
    # Transitions and emissions counted plainly for the model's classes.
    pairs = np.zeros((6, 6))
    for i, t in rows:
        if crc(i) % 10:
            ws = words(ascii_lower(t))
            line = [end, *[label.get(w, rare) for w in ws], end]
            for a, b in zip(line, line[1:], strict=False):
                pairs[a, b] += 1
            for j, w in enumerate(ws):
                if c[w] == 1 and w in label:
                    pairs[line[j], rare] += 1
                    pairs[rare, line[j + 2]] += 1
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + 6)
    transition = (pairs + 10 * share) / (pairs.sum(axis=1, keepdims=True) + 10)
    size, types = Counter(), Counter()
    for w, k in label.items():
        size[k] += c[w]
        types[k] += 1
    rare_tokens = sum(n for w, n in c.items() if w not in label)
    unseen = (once + 1) / (rare_tokens + once + 1)
    for i, t in rows:
        ws = words(ascii_lower(t))
        line = [end, *[label.get(w, rare) for w in ws], end]
        want = sum(math.log10(transition[a, b]) for a, b in zip(line, line[1:], strict=False))
        for w in ws:
            if w in label:
                want += math.log10((c[w] + 0.1) / (size[label[w]] + 0.1 * types[label[w]]))
            else:
                want += math.log10((1 - unseen) * c[w] / rare_tokens if c[w] else unseen / (once + 1))
        assert out[i] == pytest.approx(want), i


def test_nearly_all_tokens_are_clustered(spark, sf_dir):
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train().alias("train"))
    model = B.learn(held, B._word_counts(held.where("train").select("text")).cache(), 8)
    assert model.vocabulary.counts.sum() >= 0.95 * (model.tokens - model.ends)
    assert set(model.label.tolist()) <= set(range(8)) and len(set(model.label.tolist())) > 2


def test_sweeps_raise_the_likelihood(spark):
    def likelihood_of(label):
        rows, index = corpus(6, 200), {w: k for k, w in enumerate(names)}
        table = np.zeros((6, 6))
        for i, t in rows:
            if crc(i) % 10:
                line = [4, *[label[index[w]] for w in words(ascii_lower(t))], 4]
                for a, b in zip(line, line[1:], strict=False):
                    table[a, b] += 1
        f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))

    few, more = (learned(spark, corpus(6, 200), seeds=12, sweeps=n) for n in (1, 3))
    names = names_of(few)
    assert names == names_of(more) and likelihood_of(more.label.tolist()) >= likelihood_of(few.label.tolist())
    dealt = [k % 4 for k in range(len(names))]
    assert likelihood_of(few.label.tolist()) > likelihood_of(dealt) + 1000


def test_best_classes_against_the_likelihood():
    rng = np.random.default_rng(1)
    classes, n = 3, 40
    label = rng.integers(0, classes, n)
    bigrams = rng.integers(0, 4, (n + 1, n + 1))
    np.fill_diagonal(bigrams, 0)
    codes = np.append(label, classes)
    one = np.zeros((n + 1, classes + 2))
    one[np.arange(n + 1), codes] = 1
    table = one.T @ bigrams @ one
    got = B.best_classes((bigrams @ one)[:n], (bigrams.T @ one)[:n], label, table, classes)
    gains = 0
    for u in range(n):
        tried = []
        for k in range(classes):
            other = codes.copy()
            other[u] = k
            tried.append(likelihood(bigrams, other))
        gains += tried[got[u]] >= tried[label[u]]
    assert gains >= n - 2  # what a word takes from its own class's columns is left out


def likelihood(bigrams, label):
    k = max(label) + 1
    one = np.zeros((len(label), k))
    one[np.arange(len(label)), label] = 1
    t = one.T @ bigrams @ one
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))


def test_exchange_finds_a_local_optimum():
    rng = np.random.default_rng(0)
    bigrams = rng.integers(0, 6, (13, 13))
    label = np.append(B.exchange(bigrams, 3, 50), 3)
    best = likelihood(bigrams, label)
    start = np.append(np.argsort(np.argsort(-bigrams[:12].sum(axis=1), kind="stable")) % 3, 3)
    assert best >= likelihood(bigrams, start)
    for u in range(12):
        for k in range(3):
            other = label.copy()
            other[u] = k
            assert likelihood(bigrams, other) <= best + 1e-6


def test_edges(spark):
    assert B.scores(documents(spark, []), train()).count() == 0
    out = B.scores(documents(spark, [(1, "a b"), (1, "a b"), (None, None)]), F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(0, 0, pytest.approx(0))] * 3
