import random

import numpy as np
import pytest

from tests.llm.helpers import clashing, documents, words
from vectorloom.llm import substring_dedup as S


def plain(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        covered = [False] * len(w)
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            if key in seen:
                covered[a : a + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(covered), " ".join(x for x, c in zip(w, covered) if not c))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [200, 1 << 22])
def test_against_plain_version(spark, block_bytes):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for i in range(200)]
    rows += [(300 + i, t) for i, t in enumerate([None, "", " \n", "a a a a a a a a a", "ä b\tc  d e f g"] + ["x y z x y z x y z"] * 30)]
    assert result(S.remove_repeats(clashing(documents(spark, rows)), 5, block_bytes=block_bytes)) == plain(rows, 5)


def test_shared_passages_and_long_texts(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        ws = [word() for _ in range(100)]
        if i % 3 == 0:
            ws[50:50] = passage
        rows.append((i, " ".join(ws)))
    rows += [(50, " ".join(word() for _ in range(30_000))), (51, rows[1][1]), (52, rows[1][1])]
    got = result(S.remove_repeats(documents(spark, rows), 20, block_bytes=4000))
    assert got == plain(rows, 20)
    assert got[3][1] == 60 and got[0][1] == 0


def test_ids_null_and_repeated(spark):
    text = " ".join(f"w{i}" for i in range(30))
    out = S.remove_repeats(documents(spark, [(1, text), (1, text), (None, text), (2, "short")]), 20).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (1, 30), (1, 30), (2, 0)]
    assert S.remove_repeats(documents(spark, []), 20).count() == 0


def test_columns_are_carried(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f g"), (3, None)])
    out = {r["doc_id"]: (r["kept"], r["lang"], r["n_chars"]) for r in S.remove_repeats(docs, 5, carry=("lang", "n_chars")).collect()}
    assert out == {1: ("a b c d e f", "en", 11), 2: ("g", "en", 13), 3: ("", "en", None)}


def test_gaps_round_trip():
    rng = np.random.default_rng(0)
    for high in (10, 1 << 20, 1 << 62):
        x = np.unique(rng.integers(0, high, 300).astype(np.uint64))
        assert (S.unpack_gaps(S.pack_gaps(x)) == x).all()
    assert S.pack_gaps(np.zeros(0, np.uint64)) == b"" and len(S.unpack_gaps(b"")) == 0


def test_doubling_equals_steps():
    of = S.word_hashes([f"w{i}".encode() for i in range(60)], S.WordHashes())
    for width in (1, 2, 5, 20, 33):
        for c, got in enumerate(S.window_hashes(of, width)):
            for i in range(60 - width + 1):
                h = 0
                for x in of[i : i + width, c].tolist():
                    h = (h * S.FACTORS[c] + x) % (1 << 64)
                assert int(got[i]) == int(S._mix(np.array([h], np.uint64))[0])
