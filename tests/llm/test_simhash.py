import random

import numpy as np
import xxhash

from tests.llm.helpers import Forest, ascii_lower, clashing, documents, words
from vectorloom.llm import simhash


def plain_fingerprint(text, k):
    w = words(ascii_lower(text))
    hs = [xxhash.xxh64_intdigest(" ".join(w[j : j + k]), 42) for j in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, k, radius):
    fps = {i: plain_fingerprint(t, k) for i, t in rows}
    forest, ids = Forest(fps), sorted(fps)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                forest.join(a, b)
    return {i: (f"{fps[i]:016x}", forest.find(i)) for i in ids}


def corpus(seed, n):
    rng, vocabulary = random.Random(seed), [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            ws = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 2)):
                if ws:
                    ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        else:
            ws = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 40, 120]))]
        rows.append((i, " ".join(ws)))
    return [*rows, (n, None), (n + 1, " \n"), (n + 2, "Ä B c")]


def test_against_plain_version(spark):
    rows = corpus(1, 300)
    docs = clashing(documents(spark, rows))
    for k, radius, tile in ((3, 3, 8192), (3, 3, 6), (2, 12, 50)):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, k, radius, tile=tile).collect()}
        assert got == plain_components(rows, k, radius), (k, radius, tile)


def test_masks_cover_the_radius():
    rng = random.Random(4)
    for rows in (10, 10_000, 1 << 20, 1 << 28, 1 << 36):
        masks = simhash.block_masks(3, rows)
        for _ in range(500):
            x, y = rng.getrandbits(64), 0
            y = x
            for b in rng.sample(range(64), 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_repeated_rows_and_empty_table(spark):
    out = simhash.near_duplicates(documents(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c"), (2, "z")])).collect()
    assert sorted(((r["doc_id"] or -1, r["component_id"]) for r in out)) == [(-1, 5), (2, 2), (5, 5), (5, 5)]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def plain_groups(rows, k, similarity):
    sets = {}
    for i, t in rows:
        w = words(ascii_lower(t))
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    forest, ids = Forest(sets), sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or common >= similarity * len(sets[a] | sets[b]) > 0:
                forest.join(a, b)
    return {i: forest.find(i) for i in ids}


def test_similar_groups(spark):
    rng = random.Random(7)
    base = [" ".join(f"v{rng.randrange(2000)}" for _ in range(200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 140):  # copies with a few words replaced, and a group of very many
        ws = base[0 if i % 2 else rng.randrange(40)].split()
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = f"n{rng.randrange(100)}"
        rows.append((i, " ".join(ws)))
    rows += [(200, None), (201, "  "), (202, "one"), (203, "ONE"), (204, "one two")]
    docs = clashing(documents(spark, rows))
    want = plain_groups(rows, 5, 0.8)
    for family_tile in (simhash.FAMILY_TILE, 8):
        got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(docs, family_tile=family_tile).collect()}
        assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_popcount_order_is_used():
    a = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64))
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    found = {(int(i), int(j)) for p, q in simhash.near_pairs(a, a, 18, True) for i, j in zip(p, q)}
    assert found == {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 18) + i + 1}


def test_tiles_are_skipped_among_the_registered_documents(spark, sf_dir):
    """Buckets hold many sub-tiles, and pairs of those whose population counts differ by more than the radius are skipped."""
    from collections import Counter

    for scale in ("0.01", "0.1"):
        docs = spark.read.parquet(sf_dir.replace("0.001", scale) + "/documents.parquet")
        fps = np.array([r["fp"] for r in simhash.fingerprints(docs, 3).select("fp").distinct().collect()], np.int64).view(np.uint64)
        tally, rows = Counter(), 0
        for mask in simhash.block_masks(3, len(fps)):
            keys = fps & np.uint64(mask)
            for key in np.unique(keys):
                own = fps[keys == key]
                own = own[simhash._popcount_order(own)]
                rows = max(rows, len(own))
                for _ in simhash.near_pairs(own, own, 3, True, tally):
                    pass
        assert rows > 2 * simhash.SUB_TILE
        assert tally["skipped"] > 0.2 * (tally["skipped"] + tally["compared"]) > 0, (scale, tally)


def test_a_very_long_text(spark):
    text = "x y z w v " * 60_000
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(documents(spark, [(1, text), (2, "a")])).collect()}
    assert got[1] == f"{plain_fingerprint(text, 3):016x}"
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(documents(spark, [(1, text), (2, text + "end"), (3, "a")])).collect()} == {1: 1, 2: 1, 3: 3}


def test_recall_on_the_registered_documents(spark, sf_dir):
    """All pairs by an inverted index over all shingles; documents of the pipeline's third stage are such."""
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(docs).collect()}
    from collections import Counter, defaultdict

    sets, holders, first, copies = {}, defaultdict(list), {}, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        own = frozenset(simhash._shingle_set(r["text"], 5))
        if own in first:  # one stands for all of one set
            copies[r["doc_id"]] = first[own]
            continue
        first[own] = r["doc_id"]
        sets[r["doc_id"]] = own
    forest = Forest(got)
    for i, own in sets.items():
        common = Counter(j for w in own for j in holders[w])
        for j, n in common.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                forest.join(i, j)
        for w in own:
            holders[w].append(i)
    for i, j in copies.items():
        forest.join(i, j)
    assert got == {i: forest.find(i) for i in got}
    assert len(set(got.values())) < len(got)


def test_small_sets_are_nominated_exactly(spark):
    """Pairs of similarity 0.8 and a little more, whose fingerprints are often outside the radius."""
    rng, rows = random.Random(11), []
    for n in [8] * 400 + [9, 12, 18, 19, 20, 23, 40, 60, 67] * 20:
        ws = [f"x{rng.getrandbits(40)}" for _ in range(n)]
        rows += [(2 * len(rows), " ".join(ws)), (2 * len(rows) + 1, " ".join([*ws, *(f"y{rng.getrandbits(40)}" for _ in range(max(1, (n - 4) // 4)))]))]
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(documents(spark, rows)).collect()}
    for (a, s), (b, t) in zip(rows[::2], rows[1::2], strict=True):
        want = plain_groups([(a, s), (b, t)], 5, 0.8)
        assert {a: got[a], b: got[b]} == want == {a: a, b: a}


def test_similar_sets_share_a_key():
    """In any order of the items, rarest first or by hash, prefixes of similar sets meet."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 65), 100, 257, 1000, 4001]:
        for m in range(n, int(n / 0.8 + 1e-9) + 1, max(1, n // 64)):
            least = -(-4 * (n + m) // 9)  # the overlap at which the similarity is 0.8
            for _ in range(40 if n < 65 else 5):
                order = rng.permutation(n + m - least)
                a, b = np.sort(order[:n]), np.sort(order[n - least :])
                p, q = (x[: simhash.prefix_size(len(x), 0.8)] for x in (a, b))
                assert set(p.tolist()) & set(q.tolist()), (n, m)


def test_common_passages_nominate_nobody(spark):
    """Documents that share a passage of a third of their words, but little else, are no family."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{rng.getrandbits(40)}" for _ in range(60)) + " " + passage + " " + " ".join(f"u{rng.getrandbits(40)}" for _ in range(60))) for i in range(200)]
    texts = spark.createDataFrame([(i, i, t) for i, t in rows], "id long, mark long, text string")
    assert simhash._nominated(texts, 5, 0.8, 1 << 20).where("size(keys) > 0").count() == 0
    rows += [(300 + i, rows[i][1] + " tail") for i in range(5)]
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(documents(spark, rows)).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i, _ in rows}
