import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents
from vectorloom.llm import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b "), (6, "b"), (7, "x" * 100_000), (8, "x" * 100_000), (9, "x" * 100_001), (10, "a"), (11, "c")] + [(i, f"t{i % 7}") for i in range(20, 90)]


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def result(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in df.collect()}


@pytest.mark.parametrize("capacity", [1, 16_384])
def test_against_plain_version(spark, capacity):
    assert result(exact_dedup.dedup(clashing(documents(spark, ROWS)), capacity=capacity)) == plain(ROWS)


def test_chained_collisions(spark):
    weak = {"key": lambda t: F.length(t) % 2, "digest": lambda t: F.lit("d")}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(documents(spark, ROWS), **weak).collect()}
    assert got == {k: v[:3] for k, v in plain(ROWS).items()}


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "n"), (None, "n"), (2, "b")]
    out = exact_dedup.dedup(documents(spark, rows)).collect()
    assert sum(r["kept"] for r in out) == 3
    assert sorted(r["group_size"] for r in out) == [1, 2, 2, 3, 3, 3]
    kept = exact_dedup.keep_one(documents(spark, rows))
    assert sorted(r["text"] for r in kept.collect()) == ["a", "b", "n"]
    assert exact_dedup.dedup(documents(spark, [])).count() == 0
    assert exact_dedup.keep_one(documents(spark, [])).count() == 0


def test_keep_one_keeps_whole_rows(spark):
    docs = clashing(documents(spark, ROWS))
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(k for k, v in plain(ROWS).items() if v[2])


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.dedup(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_directory_doubling(spark):
    counts = {0: 5, 1: 5, 2: 1, 3: 1, 15: 40}  # distinct keys by their leading four bits
    keys = [((p << 60) + i) - (1 << 64 if p >> 3 else 0) for p, n in counts.items() for i in range(n)]
    depth, slots = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys for _ in range(3)], "h long"), 6)
    rows = slots.collect()
    bucket = {r["slot"]: r["bucket"] for r in rows}
    assert len(bucket) == len(rows) and max(bucket) < 1 << depth
    held = defaultdict(int)
    for k in keys:
        held[bucket[(k % (1 << 64)) >> (64 - depth)]] += 1
    full = bucket[(15 << 60) >> (64 - depth)]
    assert sum(held.values()) == len(keys) and held[full] == 40  # its keys have all counted bits in common
    assert all(n <= 6 for b, n in held.items() if b != full)
    depths = {r["bucket"]: r["depth"] for r in rows}
    for b, d in depths.items():  # a bucket owns one range of slots, and no shallower one would do
        own = sorted(s for s in bucket if bucket[s] == b)
        assert own == list(range(b, b + (1 << depth - d)))
        if d:
            parent = (b >> depth - d) >> 1
            assert sum((k % (1 << 64)) >> (64 - d + 1) == parent for k in keys) > 6
    assert exact_dedup.directory(spark.createDataFrame([], "h long"), 6)[0] == 0


@pytest.mark.parametrize("wrong", ["slot", "bucket"])
def test_results_come_through_the_directory(spark, monkeypatch, wrong):
    right = exact_dedup.directory

    def broken(keys, capacity):
        depth, slots = right(keys, capacity)
        if wrong == "slot":  # half of the directory is lost
            return depth, slots.where("slot % 2 = 0")
        return depth, slots.unionByName(slots.withColumn("bucket", F.col("bucket") + 1))  # two owners for each key

    monkeypatch.setattr(exact_dedup, "directory", broken)
    out = exact_dedup.dedup(documents(spark, ROWS), capacity=1).collect()
    assert len(out) != len(ROWS)
