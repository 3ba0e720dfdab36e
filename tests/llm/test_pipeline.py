import hashlib
from collections import Counter

import pytest

from tests.llm.helpers import documents, words
from tests.llm.test_simhash import plain_groups
from tests.llm.test_substring_dedup import plain as plain_substrings

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    stages = dict(pipeline.STAGES)
    assert 4 <= len(stages) <= 5
    kept = stages["toxicity"](spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()

    unique = stages["exact dedup"](spark, kept, sf_dir).cache()
    last = {}
    for r in kept.collect():
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    assert {r["doc_id"] for r in unique.collect()} == set(last.values())

    one = stages["simhash near-dedup"](spark, unique, sf_dir).cache()
    groups = plain_groups([(r["doc_id"], r["text"]) for r in unique.collect()], 5, 0.8)
    assert {r["doc_id"] for r in one.collect()} == set(groups.values())

    cut = stages["substring dedup"](spark, one, sf_dir).cache()
    want = plain_substrings([(r["doc_id"], r["text"]) for r in one.collect()], pipeline.WINDOW)
    got = {r["doc_id"]: r for r in cut.collect()}
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    assert cut.columns == docs.columns
    for i, (_, removed, left) in want.items():
        assert got[i]["text"] == (left if removed else texts[i]) and got[i]["n_chars"] == len(got[i]["text"])

    packed = stages["best-fit packing"](spark, cut, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(got)
    assert pipeline.run(spark, sf_dir).count() == len(packed)


def test_empty_tables(spark, sf_dir):
    docs = documents(spark, [])
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_nulls_repeats_and_clashing_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text + " more"), (4, "word " * 20_000), (5, text + " " + "tail " * 3)]
    docs = documents(spark, rows).withColumn("row", F.lit("x")).withColumn("mark", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
    out = docs.collect()
    assert Counter(r["row"] for r in out) == {"x": len(out)}
    assert sum(len(words(r["text"])) for r in out) > 50
    assert len({hashlib.sha256((r["text"] or "").encode()).digest() for r in out}) == len(out)


def test_a_stage_drops_the_encoder_that_packing_left_in_a_worker(spark, monkeypatch):
    import public_tokenizers

    from vectorloom.llm import packing, simhash, substring_dedup, toxicity, word_bpe

    taken = []
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    given = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: (taken.append(f), given(self, f, *a, **b))[1])
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    stages = [lambda: toxicity.accept(docs, toxicity.Lexicon()), lambda: simhash.fingerprints(docs, 5), lambda: substring_dedup.remove_repeats(docs)]
    for stage in stages:
        taken.clear()
        stage()
        for f in list(taken):
            word_bpe.encoder(path)
            assert list(f(iter([]))) == []
            assert word_bpe.encoder.cache_info().currsize == 0
    taken.clear()
    packing.pieces(docs, path, 8)
    word_bpe.encoder(path)
    list(taken[0](iter([])))
    assert word_bpe.encoder.cache_info().currsize == 1  # its own tasks keep it
