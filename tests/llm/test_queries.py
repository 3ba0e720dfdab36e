"""The registered queries over whole tables, against plain versions of what they must return."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tests.llm.helpers import crc, words
from tests.llm.test_packing import check as check_packing
from tests.llm.test_packing import library_ids
from tests.llm.test_simhash import plain_components
from tests.llm.test_substring_dedup import plain as plain_substrings
from vectorloom.llm import queries, toxicity

tokenizers = pytest.importorskip("public_tokenizers")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def result(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir).collect()


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cursor.fetchall())


def test_op1(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(tokenizers.path("byte_bpe_50k.json")))
    got = {r["doc_id"]: tuple(r)[1:] for r in result(spark, sf_dir, "op1_bpe")}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op2(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op2_toxicity")}
    assert set(got) == {i for i, _ in rows}
    for i, r in got.items():
        assert r["held_out"] == (crc(i) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # The learned lexicon, its entries looked for one by one.
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    weights, exceptions = dict(lexicon.weights), [toxicity.fold(p) for p in lexicon.exceptions]
    assert weights and len(set(got[i]["score"] for i, _ in rows)) > 1
    b, w1, w2 = lexicon.logistic
    for i, t in rows:
        x = toxicity.fold(t)
        spared = [(at, at + len(p) - 1) for p in exceptions if p not in weights for at in range(len(x)) if x.startswith(p, at)]
        best = {}
        for e, w in weights.items():
            at = x.find(e)
            while at >= 0:
                if not any(low <= at < high for low, high in spared):
                    best[at] = max(best.get(at, w), w)
                at = x.find(e, at + 1)
        z = b + w1 * max(best.values(), default=0.0) + w2 * sum(best.values()) / math.sqrt(20 + len(x.split()))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z))), i


def test_op3(spark, sf_dir, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, sf_dir, "op3_simhash")}
    assert got == plain_components(rows, 3, 3)


def test_op4(spark, sf_dir):
    got = {r["page_id"]: r for r in result(spark, sf_dir, "op4_html")}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        r = got[p["page_id"]]
        assert r["url"] == p["url"] and r["n_chars"] == len(r["text"]) and "<" not in r["text"]
        assert all(line == " ".join(line.split()) and line for line in r["text"].split("\n")) or not r["text"]


def test_op5(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op5_brown_lm")}
    assert all(got[i]["n_tokens"] == len(words(t)) + 1 and got[i]["held_out"] == (crc(i) % 10 == 0) for i, t in rows)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op8(spark, sf_dir, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result(spark, sf_dir, "op8_substring_dedup")}
    assert got == {i: (n, k, sha(left)) for i, (n, k, left) in plain_substrings(rows, 20).items()}


def test_op9(spark, sf_dir, rows):
    out = result(spark, sf_dir, "op9_packing")
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in rows:
        ids = library_ids(t)
        want = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[k : k + 2048]))) for k in range(0, len(ids), 2048)]
        assert sorted(by[i]) == want
    assert check_packing(out, 2048) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_op10(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op10_audio")}
    features = defaultdict(set)
    for i, t in rows:
        raw = (t or "").encode()
        held = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(held), sha(held), zlib.crc32(held[-64:]))
        assert r["media_bytes"] == len(held) + 44 and len(r["media_sha256"]) == 64
        features[t].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in features.values())
