import random

import pytest

from tests.llm.helpers import clashing, documents
from vectorloom.llm import bpe, word_bpe

tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(tokenizers.path("byte_bpe_50k.json"))
ALPHABET = "ab 's'tdD \n\t\r\x0b\x1c\x85\xa0é́ßΣς中​12٣٤ !?_-''\U0001f600�\x00　İŉſÄÖI"


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        x = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16)))
        yield x + "<|endoftext|>" + x if rng.random() < 0.1 else x


def test_encoder_equals_library():
    codec = bpe.encoder(PATH)
    for x in [*texts(3000, 1), "", " ", "don't  stop\n\n now", "<|endoftext|>"]:
        want = codec.library.encode(x, add_special_tokens=False).ids
        ids, joined = codec.encode(x)
        assert ids.tolist() == want, repr(x)
        assert joined == ",".join(map(str, want))
        assert bpe.decode_ids(PATH, ids) == codec.library.decode(want, skip_special_tokens=False)


def test_decoding_of_broken_bytes():
    codec, rng = bpe.encoder(PATH), random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(5)]
        assert bpe.decode_ids(PATH, ids) == codec.library.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced():
    codec = bpe.encoder(PATH)
    raw = "Überraschung!äöü".encode()
    parts = codec.cut(raw)
    assert b"".join(parts) == raw
    for a, b in zip(parts, parts[1:]):
        assert not any(bytes([a[-1], b[0]]) in t for t in bpe.token_table(PATH))


def test_table(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 20_000), (1, "Hello world"), (None, "x")]
    out = bpe.encode(clashing(documents(spark, rows)), PATH, round_trip=True).collect()
    assert len(out) == len(rows)
    assert sorted(r["decoded"] for r in out) == sorted(t or "" for _, t in rows)
    assert {len(r["ids"]) for r in out if r["decoded"] == ""} == {0}
    assert bpe.encode(documents(spark, []), PATH).count() == 0
    back = bpe.decode(bpe.encode(documents(spark, rows), PATH), PATH).collect()
    assert sorted(r["decoded"] for r in back) == sorted(t or "" for _, t in rows)


def test_word_level_equals_library():
    codec = word_bpe.encoder(str(tokenizers.path("word_bpe_49k.json")))
    for x in [*texts(3000, 3), "Don't stop, NOW... 123"]:
        want = codec.library.encode(x, add_special_tokens=False).ids
        assert list(memoryview(codec.encode(x)).cast("I")) == want, repr(x)


def test_long_texts_are_split_in_parts(monkeypatch):
    import pyarrow as pa

    codec = word_bpe.encoder(str(tokenizers.path("word_bpe_49k.json")))
    texts = pa.array(["one two three. " * 40, None, "", "x" * 500, "mixed 中文 text " * 9, " lead and trail "])
    ids, ends = codec.encode_all(texts)
    monkeypatch.setattr(word_bpe, "PART_CHARS", 50)
    again, cuts = codec.encode_all(texts)
    assert (ids == again).all() and (ends == cuts).all()
