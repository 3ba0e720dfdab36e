"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that is adjacent in no vocabulary token can never be joined by a merge, so a cut between the two is
certain. Each pre-token is cut at such pairs, its fragments are encoded independently (and cached, as they repeat),
and their ids are concatenated. Decoding concatenates the tokens' bytes and replaces malformed UTF-8.

Defined results: a null text counts as empty; the empty text has no ids and decodes to the empty text. Strings of
special tokens inside a text become the special id, as in the tokenizers library. Repeated rows give repeated rows.
Columns of the input other than the id are not carried, so names can't clash. Every text is encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.piece_cache import PieceCache
from vectorloom.llm.shared import small_batches

# The pre-token pattern of byte-level BPE (public), and characters on which all regex engines agree.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏΑ-ΡΣ-ωА-я]")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def token_table(path: str) -> list[bytes]:
    """The bytes of every token of a byte-level tokenizer file, by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in enumerate(byte_characters())}
    found = {i: bytes(map(to_byte.__getitem__, token)) for token, i in spec["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [found.get(i, b"") for i in range(1 + max(found))]


def decode_ids(path: str, ids) -> str:
    return b"".join(map(token_table(path).__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


class BoundaryEncoder:
    """Encoder of one tokenizer file of the byte-level kind without normalizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.to_chars = dict(enumerate(byte_characters()))
        inside = np.zeros((256, 256), dtype=bool)
        for raw in token_table(path):
            codes = np.frombuffer(raw, np.uint8)
            inside[codes[:-1], codes[1:]] = True
        self.joinable_rows = [frozenset(np.flatnonzero(row).tolist()) for row in inside]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.fragments = PieceCache(self._encode_fragment, 40_000, 20_000)
        self.pieces = PieceCache(self._encode_piece, 160_000, 100_000)

    def cut(self, raw: bytes) -> list[bytes]:
        """The fragments between the forced boundaries of a byte string."""
        rows, cuts, last = self.joinable_rows, [], 0
        for i in range(1, len(raw)):
            if raw[i] not in rows[raw[i - 1]]:
                cuts.append(raw[last:i])
                last = i
        cuts.append(raw[last:])
        return cuts

    def _encode_fragment(self, raw: bytes) -> tuple[int, ...]:
        return tuple(t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.to_chars)))

    def _encode_piece(self, piece: str) -> tuple[bytes, str]:
        ids = [i for fragment in self.cut(piece.encode()) for i in self.fragments[fragment]]
        return np.array(ids, np.uint32).tobytes(), ",".join(map(str, ids))

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or not PLAIN.search(text):
            if not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
                return self.pre_token.findall(text)
        # Characters whose class may differ between regex engines: the library's own pre-tokenizer cuts the text.
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        """The ids, and the same as decimals joined by commas."""
        parts = [text or ""]
        if self.split_special and any(s in parts[0] for s in self.special):
            parts = self.split_special.split(parts[0])
        packed: list[tuple[bytes, str]] = []
        for part in parts:
            if part in self.special:
                packed.append((np.uint32(self.special[part]).tobytes(), str(self.special[part])))
            elif part:
                packed += map(self.pieces.__getitem__, self._pieces(part))
        return np.frombuffer(b"".join(p[0] for p in packed), np.uint32), ",".join([p[1] for p in packed])


def slices(batch: pa.RecordBatch, rows: int = 128):
    """Parts of a batch, so that what is made of its rows is held for a few of them at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@lru_cache(maxsize=2)
def encoder(path: str) -> BoundaryEncoder:
    return BoundaryEncoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """id_col, ids array<int>, ids_text and, for a round trip, decoded: every whole text encoded. Narrow: no shuffle.

    A round trip decodes the ids in the same worker, so that one process for each core holds the vocabulary."""

    def run(batches):
        codec = encoder(path)
        for batch in batches:
            for part in slices(batch):
                rows = [codec.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r[0]) for r in rows], out=offsets[1:])
                flat = np.concatenate([r[0] for r in rows]).astype(np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([r[1] for r in rows], pa.string())]
                if round_trip:
                    columns.append(pa.array([decode_ids(path, r[0]) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "ids_text", "decoded"][: len(columns)])

    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {kind}, ids array<int>, ids_text string" + ", decoded string" * round_trip)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, decoded: the text of every list of ids (null: the empty text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [decode_ids(path, x.values.to_numpy() if x.is_valid else []) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*part.schema.names[1:], "decoded"])

    held = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in held)
    return encoded.select(F.col(ids_col).alias("__ids"), *held).mapInArrow(run, f"{kinds}, decoded string")
