"""Ids of a word-level BPE file (lower-casing, white space dropped) by cached white-space-separated chunks.

White space only separates pre-tokens in such a file, so a text's ids are its chunks' ids in order, and chunks repeat.
Texts with characters on which normalisation could cross chunks or differ between libraries are encoded whole by the
tokenizers library. A batch of texts is split and its distinct chunks found by Arrow, so a chunk is looked up once for
each batch and ids are gathered in arrays. A null text counts as empty and has no ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from vectorloom.llm import workers
from vectorloom.llm.bpe import byte_characters
from vectorloom.llm.piece_cache import PieceCache, TwoAges

# Fixed value: characters that are their own composed form, with one lower-case form and one class in all engines.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įĴ-ňŊ-ž]")


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.to_chars = dict(enumerate(byte_characters()))
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.pieces = PieceCache(self._encode_piece, 100_000, 60_000)
        self.chunks = TwoAges(self._encode_chunk, 150_000, 300_000)

    def _encode_piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.to_chars)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return pack(f"<{len(ids)}I", *ids)

    def _encode_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one piece of letters
            return self.pieces[chunk]
        return b"".join(map(self.pieces.__getitem__, self.piece.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, one after the other, as unsigned 32-bit numbers; where each text's ids end)."""
        parts, owner, whole = [], [], {}
        for at, text in enumerate(texts.to_pylist()):
            text = text or ""
            if PLAIN.search(text) or any(s in text for s in self.special):
                whole[at] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
                text = ""
            parts += _parts(text)
            owner += [at] * (len(parts) - len(owner))
        runs, sizes = [], np.zeros(len(texts), np.int64)
        for a, b in _groups(parts):
            ids, ends = self._encode_plain(pa.array(parts[a:b], pa.large_string()))
            runs.append(ids)
            np.add.at(sizes, owner[a:b], np.diff(ends, prepend=0))
        ids = np.concatenate(runs) if runs else np.zeros(0, "<u4")
        if whole:
            cuts = np.split(ids, np.cumsum(sizes)[:-1])
            for at, own in whole.items():
                cuts[at], sizes[at] = own, len(own)
            ids = np.concatenate(cuts)
        return ids, np.cumsum(sizes)

    def _encode_plain(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(parts))
        found = chunks.flatten().dictionary_encode()
        packed = self.chunks.many(found.dictionary.to_pylist())
        table, lengths = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        which = found.indices.to_numpy()
        size = lengths[which]
        ends = np.cumsum(size, dtype=np.int32)  # a group of parts has far fewer than 2 ** 31 ids
        first = (np.cumsum(lengths, dtype=np.int32) - lengths)[which]
        ids = table[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(first - (ends - size), size)]
        return ids, np.concatenate([[0], ends])[chunks.offsets.to_numpy()[1:]]


#: Texts are split so many characters at a time, so that a very long one takes no more memory than a batch.
PART_CHARS = 1 << 20


def _parts(text: str) -> list[str]:
    """The text cut at white space into parts of about PART_CHARS."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        cut = re.compile(r"[ \t\n\r]").search(text, at + PART_CHARS)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out


def _groups(parts: list[str]) -> list[tuple[int, int]]:
    """Runs of parts of about PART_CHARS together."""
    out, first, held = [], 0, 0
    for k, part in enumerate(parts):
        held += len(part)
        if held >= 4 * PART_CHARS:
            out.append((first, k + 1))
            first, held = k + 1, 0
    return [*out, (first, len(parts))] if first < len(parts) else out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


workers.MODELS["word_bpe"] = encoder.cache_clear
