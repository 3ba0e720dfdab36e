"""Substring dedup with a count-min prefilter, losing no repeated window.

Windows are runs of consecutive words of one document; a word goes if a window that covers it has the same word
sequence as a window that starts earlier (smaller id, or the same document further left).

Documents are dealt into blocks of bounded size by a hash. First pass: every block hashes its windows into count-min
rows and sends, for each slice of the sketch, the cells that it touches (sorted, as gaps) and which of them it touches
twice. Slice owners merge the blocks' sketches by addition and answer each block with one bit a cell: touched twice or
more in all. A window whose cells are all so is estimated repeated; an estimate is never too low, so no repeated window
is lost. Second pass: only those windows' 128-bit fingerprints are sent, once for each block, with the earliest id that
has them; owners of fingerprint ranges group them exactly and answer with those that start earlier elsewhere. A window
so costs one to two bytes in a shuffle, and no sketch is broadcast or held whole. Copies of a whole document are
settled first by a hash of their words: a later copy has each of its windows in the first one, so only the first takes
part; groups of copies of any size cost one row each.

Windows are compared by 128 bits of their words' hashes, not by the words. Ids are integers above -2^63, which stands for
null inside; a column of another type is an error.

Defined results: a null text counts as having no words; fewer words than a window: nothing is removed. Null ids come
before all others. Rows with the same id and the same words: one of them is the first. Rows with the same id and
different words are ordered by a hash of their words. An empty table gives no rows. Every text is processed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.bpe import slices
from vectorloom.llm.shared import block_count, materialize, small_batches
from vectorloom.llm.varints import pack_gaps, unpack_gaps
from vectorloom.llm.workers import lean, lean_cogroup, lean_group

BLOCK_BYTES = 4 << 20
DEPTH = 2  # one for each half of a window's fingerprint
#: Cells of each sketch row for each window, before rounding up to a power of two.
CELLS_PER_WINDOW = 4
SLICE_WINDOWS = 3_000_000
NONE_FIRST = -(1 << 63)

# Odd multipliers of the window hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """128 bits of every word, computed once for each distinct word of a block."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = value = xxhash.xxh3_128_digest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    """128 bits (two uint64) of every word."""
    return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8").reshape(-1, 2)


def window_hashes(of: np.ndarray, width: int) -> list[np.ndarray]:
    """Two 64-bit polynomial hashes, mixed, of every width consecutive words; by doubling, so in log(width) steps."""
    out = []
    with np.errstate(over="ignore"):
        for c, factor in enumerate(FACTORS):
            run, power, length = np.ascontiguousarray(of[:, c]), factor, 1  # of the windows of this length
            got, done, bit = None, 0, width
            while True:
                if bit & 1:
                    got = run if got is None else got[: len(run) - done] * np.uint64(power) + run[done:]
                    done += length
                bit >>= 1
                if not bit:
                    break
                run = run[:-length] * np.uint64(power) + run[length:]
                power, length = power * power & 0xFFFFFFFFFFFFFFFF, 2 * length
            out.append(_mix(got[: max(0, len(of) - width + 1)]))
    return out


def _bits_of(windows: int) -> int:
    return max(10, (windows * CELLS_PER_WINDOW - 1).bit_length()) if windows else 10


class Block:
    """The distinct windows of a block of documents, and where they are. copies: (id, text hash) of later copies."""

    def __init__(self, table: pa.Table, width: int, copies: set[tuple[int, int]]):
        ids, marks = table["key"].to_numpy(), table["mark"].to_numpy()
        self.order = np.lexsort((marks, ids))
        self.ids, self.marks = ids[self.order], marks[self.order]
        self.texts, self.copy, self.width = table["text"], [], width
        counts, hashes, before, known = [], [], None, WordHashes()
        for at, *who in zip(self.order.tolist(), self.ids.tolist(), self.marks.tolist(), strict=True):
            words = word_list(self.texts[at].as_py())
            copy = len(words) >= width and (tuple(who) in copies or who == before)
            self.copy.append(copy)
            counts.append(0 if copy or len(words) < width else len(words))
            if counts[-1]:
                hashes.append(word_hashes(words, known))
            before = who
        known.clear()
        counts = np.array(counts, np.int64)
        # Windows of all documents in one array; those that would cross a document's end are left out.
        total = int(counts.sum())
        inside = np.ones(total, bool)
        ends = np.cumsum(counts)
        for k in range(1, width):
            inside[ends[counts > 0] - k] = False
        self.counts = np.where(counts > 0, counts - width + 1, 0)
        h0, h1 = (x[inside[: len(x)]] for x in window_hashes(np.concatenate(hashes), width)) if total else (np.zeros(0, np.uint64),) * 2
        keys = np.argsort(h0)
        first, second = h0[keys], h1[keys]
        same = first[1:] == first[:-1]
        if (same & (second[1:] != second[:-1])).any():  # two windows with one half in common
            keys = np.lexsort((h1, h0))
            first, second = h0[keys], h1[keys]
            same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(keys) else np.zeros(0, np.int64)
        self.first, self.second = first[starts], second[starts]
        self.of = np.empty(len(keys), np.int64)  # the distinct window of each window
        self.of[keys] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        self.times = np.diff(np.append(starts, len(keys)))
        # Documents come in order, so the least position is the earliest start.
        self.first_at = np.minimum.reduceat(keys, starts) if len(keys) else keys

    def firsts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and marks of the documents in which the distinct windows start first."""
        owner = np.searchsorted(np.cumsum(self.counts), self.first_at[which], side="right")
        return self.ids[owner], self.marks[owner]

    def cells(self, row: int, bits: int):
        """Distinct cells of a sketch row, whether twice or more, and the cell number of each distinct window.

        A row's cell is the leading bits of one of the two hashes; the windows are sorted by the first."""
        cells = (self.second if row else self.first) >> np.uint64(64 - bits)
        order = np.argsort(cells) if row else np.arange(len(cells))
        ranked = cells[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        twice = np.add.reduceat(np.minimum(self.times, 2)[order], starts) >= 2 if len(starts) else np.zeros(0, bool)
        inverse = np.empty(len(cells), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return ranked[starts], twice, inverse


def _cut(sorted_: np.ndarray, bits: int, parts: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of sorted bits-wide numbers, by their leading bits; parts is a power of two."""
    if parts == 1:
        return [(0, 0, len(sorted_))] if len(sorted_) else []
    of = (sorted_ >> np.uint64(bits - (parts.bit_length() - 1))).astype(np.int64)
    bounds = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
    return [(int(of[a]), a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ASK = pa.schema([("row", pa.int32()), ("slice", pa.int64()), ("block", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])
TELL = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("slice", pa.int64()), ("data", pa.binary())])
FOUND = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary())])
OUT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
#: Rows of TELL that hold (id, mark) of later copies, and those that hold fingerprints of windows that start earlier elsewhere.
COPIES, EARLIER = -1, -2


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _told(tell: pa.Table) -> dict[int, list[bytes]]:
    """The data told to a block, by row, in the order of the slices."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for row, part, data in zip(tell["row"].to_pylist(), tell["slice"].to_pylist(), tell["data"].to_pylist(), strict=True):
        out.setdefault(row, []).append((part, data))
    return {k: [d for _, d in sorted(v)] for k, v in out.items()}


def _copies(told: dict[int, list[bytes]]) -> set[tuple[int, int]]:
    return {tuple(x) for d in told.get(COPIES, []) for x in np.frombuffer(d, "<i8").reshape(-1, 2).tolist()}


def _merge(table: pa.Table) -> pa.Table:
    """One slice of the sketch: the blocks' counters added up; a bit for every cell that a block touches."""
    lists = [unpack_gaps(d) for d in table["cells"].to_pylist()]
    weights = [np.unpackbits(np.frombuffer(d, np.uint8), count=len(x)) + np.uint8(1) for d, x in zip(table["twice"].to_pylist(), lists, strict=True)]
    cells, weight = np.concatenate(lists), np.concatenate(weights)
    order = np.argsort(cells, kind="stable")
    new = np.diff(cells[order], prepend=cells[order[0]] + np.uint64(1)) != 0
    starts = np.flatnonzero(new)
    often = np.add.reduceat(weight[order].astype(np.int64), starts) >= 2
    repeated = np.empty(len(cells), bool)
    repeated[order] = often[np.cumsum(new) - 1]
    ends = np.cumsum([len(x) for x in lists])
    rows = [(b, r, s, np.packbits(repeated[e - len(x) : e]).tobytes()) for b, r, s, x, e in zip(table["block"].to_pylist(), table["row"].to_pylist(), table["slice"].to_pylist(), lists, ends, strict=True)]
    return _table(TELL, rows)


def _exact(table: pa.Table) -> pa.Table:
    """One range of fingerprints: tells each block which of those it sent start earlier in another block."""
    got = [np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("hashes", "<u8"), ("ids", "<i8"), ("marks", "<i8"))]
    hashes = got[0].reshape(-1, 2)
    sizes = [len(d) // 16 for d in table["hashes"].to_pylist()]
    sender = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((got[2], got[1], hashes[:, 1], hashes[:, 0]))
    ranked = hashes[order]
    later = np.zeros(len(order), bool)
    later[1:] = (ranked[1:, 0] == ranked[:-1, 0]) & (ranked[1:, 1] == ranked[:-1, 1])
    late = np.sort(order[later])
    cuts = np.searchsorted(sender[late], np.arange(len(sizes) + 1))
    blocks, parts = table["block"].to_pylist(), table["slice"].to_pylist()
    return _table(TELL, [(blocks[k], EARLIER, parts[k], hashes[late[cuts[k] : cuts[k + 1]]].tobytes()) for k in range(len(sizes)) if cuts[k + 1] > cuts[k]])


def touched(block: Block, number: int, bits: int, parts: int) -> pa.Table:
    """ASK: the cells of the sketch that a block touches."""
    out = []
    for row in range(DEPTH):
        cells, twice, _ = block.cells(row, bits)
        for part, a, b in _cut(cells, bits, parts):
            base = np.uint64(part) << np.uint64(bits - (parts.bit_length() - 1))
            out.append((row, part, number, pack_gaps(cells[a:b] - base), np.packbits(twice[a:b]).tobytes()))
    return _table(ASK, out)


def estimated(block: Block, told: dict[int, list[bytes]], bits: int, parts: int) -> np.ndarray:
    """Which of a block's distinct windows are estimated repeated, by what the owners told it."""
    often = np.ones(len(block.first), bool)
    for row in range(DEPTH):
        cells, _, inverse = block.cells(row, bits)
        cuts = _cut(cells, bits, parts)
        heavy = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=b - a) for d, (_, a, b) in zip(told[row], cuts, strict=True)])
        often &= heavy[inverse].astype(bool)
    return often


def sketch_size(windows: int) -> tuple[int, int]:
    """(bits of a cell's number, slices) for so many windows."""
    return _bits_of(windows), 1 << max(0, (windows // SLICE_WINDOWS).bit_length())


def with_repeated(rows: DataFrame, width: int, windows: int, use, out_ddl: str) -> DataFrame:
    """use(table, block, often) of every block of rows (key, mark, text, block and others): its windows, and which of the
    distinct ones are estimated repeated anywhere. windows: about how many there are."""
    bits, parts = sketch_size(windows)

    def ask(table: pa.Table) -> pa.Table:
        return touched(Block(table, width, set()), table["block"][0].as_py(), bits, parts)

    def answer(table: pa.Table, tell: pa.Table) -> pa.Table:
        block = Block(table, width, set())
        return use(table, block, estimated(block, _told(tell), bits, parts) if len(block.first) else np.zeros(0, bool))

    dealt = rows.groupBy("block")
    told = dealt.applyInArrow(lean_group(ask), ddl(ASK)).groupBy("row", "slice").applyInArrow(lean_group(_merge), ddl(TELL))
    return dealt.cogroup(told.groupBy("block")).applyInArrow(lean_cogroup(answer), out_ddl)


def _digests(rows: DataFrame) -> DataFrame:
    """key, mark, block, n_words and a 128-bit hash of the word sequence."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = [word_list(t) for t in part.column(3).to_pylist()]
                digest = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(w) for w in words], pa.int64()), pa.array(digest, pa.binary())], names=["key", "mark", "block", "n_words", "digest"])

    return rows.select("key", "mark", "block", "text").mapInArrow(lean(run), "key long, mark long, block long, n_words long, digest binary")


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space) and the columns to carry, for every row of docs."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError("documents start in the order of their ids: an integer column")
    small_batches(docs)
    blocks = block_count(docs, text_col, block_bytes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE_FIRST)).alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"), *carried)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "mark"), F.lit(blocks)))

    known = materialize(_digests(rows), "substring-digests").where(F.col("n_words") >= width)
    firsts = known.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("key", "mark")).alias("first"), F.min("n_words").alias("n_words"))
    firsts = materialize(firsts, "substring-firsts")
    windows = firsts.agg(F.sum(F.col("n_words") - width + 1)).first()[0] or 0
    copied = firsts.where("rows > 1").select("digest", "first")
    later = known.join(copied, "digest").where(F.struct("key", "mark") != F.col("first")).select("block", "key", "mark")
    bits, parts = sketch_size(windows)

    def tell_copies(batches):
        for batch in batches:
            who = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            yield from _table(TELL, [(b, COPIES, 0, x.tobytes()) for b, x in zip(batch.column(0).to_pylist(), who, strict=True)]).to_batches()

    copies = later.mapInArrow(lean(tell_copies), ddl(TELL))

    def ask(table: pa.Table, tell: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(ASK, [])
        return touched(Block(table, width, _copies(_told(tell))), table["block"][0].as_py(), bits, parts)

    def estimate(table: pa.Table, tell: pa.Table) -> pa.Table:
        told = _told(tell)
        if not table.num_rows or not any(r >= 0 for r in told):
            return _table(FOUND, [])
        block = Block(table, width, _copies(told))
        often = estimated(block, told, bits, parts)
        hashes = np.stack([block.first[often], block.second[often]], axis=1)
        ids, marks = block.firsts(often)
        out = [(p, table["block"][0].as_py(), hashes[a:b].tobytes(), ids[a:b].tobytes(), marks[a:b].tobytes()) for p, a, b in _cut(block.first[often], 64, parts)]
        return _table(FOUND, out)

    def finish(table: pa.Table, tell: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in out_schema(table)], schema=out_schema(table))
        told = _told(tell)
        block = Block(table, width, _copies(told))
        goes = np.ones(int(block.counts.sum()), bool)
        goes[block.first_at] = False
        if EARLIER in told:
            elsewhere = np.frombuffer(b"".join(told[EARLIER]), "<u8").reshape(-1, 2)
            at = np.searchsorted(block.first, elsewhere[:, 0])
            while (miss := block.second[at] != elsewhere[:, 1]).any():  # each of them is one of the block's windows
                at[miss] += 1
            goes[block.first_at[at]] = True
        out, at = [], 0
        for k, n in enumerate(block.counts.tolist()):
            words, gone = word_list(block.texts[int(block.order[k])].as_py()), 0
            if block.copy[k]:
                gone, words_left = len(words), []
            elif (own := goes[at : at + n]).any():
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.flatnonzero(own)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone, words_left = int(covered.sum()), [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            else:
                words_left = words
            at += n
            out.append((int(block.ids[k]), len(words), gone, b" ".join(words_left).decode("utf-8", "surrogatepass")))
        done = _table(OUT, out)
        for k in range(len(carry)):
            done = done.append_column(f"carry{k}", table[f"carry{k}"].take(pa.array(block.order)))
        return done

    def out_schema(table: pa.Table) -> pa.Schema:
        return pa.schema([*OUT, *[table.schema.field(f"carry{k}") for k in range(len(carry))]])

    out_ddl = ", ".join([ddl(OUT), *[f"carry{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)]])
    dealt = rows.groupBy("block")
    asked = dealt.cogroup(copies.groupBy("block")).applyInArrow(lean_cogroup(ask), ddl(ASK))
    often = asked.groupBy("row", "slice").applyInArrow(lean_group(_merge), ddl(TELL))
    found = dealt.cogroup(often.unionByName(copies).groupBy("block")).applyInArrow(lean_cogroup(estimate), ddl(FOUND))
    earlier = found.groupBy("slice").applyInArrow(lean_group(_exact), ddl(TELL))
    done = dealt.cogroup(earlier.unionByName(copies).groupBy("block")).applyInArrow(lean_cogroup(finish), out_ddl)
    key = F.when(F.col("key") != NONE_FIRST, F.col("key")).alias(id_col)
    return done.select(key, "n_words", "n_removed", "kept", *[F.col(f"carry{k}").alias(c) for k, c in enumerate(carry)])
