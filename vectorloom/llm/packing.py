"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are cut only if they are longer than a sequence. Pieces that fill a sequence are one; the others are dealt
into shards of bounded size by a hash of a unique row number. In each shard several islands evolve packings, each from
orders of its own: a packing is a grouping of pieces into bins; crossover injects well-filled bins of one parent whole
into the other, removes the bins of the other that hold a piece twice, and best-fits the displaced pieces, largest
first. After each epoch every island receives the elite of its neighbour (a ring). The best island's packing is the
shard's. An island stops at the least number of bins that any packing could have (the sum of sizes over the capacity).
A shard loses less than one bin against packing everything together, and its size does not grow with the input.

Defined results: a null text counts as empty: a document of one end id. Every row is packed, repeated rows each for
themselves. Null ids are carried. An empty table gives no rows. Other columns of the input are not read; `pack` keeps
all columns that it is given.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import word_bpe
from vectorloom.llm.shared import materialize, shuffle_parts, small_batches
from vectorloom.llm.workers import lean

SHARD_PIECES = 16_384
ISLANDS = 2
EPOCHS = 4
GENERATIONS = 12
POPULATION = 4
#: Shards and islands are dealt to tasks of about so many.
TASK_ISLANDS = 32


def pieces(docs: DataFrame, path: str, length: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids (binary): the pieces of every document. Narrow: no shuffle."""

    def run(batches):
        codec = word_bpe.encoder(path)
        for batch in batches:
            ids, ends = codec.encode_all(batch.column(1))
            ids = np.insert(ids, ends, end_id).astype("<u4")
            sizes = np.diff(ends, prepend=0) + 1
            parts = -(-sizes // length)
            owner = np.repeat(np.arange(len(sizes)), parts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * length
            size = np.minimum(sizes[owner] - start, length)
            first = (np.cumsum(sizes) - sizes)[owner] + start
            cuts = [ids[a:b] for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
            columns += [pa.array([x.tobytes() for x in cuts], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(run, "word_bpe"), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Packer:
    """Packings of one list of sizes. A packing is a list of bins, a bin a pair of its fill and its item numbers."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.bound = -(-sum(sizes) // capacity)  # no packing has fewer bins
        self.rng = random.Random(seed)
        self.crossed = 0

    def best_fit(self, bins: list[tuple], items: list[int]) -> list[tuple]:
        """Each item, in the given order, goes to the fullest bin that holds it; at a tie to the latest."""
        sizes, capacity = self.sizes, self.capacity
        held = [b[1] for b in bins]
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        rooms = 0  # bit r: a bin with room r
        for k, b in enumerate(bins):
            by_room[capacity - b[0]].append(k)
            rooms |= 1 << capacity - b[0]
        for i in items:
            size = sizes[i]
            fits = rooms >> size
            if fits:
                room = size + ((fits & -fits).bit_length() - 1)
                k = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
                held[k] += (i,)
                room -= size
            else:
                k, room = len(held), capacity - size
                held.append((i,))
            by_room[room].append(k)
            rooms |= 1 << room
        return [(capacity - room, held[k]) for room, where in enumerate(by_room) for k in where]

    def fitness(self, bins: list[tuple]) -> tuple[int, float]:
        """Fewer bins are better; of as many, the more unevenly filled."""
        return len(bins), -sum((b[0] / self.capacity) ** 2 for b in bins)

    def start(self, jitter: float) -> list[tuple]:
        """Best fit by falling size, each size off by up to the jitter; 0: best-fit decreasing."""
        return self.best_fit([], sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i] * (1 + jitter * self.rng.random()), i)))

    def cross(self, base: list[tuple], donor: list[tuple]) -> list[tuple]:
        """Inject most of the donor's fullest bins, drop the base's bins that share an item, best-fit the displaced."""
        self.crossed += 1
        fullest = sorted(donor, key=lambda b: (-b[0], b[1]))[: max(1, len(donor) // 2)]
        injected = [b for b in fullest if self.rng.random() < 0.6] or fullest[:1]
        taken = {i for b in injected for i in b[1]}
        kept, displaced = [], []
        for b in base:
            if taken.isdisjoint(b[1]):
                kept.append(b)
            else:
                displaced += [i for i in b[1] if i not in taken]
        # The emptiest bins, and a few others by lot, are opened again, so that their items can fill others.
        kept.sort(key=lambda b: (-b[0], b[1]))
        opened = max(1, len(kept) // 10)
        stay, again = kept[:-opened], kept[-opened:]
        again += [b for b in stay if b[0] < self.capacity and self.rng.random() < 0.1]
        gone = {b[1] for b in again}
        displaced += [i for b in again for i in b[1]]
        displaced.sort(key=lambda i: (-self.sizes[i], i))
        return self.best_fit(injected + [b for b in stay if b[1] not in gone], displaced)

    def evolve(self, elites: list[list[tuple]], generations: int, population: int) -> list[tuple]:
        """The best packing after so many crossovers, or the first one that meets the bound."""
        pool = list(elites)
        if pool and min(map(len, pool)) <= self.bound:
            return min(pool, key=self.fitness)
        while len(pool) < population:  # a new island's own orders, from nearly falling to random
            pool.append(self.start(0.1 + 2 * self.rng.random()))
        pool.sort(key=self.fitness)
        for _ in range(generations):
            if len(pool[0]) <= self.bound:
                break
            mate = pool[self.rng.randrange(1, len(pool))]
            child = self.cross(pool[0], mate) if self.rng.random() < 0.5 else self.cross(mate, pool[0])
            pool = sorted([*pool, child], key=self.fitness)[:population]
        return pool[0]


def _bins_of(labels: np.ndarray, sizes: np.ndarray) -> list[tuple]:
    if not len(labels):
        return []
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    fills = np.add.reduceat(sizes[order], np.append(0, cuts))
    return [(fill, tuple(x.tolist())) for fill, x in zip(fills.tolist(), np.split(order, cuts), strict=True)]


ISLAND = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("elite", pa.binary()), ("bins", pa.int64()), ("bound", pa.int64()), ("before", pa.int64()), ("crossed", pa.int64()), ("score", pa.float64())])
ISLAND_DDL = "shard long, island int, elite binary, bins long, bound long, before long, crossed long, score double"


def _epoch(frame: DataFrame, capacity: int, epoch: int, generations: int, population: int) -> DataFrame:
    """One epoch of every island: from its sizes and the elites that it starts from to its best packing, as a bin for each
    item; before is the least number of bins among the elites (in the first epoch: of one own start)."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                shard, island = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                sizes = batch.column(2)[at].values.to_numpy()
                packer = Packer(sizes.tolist(), capacity, zlib.crc32(f"{shard} {island} {epoch}".encode()))
                elites = [_bins_of(np.frombuffer(e, "<u4"), sizes) for e in batch.column(3)[at].as_py() or []] or [packer.start(2.0)]
                best = packer.evolve(elites, generations, population)
                labels = np.zeros(len(sizes), "<u4")
                for k, b in enumerate(best):
                    labels[list(b[1])] = k
                row = (shard, island, labels.tobytes(), len(best), packer.bound, min(map(len, elites)), packer.crossed, packer.fitness(best)[1])
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ISLAND, strict=True)], schema=ISLAND)

    return frame.select("shard", "island", "sizes", "elites").mapInArrow(lean(run), ISLAND_DDL)


def evolve_islands(groups: DataFrame, shards: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> list[DataFrame]:
    """The table of all islands (columns of ISLAND) after each epoch, for groups (shard, items). Ends when every shard has met its bound."""
    tasks = max(shuffle_parts(groups.sparkSession), -(-shards * islands // TASK_ISLANDS))
    world = groups.select("shard", F.col("items.length").alias("sizes"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    held: list[DataFrame] = []
    for epoch in range(epochs):
        now = world.withColumn("elites", F.lit(None).cast("array<binary>"))
        if held:
            # Migration on a ring: an island starts from its own elite and its neighbour's.
            own = held[-1].select("shard", "island", F.col("elite").alias("own"))
            near = held[-1].select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("near"))
            now = world.join(own, ["shard", "island"]).join(near, ["shard", "island"]).withColumn("elites", F.array("own", "near"))
        held.append(materialize(_epoch(now.repartition(tasks, "shard", "island"), capacity, epoch, generations, population), f"packing-epoch{epoch}"))
        if held[-1].groupBy("shard").agg(F.min(F.col("bins") - F.col("bound")).alias("over")).where("over > 0").isEmpty():
            break
    return held


def shards_of(rest: DataFrame, shard_pieces: int = SHARD_PIECES) -> tuple[DataFrame, int]:
    """(shard, items) of rows (length, __row), dealt by a hash of their unique number, and how many shards: a shard's list is bounded."""
    shards = max(1, -(-rest.count() // shard_pieces))
    item = F.struct(F.col("length"), F.col("__row"))
    return rest.withColumn("shard", F.pmod(F.xxhash64("__row"), F.lit(shards))).groupBy("shard").agg(F.sort_array(F.collect_list(item)).alias("items")), shards


def pack(cut: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES, **world) -> DataFrame:
    """cut's columns (it must have length) with sequence_id and offset. No length may exceed the capacity. world: what evolve_islands takes."""
    names = cut.columns
    held = materialize(cut.withColumn("__row", F.monotonically_increasing_id()), "packing-pieces")
    full = held.where(F.col("length") == capacity)
    groups, shards = shards_of(held.where(F.col("length") < capacity).select("length", "__row"), shard_pieces)
    groups = materialize(groups, "packing-shards")
    best = evolve_islands(groups, shards, capacity, **world)[-1].groupBy("shard").agg(F.min_by("elite", F.struct("bins", "score", "island")).alias("elite"))
    placed = _place(groups.join(best, "shard"))
    own_sequence = full.select("__row", (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return held.join(placed.unionByName(own_sequence), "__row").select(*[F.col(f"`{c}`") for c in names], "sequence_id", "offset")


def _place(frame: DataFrame) -> DataFrame:
    """__row, sequence_id, offset of every piece from its shard's packing."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                items, labels = batch.column(1)[at].values, np.frombuffer(batch.column(2)[at].as_py(), "<u4").astype(np.int64)
                sizes, rows = items.field(0).to_numpy(), items.field(1).to_numpy()
                order = np.argsort(labels, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.flatnonzero(np.diff(labels[order], prepend=-1))
                base = np.repeat(ends[first] - sizes[order][first], np.diff(np.append(first, len(order))))
                offset = ends - sizes[order] - base
                yield pa.RecordBatch.from_arrays([pa.array(rows[order]), pa.array((batch.column(0)[at].as_py() << 32) + labels[order]), pa.array(offset)], names=["__row", "sequence_id", "offset"])

    return frame.select("shard", "items", "elite").mapInArrow(lean(run), "__row long, sequence_id long, offset long")
