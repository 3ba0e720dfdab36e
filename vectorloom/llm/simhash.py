"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts, sorted by their population counts; pairs of
sub-tiles whose population counts differ by more than the radius are skipped. Few fingerprints are one bucket. Of many,
two within radius r of each other agree on at least m - r of any m blocks of bits, so they are dealt into buckets by bits
of such blocks, as many bits as leave about BUCKET rows in a bucket: every link is found (pigeonhole), and the comparisons
stay near linear in the input. A bucket over a tile is cut into tiles by population counts, each pair of which within the
radius is one task's work. Links are reduced to stars inside a task, so a group of n copies costs n - 1 rows, not n * n.

Groups of similar documents (`similar_groups`, `keep_one`) are decided by shingle sets. Sets that are similar share a key,
whatever their sizes (a shingle of their prefixes), so no pair is lost; documents that share keys fall into families, and
inside a family 128-bit fingerprints are compared in tiles: nearest pairs are verified first, and pairs that are connected already are
passed over; what is left apart meets by its rarest shingles.

Fingerprint: words are runs without ASCII white space after lower-casing A-Z; shingles of k words, repeats included,
joined by one space (fewer words: the whole sequence); XXH64, seed 42; a bit is set if it is in over half the hashes.
Defined results: a null or blank text has fingerprint zero and links like any other. A component's id is its smallest
id, nulls last. Repeated rows are kept, each with its component. An empty table gives no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import substring_dedup
from vectorloom.llm.bpe import slices
from vectorloom.llm.components import components, least_of, local_stars
from vectorloom.llm.shared import block_count, materialize, maybe_broadcast, shuffle_parts, small_batches
from vectorloom.llm.url_filter import LOWER, UPPER
from vectorloom.llm.workers import lean, lean_group

SEED = 42
BITS = 64
TILE = 8192
BUCKET = 4096
SUB_TILE = 128


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(k, len(words))
    of = xxhash.xxh64_intdigest
    return np.fromiter([of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long), size (distinct shingles) and, if asked for, their sorted hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps, size, held = [], [], []
                for text in part.column(1).to_pylist():
                    hashes = shingle_hashes(text, k)
                    fps.append(fingerprint(hashes))
                    if sets:
                        own = np.unique(hashes)
                        size.append(len(own))
                        held.append(own.astype("<u8").tobytes())
                columns = [part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
                columns += [pa.array(size, pa.int64()), pa.array(held, pa.binary())] if sets else []
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "size", "hashes"][: len(columns)])

    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(run), f"id {kind}, fp long" + (", size long, hashes binary" if sets else ""))


def block_masks(radius: int, rows: int, bucket: int = BUCKET) -> list[int]:
    """Masks such that fingerprints within the radius agree under one at least, with bits enough for buckets of about so
    many rows. [0]: one bucket, where rows are few or no agreement is certain."""
    width = max(0, rows // bucket).bit_length()
    if not width:
        return [0]
    masks = [0]
    for m in range(radius + 1, radius + 4):
        edges = [BITS * i // m for i in range(m + 1)]
        blocks = list(zip(edges, edges[1:], strict=False))
        bits = [[x for a, b in some for x in range(a, b)] for some in combinations(blocks, m - radius)]
        if min(map(len, bits)) < min(8, width):
            break
        masks = [sum(1 << x for x in some[:width]) for some in bits]
        if min(map(len, bits)) >= width:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tally: Counter | None = None):
    """(i, j) in blocks for fingerprints a[i], b[j] within the radius; if same, a is b and i < j. Both sorted by population
    count. tally: counts the pairs of sub-tiles that were compared and skipped."""
    tally = Counter() if tally is None else tally
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    for i in range(0, len(a), SUB_TILE):
        x, low, high = a[i : i + SUB_TILE], int(pa_[i]), int(pa_[min(i + SUB_TILE, len(a)) - 1])
        for j in range(i if same else 0, len(b), SUB_TILE):
            if int(pb[j]) - high > radius:
                tally["skipped"] += -(-(len(b) - j) // SUB_TILE)
                break
            if low - int(pb[min(j + SUB_TILE, len(b)) - 1]) > radius:
                tally["skipped"] += 1
                continue
            tally["compared"] += 1
            near = np.bitwise_count(x[:, None] ^ b[None, j : j + SUB_TILE]) <= radius
            p, q = np.nonzero(np.triu(near, 1) if same and i == j else near)
            if len(p):
                yield p + i, q + j


def _star_links(fps: np.ndarray, p: list, q: list) -> tuple[np.ndarray, np.ndarray]:
    root = local_stars(len(fps), np.concatenate(p), np.concatenate(q))
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def _links_of_run(fps: np.ndarray, radius: int, same_from: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Star links among fps (sorted by population count), or between fps[:same_from] and the rest."""
    left, right = (fps, fps) if same_from is None else (fps[:same_from], fps[same_from:])
    shift = 0 if same_from is None else same_from
    ps, qs, held = [], [], 0
    for p, q in near_pairs(left, right, radius, same_from is None):
        ps.append(p)
        qs.append(q + shift)
        held += len(p)
        if held > 2_000_000:
            root = local_stars(len(fps), np.concatenate(ps), np.concatenate(qs))
            own = np.flatnonzero(root != np.arange(len(fps)))
            ps, qs, held = [own], [root[own]], len(own)
    return _star_links(fps, ps, qs) if ps else (fps[:0], fps[:0])


def _popcount_order(fps: np.ndarray) -> np.ndarray:
    return np.argsort(np.bitwise_count(fps), kind="stable")


def links(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(u, v): star links that connect the distinct fingerprints (column fp) within the radius of each other."""
    n = nodes.count()
    masks = block_masks(radius, n)
    spread = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])).alias("x"))
    spread = spread.select("fp", "x.t", "x.k", F.bit_count("fp").alias("pop"))
    sizes = spread.groupBy("t", "k").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    large = materialize(sizes.where(F.col("rows") > tile), "simhash-large")
    some = not large.isEmpty()
    parts = max(shuffle_parts(nodes.sparkSession), n * len(masks) // 200_000)

    def whole(batches):
        """Runs of one bucket, in batches that are sorted by bucket; the last run waits for the next batch."""
        rest: tuple[np.ndarray, ...] | None = None
        for batch in _with_end(batches):
            if batch is None:
                part = rest
            else:
                got = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
                part = got if rest is None else tuple(np.concatenate(x) for x in zip(rest, got, strict=True))
            if part is None or not len(part[0]):
                continue
            t, k, fps = part
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(t)]
            if batch is not None:
                rest = tuple(x[bounds[-2] :] for x in part)
                bounds = bounds[:-1]
            yield from _emit(_links_of_run(fps[a:b][_popcount_order(fps[a:b])], radius) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1)

    small = spread.join(large.select("t", "k"), ["t", "k"], "left_anti") if some else spread
    found = small.repartition(parts, "t", "k").sortWithinPartitions("t", "k").select("t", "k", "fp").mapInArrow(lean(whole), "u long, v long")
    if some:
        found = found.unionByName(_large_links(spread.join(maybe_broadcast(large.select("t", "k")), ["t", "k"]), radius, tile))
    return found


def _with_end(batches):
    yield from batches
    yield None


def _emit(pairs):
    u, v = [], []
    for a, b in pairs:
        if len(a):
            u.append(a)
            v.append(b)
    if u:
        names = ["u", "v"]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=names)


def tile_pairs(rows: DataFrame, keys: list[str], klass: str, reach: int, tile: int, payload: list[str]) -> DataFrame:
    """Rows dealt to the tile pairs that they belong to: keys, ca, qa, cb, qb, side ('a', 'b', or 'a' alone where both are one tile).

    A class of a bucket has ceil(rows / tile) tiles, dealt by a hash; tiles meet if their classes are within reach."""
    units = rows.groupBy(*keys, klass).agg(F.count(F.lit(1)).alias("rows")).select(*keys, klass, F.ceil(F.col("rows") / tile).cast("int").alias("tiles"))
    units = materialize(units, "simhash-units")
    own = rows.join(units, [*keys, klass]).withColumn("q", F.pmod(F.xxhash64(*payload), F.col("tiles")).cast("int")).drop("tiles")
    own = own.withColumn("oc", F.explode(F.sequence(F.col(klass) - reach, F.col(klass) + reach)))
    meets = own.join(units.withColumnRenamed(klass, "oc"), [*keys, "oc"]).withColumn("oq", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    first = (F.col(klass) < F.col("oc")) | ((F.col(klass) == F.col("oc")) & (F.col("q") <= F.col("oq")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return meets.select(*keys, pick(klass, "oc").alias("ca"), pick("q", "oq").alias("qa"), pick("oc", klass).alias("cb"), pick("oq", "q").alias("qb"), F.when(first, "a").otherwise("b").alias("side"), *payload)


def _large_links(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    def compare(table: pa.Table) -> pa.Table:
        fps, side = table["fp"].to_numpy().view(np.uint64), table["side"].to_numpy(zero_copy_only=False) == "a"
        a, b = fps[side], fps[~side]
        a = a[_popcount_order(a)]
        if len(b):
            b = b[_popcount_order(b)]
            u, v = _links_of_run(np.concatenate([a, b]), radius, len(a))
        else:
            u, v = _links_of_run(a, radius)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    dealt = tile_pairs(rows, ["t", "k"], "pop", radius, tile, ["fp"])
    return dealt.groupBy("t", "k", "ca", "qa", "cb", "qb").applyInArrow(lean_group(compare), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: components of fingerprints linked within the radius."""
    own = materialize(fingerprints(docs, k, id_col, text_col), "simhash-fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(materialize(links(nodes, radius, tile), "simhash-links"), "simhash")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    named = rooted.join(least_of(rooted, "root", F.col("least"), "component_id"), "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


# Groups of similar documents: prefixes of sets and wide fingerprints find pairs, shingle sets decide.

#: Pairs within this radius of 128 bits are tried first. At the similarity of 0.8 about 19 bits differ, of others 64.
WIDE_RADIUS = 36
#: Rows of a family that are compared in one task with their texts at hand.
FAMILY_TILE = 512


def wide_hashes(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles' 128-bit hashes as two columns; a text of fewer words is one shingle, a blank one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, 2), np.uint64)
    k = min(k, len(words))
    shingles = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles)), "<u8").reshape(-1, 2)


def prefix_size(size: int, similarity: float) -> int:
    """How many of a set's first items, in one order for all sets, any similar set must share one of."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _key_links(keyed: DataFrame) -> DataFrame:
    """(u, v): star links that connect the rows that share a key (columns row, key)."""
    return keyed.join(least_of(keyed, "key", F.col("row"), "least"), "key").where("row <> least").select(F.col("row").alias("u"), F.col("least").alias("v")).distinct()


def _nominated(rows: DataFrame, k: int, similarity: float, block_bytes: int) -> DataFrame:
    """id, mark, size of every row (id, mark, text); for rows that may have a similar one also f0, f1 (wide fingerprints),
    alike (a digest of the shingle set) and keys: the shingles of the prefix that are estimated to occur elsewhere.

    In the order of a set's shingles those that surely occur nowhere else come first, then the others by their hashes."""

    def use(table: pa.Table, block: substring_dedup.Block, often: np.ndarray) -> pa.Table:
        n, distinct = len(block.order), max(1, len(block.first))
        pairs = np.unique(np.repeat(np.arange(n), block.counts) * distinct + block.of)
        doc, item = pairs // distinct, pairs % distinct
        size = np.bincount(doc, minlength=n)
        elsewhere = often[item] if len(item) else np.zeros(0, bool)
        spare = np.array([prefix_size(int(x), similarity) for x in size], np.int64) - np.bincount(doc[~elsewhere], minlength=n)
        doc, item = doc[elsewhere], item[elsewhere]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        leads = rank < spare[doc]
        doc, keys = doc[leads], block.first[item[leads]].view(np.int64)
        short = block.counts == 0  # fewer words than a shingle: one shingle or none
        named = short | (spare > 0)
        texts, found = block.texts, []
        for at in range(n):
            if named[at]:
                h = wide_hashes(texts[int(block.order[at])].as_py(), k)
                found.append((len(h), fingerprint(h[:, 0]), fingerprint(h[:, 1]), xxhash.xxh3_128_digest(h[np.lexsort((h[:, 1], h[:, 0]))].tobytes())))
            else:
                found.append((int(size[at]), 0, 0, None))
        sizes, f0, f1, alike = zip(*found, strict=True) if found else ((),) * 4
        offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
        order = pa.array(block.order)
        columns = [table["id"].take(order), table["mark"].take(order), pa.array(sizes, pa.int64()), *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f0, f1)), pa.array(alike, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys))]
        return pa.table(columns, names=["id", "mark", "size", "f0", "f1", "alike", "keys"])

    small_batches(rows)
    blocks = block_count(rows, "text", block_bytes)
    dealt = rows.select("id", "mark", F.monotonically_increasing_id().alias("key"), F.translate("text", UPPER, LOWER).alias("text"), F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).alias("block"))
    windows = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # about; more cells only cost bits
    kind = rows.schema["id"].dataType.simpleString()
    return substring_dedup.with_repeated(dealt, k, windows, use, f"id {kind}, mark long, size long, f0 long, f1 long, alike binary, keys array<long>")


def _wide_pairs(x: dict, y: dict, radius: int, similarity: float, same: bool):
    """(i, j, distance) in blocks for rows within the radius whose sizes allow the similarity; if same, x is y and i < j.

    x and y hold f0, f1 and size, sorted by the population count of f0."""
    for i in range(0, len(x["f0"]), SUB_TILE):
        own = {c: v[i : i + SUB_TILE] for c, v in x.items()}
        low, high = int(np.bitwise_count(own["f0"][0])), int(np.bitwise_count(own["f0"][-1]))
        for j in range(i if same else 0, len(y["f0"]), SUB_TILE):
            other = {c: v[j : j + SUB_TILE] for c, v in y.items()}
            if int(np.bitwise_count(other["f0"][0])) - high > radius or low - int(np.bitwise_count(other["f0"][-1])) > radius:
                continue
            d = np.bitwise_count(own["f0"][:, None] ^ other["f0"][None, :])
            d += np.bitwise_count(own["f1"][:, None] ^ other["f1"][None, :])
            p, q = np.nonzero(np.triu(d <= radius, 1) if same and i == j else d <= radius)
            if len(p):
                a, b = own["size"][p], other["size"][q]
                ok = np.minimum(a, b) >= similarity * np.maximum(a, b)
                yield p[ok] + i, q[ok] + j, d[p[ok], q[ok]]


def _columns(table: pa.Table, on: np.ndarray, names: tuple[str, ...] = ("row", "size", "f0", "f1")) -> tuple[dict, np.ndarray]:
    """The rows of a mask, sorted by the population count of f0, and their positions in the table."""
    at = np.flatnonzero(on)
    got = {c: table[c].to_numpy()[at] for c in names}
    got |= {c: got[c].view(np.uint64) for c in ("f0", "f1")}
    order = np.argsort(np.bitwise_count(got["f0"]), kind="stable")
    return {c: v[order] for c, v in got.items()}, at[order]


def _sure_links(table: pa.Table, side: np.ndarray, k: int, radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect the rows of a table (row, f0, f1, size, text) whose shingle sets are similar: within side a if it
    is all, else between its two sides. Nearest pairs come first, and pairs that are connected already are passed over."""
    (x, at_x), (y, at_y) = _columns(table, side), _columns(table, ~side)
    same = not len(at_y)
    none = (np.zeros(0, np.int64),) * 3
    blocks = list(_wide_pairs(x, x if same else y, radius, similarity, same))
    p, q, d = (np.concatenate(c) for c in zip(none, *blocks, strict=True))
    order = np.lexsort((q, p, d))
    left, right = at_x[p[order]].tolist(), (at_x if same else at_y)[q[order]].tolist()
    rows, up, sets, u, v = table["row"].to_pylist(), list(range(table.num_rows)), {}, [], []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def of(i: int) -> set[bytes]:
        if i not in sets:
            sets[i] = _shingle_set(table["text"][i].as_py(), k)
        return sets[i]

    def decide(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            s, t = of(i), of(j)
            common = len(s & t)
            if (not s and not t) or common >= similarity * (len(s) + len(t) - common) > 0:
                up[a] = b
                u.append(rows[i])
                v.append(rows[j])

    for i, j in zip(left, right, strict=True):
        decide(i, j)

    # At any distance of fingerprints similar sets share one of their rarest shingles.
    size = table["size"].to_numpy()
    full = np.flatnonzero(size > 0).tolist()
    if len({root(i) for i in full}) < 2:
        return u, v
    rows_with = Counter(w for i in full for w in of(i))
    # Rows of the largest group are connected already: they meet only the others, so its size counts once, not squared.
    held = Counter(root(i) for i in full).most_common(1)[0][0]
    largest = {i for i in full if root(i) == held}
    full.sort(key=lambda i: i in largest)
    holders: dict[bytes, list[int]] = defaultdict(list)
    for i in full:
        n, tried = int(size[i]), set()
        rare = sorted((w for w in of(i)), key=lambda w: (rows_with[w], w))
        for w in rare[: n - math.ceil(similarity * n - 1e-9) + 1]:
            if rows_with[w] > 1:
                for j in holders[w]:
                    if j not in tried and (same or side[i] != side[j]):
                        tried.add(j)
                        decide(i, j)
                if i not in largest:
                    holders[w].append(i)
    return u, v


def _verified(members: DataFrame, k: int, radius: int, similarity: float, family_tile: int) -> DataFrame:
    """(u, v): links by shingle sets inside the families of members (family, row, f0, f1, size, class, text)."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > family_tile).select("family"), "similar-large")
    parts = shuffle_parts(members.sparkSession)

    def runs(batches):
        """Whole families, in batches that are sorted by family; the last one waits for the next batch."""
        rest = None
        for batch in _with_end(batches):
            part = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if part is None or not part.num_rows:
                continue
            family = part["family"].to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(family)) + 1).tolist(), len(family)]
            if batch is not None:
                rest, bounds = part.slice(bounds[-2]), bounds[:-1]
            u, v = [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                own = _sure_links(part.slice(a, b - a), np.ones(b - a, bool), k, radius, similarity)
                u += own[0]
                v += own[1]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def pair(table: pa.Table) -> pa.Table:
        u, v = _sure_links(table, table["side"].to_numpy(zero_copy_only=False) == "a", k, radius, similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    some = not large.isEmpty()
    small = members.join(maybe_broadcast(large), "family", "left_anti") if some else members
    small = small.select("family", "row", "f0", "f1", "size", "text")
    found = small.repartition(parts, "family").sortWithinPartitions("family").mapInArrow(lean(runs), "u long, v long")
    if some:
        big = members.join(maybe_broadcast(large), "family")
        dealt = tile_pairs(big, ["family"], "class", 1, family_tile, ["row", "f0", "f1", "size", "text"])
        found = found.unionByName(dealt.groupBy("family", "ca", "qa", "cb", "qb").applyInArrow(lean_group(pair), "u long, v long"))
    return found


def _shingle_set(text: str | None, k: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(k, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = WIDE_RADIUS, family_tile: int = FAMILY_TILE, block_bytes: int = substring_dedup.BLOCK_BYTES) -> DataFrame:
    """id, mark (xxhash64 of the text), group_id, stays for every row: groups of documents linked by similarity.

    Similar sets share a shingle of their prefixes in an order that all sets have in common (Chaudhuri et al., 2006). A
    count-min sketch tells the shingles that occur nowhere else; these lead, so that passages of many documents nominate
    only documents that consist of them. One row stands for all of one shingle set. Rows that share a key fall into families
    (components), and shingle sets decide inside a family. The document with the smallest id of a group stays (null ids
    last, then the smallest mark); repeated rows of one id and text are one document and stay or go together. Blank texts
    are alike."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    made = materialize(_nominated(rows, k, similarity, block_bytes).withColumn("row", F.monotonically_increasing_id()), "similar-nominated")
    ones = materialize(made.where("alike is not null").groupBy("alike").agg(F.min("row").alias("one")), "similar-sets")

    klass = F.floor(F.log("size") / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    nodes = made.where("size(keys) > 0").join(ones.select(F.col("one").alias("row")), "row", "left_semi").withColumn("class", klass)
    nodes = materialize(nodes.drop("alike"), "similar-nodes")
    keyed = nodes.select("row", F.explode("keys").alias("key"))
    family = components(_key_links(keyed), "similar-family").select(F.col("node").alias("row"), F.col("root").alias("family"))
    wanted = materialize(nodes.drop("keys").join(family, "row").withColumnsRenamed({"id": "__id", "mark": "__mark"}), "similar-members")
    same = rows["id"].eqNullSafe(F.col("__id")) & (rows["mark"] == F.col("__mark"))
    texts = rows.join(maybe_broadcast(wanted), same).select("family", "row", "f0", "f1", "size", "class", "text").dropDuplicates(["row"])
    texts = materialize(texts, "similar-texts")
    roots = components(_verified(texts, k, radius, similarity, family_tile), "similar")

    rooted = ones.join(roots, F.col("one") == F.col("node"), "left").select("alike", F.coalesce("root", "one").alias("root"))
    grouped = made.select("row", "id", "mark", "alike").join(rooted, "alike", "left").select("id", "mark", F.coalesce("root", "row").alias("root"))
    grouped = materialize(grouped, "similar-rooted")
    first = least_of(grouped, "root", F.struct(F.col("id").isNull().alias("none"), "id", "mark"), "first")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    return grouped.join(first, "root").select(F.col("id").alias(id_col), "mark", F.col("first.id").alias("group_id"), stays.alias("stays"))


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are similar to one that stays; all columns as they were."""
    gone = materialize(similar_groups(docs, k, similarity, id_col, text_col).where(~F.col("stays")).select(F.col(id_col).alias("__id"), F.col("mark").alias("__mark")), "similar-gone")
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(maybe_broadcast(gone), F.col(id_col).eqNullSafe(F.col("__id")) & (mark == F.col("__mark")), "left_anti")
