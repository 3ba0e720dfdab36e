"""Exact dedup over an extendible-hash index on shared files, in DataFrame functions only.

Each text's 64-bit hash is its key. The directory starts with one bucket and doubles, by one more leading bit of the
keys, while a bucket holds more than its capacity of distinct keys; only overfull buckets split, so a bucket owns one
range of keys and as many slots as its depth leaves it. The directory is a table of slots, however large. Every row finds
its bucket through its key's slot. Owner tasks take whole buckets: they chain the digests of each key, with the number of
rows and the row that stays, and write that index; rows then probe it under their bucket and key and follow the chain to
their digest. Keys that occur more than once have their texts compared byte by byte; texts that differ under one chain
entry are told apart by their bytes. Only hashes are shuffled, apart from the texts of repeated keys, and copies are
combined on the map side first, so a group of any number of copies is one row for each task.

Defined results: a null text counts as empty; empty texts are equal. Of equal texts the largest id stays (null ids are
the smallest); of repeated rows with that id exactly one stays. The group counts every row. Null ids are kept as nulls.
An empty table gives no rows. Other columns of the input are not read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.shared import materialize, maybe_broadcast, shuffle_parts

BUCKET_KEYS = 16_384
#: Whole buckets are dealt to owner tasks of about so many.
OWNER_BUCKETS = 64
#: Keys are counted by so many more leading bits than even buckets would need.
SPARE_BITS = 4


def directory(keys: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """(global depth, a table of slot, bucket, depth) for the distinct values of column h.

    A bucket is the leading bits of its keys, as many as its depth; it is numbered by its first slot. One that is over its
    capacity at the last counted bit stays as it is, with overflow chains."""
    counted = keys.groupBy("h").agg(F.lit(1).alias("n"))
    bits = min(62, max(0, (keys.count() - 1) // capacity).bit_length() + SPARE_BITS)
    prefixes = counted.groupBy(_leading(F.col("h"), bits).alias("prefix")).agg(F.sum("n").alias("n"))
    # After d doublings the buckets are the prefixes of d bits.
    doubled = prefixes.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    doubled = doubled.groupBy("depth", F.expr(f"shiftright(prefix, {bits} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
    doubled = materialize(doubled, "dedup-doublings")
    overfull = doubled.where((F.col("n") > capacity) & (F.col("depth") < bits)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    split = doubled.withColumn("parent", F.shiftright("prefix", 1)).join(maybe_broadcast(overfull), ["depth", "parent"], "left_semi").unionByName(doubled.where("depth = 0").withColumn("parent", F.col("prefix")))
    buckets = split.where((F.col("n") <= capacity) | (F.col("depth") == bits)).select("depth", "prefix")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")
    return depth, materialize(buckets.select(F.explode(F.sequence(first, last)).alias("slot"), first.alias("bucket"), "depth"), "dedup-directory")


def _leading(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_KEYS,
    key: Callable[[Column], Column] = F.xxhash64,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """id, keep_id, group_size, kept, digest (lower-case hex) for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", key(F.col("text")).cast("long").alias("h"), digest(F.col("text")).alias("digest"))
    keys = materialize(rows.select("id", "h", "digest").withColumn("row", F.monotonically_increasing_id()), "dedup-keys")

    depth, slots = directory(keys.select("h"), capacity)
    slots = slots.select("slot", "bucket")
    routed = keys.withColumn("slot", _leading(F.col("h"), depth)).join(maybe_broadcast(slots), "slot").drop("slot")

    # Insertion: copies are combined before they move; then each bucket's owner chains its keys' digests.
    entries = routed.groupBy("bucket", "h", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("stays"))
    owners = max(shuffle_parts(spark), slots.select("bucket").distinct().count() // OWNER_BUCKETS)
    owned = entries.repartition(owners, "bucket")
    index = owned.groupBy("bucket", "h").agg(F.sort_array(F.collect_list(F.struct("digest", "n", "stays"))).alias("chain"))
    index = materialize(index.sortWithinPartitions("bucket", "h"), "dedup-index")

    # Bytes are compared where a chain entry has more than one row.
    repeated = index.where(F.exists("chain", lambda e: e.n > 1)).select("h", F.explode("chain").alias("entry")).where("entry.n > 1")
    again = maybe_broadcast(repeated.select("h", F.col("entry.digest").alias("digest")))
    texts = rows.join(again, ["h", "digest"], "left_semi").groupBy("h", "digest", "text").agg(F.count(F.lit(1)).alias("n"))
    differ = materialize(texts.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h", "digest"), "dedup-differ")

    out = ["id", "keep_id", "group_size", "kept", "digest"]
    clash = not differ.isEmpty()
    probing = routed.join(differ, ["h", "digest"], "left_anti") if clash else routed
    found = probing.join(index, ["bucket", "h"]).withColumn("entry", F.filter("chain", lambda e: e.digest == F.col("digest"))[0])
    found = found.select("id", F.col("entry.stays.id").alias("keep_id"), F.col("entry.n").alias("group_size"), (F.col("row") == F.col("entry.stays.row")).alias("kept"), "digest")
    if clash:
        same = Window.partitionBy("h", "digest", "text")
        split = rows.join(differ, ["h", "digest"], "left_semi").withColumns(
            {"group_size": F.count(F.lit(1)).over(same), "keep_id": F.max("id").over(same), "kept": F.row_number().over(same.orderBy(F.col("id").desc_nulls_last())) == 1}
        )
        found = found.select(*out).unionByName(split.select(*out))
    return found.select(F.col("id").alias(id_col), *out[1:-1], F.lower(F.hex("digest")).alias("digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, with all its columns."""
    found = materialize(dedup(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.unhex("digest").alias("__digest"), "kept"), "dedup-found")
    by_row = found.groupBy("__id", "__digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    gone = by_row.where(~F.col("stays")).select("__id", "__digest")
    digest = _sha256(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest"))
    out = docs.join(maybe_broadcast(gone), same, "left_anti")
    repeated = by_row.where("stays and rows > 1").select("__id", "__digest")
    if repeated.isEmpty():
        return out
    # Rows with one id and one text: the first by their other columns' hash stays.
    repeated = maybe_broadcast(repeated)
    number = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy("__order"))
    one = out.join(repeated, same).withColumn("__order", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).withColumn("__n", number).where("__n = 1").select(*docs.columns)
    return out.join(repeated, same, "left_anti").unionByName(one)
