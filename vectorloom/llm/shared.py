"""What the corpus operators share: the shared folder, materialised tables, checked broadcasts, blocks of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.storage import materialize, maybe_broadcast, shared_dir

__all__ = ["block_count", "crc_mod", "materialize", "maybe_broadcast", "shared_dir", "shuffle_parts", "small_batches"]


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of the column as text, modulo m. A null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % m


#: Whole texts go to Python workers in Arrow batches of at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> None:
    """Bound the session's Arrow batches: by default 10,000 rows, which for whole texts is too much of an executor's memory."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", conf.get(key, None) or "")
        if now is None or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes of text the documents make (at least 1)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = min(shuffle_parts(docs.sparkSession), total // (1 << 20))
    return int(max(1, least, -(-total // block_bytes)))
