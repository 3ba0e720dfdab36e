"""Plain versions and small tables for the corpus operators."""

import re
import zlib

TEXT_DDL = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], TEXT_DDL)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


class Forest:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def clashing(df):
    """The table with more columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "key", "row", "h", "digest", "block", "mark", "fp", "root", "n", "kept", "score", "length", "piece", "host", "slice", "train", "label"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})
