"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; `run` writes each as Parquet in the shared folder and reads
it as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from vectorloom.llm.shared import crc_mod, materialize

SEQUENCE = 2048
WINDOW = 20


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, with a lexicon learned from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod(F.col("doc_id"), 4) != 2)
    return toxicity.accept(docs, toxicity.learn(docs, labels))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    return exact_dedup.keep_one(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over shingles of five words: the smallest id."""
    return simhash.keep_one(docs, k=5, similarity=0.8)


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier. A text that loses none stays as it was; one that loses
    all stays as the empty text."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = substring_dedup.remove_repeats(docs.withColumn("__text", F.col("text")), WINDOW, carry=(*carry, "__text"))
    text = F.when(F.col("n_removed") == 0, F.col("__text")).otherwise(F.col("kept"))
    out = found.select("doc_id", text.alias("text"), *[c for c in carry if c != "n_chars"], "n_removed")
    if "n_chars" in carry:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    import public_tokenizers

    cut = packing.pieces(docs, str(public_tokenizers.path("word_bpe_49k.json")), SEQUENCE)
    return packing.pack(cut, SEQUENCE).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact_dedup),
    ("simhash near-dedup", stage_near_dedup),
    ("substring dedup", stage_substring_dedup),
    ("best-fit packing", stage_packing),
]

#: Fingerprints, learned lexicons and packings have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
