"""The opN_ queries: each applies its operator to the whole of its table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import audio, bpe, brown_lm, exact_dedup, html_extract, packing, simhash, substring_dedup, toxicity, url_filter
from vectorloom.llm.shared import crc_mod


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), round_trip=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    scored = toxicity.score(docs, lexicon)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, radius=3)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = crc_mod(F.col("doc_id"), 10) != 0
    found = brown_lm.scores(_table(spark, sf_dir, "documents"), train)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), width=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2048)
    return packing.pack(cut, 2048).withColumnRenamed("id", "doc_id")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.tensor_summary(audio.features(audio.store(_table(spark, sf_dir, "documents"))))
    digits = F.array_join(F.transform("mel_mean", lambda x: F.format_number(x, 3)), " ")
    spans = F.array_join(F.transform("segments", lambda s: F.concat(F.format_number(s.start_s, 3), F.lit("-"), F.format_number(s.end_s, 3))), " ")
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -audio.UNIT, audio.UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("frames").cast("string"), F.col("n_tensors").cast("string"), "tensor_shape", F.format_number("tensor_mean", 3), F.format_number("covered_s", 3), digits, F.sha2(spans, 256)).alias("feature"),
    )


QUERIES = [op1_bpe, op2_toxicity, op3_simhash, op4_html, op5_brown_lm, op6_exact_dedup, op7_url_filter, op8_substring_dedup, op9_packing, op10_audio]
ORACLES: dict[str, str] = {
    # The pages' html holds no canonical links or refreshes, so no alias adds to the rules; tests/llm checks aliases.
    "op7_url_filter": """
        select page_id, host, path, rule, coalesce(case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end, 'allow') as verdict
        from (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                             when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                             when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                             when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
              from (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                           coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages))
    """,
    "op6_exact_dedup": """
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
        from (select doc_id, t, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size
              from (select doc_id, coalesce(text, '') as t from documents))
    """,
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
