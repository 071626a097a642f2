"""The queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, jaccard, lm, mixing, packing, quality, sharding, tokenfile, urlfilter, warc

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


VOCABULARIES = "TIDEMARK_TOKENIZERS"


def vocabulary(name: str) -> str:
    """A public tokenizer file; the environment may name another folder."""
    folder = os.environ.get(VOCABULARIES)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index, books = ann.build(rows, 5)
    return ann.search(index, books, rows.where("vec_id % 50 = 0"), 5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, percent=90, links=True)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urlfilter.fit(urlfilter.weak_labels(pages, URL_RULES))
    return urlfilter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_rows(sized, 16, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), seed=17, details=True)
    return mixed.select("doc_id", "source", "n_copies", "copy")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_files(files)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_ann, op2_quality, op3_jaccard, op4_lm_score, op5_url_filter, op6_packing, op7_sharding, op8_mixing, op9_token_files, op10_warc)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    from tidemark.llm.oracles import ORACLES

    return dict(ORACLES)
