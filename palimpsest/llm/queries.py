"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import oracles
from palimpsest.llm.scratch import table


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palimpsest.llm.packing import pack
    from palimpsest.llm.tokens import token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), 1024)


def op2_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.93)


def op3_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.urls import Rule, judge_urls

    allow, block = ("org/", "com/fr/"), ("example.org/es/", "example.org/en/1", "com/de/")
    rules = [Rule(x, "allow") for x in allow] + [Rule(x, "block") for x in block]
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", rules)


def op4_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.minhash import near_documents

    return near_documents(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, percent=85)


def op5_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.sharding import two_pass_shuffle

    out = two_pass_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", shards=16)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out("doc_id")), "text", "lang")
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), net, "text").drop("text")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.language import held_out
    from palimpsest.llm.toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = fit(docs, labels.where(~held_out("doc_id")), "doc_id", "text", {"poor": "quality = 0", "toxic": "toxic = 1"})
    return score(docs, chain, "doc_id", "text").withColumn("held_out", held_out("doc_id"))


def op8_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.repeats import repeated_passages

    out = repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text", words=50)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
