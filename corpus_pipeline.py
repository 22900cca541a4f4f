"""A training-data pipeline over documents: five stages, each of which works on all that the one before it kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet under the shared folder and reads again as the next stage's docs. All but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.decontaminate import find_leaks, without_leaks
from palimpsest.llm.language import UNDETERMINED, fit, held_out, identify
from palimpsest.llm.minhash import near_documents
from palimpsest.llm.packing import pack
from palimpsest.llm.pii import find_pii, redact
from palimpsest.llm.scratch import Scratch, table
from palimpsest.llm.tokens import token_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: from this score on the network's label replaces the one given
SURE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, which have no language, null and empty texts among them.

    lang becomes the network's label where that scores SURE or more, or where there was none. Rows that repeat stay, all
    of them; an empty table gives an empty result; columns that documents does not have are left out.
    """
    net = fit(docs.where(~held_out("doc_id")), "text", "lang")
    labelled = identify(docs, net, "text", "_lang", "_score").where(F.col("_lang") != UNDETERMINED)
    return labelled.withColumn("lang", F.when(F.col("lang").isNull() | (F.col("_score") >= SURE), F.col("_lang")).otherwise(F.col("lang"))).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key: doc_id, or where that is null a hash of the row from 2 ** 62 up, above any doc_id."""
    row = F.xxhash64(*[c for c in COLUMNS if c != "doc_id"])
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), row.bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group; similarity 0.8 of five-word shingles.

    Equal rows are one document. Rows that share a doc_id but not a text all stay, if it is their group's smallest.
    Rows without a doc_id are judged too, after those with one.
    """
    docs = _keyed(docs)
    groups = near_documents(docs, "_key", "text", words=5, percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("_key").alias("_gone")).distinct()
    left = docs.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    if docs.groupBy("_key").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["_key", "text"])
    return left.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with a doc_id or without.

    A null text holds none and stays; all rows of a doc_id that holds one go; an empty table gives an empty result.
    """
    docs = _keyed(docs)
    return without_leaks(docs, find_leaks(docs, table(spark, sf_dir, "benchmark"), key="_key"), "_key").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text, null for a null one.

    Every row stays; equal rows get equal texts; an empty table gives an empty result.
    """
    out = redact(docs, find_pii(docs, "doc_id", "text"), "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as can be; a null text is one piece, the end token.

    Rows that repeat are packed each; an empty table gives an empty result.
    """
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), 1024)


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("PII", private_data), ("best-fit packing", packing)]
#: learned labels, fingerprints and tokens have no SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
