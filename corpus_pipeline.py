"""A corpus pipeline: each stage is one operator, and its decisions take effect on the rows.

Stages take ``(spark, docs, sf_dir)`` and return the rows they keep with the columns of
``documents``; the last returns the encoded corpus. A stage works on everything its predecessor
kept. Its result is written as Parquet and read again as the next one's ``docs``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor.llm import bpe, decontaminate, lines, minhash, toxicity
from whofor.llm.graph import stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.3 or more go."""
    return toxicity.clean_documents(docs, docs, _table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; so do documents with no word left by that."""
    return lines.kept_documents(docs, left_words=1)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 or more on word shingles) stays."""
    return minhash.kept_documents(docs, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit), and whether they decode back."""
    ids = bpe.encode_decode(docs, bpe.tokenizer_path(), bpe.default_pattern(), keep=100_000)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return ids.select("doc_id", "lang", "source", "n_tokens", "token_ids", whole.alias("round_trip"),
                      F.sha2("token_ids", 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("byte_bpe", encoded),
]

#: Fitted scores, similarity hashing and BPE merges are beyond SQL; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result is kept in the shared folder for the next stage."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
    return docs
