"""The corpus pipeline: documents to token ids, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)). A stage gets all rows that the one
before it kept, in the columns of documents; only the last one returns others (token ids
in place of the text). `run` writes each stage's rows as Parquet in the shared folder and
reads them again.

Defined results, for every stage: null and empty texts go in the first one (too few words); a later stage that meets one
keeps it as it is, but for the mix, which takes no row of it; a null doc_id is carried, and never joins a group of near
duplicates by its id; repeated rows are judged alike, and one stays of them; an empty table gives an empty result; other columns, whatever their names, are carried.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, common, fertility, mixing, secrets, setsketch

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a null language is judged by its script."""
    return fertility.filtered(docs, PIECES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id; rows with neither id nor copy stay."""
    return setsketch.deduplicated(docs, SHINGLE_WORDS, NEAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, a null text stays null; n_chars follows; all documents stay."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix, cut into the pieces of its documents: a row has the words that one slot
    takes of one document; n_chars follows. Documents without words, null or empty, have none."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids of every document of the mix."""
    return bpe.encoded(docs, BYTE_BPE, public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix), ("byte_bpe", encode)]

#: No SQL for the tokeniser's merges, the sketches or the draws; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
