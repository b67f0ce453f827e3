"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; between stages the
rows are a Parquet table in the shared folder. All but the last return the columns of documents.
SQL cannot express MinHash linking or the tokenizer, so there is no ORACLE_SQL; tests/llm compares the
stages with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import dedup, mixing, packing, pii, quality
from lectern.llm.common import written

ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go. A null or empty text has too few words and goes; repeated rows are judged alike."""
    return quality.documents_kept(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest id: five-word shingles, similarity 0.8 or more. Of rows with one id one stays;
    null and empty texts are linked with nothing and stay, as do rows without an id."""
    return dedup.one_of_each(docs, dedup.Near(shingle=5, percent=80)).select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. Null and empty texts stay as they are; repeated rows are masked each."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for. Rows without a source form the source ''; texts without tokens come with
    every whole pass; ties of the permutation's hash go by id and text, identical rows together."""
    return mixing.mix(docs, mixing.Mix()).select("row.*").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens. A null or empty text is the end id alone; repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, packing.Packing(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
