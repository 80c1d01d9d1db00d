"""A training corpus from ``documents``: quality, language, near-duplicates, mixing, tokens.

Each stage gets what the stage before it kept, from Parquet, and returns the columns of
``documents``; the last one returns token counts and digests. A stage learns and counts over
its own input only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltgate.llm import bpe, language_crf, minmax, quality_classifier, source_mix
from siltgate.llm.queries import BYTE_BPE
from siltgate.llm.text import bounded_batches
from siltgate.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be labelled 1."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model).where("predicted = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; text without letters, or with words that are not surely labelled, goes."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    model = language_crf.fit(docs, quality_classifier.held_out())
    found = language_crf.predict(docs, model)
    # below 0.4 most words fit no language; a text in several languages has sure words
    return found.where((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("certainty") >= 0.4)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    An id is one document: if its rows hold different texts, all of them stay or go together; of
    rows equal in id and text one stays. Rows without an id stay.
    """
    bounded_batches(spark)
    return minmax.survivors(docs.select(*COLUMNS), minmax.Settings(words=5, percent=80))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and pass over its source."""
    bounded_batches(spark)
    taken = source_mix.taken_texts(docs.select(*COLUMNS))
    return taken.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as digests and counts."""
    bounded_batches(spark)
    return bpe.encode_documents(docs, BYTE_BPE, keep=["doc_id", "source"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The classifier and the language model are learned; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written and read back as the next one's input."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
