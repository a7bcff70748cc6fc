"""From raw documents to packed training sequences, one stage after another.

Every stage takes the documents that the one before kept, whole, and all but the last return the columns of documents.
Each result is written as Parquet below the shared folder and read again, so a lost executor repeats one stage at most.
What a stage stores for itself is dropped at the end of `run`.

Cases, for all stages: rows with a null or empty text, or without a letter, go in the first stage. A null doc_id is an id
like any other to the learned stages; copies and near copies prefer rows that have an id; packing orders rows without id
last. Rows that repeat an id are judged by their texts, one by one. Equal scores and equal texts are told apart by doc_id.
Very long texts are read whole. Extra columns pass through, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, packing, quality, simhash
from tidemark.llm.common import col, remainder, table
from tidemark.session import scratch_path, scratch_run

SHORTEST_PIECE = 2.0  # texts whose pieces are shorter on average are in no learned language ...
USUAL = 0.6  # ... or, where pieces of the language are short, than this part of their usual length ...
SYMBOLS = 64  # ... if they have so many symbols
KEEP_QUALITY = 0.3


def _row(docs: DataFrame) -> list:
    return [F.struct(*[col(c) for c in docs.columns]).alias("document")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter and those that fit no learned language go."""
    model = langid.fit(docs.filter(remainder("doc_id", 3) != 1))
    found = langid.identify(docs, model, keep=_row(docs))
    shortest = F.least(F.lit(SHORTEST_PIECE), F.col("usual_piece") * USUAL)
    odd = (F.col("symbols") >= SYMBOLS) & (F.col("mean_piece") < shortest)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & ~odd).select("document.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, learned from the labelled ones among them."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.score(docs, net, keep=_row(docs)).filter(F.col("score") >= KEEP_QUALITY).select("document.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id: fingerprints of four-word shingles
    that differ in four bits at most."""
    return simhash.one_of_each(docs, distance=4)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("language", language),
    ("quality", good),
    ("exact_dedup", distinct_texts),
    ("simhash_dedup", no_near_copies),
    ("packing", packed),
]

ORACLE_SQL = None  # fingerprints and learned models have no SQL; tests/llm/test_pipeline.py compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    result = scratch_path(spark, "pipeline")
    with scratch_run(spark):
        for name, stage in STAGES:
            path = result if name == STAGES[-1][0] else scratch_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
