"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybook.llm import line_crf, lsh_forest, mixing, phrases, placement
from tallybook.llm.common import stored, table, text_key
from tallybook.llm.queries import SHARDS, TARGETS, domain_labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose lines are likelier bad than good.

    A null text counts as empty; an empty one has the score of a document without lines. A score depends on the text alone,
    so repeated rows stay or go together; 0.5 itself stays. Long texts are scored whole. Without labelled rows in ``docs``
    nothing is learned and all stay. Empty tables give empty results. Columns of any name pass through unchanged.
    """
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", line_crf.quality(model, F.col("text"))).filter("__score >= 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies: the one with the least id (null first), then text digest.

    Of equal rows one stays. Null and empty texts, and texts without words, are near copies of nothing but equal rows. Long
    texts are compared whole. Empty tables give empty results. Columns of any name pass through unchanged.
    """
    return lsh_forest.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more are words of benchmark phrases.

    Null and empty texts have no words and stay; a null id makes no difference. Repeated texts go together, so one index
    entry of a text decides for all. Items without words are found nowhere, so an empty benchmark drops nothing. Long texts
    are searched whole. Empty tables give empty results. Columns of any name pass through unchanged.
    """
    found = phrases.search(docs, table(spark, sf_dir, "benchmark"))
    bad = stored(phrases.summarise(*found).filter("contaminated").select(F.col("key").alias("__key")).distinct(), "contaminated")
    return docs.join(bad, text_key() == F.col("__key"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that languages have their target shares of all words.

    Null and empty texts have no words and the rate of the prior. Rows with equal id and text are drawn together; a null
    id is drawn by the text alone. Labelled rows without a language, or of another one than the targets, are not learned
    from; without any, all languages are equally likely. Empty tables give empty results. Columns of any name pass through.
    """
    return mixing.resample(docs, domain_labels(docs, table(spark, sf_dir, "labels")), TARGETS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Name each document's slot and shard; columns of these two names are replaced, all others pass through.

    The id decides, and where it is null the text (null as empty), so repeated rows share a shard. Every row stays.
    """
    return placement.place(docs, placement.document_key(), SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the mix; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
