"""Drawing a bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: a third of the ids, by checksum; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct ids of a label table, those with the lowest hashes: small enough to broadcast."""
    ids = labels.select("doc_id").filter("doc_id is not null").distinct()
    return F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def draw(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, label, doc_id) of at most ``per_class`` documents of each class 0 and 1, and the weight of a row of each class.

    Rows with a null id or label, or held out, are left out; the sample takes the lowest id hashes, so that it is the
    same in every run. Weights restore the share of the classes among all labelled rows.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("__label"))
    totals = {r["__label"]: r["n"] for r in usable.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [usable.filter(F.col("__label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    weights = {c: max(1.0, n / per_class) for c, n in totals.items()}
    return rows.select("text", F.col("__label").alias("label"), "doc_id"), weights
