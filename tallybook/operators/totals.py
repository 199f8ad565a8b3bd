"""Totals rows: sums of counts, ratios recomputed from the sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import percent


def total_row(
    table: DataFrame, labels: Sequence[str], sums: Sequence[str], total: str = "Totals", blank: str = "",
    groups: Sequence[str] = (),
) -> DataFrame:
    """The table and its total in one pass (grouping sets), ``is_total`` telling a null label from the total.

    The first label of the total row reads ``total``, further labels ``blank``. With ``groups`` there is one total each.
    """
    keys = [F.col(c) for c in groups]
    grouped = table.groupingSets([[*keys, *[F.col(c) for c in labels]], keys], *groups, *labels).agg(
        F.grouping(labels[0]).cast("boolean").alias("is_total"), *[F.sum(c).alias(f"__{c}") for c in sums]
    )
    names = [
        F.when(F.col("is_total"), total if i == 0 else blank).otherwise(F.col(c)).alias(c) for i, c in enumerate(labels)
    ]
    return grouped.select(*groups, *names, "is_total", *[F.col(f"__{c}").alias(c) for c in sums])


def triple_percent(part: str, whole: str, digits: int = 1) -> Column:
    """Per cent of a (whole, part) pair of totals: 0 when either is 0."""
    return F.when((F.col(whole) == 0) | (F.col(part) == 0), F.lit(0.0)).otherwise(percent(part, whole, digits))


def triple_totals(
    table: DataFrame, labels: Sequence[str], triples: Sequence[tuple[str, str, str]], extra_sums: Sequence[str] = (),
    total: str = "TOTAL",
) -> DataFrame:
    """One total row for (whole, part, per cent) triples."""
    sums = [*extra_sums, *[c for whole, part, _ in triples for c in (whole, part)]]
    out = table.agg(*[F.sum(c).alias(c) for c in sums])
    out = out.select(
        *[F.lit(total if i == 0 else "").alias(c) for i, c in enumerate(labels)],
        *sums,
        *[triple_percent(part, whole).alias(per) for whole, part, per in triples],
    )
    return out.select(*[c for c in table.columns if c in out.columns])
