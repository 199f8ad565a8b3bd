"""Ranks, bands, quantiles, top rows.

Windows run only where the group is bounded (already aggregated tables); anything over facts uses
aggregation, a threshold, or the exact selection of ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from . import select
from .common import number, null_safe_join, percent, with_group_stats


def group_total_share(counts: DataFrame, group: Sequence[str], n: str = "n", digits: int = 2) -> DataFrame:
    """Total of each group and every row's share of it, over an aggregated count table."""
    total = F.sum(n).over(Window.partitionBy(*group))
    return counts.withColumn("total", total).withColumn("share", percent(n, "total", digits))


def running_total(histogram: DataFrame, group: Sequence[str], order: str, n: str = "n") -> DataFrame:
    """Cumulative count in order, group total, cumulative per cent (1 dp), over a histogram."""
    window = Window.partitionBy(*group)
    upto = window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        histogram.withColumn("cumulative", F.sum(n).over(upto))
        .withColumn("total", F.sum(n).over(window))
        .withColumn("per", percent("cumulative", "total", 1))
    )


def dense_rank_desc(value: str, group: Sequence[str] = ()) -> Column:
    """Dense rank from the highest; null values get no rank. For aggregated tables."""
    window = Window.partitionBy(*group).orderBy(F.desc_nulls_last(value))
    return F.when(F.col(value).isNotNull(), F.dense_rank().over(window))


def ntile_bands(df: DataFrame, groups: Sequence[str], order: str, tie: str, bands: int, name: str = "band") -> DataFrame:
    """Equal-count bands per group by ``order`` then ``tie`` (unique in a group); rows without a value get no band.

    Rows are neither sorted nor moved: each is compared with the edges of its group's bands, which come from refined
    histograms. ``df`` is read once a pass: hand in a scan or a stored table.
    """
    edges = stored(select.band_edges(df, groups, order, tie, bands).select(*groups, "edges"), "edges")
    marked = null_safe_join(df, edges, groups, "left")
    return marked.withColumn(name, select.band_of(order, tie).cast("int")).drop("edges")


def keep_group_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows equal to their group's maximum, ties kept."""
    best = with_group_stats(df, keys, F.max(value).alias("__best"))
    return best.filter(F.col(value) == F.col("__best")).drop("__best")


def first_n_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def group_quantiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, from the values at the ranks next to each; no task holds a group's values."""

    def place(q: float) -> Column:
        return (F.col("size") - 1) * F.lit(float(q))  # from 0 on, between two rows

    def both(size: Column) -> Column:
        return F.array(*[(f(place(q)) + 1).cast("long") for q in quantiles.values() for f in (F.floor, F.ceil)])

    rows = stored(df.filter(F.col(value).isNotNull()).select(*groups, value), "values")
    at = select.values_at_ranks(rows, groups, value, both)

    def value_at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank.cast("long"), F.col("value").cast("double")))

    out = {}
    for name, q in quantiles.items():
        low, high = F.floor(place(q)), F.ceil(place(q))
        a, b = value_at(low + 1), value_at(high + 1)
        part = F.max(place(q) - low)
        out[name] = F.when(a == b, a).otherwise(a * (1 - part) + b * part)
    return at.groupBy(*groups).agg(*[c.alias(name) for name, c in out.items()])


def iqr_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    """High and low flags at 1.5 interquartile ranges beyond the quartiles of each group."""
    quartiles = group_quantiles(df, [group], value, {"__q1": 0.25, "__q3": 0.75})
    spread = 1.5 * (F.col("__q3") - F.col("__q1"))
    return (
        null_safe_join(df, quartiles, [group], "left")
        .withColumn("outlier_high", F.col(value) > F.col("__q3") + spread)
        .withColumn("outlier_low", F.col(value) < F.col("__q1") - spread)
        .drop("__q1", "__q3")
    )


def key_multiplicity(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Every row with the number of rows that share its key."""
    return with_group_stats(df, keys, F.count("*").alias(name))


def keep_top(table: DataFrame, focus: str, k: int, n: str = "n") -> DataFrame:
    """Rows of the k subjects with the highest sum of ``n``; the focus takes the last place when it is not among them.

    For aggregated tables (a few rows per subject): the places come from windows over the table itself.
    """
    totals = table.withColumn("__taken", F.sum(n).over(Window.partitionBy("subject")))
    placed = totals.withColumn("__place", F.dense_rank().over(Window.orderBy(F.desc("__taken"), "subject")))
    focus_place = F.max(F.when(F.col("subject") == focus, F.col("__place"))).over(Window.partitionBy())
    place = F.col("__place")
    return (
        placed.withColumn("__focus", F.coalesce(focus_place, F.lit(0)))
        .filter((place < k) | (F.col("subject") == focus) | ((place == k) & (F.col("__focus") <= k)))
        .drop("__taken", "__place", "__focus")
    )


def mark_top(table: DataFrame, name: str, focus: str, k: int, n: str, always: Column) -> DataFrame:
    """Whether a row's subject is among the k highest in ``n``, as ``keep_top`` picks them; for one row a subject.

    Rows without any are never among them; rows that ``always`` holds for take no place and are marked if they have any.
    """
    has, counted = F.col(n) > 0, (F.col(n) > 0) & ~always
    placed = table.withColumn("__rank", F.when(counted, F.dense_rank().over(Window.orderBy(F.desc(counted), F.desc(n), "subject"))))
    focus_place = F.coalesce(F.max(F.when(F.col("subject") == focus, F.col("__rank"))).over(Window.partitionBy()), F.lit(0))
    place = F.col("__rank")
    top = (place < k) | (F.col("subject") == focus) | ((place == k) & (focus_place <= k))
    return placed.withColumn(name, (has & always) | (counted & top)).drop("__rank")


def top_subjects(facts: DataFrame, focus: str, k: int) -> DataFrame:
    """The k most taken subjects; the focus takes the last place when it is not among them."""
    return keep_top(facts.groupBy("subject").agg(F.count("*").alias("n")), focus, k)


def top_n_ties(df: DataFrame, n: int, weight: str, bottom: bool = False) -> DataFrame:
    """The n highest (or lowest) rows by weight, ties included: a distributed top-n gives the threshold."""
    order = F.asc(weight) if bottom else F.desc(weight)
    edge = df.filter(F.col(weight).isNotNull()).select(weight).orderBy(order).limit(n)
    threshold = edge.agg(F.max(weight) if bottom else F.min(weight)).scalar()
    return df.filter(F.col(weight) <= threshold if bottom else F.col(weight) >= threshold)


def top_rows_with_total(table: DataFrame, k: int, label: str, total: str, *order: Column) -> DataFrame:
    """First k rows in order, then the total row."""
    body = table.filter(F.col(label) != total).orderBy(*order).limit(k)
    return body.unionByName(table.filter(F.col(label) == total))


def zeros_last(table: DataFrame, value: str) -> DataFrame:
    """Non-zero and null rows first, zero rows last; the sort key stays as a column."""
    return table.withColumn("zero_last", F.coalesce((number(value) == 0).cast("int"), F.lit(0))).orderBy("zero_last")


def numeric_text_order(table: DataFrame, value: str) -> DataFrame:
    """Masked text sorted by its numeric value, masks last; the sort key stays as a column."""
    return table.withColumn("sort_value", number(value)).orderBy(F.desc_nulls_last("sort_value"))


def size_filtered_head(
    table: DataFrame, population: str, focus: str, size: int, rows: int, *order: Column, masked_population: int = 35
) -> DataFrame:
    """Rows with a large enough focus (or a Y mask in a large population); the first ``rows`` of them."""
    keep = (number(focus) >= size) | ((F.col(focus).cast("string") == "Y") & (number(population) > masked_population))
    return table.filter(keep).orderBy(*order).limit(rows)
