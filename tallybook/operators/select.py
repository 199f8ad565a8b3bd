"""Exact values at given ranks of groups of any size, by histograms that are refined range by range.

No task sorts or holds a group: a pass counts the rows of each range in a fixed number of bins, and only the bins that
hold a wanted rank are looked into by the next one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .common import null_safe_join

BINS = 1024
SMALL = 100_000


def values_at_ranks(
    df: DataFrame, groups: Sequence[str], value: str, ranks: Callable[[Column], Column], bins: int = BINS, small: int = SMALL
) -> DataFrame:
    """(groups, size, rank, value, below, equal) for each wanted rank of each group.

    ``ranks`` makes an array of wanted ranks, from 1 on, out of a group's size; a rank outside the group is left out. ``below``
    and ``equal`` count the group's rows with a smaller and with the same value. Null values are not ranked; values are
    finite numbers. ``df`` is read once a pass, so hand in a scan or a stored table: two passes, and for evenly spread values
    one more for every factor of ``bins`` by which a range with a wanted rank exceeds ``small`` rows.
    """
    known = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_at_v"))
    whole = known.groupBy(*groups).agg(F.min("_at_v").alias("_at_lo"), F.max("_at_v").alias("_at_hi"), F.count("*").alias("size"))
    wanted = whole.select(*groups, "size", F.explode(F.array_distinct(ranks(F.col("size")))).alias("rank"), "_at_lo", "_at_hi", F.col("size").alias("_at_in"), F.lit(0).cast("long").alias("_at_before"))
    targets = stored(wanted.filter(F.col("rank").between(1, F.col("size"))), "targets")
    ready, limits = None, ["_at_lo", "_at_hi"]
    for number in itertools.count():
        wide = (F.col("_at_lo") < F.col("_at_hi")) & (F.col("_at_in") > small)
        narrow = targets.filter(~wide)
        ready = narrow if ready is None else ready.unionByName(narrow)
        targets = targets.filter(wide)
        if targets.isEmpty():
            break
        inside = _inside(known, targets, groups)
        # halves, so that the width of a range is a finite number; the bin never falls as the value grows
        over, width = ((F.col(c) / 2 - F.col("_at_lo") / 2).cast("double") for c in ("_at_v", "_at_hi"))
        share = over / width
        if number % 2:  # every other pass takes logarithms, since equal steps hardly cut a range with a long tail
            share = F.when(width > 1, F.log1p(over) / F.log1p(width)).otherwise(share)
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1))
        counts = inside.groupBy(*groups, *limits, bin_.alias("_at_bin")).agg(F.min("_at_v").alias("_at_min"), F.max("_at_v").alias("_at_max"), F.count("*").alias("_at_n"))
        before = F.coalesce(F.sum("_at_n").over(Window.partitionBy(*groups, *limits).orderBy("_at_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_at_passed", before)
        met = null_safe_join(targets, counts, [*groups, *limits], "inner")
        offset = F.col("_at_before") + F.col("_at_passed")
        met = met.filter((F.col("rank") > offset) & (F.col("rank") <= offset + F.col("_at_n")))
        targets = stored(met.select(*groups, "size", "rank", F.col("_at_min").alias("_at_lo"), F.col("_at_max").alias("_at_hi"), F.col("_at_n").alias("_at_in"), offset.alias("_at_before")), "targets")
    one = ready.filter(F.col("_at_lo") == F.col("_at_hi")).select(*groups, "size", "rank", F.col("_at_lo").alias("value"), F.col("_at_before").alias("below"), F.col("_at_in").alias("equal"))
    several = ready.filter(F.col("_at_lo") < F.col("_at_hi"))
    counts = _inside(known, several, groups).groupBy(*groups, *limits, "_at_v").agg(F.count("*").alias("_at_n"))
    before = F.coalesce(F.sum("_at_n").over(Window.partitionBy(*groups, *limits).orderBy("_at_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = null_safe_join(several, counts.withColumn("_at_passed", before), [*groups, *limits], "inner")
    offset = F.col("_at_before") + F.col("_at_passed")
    met = met.filter((F.col("rank") > offset) & (F.col("rank") <= offset + F.col("_at_n")))
    return one.unionByName(met.select(*groups, "size", "rank", F.col("_at_v").alias("value"), offset.alias("below"), F.col("_at_n").alias("equal")))


def _inside(known: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows of the ranges that are looked into; the ranges of a group do not overlap."""
    ranges = targets.select(*groups, "_at_lo", "_at_hi").distinct()
    return null_safe_join(known, ranges, groups, "inner").filter(F.col("_at_v").between(F.col("_at_lo"), F.col("_at_hi")))


def band_edges(df: DataFrame, groups: Sequence[str], order: str, tie: str, bands: int, **limits: int) -> DataFrame:
    """(groups, size, edges): the last row (value, tie) of every band but the last, when a group is cut into equal counts by
    ``order`` and then ``tie``, the first bands larger by one row.

    The tie-break is looked at only for values whose rows fall on both sides of an edge; elsewhere ``tie`` is null.
    """

    def last_ranks(size: Column) -> Column:
        small, wide = F.floor(size / bands), size % bands
        return F.transform(F.sequence(F.lit(1), F.lit(bands - 1)), lambda k: (k * small + F.least(k, wide)).cast("long"))

    at = stored(values_at_ranks(df, groups, order, last_ranks, **limits), "edges").withColumn("_at_place", F.col("rank") - F.col("below"))
    cut = F.col("_at_place") < F.col("equal")
    largest = at.filter(cut).agg(F.max("equal")).first()[0]
    if largest is None:
        marked = at.withColumn("_at_tie", F.lit(None).cast(df.schema[tie].dataType))
    else:  # fewer than ``bands`` places in each cut value
        places = at.filter(cut).groupBy(*groups, F.col("value").alias(order)).agg(F.collect_list("_at_place").alias("_at_places"))
        keys = [*groups, order]
        tied = null_safe_join(df.select(*groups, order, tie), places, keys, "inner")
        if largest <= limits.get("small", SMALL):
            tied = tied.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(tie)))
            found = tied.filter(F.array_contains("_at_places", F.col("rank").cast("long"))).withColumnRenamed(tie, "_at_tie")
        else:
            keys = [*keys, "_at_places"]
            found = values_at_ranks(stored(tied, "tied"), keys, tie, lambda _: F.col("_at_places"), **limits).withColumnRenamed("value", "_at_tie")
        found = found.select(*groups, F.col(order).alias("value"), F.col("rank").cast("long").alias("_at_place"), "_at_tie")
        marked = null_safe_join(at, found, [*groups, "value", "_at_place"], "left")
    edge = F.struct("rank", F.col("value"), F.col("_at_tie").alias("tie"))
    return marked.groupBy(*groups, "size").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def band_of(order: str, tie: str, edges: str = "edges") -> Column:
    """Band of a row, from 1 on: one more than the number of edges it lies beyond; null without a value."""
    v, t = F.col(order), F.col(tie)

    def beyond(e: Column) -> Column:
        return (v > e["value"]) | ((v == e["value"]) & F.coalesce(t > e["tie"], F.lit(False)))

    passed = F.coalesce(F.size(F.filter(edges, beyond)), F.lit(0))  # a group smaller than two bands may have no edge
    return F.when(v.isNotNull(), F.when(F.col(edges).isNull(), 1).otherwise(passed + 1))
