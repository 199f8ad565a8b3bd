"""Exact nearest distance from points to a reference point set, without comparing all pairs.

The reference set is cut into cells, each with its tight bounding box: a cell that holds many points is divided at
quantiles, again and again, so cells are small everywhere and lie deeper where points are dense. Every
point starts with the whole and descends level by level: its candidate cells are replaced by their
occupied children (at most 16), the smallest upper bound over the candidates is kept, and cells whose
lower bound exceeds it are dropped. A point so carries a handful of cells whatever the density; only
the reference points of the last surviving cells are measured. Every level is an equi-join on the cell.
Points are dealt once: boxes and reference points go to every task, behind a count of them, so a descent shuffles
nothing; only of more of them do candidates move to the cells and back, a few a point and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import dealt, null_safe_join, tasks_for, with_group_stats

SPLIT = 4  # strips of a divided cell, and bins of a strip
LEAF = 64  # reference points that a cell may hold undivided
MOST_SENT = 20_000  # cells whose cut points (under 500 bytes a cell) go to every task; of more they are joined by shuffle
MOST_BOXES = 300_000  # boxes, or reference points (about 100 bytes each), that go to every task; of more, candidates are shuffled
PLACES_A_TASK = 25_000  # a place has tens of candidates at a level


def with_cuts_below(df: DataFrame, value: str, name: str, buckets: int) -> DataFrame:
    """Number of the (sorted, distinct) cut points below a value, by halving: compiled comparisons, no lambda."""
    df = df.withColumn(name, F.lit(0))
    step = 1 << (buckets - 1).bit_length() - 1
    while step:
        passed = F.coalesce(F.get("__cuts", F.col(name) + (step - 1)) < F.col(value), F.lit(False))
        df = df.withColumn(name, F.col(name) + F.when(passed, step).otherwise(0))
        step //= 2
    return df


def _box_gap(value: Column, low: str, high: str) -> Column:
    return F.greatest(F.col(low) - value, value - F.col(high), F.lit(0.0))


def _box_reach(value: Column, low: str, high: str) -> Column:
    return F.greatest(F.abs(value - F.col(low)), F.abs(F.col(high) - value))


def split_cells(refs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Distinct points (rx, ry) with their ``cell``: a text of one sign for every division.

    Every round divides the cells that hold more than ``leaf`` points, into strips by x and each strip into bins by y, at
    approximate quantiles of the points at hand. So the depth follows the points, without a limit, and differs from place
    to place. Equal coordinates on one axis leave the other to divide by, hence every round makes cells smaller.
    """
    steps = [i / SPLIT for i in range(1, SPLIT)]

    def divided(df: DataFrame, value: str, keys: list[str], name: str, few: bool) -> DataFrame:
        cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, steps, 1000)).alias("__cuts"))
        return with_cuts_below(null_safe_join(df, F.broadcast(cuts) if few else cuts, keys, "inner"), value, name, SPLIT).drop("__cuts")

    done, large, cells = None, refs.withColumn("cell", F.lit("")), 1
    while cells:
        few = cells <= MOST_SENT
        parts = divided(divided(large, "rx", ["cell"], "ix", few), "ry", ["cell", "ix"], "iy", few)
        child = F.concat("cell", F.hex(F.col("ix") * SPLIT + F.col("iy")))
        counted = cut_lineage(with_group_stats(parts.select("rx", "ry", child.alias("cell")), ["cell"], F.count("*").alias("n")))
        small = counted.filter(F.col("n") <= leaf).drop("n")
        done = small if done is None else done.unionByName(small)
        large = counted.filter(F.col("n") > leaf).drop("n")
        cells = large.select("cell").distinct().count()
    return done


def nearest_distance(
    points: DataFrame, reference: DataFrame, cutoff: float | None = None, leaf: int = LEAF, x: str = "x", y: str = "y"
) -> DataFrame:
    """Points with ``distance`` to the nearest reference point, and ``near`` (distance <= cutoff) if asked for.

    The result is exact for any ``leaf``, the most reference points of a cell; points and vertices without coordinates take
    no part.
    """
    id_cols = points.columns
    refs = split_cells(cut_lineage(reference.select(F.col(x).alias("rx"), F.col(y).alias("ry")).dropna().distinct()), leaf)

    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    leaves = cut_lineage(refs.groupBy("cell").agg(
        F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"),
        F.count("*").alias("n"),
    ))
    levels, boxes, vertices = leaves.agg(
        F.coalesce(F.max(F.length("cell")), F.lit(1)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))
    ).first()

    def sent(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= MOST_BOXES else df

    # One row per distinct location keeps a hot location from being searched more than once.
    places = points.select(F.col(x).alias("px"), F.col(y).alias("py")).dropna().distinct()
    tasks = tasks_for(points.sparkSession, points.count(), PLACES_A_TASK)
    # Dealt by a whole number: groups by it and the place need no other shuffle, which groups by fractions would get.
    place = ["deal", "px", "py"]
    found = dealt(places.withColumn("deal", F.xxhash64("px", "py")), tasks, "deal").withColumn("best", F.lit(float("inf")))

    for level in range(1, levels + 1):
        # A cell that is not divided any further is its own child.
        children = (
            leaves.select(F.substring("cell", 1, level - 1).alias("parent"), F.substring("cell", 1, level).alias("child"), "x0", "x1", "y0", "y1")
            .groupBy("parent", "child")
            .agg(*box)
        )
        if level == 1:  # the children of the whole are one value, not a join
            first = children.agg(F.collect_list(F.struct("child", "x0", "x1", "y0", "y1"))).scalar()
            candidates = found.withColumn("__first", first).select(*place, "best", F.inline("__first"))
        else:
            candidates = found.join(sent(children, boxes), "parent")
        px, py = F.col("px"), F.col("py")
        low = F.pow(_box_gap(px, "x0", "x1"), 2) + F.pow(_box_gap(py, "y0", "y1"), 2)
        high = F.pow(_box_reach(px, "x0", "x1"), 2) + F.pow(_box_reach(py, "y0", "y1"), 2)
        # The bound of the level above drops most children before they are compared. A hair of slack keeps rounding
        # of the bounds from dropping the true nearest cell.
        bounded = candidates.select(
            *place, "best", "child", low.alias("low"), (high * (1 + 1e-9)).alias("high")
        ).filter("low <= best")
        # A place's candidates are few; the smallest upper bound decides which of them stay.
        smallest = F.min("high").over(Window.partitionBy(*place))
        found = (
            bounded.withColumn("best", F.least("best", smallest)).filter("low <= best")
            .select(*place, F.col("child").alias("parent"), "best")
        )

    distance = F.sqrt(F.pow(F.col("rx") - F.col("px"), 2) + F.pow(F.col("ry") - F.col("py"), 2))
    nearest = (
        found.join(sent(refs, vertices), F.col("parent") == F.col("cell"))
        .groupBy(*place)
        .agg(F.min(distance).alias("distance"))
    )
    out = points.join(nearest, (points[x] == nearest["px"]) & (points[y] == nearest["py"]), "left").select(*id_cols, "distance")
    return out if cutoff is None else out.withColumn("near", F.col("distance") <= cutoff)

