"""Joins: results to people, dimensions, earlier years; coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scales
from .common import blank_to_null, null_safe_join, one_value


def bind_results(pupils: DataFrame, results: DataFrame, subjects: DataFrame) -> DataFrame:
    """Pupils without their own provider, inner-joined to results, with subject names where known."""
    people = pupils.drop("provider", "year")
    return people.join(results, "pupil").join(subjects, "subject", "left")


def semi_filter(df: DataFrame, keep: DataFrame, *keys: str) -> DataFrame:
    return df.join(keep.select(*keys), list(keys), "left_semi")


def anti_filter(df: DataFrame, drop: DataFrame, *keys: str) -> DataFrame:
    return df.join(drop.select(*keys), list(keys), "left_anti")


def filled_only(df: DataFrame, column: str) -> Column:
    """The column in its own type, blank text as null."""
    return blank_to_null(F.col(column)) if df.schema[column].dataType.simpleString() == "string" else F.col(column)


def backfill_column(
    destination: DataFrame, source: DataFrame, column: str, new_name: str, key: str = "pupil"
) -> DataFrame:
    """Fill blanks of ``new_name`` from the source's ``column``; rows are never multiplied.

    A source without the column leaves the destination as it is; a destination without the new column gains it.
    """
    if column not in source.columns:
        return destination
    if new_name not in destination.columns:
        destination = destination.withColumn(new_name, F.lit(None).cast(source.schema[column].dataType))
    kind = destination.schema[new_name].dataType
    values = source.groupBy(key).agg(F.max(filled_only(source, column)).cast(kind).alias("__source"))
    filled = F.coalesce(filled_only(destination, new_name), F.col("__source"))
    return destination.join(values, key, "left").withColumn(new_name, filled).drop("__source")


def backfill_report(destination: DataFrame, source: DataFrame, column: str, new_name: str, key: str = "pupil") -> DataFrame:
    """Keys found on both sides and blanks the source can fill."""
    values = source.groupBy(key).agg(F.max(filled_only(source, column)).alias("__source"))
    blank = filled_only(destination, new_name).isNull()
    return (
        destination.select(key, new_name)
        .join(values, key)
        .agg(
            F.countDistinct(key).alias("matched_keys"),
            F.count(F.when(blank & F.col("__source").isNotNull(), 1)).alias("replacements"),
        )
    )


def backfill_across_years(
    destination: DataFrame, history: DataFrame, columns: dict[str, str], key: str = "pupil", year: str = "year",
    years: tuple[int, int] | None = None, before: tuple[int, int] | None = None,
) -> DataFrame:
    """Fill blanks from the newest non-blank value, for every column in one pass and in its own type.

    ``years``: first and last year of the history that may be used (None: all). ``before``: how many years before a row's
    own ``year`` the value must come from, least and most; a row without a year is not filled then. One aggregation of the
    stacked history (a key's distinct values by year) and one left join replace a join per column and year.
    """
    if years is not None:
        history = history.filter(F.col(year).between(*years))
    found = []
    for column in columns:
        value = filled_only(history, column)
        record = F.when(value.isNotNull(), F.struct(F.col(year), value.alias("v")))
        found.append((F.max(record) if before is None else F.array_sort(F.collect_set(record))).alias(f"__{column}"))
    out = destination.join(history.groupBy(key).agg(*found), key, "left")
    for column, new_name in columns.items():
        source = F.col(f"__{column}")
        if before is not None:
            own, (least, most) = F.col(year), before
            source = F.get(F.reverse(F.filter(source, lambda r: r[year].between(own - most, own - least))), F.lit(0))
        source = source["v"]
        if new_name in destination.columns:
            source = F.coalesce(filled_only(destination, new_name), source.cast(destination.schema[new_name].dataType))
        out = out.withColumn(new_name, source)
    return out.drop(*[f"__{c}" for c in columns])


def results_history(results: DataFrame, subjects: dict[str, str], level, key: str = "pupil") -> DataFrame:
    """Best points per (key, year) at one level, a column per listed subject: a history to back-fill from."""
    return (
        results.filter((F.col("level") == level) & F.col("subject").isin(list(subjects)))
        .groupBy(key, "year")
        .agg(*[F.max(F.when(F.col("subject") == s, F.col("points"))).alias(name) for s, name in subjects.items()])
    )


def best_over_years(ids: DataFrame, history: DataFrame, points: Column, new_name: str, key: str = "pupil") -> DataFrame:
    """Best grade of the listed ids over all years, old and new points brought to one scale."""
    normal = scales.letter_to_points(scales.points_to_letter(points, "GCSE"), "GCSE")
    return (
        semi_filter(history.filter(points.isNotNull()), ids, key)
        .groupBy(key)
        .agg(F.max(normal).alias(new_name))
    )


def area_mapping_conflicts(df: DataFrame, provider: str, area: str, other: str) -> DataFrame:
    """Providers in areas that fall into more than one area of the other scheme."""
    conflicted = df.groupBy(area).agg(F.countDistinct(other).alias("n_areas")).filter("n_areas > 1")
    return df.select(provider, area, other).distinct().join(conflicted, area)


def attach_region(
    providers: DataFrame, postcodes: DataFrame, postcode: str = "postcode", region: str = "region"
) -> DataFrame:
    """Provider -> postcode -> region and authority, with the region's code."""
    return providers.join(postcodes, postcode, "left").withColumn(
        "region_code", scales.lookup(F.col(region), scales.REGION_CODES)
    )


def filter_mappings(
    results: DataFrame, levels: DataFrame, subjects: DataFrame, names: Sequence[str] = tuple(scales.COMPUTING_SUBJECTS)
) -> DataFrame:
    """Distinct (level, subject) with their names, for subjects whose name is listed."""
    return (
        results.select("level", "subject")
        .distinct()
        .join(levels, "level", "left")
        .join(subjects, "subject", "left")
        .filter(F.col("subject_name").isin(list(names)))
    )


def coalesce_coordinates(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Fill each of two columns from the other where one is null."""
    for a, b in pairs:
        df = df.withColumns({a: F.coalesce(a, b), b: F.coalesce(b, a)})
    return df


def coverage_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either side without a partner, with the side that has them."""
    a = left.select(key).distinct()
    b = right.select(key).distinct()
    return (
        a.join(b, key, "left_anti").withColumn("present_in", F.lit("left"))
        .unionByName(b.join(a, key, "left_anti").withColumn("present_in", F.lit("right")))
    )


def paste_tables(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two tables of the same keys side by side, paired by key and never by position."""
    return null_safe_join(left, right, keys, "left")


def inside_box(points: DataFrame, region: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points strictly inside the extent of a region's vertices; the extent is a one-row subquery."""
    extent = one_value(
        region,
        F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("box"),
    )
    return (
        points.withColumn("__box", extent)
        .filter(
            (F.col(x) > F.col("__box.x0")) & (F.col(x) < F.col("__box.x1"))
            & (F.col(y) > F.col("__box.y0")) & (F.col(y) < F.col("__box.y1"))
        )
        .drop("__box")
    )
