"""Long <-> wide and stacked tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .common import null_safe_join


def spread_subjects(facts: DataFrame, subjects: Sequence[str], prefix: str = "X") -> DataFrame:
    """One row per (pupil, provider), one points column per listed subject."""
    columns = {s: prefix + "".join(ch for ch in s if ch.isdigit()) for s in subjects}
    return facts.groupBy("pupil", "provider").agg(
        *[F.max(F.when(F.col("subject") == s, F.col("points"))).alias(c) for s, c in columns.items()]
    )


def gather_subjects(wide: DataFrame, ids: Sequence[str] = ("pupil", "provider"), prefix: str = "X") -> DataFrame:
    """Wide points columns back to rows; nulls are dropped."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot(list(ids), columns, "subject", "points").filter(F.col("points").isNotNull())


def build_spread(
    pupils: DataFrame, facts: DataFrame, providers: DataFrame, postcodes: DataFrame, subjects: Sequence[str],
    pupil_columns: Sequence[str], provider_columns: Sequence[str],
) -> DataFrame:
    """Wide results of known pupils with pupil, provider and area columns."""
    wide = spread_subjects(facts.join(pupils.select("pupil"), "pupil", "left_semi"), subjects)
    places = providers.select("provider", *provider_columns).join(postcodes, "postcode", "left")
    return wide.join(pupils.select("pupil", *pupil_columns), "pupil", "left").join(places, "provider", "left")


def pivot_composite(
    df: DataFrame, ids: Sequence[str], first: str, second: str, headers: Sequence[str], fill: int = 0
) -> DataFrame:
    """Counts with one column per ``first_second`` header, absent cells filled.

    The counts are dealt by the ids before they become wide, so that no task holds a wide row of every id.
    """
    counts = df.groupBy(*ids, F.concat_ws("_", first, second).alias("__header")).agg(F.count("*").alias("__n"))
    return counts.repartition(*ids).groupBy(*ids).pivot("__header", list(headers)).agg(F.first("__n")).na.fill(fill, list(headers))


def complete_combinations(counts: DataFrame, axes: Sequence[str], pair: tuple[str, str], n: str) -> DataFrame:
    """Every (axis values x valid pair) combination, a missing count as 0.

    The axes hold coded categories; their value sets are gathered by one aggregation of the counts.
    """
    sets = counts.agg(
        *[F.collect_set(F.struct(a)).alias(a) for a in axes],
        F.collect_set(F.struct(*pair)).alias("__pair"),
    )
    for a in axes:
        sets = sets.withColumn(a, F.explode(a)).withColumn(a, F.col(f"{a}.{a}"))
    grid = sets.withColumn("__pair", F.explode("__pair")).select(*axes, *[F.col(f"__pair.{p}").alias(p) for p in pair])
    return null_safe_join(grid, counts, [*axes, *pair], "left").withColumn(n, F.coalesce(n, F.lit(0)))


def stack_years(
    table: DataFrame, label: str, measure: str, items: Sequence[str], years: Sequence[int], subject_name: str
) -> DataFrame:
    """The measure of chosen items (any case) in chosen years, as rows."""
    return table.filter(
        F.lower(label).isin([i.lower() for i in items]) & F.col("year").isin(list(years))
    ).select(label, measure, "year", F.lit(subject_name).alias("subject_name"))


def measures_to_rows(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str = "type", value: str = "percentage") -> DataFrame:
    typed = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    return typed.unpivot(list(ids), list(measures), name, value)
