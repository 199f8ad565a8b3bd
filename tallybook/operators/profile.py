"""The shared intermediate grains: one row per (pupil, provider), one row per provider.

The long fact is unique on (pupil, provider, subject), so a window over (pupil, provider) never holds
more rows than there are subjects; every other grain is reached by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import ratio

ENTRY = ["pupil", "provider"]


def entries(facts: DataFrame, focus: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (pupil, provider): subject count, point sum, and the focus subject's points (null = not sat).

    ``by`` (stage, year) keeps entries of several stages and years apart.
    """
    return facts.groupBy(*by, *ENTRY).agg(
        F.count("*").alias("n_subjects"),
        F.sum("points").alias("sum_points"),
        F.avg("points").alias("mean_points"),
        F.max(F.when(F.col("subject") == focus, F.col("points"))).alias("focus_points"),
    )


def cohort(
    facts: DataFrame, pupils: DataFrame, providers: DataFrame, focus: str, by: Sequence[str] = ()
) -> DataFrame:
    """Entries with pupil and provider attributes; pupils without results are not part of the population."""
    return (
        entries(facts, focus, by)
        .join(pupils.drop("year"), "pupil", "left")
        .join(providers, "provider", "left")
    )


def with_other_mean(facts: DataFrame) -> DataFrame:
    """Each fact with the mean points of the same entry's other subjects (null when there is none)."""
    entry = Window.partitionBy(*ENTRY)
    n, total = F.count("*").over(entry), F.sum("points").over(entry)
    return (
        facts.withColumn("n_subjects", n)
        .withColumn("sum_points", total)
        .withColumn("other_mean", ratio(F.col("sum_points") - F.col("points"), F.col("n_subjects") - 1, None))
        .drop("n_subjects", "sum_points")
    )


def with_focus_points(facts: DataFrame, focus: str, name: str = "focus_points") -> DataFrame:
    """Each fact with the focus subject's points of the same entry."""
    return facts.withColumn(
        name,
        F.max(F.when(F.col("subject") == focus, F.col("points"))).over(Window.partitionBy(*ENTRY)),
    )


def provider_subjects(facts: DataFrame) -> DataFrame:
    """Takers per (provider, subject)."""
    return facts.groupBy("provider", "subject").agg(F.count("*").alias("takers"))


def provider_sizes(facts: DataFrame) -> DataFrame:
    """Entries per provider, counted in two partially aggregated steps."""
    return (
        facts.groupBy(*ENTRY).agg(F.lit(1).alias("one")).groupBy("provider").agg(F.count("*").alias("students"))
    )
