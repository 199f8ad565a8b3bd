"""Representation of demographic groups in subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from . import rank, reshape
from .common import null_safe_join, percent

KEYS = ["ethnicity", "eth_minor", "gender", "flag"]
WHITE, WHITE_BRITISH_MINOR = "WHIT", "WBRI"
WHITE_BRITISH, WHITE_OTHER = "WHIBRI", "WHIOTH"


def representation_cube(facts: DataFrame, people: DataFrame, focus: str, k: int = 20) -> DataFrame:
    """Per top-k subject and demographic group (0 where empty): takers, subject totals, population, representation.

    "All" rows hold the population itself. Groups without gender or flag count in the totals but are left out.
    """
    attributes = people.select("pupil", "provider", *KEYS)
    # Counts of all subjects give the ranking too; both count tables are small and stored once.
    every = (
        facts.select("pupil", "provider", "subject").join(attributes, ["pupil", "provider"])
        .groupBy("subject", *KEYS).agg(F.count("*").alias("n"))
    )
    counts = cut_lineage(rank.keep_top(every, focus, k))
    full = reshape.complete_combinations(counts, ["subject", "gender", "flag"], ("ethnicity", "eth_minor"), "n")
    population = cut_lineage(people.groupBy(*KEYS).agg(F.count("*").alias("n")))
    cube = full.select("subject", *KEYS, "n").unionByName(population.withColumn("subject", F.lit("All")))
    cube = cube.withColumns({
        "subject_total": F.sum("n").over(Window.partitionBy("subject")),
        "gender_flag_total": F.sum("n").over(Window.partitionBy("subject", "gender", "flag")),
    })
    cube = null_safe_join(cube, population.withColumnRenamed("n", "population"), KEYS, "left")
    cube = cube.withColumn("representation", percent("n", "population", 2))
    return cube.filter(F.col("gender").isNotNull() & F.col("flag").isNotNull()).withColumn(
        "highlight", F.when(F.col("subject") == focus, F.col("representation")).otherwise(0.0)
    )


def representation_groups(
    cube: DataFrame, white: str = WHITE, british: str = WHITE_BRITISH_MINOR
) -> DataFrame:
    """The cube by major group, white split into British and other, with a total per (subject, gender, flag)."""
    is_white = F.col("ethnicity").eqNullSafe(white)
    group = (
        F.when(is_white & (F.col("eth_minor") == british), WHITE_BRITISH).when(is_white, WHITE_OTHER).otherwise(F.col("ethnicity"))
    )
    keys = ["subject", "gender", "flag"]
    cells = cube.withColumn("group", group).groupBy(*keys, "group").agg(
        F.sum("population").alias("population"), F.sum("n").alias("n")
    )
    columns = [F.col(c) for c in keys]
    table = cells.groupingSets([[*columns, F.col("group")], columns], *keys, "group").agg(
        F.grouping("group").alias("__total"), F.sum("population").alias("population"), F.sum("n").alias("n")
    )
    return table.select(
        *keys, F.when(F.col("__total") == 1, "Total").otherwise(F.col("group")).alias("group"), "population", "n"
    ).withColumn("representation", percent("n", "population", 2))


def representation_summary(groups: DataFrame, subject: str, gender: str, flag: int) -> DataFrame:
    """One subject, gender and flag."""
    return groups.filter(
        (F.col("subject") == subject) & (F.col("gender") == gender) & (F.col("flag") == flag)
    ).select("group", "population", "n", "representation")


def representation_two_subjects(groups: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Two subjects side by side for every group, gender and flag."""
    first, second = subjects
    cells = []
    for i, s in enumerate((first, second), 1):
        hit = F.col("subject") == s
        cells += [F.max(F.when(hit, F.col("n"))).alias(f"n_{i}"), F.max(F.when(hit, F.col("representation"))).alias(f"pc_{i}")]
    population = F.max(F.when(F.col("subject") == first, F.col("population"))).alias("population")
    return groups.filter(F.col("subject").isin(first, second)).groupBy("group", "gender", "flag").agg(population, *cells)
