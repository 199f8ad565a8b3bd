"""Years side by side, and the league table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scales
from . import rank, reshape, uptake
from .common import fixed, number, percent


def reach_trend(facts: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Provider reach, pupil reach and actual uptake per subject and year, as rows."""
    table = uptake.subject_access_all(facts, ["year"]).filter(F.col("subject").isin(list(subjects)))
    return reshape.measures_to_rows(table, ["year", "subject"], ["pc_providers", "pc_with_access", "pc_of_offered"])


def demographic_trend(facts: DataFrame, people: DataFrame, subjects: Sequence[str], category: str) -> DataFrame:
    """Shares of a category's levels per year for the comparison subjects and for all pupils."""
    known = people.select("pupil", "provider", category).filter(F.col(category).isNotNull())
    rows = facts.filter(F.col("subject").isin(list(subjects))).select("pupil", "provider", "year", "subject")
    counts = rows.join(known, ["pupil", "provider"]).groupBy("year", "subject", category).agg(F.count("*").alias("n"))
    years = facts.groupBy("pupil", "provider", "year").agg(F.lit(1).alias("__one")).drop("__one")
    everyone = (
        years.join(known, ["pupil", "provider"]).groupBy("year", category).agg(F.count("*").alias("n"))
        .withColumn("subject", F.lit("All"))
    )
    return rank.group_total_share(counts.unionByName(everyone), ["year", "subject"], digits=1).select(
        "year", "subject", category, "n", F.col("share").alias("percentage")
    )


def numeric_trend(facts: DataFrame, people: DataFrame, subjects: Sequence[str], what: str, factor: float = 1.0) -> DataFrame:
    """Mean of a numeric attribute per year for the comparison subjects and for all pupils."""
    known = people.select("pupil", "provider", what).filter(F.col(what).isNotNull())
    rows = facts.filter(F.col("subject").isin(list(subjects))).select("pupil", "provider", "year", "subject")
    years = facts.groupBy("pupil", "provider", "year").agg(F.lit("All").alias("subject"))
    both = rows.unionByName(years).join(known, ["pupil", "provider"])
    return both.groupBy("year", "subject").agg(
        F.count("*").alias("n"), F.round(F.avg(what) * factor, 4).alias("percentage")
    )


def any_need_trend(shares: DataFrame, category: str, none: str = "N") -> DataFrame:
    """100 less the largest level's share per year and subject, read at the level that means no need."""
    largest = F.max("percentage").over(Window.partitionBy("year", "subject"))
    return (
        shares.withColumn("__largest", largest).filter(F.col(category) == none)
        .select("year", "subject", F.round(100 - F.col("__largest"), 1).alias("percentage"))
    )


def share_vs_population_trend(facts: DataFrame, people: DataFrame, subjects: Sequence[str], category: str) -> DataFrame:
    """Per year, subject and category: takers as a share of the category's population."""
    known = people.select("pupil", "provider", category).filter(F.col(category).isNotNull())
    years = facts.groupBy("pupil", "provider", "year").agg(F.lit(1).alias("__one")).drop("__one")
    population = years.join(known, ["pupil", "provider"]).groupBy("year", category).agg(F.count("*").alias("total"))
    takers = (
        facts.filter(F.col("subject").isin(list(subjects))).join(known, ["pupil", "provider"])
        .groupBy("year", "subject", category).agg(F.count("*").alias("sub_total"))
    )
    return takers.join(population, ["year", category]).withColumn("percentage", percent("sub_total", "total", 4))


def yearly_series(table: DataFrame, subjects: dict[str, str], attribute: str, value) -> DataFrame:
    """Rows of chosen subjects at one attribute value, subjects relabelled."""
    label = scales.lookup(F.col("subject"), subjects, F.col("subject"))
    return table.filter(F.col("subject").isin(list(subjects)) & (F.col(attribute) == value)).select(
        label.alias("series"), "year", "n", "percentage"
    )


def league_table(provision: DataFrame, codes: DataFrame, name: str = "authority", total: str = "Totals") -> DataFrame:
    """Areas with their dense ranks (masked values unranked), each rank's maximum, and the area code.

    ``provision`` is the published table with the sums ``females`` and ``sub_females``. The totals row takes part in the
    ranking, but for the female share, and is dropped at the end. One row an area, so all windows share one small task.
    """
    known = (F.col("females") > 0) & (F.col(name) != total)
    table = provision.withColumns({
        "result": scales.average_to_band(number("grade_avg_subject")),
        "female_n": F.when(known, F.col("sub_females")),
        "female_per": F.when(known, fixed(percent("sub_females", "females"), 1)),
    })
    ranks = {
        "result": number("grade_avg_subject"), "provider": F.col("pc_schools").cast("double"),
        "student": number("pc_students"), "cohort": number("average_cohort"), "female": number("female_per"),
    }
    table = table.withColumns({f"__{k}": value for k, value in ranks.items()})
    table = table.withColumns({f"{k}_rank": rank.dense_rank_desc(f"__{k}") for k in ranks})
    table = table.withColumns({f"{k}_rank_max": F.max(f"{k}_rank").over(Window.partitionBy()) for k in ranks})
    keep = [
        name, "schools", "students", "sub_schools", "pc_schools", "sub_students", "pc_students", "average_cohort", "result",
        *[f"{k}_rank{s}" for k in ranks for s in ("", "_max")], "female_n", "female_per",
    ]
    return table.filter(F.col(name) != total).select(*keep).join(codes, name, "left")
