"""Counts of qualifications and the pupils they reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import disclose
from .common import count_if, number, null_safe_join, percent

LABELS = ["course", "year", "qualification", "name", "level", "type"]


def qualification_counts(results: DataFrame, female: str = "F", male: str = "M", labels: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """Results per qualification with gender counts, small counts masked, and totals per course and year.

    Counts of 5 or fewer become X, others are rounded to 5; the totals come from the unmasked counts.
    """
    counts = results.groupBy(*labels).agg(
        F.count("*").alias("n"), count_if(F.col("gender") == female).alias("f"), count_if(F.col("gender") == male).alias("m")
    )
    masked = counts.withColumns({c: disclose.mask_le_five(F.col(c)) for c in ("n", "f", "m")})
    shown = number("f") + number("m")
    masked = masked.withColumns({
        "f_per": F.when(F.col("f") == "X", "X").otherwise(F.format_string("%.1f", percent(number("f"), shown))),
        "m_per": F.when(F.col("m") == "X", "X").otherwise(F.format_string("%.1f", percent(number("m"), shown))),
    })
    for c in ("f_per", "m_per"):
        masked = masked.withColumn(c, F.when((F.col(c) == "X") | shown.isNotNull(), F.col(c)))
    whole = counts.groupBy("course", "year").agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    both = F.col("f") + F.col("m")
    total = whole.select(
        "course", "year", F.lit("Totals").alias("name"), both.cast("string").alias("n"),
        F.col("f").cast("string").alias("f"), F.col("m").cast("string").alias("m"),
        F.format_string("%.1f", percent("f", both)).alias("f_per"), F.format_string("%.1f", percent("m", both)).alias("m_per"),
    )
    return masked.unionByName(total, allowMissingColumns=True)


def any_qualification_reach(results: DataFrame, keys: Sequence[str], listed: str) -> DataFrame:
    """Distinct pupils in all, per gender, and with any listed qualification, per course and year."""
    per_pupil = results.groupBy(*keys, "gender", "pupil").agg(F.max(listed).alias("__any"))
    genders = per_pupil.groupBy(*keys, "gender").agg(
        F.count("*").alias("total_gender"), count_if(F.col("__any")).alias("total_listed")
    ).filter("total_listed > 0")
    whole = per_pupil.groupBy(*keys, "pupil").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("total"))
    return null_safe_join(genders, whole, keys, "inner")


def qualification_reach_by_area(results: DataFrame, areas: Sequence[str], listed: str) -> DataFrame:
    """Providers and pupils per area at several grains, and those with any listed qualification.

    Distinct counts in two steps for all grains at once: first one row for each provider and each pupil of an area, then
    their number; both steps are partially aggregated before they are shuffled.
    """
    grain = F.explode(F.array(*[F.struct(F.lit(a).alias("grain"), F.col(a).cast("string").alias("name")) for a in areas])).alias("__g")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("id")) for k in ("provider", "pupil")])).alias("__k")
    stacked = results.select(grain, "provider", "pupil", F.col(listed).alias("__any")).select("__g", kinds, "__any")
    each = stacked.groupBy("__g.grain", "__g.name", "__k.kind", "__k.id").agg(F.max("__any").alias("__any"))
    of = {"providers": F.col("kind") == "provider", "students": F.col("kind") == "pupil"}
    known = F.col("id").isNotNull()
    counts = [count_if(known & hit).alias(n) for n, hit in of.items()] + [count_if(known & hit & F.col("__any")).alias(f"sub_{n}") for n, hit in of.items()]
    return each.groupBy("grain", "name").agg(*counts).withColumns({
        "pc_students": percent("sub_students", "students"), "pc_providers": percent("sub_providers", "providers"),
    })


def qualification_type_trend(published: DataFrame) -> DataFrame:
    """Entries per course, year and type from the published (masked) counts; masked rows do not count."""
    rows = published.filter((F.col("name") != "Totals") & number("n").isNotNull())
    return rows.groupBy("course", "year", "type").agg(F.sum(number("n")).cast("long").alias("n"))


def large_qualifications(published: DataFrame, above: int = 130) -> DataFrame:
    """Published rows above a size, and the totals."""
    return published.filter((F.col("name") == "Totals") | (number("n") > above))

