"""Row cleaning: record types, duplicates, attempts, scales, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scales, text

RESULT_KEYS = ["pupil", "subject", "qualification"]


def coalesce_flags(df: DataFrame, target: str, *sources: str) -> DataFrame:
    """First non-null of the source columns that exist."""
    present = [c for c in sources if c in df.columns]
    return df.withColumn(target, F.coalesce(*present))


def filter_record_type(df: DataFrame, record_type: str = "RECTYPE", keep: int = 1, provider: str = "URN") -> DataFrame:
    """Where the record type exists: keep one type, drop the provider, remove duplicates."""
    if record_type not in df.columns:
        return df
    return df.filter(F.col(record_type) == keep).drop(provider).distinct()


def drop_ambiguous_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop every row of a key that has more than one distinct record."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.distinct()
        .groupBy(*keys)
        .agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__row"))
        .filter("__n = 1")
        .select(*keys, "__row.*")
        .select(*df.columns)
    )


def best_attempt(
    results: DataFrame, exam_year: int | None = None, levels: Sequence | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Rows with the highest points per (pupil, subject, qualification), ties kept, grade dropped.

    Only the best row of each (key, provider, level) can be a best row of the key, so a first aggregation
    with map-side combine shrinks every key to at most one row per provider and level before the window.
    ``scope`` columns (stage, year) keep cohorts apart when several are cleaned at once.
    """
    df = results
    if exam_year is not None:
        df = df.filter(F.col("year") == exam_year)
    if levels is not None:
        df = df.filter(F.col("level").isin(list(levels)))
    keys = [*scope, "pupil", "provider", "level", "subject", "qualification"]
    rows = df.groupBy(*keys).agg(F.max("points").alias("points"))
    best = F.max("points").over(Window.partitionBy(*scope, *RESULT_KEYS))
    return rows.withColumn("__best", best).filter("points = __best").drop("__best")


def single_qualification(results: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per (pupil, provider, level, subject): its highest points."""
    return results.groupBy(*scope, "pupil", "provider", "level", "subject").agg(F.max("points").alias("points"))


def single_result(results: DataFrame) -> DataFrame:
    """The long fact: highest points per (pupil, provider, subject) over all levels."""
    return results.groupBy("year", "pupil", "provider", "subject").agg(F.max("points").alias("points"))


def rescale_points(results: DataFrame, reformed: Sequence[str] = tuple(scales.REFORMED_SUBJECTS)) -> DataFrame:
    return results.withColumn("points", scales.rescale_points(F.col("points"), F.col("subject"), reformed))


def supersede_level(results: DataFrame, new_level, old_level, scope: Sequence[str] = ()) -> DataFrame:
    """Drop old-level rows of any subject that occurs at the new level in the same scope (stage and year, say)."""
    keys = [*scope, "subject"]
    replaced = results.filter(F.col("level") == new_level).select(*keys).distinct()
    old = results.filter(F.col("level") == old_level).join(replaced, keys, "left_anti")
    others = results.filter(~F.col("level").eqNullSafe(old_level))
    return others.unionByName(old)


def valid_providers(df: DataFrame, bound: int = scales.FIRST_INVALID_PROVIDER, provider: str = "provider") -> DataFrame:
    return df.filter(F.col(provider) < bound)


def optional_columns(df: DataFrame, required: Sequence[str], fragments: Sequence[str]) -> DataFrame:
    """The required columns, then every column whose name contains a fragment."""
    extra = [c for f in fragments for c in df.columns if f in c and c not in required]
    return df.select(*required, *dict.fromkeys(extra))


def drop_label_rows(df: DataFrame, label: str, unwanted: Sequence[str] = ("", "Not applicable", "Totals")) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & ~F.col(label).isin(list(unwanted)))


def keyword_filter(df: DataFrame, title: str, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    return df.filter(text.matches_titles(F.col(title), include, exclude))


def normalise_title(df: DataFrame, identifier: str, name: str, level: str, kind: str) -> DataFrame:
    """Shorten qualification type, level and name by the ordered substitutions."""
    renamed = F.try_element_at(F.create_map(*[F.lit(x) for kv in text.SHORT_COURSE.items() for x in kv]), F.col(identifier))
    return (
        df.withColumn(kind, text.normalise_type(F.col(kind)))
        .withColumn(level, text.replace_in_order(F.col(level), text.LEVEL_STEPS))
        .withColumn(name, F.coalesce(renamed, text.replace_in_order(F.col(name), text.TITLE_STEPS)))
        .withColumn(identifier, F.coalesce(identifier, F.lit("")))
    )


def presence_bits(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """(pupil, provider, bits): for every entry one text of 1 and 0, a place for each subject in their order.

    One row an entry; the subject list is a one-value subquery, not a join.
    """
    taken = facts.groupBy("pupil", "provider").agg(F.collect_set("subject").alias("__taken"))
    known = entries.select("pupil", "provider").join(taken, ["pupil", "provider"], "left").withColumn("__subjects", subject_list(facts))
    sits = F.transform("__subjects", lambda s: F.when(F.array_contains("__taken", s), "1").otherwise("0"))
    return known.select("pupil", "provider", F.array_join(sits, "").alias("bits"))


def subject_list(facts: DataFrame) -> Column:
    return facts.agg(F.sort_array(F.collect_set("subject"))).scalar()


def presence_matrix(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """1 or 0 for every (entry, subject): the bits of each entry written out, for those who ask for dense rows."""
    rows = presence_bits(entries, facts).select("*", F.posexplode(subject_list(facts)).alias("__at", "subject"))
    return rows.select("pupil", "provider", "subject", F.substr("bits", F.col("__at") + 1, F.lit(1)).cast("int").alias("sits"))
