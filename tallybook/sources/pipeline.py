"""The cleaning run: raw results and pupils of all years to cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scales
from ..operators import clean, link
from ..session import exists
from . import scan
from .sink import write_clean

# Names in the field specs and in the long tables.
LONG_NAMES = {
    "PupilMatchingRefAnonymous": "pupil", "URN": "provider", "EXAMYEAR": "exam_year", "SUBLEVNO": "level", "QAN": "qualification",
    "MAPPING": "subject", "GRADE": "grade", "POINTS": "points", "GENDER": "gender", "EthMaj": "ethnicity", "EthMin": "eth_minor",
}
RESULT_NAMES = ("PupilMatchingRefAnonymous", "URN", "EXAMYEAR", "SUBLEVNO", "QAN", "MAPPING", "GRADE", "POINTS")


def clean_results(
    results: DataFrame, levels: Sequence, rescale_from: int | None = None,
    reformed: Sequence[str] = tuple(scales.REFORMED_SUBJECTS),
) -> DataFrame:
    """Best attempt of the file's own year, one qualification per subject, reformed scales.

    All years at once: the exam year is a column, so the steps run as one job.
    """
    scope = ["stage", "year"]
    own_year = results.filter(F.col("exam_year") == F.col("year"))
    best = clean.single_qualification(clean.best_attempt(own_year, levels=levels, scope=scope), scope)
    if rescale_from is not None:
        rescaled = scales.rescale_points(F.col("points"), F.col("subject"), reformed)
        best = best.withColumn("points", F.when(F.col("year") >= rescale_from, rescaled).otherwise(F.col("points")))
    return best


def clean_pupils(
    pupils: DataFrame, history: DataFrame | None = None, backfill: dict[str, str] | None = None
) -> DataFrame:
    """One record per pupil, upper-case gender, blanks filled from the newest earlier record."""
    unique = clean.drop_ambiguous_keys(pupils, "stage", "year", "pupil").withColumn("gender", F.upper("gender"))
    return unique if history is None else link.backfill_across_years(unique, history, backfill or {})


def spread_of(pupils: DataFrame, results: DataFrame, supersede: tuple | None = None) -> DataFrame:
    """The long spread: best points of known pupils per subject.

    ``supersede`` (new level, old level) leaves out a subject's old level in the stages and years in which the subject
    occurs at the new one; other years keep theirs, and the results themselves keep all.
    """
    if supersede is not None:
        results = clean.supersede_level(results, *supersede, scope=["stage", "year"])
    known = results.join(pupils.select("stage", "year", "pupil"), ["stage", "year", "pupil"], "left_semi")
    return known.groupBy("stage", "year", "pupil", "provider", "subject").agg(F.max("points").alias("points"))


def run(
    pupils: DataFrame, results: DataFrame, folder: str, supersede: tuple | None = None, years: Sequence[int] | None = None
) -> dict[str, str]:
    """Write pupils, results and the spread, which is made from the written tables, so the source is read once.

    ``years``: the years at hand; the spread of other years already in the folder is left as it is (None: all are made anew).
    A run that failed between two tables is mended by running it again.
    """
    spark = pupils.sparkSession
    paths = {name: write_clean(df, folder, name) for name, df in (("pupils", pupils), ("results", results))}
    written = [spark.read.parquet(paths[name]) for name in ("pupils", "results")]
    if years is not None:
        written = [df.filter(F.col("year").isin(sorted(set(years)))) for df in written]
    return paths | {"spread": write_clean(spread_of(*written, supersede), folder, "spread")}


def run_from_files(
    spark, sources: Sequence[dict], specs: DataFrame, folder: str, levels: dict[str, Sequence], supersede: dict[str, tuple] | None = None,
    rescale_from: int | None = None, earlier: str = "KS4", backfill: dict[str, str] | None = None,
    prior_subjects: dict[str, str] | None = None,
) -> None:
    """From raw extracts to written tables, stage by stage.

    ``sources``: {"stage", "year", "pupils", "results"} with the paths of one extract each; ``specs``: patterns and names
    by stage and year (``fields.read_field_spec``). Extracts are scanned by their own spec, brought to the names of the
    long tables and appended by name, so that headers may drift. Stages after ``earlier`` take blank attributes
    (``backfill``) and best points of ``prior_subjects`` from the earlier stage's records of any year, newest first; those
    records are the ones in the folder, also if this run brings none of the earlier stage.

    A stage and year in ``sources`` replaces what the folder holds of it; all others stay.
    """
    tables: dict[str, dict[str, DataFrame]] = {}
    rows = [tuple(r) for r in specs.select("stage", "year", "pattern", "name").collect()]  # metadata, read once
    for one in sources:
        pairs = [(pattern, name) for stage, year, pattern, name in rows if (stage, year) == (one["stage"], int(one["year"]))]
        people = [p for p in pairs if p[1] not in RESULT_NAMES or p[1] in ("PupilMatchingRefAnonymous", "URN")]
        marks = [p for p in pairs if p[1] in RESULT_NAMES]
        mark = {"stage": F.lit(one["stage"]), "year": F.lit(int(one["year"]))}
        pupils = scan.scan_pupils(spark, one["pupils"], people, one["stage"]).withColumns(mark)
        results = scan.scan_results(spark, one["results"], marks).withColumns(mark)
        for name, df in (("pupils", pupils), ("results", results)):
            renamed = df.withColumnsRenamed({k: v for k, v in LONG_NAMES.items() if k in df.columns})
            seen = tables.setdefault(one["stage"], {})
            seen[name] = seen[name].unionByName(renamed, allowMissingColumns=True) if name in seen else renamed
    years = {stage: [int(one["year"]) for one in sources if one["stage"] == stage] for stage in tables}
    history = marks_of = None
    if earlier not in tables and exists(spark, f"{folder}/{earlier}/results"):
        history, marks_of = _earlier_records(spark, f"{folder}/{earlier}", prior_subjects or {})
    for stage in sorted(tables, key=lambda s: (s != earlier, s)):
        raw = tables[stage]["results"].withColumn("exam_year", F.col("exam_year").try_cast("int"))
        results = clean_results(raw, levels[stage], rescale_from)
        fill = stage != earlier and history is not None
        pupils = clean_pupils(tables[stage]["pupils"], history if fill else None, backfill)
        if fill and prior_subjects:
            pupils = link.backfill_across_years(pupils, marks_of, {name: name for name in prior_subjects.values()})
        run(pupils, results, f"{folder}/{stage}", (supersede or {}).get(stage), years[stage])
        if stage == earlier:
            history, marks_of = _earlier_records(spark, f"{folder}/{stage}", prior_subjects or {})


def _earlier_records(spark, folder: str, prior_subjects: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Written pupils of a stage, and each pupil's and year's best points in the given subjects."""
    kept = spark.read.parquet(f"{folder}/results").filter(F.col("subject").isin(list(prior_subjects)))
    names = {s: F.max(F.when(F.col("subject") == s, F.col("points"))).alias(n) for s, n in prior_subjects.items()}
    marks = kept.groupBy("pupil", "year").agg(F.count("*").alias("__n"), *names.values()).drop("__n")
    return spark.read.parquet(f"{folder}/pupils"), marks
