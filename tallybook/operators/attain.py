"""Attainment: grade tables, averages by subject, gaps between genders and subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from . import disclose, logit, profile, rank, select, stats
from .common import count_if, either, fixed, null_safe_join, percent
from .uptake import sits

GCSE_PASS, ALEVEL_PASS = 5.0, 210.0
LETTERS = ["*", "A", "B", "C", "D", "E", "F", "G", "U"]
DEMOGRAPHICS = ["gender", "flag", "ethnicity", "eth_minor", "sen", "eal"]


# --- grades of the focus ----------------------------------------------------------------------------------------


def grade_demographics(cohort: DataFrame, letter: Column, demographics: Sequence[str] = tuple(DEMOGRAPHICS)) -> DataFrame:
    """Takers by six demographics and grade letter."""
    return cohort.filter(sits()).groupBy(*demographics, letter.alias("grade")).agg(F.count("*").alias("total"))


def grade_demographic_summary(summary: DataFrame, focus: Sequence[str], letters: Sequence[str] = tuple(LETTERS)) -> DataFrame:
    """A count row and a per cent row per focus group, one column per letter; groups without any focus value left out."""
    known = summary.filter(either([F.col(c).isNotNull() for c in focus]) & F.col("grade").isNotNull())
    cells = {g: F.sum(F.when(F.col("grade") == g, F.col("total"))) for g in letters}
    wide = known.groupBy(*focus).agg(F.sum("total").alias("__all"), *[c.cast("double").alias(g) for g, c in cells.items()])
    shares = wide.select(*focus, F.lit("%").alias("type"), *[percent(g, "__all").alias(g) for g in map(_quoted, letters)])
    counts = wide.select(*focus, F.lit("n").alias("type"), *[F.col(_quoted(g)) for g in letters])
    renamed = shares.toDF(*counts.columns)
    return counts.unionByName(renamed)


def _quoted(name: str) -> str:
    return f"`{name}`"


def grade_flag_summary(summary: DataFrame, flag: str = "flag", letters: Sequence[str] = tuple(LETTERS)) -> DataFrame:
    """Flag x grade counts, one column per letter."""
    return summary.groupBy(flag).agg(*[F.sum(F.when(F.col("grade") == g, F.col("total"))).alias(g) for g in letters])


def grade_focus_share(summary: DataFrame, focus: str) -> DataFrame:
    """Per (focus, grade): count and share within the focus group, small counts suppressed."""
    counts = (
        summary.dropna(subset=[focus, "grade"]).groupBy(focus, "grade").agg(F.sum("total").alias("total"))
    )
    shared = rank.group_total_share(counts.withColumnRenamed("total", "n"), [focus], digits=4)
    named = shared.select(focus, "grade", F.col("n").alias("total"), F.col("total").alias("focus_total"), F.col("share").alias("percentage"))
    return disclose.suppress_small(named, "total", "percentage")


# --- subjects per pupil -----------------------------------------------------------------------------------------


def subjects_per_pupil(cohort: DataFrame) -> DataFrame:
    """Histogram of subject counts: all, takers, flag 1, flag 0; small cells suppressed with their product."""
    kinds = {"all": F.lit(True), "sub": sits(), "flag1": F.col("flag") == 1, "flag0": F.col("flag") == 0}
    table = cohort.groupBy("n_subjects").agg(*[F.nullif(count_if(c), F.lit(0)).alias(k) for k, c in kinds.items()])
    out = {}
    for k in kinds:
        small = F.col(k) < disclose.CUTOFF
        out[f"{k}_total"] = F.when(small, 0).otherwise(F.col(k))
        out[f"{k}_entries"] = F.when(small, 0).otherwise(F.col(k) * F.col("n_subjects"))
        out[f"{k}_anon"] = F.when(small, "X").when(F.col(k).isNotNull(), "")
    return table.withColumns(out).drop(*kinds)


def single_subject_share(cohort: DataFrame) -> DataFrame:
    """Pupils with exactly one subject, over all and among takers, with their shares."""
    per_pupil = cohort.groupBy("pupil").agg(
        F.sum("n_subjects").alias("n"), F.sum(F.when(sits(), F.col("n_subjects"))).alias("sub_n"),
        F.count("*").alias("rows"), F.count("focus_points").alias("sub_rows"),
    )
    return per_pupil.agg(
        count_if(F.col("n") == 1).alias("single"), F.sum("rows").alias("entries"),
        count_if(F.col("sub_n") == 1).alias("sub_single"), F.sum("sub_rows").alias("sub_entries"),
    ).withColumns({
        "share": F.round(F.try_divide("single", "entries"), 6), "sub_share": F.round(F.try_divide("sub_single", "sub_entries"), 6),
    })


# --- averages by subject ----------------------------------------------------------------------------------------


def overall_average(people: DataFrame, what: str, factor: bool = False) -> DataFrame:
    """Mean, sd and n of a numeric attribute, or the share of each level of a factor."""
    known = people.filter(F.col(what).isNotNull())
    if not factor:
        return known.agg(
            F.count("*").alias("n"), F.round(F.avg(what), 4).alias("mean"), F.round(F.stddev_samp(what), 4).alias("sd")
        )
    return rank.group_total_share(known.groupBy(what).agg(F.count("*").alias("n")), [], digits=1).select(
        what, F.col("total").alias("n"), F.col("share").alias("mean"), F.lit(None).cast("double").alias("sd")
    )


def average_by_subject(
    facts: DataFrame, people: DataFrame, focus: str, what: str, k: int = 20, factor: bool = False
) -> DataFrame:
    """The average of an attribute (or shares of its levels) per top-k subject, an "All" row, the focus highlighted."""
    attribute = people.select("pupil", "provider", what)
    rows = facts.select("pupil", "provider", "subject").join(attribute, ["pupil", "provider"])
    # Unknown values count towards the ranking of subjects only, so one aggregation serves both.
    if factor:
        counts = rows.groupBy("subject", what).agg(F.count("*").alias("n"))
        known = rank.keep_top(counts, focus, k).filter(F.col(what).isNotNull())
        table = rank.group_total_share(known, ["subject"], digits=1).select(
            "subject", what, "n", F.col("share").alias("mean"), F.lit(None).cast("double").alias("sd")
        )
    else:
        moments = rows.groupBy("subject").agg(
            F.count("*").alias("__entries"), F.count(what).alias("n"),
            F.round(F.avg(what), 4).alias("mean"), F.round(F.stddev_samp(what), 4).alias("sd"),
        )
        table = rank.keep_top(moments, focus, k, "__entries").drop("__entries").filter("n > 0")
    everyone = overall_average(people, what, factor).withColumn("subject", F.lit("All"))
    return table.unionByName(everyone).withColumn("highlight", F.when(F.col("subject") == focus, F.col("mean")).otherwise(0.0))


def indicator(category: str, value) -> Column:
    """100 for the value, 0 for any other known value, null for blanks."""
    known = F.coalesce(F.col(category), F.lit("")) != ""
    return F.when(F.col(category) == value, 100.0).when(known, 0.0)


def _passes(facts: DataFrame, people: DataFrame, keys: Sequence[str], group: str, threshold: float) -> DataFrame:
    """Entries, point sum and passes per key."""
    rows = facts.select("pupil", "provider", "subject", "points").join(
        people.select("pupil", "provider", group), ["pupil", "provider"]
    )
    return rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.sum("points").alias("__points"), count_if(F.col("points") >= threshold).alias("__passes")
    )


def _pass_columns(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "points": F.round(F.col("__points") / F.col("__n"), 6), "pass_rate": F.round(F.col("__passes") / F.col("__n"), 6),
    }).drop("__n", "__points", "__passes")


def pass_rate(facts: DataFrame, people: DataFrame, group: str, threshold: float, keep_null_group: bool = False) -> DataFrame:
    """Mean points and share at or above the threshold per group."""
    sums = _passes(facts, people, [group], group, threshold)
    return _pass_columns(sums if keep_null_group else sums.filter(F.col(group).isNotNull()))


def pass_rate_by_subject(
    facts: DataFrame, people: DataFrame, group: str, threshold: float, focus: str, k: int = 20, keep_null_group: bool = False
) -> DataFrame:
    """Pass rates per top-k subject and group, with "All" rows over every subject and the focus highlighted."""
    sums = _passes(facts, people, ["subject", group], group, threshold)
    measures = ["__n", "__points", "__passes"]
    columns = [F.col("subject"), F.col(group)]
    both = sums.groupingSets([columns, columns[1:]], "subject", group).agg(
        F.grouping("subject").alias("__all"), *[F.sum(c).alias(c) for c in measures]
    )
    top = rank.keep_top(both.filter("__all = 0"), focus, k, "__n")
    everyone = both.filter("__all = 1").withColumn("subject", F.lit("All"))
    table = top.unionByName(everyone).drop("__all")
    if not keep_null_group:
        table = table.filter(F.col(group).isNotNull())
    return _pass_columns(table).withColumn(
        "highlight", F.when(F.col("subject") == focus, F.col("pass_rate")).otherwise(0.0)
    )


def category_by_subject(
    facts: DataFrame, people: DataFrame, focus: str, subjects: Sequence[str], category: str, names: Column, k: int = 30
) -> DataFrame:
    """Category shares of the comparison subjects and of all pupils as columns, categories decoded."""
    shares = average_by_subject(facts, people, focus, category, k, factor=True)
    return shares.groupBy(names.alias("category")).agg(
        *[F.max(F.when(F.col("subject") == s, F.col("mean"))).alias(s) for s in [*subjects, "All"]]
    )


def ethnicity_comparison(facts: DataFrame, people: DataFrame, subjects: Sequence[str], category: str = "ethnicity") -> DataFrame:
    """Population per category and each subject's takers and shares side by side, in one aggregation per side."""
    known = people.filter(F.coalesce(category, F.lit("")) != "").select("pupil", "provider", category)
    population = rank.group_total_share(known.groupBy(category).agg(F.count("*").alias("n")), []).select(
        category, F.col("n").alias("total"), F.col("share").alias("pc_population")
    )
    takers = facts.filter(F.col("subject").isin(list(subjects))).join(known, ["pupil", "provider"]).groupBy(category).agg(
        *[count_if(F.col("subject") == s).alias(f"n_{i}") for i, s in enumerate(subjects, 1)]
    )
    for i in range(1, len(subjects) + 1):
        takers = rank.group_total_share(takers, [], f"n_{i}").withColumnRenamed("share", f"pc_{i}").drop("total")
    return population.join(takers, category, "left")


# --- gender gaps ------------------------------------------------------------------------------------------------


def provider_differential(facts: DataFrame, people: DataFrame, subjects: Sequence[str], female: str = "F", male: str = "M") -> DataFrame:
    """Per provider and subject: mean difference from the pupil's other subjects, mean points and n by gender.

    Absent cells are 0; entries without another subject are left out.
    """
    rows = (
        profile.with_other_mean(facts).filter(F.col("other_mean").isNotNull() & F.col("subject").isin(list(subjects)))
        .join(people.select("pupil", "provider", "gender", "sch_gender"), ["pupil", "provider"])
        .filter(F.col("sch_gender").isNotNull())
        .withColumn("diff", F.col("points") - F.col("other_mean"))
    )
    cells = []
    for name, code in (("girls", female), ("boys", male)):
        hit = F.col("gender") == code
        cells += [
            F.coalesce(F.round(F.avg(F.when(hit, F.col("points"))), 6), F.lit(0.0)).alias(f"{name}_avg"),
            F.coalesce(F.round(F.avg(F.when(hit, F.col("diff"))), 6), F.lit(0.0)).alias(f"{name}_diff"),
            count_if(hit).alias(f"{name}_n"),
        ]
    share = percent("girls_n", F.col("girls_n") + F.col("boys_n"), 4)
    return rows.groupBy("provider", "subject", "sch_gender").agg(*cells).withColumn(
        "girl_per", F.when(F.col("girls_n") == 0, 0.0).when(F.col("boys_n") == 0, 100.0).otherwise(share)
    )


def gender_share_in_cohort(differential: DataFrame) -> DataFrame:
    """The differential as one row per gender, with its share of the provider's takers."""
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(label).alias("gender"), F.col(f"{name}_avg").alias("avg"), F.col(f"{name}_diff").alias("diff"),
            F.col(f"{name}_n").alias("n"),
        )
        for name, label in (("girls", "Female"), ("boys", "Male"))
    ]))
    total = F.col("girls_n") + F.col("boys_n")
    return (
        differential.select("provider", "subject", "sch_gender", total.alias("total"), rows.alias("__r"))
        .select("provider", "subject", "sch_gender", "total", "__r.*")
        .withColumn("per", percent("n", "total", 4))
    )


def subject_gender_means(facts: DataFrame, people: DataFrame, female: str = "F", male: str = "M") -> DataFrame:
    """Mean, sd and n of every subject by gender, in one aggregation."""
    rows = facts.join(people.select("pupil", "provider", "gender"), ["pupil", "provider"])
    cells = []
    for name, code in (("f", female), ("m", male)):
        v = F.when(F.col("gender") == code, F.col("points"))
        cells += [F.round(F.avg(v), 6).alias(f"mean_{name}"), F.round(F.stddev_samp(v), 6).alias(f"sd_{name}"), F.count(v).alias(f"n_{name}")]
    return rows.groupBy("subject").agg(*cells)


def _mean_sd(mean: str, sd: str) -> Column:
    """Mean and, in brackets, the deviation, which a single value has not ("null")."""
    return F.concat(fixed(mean, 2), F.lit("("), F.coalesce(fixed(sd, 2), F.lit("null")), F.lit(")"))


def entry_profile(
    facts: DataFrame, people: DataFrame, focus: str, prior: str, attribute: str, female: str = "F", male: str = "M",
    k: int = 25, top: int = 20,
) -> DataFrame:
    """Per subject and gender: n and "mean(sd)" of a prior score and of an attribute subject; top rows by the female prior.

    Restricted to pupils who have the prior score and sit the attribute subject.
    """
    rows = profile.with_focus_points(facts, attribute, "__attribute").filter(F.col("__attribute").isNotNull()).join(
        people.select("pupil", "provider", "gender", F.col(prior).alias("__prior")), ["pupil", "provider"]
    ).filter(F.col("__prior").isNotNull() & F.col("gender").isin(female, male))
    moments = []
    for name, code in (("f", female), ("m", male)):
        prior_, attribute_ = (F.when(F.col("gender") == code, F.col(c)) for c in ("__prior", "__attribute"))
        moments += [
            F.count(prior_).alias(f"n_{name}"), F.round(F.avg(prior_), 9).alias(f"mean_{name}"), F.stddev_samp(prior_).alias(f"sd_{name}"),
            F.round(F.avg(attribute_), 9).alias(f"a_mean_{name}"), F.stddev_samp(attribute_).alias(f"a_sd_{name}"),
        ]
    # Everyone sits the attribute subject once, so its rows are the population as well.
    is_attribute = F.col("subject") == attribute
    table = rows.groupBy("subject").agg(*moments).withColumn(
        "__all", F.explode(F.when(is_attribute, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    ).withColumn("subject", F.when(F.col("__all"), "All").otherwise(F.col("subject")))
    for name in ("f", "m"):
        table = rank.mark_top(table, f"__top_{name}", focus, k, f"n_{name}", F.col("__all"))
    listed = table.filter(F.col("__top_f") & F.col("__top_m")).withColumn("__place", F.rank().over(Window.orderBy(F.desc("mean_f"))))
    return listed.filter(F.col("__place") <= top).select(
        "subject",
        *[c for x in ("f", "m") for c in (
            F.col(f"n_{x}"), _mean_sd(f"mean_{x}", f"sd_{x}").alias(f"prior_{x}"), _mean_sd(f"a_mean_{x}", f"a_sd_{x}").alias(f"attribute_{x}"),
        )],
        (F.col("n_f") + F.col("n_m")).alias("n"),
    )


def grade_gap_by_provider_gender(
    facts: DataFrame, people: DataFrame, min_total: int = 30000,
    categories: Sequence[str] = ("Boys_M", "Girls_F", "Mixed_F", "Mixed_M"),
) -> DataFrame:
    """Per subject: "mean(sd)" of points and of the difference from other subjects, by provider gender and gender."""
    rows = (
        profile.with_other_mean(facts).filter(F.col("other_mean").isNotNull())
        .join(people.select("pupil", "provider", "gender", "sch_gender"), ["pupil", "provider"])
        .filter(F.col("sch_gender").isNotNull())
        .withColumns({"diff": F.col("points") - F.col("other_mean"), "__category": F.concat_ws("_", "sch_gender", "gender")})
    )
    aggregates = [F.count("*").alias("total")]
    for c in categories:
        for what, col in (("focus", "points"), ("diff", "diff")):
            v = F.when(F.col("__category") == c, F.col(col))
            aggregates += [F.avg(v).alias(f"__m_{what}_{c}"), F.stddev_samp(v).alias(f"__s_{what}_{c}")]
    table = rows.groupBy("subject").agg(*aggregates).filter(F.col("total") > min_total)
    return table.select("subject", "total", *[
        F.when(F.col(f"__m_{w}_{c}").isNotNull(), _mean_sd(f"__m_{w}_{c}", f"__s_{w}_{c}")).alias(f"{w}_{c}")
        for w in ("focus", "diff") for c in categories
    ])


def _paired(facts: DataFrame, people: DataFrame, focus: str) -> DataFrame:
    """Facts of entries that sit the focus, with diff = focus points - this subject's points."""
    return (
        profile.with_focus_points(facts, focus).filter(sits())
        .join(people.select("pupil", "provider", "gender"), ["pupil", "provider"])
        .withColumn("diff", F.col("focus_points") - F.col("points"))
    )


def subject_gap_table(facts: DataFrame, people: DataFrame, focus: str, female: str = "F", male: str = "M") -> DataFrame:
    """For pupils sitting the focus and another subject: difference overall and by gender, over/equal/under counts."""
    itself = F.col("subject") == focus
    aggregates = []
    for name, hit in (("t", F.lit(True)), ("m", F.col("gender") == male), ("f", F.col("gender") == female)):
        v = F.when(hit, F.col("diff"))
        aggregates += [F.count(v).alias(f"{name}_n"), F.round(F.avg(v), 4).alias(f"{name}_mean"), F.round(F.stddev_samp(v), 4).alias(f"{name}_sd")]
        if name != "t":
            aggregates += [count_if(v > 0).alias(f"{name}_over"), count_if((v == 0) & ~itself).alias(f"{name}_equal"), count_if(v < 0).alias(f"{name}_under")]
    table = _paired(facts, people, focus).groupBy("subject").agg(*aggregates)
    return table.withColumn("gap", F.round(F.col("m_mean") - F.col("f_mean"), 4))


def subject_gap_tests(facts: DataFrame, people: DataFrame, focus: str, female: str = "F", male: str = "M") -> DataFrame:
    """Welch test of the difference by gender, and other ~ male + focus against other ~ focus, for every other subject."""
    rows = _paired(facts, people, focus).filter((F.col("subject") != focus) & F.col("gender").isin(female, male)).withColumn(
        "__male", (F.col("gender") == male).cast("double")
    )
    moments = rows.groupBy("subject").agg(
        *stats.two_group_moments(F.col("diff"), F.col("gender") == female, F.col("gender") == male),
        *stats.two_predictor_moments("points", "__male", "focus_points"),
    )
    tested = stats.solve_two_predictors(stats.welch(moments))
    keep = ["t", "df", "d", "b0", "b1", "b2", "se1", "se2", "r2", "sum_sq", "chi2"]
    return tested.select("subject", "n", "res_df", "magnitude", *keep)


def qualification_gap(
    results: DataFrame, facts: DataFrame, pupils: DataFrame, focus: str, female: str = "F", male: str = "M"
) -> DataFrame:
    """Per qualification of the focus: points and other-subject mean by gender, their gaps, and Welch tests of both."""
    others = facts.filter(F.col("subject") != focus).groupBy("pupil").agg(F.avg("points").alias("other_mean"))
    rows = (
        results.filter(F.col("subject") == focus).select("pupil", "qualification", "points")
        .join(pupils.select("pupil", "gender"), "pupil", "left").join(others, "pupil", "left")
    )
    aggregates = []
    for name, code in (("f", female), ("m", male)):
        hit = (F.col("gender") == code) & F.col("other_mean").isNotNull()
        p, o = F.when(hit, F.col("points")), F.when(hit, F.col("other_mean"))
        aggregates += [
            F.count(p).alias(f"n_{name}"), F.avg(p).alias(f"points_{name}"), F.stddev_samp(p).alias(f"points_sd_{name}"),
            F.avg(o).alias(f"other_{name}"), F.stddev_samp(o).alias(f"other_sd_{name}"),
        ]
    is_m, is_f = F.col("gender") == male, F.col("gender") == female
    table = rows.groupBy("qualification").agg(*aggregates)
    for name, value in (("points", F.col("points")), ("diff", F.col("points") - F.col("other_mean"))):
        tests = stats.welch_ttest(rows, ["qualification"], value, is_m, is_f).select(
            "qualification", *[F.col(c).alias(f"{name}_{c}") for c in ("t", "df", "d")]
        )
        table = null_safe_join(table, tests, ["qualification"], "left")
    return table.withColumns({
        "gender_gap": F.col("points_f") - F.col("points_m"),
        "f_gap": F.col("points_f") - F.col("other_f"), "m_gap": F.col("points_m") - F.col("other_m"),
    })


# --- science combinations ---------------------------------------------------------------------------------------


def ebacc_summary(
    facts: DataFrame, singles: Sequence[str], core: str, additional: str, focus: str | None, pass_mark: float = 4.0
) -> DataFrame:
    """Entries taking or passing single sciences and core + additional science; takers of the focus, or all entries."""
    single = F.col("subject").isin(list(singles))
    passed = F.col("points") >= pass_mark
    per_entry = facts.groupBy("pupil", "provider").agg(
        count_if(single).alias("taken"), count_if(single & passed).alias("singles_passed"),
        F.max(F.col("subject") == core).alias("c"), F.max(F.col("subject") == additional).alias("a"),
        F.max((F.col("subject") == core) & passed).alias("cp"), F.max((F.col("subject") == additional) & passed).alias("ap"),
        F.max(F.col("subject") == (focus or "")).alias("sits"),
    )
    if focus is not None:
        per_entry = per_entry.filter("sits")
    return per_entry.agg(
        count_if(F.col("taken") == 4).alias("singles_4"), count_if(F.col("taken") == 3).alias("singles_3"),
        count_if((F.col("taken") >= 3) & (F.col("singles_passed") >= 2)).alias("passed_singles"),
        count_if(F.col("c") & F.col("a")).alias("attempt_coreadd"),
        count_if(F.col("cp") & F.col("ap")).alias("passed_coreadd"), F.count("*").alias("total"),
    ).withColumns({
        "singles_per": percent(F.col("singles_4") + F.col("singles_3"), "total"), "core_per": percent("attempt_coreadd", "total"),
        "singles_4_per": percent("singles_4", "total"), "singles_3_per": percent("singles_3", "total"),
    }).withColumn("subject", F.lit(focus or "All"))


# --- deprivation ------------------------------------------------------------------------------------------------


def _banded(people: DataFrame, facts: DataFrame, bands: int, attributes: Sequence[str], score: str) -> tuple[DataFrame, DataFrame]:
    """(population, takers) per offered subject with the band of the score within (subject, gender).

    The edges of the bands come from histograms over the people of the providers that offer a subject; people and takers
    are compared with them where they are read, so no table of people by subject is written or shuffled.
    """
    known = people.filter(F.col("gender").isNotNull() & F.col(score).isNotNull()).select("pupil", "provider", "gender", *attributes, score)
    population = logit.per_subject(logit.exposed(known, facts).drop("provider"))
    edges = stored(select.band_edges(population, ["subject", "gender"], score, "pupil", bands).select("subject", "gender", "edges"), "edges")
    takers = facts.select("pupil", "provider", "subject").join(known, ["pupil", "provider"]).drop("provider")
    band = select.band_of(score, "pupil").cast("int")
    return tuple(null_safe_join(df, edges, ["subject", "gender"], "inner").withColumn("band", band).drop("edges") for df in (population, takers))


def _shares(population: DataFrame, takers: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = population.groupBy(*keys).agg(F.count("*").alias("total"))
    taken = takers.groupBy(*keys).agg(F.count("*").alias("takers"))
    both = null_safe_join(totals, taken, keys, "left").withColumn("takers", F.coalesce("takers", F.lit(0).cast("long")))
    return both.withColumn("percentage", percent("takers", "total"))


def deprivation_bands(people: DataFrame, facts: DataFrame, bands: int, score: str = "score") -> DataFrame:
    """Per (subject, gender, band of the score): pupils of providers that offer the subject, takers, share; all subjects."""
    return _shares(*_banded(people, facts, bands, (), score), ["subject", "gender", "band"])


def deprivation_by_category(people: DataFrame, facts: DataFrame, bands: int, category: str, leave_out: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Bands drawn per (subject, gender), then pupils, takers and share per category within them."""
    both = _banded(people, facts, bands, [category], score)
    return _shares(*[df.filter(~F.col(category).isin(list(leave_out))) for df in both], ["subject", "gender", category, "band"])
