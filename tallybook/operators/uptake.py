"""Uptake of a subject by provider, area and demographic group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scales
from ..session import stored
from . import disclose, profile, rank, totals
from .clean import valid_providers
from .common import count_if, dealt, looked_up, null_safe_join, percent, ratio

def sits() -> Column:
    return F.col("focus_points").isNotNull()


# --- provider grain -------------------------------------------------------------------------------------------


def provider_size(cohort: DataFrame, by_gender: bool = False) -> DataFrame:
    """Distinct pupils per provider, or per provider and gender."""
    keys = ["provider", "gender"] if by_gender else ["provider"]
    return cohort.groupBy(*keys).agg(F.countDistinct("pupil").alias("students"))


def provider_subject_count(facts: DataFrame, focus: str) -> DataFrame:
    """Distinct subjects per provider and whether the focus is offered."""
    return (
        profile.provider_subjects(facts).groupBy("provider")
        .agg(F.count("*").alias("n_subjects"), F.max(F.col("subject") == focus).alias("offers_focus"))
    )


PROFILE_SUMS = [
    "schools", "students", "sub_schools", "sub_students", "total_grade", "sub_all_grades", "sub_grade",
]


def _stable_sum(value) -> Column:
    """Sum of fractions rounded far below any published digit, so that it does not depend on the order of addition."""
    return F.round(F.sum(value), 6)


def provider_profile(cohort: DataFrame, attributes: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Per provider: pupils and sum of pupil means; for takers: pupils, focus grades, their pupil means.

    ``attributes`` may hold stage and year, which makes one profile for each; ``extra`` are further aggregates.
    """
    taker_mean = F.when(sits(), F.col("mean_points"))
    return (
        cohort.groupBy("provider", *attributes)
        .agg(
            F.count("*").alias("students"),
            _stable_sum("mean_points").alias("total_grade"),
            F.count("focus_points").alias("sub_students"),
            F.sum("focus_points").alias("sub_grade"),
            _stable_sum(taker_mean).alias("sub_all_grades"),
            *extra,
        )
        .withColumn("schools", F.lit(1).cast("long"))
        .withColumn("sub_schools", (F.col("sub_students") > 0).cast("long"))
    )


CRITERIA_RATIOS = {
    "pc_schools": lambda: percent("sub_schools", "schools"),
    "pc_students": lambda: percent("sub_students", "students"),
    "average_cohort": lambda: F.coalesce(ratio("sub_students", "sub_schools"), F.lit(0.0)),
    "grade_avg_sch": lambda: F.coalesce(ratio("total_grade", "students"), F.lit(0.0)),
    "grade_avg_sub_students": lambda: F.coalesce(ratio("sub_all_grades", "sub_students"), F.lit(0.0)),
    "grade_avg_subject": lambda: F.coalesce(ratio("sub_grade", "sub_students"), F.lit(0.0)),
}

# (column, providers, students): the column is masked where the providers nearly equal the students.
SMALL_GROUP_RULES = [
    ("grade_avg_sch", "schools", "students"),
    ("grade_avg_sub_students", "sub_schools", "sub_students"),
    ("grade_avg_subject", "sub_schools", "sub_students"),
    ("average_cohort", "sub_schools", "sub_students"),
    ("pc_students", "sub_schools", "sub_students"),
    ("students", "schools", "students"),
    ("sub_students", "sub_schools", "sub_students"),
]


LABEL = "label"


def label_columns(n: int) -> list[str]:
    """label, label2, ... of a table of several criteria."""
    return [LABEL if i == 0 else f"{LABEL}{i + 1}" for i in range(n)]


def criteria_counts(
    profiles: DataFrame, tables: dict[str, dict[str, Column]], by: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """Groups, totals and ratios of every criterion, before masking, from one pass over the profiles.

    Each profile is read once and becomes one row a criterion, which partial aggregation shrinks before the only shuffle.
    The groups are stored: the test for close groups and the totals read them again, by stage, year (``by``) and
    criterion, and no task holds a whole table however many groups it has. ``extra`` are further columns to sum.
    Groups whose first label is null, blank or "Not applicable" are left out; labels that a criterion lacks are "".
    """
    sums = [*PROFILE_SUMS, *extra]
    names = label_columns(max(len(labels) for labels in tables.values()))
    cells = []
    for criterion, labels in tables.items():
        padded = [*[c.cast("string") for c in labels.values()], *[F.lit("")] * (len(names) - len(labels))]
        cells.append(F.struct(F.lit(criterion).alias("criterion"), *[c.alias(n) for c, n in zip(padded, names)]))
    rows = profiles.select(*by, *sums, F.explode(F.array(*cells)).alias("__cell")).select(*by, *sums, "__cell.*")
    known = rows.filter(F.col(LABEL).isNotNull() & ~F.col(LABEL).isin("", "Not applicable"))
    scope = [*by, "criterion"]
    totalled = [_stable_sum(c) if c.endswith(("grade", "grades")) else F.sum(c) for c in sums]
    table = known.groupBy(*scope, *names).agg(*[F.coalesce(s, F.lit(0)).alias(c) for s, c in zip(totalled, sums)])
    table = disclose.round_if_any_small(stored(table, "criteria"), "sub_students", "sub_schools", scope)
    table = totals.total_row(table, names, sums, groups=scope)
    return table.withColumns({name: make() for name, make in CRITERIA_RATIOS.items()})


PUBLISHED = ["schools", "students", "sub_schools", "pc_schools", "sub_students", "pc_students", "average_cohort"]
PUBLISHED_GRADES = ["grade_avg_sch", "grade_avg_sub_students", "grade_avg_subject"]


def criteria_report(
    profiles: DataFrame, tables: dict[str, dict[str, Column]], by: Sequence[str] = (), grades: bool = True,
    extra: Sequence[str] = (),
) -> DataFrame:
    """The published tables of all criteria, stages and years (``by``) as one table, masked, each with its totals row."""
    names = label_columns(max(len(labels) for labels in tables.values()))
    table = criteria_counts(profiles, tables, by, extra)
    table = disclose.mask_small_groups(table, SMALL_GROUP_RULES, F.col("is_total"))
    return table.select(*by, "criterion", *names, *PUBLISHED, *(PUBLISHED_GRADES if grades else []), *extra)


def provision_by_criteria(
    profiles: DataFrame, labels: Sequence[str], grades: bool = True, extra: Sequence[str] = ()
) -> DataFrame:
    """The published provision table of one criterion; every criterion shares the same provider profiles."""
    table = criteria_report(profiles, {labels[0]: {c: F.col(c) for c in labels}}, grades=grades, extra=extra)
    return table.drop("criterion").withColumnsRenamed(dict(zip(label_columns(len(labels)), labels)))


def criteria() -> dict[str, dict[str, Column]]:
    """Criterion -> label columns, each derived from provider attributes."""
    sch_type, selective = F.col("sch_type"), F.col("selective")
    return {
        "all": {"provider": F.col("provider").cast("string")},
        "lea": {"authority": F.col("authority")},
        "region": {"region": F.col("region")},
        "type": {"sch_type": sch_type},
        "trust": {"trust": F.col("trust")},
        "schGender": {"sch_gender": F.col("sch_gender")},
        "selective": {"class": scales.provider_class(sch_type, selective)},
        "selGender": {"sch_gender": F.col("sch_gender"), "class": scales.provider_class_3(sch_type, selective)},
        "UrbanRuralCombine": {"urban": scales.urban_class(F.col("sch_urban"))},
        "UrbanRuralALL": {"sch_urban": F.col("sch_urban")},
        "Coastal": {"coastal": F.when(F.col("near"), "Coastal").when(~F.col("near"), "Inland")},
    }


def criterion_labels(profiles: DataFrame, criterion: str) -> tuple[DataFrame, list[str]]:
    labels = criteria()[criterion]
    return profiles.withColumns(labels), list(labels)


def mixed_gender_provision(cohort: DataFrame, female: str = "F", male: str = "M") -> DataFrame:
    """Per (provider gender, class): providers of the focus, female and male takers, providers without females."""
    per_provider = (
        cohort.filter(sits())
        .withColumn("class", scales.provider_class(F.col("sch_type"), F.col("selective")))
        .groupBy("sch_gender", "class", "provider")
        .agg(count_if(F.col("gender") == female).alias("f"), count_if(F.col("gender") == male).alias("m"))
    )
    return (
        per_provider.groupBy("sch_gender", "class")
        .agg(
            F.count("*").alias("sub_providers"),
            F.sum("f").alias("females"),
            F.sum("m").alias("males"),
            count_if(F.col("f") == 0).alias("no_female_providers"),
            F.round(F.stddev_samp(F.col("f") + F.col("m")), 4).alias("sd_size"),
        )
        .withColumn("mean_size", ratio(F.col("females") + F.col("males"), "sub_providers", 4))
        .withColumn("pc_no_female", percent("no_female_providers", "sub_providers"))
        .withColumn("females", disclose.ceil_to(F.col("females")))
        .withColumn("males", disclose.ceil_to(F.col("males")))
    )


def mixed_no_female(mixed: DataFrame) -> DataFrame:
    """The mixed providers' rows and their totals."""
    sums = ["sub_providers", "females", "males", "no_female_providers"]
    table = totals.total_row(mixed.filter("sch_gender = 'Mixed'"), ["class"], sums)
    return table.select(
        F.when(F.col("is_total"), "").otherwise("Mixed").alias("sch_gender"), "class", *sums
    ).withColumn("pc_no_female", percent("no_female_providers", "sub_providers"))


def provider_grade_distribution(
    cohort: DataFrame, focus: str, grades: Sequence[int], attributes: Sequence[str] = ()
) -> DataFrame:
    """Takers per provider and gender, one column per grade headed ``<subject>_<grade>``."""
    counts = (
        cohort.filter(sits())
        .groupBy("provider", "gender", *attributes, F.col("focus_points").cast("int").alias("__grade"))
        .agg(F.count("*").alias("__n"))
    )
    return counts.groupBy("provider", "gender", *attributes).agg(
        *[F.sum(F.when(F.col("__grade") == g, F.col("__n"))).alias(f"{focus}_{g}") for g in grades]
    )


def grade_distribution(cohort: DataFrame, letter: Column) -> DataFrame:
    """Counts and percentages per grade letter, overall, by gender and by flag; absent letters count 0."""
    takers = cohort.filter(sits()).select("gender", "flag", letter.alias("grade")).filter(F.col("grade").isNotNull())
    cells = takers.groupBy("gender", "flag", "grade").agg(F.count("*").alias("n"))
    kinds = cells.groupingSets(
        [[F.col("grade")], [F.col("gender"), F.col("grade")], [F.col("flag"), F.col("grade")]], "gender", "flag", "grade"
    ).agg(F.sum("n").alias("n"), F.grouping("gender").alias("__g"), F.grouping("flag").alias("__f"))
    kind = (
        F.when(F.col("__g") == 0, F.col("gender"))
        .when(F.col("__f") == 0, F.col("flag").cast("string"))
        .otherwise("overall")
    )
    scope = F.when(F.col("__g") == 0, "gender").when(F.col("__f") == 0, "flag").otherwise("overall")
    counts = kinds.select(scope.alias("scope"), kind.alias("type"), "grade", "n")
    letters = counts.agg(F.sort_array(F.collect_set("grade"))).scalar()
    grid = counts.select("scope", "type").distinct().withColumn("grade", F.explode(letters))
    full = null_safe_join(grid, counts, ["scope", "type", "grade"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("scope", "type"))
    return full.withColumn("percentage", percent(F.col("n"), total, 4))


# --- clusters of providers ------------------------------------------------------------------------------------


def _cut_points(providers: DataFrame, size: str, descending: bool) -> Column:
    """The sizes at ranks ceil(0.2 k n), k = 1..5, as one array: read off the cumulative histogram of sizes.

    The histogram has one row per distinct size; that, not the providers, is what the window orders.
    """
    order = F.desc(size) if descending else F.asc(size)
    histogram = providers.groupBy(size).agg(F.count("*").alias("__n"))
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(Window.partitionBy())})
    pick = F.min if not descending else F.max
    bars = [
        pick(F.when(F.col("__upto") >= F.ceil(F.col("__all") * k / 5), F.col(size))) for k in range(1, 6)
    ]
    return ranked.agg(F.array(*bars).alias("bars")).scalar()


def _cluster_shares(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("cluster")
        .agg(
            count_if(F.col("offers")).alias("entries"),
            count_if(~F.col("offers")).alias("no_entries"),
            F.first("bars").alias("bars"),
            F.max("size").alias("largest"),
        )
        .withColumn("pc_entries", percent("entries", F.col("entries") + F.col("no_entries"), 4))
        .withColumn("pc_no_entries", percent("no_entries", F.col("entries") + F.col("no_entries"), 4))
    )


def provision_by_size_cluster(cohort: DataFrame) -> DataFrame:
    """Providers in five groups by size: with and without the focus, and the size range as a label."""
    sizes = cohort.groupBy("provider").agg(F.count("*").alias("size"), F.max(sits()).alias("offers"))
    bar = lambda k: F.col("bars")[k - 1]
    size = F.col("size")
    placed = sizes.withColumn("bars", _cut_points(sizes, "size", True)).withColumn(
        "cluster",
        F.when(size <= bar(4), 1).when(size <= bar(3), 2).when(size <= bar(2), 3).when(size <= bar(1), 4).otherwise(5),
    )
    low = [bar(5), bar(4), bar(3), bar(2), bar(1)]
    high = [bar(4) - 1, bar(3) - 1, bar(2) - 1, bar(1) - 1, F.col("largest")]
    return _cluster_shares(placed).withColumn("label", _range_label(low, high)).drop("bars", "largest")


def provision_by_breadth_cluster(facts: DataFrame, focus: str) -> DataFrame:
    """Providers in five groups by number of subjects offered."""
    breadth = provider_subject_count(facts, focus).select(
        "provider", F.col("n_subjects").alias("size"), F.col("offers_focus").alias("offers")
    )
    bar = lambda k: F.col("bars")[k - 1]
    size = F.col("size")
    placed = breadth.withColumn("bars", _cut_points(breadth, "size", False)).withColumn(
        "cluster",
        F.when(size >= bar(4), 5).when(size >= bar(3), 4).when(size >= bar(2), 3).when(size >= bar(1), 2).otherwise(1),
    )
    low = [F.lit(1), bar(1) + 1, bar(2) + 1, bar(3) + 1, bar(4) + 1]
    high = [bar(1), bar(2), bar(3), bar(4), bar(5)]
    return _cluster_shares(placed).withColumn("label", _range_label(low, high)).drop("bars", "largest")


def _range_label(low: Sequence[Column], high: Sequence[Column]) -> Column:
    texts = [F.concat_ws("-", a.cast("string"), b.cast("string")) for a, b in zip(low, high)]
    return F.element_at(F.array(*texts), F.col("cluster"))


def cohort_size_cumulative(facts: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Histogram of provider cohort sizes per subject with cumulative count and per cent."""
    histogram = (
        profile.provider_subjects(facts.filter(F.col("subject").isin(list(subjects))))
        .groupBy("subject", F.col("takers").alias("size"))
        .agg(F.count("*").alias("n"))
    )
    return rank.running_total(histogram, ["subject"], "size")


def cohort_size_by_subject(facts: DataFrame, focus: str, k: int) -> DataFrame:
    """Cohort size per (subject, provider) for the top-k subjects and for ALL, with the 90th percentile."""
    sizes = profile.provider_subjects(facts).withColumnRenamed("takers", "size")
    totals_by_subject = sizes.groupBy("subject").agg(F.sum("size").alias("n"))
    top = rank.keep_top(totals_by_subject, focus, k).select("subject")
    everything = sizes.withColumn("subject", F.lit("ALL"))
    both = sizes.join(top, "subject").select("subject", "provider", "size").unionByName(
        everything.select("subject", "provider", "size")
    )
    upper = rank.group_quantiles(both, ["subject"], "size", {"upper": 0.9})
    return null_safe_join(both, upper, ["subject"], "inner")


# --- demographic shares ---------------------------------------------------------------------------------------


def share_vs_population(cohort: DataFrame, category: str) -> DataFrame:
    """Per category: population, takers, and takers as a share of it."""
    return (
        cohort.filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(F.count("*").alias("total"), F.count("focus_points").alias("sub_total"))
        .filter("sub_total > 0")
        .withColumn("percentage", percent("sub_total", "total", 4))
    )


def ethnicity_breakdown(cohort: DataFrame, category: str = "ethnicity") -> DataFrame:
    """Population and takers per category, with the difference from the overall rate (blank categories out)."""
    table = (
        cohort.filter(F.coalesce(category, F.lit("")) != "")
        .groupBy(category)
        .agg(F.count("*").alias("total"), F.count("focus_points").alias("sub_total"))
    )
    everyone = Window.partitionBy()
    population, takers = F.sum("total").over(everyone), F.sum("sub_total").over(everyone)
    overall = takers / population
    table = table.withColumns({
        "pc_population": percent(F.col("total"), population, 2),
        "pc_sub": percent(F.col("sub_total"), takers, 2),
        "difference": F.round(100 * F.try_divide(F.col("sub_total") / F.col("total") - overall, overall), 2),
    })
    return table


def ethnicity_breakdown_minor(cohort: DataFrame, major: str = "ethnicity", minor: str = "eth_minor") -> DataFrame:
    """Two-level population and takers with shares; joined on both levels, so nothing is duplicated."""
    table = cohort.groupBy(major, minor).agg(F.count("*").alias("total"), F.count("focus_points").alias("n"))
    everyone = Window.partitionBy()
    return table.select(
        major, minor, "total",
        percent(F.col("total"), F.sum("total").over(everyone), 4).alias("pc_population"),
        F.nullif("n", F.lit(0)).alias("sub_total"),
        percent(F.nullif("n", F.lit(0)), F.sum("n").over(everyone), 4).alias("pc_sub"),
    )


def flag_share_by_group(cohort: DataFrame, group: str, flag: str = "flag", takers_only: bool = True) -> DataFrame:
    """Per (group, flag): pupils and share of the group; nulls of either left out."""
    known = cohort.filter(F.col(group).isNotNull() & F.col(flag).isNotNull())
    if takers_only:
        known = known.filter(sits())
    counts = known.groupBy(group, flag).agg(F.count("*").alias("n"))
    return rank.group_total_share(counts, [group]).withColumnRenamed("total", "cohort")


def population_flag_share(cohort: DataFrame, group: str, flag: str = "flag") -> DataFrame:
    """Population shares of the flag by group and over all groups."""
    by_group = flag_share_by_group(cohort, group, flag, takers_only=False)
    known = cohort.filter(F.col(flag).isNotNull()).groupBy(flag).agg(F.count("*").alias("n"))
    overall = rank.group_total_share(known, []).withColumnRenamed("total", "cohort").withColumn(group, F.lit("All"))
    return by_group.unionByName(overall)


# --- areas ----------------------------------------------------------------------------------------------------


def area_summary(cohort: DataFrame, areas: Sequence[str], with_total: bool = True) -> DataFrame:
    """Per area: providers, pupils, takers and their providers, with ratios and totals (null area out)."""
    per_provider = (
        cohort.filter(F.col(areas[0]).isNotNull())
        .groupBy(*areas, "provider")
        .agg(F.count("*").alias("students"), F.count("focus_points").alias("sub_students"))
    )
    table = per_provider.groupBy(*areas).agg(
        F.count("*").alias("schools"),
        F.sum("students").alias("students"),
        count_if(F.col("sub_students") > 0).alias("sub_schools"),
        F.sum("sub_students").alias("sub_students"),
    )
    if with_total:
        table = totals.total_row(table, areas, ["schools", "students", "sub_schools", "sub_students"]).drop("is_total")
    return table.withColumns({
        "pc_schools": percent("sub_schools", "schools", 4),
        "pc_students": percent("sub_students", "students", 4),
        "average_cohort": ratio("sub_students", "sub_schools", 4),
    })


def area_flag_totals(cohort: DataFrame, category: str, area: str, areas: Sequence[str]) -> DataFrame:
    """Takers by category and area within a set of areas."""
    return (
        cohort.filter(sits() & F.col(area).isin(list(areas)))
        .groupBy(category, area)
        .agg(F.count("*").alias("total"))
    )


def small_areas(cohort: DataFrame, area: str, limit: int = 20) -> DataFrame:
    """Areas with fewer takers than the limit."""
    return (
        cohort.filter(F.col(area).isNotNull()).groupBy(area).agg(F.count("focus_points").alias("sub_total"))
        .filter(F.col("sub_total") < limit)
    )


def provider_cohort_locations(cohort: DataFrame, providers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Provider cohort by gender with the provider's own columns."""
    return provider_size(cohort, by_gender=True).join(providers.select("provider", *columns), "provider", "left")


# --- access ---------------------------------------------------------------------------------------------------


def subject_access_all(facts: DataFrame, by: Sequence[str] = (), bound: int = scales.FIRST_INVALID_PROVIDER) -> DataFrame:
    """For every subject: providers offering it, pupils at those providers, takers, with percentages.

    Providers from ``bound`` on are not valid and left out. One job for all subjects: facts shrink to (provider, subject) takers, which meet the provider sizes.
    """
    by = list(by)
    facts = valid_providers(facts, bound)
    offered = facts.groupBy(*by, "provider", "subject").agg(F.count("*").alias("takers"))
    sizes = (
        facts.groupBy(*by, "pupil", "provider").agg(F.lit(1).alias("one"))
        .groupBy(*by, "provider").agg(F.count("*").alias("students"))
    )
    table = (
        offered.join(sizes, [*by, "provider"])
        .groupBy(*by, "subject")
        .agg(
            F.count("*").alias("providers"),
            F.sum("students").alias("students_with_access"),
            F.sum("takers").alias("takers"),
        )
    )
    overall = sizes.groupBy(*by).agg(F.count("*").alias("__providers"), F.sum("students").alias("__students"))
    if by:
        table = table.join(overall, by)
    else:
        whole = overall.select(F.struct("__providers", "__students").alias("whole")).scalar()
        table = table.withColumn("__whole", whole).select("*", "__whole.*").drop("__whole")
    return table.withColumns({
        "pc_providers": percent("providers", "__providers"),
        "pc_with_access": percent("students_with_access", "__students"),
        "pc_of_all": percent("takers", "__students"),
        "pc_of_offered": percent("takers", "students_with_access"),
    }).drop("__providers", "__students")


def subject_access(cohort: DataFrame, focus: str, bound: int = scales.FIRST_INVALID_PROVIDER) -> DataFrame:
    """Access figures of one subject from the (pupil, provider) rows of valid providers."""
    per_provider = valid_providers(cohort, bound).groupBy("provider").agg(
        F.count("*").alias("students"), F.count("focus_points").alias("takers")
    )
    offers = F.col("takers") > 0
    return per_provider.agg(
        count_if(offers).alias("providers"),
        F.coalesce(F.sum(F.when(offers, F.col("students"))), F.lit(0)).alias("students_with_access"),
        F.coalesce(F.sum("takers"), F.lit(0)).alias("takers"),
        F.count("*").alias("__providers"),
        F.sum("students").alias("__students"),
    ).select(
        F.lit(focus).alias("subject"), "providers", "students_with_access", "takers",
        percent("providers", "__providers").alias("pc_providers"),
        percent("students_with_access", "__students").alias("pc_with_access"),
        percent("takers", "__students").alias("pc_of_all"),
        percent("takers", "students_with_access").alias("pc_of_offered"),
    )


def qualification_variant_providers(results: DataFrame, focus: str, variant: Column) -> DataFrame:
    """Per provider class: results and providers of the variant qualification and of the rest."""
    rows = results.filter((F.col("subject") == focus) | variant).withColumns({
        "variant": variant,
        "class": scales.provider_class(F.col("sch_type"), F.col("selective")),
    })
    per_provider = rows.groupBy("class", "provider").agg(
        count_if(~F.col("variant")).alias("s"), count_if(F.col("variant")).alias("v")
    )
    return per_provider.groupBy("class").agg(
        F.sum("s").alias("standard_students"), F.sum("v").alias("variant_students"),
        count_if(F.col("s") > 0).alias("standard_providers"), count_if(F.col("v") > 0).alias("variant_providers"),
    )


def cohort_percentage(cohort: DataFrame, focus: str, resolution: int = 10) -> DataFrame:
    """Share of each provider's pupils taking the focus, rounded up to the resolution."""
    table = cohort.groupBy("provider").agg(F.count("*").alias("total"), F.count("focus_points").alias("__n"))
    share = F.ceil(F.round(F.lit(100.0) * F.col("__n") / F.col("total") / resolution, 9)) * resolution
    return table.select("provider", "total", share.cast("double").alias("per"), F.lit(focus).alias("subject"))


def provider_uptake(cohort: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Providers with the focus: class, attributes, pupils, takers and share."""
    return (
        cohort.groupBy("provider", *attributes)
        .agg(F.count("*").alias("students"), F.count("focus_points").alias("sub_students"))
        .filter("sub_students > 0")
        .withColumn("class", scales.provider_class_3(
            F.col("sch_type"), F.col("selective"), "independent", ("Independent", "Selective", "Non-Selective")))
        .withColumn("percentage", percent("sub_students", "students", 4))
    )


# --- several subjects -----------------------------------------------------------------------------------------


def subject_group_share(facts: DataFrame, people: DataFrame, key: str, group: str, focus: str, k: int = 20) -> DataFrame:
    """Per top-k subject: entries and share by a pupil or provider attribute."""
    counts = facts.join(people.select(key, group), key, "left").groupBy("subject", group).agg(F.count("*").alias("n"))
    return rank.group_total_share(rank.keep_top(counts, focus, k), ["subject"], digits=4)


def offer_overlap(facts: DataFrame, first: str, second: str) -> DataFrame:
    """Providers offering the first, the second and both subjects."""
    offers = (
        facts.filter(F.col("subject").isin(first, second)).groupBy("provider")
        .agg(F.max(F.col("subject") == first).alias("a"), F.max(F.col("subject") == second).alias("b"))
    )
    return offers.agg(
        count_if(F.col("a")).alias("first"), count_if(F.col("b")).alias("second"),
        count_if(F.col("a") & F.col("b")).alias("both"),
    )


def _beside(facts: DataFrame, focus: str) -> DataFrame:
    """Facts of the entries that take the focus."""
    takers = facts.filter(F.col("subject") == focus).select("pupil", "provider")
    return facts.join(takers, ["pupil", "provider"], "left_semi")


def subject_combinations(facts: DataFrame, focus: str) -> DataFrame:
    """Per subject taken beside the focus: pupils, share of focus takers, share of that subject's takers."""
    beside = _beside(facts, focus).groupBy("subject").agg(F.count("*").alias("together"))
    takers = facts.groupBy("subject").agg(F.count("*").alias("takers"))
    focus_takers = facts.filter(F.col("subject") == focus).agg(F.count("*")).scalar()
    return beside.join(takers, "subject").withColumns({
        "pc_of_focus": percent(F.col("together"), focus_takers, 4),
        "pc_of_subject": percent("together", "takers", 4),
    })


def combinations_vs_population(facts: DataFrame, entries: DataFrame, names: DataFrame, focus: str, n: int) -> DataFrame:
    """Per subject: share of all pupils and share of focus takers; the n most taken, ties included."""
    takers = facts.groupBy("subject").agg(F.count("*").alias("n"))
    beside = _beside(facts, focus).groupBy("subject").agg(F.count("*").alias("__together"))
    whole = entries.agg(F.struct(F.count("*").alias("all"), F.count("focus_points").alias("focus")).alias("whole")).scalar()
    table = (
        takers.filter(F.col("subject") != focus).join(beside, "subject", "left").withColumn("__whole", whole)
        .withColumns({
            "pc_all": percent(F.col("n"), F.col("__whole.all"), 4),
            "pc_focus": percent(F.coalesce("__together", F.lit(0)), F.col("__whole.focus"), 4),
        })
        .drop("__together", "__whole")
    )
    return rank.top_n_ties(table, n, "n").join(names, "subject", "left")


def combinations_by_gender(facts: DataFrame, pupils: DataFrame, focus: str, rows: int = 20) -> DataFrame:
    """Entries beside the focus by gender, the pair total, share of focus takers; the first rows by pair total."""
    beside = _beside(facts, focus).join(pupils.select("pupil", "gender"), "pupil", "left")
    counts = beside.groupBy("subject", "gender").agg(F.count("*").alias("n"))
    counts = counts.withColumn("pair_total", F.sum("n").over(Window.partitionBy("subject")))
    focus_takers = facts.filter(F.col("subject") == focus).agg(F.count("*")).scalar()
    return (
        counts.filter(F.col("subject") != focus)
        .withColumn("percentage", percent(F.col("n"), focus_takers))
        .orderBy(F.desc("pair_total"), "subject", F.asc_nulls_first("gender"))
        .limit(rows)
    )


def provider_subject_summary(
    facts: DataFrame, pupils: DataFrame, providers: DataFrame, tasks: int | None = None
) -> DataFrame:
    """Per provider, subject, flag and gender: entries; with the provider's pupils, class and area.

    Groups are nearly as many as the facts: with ``tasks`` they are dealt over so many. The provider's row is looked up.
    """
    keys = ["provider", "subject", "flag", "gender"]
    rows = facts.join(pupils.select("pupil", "flag", "gender"), "pupil", "left").select(*keys)
    if tasks is not None:
        rows = dealt(rows, tasks, *keys)
    entries = rows.groupBy(*keys).agg(F.count("*").alias("entries"))
    sizes = profile.provider_sizes(facts)
    places = providers.select(
        "provider", "area",
        scales.provider_class_3(F.col("sch_type"), F.col("selective"), "inde",
                                ("Independent", "Selective", "Comprehensive")).alias("class"),
    )
    return entries.join(looked_up(sizes.join(places, "provider", "left")), "provider")


def class_subject_summary(summary: DataFrame, focus: str) -> DataFrame:
    """Class totals, class x focus providers and class x focus x gender entries and providers, joined by grain."""
    per_provider = summary.groupBy("class", "provider").agg(F.sum("entries").alias("entries"))
    classes = per_provider.groupBy("class").agg(
        F.count("*").alias("class_providers"), F.sum("entries").alias("class_entries")
    )
    chosen = (
        summary.filter(F.col("subject") == focus).groupBy("class", "provider", "gender").agg(F.sum("entries").alias("entries"))
    )
    subject = chosen.groupBy("class").agg(F.countDistinct("provider").alias("subject_providers"))
    gender = chosen.groupBy("class", "gender").agg(
        F.sum("entries").alias("gender_entries"), F.count("*").alias("gender_providers")
    )
    return gender.join(classes, "class").join(subject, "class")


# --- areas by category ----------------------------------------------------------------------------------------


def resolution_share(cohort: DataFrame, area: str, category: str) -> DataFrame:
    """Per area and category: area total, category total, area takers, category takers and their share."""
    counts = cohort.groupBy(area, category).agg(
        F.count("*").alias("total"), F.count("focus_points").alias("sub_students")
    )
    within = Window.partitionBy(area)
    return counts.withColumns({
        "area_total": F.sum("total").over(within), "sub_total": F.sum("sub_students").over(within),
    }).withColumn("pc_of_sub", F.coalesce(percent("sub_students", "sub_total"), F.lit(0.0)))


def resolution_providers(cohort: DataFrame, area: str, category: str, value) -> DataFrame:
    """Per area: providers, providers with the focus, and those where a taker has the category value."""
    per_provider = cohort.groupBy(area, "provider").agg(
        F.max(sits()).alias("sub"), F.max(sits() & F.coalesce(F.col(category) == value, F.lit(False))).alias("with_value")
    )
    return per_provider.groupBy(area).agg(
        F.count("*").alias("providers"), count_if(F.col("sub")).alias("sub_providers"),
        count_if(F.col("with_value")).alias("value_providers"),
    )


def provider_type_stats(entries: DataFrame, students: DataFrame, subject: str, qualification) -> DataFrame:
    """Per provider type: providers, providers and entries of one subject and qualification, cohort mean and median.

    ``entries`` has one row per (type, provider, subject, qualification) with its number of entries.
    """
    chosen = (F.col("subject") == subject) & (F.col("qualification") == qualification)
    table = (
        entries.filter(F.col("type").isNotNull())
        .groupBy("type")
        .agg(
            F.countDistinct("provider").alias("providers"),
            count_if(chosen).alias("sub_providers"),
            F.coalesce(F.sum(F.when(chosen, F.col("entries"))), F.lit(0)).alias("sub_students"),
        )
    )
    medians = rank.group_quantiles(entries.filter(chosen), ["type"], "entries", {"median_cohort": 0.5})
    table = table.join(students, "type", "left")
    sums = ["providers", "students", "sub_providers", "sub_students"]
    with_total = totals.total_row(table, ["type"], sums, total="Total").drop("is_total")
    return null_safe_join(with_total, medians, ["type"], "left").withColumns({
        "pc_providers": percent("sub_providers", "providers"),
        "pc_students": percent("sub_students", "students"),
        "average_cohort": ratio("sub_students", "sub_providers"),
        "median_cohort": F.round("median_cohort", 1),
    })


# --- where offered, gender mix --------------------------------------------------------------------------------


def uptake_where_offered(cohort: DataFrame, groups: Sequence[str], flag: str = "flag") -> DataFrame:
    """At providers with the focus: per group and flag, takers and their share, as "n (p%)" columns per flag."""
    offering = cohort.filter(sits()).select("provider").distinct()
    counts = (
        cohort.join(offering, "provider", "left_semi")
        .groupBy(*groups, flag).agg(F.count("*").alias("__all"), F.count("focus_points").alias("n"))
        .filter("n > 0")
        .withColumn("per", percent("n", "__all"))
    )
    known = counts.filter(F.col(flag).isNotNull())
    out = []
    for value in (0, 1):
        hit = F.col(flag) == value
        n, per = F.max(F.when(hit, F.col("n"))), F.max(F.when(hit, F.col("per")))
        out += [n.alias(f"n_{value}"), F.format_string("%d (%.1f%%)", n, per).alias(f"label_{value}")]
    table = known.groupBy(*groups).agg(*out)
    for value in (0, 1):
        table = table.withColumn(f"label_{value}", F.when(F.col(f"n_{value}").isNotNull(), F.col(f"label_{value}")))
    return table


def provider_mean_contrast(facts: DataFrame, attribute: str, focus: str) -> DataFrame:
    """Mean of provider means of the attribute subject: takers of the focus there, against providers without it.

    A provider counts as having the focus when some pupil sits both subjects.
    """
    paired = profile.with_focus_points(facts.filter(F.col("subject").isin(attribute, focus)), focus)
    per_provider = paired.filter(F.col("subject") == attribute).groupBy("provider").agg(
        F.avg("points").alias("all_mean"),
        F.avg(F.when(F.col("focus_points").isNotNull(), F.col("points"))).alias("taker_mean"),
    )
    without = F.col("taker_mean").isNull()
    return per_provider.agg(
        F.round(F.avg("taker_mean"), 6).alias("with_mean"), F.count("taker_mean").alias("with_n"),
        F.round(F.avg(F.when(without, F.col("all_mean"))), 6).alias("without_mean"), count_if(without).alias("without_n"),
    )


def female_provision(cohort: DataFrame, female: str = "F") -> DataFrame:
    """Females only, per provider gender: providers, pupils, providers with the focus, takers, shares."""
    per_provider = cohort.filter(F.col("gender") == female).groupBy("sch_gender", "provider").agg(
        F.count("*").alias("students"), F.count("focus_points").alias("sub_students")
    )
    return per_provider.groupBy("sch_gender").agg(
        F.count("*").alias("schools"), F.sum("students").alias("students"),
        count_if(F.col("sub_students") > 0).alias("sub_schools"), F.sum("sub_students").alias("sub_students"),
    ).withColumns({
        "pc_schools": percent("sub_schools", "schools", 4), "pc_students": percent("sub_students", "students", 4),
    })


def provider_gender_mix(cohort: DataFrame) -> DataFrame:
    """Distinct providers per provider gender with shares, over all and over those with the focus."""
    per_provider = cohort.filter(F.col("sch_gender").isNotNull()).groupBy("sch_gender", "provider").agg(F.max(sits()).alias("sub"))
    table = per_provider.groupBy("sch_gender").agg(F.count("*").alias("n"), count_if(F.col("sub")).alias("sub_n"))
    everyone = Window.partitionBy()
    return table.withColumns({
        "share": ratio(F.col("n"), F.sum("n").over(everyone), 6),
        "sub_share": ratio(F.col("sub_n"), F.sum("sub_n").over(everyone), 6),
    })


def dataset_totals(cohort: DataFrame, bound: int = scales.FIRST_INVALID_PROVIDER) -> DataFrame:
    """Distinct providers and pupils, valid and invalid, with the focus, and pupils by gender."""
    per_provider = cohort.groupBy("provider").agg(
        F.count("*").alias("n"), F.count("focus_points").alias("sub"),
        count_if(F.col("gender") == "F").alias("f"), count_if(F.col("gender").isNotNull() & (F.col("gender") != "F")).alias("m"),
    )
    valid = F.col("provider") < bound
    zero = F.lit(0)
    return per_provider.agg(
        count_if(valid).alias("valid_providers"), count_if(~valid).alias("invalid_providers"),
        count_if(valid & (F.col("sub") > 0)).alias("sub_providers"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), zero).alias("invalid_entries"),
        F.sum("n").alias("entries"), F.sum("sub").alias("sub_entries"),
        F.sum("f").alias("female_entries"), F.sum("m").alias("male_entries"),
    )


def no_provision_list(table: DataFrame, label: str) -> DataFrame:
    """Categories without a single provider, and all of them as one "label (n=..)" text."""
    none = table.filter(F.col("sub_schools") == 0).select(label, "schools")
    items = F.sort_array(F.collect_list(F.concat(F.col(label), F.lit(" (n="), F.col("schools").cast("string"), F.lit(")"))))
    return none.agg(F.count("*").alias("categories"), F.array_join(items, "; ").alias("listing"))


def grammar_by_region(providers: DataFrame) -> DataFrame:
    return providers.groupBy("region", "selective", "sch_type").agg(F.countDistinct("provider").alias("n"))


def training_supply(training: DataFrame, subject: str) -> DataFrame:
    """Providers of a subject with their postgraduates, and all other providers once each."""
    chosen = training.filter(F.col("subject") == subject).groupBy("provider").agg(F.sum("postgrads").alias("postgrads"))
    others = training.select("provider").distinct().join(chosen, "provider", "left_anti")
    return chosen.withColumn("offers", F.lit(True)).unionByName(
        others.withColumn("offers", F.lit(False)), allowMissingColumns=True
    )

