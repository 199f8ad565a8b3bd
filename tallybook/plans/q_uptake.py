"""Queries: subject uptake."""

from pyspark.sql import functions as F

from ..functions import scales
from ..operators import profile, spatial, uptake
from .q_link import SUBJECT_NAMES, subject_names
from .registry import query
from .testbed import FOCUS, SECOND


@query("provider_size", """SELECT provider, gender, count(DISTINCT pupil) AS students FROM cohort GROUP BY provider, gender
  UNION ALL SELECT provider, 'all', count(DISTINCT pupil) FROM cohort GROUP BY provider""")
def _(t):
    cohort = t.cohort()
    both = uptake.provider_size(cohort).withColumn("gender", F.lit("all"))
    return uptake.provider_size(cohort, by_gender=True).unionByName(both)


@query("provider_subject_count", f"""SELECT provider, count(DISTINCT subject) AS n_subjects, bool_or(subject = '{FOCUS}') AS offers_focus
  FROM facts GROUP BY provider""")
def _(t):
    return uptake.provider_subject_count(t.facts, FOCUS)


PROFILE_SQL = """profiles AS (SELECT provider, trust, sch_type, sch_gender, selective, sch_urban, authority, region, easting,
    count(*) AS students, round(sum(mean_points), 6) AS total_grade, count(focus_points) AS sub_students, sum(focus_points) AS sub_grade,
    round(sum(CASE WHEN focus_points IS NOT NULL THEN mean_points END), 6) AS sub_all_grades, CAST(1 AS BIGINT) AS schools,
    CAST(count(focus_points) > 0 AS BIGINT) AS sub_schools FROM cohort GROUP BY ALL)"""
ATTRIBUTES = ["trust", "sch_type", "sch_gender", "selective", "sch_urban", "authority", "region", "easting"]


def profiles(t):
    return uptake.provider_profile(t.cohort(), ATTRIBUTES)


@query("provider_profile", PROFILE_SQL + """ SELECT provider, trust, sch_type, sch_gender, selective, sch_urban, students, sub_students, schools, sub_schools,
    round(total_grade, 6) AS total_grade, sub_grade, round(sub_all_grades, 6) AS sub_all_grades FROM profiles""")
def _(t):
    return profiles(t).select(
        "provider", *ATTRIBUTES[:5], "students", "sub_students", "schools", "sub_schools",
        F.round("total_grade", 6).alias("total_grade"), "sub_grade", F.round("sub_all_grades", 6).alias("sub_all_grades"),
    )


SUMS = ["schools", "students", "sub_schools", "sub_students", "total_grade", "sub_all_grades", "sub_grade"]


def measures_sql() -> str:
    """Ratios and masks of a published table."""
    def mask(value, providers, students):
        return (f"CASE WHEN NOT is_total AND {providers} > {students} - 5 AND {students} = 0 THEN '0' "
                f"WHEN NOT is_total AND {providers} > {students} - 5 THEN 'X' ELSE {value} END")

    def decimal(expr):
        return f"CAST(coalesce(round(round({expr}, 9), 1), 0.0)::DOUBLE AS VARCHAR)"

    sub = ("sub_schools", "sub_students")
    return f"""CAST(schools AS BIGINT) AS schools, {mask("CAST(CAST(students AS BIGINT) AS VARCHAR)", "schools", "students")} AS students,
    CAST(sub_schools AS BIGINT) AS sub_schools, round(100.0 * sub_schools / schools, 1) AS pc_schools,
    {mask("CAST(CAST(sub_students AS BIGINT) AS VARCHAR)", *sub)} AS sub_students,
    {mask("CAST(round(100.0 * sub_students / students, 1)::DOUBLE AS VARCHAR)", *sub)} AS pc_students,
    {mask(decimal("sub_students / nullif(sub_schools, 0)"), *sub)} AS average_cohort,
    {mask(decimal("total_grade / nullif(students, 0)"), "schools", "students")} AS grade_avg_sch,
    {mask(decimal("sub_all_grades / nullif(sub_students, 0)"), *sub)} AS grade_avg_sub_students,
    {mask(decimal("sub_grade / nullif(sub_students, 0)"), *sub)} AS grade_avg_subject"""


def criteria_sql(labels: dict[str, str], source: str = "profiles") -> str:
    """The published table in SQL: group, round if any group is close, total, ratios, masks."""
    names = list(labels)
    cols = ", ".join(f"{e} AS {n}" for n, e in labels.items())
    keys = ", ".join(names)
    totals = ", ".join([f"'Totals' AS {names[0]}", *[f"'' AS {n}" for n in names[1:]]])
    grouped = ", ".join(f"coalesce(round(sum({c}), 6), 0) AS {c}" for c in SUMS)
    rounded = ", ".join(
        c if c != "sub_students" else
        "CASE WHEN (SELECT any_close FROM closest) AND sub_students <> 0 THEN greatest(round(sub_students / 5) * 5, 5) ELSE sub_students END AS sub_students"
        for c in SUMS)
    summed = ", ".join(f"sum({c}) AS {c}" for c in SUMS)
    return f"""labelled AS (SELECT {cols}, * EXCLUDE ({", ".join(n for n in names if n in PROFILE_COLUMNS) or "schools"}){', schools' if not any(n in PROFILE_COLUMNS for n in names) else ''} FROM {source}),
  grouped AS (SELECT {keys}, {grouped} FROM labelled WHERE {names[0]} IS NOT NULL AND {names[0]} NOT IN ('', 'Not applicable') GROUP BY {keys}),
  closest AS (SELECT coalesce(bool_or(sub_students <> 0 AND sub_schools > sub_students - 6), false) AS any_close FROM grouped),
  rounded AS (SELECT {keys}, {rounded} FROM grouped),
  u AS (SELECT {keys}, false AS is_total, {", ".join(SUMS)} FROM rounded UNION ALL SELECT {totals}, true, {summed} FROM rounded)
  SELECT {keys}, {measures_sql()} FROM u"""


PROFILE_COLUMNS = {"provider", "trust", "sch_type", "sch_gender", "selective", "sch_urban", "authority", "region", "easting"}
CLASS_SQL = """CASE WHEN contains(sch_type, 'special') THEN 'Special' WHEN contains(sch_type, 'inde') THEN 'Independent'
  WHEN contains(coalesce(selective, ''), 'Selective') THEN 'Grammar' ELSE 'Comprehensive' END"""
CLASS3_SQL = """CASE WHEN contains(sch_type, 'inde') THEN 'Independent' WHEN contains(coalesce(selective, ''), 'Selective')
  THEN 'Grammar school' ELSE 'State non-selective' END"""
CRITERIA_SQL = {
    "all": {"provider": "CAST(provider AS VARCHAR)"},
    "lea": {"authority": "authority"},
    "region": {"region": "region"},
    "type": {"sch_type": "sch_type"},
    "trust": {"trust": "trust"},
    "schGender": {"sch_gender": "sch_gender"},
    "selective": {"class": CLASS_SQL},
    "selGender": {"sch_gender": "sch_gender", "class": CLASS3_SQL},
    "UrbanRuralCombine": {"urban": "CASE WHEN contains(sch_urban, 'Rural') THEN 'Rural' WHEN sch_urban IS NOT NULL THEN 'Urban' END"},
    "UrbanRuralALL": {"sch_urban": "sch_urban"},
}


def register_criterion(criterion: str, key: str):
    @query(key, PROFILE_SQL + ", " + criteria_sql(CRITERIA_SQL[criterion]))
    def _(t):
        labelled, labels = uptake.criterion_labels(profiles(t), criterion)
        return uptake.provision_by_criteria(labelled, labels)


register_criterion("region", "provision_by_criteria")
for name in CRITERIA_SQL:
    if name != "region":
        register_criterion(name, f"provision_by_criteria_{name.lower()}")


# The coast stands in for itself as the suppliers' places on the same plane.
COAST_SQL = PROFILE_SQL + """, coast AS (SELECT s_acctbal * 100 AS e, s_suppkey * 100.0::DOUBLE AS n FROM supplier),
  near AS (SELECT provider, min(sqrt((easting - e) * (easting - e) + (northing - n) * (northing - n))) <= 5500 AS near FROM providers, coast GROUP BY provider),
  placed AS (SELECT p.*, near FROM profiles p LEFT JOIN near USING (provider)), """


COASTAL_SQL = {"coastal": "CASE WHEN near THEN 'Coastal' WHEN NOT near THEN 'Inland' END"}


def near_coast(t):
    coast = t.table("supplier").select((F.col("s_acctbal") * 100).alias("x"), (F.col("s_suppkey") * 100.0).alias("y"))
    places = t.providers.select("provider", F.col("easting").alias("x"), F.col("northing").alias("y"))
    return spatial.nearest_distance(places, coast, cutoff=5500).select("provider", "near")


@query("provision_by_criteria_coastal", COAST_SQL + criteria_sql(COASTAL_SQL, "placed"))
def _(t):
    labelled, labels = uptake.criterion_labels(profiles(t).join(near_coast(t), "provider", "left"), "Coastal")
    return uptake.provision_by_criteria(labelled, labels)


def report_sql(tables: dict[str, dict[str, str]], source: str, by: str) -> str:
    """All criteria's published tables by stage and year, in SQL."""
    def rows(criterion, labels):
        first, second = (*labels.values(), "''")[:2]
        return f"SELECT {by}, '{criterion}' AS criterion, {first} AS label, {second} AS label2, {', '.join(SUMS)} FROM {source}"

    grouped = ", ".join(f"coalesce(round(sum({c}), 6), 0) AS {c}" for c in SUMS)
    summed = ", ".join(f"sum({c}) AS {c}" for c in SUMS)
    return f"""cells AS ({" UNION ALL ".join(rows(c, labels) for c, labels in tables.items())}),
  grouped AS (SELECT {by}, criterion, label, label2, {grouped} FROM cells WHERE label IS NOT NULL AND label NOT IN ('', 'Not applicable') GROUP BY ALL),
  rounded AS (SELECT * REPLACE (CASE WHEN bool_or(sub_students <> 0 AND sub_schools > sub_students - 6) OVER (PARTITION BY {by}, criterion) AND sub_students <> 0
      THEN greatest(round(sub_students / 5) * 5, 5) ELSE sub_students END AS sub_students) FROM grouped),
  u AS (SELECT {by}, criterion, label, label2, false AS is_total, {", ".join(SUMS)} FROM rounded
    UNION ALL SELECT {by}, criterion, 'Totals', '', true, {summed} FROM rounded GROUP BY {by}, criterion)
  SELECT {by}, criterion, label, label2, {measures_sql()} FROM u"""


# Stage and year apart: a level is a stage, so an entry is a pupil's results of one level at one provider.
STAGED_SQL = f"""sfacts AS (SELECT level AS stage, year, pupil, provider, subject, max(points) AS points FROM results GROUP BY ALL),
  sentries AS (SELECT stage, year, pupil, provider, avg(points) AS mean_points, max(CASE WHEN subject = '{FOCUS}' THEN points END) AS focus_points FROM sfacts GROUP BY ALL),
  sprofiles AS (SELECT stage, year, provider, count(*) AS students, round(sum(mean_points), 6) AS total_grade, count(focus_points) AS sub_students, sum(focus_points) AS sub_grade,
    round(sum(CASE WHEN focus_points IS NOT NULL THEN mean_points END), 6) AS sub_all_grades, 1 AS schools, CAST(count(focus_points) > 0 AS BIGINT) AS sub_schools FROM sentries GROUP BY ALL),
  splaced AS (SELECT p.*, v.* EXCLUDE (provider), near FROM sprofiles p LEFT JOIN providers v USING (provider) LEFT JOIN near USING (provider)), """


@query("criteria_report", COAST_SQL + STAGED_SQL + report_sql(CRITERIA_SQL | {"Coastal": COASTAL_SQL}, "splaced", "stage, year"))
def _(t):
    facts = t.results.groupBy(F.col("level").alias("stage"), "year", "pupil", "provider", "subject").agg(F.max("points").alias("points"))
    entries = profile.entries(facts, FOCUS, ["stage", "year"])
    profiles = uptake.provider_profile(entries, ["stage", "year"]).join(t.providers, "provider", "left").join(near_coast(t), "provider", "left")
    return uptake.criteria_report(profiles, uptake.criteria(), ["stage", "year"])


MIXED_SQL = f"""per AS (SELECT sch_gender, {CLASS_SQL} AS class, provider, count(CASE WHEN gender = 'F' THEN 1 END) AS f, count(CASE WHEN gender = 'O' THEN 1 END) AS m
    FROM cohort WHERE focus_points IS NOT NULL GROUP BY ALL),
  mixed AS (SELECT sch_gender, class, count(*) AS sub_providers, CAST(ceil(sum(f) / 5) * 5 AS BIGINT) AS females, CAST(ceil(sum(m) / 5) * 5 AS BIGINT) AS males,
    count(CASE WHEN f = 0 THEN 1 END) AS no_female_providers, round(stddev_samp(f + m), 4) AS sd_size, round(sum(f + m) / count(*), 4) AS mean_size,
    round(100.0 * count(CASE WHEN f = 0 THEN 1 END) / count(*), 1) AS pc_no_female FROM per GROUP BY sch_gender, class)"""


@query("mixed_gender_provision", MIXED_SQL + " SELECT * FROM mixed")
def _(t):
    return uptake.mixed_gender_provision(t.cohort(), "F", "O")


@query("mixed_no_female", MIXED_SQL + """ SELECT sch_gender, class, sub_providers, females, males, no_female_providers, pc_no_female FROM mixed WHERE sch_gender = 'Mixed'
  UNION ALL SELECT '', 'Totals', sum(sub_providers)::BIGINT, sum(females)::BIGINT, sum(males)::BIGINT, sum(no_female_providers)::BIGINT,
    round(100.0 * sum(no_female_providers) / sum(sub_providers), 1) FROM mixed WHERE sch_gender = 'Mixed'""")
def _(t):
    return uptake.mixed_no_female(uptake.mixed_gender_provision(t.cohort(), "F", "O"))


@query("share_vs_population", """SELECT ethnicity, count(*) AS total, count(focus_points) AS sub_total, round(100.0 * count(focus_points) / count(*), 4) AS percentage
  FROM cohort WHERE ethnicity IS NOT NULL GROUP BY ethnicity HAVING count(focus_points) > 0""")
def _(t):
    return uptake.share_vs_population(t.cohort(), "ethnicity")


GRADES_SQL = ", ".join(
    f"nullif(count(CASE WHEN focus_points = {g} THEN 1 END), 0) AS \"{FOCUS}_{g}\"" for g in range(1, 51)
)


@query("provider_grade_distribution", f"SELECT provider, gender, sch_type, sch_gender, {GRADES_SQL} FROM cohort WHERE focus_points IS NOT NULL GROUP BY ALL")
def _(t):
    return uptake.provider_grade_distribution(t.cohort(), FOCUS, range(1, 51), ["sch_type", "sch_gender"])


LETTER_SQL = "substr('UGFEDCBA*', CAST(focus_points AS INTEGER) % 9 + 1, 1)"


@query("grade_distribution", f"""takers AS (SELECT gender, CAST(flag AS VARCHAR) AS flag, {LETTER_SQL} AS grade FROM cohort WHERE focus_points IS NOT NULL),
  c AS (SELECT 'overall' AS scope, 'overall' AS type, grade, count(*) AS n FROM takers GROUP BY ALL UNION ALL
    SELECT 'gender', gender, grade, count(*) FROM takers GROUP BY ALL UNION ALL SELECT 'flag', flag, grade, count(*) FROM takers GROUP BY ALL),
  g AS (SELECT * FROM (SELECT DISTINCT scope, type FROM c) CROSS JOIN (SELECT DISTINCT grade FROM c))
  SELECT g.*, coalesce(c.n, 0) AS n, round(100.0 * coalesce(c.n, 0) / sum(c.n) OVER (PARTITION BY g.scope, g.type), 4) AS percentage
  FROM g LEFT JOIN c ON g.scope = c.scope AND g.type IS NOT DISTINCT FROM c.type AND g.grade = c.grade""")
def _(t):
    return uptake.grade_distribution(t.cohort(), scales.points_to_letter(F.col("focus_points") % 9))


CLUSTER_TAIL = """, round(100.0 * entries / (entries + no_entries), 4) AS pc_entries, round(100.0 * no_entries / (entries + no_entries), 4) AS pc_no_entries"""


@query("provision_by_size_cluster", f"""s AS (SELECT provider, count(*) AS size, count(focus_points) > 0 AS offers FROM cohort GROUP BY provider),
  o AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS r, count(*) OVER () AS n FROM s),
  b AS (SELECT max(CASE WHEN r = ceil(n * 1 / 5) THEN size END) AS b1, max(CASE WHEN r = ceil(n * 2 / 5) THEN size END) AS b2,
    max(CASE WHEN r = ceil(n * 3 / 5) THEN size END) AS b3, max(CASE WHEN r = ceil(n * 4 / 5) THEN size END) AS b4, max(CASE WHEN r = n THEN size END) AS b5, max(size) AS top FROM o),
  c AS (SELECT CASE WHEN size <= b4 THEN 1 WHEN size <= b3 THEN 2 WHEN size <= b2 THEN 3 WHEN size <= b1 THEN 4 ELSE 5 END AS cluster,
    count(CASE WHEN offers THEN 1 END) AS entries, count(CASE WHEN NOT offers THEN 1 END) AS no_entries FROM s, b GROUP BY 1)
  SELECT cluster, entries, no_entries{CLUSTER_TAIL}, CASE cluster WHEN 1 THEN b5 || '-' || (b4 - 1) WHEN 2 THEN b4 || '-' || (b3 - 1) WHEN 3 THEN b3 || '-' || (b2 - 1)
    WHEN 4 THEN b2 || '-' || (b1 - 1) ELSE b1 || '-' || top END AS label FROM c, b""")
def _(t):
    return uptake.provision_by_size_cluster(t.cohort())


@query("provision_by_breadth_cluster", f"""s AS (SELECT provider, count(DISTINCT subject) AS size, bool_or(subject = '{FOCUS}') AS offers FROM facts GROUP BY provider),
  o AS (SELECT size, row_number() OVER (ORDER BY size) AS r, count(*) OVER () AS n FROM s),
  b AS (SELECT max(CASE WHEN r = ceil(n * 1 / 5) THEN size END) AS b1, max(CASE WHEN r = ceil(n * 2 / 5) THEN size END) AS b2,
    max(CASE WHEN r = ceil(n * 3 / 5) THEN size END) AS b3, max(CASE WHEN r = ceil(n * 4 / 5) THEN size END) AS b4, max(CASE WHEN r = n THEN size END) AS b5 FROM o),
  c AS (SELECT CASE WHEN size >= b4 THEN 5 WHEN size >= b3 THEN 4 WHEN size >= b2 THEN 3 WHEN size >= b1 THEN 2 ELSE 1 END AS cluster,
    count(CASE WHEN offers THEN 1 END) AS entries, count(CASE WHEN NOT offers THEN 1 END) AS no_entries FROM s, b GROUP BY 1)
  SELECT cluster, entries, no_entries{CLUSTER_TAIL}, CASE cluster WHEN 5 THEN (b4 + 1) || '-' || b5 WHEN 4 THEN (b3 + 1) || '-' || b4 WHEN 3 THEN (b2 + 1) || '-' || b3
    WHEN 2 THEN (b1 + 1) || '-' || b2 ELSE '1-' || b1 END AS label FROM c, b""")
def _(t):
    return uptake.provision_by_breadth_cluster(t.facts, FOCUS)


@query("cohort_size_cumulative", f"""s AS (SELECT subject, provider, count(*) AS size FROM facts WHERE subject IN ('{FOCUS}', '{SECOND}') GROUP BY ALL),
  h AS (SELECT subject, size, count(*) AS n FROM s GROUP BY ALL)
  SELECT *, sum(n) OVER (PARTITION BY subject ORDER BY size)::BIGINT AS cumulative, sum(n) OVER (PARTITION BY subject)::BIGINT AS total,
    round(100.0 * sum(n) OVER (PARTITION BY subject ORDER BY size) / sum(n) OVER (PARTITION BY subject), 1) AS per FROM h""")
def _(t):
    return uptake.cohort_size_cumulative(t.facts, [FOCUS, SECOND])


TOP_SQL = """n AS (SELECT subject, count(*) AS n FROM facts GROUP BY subject), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, subject) AS place FROM n),
  top AS (SELECT subject, n FROM r WHERE place <= {less} UNION ALL
    SELECT subject, n FROM r WHERE CASE WHEN (SELECT place FROM r WHERE subject = '{focus}') <= {k} THEN place = {k} ELSE subject = '{focus}' END)"""


def top_sql(k: int) -> str:
    return TOP_SQL.format(k=k, less=k - 1, focus=FOCUS)


@query("cohort_size_by_subject", top_sql(8) + """, s AS (SELECT subject, provider, count(*) AS size FROM facts GROUP BY ALL),
  u AS (SELECT * FROM s WHERE subject IN (SELECT subject FROM top) UNION ALL SELECT 'ALL', provider, size FROM s)
  SELECT *, quantile_cont(size, 0.9) OVER (PARTITION BY subject) AS upper FROM u""")
def _(t):
    return uptake.cohort_size_by_subject(t.facts, FOCUS, 8)


@query("ethnicity_breakdown", """t AS (SELECT ethnicity, count(*) AS total, count(focus_points) AS sub_total FROM cohort WHERE coalesce(ethnicity, '') <> '' GROUP BY ethnicity)
  SELECT *, round(100.0 * total / sum(total) OVER (), 2) AS pc_population, round(100.0 * sub_total / sum(sub_total) OVER (), 2) AS pc_sub,
    round(100.0 * (sub_total / total - sum(sub_total) OVER () / sum(total) OVER ()) / nullif(sum(sub_total) OVER () / sum(total) OVER (), 0), 2) AS difference FROM t""")
def _(t):
    return uptake.ethnicity_breakdown(t.cohort())


@query("ethnicity_breakdown_minor", """t AS (SELECT ethnicity, eth_minor, count(*) AS total, nullif(count(focus_points), 0) AS sub_total FROM cohort GROUP BY ALL)
  SELECT *, round(100.0 * total / sum(total) OVER (), 4) AS pc_population, round(100.0 * sub_total / sum(sub_total) OVER (), 4) AS pc_sub FROM t""")
def _(t):
    return uptake.ethnicity_breakdown_minor(t.cohort())


@query("provider_cohort_locations", """s AS (SELECT provider, gender, count(DISTINCT pupil) AS students FROM cohort GROUP BY ALL)
  SELECT s.*, easting, northing, sch_type FROM s LEFT JOIN providers USING (provider)""")
def _(t):
    return uptake.provider_cohort_locations(t.cohort(), t.providers, ["easting", "northing", "sch_type"])


def area_sql(area: str) -> str:
    return f"""t AS (SELECT {area}, count(DISTINCT provider) AS schools, count(*) AS students, count(DISTINCT CASE WHEN focus_points IS NOT NULL THEN provider END) AS sub_schools,
    count(focus_points) AS sub_students FROM cohort WHERE {area} IS NOT NULL GROUP BY {area}),
  u AS (SELECT * FROM t UNION ALL SELECT 'Totals', sum(schools)::BIGINT, sum(students)::BIGINT, sum(sub_schools)::BIGINT, sum(sub_students)::BIGINT FROM t)
  SELECT *, round(100.0 * sub_schools / schools, 4) AS pc_schools, round(100.0 * sub_students / students, 4) AS pc_students,
    round(sub_students / nullif(sub_schools, 0), 4) AS average_cohort FROM u"""


@query("authority_summary", area_sql("authority"))
def _(t):
    return uptake.area_summary(t.cohort(), ["authority"])


@query("area_summary", area_sql("area"))
def _(t):
    return uptake.area_summary(t.cohort(), ["area"])


@query("region_summary", area_sql("region"))
def _(t):
    return uptake.area_summary(t.cohort(), ["region"])


@query("flag_share_by_group", """t AS (SELECT gender, flag, count(*) AS n FROM cohort WHERE gender IS NOT NULL AND flag IS NOT NULL AND focus_points IS NOT NULL GROUP BY ALL),
  e AS (SELECT ethnicity, flag, count(*) AS n FROM cohort WHERE ethnicity IS NOT NULL AND flag IS NOT NULL AND focus_points IS NOT NULL GROUP BY ALL)
  SELECT gender AS grp, flag, n, sum(n) OVER (PARTITION BY gender)::BIGINT AS cohort, round(100.0 * n / sum(n) OVER (PARTITION BY gender), 2) AS share FROM t
  UNION ALL SELECT ethnicity, flag, n, sum(n) OVER (PARTITION BY ethnicity)::BIGINT, round(100.0 * n / sum(n) OVER (PARTITION BY ethnicity), 2) FROM e""")
def _(t):
    cohort = t.cohort()
    parts = [uptake.flag_share_by_group(cohort, g).withColumnRenamed(g, "grp") for g in ("gender", "ethnicity")]
    return parts[0].unionByName(parts[1])


@query("population_flag_share", """t AS (SELECT gender, flag, count(*) AS n FROM cohort WHERE flag IS NOT NULL GROUP BY ALL), o AS (SELECT flag, sum(n)::BIGINT AS n FROM t GROUP BY flag)
  SELECT gender, flag, n, sum(n) OVER (PARTITION BY gender)::BIGINT AS cohort, round(100.0 * n / sum(n) OVER (PARTITION BY gender), 2) AS share FROM t WHERE gender IS NOT NULL
  UNION ALL SELECT 'All', flag, n, sum(n) OVER ()::BIGINT, round(100.0 * n / sum(n) OVER (), 2) FROM o""")
def _(t):
    return uptake.population_flag_share(t.cohort(), "gender")


ACCESS_SQL = """s AS (SELECT provider, count(*) AS students FROM entries WHERE provider < 900000 GROUP BY provider), o AS (SELECT subject, provider, count(*) AS takers FROM facts WHERE provider < 900000 GROUP BY ALL),
  w AS (SELECT count(*) AS p, sum(students) AS n FROM s)
  SELECT subject, count(*) AS providers, sum(students)::BIGINT AS students_with_access, sum(takers)::BIGINT AS takers, round(100.0 * count(*) / any_value(p), 1) AS pc_providers,
    round(100.0 * sum(students) / any_value(n), 1) AS pc_with_access, round(100.0 * sum(takers) / any_value(n), 1) AS pc_of_all, round(100.0 * sum(takers) / sum(students), 1) AS pc_of_offered
  FROM o JOIN s USING (provider), w {where} GROUP BY subject"""


@query("subject_access", ACCESS_SQL.format(where=f"WHERE subject = '{FOCUS}'"))
def _(t):
    return uptake.subject_access(t.cohort(), FOCUS)


@query("subject_access_all", SUBJECT_NAMES + ", a AS (WITH " + ACCESS_SQL.format(where="") + ") SELECT a.*, subject_name FROM a LEFT JOIN names USING (subject)")
def _(t):
    return uptake.subject_access_all(t.facts).join(subject_names(t), "subject", "left")


@query("qualification_variant_providers", f"""r AS (SELECT r.*, {CLASS_SQL} AS class, qualification < 100 AS variant FROM results r LEFT JOIN providers USING (provider)
    WHERE subject = '{FOCUS}' OR qualification < 100)
  SELECT class, count(CASE WHEN NOT variant THEN 1 END) AS standard_students, count(CASE WHEN variant THEN 1 END) AS variant_students,
    count(DISTINCT CASE WHEN NOT variant THEN provider END) AS standard_providers, count(DISTINCT CASE WHEN variant THEN provider END) AS variant_providers FROM r GROUP BY class""")
def _(t):
    rows = t.results.join(t.providers.select("provider", "sch_type", "selective"), "provider", "left")
    return uptake.qualification_variant_providers(rows, FOCUS, F.col("qualification") < 100)


@query("cohort_percentage", f"""SELECT provider, count(*) AS total, ceil(round(100.0 * count(focus_points) / count(*) / 10, 9)) * 10.0::DOUBLE AS per, '{FOCUS}' AS subject
  FROM cohort GROUP BY provider""")
def _(t):
    return uptake.cohort_percentage(t.cohort(), FOCUS)


@query("provider_uptake", """SELECT provider, area, sch_type, sch_gender, selective, easting, northing, count(*) AS students, count(focus_points) AS sub_students,
    CASE WHEN contains(sch_type, 'independent') THEN 'Independent' WHEN contains(coalesce(selective, ''), 'Selective') THEN 'Selective' ELSE 'Non-Selective' END AS class,
    round(100.0 * count(focus_points) / count(*), 4) AS percentage FROM cohort GROUP BY ALL HAVING count(focus_points) > 0""")
def _(t):
    return uptake.provider_uptake(t.cohort(), ["area", "sch_type", "sch_gender", "selective", "easting", "northing"])


@query("subject_group_share", top_sql(20) + """, e AS (SELECT subject, ethnicity AS grp, count(*) AS n FROM facts LEFT JOIN pupils USING (pupil) WHERE subject IN (SELECT subject FROM top) GROUP BY ALL),
  s AS (SELECT subject, sch_type AS grp, count(*) AS n FROM facts LEFT JOIN providers USING (provider) WHERE subject IN (SELECT subject FROM top) GROUP BY ALL)
  SELECT *, sum(n) OVER (PARTITION BY subject)::BIGINT AS total, round(100.0 * n / sum(n) OVER (PARTITION BY subject), 4) AS share, 'ethnicity' AS attribute FROM e
  UNION ALL SELECT *, sum(n) OVER (PARTITION BY subject)::BIGINT, round(100.0 * n / sum(n) OVER (PARTITION BY subject), 4), 'sch_type' FROM s""")
def _(t):
    eth = uptake.subject_group_share(t.facts, t.pupils, "pupil", "ethnicity", FOCUS)
    kind = uptake.subject_group_share(t.facts, t.providers, "provider", "sch_type", FOCUS)
    return eth.withColumnRenamed("ethnicity", "grp").withColumn("attribute", F.lit("ethnicity")).unionByName(
        kind.withColumnRenamed("sch_type", "grp").withColumn("attribute", F.lit("sch_type"))
    )


@query("offer_overlap", f"""o AS (SELECT provider, bool_or(subject = '{FOCUS}') AS a, bool_or(subject = '{SECOND}') AS b FROM facts GROUP BY provider)
  SELECT count(CASE WHEN a THEN 1 END) AS first, count(CASE WHEN b THEN 1 END) AS second, count(CASE WHEN a AND b THEN 1 END) AS "both" FROM o""")
def _(t):
    return uptake.offer_overlap(t.facts, FOCUS, SECOND)


BESIDE_SQL = f"beside AS (SELECT f.* FROM facts f JOIN facts g ON f.pupil = g.pupil AND f.provider = g.provider AND g.subject = '{FOCUS}')"


@query("subject_combinations", BESIDE_SQL + f""", b AS (SELECT subject, count(*) AS together FROM beside GROUP BY subject), n AS (SELECT subject, count(*) AS takers FROM facts GROUP BY subject)
  SELECT subject, together, takers, round(100.0 * together / (SELECT takers FROM n WHERE subject = '{FOCUS}'), 4) AS pc_of_focus,
    round(100.0 * together / takers, 4) AS pc_of_subject FROM b JOIN n USING (subject)""")
def _(t):
    return uptake.subject_combinations(t.facts, FOCUS)


@query("combinations_vs_population", BESIDE_SQL + f""", {SUBJECT_NAMES}, b AS (SELECT subject, count(*) AS together FROM beside GROUP BY subject),
  n AS (SELECT subject, count(*) AS n FROM facts GROUP BY subject)
  SELECT n.subject, n.n, round(100.0 * n.n / (SELECT count(*) FROM entries), 4) AS pc_all,
    round(100.0 * coalesce(together, 0) / (SELECT count(focus_points) FROM entries), 4) AS pc_focus, subject_name
  FROM n LEFT JOIN b USING (subject) LEFT JOIN names USING (subject) WHERE n.subject <> '{FOCUS}' QUALIFY rank() OVER (ORDER BY n.n DESC) <= 15""")
def _(t):
    return uptake.combinations_vs_population(t.facts, t.cohort(), subject_names(t), FOCUS, 15)


@query("combinations_by_gender", BESIDE_SQL + f""", c AS (SELECT subject, gender, count(*) AS n FROM beside LEFT JOIN pupils USING (pupil) GROUP BY ALL)
  SELECT *, sum(n) OVER (PARTITION BY subject)::BIGINT AS pair_total, round(100.0 * n / (SELECT count(focus_points) FROM entries), 1) AS percentage
  FROM c WHERE subject <> '{FOCUS}' ORDER BY pair_total DESC, subject, gender NULLS FIRST LIMIT 20""")
def _(t):
    return uptake.combinations_by_gender(t.facts, t.pupils, FOCUS)


SUMMARY_SQL = """summary AS (SELECT f.provider, subject, flag, gender, count(*) AS entries FROM facts f LEFT JOIN pupils p ON f.pupil = p.pupil GROUP BY ALL),
  sizes AS (SELECT provider, count(DISTINCT pupil) AS students FROM facts GROUP BY provider),
  full_summary AS (SELECT s.*, students, area, CASE WHEN contains(sch_type, 'inde') THEN 'Independent' WHEN contains(coalesce(selective, ''), 'Selective') THEN 'Selective'
    ELSE 'Comprehensive' END AS class FROM summary s JOIN sizes USING (provider) LEFT JOIN providers USING (provider))"""


@query("provider_subject_summary", SUMMARY_SQL + " SELECT * FROM full_summary")
def _(t):
    return uptake.provider_subject_summary(t.facts, t.pupils, t.providers, t.tasks)


@query("class_subject_summary", SUMMARY_SQL + f""", c AS (SELECT class, count(DISTINCT provider) AS class_providers, sum(entries)::BIGINT AS class_entries FROM full_summary GROUP BY class),
  s AS (SELECT class, count(DISTINCT provider) AS subject_providers FROM full_summary WHERE subject = '{FOCUS}' GROUP BY class)
  SELECT class, gender, sum(entries)::BIGINT AS gender_entries, count(DISTINCT provider) AS gender_providers, any_value(class_providers) AS class_providers,
    any_value(class_entries) AS class_entries, any_value(subject_providers) AS subject_providers
  FROM full_summary JOIN c USING (class) JOIN s USING (class) WHERE subject = '{FOCUS}' GROUP BY class, gender""")
def _(t):
    return uptake.class_subject_summary(uptake.provider_subject_summary(t.facts, t.pupils, t.providers, t.tasks), FOCUS)


AREAS = ["E09000001", "E09000002", "E09000003", "E09000007", "E09000012"]


@query("area_flag_totals", f"""SELECT CAST(flag AS VARCHAR) AS category, area, count(*) AS total FROM cohort WHERE focus_points IS NOT NULL AND area IN {tuple(AREAS)} GROUP BY ALL
  UNION ALL SELECT gender, area, count(*) FROM cohort WHERE focus_points IS NOT NULL AND area IN {tuple(AREAS)} GROUP BY ALL""")
def _(t):
    cohort = t.cohort()
    flags = uptake.area_flag_totals(cohort, "flag", "area", AREAS).withColumn("flag", F.col("flag").cast("string"))
    genders = uptake.area_flag_totals(cohort, "gender", "area", AREAS)
    return flags.withColumnRenamed("flag", "category").unionByName(genders.withColumnRenamed("gender", "category"))


@query("small_areas", "SELECT area, count(focus_points) AS sub_total FROM cohort WHERE area IS NOT NULL GROUP BY area HAVING count(focus_points) < 80")
def _(t):
    return uptake.small_areas(t.cohort(), "area", 80)


@query("resolution_share", """t AS (SELECT authority, gender, count(*) AS total, count(focus_points) AS sub_students FROM cohort GROUP BY ALL),
  w AS (SELECT *, sum(total) OVER (PARTITION BY authority)::BIGINT AS area_total, sum(sub_students) OVER (PARTITION BY authority)::BIGINT AS sub_total FROM t)
  SELECT *, coalesce(round(100.0 * sub_students / nullif(sub_total, 0), 1), 0) AS pc_of_sub FROM w""")
def _(t):
    return uptake.resolution_share(t.cohort(), "authority", "gender")


@query("resolution_providers", """SELECT authority, count(DISTINCT provider) AS providers, count(DISTINCT CASE WHEN focus_points IS NOT NULL THEN provider END) AS sub_providers,
  count(DISTINCT CASE WHEN focus_points IS NOT NULL AND gender = 'F' THEN provider END) AS value_providers FROM cohort GROUP BY authority""")
def _(t):
    return uptake.resolution_providers(t.cohort(), "authority", "gender", "F")


@query("provider_type_stats", f"""e AS (SELECT sch_type AS type, provider, subject, level AS qualification, count(*) AS entries FROM results JOIN providers USING (provider) GROUP BY ALL),
  s AS (SELECT sch_type AS type, count(*) AS students FROM cohort GROUP BY sch_type),
  t AS (SELECT type, count(DISTINCT provider) AS providers, count(CASE WHEN subject = '{FOCUS}' AND qualification = 'A' THEN 1 END) AS sub_providers,
    sum(CASE WHEN subject = '{FOCUS}' AND qualification = 'A' THEN entries ELSE 0 END)::BIGINT AS sub_students,
    median(CASE WHEN subject = '{FOCUS}' AND qualification = 'A' THEN entries END) AS median_cohort FROM e GROUP BY type),
  u AS (SELECT type, providers, students, sub_providers, sub_students, median_cohort FROM t LEFT JOIN s USING (type)
    UNION ALL SELECT 'Total', sum(providers)::BIGINT, sum(students)::BIGINT, sum(sub_providers)::BIGINT, sum(sub_students)::BIGINT, NULL FROM t LEFT JOIN s USING (type))
  SELECT *, round(100.0 * sub_providers / providers, 1) AS pc_providers, round(100.0 * sub_students / students, 1) AS pc_students,
    round(sub_students / nullif(sub_providers, 0), 1) AS average_cohort FROM u""")
def _(t):
    entries = (
        t.results.join(t.providers.select("provider", F.col("sch_type").alias("type")), "provider")
        .groupBy("type", "provider", "subject", F.col("level").alias("qualification")).agg(F.count("*").alias("entries"))
    )
    students = t.cohort().groupBy(F.col("sch_type").alias("type")).agg(F.count("*").alias("students"))
    return uptake.provider_type_stats(entries, students, FOCUS, "A")


@query("uptake_where_offered", """o AS (SELECT gender, ethnicity, flag, count(*) AS a, count(focus_points) AS n FROM cohort
    WHERE provider IN (SELECT provider FROM cohort WHERE focus_points IS NOT NULL) GROUP BY ALL HAVING count(focus_points) > 0),
  p AS (SELECT *, printf('%d (%.1f%%)', n, round(100.0 * n / a, 1)::DOUBLE) AS label FROM o WHERE flag IS NOT NULL)
  SELECT gender, ethnicity, max(CASE WHEN flag = 0 THEN n END) AS n_0, max(CASE WHEN flag = 0 THEN label END) AS label_0,
    max(CASE WHEN flag = 1 THEN n END) AS n_1, max(CASE WHEN flag = 1 THEN label END) AS label_1 FROM p GROUP BY ALL""")
def _(t):
    return uptake.uptake_where_offered(t.cohort(), ["gender", "ethnicity"])


@query("provider_mean_contrast", f"""m AS (SELECT a.provider, avg(a.points) AS all_mean, avg(CASE WHEN b.points IS NOT NULL THEN a.points END) AS taker_mean
    FROM facts a LEFT JOIN facts b ON a.pupil = b.pupil AND a.provider = b.provider AND b.subject = '{FOCUS}' WHERE a.subject = '{SECOND}' GROUP BY a.provider)
  SELECT round(avg(taker_mean), 6) AS with_mean, count(taker_mean) AS with_n, round(avg(CASE WHEN taker_mean IS NULL THEN all_mean END), 6) AS without_mean,
    count(CASE WHEN taker_mean IS NULL THEN 1 END) AS without_n FROM m""")
def _(t):
    return uptake.provider_mean_contrast(t.facts, SECOND, FOCUS)


@query("female_provision", """SELECT sch_gender, count(DISTINCT provider) AS schools, count(*) AS students, count(DISTINCT CASE WHEN focus_points IS NOT NULL THEN provider END) AS sub_schools,
    count(focus_points) AS sub_students, round(100.0 * count(DISTINCT CASE WHEN focus_points IS NOT NULL THEN provider END) / count(DISTINCT provider), 4) AS pc_schools,
    round(100.0 * count(focus_points) / count(*), 4) AS pc_students FROM cohort WHERE gender = 'F' GROUP BY sch_gender""")
def _(t):
    return uptake.female_provision(t.cohort())


@query("provider_gender_mix", """g AS (SELECT sch_gender, count(DISTINCT provider) AS n, count(DISTINCT CASE WHEN focus_points IS NOT NULL THEN provider END) AS sub_n
    FROM cohort WHERE sch_gender IS NOT NULL GROUP BY sch_gender)
  SELECT *, round(n / sum(n) OVER (), 6) AS share, round(sub_n / sum(sub_n) OVER (), 6) AS sub_share FROM g""")
def _(t):
    return uptake.provider_gender_mix(t.cohort())


@query("dataset_totals", """SELECT count(DISTINCT CASE WHEN provider < 1000 THEN provider END) AS valid_providers, count(DISTINCT CASE WHEN provider >= 1000 THEN provider END) AS invalid_providers,
  count(DISTINCT CASE WHEN provider < 1000 AND focus_points IS NOT NULL THEN provider END) AS sub_providers, count(CASE WHEN provider >= 1000 THEN 1 END) AS invalid_entries,
  count(*) AS entries, count(focus_points) AS sub_entries, count(CASE WHEN gender = 'F' THEN 1 END) AS female_entries, count(CASE WHEN gender <> 'F' THEN 1 END) AS male_entries FROM cohort""")
def _(t):
    return uptake.dataset_totals(t.cohort(), 1000)


@query("no_provision_list", f"""t AS (SELECT floor(easting / 500) AS cell, count(DISTINCT provider) AS schools, count(focus_points) AS n FROM cohort GROUP BY ALL HAVING count(focus_points) = 0)
  SELECT count(*) AS categories, coalesce(string_agg(cell || ' (n=' || schools || ')', '; ' ORDER BY cell || ' (n=' || schools || ')'), '') AS listing FROM
  (SELECT CAST(CAST(cell AS BIGINT) AS VARCHAR) AS cell, schools FROM t)""")
def _(t):
    cells = profiles(t).withColumn("cell", F.floor(F.col("easting") / 500).cast("string"))
    table = cells.groupBy("cell").agg(F.sum("schools").alias("schools"), F.sum("sub_schools").alias("sub_schools"))
    return uptake.no_provision_list(table, "cell")


@query("grammar_by_region", "SELECT region, selective, sch_type, count(DISTINCT provider) AS n FROM providers GROUP BY ALL")
def _(t):
    return uptake.grammar_by_region(t.providers)


@query("training_supply", f"""t AS (SELECT l_suppkey AS provider, p_brand AS subject, count(*) AS postgrads FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT provider, sum(postgrads)::BIGINT AS postgrads, true AS offers FROM t WHERE subject = '{FOCUS}' GROUP BY provider
  UNION ALL SELECT DISTINCT provider, NULL, false FROM t WHERE provider NOT IN (SELECT provider FROM t WHERE subject = '{FOCUS}')""")
def _(t):
    lines = t.table("lineitem").join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    training = lines.groupBy(F.col("l_suppkey").alias("provider"), F.col("p_brand").alias("subject")).agg(F.count("*").alias("postgrads"))
    return uptake.training_supply(training, FOCUS)
