"""Queries: qualifications (A52-A55), league table (A68), trends."""

from pyspark.sql import functions as F

from ..operators import qualifications, trend, uptake
from ..operators.common import count_if
from .q_uptake import PROFILE_SQL, criteria_sql
from .registry import query
from .testbed import FOCUS, SECOND

QUALS_SQL = """quals AS (SELECT r.level AS course, r.year, r.qualification, p_name AS name, 'L' || p_size % 3 AS level, p_type AS type, p.gender, r.pupil, r.provider,
    regexp_matches(p_name, 'ring|gear', 'i') AS listed FROM results r JOIN part ON qualification = p_partkey LEFT JOIN pupils p ON r.pupil = p.pupil)"""


def quals(t):
    parts = t.table("part").select(
        F.col("p_partkey").alias("qualification"), F.col("p_name").alias("name"),
        F.concat(F.lit("L"), (F.col("p_size") % 3).cast("string")).alias("level"), F.col("p_type").alias("type"),
        F.col("p_name").rlike("(?i)ring|gear").alias("listed"),
    )
    rows = t.results.select(F.col("level").alias("course"), "year", "qualification", "pupil", "provider")
    return rows.join(parts, "qualification").join(t.pupils.select("pupil", "gender"), "pupil", "left")


def coarse(t):
    """Qualifications grouped by type, so that counts pass the disclosure limits."""
    return quals(t).withColumns({"qualification": F.col("type"), "name": F.col("level")})


def five_sql(c: str) -> str:
    return f"CASE WHEN {c} <= 5 THEN 'X' ELSE CAST(CAST(round({c} / 5) * 5 AS BIGINT) AS VARCHAR) END"


PUBLISHED_SQL = QUALS_SQL + f""", c AS (SELECT course, year, type AS qualification, level AS name, level, type, count(*) AS n, count(CASE WHEN gender = 'F' THEN 1 END) AS f,
    count(CASE WHEN gender = 'O' THEN 1 END) AS m FROM quals GROUP BY course, year, type, level),
  m AS (SELECT course, year, qualification, name, level, type, {five_sql("n")} AS n, {five_sql("f")} AS f, {five_sql("m")} AS m FROM c),
  published AS (SELECT *, CASE WHEN f = 'X' THEN 'X' ELSE printf('%.1f', round(100.0 * TRY_CAST(f AS DOUBLE) / (TRY_CAST(f AS DOUBLE) + TRY_CAST(m AS DOUBLE)), 1)::DOUBLE) END AS f_per,
      CASE WHEN m = 'X' THEN 'X' ELSE printf('%.1f', round(100.0 * TRY_CAST(m AS DOUBLE) / (TRY_CAST(f AS DOUBLE) + TRY_CAST(m AS DOUBLE)), 1)::DOUBLE) END AS m_per FROM m
    UNION ALL SELECT course, year, NULL, 'Totals', NULL, NULL, CAST(sum(f + m)::BIGINT AS VARCHAR), CAST(sum(f)::BIGINT AS VARCHAR), CAST(sum(m)::BIGINT AS VARCHAR),
      printf('%.1f', round(100.0 * sum(f) / sum(f + m), 1)::DOUBLE), printf('%.1f', round(100.0 * sum(m) / sum(f + m), 1)::DOUBLE) FROM c GROUP BY course, year)"""


def published(t):
    return qualifications.qualification_counts(coarse(t), "F", "O")


@query("qualification_counts", PUBLISHED_SQL + " SELECT * FROM published")
def _(t):
    return published(t)


@query("any_qualification_reach", QUALS_SQL + """, t AS (SELECT course, year, count(DISTINCT pupil) AS total FROM quals GROUP BY ALL),
  g AS (SELECT course, year, gender, count(DISTINCT pupil) AS total_gender, count(DISTINCT CASE WHEN listed THEN pupil END) AS total_listed FROM quals GROUP BY ALL)
  SELECT g.*, total FROM g JOIN t ON g.course = t.course AND g.year = t.year WHERE total_listed > 0""")
def _(t):
    return qualifications.any_qualification_reach(quals(t), ["course", "year"], "listed")


def reach_sql(area: str) -> str:
    return f"""SELECT '{area}' AS grain, {area} AS name, count(DISTINCT provider) AS providers, count(DISTINCT pupil) AS students, count(DISTINCT CASE WHEN listed THEN provider END) AS sub_providers,
    count(DISTINCT CASE WHEN listed THEN pupil END) AS sub_students FROM x GROUP BY {area}"""


@query("qualification_reach_by_area", QUALS_SQL + f""", x AS (SELECT q.*, authority, region FROM quals q LEFT JOIN providers USING (provider)),
  a AS ({reach_sql("authority")} UNION ALL {reach_sql("region")})
  SELECT *, round(100.0 * sub_students / students, 1) AS pc_students, round(100.0 * sub_providers / providers, 1) AS pc_providers FROM a""")
def _(t):
    rows = quals(t).join(t.providers.select("provider", "authority", "region"), "provider", "left")
    return qualifications.qualification_reach_by_area(rows, ["authority", "region"], "listed")


@query("qualification_type_trend", PUBLISHED_SQL + """ SELECT course, year, type, sum(CAST(n AS BIGINT))::BIGINT AS n FROM published WHERE name <> 'Totals' AND n <> 'X' GROUP BY ALL""")
def _(t):
    return qualifications.qualification_type_trend(published(t))


@query("large_qualifications", PUBLISHED_SQL + " SELECT * FROM published WHERE name = 'Totals' OR TRY_CAST(n AS DOUBLE) > 130")
def _(t):
    return qualifications.large_qualifications(published(t))


RANKS = ["result", "provider", "student", "cohort", "female"]


@query("league_table", PROFILE_SQL + ", provision AS (WITH " + criteria_sql({"authority": "authority"}) + """),
  females AS (SELECT authority, count(focus_points) AS female_n, printf('%.1f', round(100.0 * count(focus_points) / count(*), 1)::DOUBLE) AS female_per FROM cohort WHERE gender = 'F' GROUP BY authority),
  v AS (SELECT p.*, female_n, female_per, TRY_CAST(grade_avg_subject AS DOUBLE) AS v_result, pc_schools AS v_provider, TRY_CAST(pc_students AS DOUBLE) AS v_student,
    TRY_CAST(average_cohort AS DOUBLE) AS v_cohort, TRY_CAST(female_per AS DOUBLE) AS v_female FROM provision p LEFT JOIN females f ON p.authority = f.authority),
  r AS (SELECT *, """ + ", ".join(f"CASE WHEN v_{k} IS NOT NULL THEN dense_rank() OVER (ORDER BY v_{k} DESC NULLS LAST) END AS {k}_rank" for k in RANKS) + """ FROM v),
  m AS (SELECT *, """ + ", ".join(f"max({k}_rank) OVER () AS {k}_rank_max" for k in RANKS) + """ FROM r)
  SELECT m.authority, schools, students, sub_schools, pc_schools, sub_students, pc_students, average_cohort, CASE WHEN v_result > 7.5 THEN 'A*' WHEN v_result > 7 THEN 'A' WHEN v_result > 6.5 THEN 'A-'
    WHEN v_result > 6 THEN 'B*' WHEN v_result > 5.5 THEN 'B-' WHEN v_result > 5 THEN 'C' WHEN v_result > 4.5 THEN 'C-' WHEN v_result > 4 THEN 'D' WHEN v_result > 3.5 THEN 'D-' WHEN v_result > 3 THEN 'E'
    WHEN v_result > 2.5 THEN 'E-' WHEN v_result > 2 THEN 'F' WHEN v_result > 1.5 THEN 'F-' WHEN v_result > 1 THEN 'G' WHEN v_result > 0 THEN 'U' ELSE 'X' END AS result, """
       + ", ".join(f"{k}_rank, {k}_rank_max" for k in RANKS) + """, female_n, female_per, code
  FROM m LEFT JOIN (SELECT n_name, n_nationkey AS code FROM nation) n ON m.authority = n.n_name WHERE m.authority <> 'Totals'""")
def _(t):
    female = F.col("gender") == "F"
    profiles = uptake.provider_profile(t.cohort(), ["authority"], [
        count_if(female).alias("females"), F.count(F.when(female, F.col("focus_points"))).alias("sub_females"),
    ])
    provision = uptake.provision_by_criteria(profiles, ["authority"], extra=["females", "sub_females"])
    codes = t.table("nation").select(F.col("n_name").alias("authority"), F.col("n_nationkey").alias("code"))
    return trend.league_table(provision, codes)


@query("reach_trend", f"""s AS (SELECT year, provider, count(*) AS students FROM (SELECT DISTINCT year, pupil, provider FROM facts WHERE provider < 900000) GROUP BY ALL), o AS (SELECT year, subject, provider, count(*) AS takers FROM facts WHERE provider < 900000 GROUP BY ALL),
  w AS (SELECT year, count(*) AS p, sum(students) AS n FROM s GROUP BY year),
  a AS (SELECT o.year, subject, round(100.0 * count(*) / any_value(p), 1) AS pc_providers, round(100.0 * sum(students) / any_value(n), 1) AS pc_with_access, round(100.0 * sum(takers) / sum(students), 1) AS pc_of_offered
    FROM o JOIN s ON o.year = s.year AND o.provider = s.provider JOIN w ON o.year = w.year WHERE subject IN ('{FOCUS}', '{SECOND}') GROUP BY o.year, subject)
  SELECT year, subject, type, percentage FROM a UNPIVOT (percentage FOR type IN (pc_providers, pc_with_access, pc_of_offered))""")
def _(t):
    return trend.reach_trend(t.facts, [FOCUS, SECOND])


def shares_sql(category: str) -> str:
    return f"""c AS (SELECT f.year, f.subject, {category}, count(*) AS n FROM facts f JOIN cohort c ON f.pupil = c.pupil AND f.provider = c.provider WHERE f.subject IN ('{FOCUS}', '{SECOND}') AND {category} IS NOT NULL GROUP BY ALL
    UNION ALL SELECT p.year, 'All', {category}, count(*) FROM cohort c JOIN (SELECT pupil, year FROM pupils) p ON c.pupil = p.pupil WHERE {category} IS NOT NULL GROUP BY ALL),
  shares AS (SELECT year, subject, {category}, n, round(100.0 * n / sum(n) OVER (PARTITION BY year, subject), 1) AS percentage FROM c)"""


@query("demographic_trend", shares_sql("ethnicity") + " SELECT * FROM shares")
def _(t):
    return trend.demographic_trend(t.facts, t.cohort(), [FOCUS, SECOND], "ethnicity")


@query("demographic_trend_any_need", shares_sql("sen") + """, m AS (SELECT *, max(percentage) OVER (PARTITION BY year, subject) AS largest FROM shares)
  SELECT year, subject, round(100 - largest, 1) AS percentage FROM m WHERE sen = 'N'""")
def _(t):
    return trend.any_need_trend(trend.demographic_trend(t.facts, t.cohort(), [FOCUS, SECOND], "sen"), "sen")


@query("demographic_trend_flag", f"""r AS (SELECT f.year, f.subject, flag FROM facts f JOIN cohort c ON f.pupil = c.pupil AND f.provider = c.provider WHERE f.subject IN ('{FOCUS}', '{SECOND}') AND flag IS NOT NULL
    UNION ALL SELECT p.year, 'All', c.flag FROM cohort c JOIN (SELECT pupil, year FROM pupils) p ON c.pupil = p.pupil WHERE c.flag IS NOT NULL)
  SELECT year, subject, count(*) AS n, round(100 * avg(flag), 4) AS percentage FROM r GROUP BY ALL""")
def _(t):
    return trend.numeric_trend(t.facts, t.cohort(), [FOCUS, SECOND], "flag", 100.0)


@query("demographic_trend_vs_population", f"""p AS (SELECT p.year, eal, count(*) AS total FROM cohort c JOIN (SELECT pupil, year FROM pupils) p ON c.pupil = p.pupil GROUP BY ALL),
  s AS (SELECT f.year, f.subject, eal, count(*) AS sub_total FROM facts f JOIN cohort c ON f.pupil = c.pupil AND f.provider = c.provider WHERE f.subject IN ('{FOCUS}', '{SECOND}') GROUP BY ALL)
  SELECT s.*, total, round(100.0 * sub_total / total, 4) AS percentage FROM s JOIN p ON s.year = p.year AND s.eal = p.eal""")
def _(t):
    return trend.share_vs_population_trend(t.facts, t.cohort(), [FOCUS, SECOND], "eal")


@query("yearly_series", shares_sql("gender") + f""" SELECT CASE subject WHEN '{FOCUS}' THEN 'GCSE Computing' WHEN '{SECOND}' THEN 'GCSE ICT' END AS series, year, n, percentage
  FROM shares WHERE subject IN ('{FOCUS}', '{SECOND}') AND gender = 'F'""")
def _(t):
    shares = trend.demographic_trend(t.facts, t.cohort(), [FOCUS, SECOND], "gender")
    return trend.yearly_series(shares, {FOCUS: "GCSE Computing", SECOND: "GCSE ICT"}, "gender", "F")
