"""Queries: attainment and representation."""

from pyspark.sql import functions as F

from ..functions import scales
from ..operators import attain, represent
from .q_uptake import LETTER_SQL, top_sql
from .registry import query
from .testbed import FOCUS, SECOND, THIRD

LETTERS = "*ABCDEFGU"


def letter():
    return scales.points_to_letter(F.col("focus_points") % 9)


SUMMARY_SQL = f"""demo AS (SELECT gender, flag, ethnicity, eth_minor, sen, eal, {LETTER_SQL} AS grade, count(*) AS total FROM cohort
  WHERE focus_points IS NOT NULL GROUP BY ALL)"""


def summary(t):
    return attain.grade_demographics(t.cohort(), letter())


@query("grade_demographics", SUMMARY_SQL + " SELECT * FROM demo")
def _(t):
    return summary(t)


def wide_sql(expression: str) -> str:
    return ", ".join(expression.replace("?", f"sum(CASE WHEN grade = '{g}' THEN total END)") + f' AS "{g}"' for g in LETTERS)


@query("grade_demographic_summary", SUMMARY_SQL + f""", k AS (SELECT * FROM demo WHERE gender IS NOT NULL OR flag IS NOT NULL)
  SELECT gender, flag, 'n' AS type, {wide_sql("CAST(? AS DOUBLE)")} FROM k GROUP BY gender, flag
  UNION ALL SELECT gender, flag, '%', {wide_sql("round(100.0 * ? / sum(total), 1)")} FROM k GROUP BY gender, flag""")
def _(t):
    return attain.grade_demographic_summary(summary(t), ["gender", "flag"])


@query("grade_flag_summary", SUMMARY_SQL + f" SELECT flag, {wide_sql('CAST(? AS BIGINT)')} FROM demo GROUP BY flag")
def _(t):
    return attain.grade_flag_summary(summary(t))


@query("grade_focus_share", SUMMARY_SQL + """, c AS (SELECT sen, eal, grade, sum(total)::BIGINT AS total FROM demo GROUP BY ALL),
  s AS (SELECT sen, grade, sum(total)::BIGINT AS total FROM demo WHERE sen IS NOT NULL GROUP BY ALL),
  w AS (SELECT *, sum(total) OVER (PARTITION BY sen)::BIGINT AS focus_total, round(100.0 * total / sum(total) OVER (PARTITION BY sen), 4) AS percentage FROM s)
  SELECT sen, grade, focus_total, CASE WHEN total < 6 THEN 0 ELSE total END AS total, CASE WHEN total < 6 THEN 0 ELSE percentage END AS percentage,
    CASE WHEN total < 6 THEN 'X' ELSE '' END AS anon FROM w""")
def _(t):
    return attain.grade_focus_share(summary(t), "sen")


def histogram_sql(kind: str) -> str:
    return (f"CASE WHEN {kind} < 6 THEN 0 ELSE {kind} END AS {kind}_total, CASE WHEN {kind} < 6 THEN 0 ELSE {kind} * n_subjects END AS {kind}_entries, "
            f"CASE WHEN {kind} < 6 THEN 'X' WHEN {kind} IS NOT NULL THEN '' END AS {kind}_anon")


@query("subjects_per_pupil", f"""h AS (SELECT n_subjects, count(*) AS "all", nullif(count(focus_points), 0) AS sub, nullif(count(CASE WHEN flag = 1 THEN 1 END), 0) AS flag1,
    nullif(count(CASE WHEN flag = 0 THEN 1 END), 0) AS flag0 FROM cohort GROUP BY n_subjects)
  SELECT n_subjects, {histogram_sql('"all"').replace('"all"_', 'all_')}, {histogram_sql("sub")}, {histogram_sql("flag1")}, {histogram_sql("flag0")} FROM h""")
def _(t):
    return attain.subjects_per_pupil(t.cohort())


@query("single_subject_share", """p AS (SELECT pupil, sum(n_subjects) AS n, sum(CASE WHEN focus_points IS NOT NULL THEN n_subjects END) AS sub_n, count(*) AS r, count(focus_points) AS sr FROM cohort GROUP BY pupil)
  SELECT count(CASE WHEN n = 1 THEN 1 END) AS single, sum(r)::BIGINT AS entries, count(CASE WHEN sub_n = 1 THEN 1 END) AS sub_single, sum(sr)::BIGINT AS sub_entries,
    round(count(CASE WHEN n = 1 THEN 1 END) / sum(r), 6) AS share, round(count(CASE WHEN sub_n = 1 THEN 1 END) / sum(sr), 6) AS sub_share FROM p""")
def _(t):
    return attain.single_subject_share(t.cohort())


@query("overall_average", """SELECT 'prior' AS what, NULL AS level, count(prior) AS n, round(avg(prior), 4) AS mean, round(stddev_samp(prior), 4) AS sd FROM cohort
  UNION ALL SELECT 'sen', sen, sum(count(*)) OVER ()::BIGINT, round(100.0 * count(*) / sum(count(*)) OVER (), 1), NULL FROM cohort GROUP BY sen""")
def _(t):
    cohort = t.cohort()
    numeric = attain.overall_average(cohort, "prior").withColumns({"what": F.lit("prior"), "level": F.lit(None).cast("string")})
    factor = attain.overall_average(cohort, "sen", factor=True).withColumn("what", F.lit("sen")).withColumnRenamed("sen", "level")
    return numeric.unionByName(factor)


PEOPLE_SQL = "rows AS (SELECT f.subject, f.points, c.* FROM facts f JOIN cohort c ON f.pupil = c.pupil AND f.provider = c.provider)"


def average_sql(value: str, population: str = "cohort", k: int = 20) -> str:
    return f"""{top_sql(k)}, {PEOPLE_SQL},
  a AS (SELECT subject, count({value}) AS n, round(avg({value}), 4) AS mean, round(stddev_samp({value}), 4) AS sd FROM rows WHERE subject IN (SELECT subject FROM top) GROUP BY subject
    UNION ALL SELECT 'All', count({value}), round(avg({value}), 4), round(stddev_samp({value}), 4) FROM {population})
  SELECT *, CASE WHEN subject = '{FOCUS}' THEN mean ELSE 0 END AS highlight FROM a"""


@query("average_by_subject", average_sql("prior"))
def _(t):
    return attain.average_by_subject(t.facts, t.cohort(), FOCUS, "prior")


@query("average_by_subject_points", average_sql("focus_points"))
def _(t):
    return attain.average_by_subject(t.facts, t.cohort(), FOCUS, "focus_points")


FACTOR_SQL = """{top}, {people}, c AS (SELECT subject, {what}, count(*) AS n FROM rows WHERE subject IN (SELECT subject FROM top) AND {what} IS NOT NULL GROUP BY ALL),
  a AS (SELECT subject, {what}, n, round(100.0 * n / sum(n) OVER (PARTITION BY subject), 1) AS mean FROM c
    UNION ALL SELECT 'All', {what}, sum(count(*)) OVER ()::BIGINT, round(100.0 * count(*) / sum(count(*)) OVER (), 1) FROM cohort WHERE {what} IS NOT NULL GROUP BY {what})"""


@query("average_by_subject_factor", FACTOR_SQL.format(top=top_sql(20), people=PEOPLE_SQL, what="ethnicity")
       + f" SELECT *, CAST(NULL AS DOUBLE) AS sd, CASE WHEN subject = '{FOCUS}' THEN mean ELSE 0 END AS highlight FROM a")
def _(t):
    return attain.average_by_subject(t.facts, t.cohort(), FOCUS, "ethnicity", factor=True)


@query("indicator_average", average_sql("CASE WHEN ethnicity = '2-HIGH' THEN 100.0::DOUBLE WHEN coalesce(ethnicity, '') <> '' THEN 0 END", k=30))
def _(t):
    people = t.cohort().withColumn("indicator", attain.indicator("ethnicity", "2-HIGH"))
    return attain.average_by_subject(t.facts, people, FOCUS, "indicator", 30)


PASS_SQL = "round(avg(points), 6) AS points, round(avg(CASE WHEN points >= 25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate"


@query("pass_rate_overall", PEOPLE_SQL + f" SELECT gender, {PASS_SQL} FROM rows WHERE gender IS NOT NULL GROUP BY gender")
def _(t):
    return attain.pass_rate(t.facts, t.cohort(), "gender", 25.0)


@query("pass_rate_by_subject", top_sql(20) + f""", {PEOPLE_SQL}, a AS (SELECT subject, flag, {PASS_SQL} FROM rows WHERE flag IS NOT NULL AND subject IN (SELECT subject FROM top) GROUP BY subject, flag
    UNION ALL SELECT 'All', flag, {PASS_SQL} FROM rows WHERE flag IS NOT NULL GROUP BY flag)
  SELECT *, CASE WHEN subject = '{FOCUS}' THEN pass_rate ELSE 0 END AS highlight FROM a""")
def _(t):
    return attain.pass_rate_by_subject(t.facts, t.cohort(), "flag", 25.0, FOCUS)


@query("category_by_subject", FACTOR_SQL.format(top=top_sql(30), people=PEOPLE_SQL, what="sen") + f""" SELECT CASE sen WHEN 'N' THEN 'None' WHEN 'A' THEN 'School action'
    WHEN 'P' THEN 'School action plus' WHEN 'S' THEN 'Statement' WHEN 'E' THEN 'EHC plan' WHEN 'K' THEN 'SEN support' ELSE 'NA' END AS category,
    max(CASE WHEN subject = '{FOCUS}' THEN mean END) AS "{FOCUS}", max(CASE WHEN subject = '{SECOND}' THEN mean END) AS "{SECOND}", max(CASE WHEN subject = 'All' THEN mean END) AS "All" FROM a GROUP BY 1""")
def _(t):
    names = scales.decode(F.col("sen"), scales.SEN_LABELS, "NA")
    return attain.category_by_subject(t.facts, t.cohort(), FOCUS, [FOCUS, SECOND], "sen", names)


@query("ethnicity_comparison", PEOPLE_SQL + f""", p AS (SELECT ethnicity, count(*) AS total FROM cohort WHERE coalesce(ethnicity, '') <> '' GROUP BY ethnicity),
  t AS (SELECT ethnicity, count(CASE WHEN subject = '{FOCUS}' THEN 1 END) AS n_1, count(CASE WHEN subject = '{SECOND}' THEN 1 END) AS n_2, count(CASE WHEN subject = '{THIRD}' THEN 1 END) AS n_3
    FROM rows WHERE coalesce(ethnicity, '') <> '' AND subject IN ('{FOCUS}', '{SECOND}', '{THIRD}') GROUP BY ethnicity)
  SELECT ethnicity, total, round(100.0 * total / sum(total) OVER (), 2) AS pc_population, n_1, n_2, n_3, round(100.0 * n_1 / sum(n_1) OVER (), 2) AS pc_1,
    round(100.0 * n_2 / sum(n_2) OVER (), 2) AS pc_2, round(100.0 * n_3 / sum(n_3) OVER (), 2) AS pc_3 FROM p LEFT JOIN t USING (ethnicity)""")
def _(t):
    return attain.ethnicity_comparison(t.facts, t.cohort(), [FOCUS, SECOND, THIRD])


OTHERS_SQL = """others AS (SELECT f.*, c.gender, c.sch_gender, (c.sum_points - f.points) / nullif(c.n_subjects - 1, 0) AS other_mean
  FROM facts f JOIN cohort c ON f.pupil = c.pupil AND f.provider = c.provider)"""
DIFFERENTIAL_SQL = OTHERS_SQL + f""", differential AS (SELECT provider, subject, sch_gender,
    coalesce(round(avg(CASE WHEN gender = 'F' THEN points END), 6), 0) AS girls_avg, coalesce(round(avg(CASE WHEN gender = 'F' THEN points - other_mean END), 6), 0) AS girls_diff,
    count(CASE WHEN gender = 'F' THEN 1 END) AS girls_n, coalesce(round(avg(CASE WHEN gender = 'O' THEN points END), 6), 0) AS boys_avg,
    coalesce(round(avg(CASE WHEN gender = 'O' THEN points - other_mean END), 6), 0) AS boys_diff, count(CASE WHEN gender = 'O' THEN 1 END) AS boys_n
  FROM others WHERE other_mean IS NOT NULL AND subject IN ('{FOCUS}', '{SECOND}') AND sch_gender IS NOT NULL GROUP BY ALL)"""


def differential(t):
    return attain.provider_differential(t.facts, t.cohort(), [FOCUS, SECOND], "F", "O")


@query("provider_differential", DIFFERENTIAL_SQL + """ SELECT *, CASE WHEN girls_n = 0 THEN 0 WHEN boys_n = 0 THEN 100 ELSE round(100.0 * girls_n / (girls_n + boys_n), 4) END AS girl_per FROM differential""")
def _(t):
    return differential(t)


@query("gender_share_in_cohort", DIFFERENTIAL_SQL + """ SELECT provider, subject, sch_gender, girls_n + boys_n AS total, 'Female' AS gender, girls_avg AS avg, girls_diff AS diff, girls_n AS n,
    round(100.0 * girls_n / nullif(girls_n + boys_n, 0), 4) AS per FROM differential
  UNION ALL SELECT provider, subject, sch_gender, girls_n + boys_n, 'Male', boys_avg, boys_diff, boys_n, round(100.0 * boys_n / nullif(girls_n + boys_n, 0), 4) FROM differential""")
def _(t):
    return attain.gender_share_in_cohort(differential(t))


@query("subject_gender_means", PEOPLE_SQL + """ SELECT subject, round(avg(CASE WHEN gender = 'F' THEN points END), 6) AS mean_f, round(stddev_samp(CASE WHEN gender = 'F' THEN points END), 6) AS sd_f,
    count(CASE WHEN gender = 'F' THEN 1 END) AS n_f, round(avg(CASE WHEN gender = 'O' THEN points END), 6) AS mean_m, round(stddev_samp(CASE WHEN gender = 'O' THEN points END), 6) AS sd_m,
    count(CASE WHEN gender = 'O' THEN 1 END) AS n_m FROM rows GROUP BY subject""")
def _(t):
    return attain.subject_gender_means(t.facts, t.cohort(), "F", "O")


def profile_sql(name: str, code: str) -> str:
    """Both averages of one gender: subjects are the top 25 of that gender's pupils with the prior and the attribute."""
    text = "printf('%.2f(%.2f)', round(round({0}, 9), 2)::DOUBLE, round(round({1}, 9), 2)::DOUBLE)"
    return f"""p{name} AS (SELECT c.pupil, c.provider, prior, f.points AS attribute FROM cohort c JOIN facts f ON c.pupil = f.pupil AND c.provider = f.provider AND f.subject = '{SECOND}'
    WHERE prior IS NOT NULL AND gender = '{code}'),
  f{name} AS (SELECT f.subject, p.prior, p.attribute FROM facts f JOIN p{name} p ON f.pupil = p.pupil AND f.provider = p.provider),
  n{name} AS (SELECT subject, row_number() OVER (ORDER BY count(*) DESC, subject) AS place FROM f{name} GROUP BY subject),
  s{name} AS (SELECT 'All' AS subject, prior, attribute FROM p{name} UNION ALL SELECT * FROM f{name} WHERE subject IN (SELECT subject FROM n{name} WHERE place < 25 OR subject = '{FOCUS}'
    OR (place = 25 AND (SELECT place FROM n{name} WHERE subject = '{FOCUS}') <= 25))),
  a{name} AS (SELECT subject, count(*) AS n_{name}, round(avg(prior), 9) AS mean_{name}, {text.format("avg(prior)", "stddev_samp(prior)")} AS prior_{name},
    {text.format("avg(attribute)", "stddev_samp(attribute)")} AS attribute_{name} FROM s{name} GROUP BY subject)"""


@query("entry_profile", profile_sql("f", "F") + ", " + profile_sql("m", "O") + """ SELECT subject, n_f, prior_f, attribute_f, n_m, prior_m, attribute_m, n_f + n_m AS n
  FROM af JOIN am USING (subject) QUALIFY rank() OVER (ORDER BY mean_f DESC) <= 20""")
def _(t):
    return attain.entry_profile(t.facts, t.cohort(), FOCUS, "prior", SECOND, "F", "O")


GAP_CATEGORIES = ["Boys_O", "Girls_F", "Mixed_F", "Mixed_O"]
GAP_SQL = ", ".join(
    f"CASE WHEN count(CASE WHEN category = '{c}' THEN 1 END) > 0 THEN printf('%.2f', round(round(avg(CASE WHEN category = '{c}' THEN {v} END), 9), 2)::DOUBLE + 0.0) || '(' || "
    f"coalesce(printf('%.2f', round(round(stddev_samp(CASE WHEN category = '{c}' THEN {v} END), 9), 2)::DOUBLE), 'null') || ')' END AS \"{w}_{c}\""
    for w, v in (("focus", "points"), ("diff", "points - other_mean")) for c in GAP_CATEGORIES
)


@query("grade_gap_by_provider_gender", OTHERS_SQL + f""", x AS (SELECT *, sch_gender || '_' || gender AS category FROM others WHERE other_mean IS NOT NULL AND sch_gender IS NOT NULL)
  SELECT subject, count(*) AS total, {GAP_SQL} FROM x GROUP BY subject HAVING count(*) > 100""")
def _(t):
    return attain.grade_gap_by_provider_gender(t.facts, t.cohort(), 100, GAP_CATEGORIES)


PAIR_SQL = f"""pairs AS (SELECT f.subject, c.gender, f.points, c.focus_points, c.focus_points - f.points AS diff FROM facts f
  JOIN cohort c ON f.pupil = c.pupil AND f.provider = c.provider WHERE c.focus_points IS NOT NULL)"""


def gap_sql(name: str, code: str) -> str:
    v = f"CASE WHEN gender = '{code}' THEN diff END"
    return (f"count({v}) AS {name}_n, round(avg({v}), 4) AS {name}_mean, round(stddev_samp({v}), 4) AS {name}_sd, count(CASE WHEN {v} > 0 THEN 1 END) AS {name}_over, "
            f"count(CASE WHEN {v} = 0 AND subject <> '{FOCUS}' THEN 1 END) AS {name}_equal, count(CASE WHEN {v} < 0 THEN 1 END) AS {name}_under")


@query("subject_gap_table", PAIR_SQL + f""", g AS (SELECT subject, count(*) AS t_n, round(avg(diff), 4) AS t_mean, round(stddev_samp(diff), 4) AS t_sd, {gap_sql("m", "O")}, {gap_sql("f", "F")}
    FROM pairs GROUP BY subject) SELECT *, round(m_mean - f_mean, 4) AS gap FROM g""")
def _(t):
    return attain.subject_gap_table(t.facts, t.cohort(), FOCUS, "F", "O")


@query("qualification_gap", f"""o AS (SELECT pupil, avg(points) AS other FROM facts WHERE subject <> '{FOCUS}' GROUP BY pupil),
  r AS (SELECT level, r.points, p.gender, o.other FROM results r LEFT JOIN pupils p ON r.pupil = p.pupil LEFT JOIN o ON r.pupil = o.pupil WHERE subject = '{FOCUS}'),
  d AS (SELECT level AS qualification, count(CASE WHEN gender = 'F' THEN other END) AS n_f, count(CASE WHEN gender = 'O' THEN other END) AS n_m,
    avg(CASE WHEN gender = 'F' AND other IS NOT NULL THEN points END) AS pf, avg(CASE WHEN gender = 'O' AND other IS NOT NULL THEN points END) AS pm,
    stddev_samp(CASE WHEN gender = 'F' AND other IS NOT NULL THEN points END) AS spf, stddev_samp(CASE WHEN gender = 'O' AND other IS NOT NULL THEN points END) AS spm,
    avg(CASE WHEN gender = 'F' THEN other END) AS "of", avg(CASE WHEN gender = 'O' THEN other END) AS om,
    stddev_samp(CASE WHEN gender = 'F' THEN other END) AS sof, stddev_samp(CASE WHEN gender = 'O' THEN other END) AS som,
    avg(CASE WHEN gender = 'O' THEN points END) AS ma, var_samp(CASE WHEN gender = 'O' THEN points END) AS va, count(CASE WHEN gender = 'O' THEN points END) AS na,
    avg(CASE WHEN gender = 'F' THEN points END) AS mb, var_samp(CASE WHEN gender = 'F' THEN points END) AS vb, count(CASE WHEN gender = 'F' THEN points END) AS nb,
    avg(CASE WHEN gender = 'O' THEN points - other END) AS da, var_samp(CASE WHEN gender = 'O' THEN points - other END) AS wa,
    avg(CASE WHEN gender = 'F' THEN points - other END) AS db, var_samp(CASE WHEN gender = 'F' THEN points - other END) AS wb FROM r GROUP BY level)
  SELECT qualification, n_f, n_m, round(pf, 4) AS points_f, round(pm, 4) AS points_m, round(spf, 4) AS points_sd_f, round(spm, 4) AS points_sd_m, round("of", 4) AS other_f, round(om, 4) AS other_m,
    round(sof, 4) AS other_sd_f, round(som, 4) AS other_sd_m, round((ma - mb) / sqrt(va / na + vb / nb), 4) AS points_t,
    round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 3) AS points_df,
    round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 4) AS points_d,
    round((da - db) / sqrt(wa / n_m + wb / n_f), 4) AS diff_t, round((wa / n_m + wb / n_f) ** 2 / ((wa / n_m) ** 2 / (n_m - 1) + (wb / n_f) ** 2 / (n_f - 1)), 3) AS diff_df,
    round((da - db) / sqrt(((n_m - 1) * wa + (n_f - 1) * wb) / (n_m + n_f - 2)), 4) AS diff_d, round(pf - pm, 4) AS gender_gap, round(pf - "of", 4) AS f_gap, round(pm - om, 4) AS m_gap FROM d""")
def _(t):
    rows = t.results.drop("qualification").withColumnRenamed("level", "qualification")
    table = attain.qualification_gap(rows, t.facts, t.pupils, FOCUS, "F", "O")
    digits = {c: 3 if c.endswith("_df") else 4 for c in table.columns if c != "qualification" and not c.startswith("n_")}
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


SINGLES = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]


def ebacc_sql(label: str, where: str) -> str:
    return f"""SELECT '{label}' AS subject, count(CASE WHEN taken = 4 THEN 1 END) AS singles_4, count(CASE WHEN taken = 3 THEN 1 END) AS singles_3,
    count(CASE WHEN taken >= 3 AND ok >= 2 THEN 1 END) AS passed_singles, count(CASE WHEN c IS NOT NULL AND a IS NOT NULL THEN 1 END) AS attempt_coreadd,
    count(CASE WHEN c >= 25 AND a >= 25 THEN 1 END) AS passed_coreadd, count(*) AS total, round(100.0 * count(CASE WHEN taken IN (3, 4) THEN 1 END) / count(*), 1) AS singles_per,
    round(100.0 * count(CASE WHEN c IS NOT NULL AND a IS NOT NULL THEN 1 END) / count(*), 1) AS core_per, round(100.0 * count(CASE WHEN taken = 4 THEN 1 END) / count(*), 1) AS singles_4_per,
    round(100.0 * count(CASE WHEN taken = 3 THEN 1 END) / count(*), 1) AS singles_3_per FROM e {where}"""


@query("ebacc_summary", f"""e AS (SELECT pupil, provider, count(CASE WHEN subject IN {tuple(SINGLES)} THEN 1 END) AS taken, count(CASE WHEN subject IN {tuple(SINGLES)} AND points >= 25 THEN 1 END) AS ok,
    max(CASE WHEN subject = 'Brand#5' THEN points END) AS c, max(CASE WHEN subject = 'Brand#6' THEN points END) AS a, bool_or(subject = '{FOCUS}') AS sits FROM facts GROUP BY pupil, provider)
  {ebacc_sql(FOCUS, "WHERE sits")} UNION ALL {ebacc_sql("All", "")}""")
def _(t):
    return attain.ebacc_summary(t.facts, SINGLES, "Brand#5", "Brand#6", FOCUS, 25.0).unionByName(
        attain.ebacc_summary(t.facts, SINGLES, "Brand#5", "Brand#6", None, 25.0))


CUBE_SQL = top_sql(5) + f""", {PEOPLE_SQL}, n0 AS (SELECT subject, ethnicity, eth_minor, gender, flag, count(*) AS n FROM rows WHERE subject IN (SELECT subject FROM top) GROUP BY ALL),
  grid AS (SELECT * FROM (SELECT DISTINCT subject FROM n0) CROSS JOIN (SELECT DISTINCT gender FROM n0) CROSS JOIN (SELECT DISTINCT flag FROM n0) CROSS JOIN (SELECT DISTINCT ethnicity, eth_minor FROM n0)),
  pop AS (SELECT ethnicity, eth_minor, gender, flag, count(*) AS population FROM cohort GROUP BY ALL),
  u AS (SELECT g.subject, g.ethnicity, g.eth_minor, g.gender, g.flag, coalesce(n0.n, 0) AS n FROM grid g LEFT JOIN n0 ON g.subject = n0.subject AND g.ethnicity IS NOT DISTINCT FROM n0.ethnicity
      AND g.eth_minor = n0.eth_minor AND g.gender IS NOT DISTINCT FROM n0.gender AND g.flag IS NOT DISTINCT FROM n0.flag
    UNION ALL SELECT 'All', ethnicity, eth_minor, gender, flag, population FROM pop),
  w AS (SELECT *, sum(n) OVER (PARTITION BY subject)::BIGINT AS subject_total, sum(n) OVER (PARTITION BY subject, gender, flag)::BIGINT AS gender_flag_total FROM u),
  cube AS (SELECT w.*, population, round(100.0 * w.n / population, 2) AS representation FROM w LEFT JOIN pop ON w.ethnicity IS NOT DISTINCT FROM pop.ethnicity AND w.eth_minor = pop.eth_minor
    AND w.gender IS NOT DISTINCT FROM pop.gender AND w.flag IS NOT DISTINCT FROM pop.flag WHERE w.gender IS NOT NULL AND w.flag IS NOT NULL),
  groups AS (SELECT subject, gender, flag, CASE WHEN ethnicity = '1-URGENT' AND eth_minor = '1-URGENT/1' THEN 'WHIBRI' WHEN ethnicity = '1-URGENT' THEN 'WHIOTH' ELSE ethnicity END AS "group",
    sum(population)::BIGINT AS population, sum(n)::BIGINT AS n FROM cube GROUP BY ALL),
  full_groups AS (SELECT subject, gender, flag, "group", population, n, round(100.0 * n / population, 2) AS representation FROM groups
    UNION ALL SELECT subject, gender, flag, 'Total', sum(population)::BIGINT, sum(n)::BIGINT, round(100.0 * sum(n) / sum(population), 2) FROM groups GROUP BY subject, gender, flag)"""


def cube(t):
    return represent.representation_cube(t.facts, t.cohort(), FOCUS, 5)


def groups(t):
    return represent.representation_groups(cube(t), "1-URGENT", "1-URGENT/1")


@query("representation_cube", CUBE_SQL + f" SELECT *, CASE WHEN subject = '{FOCUS}' THEN representation ELSE 0 END AS highlight FROM cube")
def _(t):
    return cube(t)


@query("representation_summary", CUBE_SQL + f""" SELECT "group", population, n, representation FROM full_groups WHERE subject = '{FOCUS}' AND gender = 'F' AND flag = 1""")
def _(t):
    return represent.representation_summary(groups(t), FOCUS, "F", 1)


TWO_SQL = CUBE_SQL + f""" SELECT "group", gender, flag, max(CASE WHEN subject = '{FOCUS}' THEN population END) AS population, max(CASE WHEN subject = '{FOCUS}' THEN n END) AS n_1,
    max(CASE WHEN subject = '{FOCUS}' THEN representation END) AS pc_1, max(CASE WHEN subject = 'All' THEN n END) AS n_2, max(CASE WHEN subject = 'All' THEN representation END) AS pc_2
  FROM full_groups WHERE subject IN ('{FOCUS}', 'All') GROUP BY ALL"""


@query("representation_two_subjects", TWO_SQL)
def _(t):
    return represent.representation_two_subjects(groups(t), [FOCUS, "All"])


OFFERED_SQL = """offered AS (SELECT DISTINCT provider, subject FROM facts),
  population AS (SELECT c.*, o.subject, CAST(f.points IS NOT NULL AS INTEGER) AS sits FROM cohort c JOIN offered o ON c.provider = o.provider
    LEFT JOIN facts f ON f.pupil = c.pupil AND f.provider = c.provider AND f.subject = o.subject WHERE c.gender IS NOT NULL AND c.score IS NOT NULL)"""


@query("deprivation_bands", OFFERED_SQL + """, b AS (SELECT *, CAST(ntile(10) OVER (PARTITION BY subject, gender ORDER BY score, pupil) AS INTEGER) AS band FROM population)
  SELECT subject, gender, band, count(*) AS total, sum(sits)::BIGINT AS takers, round(100.0 * sum(sits) / count(*), 1) AS percentage FROM b GROUP BY ALL""")
def _(t):
    return attain.deprivation_bands(t.cohort(), t.facts, 10)


@query("deprivation_by_category", OFFERED_SQL + """, b AS (SELECT *, CAST(ntile(4) OVER (PARTITION BY subject, gender ORDER BY score, pupil) AS INTEGER) AS band FROM population)
  SELECT subject, gender, ethnicity, band, count(*) AS total, sum(sits)::BIGINT AS takers, round(100.0 * sum(sits) / count(*), 1) AS percentage FROM b
  WHERE ethnicity NOT IN ('5-LOW') GROUP BY ALL""")
def _(t):
    return attain.deprivation_by_category(t.cohort(), t.facts, 4, "ethnicity", ["5-LOW"])
