"""Queries: statistics and data quality (T)."""

from pyspark.sql import functions as F

from ..functions import scales
from ..operators import attain, logit, profile, stats
from .q_attain import DIFFERENTIAL_SQL, OTHERS_SQL, PAIR_SQL, PEOPLE_SQL, differential
from .registry import query
from .testbed import FOCUS

WELCH_SQL = PEOPLE_SQL + """, m AS (SELECT subject, count(CASE WHEN gender = 'F' THEN prior END) AS n_a, avg(CASE WHEN gender = 'F' THEN prior END) AS ma, var_samp(CASE WHEN gender = 'F' THEN prior END) AS va,
    count(CASE WHEN gender = 'O' THEN prior END) AS n_b, avg(CASE WHEN gender = 'O' THEN prior END) AS mb, var_samp(CASE WHEN gender = 'O' THEN prior END) AS vb FROM rows GROUP BY subject),
  w AS (SELECT *, (ma - mb) / sqrt(va / n_a + vb / n_b) AS t, (va / n_a + vb / n_b) ** 2 / ((va / n_a) ** 2 / (n_a - 1) + (vb / n_b) ** 2 / (n_b - 1)) AS df,
    (ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS d FROM m)"""


def welch_rows(t):
    rows = t.facts.select("pupil", "provider", "subject").join(t.cohort().select("pupil", "provider", "gender", "prior"), ["pupil", "provider"])
    return stats.welch_ttest(rows, ["subject"], F.col("prior"), F.col("gender") == "F", F.col("gender") == "O")


@query("welch_ttest", WELCH_SQL + """ SELECT subject, n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(t, 5) AS t, round(df, 3) AS df, round(d, 6) AS d,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM w""")
def _(t):
    table = welch_rows(t)
    digits = {"mean_a": 6, "mean_b": 6, "t": 5, "df": 3, "d": 6}
    return table.select("subject", "n_a", "n_b", *[F.round(c, k).alias(c) for c, k in digits.items()], "magnitude")


SIMPSON = "(SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS h FROM range(0, 2001) r(i))"


def t_tail_sql(source: str, keys: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    return f"""angles AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM {source}),
  tails AS (SELECT {keys}, greatest(0.0, 1 - 2 * any_value(exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi())) * sum(h * cos(th * i / 2000.0) ** (df - 1)) * any_value(th) / 6000) AS p
    FROM angles, {SIMPSON} GROUP BY {keys})"""


def normal_tail_sql(source: str, keys: str) -> str:
    """Two-sided tail of the normal distribution beyond z by Simpson's rule; past ten it counts as none."""
    return f"""ends AS (SELECT *, least(abs(z), 10.0) AS e FROM {source}),
  tails AS (SELECT {keys}, greatest(0.0, 1 - 2 / sqrt(2 * pi()) * sum(h * exp(-((e * i / 2000.0) ** 2) / 2)) * any_value(e) / 6000) AS p FROM ends, {SIMPSON} GROUP BY {keys})"""


STARS_SQL = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '** ' WHEN p < 0.05 THEN '*  ' WHEN p < 0.1 THEN '.  ' ELSE '   ' END"


def rounded(table, **digits):
    return table.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query("welch_ttest_p", WELCH_SQL + ", " + t_tail_sql("w", "subject") + """ SELECT subject, round(t, 5) AS t, round(df, 3) AS df, round(p, 6) AS p, round(d, 6) AS d,
  printf('_t_(%.0f)=%.3f _p_=%.3f _d_=%.2f', df, t, p, d) AS description FROM w JOIN tails USING (subject)""")
def _(t):
    tests = stats.with_p(welch_rows(t)).select("subject", "t", "df", "p", "d", "description")
    return rounded(tests, t=5, df=3, p=6, d=6)


OLS_SQL = """q AS (SELECT subject, count(*) AS n, count(prior) AS n_prior FROM facts JOIN pupils USING (pupil) GROUP BY subject HAVING count(*) > 60 AND count(prior) > 40),
  u AS (SELECT subject, points AS y, CAST(gender = 'O' AS DOUBLE) AS a, other_mean AS b FROM others WHERE gender IS NOT NULL AND other_mean IS NOT NULL),"""
MOMENTS_SQL = """m AS (SELECT subject, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_samp(y) AS vy, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab, covar_samp(a, y) AS cay, covar_samp(b, y) AS cby
    FROM u GROUP BY subject),
  c AS (SELECT *, (cay * vb - cby * cab) / (va * vb - cab * cab) AS b1, (cby * va - cay * cab) / (va * vb - cab * cab) AS b2, va * vb - cab * cab AS det FROM m),
  e AS (SELECT *, my - b1 * ma - b2 * mb AS b0, (n - 1) * (vy - b1 * cay - b2 * cby) AS rss, (n - 1) * vy AS tss, (n - 1) * (vy - cby * cby / vb) AS rss_reduced FROM c),
  s AS (SELECT *, rss / (n - 3) AS s2, sqrt(rss / (n - 3) * vb / ((n - 1) * det)) AS se1, sqrt(rss / (n - 3) * va / ((n - 1) * det)) AS se2,
    sqrt(rss / (n - 3) * (1.0 / n + (ma * ma * vb + mb * mb * va - 2 * ma * mb * cab) / ((n - 1) * det))) AS se0 FROM e)"""


def ols_rows(t):
    attributes = t.cohort().select("pupil", "provider", "gender", "prior")
    rows = profile.with_other_mean(t.facts).join(attributes, ["pupil", "provider"])
    return stats.ols_by_subject(rows, male="O")


@query("ols_by_subject", OTHERS_SQL + ", " + OLS_SQL + MOMENTS_SQL + """, r AS (SELECT s.*, q.n AS pupils FROM s JOIN q USING (subject))
  SELECT subject, pupils, n, n - 3 AS res_df, round(1 - rss / tss, 5) AS r2, round(1 - s2 / vy, 5) AS adj_r2, round((tss - rss) / 2 / s2, 3) AS f, '(Intercept)' AS term, round(b0, 5) AS est, round(se0, 5) AS std_error, round(b0 / se0, 4) AS t FROM r
  UNION ALL SELECT subject, pupils, n, n - 3, round(1 - rss / tss, 5), round(1 - s2 / vy, 5), round((tss - rss) / 2 / s2, 3), 'male', round(b1, 5), round(se1, 5), round(b1 / se1, 4) FROM r
  UNION ALL SELECT subject, pupils, n, n - 3, round(1 - rss / tss, 5), round(1 - s2 / vy, 5), round((tss - rss) / 2 / s2, 3), 'other_mean', round(b2, 5), round(se2, 5), round(b2 / se2, 4) FROM r""")
def _(t):
    digits = {"r2": 5, "adj_r2": 5, "f": 3, "est": 5, "std_error": 5, "t": 4}
    return ols_rows(t).withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("ols_by_subject_p", OTHERS_SQL + ", " + OLS_SQL + MOMENTS_SQL + """, r AS (SELECT s.* FROM s JOIN q USING (subject)),
  terms AS (SELECT subject, n - 3 AS df, '(Intercept)' AS term, b0 AS est, b0 / se0 AS t FROM r UNION ALL SELECT subject, n - 3, 'male', b1, b1 / se1 FROM r UNION ALL SELECT subject, n - 3, 'other_mean', b2, b2 / se2 FROM r),
  """ + t_tail_sql("terms", "subject, term") + f" SELECT subject, term, round(t, 4) AS t, round(p, 6) AS p, printf('%.3f', round(est, 3)) || {STARS_SQL} AS marks FROM terms JOIN tails USING (subject, term)")
def _(t):
    tests = stats.with_t_p(ols_rows(t)).withColumn("marks", scales.starred(F.col("est"), F.col("p"), 3))
    return rounded(tests.select("subject", "term", "t", "p", "marks"), t=4, p=6)


def simple_sql(x: str) -> str:
    return f"""s AS (SELECT kind, gender, count(*) AS n, regr_slope(diff, {x}) AS b1, regr_intercept(diff, {x}) AS b0, regr_r2(diff, {x}) AS r2, var_samp(diff) AS vy, var_samp({x}) AS vx, avg({x}) AS mx FROM k GROUP BY ALL),
  e AS (SELECT *, (n - 1) * vy * (1 - r2) / (n - 2) AS s2 FROM s),
  f AS (SELECT *, sqrt(s2 / ((n - 1) * vx)) AS se1, sqrt(s2 * (1.0 / n + mx * mx / ((n - 1) * vx))) AS se0 FROM e)
  SELECT kind, gender, n, n - 2 AS res_df, round(r2, 5) AS r2, '(Intercept)' AS term, round(b0, 5) AS est, round(se0, 5) AS std_error, round(b0 / se0, 4) AS t FROM f
  UNION ALL SELECT kind, gender, n, n - 2, round(r2, 5), '{x}', round(b1, 5), round(se1, 5), round(b1 / se1, 4) FROM f"""


GROUP_SIZE_SQL = DIFFERENTIAL_SQL + f""", g AS (SELECT provider, sch_gender, 'Female' AS gender, girls_diff AS diff, girls_n AS n_sub, round(100.0 * girls_n / nullif(girls_n + boys_n, 0), 4) AS per FROM differential WHERE subject = '{FOCUS}'
    UNION ALL SELECT provider, sch_gender, 'Male', boys_diff, boys_n, round(100.0 * boys_n / nullif(girls_n + boys_n, 0), 4) FROM differential WHERE subject = '{FOCUS}'),
  k AS (SELECT *, CASE WHEN sch_gender = 'Mixed' THEN 'Mixed' ELSE 'Single' END AS kind FROM g WHERE per <> 0
    AND (sch_gender = 'Mixed' OR (gender = 'Female' AND sch_gender = 'Girls') OR (gender = 'Male' AND sch_gender = 'Boys')))"""


@query("ols_simple", GROUP_SIZE_SQL + ", " + simple_sql("n_sub"))
def _(t):
    rows = attain.gender_share_in_cohort(differential(t)).filter((F.col("subject") == FOCUS) & (F.col("per") != 0))
    mixed = F.col("sch_gender") == "Mixed"
    own = ((F.col("gender") == "Female") & (F.col("sch_gender") == "Girls")) | ((F.col("gender") == "Male") & (F.col("sch_gender") == "Boys"))
    rows = rows.filter(mixed | own).withColumn("kind", F.when(mixed, "Mixed").otherwise("Single")).withColumnRenamed("n", "n_sub")
    digits = {"r2": 5, "est": 5, "std_error": 5, "t": 4}
    return stats.ols_simple(rows, ["kind", "gender"], "diff", "n_sub").withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("nested_ols_anova", PAIR_SQL + f""", u AS (SELECT subject, points AS y, CAST(gender = 'O' AS DOUBLE) AS a, focus_points AS b FROM pairs WHERE gender IS NOT NULL AND subject <> '{FOCUS}'),
  {MOMENTS_SQL} SELECT subject, n, n - 3 AS res_df, round(b1, 5) AS b1, round(b2, 5) AS b2, round(1 - rss / tss, 5) AS r2, round(rss_reduced - rss, 3) AS sum_sq, round((rss_reduced - rss) / s2, 4) AS chi2 FROM s""")
def _(t):
    tests = attain.subject_gap_tests(t.facts, t.cohort(), FOCUS, "F", "O")
    digits = {"b1": 5, "b2": 5, "r2": 5, "sum_sq": 3, "chi2": 4}
    return tests.select("subject", "n", "res_df", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("nested_ols_anova_p", PAIR_SQL + f""", u AS (SELECT subject, points AS y, CAST(gender = 'O' AS DOUBLE) AS a, focus_points AS b FROM pairs WHERE gender IS NOT NULL AND subject <> '{FOCUS}'),
  {MOMENTS_SQL}, c2 AS (SELECT subject, (rss_reduced - rss) / s2 AS chi2, sqrt((rss_reduced - rss) / s2) AS z FROM s), {normal_tail_sql("c2", "subject")}
  SELECT subject, round(chi2, 4) AS chi2, round(p, 6) AS anova_p FROM c2 JOIN tails USING (subject)""")
def _(t):
    tests = stats.anova_p(attain.subject_gap_tests(t.facts, t.cohort(), FOCUS, "F", "O"))
    return rounded(tests.select("subject", "chi2", "anova_p"), chi2=4, anova_p=6)


@query("logit_uptake_flag", """people AS (SELECT * FROM cohort WHERE flag IS NOT NULL AND gender IS NOT NULL), offered AS (SELECT DISTINCT provider, subject FROM facts),
  p AS (SELECT o.subject, c.gender, count(CASE WHEN flag = 0 THEN 1 END) AS n0, count(CASE WHEN flag = 1 THEN 1 END) AS n1, count(CASE WHEN flag = 0 THEN f.points END) AS s0, count(CASE WHEN flag = 1 THEN f.points END) AS s1
    FROM people c JOIN offered o ON c.provider = o.provider LEFT JOIN facts f ON f.pupil = c.pupil AND f.provider = c.provider AND f.subject = o.subject GROUP BY ALL)
  SELECT subject, gender, n0 + n1 AS n, round(ln(s0 / (n0 - s0)), 6) AS b0, round(sqrt(1 / s0 + 1 / (n0 - s0)), 6) AS se0, round(ln(s1 / (n1 - s1)) - ln(s0 / (n0 - s0)), 6) AS b1,
    round(sqrt(1 / s0 + 1 / (n0 - s0) + 1 / s1 + 1 / (n1 - s1)), 6) AS se1 FROM p WHERE s0 > 0 AND s1 > 0 AND s0 < n0 AND s1 < n1""")
def _(t):
    fits = logit.logit_uptake_by_flag(t.cohort(), t.facts)
    return fits.select("subject", "gender", "n", *[F.round(c, 6).alias(c) for c in ("b0", "se0", "b1", "se1")])


def sitting(t):
    people = t.cohort().filter("gender IS NOT NULL AND score IS NOT NULL AND ethnicity IS NOT NULL")
    return people.select("pupil", "provider", "gender", "ethnicity", (F.col("score") / 100000).alias("score_100k"))


def newton_sql(keys: list[str], steps: int = 8) -> str:
    """The same fits as unrolled Newton steps: one CTE per step, x centred at 2.5."""
    k = ", ".join(keys)
    ctes = [f"""d AS (SELECT o.subject, c.gender, c.ethnicity, c.score / 100000 - 2.5 AS x, CAST(f.points IS NOT NULL AS INTEGER) AS y
    FROM cohort c JOIN (SELECT DISTINCT provider, subject FROM facts) o ON c.provider = o.provider LEFT JOIN facts f ON f.pupil = c.pupil AND f.provider = c.provider AND f.subject = o.subject
    WHERE c.gender IS NOT NULL AND c.ethnicity IS NOT NULL)""",
            f"""k0 AS (SELECT {k}, ln(avg(y) / (1 - avg(y))) AS a, 0.0::DOUBLE AS b, count(*) AS n, -2 * (sum(y) * ln(avg(y)) + (count(*) - sum(y)) * ln(1 - avg(y))) AS null_deviance
    FROM d GROUP BY {k} HAVING avg(y) > 0 AND avg(y) < 1)"""]
    for i in range(steps):
        ctes.append(f"""p{i} AS MATERIALIZED (SELECT {k}, d.x, d.y, a, b, n, null_deviance, 1 / (1 + exp(-(a + b * d.x))) AS p FROM d JOIN k{i} USING ({k})),
  h{i} AS (SELECT {k}, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, any_value(null_deviance) AS null_deviance, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00,
    sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11, -2 * sum(y * ln(p) + (1 - y) * ln(1 - p)) AS deviance FROM p{i} GROUP BY {k}),
  k{i + 1} AS MATERIALIZED (SELECT {k}, n, null_deviance, deviance, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b,
    h11 / (h00 * h11 - h01 * h01) AS va, -h01 / (h00 * h11 - h01 * h01) AS cab, h00 / (h00 * h11 - h01 * h01) AS vb FROM h{i})""")
    ctes.append(f"fits AS (SELECT {k}, n, null_deviance, deviance, a - 2.5 * b AS b0, b AS b1, sqrt(va - 5 * cab + 6.25 * vb) AS se0, sqrt(vb) AS se1 FROM k{steps})")
    return ",\n  ".join(ctes)


def simple_logit(t):
    return logit.uptake_fits(sitting(t), t.facts, ["gender"], "score_100k")


def rounded_rows(rows):
    return rows.withColumns({"est": F.round("est", 5), "std_error": F.round("std_error", 5), "z": F.round("z", 3)})


@query("logit_uptake", newton_sql(["subject", "gender"]) + """ SELECT subject, gender, n, '(Intercept)' AS term, round(b0, 5) AS est, round(se0, 5) AS std_error, round(b0 / se0, 3) AS z FROM fits
  UNION ALL SELECT subject, gender, n, 'score_100k', round(b1, 5), round(se1, 5), round(b1 / se1, 3) FROM fits""")
def _(t):
    return rounded_rows(logit.coefficient_rows(simple_logit(t), ["subject", "gender"], "score_100k").drop("p"))


@query("logit_uptake_p", newton_sql(["subject", "gender"]) + """, terms AS (SELECT subject, gender, '(Intercept)' AS term, b0 / se0 AS z FROM fits UNION ALL SELECT subject, gender, 'score_100k', b1 / se1 FROM fits),
  """ + normal_tail_sql("terms", "subject, gender, term") + f" SELECT subject, gender, term, round(z, 3) AS z, round(p, 6) AS p, {STARS_SQL} AS marks FROM terms JOIN tails USING (subject, gender, term)")
def _(t):
    rows = logit.coefficient_rows(simple_logit(t), ["subject", "gender"], "score_100k")
    return rounded(rows.withColumn("marks", scales.stars(F.col("p"))).select("subject", "gender", "term", "z", "p", "marks"), z=3, p=6)


@query("logit_interaction", newton_sql(["subject", "gender", "ethnicity"]) + """, base AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY subject, gender ORDER BY n DESC, ethnicity DESC) = 1),
  j AS (SELECT f.*, f.ethnicity = b.ethnicity AS is_base, b.b0 AS c0, b.b1 AS c1, b.se0 AS e0, b.se1 AS e1 FROM fits f JOIN base b ON f.subject = b.subject AND f.gender = b.gender),
  r AS (SELECT subject, gender, n, CASE WHEN is_base THEN '(Intercept)' ELSE ethnicity END AS term, CASE WHEN is_base THEN b0 ELSE b0 - c0 END AS est, CASE WHEN is_base THEN se0 ELSE sqrt(se0 ** 2 + e0 ** 2) END AS std_error FROM j
    UNION ALL SELECT subject, gender, n, CASE WHEN is_base THEN 'score_100k' ELSE 'score_100k:' || ethnicity END, CASE WHEN is_base THEN b1 ELSE b1 - c1 END, CASE WHEN is_base THEN se1 ELSE sqrt(se1 ** 2 + e1 ** 2) END FROM j)
  SELECT subject, gender, n, term, round(est, 5) AS est, round(std_error, 5) AS std_error, round(est / std_error, 3) AS z FROM r""")
def _(t):
    fits = logit.uptake_fits(sitting(t), t.facts, ["gender", "ethnicity"], "score_100k")
    rows = logit.logit_interaction(fits, ["subject", "gender"], "score_100k", "ethnicity")
    return rounded_rows(rows.drop("p"))


@query("logit_fit_quality", newton_sql(["subject", "gender"]) + """ SELECT subject, gender, n, round(null_deviance - deviance, 4) AS chi2, 1 AS chi2_df, round(1 - deviance / null_deviance, 7) AS r2_hosmer,
    round(1 - exp(-(null_deviance - deviance) / n), 7) AS r2_cox, round((1 - exp(-(null_deviance - deviance) / n)) / (1 - exp(-null_deviance / n)), 7) AS r2_nagelkerke,
    round(exp(b0 - 1.959963984540054 * se0), 5) AS or0_low, round(exp(b0 + 1.959963984540054 * se0), 5) AS or0_high, round(exp(b1 - 1.959963984540054 * se1), 5) AS or1_low, round(exp(b1 + 1.959963984540054 * se1), 5) AS or1_high FROM fits""")
def _(t):
    quality = logit.logit_fit_quality(simple_logit(t), "score_100k")
    digits = {"chi2": 4, "r2_hosmer": 7, "r2_cox": 7, "r2_nagelkerke": 7, "or0_low": 5, "or0_high": 5, "or1_low": 5, "or1_high": 5}
    return quality.select("subject", "gender", "n", "chi2_df", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("logit_fit_quality_p", newton_sql(["subject", "gender"]) + """, c2 AS (SELECT subject, gender, null_deviance - deviance AS chi2, sqrt(greatest(null_deviance - deviance, 0)) AS z FROM fits),
  """ + normal_tail_sql("c2", "subject, gender") + " SELECT subject, gender, round(chi2, 4) AS chi2, 1 AS chi2_df, round(p, 6) AS p FROM c2 JOIN tails USING (subject, gender)")
def _(t):
    return rounded(logit.logit_fit_quality(simple_logit(t), "score_100k").select("subject", "gender", "chi2", "chi2_df", "p"), chi2=4, p=6)


@query("significance_stars", """p AS (SELECT pupil, score / 1000000 AS p FROM pupils)
  SELECT pupil, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '** ' WHEN p < 0.05 THEN '*  ' WHEN p < 0.1 THEN '.  ' ELSE '   ' END AS marks FROM p""")
def _(t):
    return t.pupils.select("pupil", scales.stars(F.col("score") / 1000000).alias("marks"))


HEALTH = ["gender", "ethnicity", "flag", "sen", "prior"]


@query("field_health", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) AS n, count(*) - count({c}) AS missing, count({c}) AS present, round((count(*) - count({c})) / count(*), 6) AS missing_share FROM pupils" for c in HEALTH))
def _(t):
    return stats.field_health(t.pupils, HEALTH)


@query("missing_report", "SELECT count(*) AS n, count(*) - count(ethnicity) AS missing, round(100.0 * (count(*) - count(ethnicity)) / count(*), 2) AS per FROM pupils")
def _(t):
    return stats.missing_report(t.pupils, "ethnicity")


@query("dedupe_report", "SELECT count(*) AS n, count(DISTINCT pupil) AS ids, count(*) - count(DISTINCT pupil) AS surplus, round(100.0 * (count(*) - count(DISTINCT pupil)) / count(*), 2) AS per FROM results")
def _(t):
    return stats.dedupe_report(t.results, "pupil")
