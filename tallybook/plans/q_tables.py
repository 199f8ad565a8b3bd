"""Queries: reshaping (R), windows (W), sorts and top-k (K), totals (G), sets (U)."""

from pyspark.sql import functions as F

from ..operators import rank, reshape, totals
from ..operators.common import percent
from .q_link import SUBJECTS, WIDE_SQL
from .registry import query
from .testbed import FOCUS


@query("spread_subjects", f"SELECT pupil, provider, {WIDE_SQL} FROM facts GROUP BY pupil, provider")
def _(t):
    return reshape.spread_subjects(t.facts, SUBJECTS)


@query("gather_subjects", "SELECT pupil, provider, 'X' || substr(subject, 7) AS subject, points FROM facts")
def _(t):
    return reshape.gather_subjects(reshape.spread_subjects(t.facts, SUBJECTS))


PIVOT_SQL = ", ".join(
    f"count(CASE WHEN subject = '{s}' AND gender = '{g}' THEN 1 END) AS \"{s}_{g}\"" for s in SUBJECTS for g in "FO"
)


@query("pivot_composite", f"SELECT provider, {PIVOT_SQL} FROM facts JOIN pupils USING (pupil) GROUP BY provider")
def _(t):
    df = t.facts.join(t.pupils.select("pupil", "gender"), "pupil")
    return reshape.pivot_composite(df, ["provider"], "subject", "gender", [f"{s}_{g}" for s in SUBJECTS for g in "FO"])


@query("complete_combinations", """n AS (SELECT subject, gender, flag, ethnicity, eth_minor, count(*) AS n FROM facts JOIN pupils USING (pupil)
    GROUP BY ALL),
  grid AS (SELECT * FROM (SELECT DISTINCT subject FROM n) CROSS JOIN (SELECT DISTINCT gender FROM n) CROSS JOIN (SELECT DISTINCT flag FROM n)
    CROSS JOIN (SELECT DISTINCT ethnicity, eth_minor FROM n))
  SELECT g.*, coalesce(n.n, 0) AS n FROM grid g LEFT JOIN n ON g.subject = n.subject AND g.gender IS NOT DISTINCT FROM n.gender
    AND g.flag IS NOT DISTINCT FROM n.flag AND g.ethnicity IS NOT DISTINCT FROM n.ethnicity AND g.eth_minor = n.eth_minor""")
def _(t):
    people = t.pupils.select("pupil", "gender", "flag", "ethnicity", "eth_minor")
    counts = (
        t.facts.join(people, "pupil")
        .groupBy("subject", "gender", "flag", "ethnicity", "eth_minor").agg(F.count("*").alias("n"))
    )
    return reshape.complete_combinations(counts, ["subject", "gender", "flag"], ("ethnicity", "eth_minor"), "n")


@query("stack_years", f"""y AS (SELECT f.year, sch_type, round(100.0 * count(CASE WHEN subject = '{FOCUS}' THEN 1 END) / count(*), 1) AS share
    FROM facts f JOIN providers USING (provider) GROUP BY f.year, sch_type)
  SELECT sch_type, share, year, 'Computing' AS subject_name FROM y WHERE sch_type IN ('Community school', 'Academy converter') AND year BETWEEN 1996 AND 1999""")
def _(t):
    yearly = (
        t.facts.join(t.providers.select("provider", "sch_type"), "provider").groupBy("year", "sch_type")
        .agg(percent(F.count(F.when(F.col("subject") == FOCUS, 1)), F.count("*")).alias("share"))
    )
    return reshape.stack_years(yearly, "sch_type", "share", ["COMMUNITY SCHOOL", "academy converter"], range(1996, 2000), "Computing")


@query("measures_to_rows", """y AS (SELECT year, count(*)::DOUBLE AS entries, count(DISTINCT pupil)::DOUBLE AS pupils FROM facts GROUP BY year)
  SELECT year, type, percentage FROM y UNPIVOT (percentage FOR type IN (entries, pupils))""")
def _(t):
    y = t.facts.groupBy("year").agg(F.count("*").alias("entries"), F.countDistinct("pupil").alias("pupils"))
    return reshape.measures_to_rows(y, ["year"], ["entries", "pupils"])


def by_subject_gender(t):
    return (
        t.facts.join(t.pupils.select("pupil", "gender"), "pupil").groupBy("subject", "gender").agg(F.count("*").alias("n"))
    )


@query("group_total_share", """n AS (SELECT subject, gender, count(*) AS n FROM facts JOIN pupils USING (pupil) GROUP BY subject, gender)
  SELECT *, CAST(sum(n) OVER (PARTITION BY subject) AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (PARTITION BY subject), 2) AS share FROM n""")
def _(t):
    return rank.group_total_share(by_subject_gender(t), ["subject"])


SIZES_SQL = "sizes AS (SELECT subject, provider, count(*) AS size FROM facts GROUP BY subject, provider)"


def cohort_sizes(t):
    return t.facts.groupBy("subject", "provider").agg(F.count("*").alias("size"))


@query("running_total", SIZES_SQL + """, h AS (SELECT subject, size, count(*) AS n FROM sizes GROUP BY subject, size)
  SELECT *, CAST(sum(n) OVER (PARTITION BY subject ORDER BY size) AS BIGINT) AS cumulative, CAST(sum(n) OVER (PARTITION BY subject) AS BIGINT) AS total,
    round(100.0 * sum(n) OVER (PARTITION BY subject ORDER BY size) / sum(n) OVER (PARTITION BY subject), 1) AS per FROM h""")
def _(t):
    histogram = cohort_sizes(t).groupBy("subject", "size").agg(F.count("*").alias("n"))
    return rank.running_total(histogram, ["subject"], "size")


@query("dense_rank_desc", f"""n AS (SELECT authority, nullif(count(CASE WHEN subject = '{FOCUS}' THEN 1 END) // 10, 7) AS n
    FROM facts JOIN providers USING (provider) GROUP BY authority)
  SELECT authority, n, CASE WHEN n IS NOT NULL THEN dense_rank() OVER (ORDER BY n DESC NULLS LAST) END AS place FROM n""")
def _(t):
    n = (
        t.facts.join(t.providers.select("provider", "authority"), "provider").groupBy("authority")
        .agg(F.floor(F.count(F.when(F.col("subject") == FOCUS, 1)) / 10).alias("n"))
        .withColumn("n", F.nullif("n", F.lit(7)))
    )
    return n.withColumn("place", rank.dense_rank_desc("n"))


@query("ntile_bands", """n AS (SELECT pupil, gender, CASE WHEN score > 30000 THEN floor(score / 5000) END AS band_score FROM pupils)
  SELECT pupil, gender, band_score, CAST(ntile(10) OVER (PARTITION BY gender ORDER BY band_score, pupil) AS INTEGER) AS band FROM n WHERE band_score IS NOT NULL
  UNION ALL SELECT pupil, gender, band_score, NULL FROM n WHERE band_score IS NULL""")
def _(t):
    score = F.col("score")
    df = t.pupils.select("pupil", "gender", F.when(score > 30000, F.floor(score / 5000)).alias("band_score"))
    return rank.ntile_bands(df, ["gender"], "band_score", "pupil", 10)


@query("keep_group_max", "SELECT * FROM facts QUALIFY points = max(points) OVER (PARTITION BY pupil)")
def _(t):
    return rank.keep_group_max(t.facts, ["pupil"], "points")


@query("first_n_rows", "SELECT pupil, provider, score FROM cohort ORDER BY score DESC, pupil LIMIT 20")
def _(t):
    df = t.cohort().select("pupil", "provider", "score")
    return rank.first_n_rows(df, 20, F.desc("score"), F.asc("pupil"))


@query("group_median", SIZES_SQL + " SELECT subject, median(size) AS median FROM sizes GROUP BY subject")
def _(t):
    return rank.group_quantiles(cohort_sizes(t), ["subject"], "size", {"median": 0.5})


@query("group_quantile", SIZES_SQL + """ SELECT subject, quantile_cont(size, 0.1) AS q10, quantile_cont(size, 0.25) AS q25,
  quantile_cont(size, 0.75) AS q75, quantile_cont(size, 0.9) AS q90 FROM sizes GROUP BY subject""")
def _(t):
    quantiles = {"q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}
    return rank.group_quantiles(cohort_sizes(t), ["subject"], "size", quantiles)


@query("iqr_outliers", SIZES_SQL + """, q AS (SELECT subject, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.75) AS q3 FROM sizes GROUP BY subject)
  SELECT s.*, size > q3 + 1.5 * (q3 - q1) AS outlier_high, size < q1 - 1.5 * (q3 - q1) AS outlier_low FROM sizes s JOIN q USING (subject)""")
def _(t):
    return rank.iqr_outliers(cohort_sizes(t), "subject", "size")


@query("key_multiplicity", "n AS (SELECT pupil, subject, points, count(*) OVER (PARTITION BY pupil, subject) AS n FROM results) SELECT * FROM n WHERE n > 1")
def _(t):
    return rank.key_multiplicity(t.results.select("pupil", "subject", "points"), ["pupil", "subject"]).filter("n > 1")


@query("top_subjects", f"""n AS (SELECT subject, count(*) AS n FROM facts GROUP BY subject), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, subject) AS place FROM n)
  SELECT subject, n FROM r WHERE place <= 4 UNION ALL
  SELECT subject, n FROM r WHERE CASE WHEN (SELECT place FROM r WHERE subject = '{FOCUS}') <= 5 THEN place = 5 ELSE subject = '{FOCUS}' END""")
def _(t):
    return rank.top_subjects(t.facts, FOCUS, 5)


TIES_SQL = SIZES_SQL + """, n AS (SELECT provider, sum(size)::BIGINT AS n FROM sizes GROUP BY provider)
  SELECT provider, n, 'top' AS side FROM n QUALIFY rank() OVER (ORDER BY n DESC) <= 5
  UNION ALL SELECT provider, n, 'bottom' FROM n QUALIFY rank() OVER (ORDER BY n) <= 5"""


@query("top_n_ties", TIES_SQL)
def _(t):
    n = t.facts.groupBy("provider").agg(F.count("*").alias("n"))
    top = rank.top_n_ties(n, 5, "n").withColumn("side", F.lit("top"))
    return top.unionByName(rank.top_n_ties(n, 5, "n", bottom=True).withColumn("side", F.lit("bottom")))


def authority_entries(t):
    return t.facts.join(t.providers.select("provider", "authority"), "provider").groupBy("authority").agg(
        F.count("*").alias("entries"), F.count(F.when(F.col("subject") == FOCUS, 1)).alias("focus_entries")
    )


AUTHORITY_SQL = f"""a AS (SELECT authority, count(*) AS entries, count(CASE WHEN subject = '{FOCUS}' THEN 1 END) AS focus_entries
  FROM facts JOIN providers USING (provider) GROUP BY authority)"""


@query("top_rows_with_total", AUTHORITY_SQL + """ (SELECT authority, entries, focus_entries FROM a ORDER BY focus_entries DESC, authority LIMIT 5)
  UNION ALL SELECT 'Totals', sum(entries)::BIGINT, sum(focus_entries)::BIGINT FROM a""")
def _(t):
    table = totals.total_row(authority_entries(t), ["authority"], ["entries", "focus_entries"]).drop("is_total")
    return rank.top_rows_with_total(table, 5, "authority", "Totals", F.desc("focus_entries"), F.asc("authority"))


@query("zeros_last", """m AS (SELECT provider, count(CASE WHEN points > 48 THEN 1 END) AS n FROM facts GROUP BY provider),
  x AS (SELECT provider, CASE WHEN n = 1 THEN 'X' ELSE CAST(n AS VARCHAR) END AS n FROM m)
  SELECT *, coalesce(CAST(TRY_CAST(n AS DOUBLE) = 0 AS INTEGER), 0) AS zero_last FROM x""")
def _(t):
    n = t.facts.groupBy("provider").agg(F.count(F.when(F.col("points") > 48, 1)).alias("n"))
    return rank.zeros_last(n.withColumn("n", F.when(F.col("n") == 1, "X").otherwise(F.col("n").cast("string"))), "n")


@query("numeric_text_order", AUTHORITY_SQL + """ SELECT authority, CASE WHEN focus_entries < 80 THEN 'X' ELSE CAST(focus_entries AS VARCHAR) END AS n,
    CASE WHEN focus_entries < 80 THEN NULL ELSE CAST(focus_entries AS DOUBLE) END AS sort_value FROM a""")
def _(t):
    n = F.when(F.col("focus_entries") < 80, "X").otherwise(F.col("focus_entries").cast("string"))
    return rank.numeric_text_order(authority_entries(t).select("authority", n.alias("n")), "n")


@query("size_filtered_head", f"""n AS (SELECT provider, count(*) AS entries, count(CASE WHEN subject = '{FOCUS}' THEN 1 END) AS takers FROM facts GROUP BY provider),
  m AS (SELECT provider, entries, CASE WHEN takers = 3 THEN 'Y' ELSE CAST(takers AS VARCHAR) END AS takers FROM n)
  SELECT * FROM m WHERE TRY_CAST(takers AS DOUBLE) >= 4 OR (takers = 'Y' AND entries > 35) ORDER BY entries DESC, provider LIMIT 30""")
def _(t):
    n = t.facts.groupBy("provider").agg(
        F.count("*").alias("entries"), F.count(F.when(F.col("subject") == FOCUS, 1)).alias("takers")
    )
    masked = n.withColumn("takers", F.when(F.col("takers") == 3, "Y").otherwise(F.col("takers").cast("string")))
    return rank.size_filtered_head(masked, "entries", "takers", 4, 30, F.desc("entries"), F.asc("provider"))


@query("total_row", f"""g AS (SELECT region, trust, count(*) AS entries, count(CASE WHEN subject = '{FOCUS}' THEN 1 END) AS focus_entries
    FROM facts JOIN providers USING (provider) GROUP BY region, trust),
  u AS (SELECT region, trust, false AS is_total, entries, focus_entries FROM g
    UNION ALL SELECT 'Totals', '', true, sum(entries)::BIGINT, sum(focus_entries)::BIGINT FROM g)
  SELECT *, round(100.0 * focus_entries / entries, 1) AS per FROM u""")
def _(t):
    g = t.facts.join(t.providers.select("provider", "region", "trust"), "provider").groupBy("region", "trust").agg(
        F.count("*").alias("entries"), F.count(F.when(F.col("subject") == FOCUS, 1)).alias("focus_entries")
    )
    table = totals.total_row(g, ["region", "trust"], ["entries", "focus_entries"])
    return table.withColumn("per", percent("focus_entries", "entries"))


@query("triple_totals", AUTHORITY_SQL + """ SELECT 'TOTAL' AS authority, sum(entries)::BIGINT AS entries, sum(focus_entries)::BIGINT AS focus_entries,
    round(100.0 * sum(focus_entries) / sum(entries), 1) AS per FROM a""")
def _(t):
    table = authority_entries(t).withColumn("per", percent("focus_entries", "entries"))
    return totals.triple_totals(table, ["authority"], [("entries", "focus_entries", "per")])


@query("union_all", """SELECT pupil AS id, gender, NULL AS sch_gender FROM pupils UNION ALL SELECT provider, NULL, sch_gender FROM providers""")
def _(t):
    a = t.pupils.select(F.col("pupil").alias("id"), "gender")
    return a.unionByName(t.providers.select(F.col("provider").alias("id"), "sch_gender"), allowMissingColumns=True)


@query("distinct_on", "SELECT DISTINCT provider, subject, level FROM results")
def _(t):
    return t.results.dropDuplicates(["provider", "subject", "level"]).select("provider", "subject", "level")


@query("intersect_keys", "SELECT provider FROM facts INTERSECT SELECT provider FROM providers WHERE sch_gender = 'Mixed'")
def _(t):
    return t.facts.select("provider").intersect(t.providers.filter("sch_gender = 'Mixed'").select("provider"))


@query("except_keys", f"SELECT provider FROM providers EXCEPT ALL SELECT provider FROM facts WHERE subject = '{FOCUS}'")
def _(t):
    return t.providers.select("provider").exceptAll(t.facts.filter(F.col("subject") == FOCUS).select("provider"))


@query("symmetric_missing", "SELECT provider, trust, sch_urban FROM providers WHERE (trust IS NULL) <> (sch_urban IS NULL)")
def _(t):
    return t.providers.select("provider", "trust", "sch_urban").filter(F.col("trust").isNull() != F.col("sch_urban").isNull())
