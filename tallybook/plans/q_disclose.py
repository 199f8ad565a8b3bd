"""Queries: disclosure control (D)."""

from pyspark.sql import functions as F

from ..operators import disclose, uptake
from ..operators.common import count_if, percent
from ..session import stored
from .q_uptake import PROFILE_SQL, profiles
from .registry import query
from .testbed import FOCUS

# Provider tables: pupils, takers, share; and by gender.
SMALL_SQL = """small AS (SELECT provider, count(*) AS total, count(focus_points) AS part, round(100.0 * count(focus_points) / count(*), 4) AS per FROM cohort GROUP BY provider)"""


def small(t):
    return t.cohort().groupBy("provider").agg(F.count("*").alias("total"), F.count("focus_points").alias("part")).withColumn(
        "per", percent("part", "total", 4)
    )


@query("suppress_small", SMALL_SQL + """ SELECT provider, part, CASE WHEN total < 6 THEN 0 ELSE total END AS total, CASE WHEN total < 6 THEN 0 ELSE per END AS per,
  CASE WHEN total < 6 THEN 'X' ELSE '' END AS anon FROM small""")
def _(t):
    return disclose.suppress_small(small(t), "total", "per")


def triple_sql(source: str, whole: str, part: str, per: str, limit: str = "6", name: str = "s") -> str:
    """The masking steps of one triple, one CTE per step."""
    return f"""{name}1 AS (SELECT * REPLACE (CASE WHEN {whole} > 0 AND {whole} < {limit} THEN -1 ELSE {whole} END AS {whole}) FROM {source}),
  {name}2 AS (SELECT * REPLACE (CASE WHEN {part} > 0 AND {part} < {limit} THEN -1 WHEN {whole} - {part} > 0 AND {whole} - {part} < {limit} THEN -2 ELSE {part} END AS {part}) FROM {name}1),
  {name}3 AS (SELECT * REPLACE (CASE WHEN {part} IN (-1, -2) THEN {part} ELSE round({per}, 1) END AS {per}) FROM {name}2)"""


def five_sql(x: str) -> str:
    return f"CASE WHEN {x} IN (6, 7) THEN 6 WHEN {x} IN (-1, -2, 1, 2, 3, 4, 5) THEN {x} ELSE CAST(round({x} / 5) * 5 AS BIGINT) END"


def round_sql(source: str, whole: str, part: str, per: str, name: str) -> str:
    return f"""{name}0 AS (SELECT * REPLACE ({five_sql(whole)} AS {whole}, {five_sql(part)} AS {part}) FROM {source}),
  {name} AS (SELECT * REPLACE (CASE WHEN {whole} = 0 THEN 0 WHEN {part} IN (-1, -2, 0) THEN {part} ELSE round(100.0 * {part} / {whole}, 1) END AS {per}) FROM {name}0)"""


@query("suppress_triple", SMALL_SQL + ", " + triple_sql("small", "total", "part", "per") + " SELECT * FROM s3")
def _(t):
    return disclose.suppress_triple(small(t), ("total", "part", "per"))


AUTHORITY_SQL = """areas AS (SELECT authority, count(DISTINCT provider) AS providers, count(*) AS total, count(focus_points) AS part, round(100.0 * count(focus_points) / count(*), 4) AS per
  FROM cohort GROUP BY authority)"""


def areas(t):
    return t.cohort().groupBy("authority").agg(
        F.countDistinct("provider").alias("providers"), F.count("*").alias("total"), F.count("focus_points").alias("part")
    ).withColumn("per", percent("part", "total", 4))


@query("suppress_triple_by_providers", AUTHORITY_SQL + ", " + triple_sql("areas", "total", "part", "per", "(providers + 5)") + " SELECT * FROM s3")
def _(t):
    return disclose.suppress_triple_by_providers(areas(t), ("total", "part", "per"), "providers")


TEN_SQL = """ten AS (SELECT sch_urban || ' / ' || sch_gender || ' / ' || authority AS name, count(DISTINCT provider) AS providers, count(DISTINCT CASE WHEN focus_points IS NOT NULL THEN provider END) AS sub_providers,
    count(DISTINCT CASE WHEN focus_points IS NOT NULL AND gender = 'F' THEN provider END) AS female_providers, count(*) AS students, count(CASE WHEN gender = 'F' THEN 1 END) AS females,
    round(100.0 * count(CASE WHEN gender = 'F' THEN 1 END) / count(*), 1) AS female_per, count(focus_points) AS sub_students, count(CASE WHEN gender = 'F' THEN focus_points END) AS sub_females,
    coalesce(round(100.0 * count(CASE WHEN gender = 'F' THEN focus_points END) / nullif(count(focus_points), 0), 1), 0) AS sub_female_per FROM cohort GROUP BY 1)"""
TEN = ["name", "providers", "sub_providers", "female_providers", "students", "females", "female_per", "sub_students", "sub_females", "sub_female_per"]
FIRST, SECOND_TRIPLE = ("students", "females", "female_per"), ("sub_students", "sub_females", "sub_female_per")


def ten(t):
    female, sub = F.col("gender") == "F", F.col("focus_points").isNotNull()
    name = F.concat("sch_urban", F.lit(" / "), "sch_gender", F.lit(" / "), "authority").alias("name")
    per_provider = t.cohort().groupBy(name, "provider").agg(
        F.count("*").alias("n"), count_if(female).alias("f"), count_if(sub).alias("s"), count_if(female & sub).alias("sf")
    )
    return per_provider.groupBy("name").agg(
        F.count("*").alias("providers"), count_if(F.col("s") > 0).alias("sub_providers"), count_if(F.col("sf") > 0).alias("female_providers"),
        F.sum("n").alias("students"), F.sum("f").alias("females"), F.sum("s").alias("sub_students"), F.sum("sf").alias("sub_females"),
    ).withColumns({
        "female_per": percent("females", "students"), "sub_female_per": F.coalesce(percent("sub_females", "sub_students"), F.lit(0.0)),
    }).select(*TEN)


CROSS = """{n}1 AS (SELECT * REPLACE (CASE WHEN students - sub_students > 0 AND students - sub_students < 6 THEN -2 ELSE sub_students END AS sub_students,
    CASE WHEN females - sub_females > 0 AND females - sub_females < 6 THEN -2 ELSE sub_females END AS sub_females) FROM {source}),
  {n} AS (SELECT * REPLACE (CASE WHEN sub_females = -2 THEN -2 ELSE round(sub_female_per, 1) END AS sub_female_per) FROM {n}1)"""


@query("suppress_cross", TEN_SQL + ", " + CROSS.format(n="x", source="ten") + " SELECT * FROM x")
def _(t):
    return disclose.suppress_cross(ten(t), FIRST, SECOND_TRIPLE)


@query("round_to_five", TEN_SQL + ", " + round_sql("ten", *FIRST, "a") + " SELECT * FROM a")
def _(t):
    return disclose.round_to_five(ten(t), FIRST)


def text_sql(source: str, counts, percents, labels=("name",)) -> str:
    cells = [*labels]
    cells += [f"CASE {c} WHEN -1 THEN 'X' WHEN -2 THEN 'Y' ELSE CAST(CAST({c} AS BIGINT) AS VARCHAR) END AS {c}" for c in counts]
    cells += [f"CASE {c} WHEN -1 THEN 'X' WHEN -2 THEN 'Y' ELSE printf('%.1f', CAST({c} AS DOUBLE)) END AS {c}" for c in percents]
    return f"SELECT {', '.join(cells)} FROM {source}"


EXTRAS = ["providers", "sub_providers", "female_providers"]
COUNTS, PERCENTS = [*EXTRAS, "students", "females", "sub_students", "sub_females"], ["female_per", "sub_female_per"]


def totals_sql(source: str) -> str:
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTS)
    return f"""tot0 AS (SELECT 'TOTAL' AS name, {sums} FROM {source}),
  tot AS (SELECT *, CASE WHEN students = 0 OR females = 0 THEN 0 ELSE round(100.0 * females / students, 1) END AS female_per,
    CASE WHEN sub_students = 0 OR sub_females = 0 THEN 0 ELSE round(100.0 * sub_females / sub_students, 1) END AS sub_female_per FROM tot0)"""


KNOWN = "known AS (SELECT * FROM ten WHERE name IS NOT NULL)"


@query("anonymise_table", ", ".join([
    TEN_SQL, KNOWN, round_sql("known", *FIRST, "ra"), round_sql("ra", *SECOND_TRIPLE, "rb"), totals_sql("rb"),
    triple_sql("known", *FIRST, name="p"), triple_sql("p3", *SECOND_TRIPLE, name="q"), CROSS.format(n="x", source="q3"),
    triple_sql("x", *FIRST, limit="(female_providers + 5)", name="u"), triple_sql("u3", *SECOND_TRIPLE, limit="(female_providers + 5)", name="v"),
    round_sql("v3", *FIRST, "wa"), round_sql("wa", *SECOND_TRIPLE, "wb"),
]) + " " + text_sql("wb", COUNTS, PERCENTS) + " UNION ALL " + text_sql("tot", COUNTS, PERCENTS))
def _(t):
    return disclose.anonymise_table(ten(t), disclose.layout("ten", TEN, by_authority=True))


SEVEN = ["name", *FIRST, *SECOND_TRIPLE]


@query("anonymise_table_seven", ", ".join([
    TEN_SQL, KNOWN, round_sql("known", *FIRST, "ra"), round_sql("ra", *SECOND_TRIPLE, "rb"), totals_sql("rb"),
    triple_sql("rb", *FIRST, name="p"), triple_sql("p3", *SECOND_TRIPLE, name="q"), CROSS.format(n="x", source="q3"),
]) + " " + text_sql("x", COUNTS[3:], PERCENTS) + " UNION ALL " + text_sql("tot", COUNTS[3:], PERCENTS))
def _(t):
    return disclose.anonymise_table(ten(t).select(*SEVEN), disclose.layout("seven", SEVEN))


SIX_SQL = """six AS (SELECT CAST(provider AS VARCHAR) AS provider, sch_type, region, count(*) AS students, count(focus_points) AS sub_students, round(100.0 * count(focus_points) / count(*), 1) AS per
  FROM cohort GROUP BY ALL)"""
SIX = ["provider", "sch_type", "region", "students", "sub_students", "per"]


@query("anonymise_table_providers", ", ".join([
    SIX_SQL, round_sql("six", "students", "sub_students", "per", "r"), triple_sql("r", "students", "sub_students", "per", name="p"),
    "best AS (SELECT * FROM p3 WHERE sub_students >= 6 ORDER BY per DESC, provider, sch_type, region LIMIT 30)",
    """tot AS (SELECT 'TOTAL' AS provider, '' AS sch_type, '' AS region, sum(students)::BIGINT AS students, sum(sub_students)::BIGINT AS sub_students,
    CASE WHEN sum(sub_students) = 0 THEN 0 ELSE round(100.0 * sum(sub_students) / sum(students), 1) END AS per FROM r)""",
]) + " " + text_sql("best", SIX[3:5], SIX[5:], SIX[:3]) + " UNION ALL " + text_sql("tot", SIX[3:5], SIX[5:], SIX[:3]))
def _(t):
    table = t.cohort().groupBy(F.col("provider").cast("string").alias("provider"), "sch_type", "region").agg(
        F.count("*").alias("students"), F.count("focus_points").alias("sub_students")
    ).withColumn("per", percent("sub_students", "students"))
    return disclose.anonymise_table(table, disclose.layout("six", SIX), size=6, rows=30)


YOY_SQL = """yoy AS (SELECT sch_type, authority, count(*) AS students, count(CASE WHEN gender = 'F' THEN 1 END) AS females, round(100.0 * count(CASE WHEN gender = 'F' THEN 1 END) / count(*), 1) AS female_per,
    count(focus_points) AS sub_students, count(CASE WHEN gender = 'F' THEN focus_points END) AS sub_females,
    round(100.0 * count(CASE WHEN gender = 'F' THEN focus_points END) / nullif(count(focus_points), 0), 1) AS sub_female_per
  FROM cohort GROUP BY ALL)"""


@query("year_on_year", ", ".join([YOY_SQL, round_sql("yoy", *FIRST, "r"), triple_sql("r", *SECOND_TRIPLE, name="p")])
       + " " + text_sql("p3", COUNTS[3:], PERCENTS, ("sch_type", "authority")))
def _(t):
    female = F.col("gender") == "F"
    table = t.cohort().groupBy("sch_type", "authority").agg(
        F.count("*").alias("students"), F.count(F.when(female, 1)).alias("females"),
        F.count("focus_points").alias("sub_students"), F.count(F.when(female, F.col("focus_points"))).alias("sub_females"),
    ).withColumns({"female_per": percent("females", "students"), "sub_female_per": percent("sub_females", "sub_students")})
    return disclose.year_on_year(table, tuple(FIRST), tuple(SECOND_TRIPLE))


ROUND_ANY_SQL = PROFILE_SQL + """, g AS (SELECT sch_gender, authority, sum(sub_schools)::BIGINT AS sub_schools, sum(sub_students)::BIGINT AS sub_students FROM profiles GROUP BY ALL),
  r AS (SELECT sch_gender, authority, sub_schools, CASE WHEN (SELECT bool_or(sub_students <> 0 AND sub_schools > sub_students - 6) FROM g) AND sub_students <> 0
    THEN greatest(CAST(round(sub_students / 5) * 5 AS BIGINT), 5) ELSE sub_students END AS sub_students FROM g)"""


def rounded(t):
    table = profiles(t).groupBy("sch_gender", "authority").agg(F.sum("sub_schools").alias("sub_schools"), F.sum("sub_students").alias("sub_students"))
    return disclose.round_if_any_small(stored(table, "groups"), "sub_students", "sub_schools")


@query("round_if_any_small", ROUND_ANY_SQL + " SELECT * FROM r")
def _(t):
    return rounded(t)


@query("mask_small_groups", ROUND_ANY_SQL + """ SELECT sch_gender, authority, sub_schools, CASE WHEN authority = 'NATION_3' THEN CAST(sub_students AS VARCHAR) WHEN sub_schools > sub_students - 5 AND sub_students = 0 THEN '0'
    WHEN sub_schools > sub_students - 5 THEN 'X' ELSE CAST(sub_students AS VARCHAR) END AS sub_students FROM r""")
def _(t):
    return disclose.mask_small_groups(rounded(t), [("sub_students", "sub_schools", "sub_students")], F.col("authority") == "NATION_3")


@query("ceil_to_five", SMALL_SQL + " SELECT provider, CAST(ceil(total / 5) * 5 AS BIGINT) AS total FROM small")
def _(t):
    return small(t).select("provider", disclose.ceil_to(F.col("total")).alias("total"))


@query("mask_le_five", SMALL_SQL + " SELECT provider, CASE WHEN total <= 5 THEN 'X' ELSE CAST(CAST(round(total / 5) * 5 AS BIGINT) AS VARCHAR) END AS total FROM small")
def _(t):
    return small(t).select("provider", disclose.mask_le_five(F.col("total")).alias("total"))


@query("map_safe_value", SMALL_SQL + """, m AS (SELECT provider, total, CASE WHEN part BETWEEN 1 AND 2 THEN 'X' ELSE CAST(part AS VARCHAR) END AS part,
    CASE WHEN part BETWEEN 1 AND 2 THEN 'X' ELSE printf('%.1f', round(per, 1)::DOUBLE) END AS per FROM small)
  SELECT provider, total, CASE WHEN part = 'X' THEN 6.0::DOUBLE ELSE TRY_CAST(part AS DOUBLE) END AS part,
    CASE WHEN per = 'X' THEN CASE WHEN 600.0 / total > 5 THEN 5.0::DOUBLE ELSE 600.0::DOUBLE / total END ELSE TRY_CAST(per AS DOUBLE) END AS per FROM m""")
def _(t):
    few = F.col("part").between(1, 2)
    table = small(t).select(
        "provider", "total", F.when(few, "X").otherwise(F.format_string("%.1f", F.round("per", 1))).alias("per"),
        F.when(few, "X").otherwise(F.col("part").cast("string")).alias("part"),
    )
    return disclose.map_safe_values(table, "total", "part", "per")


@query("mask_average_below", f"""a AS (SELECT provider, CASE WHEN count(CASE WHEN subject = '{FOCUS}' THEN 1 END) = 0 THEN 'Y' ELSE printf('%.1f', round(avg(CASE WHEN subject = '{FOCUS}' THEN points END), 1)::DOUBLE) END AS average
    FROM facts GROUP BY provider)
  SELECT provider, CASE WHEN TRY_CAST(average AS DOUBLE) < 25 THEN 'X' ELSE average END AS average FROM a""")
def _(t):
    points = F.when(F.col("subject") == FOCUS, F.col("points"))
    table = t.facts.groupBy("provider").agg(
        F.when(F.count(points) == 0, "Y").otherwise(F.format_string("%.1f", F.round(F.avg(points), 1))).alias("average")
    )
    return disclose.mask_average_below(table, ["average"], 25)


@query("published_small_cells", "SELECT 0 AS sub_students, count(CASE WHEN n BETWEEN 1 AND 5 THEN 1 END) AS unmasked FROM (SELECT provider, count(focus_points) AS n FROM cohort GROUP BY provider)")
def _(t):
    published = uptake.provision_by_criteria(profiles(t), ["authority"])
    counts = disclose.published_small_cells(published, ["sub_students"])
    raw = small(t).agg(count_if(F.col("part").between(1, 5)).alias("unmasked")).scalar()
    return counts.withColumn("unmasked", raw)
