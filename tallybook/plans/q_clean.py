"""Queries: cleaning operators (C)."""

from pyspark.sql import functions as F

from ..functions import scales, text
from ..operators import clean
from .registry import query

# Order columns standing in for the census flags, with blanks made by rule.
FLAGS_SQL = """flags AS (
  SELECT o_orderkey AS pupil, nullif(o_orderpriority, '1-URGENT') AS ks4_flag,
         nullif(o_orderpriority, '2-HIGH') AS ever_6, CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS ever_3,
         'eligible' AS eligible FROM orders)"""


@query("coalesce_flags", FLAGS_SQL + " SELECT pupil, coalesce(ks4_flag, ever_6, ever_3, eligible) AS ever_6 FROM flags")
def _(t):
    flags = t.table("orders").select(
        F.col("o_orderkey").alias("pupil"),
        F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("ks4_flag"),
        F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")).alias("ever_6"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("ever_3"),
        F.lit("eligible").alias("eligible"),
    )
    return clean.coalesce_flags(flags, "ever_6", "ks4_flag", "ever_6", "ever_3", "eligible").select("pupil", "ever_6")


@query("filter_record_type", """SELECT DISTINCT l_orderkey AS pupil, l_linenumber AS rectype, l_returnflag AS level
  FROM lineitem WHERE l_linenumber = 1""")
def _(t):
    rows = t.table("lineitem").select(
        F.col("l_orderkey").alias("pupil"),
        F.col("l_linenumber").alias("rectype"),
        F.col("l_returnflag").alias("level"),
        F.col("l_suppkey").alias("provider"),
    )
    return clean.filter_record_type(rows, "rectype", 1, "provider")


@query("distinct_rows", "SELECT DISTINCT pupil, subject, level FROM results")
def _(t):
    return t.results.select("pupil", "subject", "level").distinct()


@query("drop_ambiguous_keys", """records AS (SELECT DISTINCT pupil, level, grade FROM results)
  SELECT pupil, level, grade FROM records QUALIFY count(*) OVER (PARTITION BY pupil) = 1""")
def _(t):
    return clean.drop_ambiguous_keys(t.results.select("pupil", "level", "grade"), "pupil")


@query("best_attempt", """best AS (SELECT *, rank() OVER (PARTITION BY pupil, subject, qualification ORDER BY points DESC) AS r
    FROM results WHERE level IN ('A', 'R') AND year = 1998)
  SELECT DISTINCT pupil, provider, level, subject, qualification, points FROM best WHERE r = 1""")
def _(t):
    return clean.best_attempt(t.results, 1998, ["A", "R"])


@query("single_qualification", """best AS (SELECT *, rank() OVER (PARTITION BY pupil, provider, level, subject ORDER BY points DESC) AS r
    FROM results) SELECT DISTINCT pupil, provider, level, subject, points FROM best WHERE r = 1""")
def _(t):
    return clean.single_qualification(t.results)


@query("rescale_points", """half AS (SELECT pupil, provider, subject, points % 18 / 2 AS points FROM facts)
  SELECT pupil, provider, subject, CASE WHEN subject = 'Brand#5' THEN points
    WHEN points = 8.5 THEN 8 WHEN points = 7 THEN 7 WHEN points = 5.5 THEN 6 WHEN points = 4 THEN 5
    WHEN points = 3 THEN 4 WHEN points = 2 THEN 3 WHEN points = 1.5 THEN 2 WHEN points = 1 THEN 1
    ELSE points END AS points FROM half""")
def _(t):
    half = t.facts.withColumn("points", F.col("points") % 18 / 2)
    return clean.rescale_points(half, ["Brand#5"]).select("pupil", "provider", "subject", "points")


@query("supersede_level", """marked AS (SELECT pupil, subject, points,
    CASE WHEN level = 'R' AND subject >= 'Brand#2' THEN 'A' ELSE level END AS level FROM results)
  SELECT * FROM marked WHERE NOT (level = 'A' AND subject IN (SELECT subject FROM marked WHERE level = 'R'))""")
def _(t):
    marked = t.results.select(
        "pupil", "subject", "points",
        F.when((F.col("level") == "R") & (F.col("subject") >= "Brand#2"), "A").otherwise(F.col("level")).alias("level"),
    )
    return clean.supersede_level(marked, "R", "A")


@query("normalise_case", "SELECT c_custkey AS provider, upper(c_name) AS name FROM customer")
def _(t):
    return t.table("customer").select(F.col("c_custkey").alias("provider"), F.upper("c_name").alias("name"))


@query("normalise_postcode", "SELECT p_partkey AS id, replace(p_name, ' ', '') AS postcode FROM part")
def _(t):
    return t.table("part").select(F.col("p_partkey").alias("id"), text.no_spaces(F.col("p_name")).alias("postcode"))


@query("classify_provider", """SELECT provider, CASE WHEN contains(sch_type, 'special') THEN 'Special'
    WHEN contains(sch_type, 'inde') THEN 'Independent' WHEN contains(coalesce(selective, ''), 'Selective') THEN 'Grammar'
    ELSE 'Comprehensive' END AS class FROM providers""")
def _(t):
    return t.providers.select("provider", scales.provider_class(F.col("sch_type"), F.col("selective")).alias("class"))


@query("classify_provider_3", """SELECT provider, CASE WHEN contains(sch_type, 'inde') THEN 'Independent'
    WHEN contains(coalesce(selective, ''), 'Selective') THEN 'Grammar school' ELSE 'State non-selective' END AS class FROM providers""")
def _(t):
    return t.providers.select("provider", scales.provider_class_3(F.col("sch_type"), F.col("selective")).alias("class"))


@query("classify_urban", """SELECT provider, CASE WHEN contains(sch_urban, 'Rural') THEN 'Rural' ELSE 'Urban' END AS class
  FROM providers WHERE sch_urban IS NOT NULL""")
def _(t):
    return t.providers.select("provider", scales.urban_class(F.col("sch_urban")).alias("class")).dropna(subset=["class"])


@query("points_to_letter", """SELECT pupil, provider, subject, CASE CAST(points AS INTEGER) WHEN 0 THEN 'U' WHEN 1 THEN 'G' WHEN 2 THEN 'F'
    WHEN 3 THEN 'E' WHEN 4 THEN 'D' WHEN 5 THEN 'C' WHEN 6 THEN 'B' WHEN 7 THEN 'A' WHEN 8 THEN '*' WHEN 16 THEN 'G'
    WHEN 22 THEN 'F' WHEN 28 THEN 'E' WHEN 34 THEN 'D' WHEN 40 THEN 'C' WHEN 46 THEN 'B' WHEN 52 THEN 'A' WHEN 58 THEN '*' END AS letter,
    CASE CAST(points * 30 AS INTEGER) WHEN 300 THEN '*' WHEN 270 THEN 'A' WHEN 240 THEN 'B' WHEN 210 THEN 'C' WHEN 180 THEN 'D'
    WHEN 150 THEN 'E' WHEN 0 THEN 'U' END AS alevel FROM facts""")
def _(t):
    return t.facts.select(
        "pupil", "provider", "subject",
        scales.points_to_letter(F.col("points"), "GCSE").alias("letter"),
        scales.points_to_letter(F.col("points") * 30, "Alevel").alias("alevel"),
    )


@query("letter_to_points", """letters AS (SELECT pupil, provider, subject, substr('UGFEDCBA*?', CAST(points AS INTEGER) % 10 + 1, 1) AS letter FROM facts)
  SELECT *, CASE WHEN letter = '?' THEN NULL ELSE strpos('UGFEDCBA*', letter) - 1.0::DOUBLE END AS gcse,
    CASE letter WHEN '*' THEN 300.0::DOUBLE WHEN 'A' THEN 270 WHEN 'B' THEN 240 WHEN 'C' THEN 210 WHEN 'D' THEN 180 WHEN 'E' THEN 150 WHEN 'U' THEN 0 END AS alevel,
    CASE letter WHEN '*' THEN 70.0::DOUBLE WHEN 'A' THEN 60 WHEN 'B' THEN 50 WHEN 'C' THEN 40 WHEN 'D' THEN 30 WHEN 'E' THEN 20 WHEN 'U' THEN 0 END AS tariff FROM letters""")
def _(t):
    letter = F.substring(F.lit("UGFEDCBA*?"), F.col("points").cast("int") % 10 + 1, F.lit(1))
    df = t.facts.select("pupil", "provider", "subject", letter.alias("letter"))
    return df.select(
        "*",
        scales.letter_to_points(F.col("letter"), "GCSE").alias("gcse"),
        scales.letter_to_points(F.col("letter"), "Alevel").alias("alevel"),
        scales.letter_to_points(F.col("letter"), "tariff").alias("tariff"),
    )


@query("average_to_band", """averages AS (SELECT provider, round(avg(points) / 5, 4) AS average FROM facts GROUP BY provider)
  SELECT provider, average, CASE WHEN average > 7.5 THEN 'A*' WHEN average > 7 THEN 'A' WHEN average > 6.5 THEN 'A-'
    WHEN average > 6 THEN 'B*' WHEN average > 5.5 THEN 'B-' WHEN average > 5 THEN 'C' WHEN average > 4.5 THEN 'C-'
    WHEN average > 4 THEN 'D' WHEN average > 3.5 THEN 'D-' WHEN average > 3 THEN 'E' WHEN average > 2.5 THEN 'E-'
    WHEN average > 2 THEN 'F' WHEN average > 1.5 THEN 'F-' WHEN average > 1 THEN 'G' WHEN average > 0 THEN 'U' ELSE 'X' END AS band
  FROM averages""")
def _(t):
    df = t.facts.groupBy("provider").agg(F.round(F.avg("points") / 5, 4).alias("average"))
    return df.withColumn("band", scales.average_to_band(F.col("average")))


@query("decode_labels", """SELECT pupil, CASE sen WHEN 'N' THEN 'None' WHEN 'A' THEN 'School action' WHEN 'P' THEN 'School action plus'
    WHEN 'S' THEN 'Statement' WHEN 'E' THEN 'EHC plan' WHEN 'K' THEN 'SEN support' ELSE 'NA' END AS sen_name,
    CASE eal WHEN 1 THEN 'English' WHEN 2 THEN 'English Additional Language' WHEN 3 THEN 'Unclassified' ELSE 'NA' END AS eal_name,
    CASE ethnicity WHEN '1-URGENT' THEN 'White' WHEN '2-HIGH' THEN 'Asian' WHEN '3-MEDIUM' THEN 'Black' ELSE 'ERROR' END AS eth_name,
    CASE ethnicity WHEN '1-URGENT' THEN 'White Irish' WHEN '2-HIGH' THEN 'Indian' WHEN '3-MEDIUM' THEN 'Black African' ELSE 'ERROR' END AS minor_name
  FROM pupils""")
def _(t):
    major = F.create_map(*[F.lit(x) for x in ["1-URGENT", "WHIT", "2-HIGH", "ASIA", "3-MEDIUM", "BLAC", "5-LOW", "?"]])
    minor = F.create_map(*[F.lit(x) for x in ["1-URGENT", "WIRI", "2-HIGH", "AIND", "3-MEDIUM", "BAFR", "5-LOW", "?"]])
    return t.pupils.select(
        "pupil",
        scales.decode(F.col("sen"), scales.SEN_LABELS, "NA").alias("sen_name"),
        scales.decode(F.col("eal"), scales.EAL_LABELS, "NA").alias("eal_name"),
        scales.decode(major[F.col("ethnicity")], scales.ETHNICITY_MAJOR, "ERROR").alias("eth_name"),
        scales.decode(minor[F.col("ethnicity")], scales.ETHNICITY_MINOR, "ERROR").alias("minor_name"),
    )


@query("keyword_filter", """SELECT p_partkey AS qualification, p_name AS title FROM part
  WHERE regexp_matches(p_name, 'RING|^blue|gear$', 'i') AND NOT regexp_matches(p_name, 'SMALL', 'i')""")
def _(t):
    parts = t.table("part").select(F.col("p_partkey").alias("qualification"), F.col("p_name").alias("title"))
    return clean.keyword_filter(parts, "title", ["RING", "^blue", "gear$"], ["SMALL"])


TITLE_SQL = """titles AS (SELECT p_partkey AS id, CASE p_brand WHEN 'Brand#1' THEN '50085104' WHEN 'Brand#2' THEN NULL ELSE p_brand END AS qan,
    p_name || CASE p_size % 5 WHEN 0 THEN ' Information and Communication Technology (ICT)' WHEN 1 THEN ' in Information Technology at Level 2'
      WHEN 2 THEN ' Level 1/2 award' WHEN 3 THEN ' Entry Level information and communication technology' ELSE ' Level 1/Level 2' END AS name,
    CASE p_type WHEN 'PROMO' THEN 'Entry Level' ELSE 'Level 2' END AS level,
    CASE p_type WHEN 'PROMO' THEN 'GCSE (A* to G)' WHEN 'SMALL' THEN 'GCE A Level' WHEN 'LARGE' THEN 'Functional Skills' ELSE p_type END AS type FROM part)
  SELECT id, coalesce(qan, '') AS qan,
    CASE WHEN qan = '50085104' THEN 'AQA GCSE in ICT (short course)' ELSE
      replace(replace(replace(replace(replace(replace(replace(replace(replace(name, 'Information and Communication Technology (ICT)', 'ICT'),
      'information and communication technology', 'ICT'), 'Information Technology', 'IT'), 'at Level 2', ''), 'Entry Level', ''),
      'Level 1/2', ''), 'Level 1/Level 2', ''), 'Level 1', ''), 'Level 2', '') END AS name,
    replace(replace(level, 'Entry Level', 'Entry'), 'Level', '') AS level,
    CASE type WHEN 'GCSE (A* to G)' THEN 'GCSE' WHEN 'GCE A Level' THEN 'GCE A' WHEN 'Functional Skills' THEN 'Func skills' ELSE type END AS type
  FROM titles"""


@query("normalise_title", TITLE_SQL)
def _(t):
    brand, size, kind = F.col("p_brand"), F.col("p_size") % 5, F.col("p_type")
    titles = t.table("part").select(
        F.col("p_partkey").alias("id"),
        F.when(brand == "Brand#1", "50085104").when(brand == "Brand#2", None).otherwise(brand).alias("qan"),
        F.concat(
            "p_name",
            F.when(size == 0, " Information and Communication Technology (ICT)")
            .when(size == 1, " in Information Technology at Level 2")
            .when(size == 2, " Level 1/2 award")
            .when(size == 3, " Entry Level information and communication technology")
            .otherwise(" Level 1/Level 2"),
        ).alias("name"),
        F.when(kind == "PROMO", "Entry Level").otherwise("Level 2").alias("level"),
        F.when(kind == "PROMO", "GCSE (A* to G)").when(kind == "SMALL", "GCE A Level")
        .when(kind == "LARGE", "Functional Skills").otherwise(kind).alias("type"),
    )
    return clean.normalise_title(titles, "qan", "name", "level", "type")


@query("valid_providers", """SELECT count(DISTINCT CASE WHEN provider < 900 THEN provider END) AS valid_providers,
    count(DISTINCT CASE WHEN provider >= 900 THEN provider END) AS dropped_providers,
    count(CASE WHEN provider < 900 THEN 1 END) AS valid_entries, count(CASE WHEN provider >= 900 THEN 1 END) AS dropped_entries FROM entries""")
def _(t):
    sizes = t.facts.groupBy("provider").agg(F.countDistinct("pupil").alias("n"))
    valid = F.col("provider") < 900
    return sizes.agg(
        F.count(F.when(valid, 1)).alias("valid_providers"),
        F.count(F.when(~valid, 1)).alias("dropped_providers"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid_entries"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("dropped_entries"),
    )


@query("complete_cases", "SELECT pupil, gender, ethnicity, flag FROM pupils WHERE gender IS NOT NULL AND ethnicity IS NOT NULL AND flag IS NOT NULL")
def _(t):
    return t.pupils.select("pupil", "gender", "ethnicity", "flag").dropna(subset=["gender", "ethnicity", "flag"])


@query("clean_identifier", "SELECT c_custkey AS provider, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS name FROM customer")
def _(t):
    return t.table("customer").select(F.col("c_custkey").alias("provider"), text.alphanumeric(F.col("c_name")).alias("name"))


@query("optional_columns", "SELECT provider, sch_type, sch_gender, sch_urban FROM providers")
def _(t):
    return clean.optional_columns(t.providers, ["provider"], ["sch_", "KS2Mat"])


@query("drop_label_rows", "SELECT provider, sch_urban FROM providers WHERE sch_urban IS NOT NULL AND sch_urban NOT IN ('', 'Not applicable', 'Totals')")
def _(t):
    return clean.drop_label_rows(t.providers.select("provider", "sch_urban"), "sch_urban")


@query("presence_matrix", """grid AS (SELECT pupil, provider, s.subject FROM entries CROSS JOIN (SELECT DISTINCT subject FROM facts) s)
  SELECT g.pupil, g.provider, g.subject, CAST(f.points IS NOT NULL AS INTEGER) AS sits FROM grid g
  LEFT JOIN facts f ON g.pupil = f.pupil AND g.provider = f.provider AND g.subject = f.subject""")
def _(t):
    return clean.presence_matrix(t.cohort().select("pupil", "provider"), t.facts)


@query("presence_bits", """list AS (SELECT DISTINCT subject FROM facts)
  SELECT e.pupil, e.provider, string_agg(CASE WHEN f.points IS NULL THEN '0' ELSE '1' END, '' ORDER BY l.subject) AS bits FROM entries e CROSS JOIN list l
  LEFT JOIN facts f ON e.pupil = f.pupil AND e.provider = f.provider AND l.subject = f.subject GROUP BY e.pupil, e.provider""")
def _(t):
    return clean.presence_bits(t.cohort().select("pupil", "provider"), t.facts)
