"""Queries: scans and sinks (S). The raw extracts are written from the tables at hand, then read back."""

import json

from pyspark.sql import functions as F

from ..operators import link, uptake
from ..session import scratch_folder
from ..sources import fields, pipeline, scan, sink
from .q_uptake import PROFILE_SQL, criteria_sql, profiles
from .registry import query
from .testbed import FOCUS, SECOND

RESULT_FIELDS = [
    ("PupilMatchingRefAnonymous", "PupilMatchingRefAnonymous"), ("_URN$", "URN"), ("_EXAMYEAR", "EXAMYEAR"), ("_SUBLEVNO", "SUBLEVNO"),
    (" _QAN", " QAN"), ("MAPPING", "MAPPING"), ("GRADE", "GRADE"), ("POINTS", "POINTS"), ("NOT_THERE", "EXTRA"),
]
TRIMMED = [(p.strip(), n.strip()) for p, n in RESULT_FIELDS]


def raw_results(t):
    r = t.results
    return r.select(
        F.lit("x").alias("KS4_UNUSED"), F.col("pupil").alias("KS4_PupilMatchingRefAnonymous"), F.col("provider").alias("KS4_URN"),
        F.col("year").alias("KS4_EXAMYEAR"), F.when(F.col("level") == "A", 310).otherwise(391).alias("KS4_SUBLEVNO"),
        F.col("qualification").alias("KS4_QAN"), F.col("subject").alias("KS4_MAPPING"),
        F.when(F.col("grade") == "F", " ").otherwise(F.col("grade")).alias("KS4_GRADE"), F.col("points").alias("KS4_POINTS"),
    )


def written(t, df, sep="\t", encoding="UTF-8"):
    path = f"{scratch_folder(t.spark)}/extract"
    df.write.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


RAW_SQL = """raw AS (SELECT CAST(pupil AS VARCHAR) AS PupilMatchingRefAnonymous, provider AS URN, CAST(year AS VARCHAR) AS EXAMYEAR, CASE level WHEN 'A' THEN 310 ELSE 391 END AS SUBLEVNO,
  CAST(qualification AS VARCHAR) AS QAN, subject AS MAPPING, CASE grade WHEN 'F' THEN NULL ELSE grade END AS GRADE, points AS POINTS, NULL AS EXTRA FROM results)"""


@query("scan_results", RAW_SQL + " SELECT * FROM raw")
def _(t):
    return scan.scan_results(t.spark, written(t, raw_results(t)), TRIMMED)


@query("select_by_pattern", RAW_SQL + " SELECT * FROM raw")
def _(t):
    return fields.select_by_pattern(raw_results(t), TRIMMED, scan.RESULT_TYPES)


PUPIL_FIELDS = [
    ("PupilMatchingRefAnonymous", "PupilMatchingRefAnonymous"), ("_RECTYPE", "RECTYPE"), ("_GENDER", "GENDER"), ("KS5_URN$", "URN"), ("KS4_FSM", "KS4_FSM"),
    ("EVERFSM_6_", "EVERFSM_6"), ("EVERFSM_3_", "EVERFSM_3"), ("FSMeligible_", "FSMeligible"), ("IDACIScore", "IDACIScore"),
]


@query("scan_pupils", """raw AS (SELECT DISTINCT l_orderkey AS pupil, l_returnflag, l_linenumber, CASE WHEN o_totalprice < 100000 THEN NULL WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS fsm6,
    CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 1 ELSE 0 END AS fsm3, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  one AS (SELECT * FROM raw WHERE l_linenumber = 1 QUALIFY count(*) OVER (PARTITION BY pupil) = 1)
  SELECT CAST(pupil AS VARCHAR) AS PupilMatchingRefAnonymous, 1 AS RECTYPE, l_returnflag AS GENDER, NULL AS KS4_FSM, coalesce(fsm6, fsm3, 1) AS EVERFSM_6, fsm3 AS EVERFSM_3, 1 AS FSMeligible, o_totalprice AS IDACIScore FROM one""")
def _(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    raw = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("KS5_PupilMatchingRefAnonymous"), F.col("l_linenumber").alias("KS5_RECTYPE"), F.lower("l_returnflag").alias("KS5_GENDER"),
        F.col("l_suppkey").alias("KS5_URN"), F.when(price < 100000, None).when(price > 300000, 1).otherwise(0).alias("EVERFSM_6_SPR14"),
        F.when(status == "P", None).when(status == "F", 1).otherwise(0).alias("EVERFSM_3_SPR14"), F.lit(1).alias("FSMeligible_SPR14"),
        price.alias("KS4_IDACIScore"),
    )
    return scan.scan_pupils(t.spark, written(t, raw), PUPIL_FIELDS, "KS5")


@query("scan_providers", """SELECT c_custkey AS URN, c_name || ' École' AS "Name", NULL AS trust, 'E' || c_nationkey AS "LA..code.",
    CASE r_name WHEN 'ASIA' THEN 'Yorkshire and The Humber' ELSE r_name END AS "Region", c_mktsegment AS "schType", NULL AS "schPhase", 'Mixed' AS "schGender", NULL AS "ReligiousCharacter..name.",
    CASE WHEN c_acctbal > 8000 THEN 'Selective' END AS selective, c_nationkey * 10 AS "NumberOfPupils", NULL AS "NumberOfBoys", NULL AS "NumberOfGirls", c_acctbal AS "PercentageFSM",
    'AB' || c_nationkey || 'CD' AS "Postcode", NULL AS "schUrban", NULL AS "Easting", NULL AS "Northing"
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    places = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.col("r_name")
    register = t.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("URN"), F.concat("c_name", F.lit(" École")).alias("EstablishmentName"),
        F.concat(F.lit("E"), F.col("c_nationkey").cast("string")).alias("GSSLACode (name)"),
        F.when(name == "ASIA", "Yorkshire and the Humber").otherwise(name).alias("GOR (name)"),
        F.col("c_mktsegment").alias("TypeOfEstablishment (name)"), F.lit("Mixed").alias("Gender (name)"),
        F.when(F.col("c_acctbal") > 8000, "Selective").alias("AdmissionsPolicy (name)"), (F.col("c_nationkey") * 10).alias("NumberOfPupils"),
        F.col("c_acctbal").alias("PercentageFSM"), F.concat(F.lit("AB"), F.col("c_nationkey").cast("string"), F.lit(" CD")).alias("Postcode"),
    )
    return scan.scan_providers(t.spark, written(t, register, ",", "ISO-8859-1"))


@query("scan_lookup", "SELECT DISTINCT p_brand AS \"MAPPING\", 'Subject ' || p_brand AS \"MAPPING_DESCRIPTION\" FROM part")
def _(t):
    codes = t.table("part").select(F.col("p_brand").alias("MAPPING"), F.concat(F.lit("Subject "), "p_brand").alias("MAPPING_DESCRIPTION")).distinct()
    return scan.scan_lookup(t.spark, written(t, codes))


POSTCODE_SQL = """places AS (SELECT 'AB' || s_suppkey || 'CD' AS "Postcode", 'R' || s_nationkey AS "Region", s_acctbal AS easting, s_suppkey * 1.5::DOUBLE AS northing FROM supplier)"""


def postcodes(t):
    return t.table("supplier").select(
        F.concat(F.lit("AB"), F.col("s_suppkey").cast("string"), F.lit(" CD")).alias("Postcode"),
        F.concat(F.lit("R"), F.col("s_nationkey").cast("string")).alias("Region"), F.col("s_acctbal").alias("easting"), (F.col("s_suppkey") * 1.5).alias("northing"),
    )


@query("scan_postcodes", POSTCODE_SQL + " SELECT * FROM places")
def _(t):
    return scan.scan_postcodes(t.spark, written(t, postcodes(t), ","))


@query("scan_authorities", """a AS (SELECT s_suppkey AS "URN", CAST(s_suppkey AS VARCHAR) AS "EstablishmentNumber", CASE s_nationkey WHEN 1 THEN 'Northumberland' WHEN 2 THEN 'Gateshead' ELSE 'N' || s_nationkey END AS authority,
    CASE WHEN s_nationkey < 12 THEN 'E' ELSE 'W' END || s_nationkey AS code FROM supplier)
  SELECT "URN", "EstablishmentNumber", authority, CASE authority WHEN 'Northumberland' THEN 'E06000057' WHEN 'Gateshead' THEN 'E08000037' ELSE code END AS authority_code FROM a WHERE contains(code, 'E')""")
def _(t):
    nation = F.col("s_nationkey")
    register = t.table("supplier").select(
        F.col("s_suppkey").alias("URN"), F.col("s_suppkey").alias("EstablishmentNumber"),
        F.when(nation == 1, "Northumberland").when(nation == 2, "Gateshead").otherwise(F.concat(F.lit("N"), nation.cast("string"))).alias("LA (name)"),
        F.concat(F.when(nation < 12, "E").otherwise("W"), nation.cast("string")).alias("GSSLACode (name)"),
    )
    return scan.scan_authorities(t.spark, written(t, register, ","))


SPEC_SQL = """f AS (SELECT DISTINCT o_orderpriority AS stage, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS p FROM orders)
  SELECT stage, year, '_' || p || '$' AS pattern, 'name ' || p AS name FROM f"""


@query("field_filter_spec", SPEC_SQL)
def _(t):
    status = F.col("o_orderstatus")
    rows = t.table("orders").select(F.col("o_orderpriority").alias("stage"), F.year("o_orderdate").cast("string").alias("year"), status).distinct()
    entry = F.struct(F.concat(F.lit(" _"), status, F.lit("$")).alias("k"), F.concat(F.lit("name "), status, F.lit(" ")).alias("v"))
    years = rows.groupBy("stage", "year").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))
    stages = years.groupBy("stage").agg(F.map_from_entries(F.collect_list(F.struct("year", "fields"))).alias("years"))
    document = stages.select(F.to_json(F.map_from_entries(F.array(F.struct("stage", "years")))).alias("value"))
    return fields.field_filter_spec(document)


def cleaned(t):
    """Pupils, results and spread of two stages and all years, written by the cleaning run.

    Lines N belong to the later stage. Level A counts as the old level before 1996 and as the new one from then on, so
    subjects change level in some years only; points are rescaled from 1996, halved to fall on the scale. Pupils without
    a prior score take their best points in a subject; some are unknown.
    """
    folder = f"{scratch_folder(t.spark)}/cleaned"
    late = F.col("level") == "N"
    results = t.results.withColumns({
        "stage": F.when(late, "KS5").otherwise("KS4"), "exam_year": F.when(F.col("grade") == "O", F.col("year")).otherwise(F.col("year") - 1),
        "level": F.when((F.col("level") == "A") & (F.col("year") < 1996), "R").otherwise(F.col("level")), "points": F.col("points") % 18 / 2,
    })
    results = pipeline.clean_results(results, ["A", "R", "N"], rescale_from=1996, reformed=["Brand#5"])
    person = F.when(F.col("score") > 20000, F.col("pupil")).otherwise(-F.col("pupil"))
    stages = F.explode(F.array(F.lit("KS4"), F.lit("KS5")))
    pupils = t.pupils.withColumns({"pupil": person, "prior": F.when(F.col("score") > 100000, F.col("prior"))}).withColumn("stage", stages)
    history = link.results_history(t.results, {SECOND: "best"}, "A")
    pupils = pipeline.clean_pupils(pupils, history, {"best": "prior"})
    pipeline.run(pupils, results, folder, supersede=("A", "R"))
    return folder


CLEAN_SQL = f"""raw AS (SELECT * REPLACE (CASE WHEN level = 'A' AND year < 1996 THEN 'R' ELSE level END AS level, points % 18 / 2 AS points), CASE level WHEN 'N' THEN 'KS5' ELSE 'KS4' END AS stage
    FROM results WHERE grade = 'O'),
  own AS (SELECT *, rank() OVER (PARTITION BY stage, year, pupil, subject, qualification ORDER BY points DESC) AS r FROM raw),
  best0 AS (SELECT stage, year, pupil, provider, level, subject, max(points) AS points FROM own WHERE r = 1 GROUP BY ALL),
  best AS (SELECT * REPLACE (CASE WHEN year < 1996 OR subject = 'Brand#5' THEN points WHEN points = 8.5 THEN 8 WHEN points = 7 THEN 7 WHEN points = 5.5 THEN 6 WHEN points = 4 THEN 5
    WHEN points = 3 THEN 4 WHEN points = 2 THEN 3 WHEN points = 1.5 THEN 2 WHEN points = 1 THEN 1 ELSE points END AS points) FROM best0),
  known AS (SELECT stage, year, CASE WHEN score > 20000 THEN pupil ELSE -pupil END AS pupil FROM pupils, (VALUES ('KS4'), ('KS5')) s(stage)),
  newest AS (SELECT pupil, arg_max(v, year) AS v FROM (SELECT pupil, year, max(points) AS v FROM results WHERE level = 'A' AND subject = '{SECOND}' GROUP BY pupil, year) GROUP BY pupil),
  changed AS (SELECT DISTINCT stage, year, subject FROM best WHERE level = 'A'),
  spread AS (SELECT b.stage, b.year, b.pupil, provider, b.subject, max(points) AS points FROM best b JOIN known k ON b.stage = k.stage AND b.year = k.year AND b.pupil = k.pupil
    LEFT JOIN changed c ON b.stage = c.stage AND b.year = c.year AND b.subject = c.subject WHERE NOT (b.level = 'R' AND c.subject IS NOT NULL) GROUP BY ALL)"""


@query("scan_clean", CLEAN_SQL + " SELECT * FROM best")
def _(t):
    return scan.scan_clean(t.spark, cleaned(t), "results")


@query("register_cohorts", CLEAN_SQL + """ SELECT 'pupils' AS "table", count(*) AS n FROM known WHERE stage = 'KS4' AND year = 1998 UNION ALL SELECT 'results', count(*) FROM best WHERE stage = 'KS4' AND year = 1998
  UNION ALL SELECT 'spread', count(*) FROM spread WHERE stage = 'KS4' AND year = 1998""")
def _(t):
    views = scan.register_cohorts(t.spark, cleaned(t), "KS4", 1998)
    out = None
    for name in views:
        n = t.spark.table(f"{name}_KS4_1998").agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("write_clean", CLEAN_SQL + """ SELECT stage, year, count(*) AS n, sum(points) AS points FROM spread GROUP BY stage, year""")
def _(t):
    return scan.scan_clean(t.spark, cleaned(t), "spread").groupBy("stage", "year").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


RUN_PEOPLE = {"_PupilMatchingRefAnonymous": "PupilMatchingRefAnonymous", "_URN": "URN", "_GENDER": "GENDER", "KS2MAT": "KS2Mat"}
RUN_RESULTS = {"_EXAMYEAR": "EXAMYEAR", "SUBLEVNO": "SUBLEVNO", "QAN": "QAN", "MAPPING": "MAPPING", "GRADE": "GRADE", "POINTS": "POINTS"}
RUN_LATE = {"KS4_FSM": "KS4_FSM", "EVERFSM_6": "EVERFSM_6", "EVERFSM_3": "EVERFSM_3", "FSMeligible": "FSMeligible"}
AGAIN = ("KS5", 1996)


def extracts(t, results, pupils):
    """Raw files of every stage and year, headers differing between the stages: path by (stage, year) and kind."""
    folder = f"{scratch_folder(t.spark)}/raw"
    stages = {"KS4": "A_", "KS5": "B_"}
    for stage, mark in stages.items():
        r = results.filter(F.col("stage") == stage).select(
            F.col("pupil").alias(f"{mark}PupilMatchingRefAnonymous"), F.col("provider").alias(f"{mark}URN"), F.col("exam_year").alias(f"{mark}EXAMYEAR"),
            F.col("level").alias("SUBLEVNO"), F.col("qualification").alias(f"{mark}QAN"), F.col("subject").alias("MAPPING"), F.col("grade").alias("GRADE"), F.col("points").alias("POINTS"), "year")
        p = pupils.filter(F.col("stage") == stage).select(
            F.col("gender").alias(f"{mark}GENDER"), F.col("pupil").alias(f"{mark}PupilMatchingRefAnonymous"), F.lit(1).alias(f"{mark}URN"), F.col("prior").alias(f"{mark}KS2MAT"), "year")
        for name, df in (("results", r), ("pupils", p)):
            df.repartition("year").write.partitionBy("year").option("header", True).option("sep", "\t").csv(f"{folder}/{stage}/{name}")
    return folder


@query("run_from_files", f"""raw AS (SELECT *, CASE level WHEN 'N' THEN 'KS5' ELSE 'KS4' END AS stage FROM results WHERE grade = 'O'),
  again AS (SELECT * FROM raw WHERE NOT (stage = '{AGAIN[0]}' AND year = {AGAIN[1]} AND pupil % 2 = 1)),
  own AS (SELECT *, rank() OVER (PARTITION BY stage, year, pupil, subject, qualification ORDER BY points DESC) AS r FROM again),
  best AS (SELECT stage, year, pupil, level, provider, subject, max(points) AS points FROM own WHERE r = 1 GROUP BY ALL),
  newer AS (SELECT DISTINCT stage, year, subject FROM best WHERE level = 'R'),
  spread AS (SELECT b.stage, b.year, pupil, provider, b.subject, max(points) AS points FROM best b LEFT JOIN newer n ON b.stage = n.stage AND b.year = n.year AND b.subject = n.subject
    WHERE NOT (level = 'A' AND n.subject IS NOT NULL) GROUP BY ALL)
  SELECT stage, year, count(*) AS n, sum(points) AS points, any_value(k.n_pupils) AS n_pupils, any_value(k.prior) AS prior FROM spread
    JOIN (SELECT year, count(*) AS n_pupils, round(sum(prior), 2) AS prior FROM pupils GROUP BY year) k USING (year) GROUP BY stage, year""")
def _(t):
    """From raw files of two stages and all years to the written spread; then one year of one stage again, with half its results."""
    results = t.results.withColumns({
        "stage": F.when(F.col("level") == "N", "KS5").otherwise("KS4"), "exam_year": F.when(F.col("grade") == "O", F.col("year")).otherwise(F.col("year") - 1),
        "level": F.when(F.col("level") == "A", 310).when(F.col("level") == "R", 391).otherwise(111)})
    early = t.pupils.withColumn("stage", F.lit("KS4"))
    late = t.pupils.withColumns({"stage": F.lit("KS5"), "prior": F.when(F.col("pupil") % 3 == 0, F.col("prior"))})  # blanks come from the earlier stage
    raw, folder = extracts(t, results, early.unionByName(late)), f"{scratch_folder(t.spark)}/out"
    second = extracts(t, results.filter((F.col("stage") == AGAIN[0]) & (F.col("year") == AGAIN[1]) & (F.col("pupil") % 2 == 0)), late.filter(F.col("year") == AGAIN[1]))
    years = [r.year for r in t.pupils.select("year").distinct().orderBy("year").collect()]
    spec = {s: {str(y): RUN_PEOPLE | RUN_RESULTS | (RUN_LATE if s == "KS5" else {}) for y in years} for s in ("KS4", "KS5")}
    specs = fields.field_filter_spec(t.spark.createDataFrame([(json.dumps(spec),)], "value string"))

    def source(base, stage, year):
        return {"stage": stage, "year": year, **{name: f"{base}/{stage}/{name}/year={year}" for name in ("pupils", "results")}}

    levels, rules = {"KS4": [310, 391], "KS5": [111]}, {"supersede": {"KS4": (391, 310)}, "backfill": {"KS2Mat": "KS2Mat"}}
    pipeline.run_from_files(t.spark, [source(raw, s, y) for s in ("KS4", "KS5") for y in years], specs, folder, levels, **rules)
    pipeline.run_from_files(t.spark, [source(second, *AGAIN)], specs, folder, levels, **rules)
    out = None
    for stage in ("KS4", "KS5"):
        spread = t.spark.read.parquet(f"{folder}/{stage}/spread").groupBy("stage", "year").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
        people = t.spark.read.parquet(f"{folder}/{stage}/pupils").groupBy("stage", "year").agg(F.count("*").alias("n_pupils"), F.round(F.sum("KS2Mat"), 2).alias("prior"))
        both = spread.join(people, ["stage", "year"])
        out = both if out is None else out.unionByName(both)
    return out


@query("clean_pupils", CLEAN_SQL + """ SELECT s.stage, p.year, CASE WHEN p.score > 20000 THEN p.pupil ELSE -p.pupil END AS pupil, p.gender,
    coalesce(CASE WHEN p.score > 100000 THEN p.prior END, n.v) AS prior
  FROM pupils p CROSS JOIN (VALUES ('KS4'), ('KS5')) s(stage) LEFT JOIN newest n ON n.pupil = CASE WHEN p.score > 20000 THEN p.pupil ELSE -p.pupil END""")
def _(t):
    return scan.scan_clean(t.spark, cleaned(t), "pupils").select("stage", "year", "pupil", "gender", "prior")


@query("write_report", PROFILE_SQL + ", " + criteria_sql({"sch_type": "sch_type"}).replace("CAST(schools AS BIGINT) AS schools", "CAST(CAST(schools AS BIGINT) AS VARCHAR) AS schools")
       .replace("CAST(sub_schools AS BIGINT) AS sub_schools", "CAST(CAST(sub_schools AS BIGINT) AS VARCHAR) AS sub_schools").replace("round(100.0 * sub_schools / schools, 1) AS pc_schools", "CAST(round(100.0 * sub_schools / schools, 1)::DOUBLE AS VARCHAR) AS pc_schools"))
def _(t):


    labelled, labels = uptake.criterion_labels(profiles(t), "type")
    path = sink.write_report(uptake.provision_by_criteria(labelled, labels), f"{scratch_folder(t.spark)}/report")
    return scan.read_delimited(t.spark, path, ",")


@query("scan_subset", f"""p AS (SELECT CAST(provider AS VARCHAR) AS provider, count(*) AS n FROM facts GROUP BY provider UNION ALL SELECT 'TOTAL', count(*) FROM facts)
  SELECT * FROM p WHERE provider = 'TOTAL' OR provider IN (SELECT CAST(provider AS VARCHAR) FROM facts WHERE subject = '{FOCUS}')""")
def _(t):
    counts = t.facts.groupBy(F.col("provider").cast("string").alias("provider")).agg(F.count("*").alias("n"))
    total = t.facts.agg(F.lit("TOTAL").alias("provider"), F.count("*").alias("n"))
    return scan.scan_subset(counts.unionByName(total), t.facts.filter(F.col("subject") == FOCUS), "provider")


@query("union_drifted_sources", """s AS (SELECT authority, region, sch_gender, sch_type, subject, level, count(*) AS n FROM results JOIN providers USING (provider) GROUP BY ALL)
  SELECT authority AS "LA", region AS "Region", sch_gender AS "Gender", sch_type AS "Provider Type", subject AS "Subject", level AS "Qualification", n::DOUBLE AS "Entries" FROM s""")
def _(t):
    # Sheets of category counts; each is one file, as a workbook export is, and bounded by its categories.
    counts = t.results.join(t.providers, "provider").groupBy("authority", "region", "sch_gender", "sch_type", "subject", "level").agg(F.count("*").alias("n"))
    folder, paths = scratch_folder(t.spark), []
    titles = ["Published entries"], ["Published entries", "Vocational, by award"], []
    headers = [
        "LA,Region,Gender,Type of provider,Subject,Qualification,Entries",
        "LA,Region,Gender,Provider Type,Subject,Qualification,Award,Number of entries",
        "LA,Region,Gender,Provider Type,Subject,Qualification,Number of entries",
    ]
    for i, level in enumerate("ANR"):
        line = F.concat_ws(",", "authority", "region", "sch_gender", "sch_type", "subject", "level", *([F.lit("all")] if i == 1 else []), F.col("n").cast("string"))
        body = counts.filter(F.col("level") == level).select(F.lit(9).alias("k"), line.alias("value"))
        top = t.spark.createDataFrame([(k, v) for k, v in enumerate([*titles[i], headers[i]])], "k int, value string")
        path = f"{folder}/sheet{i}"
        top.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
        paths.append(path)
    return scan.union_drifted_sources(t.spark, paths)


@query("scan_training_providers", POSTCODE_SQL + """ SELECT CAST(s_suppkey AS VARCHAR) AS "UKPRN", s_name AS "Provider_name", "Region", 'S' || s_nationkey AS "Subject6", s_acctbal AS "Postgrads", easting, northing
  FROM supplier LEFT JOIN places ON "Postcode" = 'AB' || s_suppkey || 'CD' WHERE s_nationkey <> 3""")
def _(t):
    supplier = t.table("supplier")
    nation = F.col("s_nationkey")
    training = supplier.select(
        F.col("s_suppkey").cast("string").alias("UKPRN"), F.col("s_name").alias("Provider_name"),
        F.when(nation == 3, "Primary").otherwise(F.concat(F.lit("S"), nation.cast("string"))).alias("Subject6"), F.col("s_acctbal").cast("string").alias("Postgrads"),
    )
    total = supplier.agg(F.lit("Total").alias("UKPRN"), F.lit("All").alias("Provider_name"), F.lit("S").alias("Subject6"), F.sum("s_acctbal").cast("string").alias("Postgrads"))
    located = supplier.select(F.col("s_suppkey").alias("UKPRN"), F.concat(F.lit("AB"), F.col("s_suppkey").cast("string"), F.lit("CD ")).alias("Postcode"))
    paths = [written(t, df, ",") for df in (training.unionByName(total), located, postcodes(t))]
    return scan.read_training_providers(t.spark, *paths)


@query("literal_table", """g(letter, points) AS (VALUES ('U', 0), ('G', 1), ('F', 2), ('E', 3), ('D', 4), ('C', 5), ('B', 6), ('A', 7), ('*', 8))
  SELECT letter, g.points::DOUBLE AS points, count(f.pupil) AS n FROM g LEFT JOIN facts f ON f.points = g.points GROUP BY ALL""")
def _(t):
    counts = t.facts.groupBy("points").agg(F.count("*").alias("n"))
    return scan.grade_table(t.spark).join(counts, "points", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("area_sets", "SELECT provider, area FROM providers WHERE area BETWEEN 'E09000001' AND 'E09000033'")
def _(t):
    return scan.in_area_set(t.providers.select("provider", "area"), "area", "London")
