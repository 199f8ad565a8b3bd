"""Queries: joins (J)."""

from pyspark.sql import functions as F

from ..operators import link, reshape, spatial
from .registry import query
from .testbed import FOCUS

SUBJECT_NAMES = "names AS (SELECT p_brand AS subject, min(p_name) AS subject_name FROM part GROUP BY p_brand)"


def subject_names(t):
    return t.table("part").groupBy(F.col("p_brand").alias("subject")).agg(F.min("p_name").alias("subject_name"))


@query("semi_filter", f"SELECT * FROM facts f WHERE EXISTS (SELECT 1 FROM facts g WHERE g.subject = '{FOCUS}' AND g.pupil = f.pupil)")
def _(t):
    return link.semi_filter(t.facts, t.facts.filter(F.col("subject") == FOCUS), "pupil")


@query("anti_filter", f"SELECT * FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.subject = '{FOCUS}' AND g.pupil = f.pupil)")
def _(t):
    return link.anti_filter(t.facts, t.facts.filter(F.col("subject") == FOCUS), "pupil")


@query("bind_results", SUBJECT_NAMES + """ SELECT p.pupil, p.gender, r.provider, r.subject, r.level, r.points, n.subject_name
  FROM pupils p JOIN results r ON p.pupil = r.pupil LEFT JOIN names n ON r.subject = n.subject""")
def _(t):
    bound = link.bind_results(t.pupils, t.results.drop("grade", "qualification"), subject_names(t))
    return bound.select("pupil", "gender", "provider", "subject", "level", "points", "subject_name")


SUBJECTS = [f"Brand#{i}" for i in range(1, 26)]
WIDE_SQL = ", ".join(f"max(CASE WHEN subject = '{s}' THEN points END) AS X{s[6:]}" for s in SUBJECTS)


@query("build_spread", f"""people AS (SELECT * REPLACE (CASE WHEN score > 20000 THEN pupil ELSE -pupil END AS pupil) FROM pupils),
  wide AS (SELECT pupil, provider, {WIDE_SQL} FROM facts WHERE pupil IN (SELECT pupil FROM people) GROUP BY pupil, provider)
  SELECT w.*, p.gender, p.ethnicity, v.sch_type, v.sch_gender, v.area AS postcode, v.authority, v.region
  FROM wide w LEFT JOIN people p ON w.pupil = p.pupil LEFT JOIN providers v ON w.provider = v.provider""")
def _(t):
    people = t.pupils.withColumn("pupil", F.when(F.col("score") > 20000, F.col("pupil")).otherwise(-F.col("pupil")))  # some unknown
    providers = t.providers.withColumnRenamed("area", "postcode")
    places = providers.select("postcode", "authority", "region").distinct()
    return reshape.build_spread(
        people, t.facts, providers, places, SUBJECTS, ["gender", "ethnicity"], ["sch_type", "sch_gender", "postcode"]
    )


# A person's yearly records: the orders of a customer, blank where the priority is not specified.
HISTORY_SQL = """history AS (SELECT o_custkey AS person, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' ' ELSE o_orderpriority END AS ethnicity,
    nullif(o_orderstatus, 'P') AS gender FROM orders),
  people AS (SELECT c_custkey AS person, CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END AS eth FROM customer)"""


def history(t):
    return t.table("orders").select(
        F.col("o_custkey").alias("person"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " ").otherwise(F.col("o_orderpriority")).alias("ethnicity"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("gender"),
    )


def people(t):
    segment = F.col("c_mktsegment")
    return t.table("customer").select(
        F.col("c_custkey").alias("person"),
        F.when(segment == "BUILDING", "").when(segment == "MACHINERY", None).otherwise(segment).alias("eth"),
    )


@query("backfill_column", HISTORY_SQL + """, src AS (SELECT person, max(nullif(trim(ethnicity), '')) AS v FROM history WHERE year = 1999 GROUP BY person)
  SELECT p.person, coalesce(nullif(trim(p.eth), ''), s.v) AS eth FROM people p LEFT JOIN src s ON p.person = s.person""")
def _(t):
    return link.backfill_column(people(t), history(t).filter("year = 1999"), "ethnicity", "eth", "person")


@query("backfill_report", HISTORY_SQL + """, src AS (SELECT person, max(nullif(trim(ethnicity), '')) AS v FROM history WHERE year = 1999 GROUP BY person)
  SELECT count(DISTINCT p.person) AS matched_keys,
    count(CASE WHEN nullif(trim(p.eth), '') IS NULL AND s.v IS NOT NULL THEN 1 END) AS replacements FROM people p JOIN src s ON p.person = s.person""")
def _(t):
    return link.backfill_report(people(t), history(t).filter("year = 1999"), "ethnicity", "eth", "person")


@query("backfill_across_years", HISTORY_SQL + """,
  eth AS (SELECT person, year, max(trim(ethnicity)) AS v FROM history WHERE nullif(trim(ethnicity), '') IS NOT NULL GROUP BY person, year),
  gen AS (SELECT person, year, max(gender) AS v FROM history WHERE gender IS NOT NULL GROUP BY person, year),
  eth1 AS (SELECT person, v FROM eth QUALIFY row_number() OVER (PARTITION BY person ORDER BY year DESC) = 1),
  gen1 AS (SELECT person, v FROM gen QUALIFY row_number() OVER (PARTITION BY person ORDER BY year DESC) = 1)
  SELECT p.person, coalesce(nullif(trim(p.eth), ''), e.v) AS eth, g.v AS gender
  FROM people p LEFT JOIN eth1 e ON p.person = e.person LEFT JOIN gen1 g ON p.person = g.person""")
def _(t):
    return link.backfill_across_years(people(t), history(t), {"ethnicity": "eth", "gender": "gender"}, "person")


@query("backfill_year_range", """h AS (SELECT o_custkey AS person, CAST(year(o_orderdate) AS INTEGER) AS year, nullif(o_orderstatus, 'P') AS gender, o_totalprice AS price FROM orders),
  d AS (SELECT o_orderkey AS pupil, o_custkey AS person, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 2 = 0 THEN nullif(o_orderstatus, 'P') END AS gender FROM orders),
  g AS (SELECT pupil, max({'year': h.year, 'v': h.gender}) AS r FROM d JOIN h ON h.person = d.person AND h.year BETWEEN d.year - 3 AND d.year - 1 WHERE h.gender IS NOT NULL AND h.year BETWEEN 1993 AND 1996 GROUP BY pupil),
  p AS (SELECT pupil, max({'year': h.year, 'v': h.price}) AS r FROM d JOIN h ON h.person = d.person AND h.year BETWEEN d.year - 3 AND d.year - 1 WHERE h.year BETWEEN 1993 AND 1996 GROUP BY pupil)
  SELECT d.pupil, d.person, d.year, coalesce(d.gender, g.r.v) AS gender, p.r.v AS prior_price FROM d LEFT JOIN g ON g.pupil = d.pupil LEFT JOIN p ON p.pupil = d.pupil""")
def _(t):
    """Records of one to three years before a row's own year, of 1993 to 1996 only."""
    orders = t.table("orders").select(
        F.col("o_orderkey").alias("pupil"), F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("year"),
        F.nullif("o_orderstatus", F.lit("P")).alias("gender"), F.col("o_totalprice").alias("price"))
    now = orders.drop("price").withColumn("gender", F.when(F.col("pupil") % 2 == 0, F.col("gender")))
    return link.backfill_across_years(now, orders.drop("pupil"), {"gender": "gender", "price": "prior_price"}, "person", years=(1993, 1996), before=(1, 3))


@query("backfill_results", f"""best AS (SELECT provider, year, max(points) AS v FROM results WHERE level = 'A' AND subject = '{FOCUS}' GROUP BY provider, year),
  newest AS (SELECT provider, v FROM best QUALIFY row_number() OVER (PARTITION BY provider ORDER BY year DESC) = 1)
  SELECT c_custkey AS provider, v AS prior_points FROM customer LEFT JOIN newest ON c_custkey = provider""")
def _(t):
    history_ = link.results_history(t.results, {FOCUS: "focus"}, "A", key="provider")
    ids = t.table("customer").select(F.col("c_custkey").alias("provider"))
    return link.backfill_across_years(ids, history_, {"focus": "prior_points"}, "provider")


@query("best_over_years", f"""SELECT provider, max(CASE WHEN points % 10 <= 8 THEN points % 10 END) AS best FROM facts
  WHERE subject = '{FOCUS}' AND provider IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY provider""")
def _(t):
    ids = t.table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("provider"))
    history_ = t.facts.filter(F.col("subject") == FOCUS)
    return link.best_over_years(ids, history_, F.col("points") % 10, "best", "provider")


@query("area_mapping_conflicts", """cells AS (SELECT provider, floor(easting / 1000) AS cell, authority FROM providers),
  bad AS (SELECT cell, count(DISTINCT authority) AS n_areas FROM cells GROUP BY cell HAVING count(DISTINCT authority) > 1)
  SELECT c.*, b.n_areas FROM cells c JOIN bad b ON c.cell = b.cell""")
def _(t):
    cells = t.providers.select("provider", F.floor(F.col("easting") / 1000).alias("cell"), "authority")
    return link.area_mapping_conflicts(cells, "provider", "cell", "authority")


PLANE_SQL = "plane AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


@query("nearest_distance", PLANE_SQL + """ SELECT p.id, round(min(sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y))), 9) AS distance,
    min(sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y))) <= 0.02 AS near
  FROM plane p, plane r WHERE p.label <> 3 AND r.label = 3 GROUP BY p.id""")
def _(t):
    found = spatial.nearest_distance(t.plane.filter("label <> 3"), t.plane.filter("label = 3"), cutoff=0.02)
    return found.select("id", F.round("distance", 9).alias("distance"), "near")


@query("bbox_filter", PLANE_SQL + """ SELECT * FROM plane WHERE label <> 6 AND x > (SELECT min(x) FROM plane WHERE label = 6) AND x < (SELECT max(x) FROM plane WHERE label = 6)
    AND y > (SELECT min(y) FROM plane WHERE label = 6) AND y < (SELECT max(y) FROM plane WHERE label = 6)""")
def _(t):
    return link.inside_box(t.plane.filter("label <> 6"), t.plane.filter("label = 6"))


@query("attach_region", """SELECT s_suppkey AS provider, CAST(s_nationkey AS VARCHAR) AS postcode, n_name AS authority,
    CASE r_name WHEN 'ASIA' THEN 'London' WHEN 'EUROPE' THEN 'South East' ELSE r_name END AS region,
    CASE r_name WHEN 'ASIA' THEN '117537' WHEN 'EUROPE' THEN '51776' END AS region_code
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    name = F.col("r_name")
    places = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("postcode"),
        F.col("n_name").alias("authority"),
        F.when(name == "ASIA", "London").when(name == "EUROPE", "South East").otherwise(name).alias("region"),
    )
    suppliers = t.table("supplier").select(F.col("s_suppkey").alias("provider"), F.col("s_nationkey").cast("string").alias("postcode"))
    return link.attach_region(suppliers, places)


@query("filter_mappings", SUBJECT_NAMES + """, levels AS (SELECT DISTINCT l_returnflag AS level, 'level ' || l_returnflag AS level_name FROM lineitem)
  SELECT DISTINCT r.level, r.subject, l.level_name, n.subject_name FROM results r LEFT JOIN levels l ON r.level = l.level
  LEFT JOIN names n ON r.subject = n.subject WHERE n.subject_name IN ('blue bolt', 'blue gear', 'blue ring', 'cold bolt', 'blue gizmo')""")
def _(t):
    level = F.col("l_returnflag").alias("level")
    levels = t.table("lineitem").select(level).distinct().withColumn("level_name", F.concat(F.lit("level "), "level"))
    wanted = ["blue bolt", "blue gear", "blue ring", "cold bolt", "blue gizmo"]
    return link.filter_mappings(t.results, levels, subject_names(t), wanted)


@query("coalesce_coordinates", """pairs AS (SELECT provider, CASE WHEN easting > 0 THEN easting END AS e1, CASE WHEN easting < 500000 THEN easting END AS e2 FROM providers)
  SELECT provider, coalesce(e1, e2) AS e1, coalesce(e2, e1) AS e2 FROM pairs""")
def _(t):
    e = F.col("easting")
    pairs = t.providers.select("provider", F.when(e > 0, e).alias("e1"), F.when(e < 500000, e).alias("e2"))
    return link.coalesce_coordinates(pairs, [("e1", "e2")])


@query("coverage_check", f"""a AS (SELECT DISTINCT provider FROM facts WHERE subject = '{FOCUS}'), b AS (SELECT provider FROM providers WHERE sch_gender = 'Mixed')
  SELECT provider, 'left' AS present_in FROM a WHERE provider NOT IN (SELECT provider FROM b)
  UNION ALL SELECT provider, 'right' FROM b WHERE provider NOT IN (SELECT provider FROM a)""")
def _(t):
    return link.coverage_check(t.facts.filter(F.col("subject") == FOCUS), t.providers.filter("sch_gender = 'Mixed'"), "provider")


@query("paste_tables", """a AS (SELECT ethnicity, count(*) AS n_f FROM pupils WHERE gender = 'F' GROUP BY ethnicity),
  b AS (SELECT ethnicity, count(*) AS n_o FROM pupils WHERE gender = 'O' GROUP BY ethnicity)
  SELECT a.ethnicity, n_f, n_o FROM a LEFT JOIN b ON a.ethnicity IS NOT DISTINCT FROM b.ethnicity""")
def _(t):
    def table(gender, name):
        return t.pupils.filter(F.col("gender") == gender).groupBy("ethnicity").agg(F.count("*").alias(name))

    return link.paste_tables(table("F", "n_f"), table("O", "n_o"), "ethnicity")
