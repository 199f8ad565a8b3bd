"""The star schema at hand read as cohort data.

An order is a pupil, its customer the provider, a part's brand the subject, a line the exam result.
Attributes that the tables lack are derived from columns by rule, identically here and in PRELUDE.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean, profile
from ..operators.common import dealt, looked_up, tasks_for

FOCUS = "Brand#1"
SECOND = "Brand#2"
THIRD = "Brand#3"


class Testbed:
    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> int:
        """Tasks for work on the results, by their number (read from the file's footers)."""
        return tasks_for(self.spark, self.table("lineitem").count())

    @cached_property
    def results(self) -> DataFrame:
        """Raw results: one row per attempt, dealt by pupil over a number of tasks that follows the number of results.

        Joins and groups by pupil, and by pupil and more, so hold a bounded number of rows a task at any size.
        """
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("pupil"),
            F.col("l_partkey").alias("qualification"),
            F.col("l_returnflag").alias("level"),
            F.col("l_quantity").alias("points"),
            F.col("l_linestatus").alias("grade"),
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("pupil"),
            F.col("o_custkey").alias("provider"),
            F.year("o_orderdate").alias("year"),
        )
        parts = self.table("part").select(F.col("p_partkey").alias("qualification"), F.col("p_brand").alias("subject"))
        known = lines.join(looked_up(parts, self.table("part").count()), "qualification")
        return dealt(known, self.tasks, "pupil").join(dealt(orders, self.tasks, "pupil"), "pupil").select(
            "year", "pupil", "provider", "level", "subject", "qualification", "grade", "points"
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Long fact: one row per (pupil, provider, subject)."""
        return clean.single_result(self.results)

    @cached_property
    def pupils(self) -> DataFrame:
        price, quarter = F.col("o_totalprice"), F.quarter("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("pupil"),
            F.year("o_orderdate").alias("year"),
            F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("gender"),
            F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("ethnicity"),
            F.concat(F.col("o_orderpriority"), F.lit("/"), quarter.cast("string")).alias("eth_minor"),
            F.when(price < 20000, None).when(price > 300000, 1).otherwise(0).alias("flag"),
            price.alias("score"),
            F.when(price < 20000, None).otherwise(F.round(price / 10000, 2)).alias("prior"),
            F.element_at(F.array(*[F.lit(c) for c in "NAPK"]), quarter).alias("sen"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(1).alias("eal"),
        )

    @cached_property
    def providers(self) -> DataFrame:
        balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("provider"),
                F.col("c_name").alias("provider_name"),
                F.when(segment == "MACHINERY", "Other independent school")
                .when(segment == "BUILDING", "Community special school")
                .when(segment == "AUTOMOBILE", "Academy converter")
                .when(segment == "FURNITURE", "Community school")
                .otherwise("Voluntary aided school")
                .alias("sch_type"),
                F.when(balance < 1000, "Boys").when(balance < 2500, "Girls").otherwise("Mixed").alias("sch_gender"),
                F.when(balance < 0, None).when(balance > 8000, "Selective").otherwise("Non-selective").alias("selective"),
                F.when(balance < 0, None)
                .when(balance < 3000, "Rural town and fringe")
                .when(balance < 6000, "Rural village")
                .otherwise("Urban major conurbation")
                .alias("sch_urban"),
                F.when(segment != "MACHINERY", F.concat(F.lit("Trust "), F.col("n_name"))).alias("trust"),
                F.col("n_name").alias("authority"),
                F.concat(F.lit("E090000"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("area"),
                F.col("r_name").alias("region"),
                (balance * 100).alias("easting"),
                (F.col("c_custkey") * 10.0).alias("northing"),
            )
        )

    def cohort(self, focus: str = FOCUS) -> DataFrame:
        providers = looked_up(self.providers, self.table("customer").count())
        return profile.cohort(self.facts, self.pupils, providers, focus)

    @cached_property
    def plane(self) -> DataFrame:
        """Points in a plane with a label."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col("label"),
            F.col("embedding")[0].cast("double").alias("x"),
            F.col("embedding")[1].cast("double").alias("y"),
        )


PRELUDE = f"""WITH results AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS pupil, o_custkey AS provider,
         l_returnflag AS level, p_brand AS subject, l_partkey AS qualification, l_linestatus AS grade,
         l_quantity AS points
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
facts AS (
  SELECT year, pupil, provider, subject, max(points) AS points FROM results GROUP BY year, pupil, provider, subject),
pupils AS (
  SELECT o_orderkey AS pupil, CAST(year(o_orderdate) AS INTEGER) AS year, nullif(o_orderstatus, 'P') AS gender,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS ethnicity,
         o_orderpriority || '/' || CAST(quarter(o_orderdate) AS VARCHAR) AS eth_minor,
         CASE WHEN o_totalprice < 20000 THEN NULL WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS flag,
         o_totalprice AS score,
         CASE WHEN o_totalprice < 20000 THEN NULL ELSE round(o_totalprice / 10000, 2) END AS prior,
         substr('NAPK', CAST(quarter(o_orderdate) AS INTEGER), 1) AS sen,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS eal
  FROM orders),
providers AS (
  SELECT c_custkey AS provider, c_name AS provider_name,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 'Other independent school'
              WHEN 'BUILDING' THEN 'Community special school' WHEN 'AUTOMOBILE' THEN 'Academy converter'
              WHEN 'FURNITURE' THEN 'Community school' ELSE 'Voluntary aided school' END AS sch_type,
         CASE WHEN c_acctbal < 1000 THEN 'Boys' WHEN c_acctbal < 2500 THEN 'Girls' ELSE 'Mixed' END AS sch_gender,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 8000 THEN 'Selective' ELSE 'Non-selective' END AS selective,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'Rural town and fringe'
              WHEN c_acctbal < 6000 THEN 'Rural village' ELSE 'Urban major conurbation' END AS sch_urban,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'Trust ' || n_name END AS trust,
         n_name AS authority, 'E090000' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS area, r_name AS region,
         c_acctbal * 100 AS easting, c_custkey * 10.0::DOUBLE AS northing
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
entries AS (
  SELECT pupil, provider, count(*) AS n_subjects, sum(points) AS sum_points, avg(points) AS mean_points,
         max(CASE WHEN subject = '{FOCUS}' THEN points END) AS focus_points
  FROM facts GROUP BY pupil, provider),
cohort AS (
  SELECT e.*, p.* EXCLUDE (pupil, year), v.* EXCLUDE (provider)
  FROM entries e LEFT JOIN pupils p USING (pupil) LEFT JOIN providers v USING (provider))"""
