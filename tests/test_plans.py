"""Plans that must hold at scale."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from plan_report import features
from tallybook.operators import common, disclose, spatial, uptake
from tallybook.plans import catalogue, testbed
from tallybook.plans.testbed import Testbed
from tallybook.session import stored

SF_DIR = "/root/testdata/sf0.001"
SHAPES = ["subject_access_all", "provision_by_criteria", "best_attempt", "provider_differential", "average_by_subject",
          "subject_combinations", "ols_by_subject", "anonymise_table", "presence_matrix", "scan_subset", "league_table"]


@pytest.mark.parametrize("key", SHAPES)
def test_no_pairwise_joins(spark, key):
    found = features(catalogue.QUERIES[key](spark, SF_DIR))
    assert found["nested_loop"] == 0 and found["cartesian"] == 0


def test_scan_reads_only_what_is_needed(spark):
    plan = catalogue.QUERIES["subject_access_all"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "lineitem" in line]
    assert scans and all("l_extendedprice" not in line and "l_shipdate" not in line for line in scans)


def scans_of(df, table: str) -> int:
    """Scans of a table in the plan as it ran, where a reused exchange counts once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("FileScan parquet" in line and f"/{table}.parquet" in line for line in plan.splitlines())


@pytest.mark.parametrize("key", ["provision_by_criteria", "league_table", "anonymise_table", "anonymise_table_providers"])
def test_published_tables_read_results_once(spark, key, monkeypatch):
    plans = []

    def remember(df, name="table"):
        plans.append(df)
        return stored(df, name)

    monkeypatch.setattr(uptake, "stored", remember)
    monkeypatch.setattr(disclose, "stored", remember)
    out = catalogue.QUERIES[key](spark, SF_DIR)
    assert len(plans) == 1 and scans_of(plans[0], "lineitem") == 1
    assert scans_of(out, "lineitem") == 0
    assert features(out)["window"] <= 6  # the league table's five ranks and their maxima


def test_report_plans_all_criteria_in_one_pass(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(uptake, "stored", lambda df, name: plans.append(df) or stored(df, name))
    catalogue.QUERIES["criteria_report"](spark, SF_DIR)
    assert len(plans) == 1 and scans_of(plans[0], "lineitem") == 1


@pytest.mark.parametrize("most", [None, 0])  # boxes sent to every task, or candidates shuffled to them
def test_nearest_distance_shuffles_places_once(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(spatial, "MOST_BOXES", most)
        monkeypatch.setattr(spatial, "MOST_SENT", most)
    rng = random.Random(7)
    places = [(i, rng.choice([rng.uniform(-50, 50), 3.0, 0.0, -0.0]), rng.uniform(-50, 50)) for i in range(400)]
    coast = [(rng.choice([rng.uniform(-40, 40), 5.0]), rng.uniform(-40, 40)) for _ in range(600)]
    points = spark.createDataFrame([*places, *[(1000 + i, x, y) for i, x, y in places[:20]], (2000, None, 1.0)], "id int, x double, y double")
    found = spatial.nearest_distance(points, spark.createDataFrame([*coast, *coast[:50], (None, 2.0)], "x double, y double"), 2.0, 8)
    got = {r["id"]: (r["distance"], r["near"]) for r in found.collect()}
    assert len(got) == 421 and got[2000] == (None, None)
    for i, x, y in places:
        least = min(math.hypot(x - a, y - b) for a, b in coast)
        assert got[i][0] == pytest.approx(least, abs=1e-9) and got[i][1] == (got[i][0] <= 2.0)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    if most is None:  # the descent lies between the shuffle that deals places and the last join
        dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
        assert len(dealt) == 1 and "NestedLoop" not in plan
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "deal#" in line and line not in dealt]
        assert sum("Exchange hashpartitioning" in line and ("px#" in line) for line in plan.splitlines()) <= 2


def test_nearest_distance_without_reference_points(spark):
    points = spark.createDataFrame([(1, 0.0, 1.0)], "id int, x double, y double")
    found = spatial.nearest_distance(points, points.filter("id > 1"), 2.0)
    assert [(r["id"], r["distance"], r["near"]) for r in found.collect()] == [(1, None, None)]


def test_tasks_follow_the_number_of_results(spark):
    assert common.tasks_for(spark, 10) == spark.sparkContext.defaultParallelism
    assert common.tasks_for(spark, 100_000_000) == 400
    t = Testbed(spark, SF_DIR)
    t.tasks = 40
    assert t.facts.rdd.getNumPartitions() == 40  # not merged into a few large ones


def test_tasks_are_counted_from_the_tables(spark, monkeypatch):
    monkeypatch.setattr(testbed, "tasks_for", lambda spark, rows: rows)
    assert Testbed(spark, SF_DIR).tasks == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()


@pytest.fixture
def star(spark, tmp_path):
    """Small tables with a part, a customer and an order that come twice, unknown and null keys."""
    rng = random.Random(3)
    parts = [(i, f"Brand#{i % 4}") for i in range(1, 13)]
    customers = [(i, f"c{i}", i % 2, 900.0 * i, rng.choice(["MACHINERY", "BUILDING", "HOUSEHOLD"])) for i in range(1, 9)]
    orders = [(i, rng.choice([*range(1, 11), None]), rng.choice("FOP"), 15000.0 * (i % 25), f"199{5 + i % 3}-0{1 + i % 9}-01",
               rng.choice(["1-URGENT", "2-HIGH"])) for i in range(1, 121)]
    lines = [(rng.choice([*range(1, 126), None]), rng.choice([*range(1, 15), None]), rng.choice("ANR"), "F", float(rng.randint(1, 50)))
             for _ in range(700)]
    tables = {
        "part": ([*parts, parts[2], (None, "Brand#1")], "p_partkey long, p_brand string"),
        "customer": ([*customers, customers[3]], "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"),
        "orders": ([*orders, orders[5]], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double"),
        "nation": ([(0, "N0", 0), (1, "N1", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "region": ([(0, "R")], "r_regionkey long, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.to_timestamp("o_orderdate"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are planned where no table is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def ran(df) -> tuple[list, list[str]]:
    """Sorted rows, and the lines of the plan as it ran."""
    rows = sorted(map(tuple, df.collect()), key=repr)
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def joins(plan: list[str], how: str, key: str) -> int:
    return sum(f"{how} [{key}#" in line for line in plan)


def test_large_dimensions_are_hashed_and_results_not_sorted(spark, star, no_broadcast, monkeypatch):
    small, plan = ran(Testbed(spark, star).cohort())  # left to Spark, which sorts here
    assert joins(plan, "SortMergeJoin", "qualification") == joins(plan, "SortMergeJoin", "provider") == 1
    monkeypatch.setattr(common, "MOST_LEFT_TO_SPARK", 0)
    large, plan = ran(Testbed(spark, star).cohort())
    assert large == small and len(large) > 100
    assert joins(plan, "SortMergeJoin", "qualification") == joins(plan, "SortMergeJoin", "provider") == 0
    assert joins(plan, "ShuffledHashJoin", "qualification") == joins(plan, "ShuffledHashJoin", "provider") == 1


def test_summary_of_subjects_deals_its_groups(spark, star, no_broadcast):
    t = Testbed(spark, star)
    t.tasks = 40
    rows, plan = ran(uptake.provider_subject_summary(t.facts, t.pupils, t.providers, t.tasks))
    assert any("REPARTITION_BY_NUM" in line and "hashpartitioning(provider#" in line and ", 40)" in line for line in plan)
    assert joins(plan, "SortMergeJoin", "provider") <= 1  # of the provider's own rows; the groups are streamed
    plain = ran(uptake.provider_subject_summary(t.facts, t.pupils, t.providers))[0]
    assert rows == plain and len(rows) > 100
    people, places = {}, {}
    for r in t.pupils.collect():
        people.setdefault(r["pupil"], []).append((r["flag"], r["gender"]))
    for r in t.providers.collect():
        places.setdefault(r["provider"], []).append(r)
    entries, pupils = collections.Counter(), {}
    for r in t.facts.collect():
        pupils.setdefault(r["provider"], set()).add(r["pupil"])
        entries.update((r["provider"], r["subject"], *p) for p in people.get(r["pupil"], [(None, None)]))
    expected = [
        (*key, n, len(pupils[key[0]]), place and place["area"]) for key, n in entries.items() if key[0] is not None
        for place in places.get(key[0], [None])
    ]
    assert sorted([r[:7] for r in rows], key=repr) == sorted(expected, key=repr)
