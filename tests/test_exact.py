"""Exactness on skewed fixtures, checked by brute force, numpy and known tail values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.functions import tails
from tallybook.operators import clean, logit, rank, reshape, select, spatial, stats


def test_tail_probabilities():
    assert tails.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_tail(0.0, 7) == pytest.approx(1.0)
    assert tails.t_tail(-12.7062047, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.normal_tail(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(0.0, 3) == 1.0


@pytest.mark.parametrize("bands", [4, 10])
def test_bands_with_one_value_holding_most_rows(spark, bands):
    rng = random.Random(1)
    data = [("hot", 5.0 if rng.random() < 0.6 else float(rng.randint(0, 40)), i) for i in range(3000)]
    data += [("few", float(i % 3), 10_000 + i) for i in range(7)] + [("hot", None, 20_000)]
    df = spark.createDataFrame(data, "g string, v double, id long")
    got = {r["id"]: r["band"] for r in rank.ntile_bands(df, ["g"], "v", "id", bands).collect()}
    for g in ("hot", "few"):
        ordered = sorted((v, i) for k, v, i in data if k == g and v is not None)
        small, wide = divmod(len(ordered), bands)
        want = [b + 1 for b in range(bands) for _ in range(small + (b < wide))]
        assert [got[i] for _, i in ordered] == want
    assert got[20_000] is None


@pytest.mark.parametrize("bins,small", [(32, 150), (1024, 100_000)])
def test_values_at_ranks_by_many_passes(spark, bins, small):
    """A group of distinct values only, heavy tails, one value holding most rows, whole numbers, null keys."""
    rng = random.Random(4)
    data = [("distinct", rng.random()) for _ in range(1500)] + [("tails", rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 12)) for _ in range(600)]
    data += [("hot", 7.0 if rng.random() < 0.7 else float(rng.randint(-3, 20))) for _ in range(900)] + [(None, float(i)) for i in range(40)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    rows = select.values_at_ranks(df, ["g"], "v", lambda n: F.array(F.lit(1).cast("long"), F.ceil(n / 3), n, n + 1), bins, small).collect()
    seen = {}
    for r in rows:
        values = sorted(v for g, v in data if g == r["g"] and v is not None)
        want = values[r["rank"] - 1]
        assert (r["value"], r["size"], r["below"], r["equal"]) == (want, len(values), sum(v < want for v in values), values.count(want))
        seen.setdefault(r["g"], set()).add(r["rank"])
    assert seen == {"distinct": {1, 500, 1500}, "tails": {1, 200, 600}, "hot": {1, 300, 900}, None: {1, 14, 40}, "one": {1}}
    ids = spark.range(10_000).select(F.lit("a").alias("g"), (F.col("id") * 7 + 10**15).alias("v"))
    assert [r["value"] for r in select.values_at_ranks(ids, ["g"], "v", lambda n: F.array(F.lit(6001).cast("long")), bins, small).collect()] == [6000 * 7 + 10**15]


def test_band_edges_cut_ties_only_where_needed(spark):
    data = [("a", float(i // 10), i) for i in range(100)]
    df = spark.createDataFrame(data, "g string, v double, id long")
    (row,) = select.band_edges(df, ["g"], "v", "id", 4, bins=4, small=40).collect()
    assert [(e["rank"], e["value"], e["tie"]) for e in row["edges"]] == [(25, 2.0, 24), (50, 4.0, None), (75, 7.0, 74)]


def test_quantiles_of_a_group_of_distinct_values(spark):
    rng = random.Random(8)
    data = [("g", rng.gauss(0, 1)) for _ in range(5001)] + [("h", float(i)) for i in range(4)] + [("i", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in rank.group_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for g in ("g", "h"):
        want = np.quantile([v for k, v in data if k == g], [0.25, 0.5, 0.9])
        assert got[g] == pytest.approx(tuple(want), rel=1e-12)
    assert set(got) == {"g", "h"}


@pytest.mark.parametrize("leaf, sent", [(spatial.LEAF, 20000), (1000, 20000), (4, 0)])
def test_nearest_distance_is_exact(spark, leaf, sent, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_SENT", sent)  # at 0 cut points are joined by shuffle
    rng = random.Random(2)
    cluster = [(rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(300)]
    refs = cluster + [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(40)] + [cluster[0]] * 50
    points = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(150)] + [(200 + i, *cluster[i]) for i in range(20)]
    points += [(300 + i, 0.0, 0.0) for i in range(50)]
    df = spark.createDataFrame([*points, (999, None, 1.0)], "id long, x double, y double")
    ref = spark.createDataFrame([*refs, (None, 0.0)], "x double, y double")
    got = {r["id"]: (r["distance"], r["near"]) for r in spatial.nearest_distance(df, ref, cutoff=5.0, leaf=leaf).collect()}
    for i, x, y in points:
        want = min(math.hypot(x - a, y - b) for a, b in refs)
        assert got[i][0] == pytest.approx(want, abs=1e-9)
        assert got[i][1] == (want <= 5.0)
    assert got[999][0] is None and len(got) == len(points) + 1


def test_a_dense_cluster_is_split_however_far_the_other_points_lie(spark):
    rng = random.Random(9)
    rows = [(rng.random(), rng.random()) for _ in range(4000)] + [(1e6, 1e6)] + [(0.5, i / 500) for i in range(500)]
    cells = spatial.split_cells(spark.createDataFrame(rows, "rx double, ry double"), 16)
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) <= 16
    assert len({len(c) for c in sizes}) > 1  # depth differs from place to place
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)


@pytest.mark.parametrize("rows", [[(0.5, i / 3000) for i in range(3000)], [(i / 3000, 0.5) for i in range(3000)], [(0.5, float(i)) for i in range(2900)] + [(float(i), 7.0) for i in range(100)]])
def test_equal_coordinates_leave_few_points_in_a_cell(spark, rows):
    """Vertices with one x (or y): each place is measured against the points of few cells, all of them small."""
    refs = spark.createDataFrame(sorted(set(rows)), "rx double, ry double")
    cells = spatial.split_cells(refs, 32)
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 32 and cells.count() == len(set(rows))
    points = [(i, -1.0 + i / 7, 3.0 + i / 11) for i in range(20)]
    got = {r["id"]: r["distance"] for r in spatial.nearest_distance(spark.createDataFrame(points, "id long, x double, y double"), refs.toDF("x", "y"), leaf=32).collect()}
    assert all(got[i] == pytest.approx(min(math.hypot(x - a, y - b) for a, b in rows), abs=1e-9) for i, x, y in points)


def test_nearest_distance_without_vertices(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert spatial.nearest_distance(points, points.drop("id").limit(0)).first()["distance"] is None


def test_best_attempt_with_one_pupil_holding_a_third_of_all_rows(spark):
    rng = random.Random(3)
    data = [(2017, "hot" if rng.random() < 0.34 else f"p{rng.randint(0, 300)}", rng.randint(1, 20), 310, f"s{rng.randint(0, 3)}", f"q{rng.randint(0, 2)}", "A", float(rng.randint(0, 8))) for _ in range(3000)]
    df = spark.createDataFrame(data, "year int, pupil string, provider long, level int, subject string, qualification string, grade string, points double")
    best = {}
    for _, pupil, _, _, subject, q, _, points in data:
        best[pupil, subject, q] = max(points, best.get((pupil, subject, q), 0))
    want = {(p, v, lv, s, q, x) for _, p, v, lv, s, q, _, x in data if x == best[p, s, q]}
    got = [(r["pupil"], r["provider"], r["level"], r["subject"], r["qualification"], r["points"]) for r in clean.best_attempt(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_two_predictor_fit_matches_lstsq(spark):
    rng = np.random.default_rng(4)
    x1, x2 = rng.integers(0, 2, 400).astype(float), rng.normal(5, 2, 400)
    y = 1.5 - 0.7 * x1 + 0.4 * x2 + rng.normal(0, 1, 400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, x1, x2)], "y double, a double, b double")
    fit = stats.solve_two_predictors(df.agg(*stats.two_predictor_moments("y", "a", "b"))).first()
    design = np.column_stack([np.ones(400), x1, x2])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 397)
    assert [fit["b0"], fit["b1"], fit["b2"]] == pytest.approx(list(beta), rel=1e-9)
    assert [fit["se0"], fit["se1"], fit["se2"]] == pytest.approx(list(se), rel=1e-9)
    reduced = np.linalg.lstsq(design[:, [0, 2]], y, rcond=None)[1][0]
    assert fit["sum_sq"] == pytest.approx(reduced - rss[0], rel=1e-7)


def newton(y, design):
    b = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ b))
        cov = np.linalg.inv((design * (p * (1 - p))[:, None]).T @ design)
        b = b + cov @ (design.T @ (y - p))
    p = 1 / (1 + np.exp(-design @ b))
    return b, np.sqrt(np.diag(cov)), -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_logit_matches_newton_per_group_and_with_interaction(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x, c = rng.normal(30000, 9000, n), rng.choice(["a", "b", "c"], n, p=[0.6, 0.25, 0.15])
    slope = np.where(c == "a", 1.0, np.where(c == "b", -0.5, 0.2))
    y = (rng.random(n) < 1 / (1 + np.exp(0.4 - slope * (x - 30000) / 9000))).astype(int)
    df = spark.createDataFrame([("m", str(cc), float(xx), int(yy)) for cc, xx, yy in zip(c, x, y)] + [("one", "a", 1.0, 1)] * 3, "g string, c string, x double, y int")
    fits = {r["g"]: r for r in logit.grouped_logit(df, ["g"], "y", "x").collect()}
    assert set(fits) == {"m"} and fits["m"]["converged"]
    z = (x - 30000) / 9000
    b, se, deviance = newton(y, np.column_stack([np.ones(n), z]))
    assert fits["m"]["b1"] == pytest.approx(b[1] / 9000, rel=1e-7)
    assert fits["m"]["b0"] == pytest.approx(b[0] - b[1] * 30000 / 9000, rel=1e-7)
    assert fits["m"]["se1"] == pytest.approx(se[1] / 9000, rel=1e-5)
    assert fits["m"]["deviance"] == pytest.approx(deviance, rel=1e-9)
    d = [np.ones(n), z, c == "b", c == "c", z * (c == "b"), z * (c == "c")]
    b, se, _ = newton(y, np.column_stack([np.asarray(v, float) for v in d]))
    rows = {r["term"]: r for r in logit.logit_interaction(logit.grouped_logit(df.filter("g = 'm'"), ["g", "c"], "y", "x"), ["g"], "x", "c").collect()}
    assert rows["x:b"]["est"] == pytest.approx(b[4] / 9000, rel=1e-6)
    assert rows["x:c"]["std_error"] == pytest.approx(se[5] / 9000, rel=1e-5)
    assert rows["x"]["est"] == pytest.approx(b[1] / 9000, rel=1e-6)
    assert rows["c"]["est"] == pytest.approx(b[3] - b[5] * 30000 / 9000, rel=1e-6)


def test_spread_and_gather_are_inverse(spark):
    data = [("p1", 1, "Brand#1", 3.0), ("p1", 1, "Brand#2", 0.0), ("p2", 1, "Brand#2", 8.0)]
    facts = spark.createDataFrame(data, "pupil string, provider long, subject string, points double")
    wide = reshape.spread_subjects(facts, ["Brand#1", "Brand#2", "Brand#3"])
    assert {tuple(r) for r in reshape.gather_subjects(wide).collect()} == {(p, v, "X" + s[6:], x) for p, v, s, x in data}


def test_top_keeps_the_focus_in_the_last_place(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 1)], "subject string, n long")
    pick = lambda focus, k: sorted(r["subject"] for r in rank.keep_top(counts, focus, k).collect())
    assert pick("d", 2) == ["a", "d"] and pick("b", 2) == ["a", "b"] and pick("a", 3) == ["a", "b", "c"]


def test_welch_against_direct_formula(spark):
    a, b = [1.0, 2.0, 4.0, 8.0], [3.0, 3.5, 9.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    r = stats.with_p(stats.welch_ttest(df, [], F.col("v"), F.col("g") == "a", F.col("g") == "b")).first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 3
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb)
    freedom = (va + vb) ** 2 / (va**2 / 3 + vb**2 / 2)
    assert r["t"] == pytest.approx(t) and r["df"] == pytest.approx(freedom) and r["p"] == pytest.approx(tails.t_tail(t, freedom))


def test_marked_subjects_are_those_kept(spark):
    counts = spark.createDataFrame([(s, n) for s, n in zip("abcdefgh", (9, 7, 7, 5, 4, 2, 1, 0))], "subject string, n long")
    both = counts.withColumn("always", F.lit(False)).unionByName(spark.createDataFrame([("All", 40, True)], "subject string, n long, always boolean"))
    for focus in ("a", "c", "f", "h", "none"):
        for k in (1, 3, 8):
            kept = {r.subject for r in rank.keep_top(counts.filter("n > 0"), focus, k).collect()}
            marked = {r.subject for r in rank.mark_top(both, "top", focus, k, "n", F.col("always")).filter("top").collect()}
            assert marked == kept | {"All"}
