"""Hard negatives against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import threshold_join as tj

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score string, uid string"


def plain(rows, anchors, p):
    """Rows are (id, vector, label); every anchor, positive and negative by sorting all scores."""
    out = []
    for i in anchors:
        a, va, la = rows[i]
        scored = sorted((-int(np.dot(va, v)), b, j, la == l) for j, (b, v, l) in enumerate(rows) if j != i)
        for s, b, _, _ in [x for x in scored if x[3]][: p.positives]:
            good = [(b2, -s2) for s2, b2, _, same in scored if not same and p.low * -s <= 100 * -s2 <= p.high * -s][: p.negatives]
            out += [(a, b, k + 1, b2, -s, s2) for k, (b2, s2) in enumerate(good)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "r", "s", "u") for i, v, l in rows], SCHEMA)


def run(spark, rows, p, every=10):
    return sorted(tuple(r) for r in tj.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, p).collect())


@pytest.mark.parametrize("low,high,labels,spread", [(30, 90, 4, 60), (80, 99, 2, 3), (0, 100, 30, 8)])
def test_like_a_plain_search(spark, low, high, labels, spread):
    """Many blocks and parts, ties (small whole numbers), negative scores, and a label that holds most rows."""
    rng = np.random.default_rng(labels)
    p = tj.Mining(low=low, high=high, sample=50, least_block=64, most_block=64, part=16, cells=512, step=3)
    rows = [(i, rng.integers(-spread, spread + 1, 11).astype(float).tolist(), 0 if rng.random() < 0.4 else int(rng.integers(0, labels))) for i in range(500)]
    assert run(spark, rows, p) == plain(rows, [i for i, r in enumerate(rows) if r[0] % 10 == 0], p)


def test_copies_and_few_rows(spark):
    """Windows that cannot fill, labels without another row, equal vectors, zero vectors."""
    p = tj.Mining(sample=4, least_block=8, most_block=8)
    rows = [(i, [3.0, 4.0], 1) for i in range(30)] + [(100 + i, [2.0, 2.0], 2) for i in range(15)] + [(200, [0.0, 0.0], 3), (210, [0.0, 0.0], 3), (220, [5.0, 5.0], 4)]
    assert run(spark, rows, p) == plain(rows, [i for i, r in enumerate(rows) if r[0] % 10 == 0], p)


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i % 5), 2.0, float(i % 3)], i % 2) for i in range(40)]
    bad = [(None, [1.0, 1.0, 1.0], 1), (50, None, 1), (60, [1.0, None, 1.0], 0), (70, [float("nan"), 1.0, 1.0], 0), (80, [float("inf"), 1.0, 1.0], 1), (90, [9.0, 9.0, 9.0], None), (100, [1.0], 0)]
    p = tj.Mining()
    assert run(spark, good + bad, p) == plain(good, [0, 10, 20, 30], p)


def test_empty_tables(spark):
    p = tj.Mining()
    out = tj.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0, p)
    assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert run(spark, [(1, [1.0], 1)], p) == [] and run(spark, [(10, [1.0], 1)], p) == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(10, [2.0, 1.0], 1), (10, [2.0, 1.0], 1), (11, [1.0, 0.0], 2)]
    got = run(spark, rows, tj.Mining())
    assert got == [(10, 10, 1, 11, 5, 2), (10, 10, 1, 11, 5, 2)]


def test_index_leaves_out_what_norms_cover():
    """Fewer postings than values, and still every pair that reaches the threshold."""
    rng = np.random.default_rng(0)
    v = np.rint(rng.normal(0, 50, (300, 32)) * np.linspace(2, 0.05, 32))
    q = np.rint(rng.normal(0, 50, (20, 32)) * np.linspace(2, 0.05, 32))
    full = q @ v.T
    t = np.sort(full, axis=1)[:, -10]
    index = tj.build_index(v.T, tj.suffix_norms(q.T).max(axis=1), t.min())
    assert 0 < index.reach.sum() < 0.8 * v.size
    a, b, s = tj.above(index, q, t, 4)
    want = {(i, j): full[i, j] for i, j in zip(*np.nonzero(full >= t[:, None]))}
    assert {(i, j): x for i, j, x in zip(a.tolist(), b.tolist(), s.tolist())} == want and len(a) == len(want)
