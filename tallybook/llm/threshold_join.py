"""Hard negatives by threshold joins: an inverted index without the dimensions that suffix norms cover."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored


@dataclass(frozen=True)
class Mining:
    """``positives``: nearest rows of the anchor's label; ``negatives``: rows of other labels returned for each of them,
    whose score lies between ``low`` and ``high`` percent of the positive's.

    ``rounds``: how many times the wanted rows the threshold of a round should let through; a last round is open to all.
    ``sample``: rows from which thresholds are guessed. ``least_block``, ``most_block``: rows that share an index, in
    between 16 times the root of their number; ``part``: requests that meet a block in one task; ``cells``: scores a task
    holds at a time; ``step``: dimensions added up between two looks at the bounds.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    rounds: tuple[int, ...] = (4, 64)
    sample: int = 2048
    least_block: int = 4096
    most_block: int = 65_536
    part: int = 16_384
    cells: int = 1 << 21
    step: int = 8


# The index ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Postings of rows in falling order of their number of indexed dimensions.

    ``vectors``: dimension by entry; the postings of dimension d are its first ``reach[d]`` entries. ``order``: the row
    of each entry. ``rest``: norm of an entry's values from each dimension on.
    """

    vectors: np.ndarray
    order: np.ndarray
    reach: np.ndarray
    rest: np.ndarray


def suffix_norms(vectors: np.ndarray) -> np.ndarray:
    """(dimensions + 1, entries): norm of each entry of ``vectors`` (dimension by entry) from each dimension on; rounded up."""
    squares = np.cumsum((vectors * vectors)[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([squares, np.zeros((1, vectors.shape[1]))])) * (1 + 1e-9)


def build_index(vectors: np.ndarray, norms: np.ndarray, threshold: float) -> Index:
    """Index of ``vectors`` (dimension by row) for queries whose suffix norms are ``norms`` at most.

    The last dimensions of a row are left out as far as they alone cannot bring a score to ``threshold``: what they add is
    covered by the product of the two norms.
    """
    rest = suffix_norms(vectors)
    needed = (rest[:-1] * norms[:-1, None] >= threshold).sum(axis=0)  # norms fall with the dimension
    order = np.argsort(-needed, kind="stable")
    reach = np.searchsorted(-needed[order], -np.arange(len(vectors)), side="left")
    return Index(np.ascontiguousarray(vectors[:, order]), order, reach, rest[:, order])


def above(index: Index, queries: np.ndarray, thresholds: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every pair whose inner product reaches the query's threshold.

    Partial scores grow over the postings, ``step`` dimensions at a time. Queries and entries whose scores cannot reach a
    threshold with the norms that remain go. An entry whose postings end gets its left-out dimensions, if the remaining
    norms allow it to reach the threshold.
    """
    dims, rest = len(index.vectors), suffix_norms(queries.T)
    live, cols = np.arange(len(queries)), np.arange(len(index.order))
    scores = np.zeros((len(live), len(cols)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low in range(0, dims + step, step):
        low, high = min(low, dims), min(low + step, dims)
        met = int(np.searchsorted(cols, index.reach[low])) if low < dims else 0
        bound = scores[:, met:] + rest[low, live][:, None] * index.rest[low, cols[met:]]
        q, c = np.nonzero(bound >= thresholds[live][:, None])
        if len(q):
            total = scores[q, met + c]
            for a in range(0, len(q), 1 << 16):  # verification of the pairs that are left
                some = slice(a, a + (1 << 16))
                total[some] += np.einsum("pd,dp->p", queries[live[q[some]], low:], index.vectors[low:, cols[met + c[some]]])
            good = total >= thresholds[live[q]]
            found.append((live[q[good]], index.order[cols[met + c[good]]], total[good]))
        cols, scores = cols[:met], scores[:, :met]
        if not scores.size:
            break
        scores = scores + queries[live, low:high] @ index.vectors[low:high, cols]
        alive = scores + rest[high, live][:, None] * index.rest[high, cols] >= thresholds[live][:, None]
        keep_q, keep_c = alive.any(axis=1), alive.any(axis=0)
        if keep_q.sum() < 0.9 * len(live) or keep_c.sum() < 0.9 * len(cols):
            live, cols, scores = live[keep_q], cols[keep_c], scores[np.ix_(keep_q, keep_c)]
    return tuple(np.concatenate(x) for x in zip(*found))


# Tasks --------------------------------------------------------------------------------------------------------------


def _column(table, name: str, kind=np.int64) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _matrix(table, dim: int) -> np.ndarray:
    column = table.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def guess(scores: np.ndarray, low: float, high: float, wanted: float) -> float:
    """A threshold that about ``wanted`` of ``scores`` up to ``high`` reach; ``wanted`` may be a fraction of a row."""
    x = np.sort(scores[scores <= high])[::-1]
    if wanted >= len(x):
        return low
    if wanted >= 1:
        t = x[int(np.ceil(wanted)) - 1]
    elif np.isfinite(high):  # as dense above the nearest ones as among them
        near = min(8, len(x))
        t = high - (high - x[near - 1]) * wanted / near
    else:
        t = max(x[0], x.mean() + x.std() * NormalDist().inv_cdf(1 - wanted / len(x)))
    return max(float(np.floor(t)), low)


def _guessing(sample: np.ndarray, uids: np.ndarray, labels: np.ndarray, rows: int, factor: float | None, dim: int):
    """Tasks that give each request the threshold of this round; its lower limit in the last one."""

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = _column(batch, "low", float), _column(batch, "high", float)
            if factor is None:
                out = low
            else:
                out = np.empty(batch.num_rows)
                queries, own, label, same, want = _matrix(batch, dim), _column(batch, "auid"), _column(batch, "label"), _column(batch, "same", bool), _column(batch, "want")
                for i in range(batch.num_rows):
                    fit = ((labels == label[i]) == same[i]) & (uids != own[i])
                    out[i] = guess(sample[fit] @ queries[i], low[i], high[i], want[i] * factor * len(sample) / rows)
            yield pa.RecordBatch.from_arrays([batch.column("auid"), batch.column("place"), pa.array(out)], ["auid", "place", "threshold"])

    return guessed


def _meet(dim: int, p: Mining):
    """The best rows of a block for each request that meets it."""

    def meet(rows: pa.Table, requests: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        if rows.num_rows and requests.num_rows:
            vectors, uid, vec_id, label = _matrix(rows, dim), _column(rows, "uid"), _column(rows, "vec_id"), _column(rows, "label")
            auid, place, same, want = _column(requests, "auid"), _column(requests, "place"), _column(requests, "same", bool), _column(requests, "want")
            low, high, wanted_label = _column(requests, "threshold", float), _column(requests, "high", float), _column(requests, "label")
            _, first, of = np.unique(auid, return_index=True, return_inverse=True)
            queries = _matrix(requests, dim)[first]
            thresholds = np.full(len(first), np.inf)
            np.minimum.at(thresholds, of, low)
            by_query = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[by_query], np.arange(len(first) + 1))
            index = build_index(vectors.T, suffix_norms(queries.T).max(axis=1), thresholds.min())
            chunk = max(1, p.cells // len(vectors))
            for a in range(0, len(first), chunk):
                q, r, s = above(index, queries[a : a + chunk], thresholds[a : a + chunk], p.step)
                order = np.lexsort((uid[r], vec_id[r], -s, q))
                q, r, s = q[order], r[order], s[order]
                at = np.searchsorted(q, np.arange(len(thresholds[a : a + chunk]) + 1))
                for i in range(len(at) - 1):
                    if at[i] == at[i + 1]:
                        continue
                    hit, score = r[at[i] : at[i + 1]], s[at[i] : at[i + 1]]
                    for k in by_query[edges[a + i] : edges[a + i + 1]]:
                        fit = (score >= low[k]) & (score <= high[k]) & ((label[hit] == wanted_label[k]) == same[k]) & (uid[hit] != auid[k])
                        best = np.flatnonzero(fit)[: want[k]]
                        out.append((np.full(len(best), auid[k]), np.full(len(best), place[k]), uid[hit[best]], vec_id[hit[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*out)]
        columns[-1] = columns[-1].astype(np.int64)
        return pa.table(dict(zip(("auid", "place", "uid", "vec_id", "score"), columns))).cast(_FOUND)

    return meet


_FOUND = pa.schema([("auid", pa.int64()), ("place", pa.int32()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


# Requests -----------------------------------------------------------------------------------------------------------


def _fill(rows: DataFrame, requests: DataFrame, n: int, dim: int, p: Mining) -> DataFrame:
    """(auid, place, rank, vec_id, score): the first ``want`` rows that each request asks for.

    ``requests``: auid, place, label, vector, same (of that label, or of any other), want, low, high (limits of the score).
    A round is a threshold join; requests it fills are done, for the others the threshold is lowered.
    """
    size = int(min(max(16 * n**0.5, p.least_block), p.most_block))
    blocks = -(-n // size)
    drawn = rows.orderBy(F.xxhash64("uid"), "uid").limit(p.sample).select("uid", "label", "vector").toArrow()  # ``sample`` rows
    sample, uids, labels = _matrix(drawn, dim), _column(drawn, "uid"), _column(drawn, "label")
    by_block = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    filled, waiting = rows.sparkSession.createDataFrame([], "auid long, place int, vec_id long, score long, rank int"), requests
    best = Window.partitionBy("auid", "place").orderBy(F.desc("score"), "vec_id", "uid")
    for factor in (*p.rounds, None):
        number = waiting.count()
        if not number:
            break
        thresholds = waiting.mapInArrow(_guessing(sample, uids, labels, n, factor, dim), "auid long, place int, threshold double")
        asked = stored(waiting.join(thresholds, ["auid", "place"]), "asked")
        parts = -(-number // p.part)
        left = by_block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("block", "part", "uid", "vec_id", "label", "vector")
        right = asked.withColumn("part", F.pmod(F.xxhash64("auid"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = right.select("block", "part", "auid", "place", "label", "vector", "same", "want", "threshold", "high")
        met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_meet(dim, p), "auid long, place int, uid long, vec_id long, score long")
        ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(p.positives, p.negatives))
        found = stored(ranked.join(asked.select("auid", "place", "want"), ["auid", "place"]).filter("rank <= want").drop("want", "uid"), "found")
        full = found.groupBy("auid", "place").agg(F.count("*").alias("n"))
        open_ = asked.join(full, ["auid", "place"], "left").filter("coalesce(n, 0) < want and threshold > low").drop("n", "threshold")
        waiting = stored(open_, "waiting")
        filled = filled.unionByName(found.join(waiting.select("auid", "place"), ["auid", "place"], "left_anti"))
    return filled


def usable(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def hard_negatives(vectors: DataFrame, anchors: Column, p: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row for which ``anchors`` holds.

    An anchor's positives are its first rows of the same label by score, its hard negatives for one of them the first rows
    of other labels with ``low`` * positive_score <= 100 * score <= ``high`` * positive_score. The score is the inner product
    of the vectors, which must be whole numbers with sums below 2 ** 53 (then it is exact); higher scores come first, ties
    go to the smaller id, then in any fixed order. An anchor is not its own positive, another row with its id may be one.

    Rows with a null id or label, or whose vector is null, of another length than most, or holds nulls or numbers that are
    not finite take no part; an empty table gives an empty result. Each search is a series of threshold joins: rows are
    dealt to blocks of like size, whatever their labels; the anchors are a query set that meets every block, in parts. A
    block is indexed by dimensions without those that suffix norms cover, partial scores are pruned by what the remaining
    norms can add, and only the best rows of a block go on. A first threshold is guessed from a bounded sample; it is
    lowered for searches that it leaves unfilled, at last down to the lower limit, so the result is complete.
    """
    spark = vectors.sparkSession
    usable_rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    usable_rows = usable_rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = stored(usable_rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None or not lengths["dim"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, n = lengths["dim"], lengths["n"]
    rows = rows.filter(F.size("vector") == dim)
    asking = rows.filter("asks").select(F.col("uid").alias("auid"), F.col("vec_id").alias("anchor_id"), "label", "vector")

    def limit(percent: int, up: bool) -> Column:
        """A hundredth of ``percent`` times the score, as a whole number."""
        x = F.col("positive_score") * percent
        return (x + F.pmod(-x, F.lit(100)) if up else x - F.pmod(x, F.lit(100))).cast("double") / 100

    first = asking.select("auid", F.lit(0).alias("place"), "label", "vector", F.lit(True).alias("same"), F.lit(p.positives).alias("want"),
                          F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    positives = _fill(rows, first, n, dim, p).select("auid", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = stored(positives, "positives")
    second = positives.join(asking, "auid").select("auid", "place", "label", "vector", F.lit(False).alias("same"), F.lit(p.negatives).alias("want"),
                                                   limit(p.low, True).alias("low"), limit(p.high, False).alias("high")).filter("low <= high")
    negatives = _fill(rows, stored(second, "requests"), n, dim, p).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    whole = negatives.join(positives, ["auid", "place"]).join(asking.select("auid", "anchor_id"), "auid")
    return whole.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
