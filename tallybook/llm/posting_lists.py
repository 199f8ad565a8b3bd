"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored
from .textbatch import SEED


@dataclass(frozen=True)
class Lists:
    """``sample``: vectors the index is fitted on at most, and ``sample_bytes`` their size. ``list_size``: vectors a list should hold, ``most_lists`` bounds
    their number and so the broadcast centroids. A vector is filed in the lists whose centroids are at most ``spread``
    times as far as the nearest, in ``replicas`` at most; a query reads the lists up to ``ratio`` times as far. ``beam``
    (of a query) and ``filing_beam``: centroids kept by a graph search, ``degree``: neighbours of a centroid in the graph. ``block``: vectors, and
    queries, of a list that one task compares."""

    sample: int = 20_000
    sample_bytes: int = 128 << 20
    list_size: int = 200
    most_lists: int = 4096
    spread: float = 1.1
    replicas: int = 4
    ratio: float = 1.2
    beam: int = 128
    filing_beam: int = 16
    degree: int = 24
    block: int = 4000


@dataclass(frozen=True)
class Graph:
    """Centroids, the neighbours of each, where a search begins, and which neighbours stand for the first time in their row."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @cached_property
    def first(self) -> np.ndarray:
        order = np.argsort(self.neighbours, axis=1, kind="stable")
        ranked = np.take_along_axis(self.neighbours, order, axis=1)
        fresh = np.ones(ranked.shape, bool)
        fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        out = np.empty_like(fresh)
        np.put_along_axis(out, order, fresh, axis=1)
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of equally large parts: a part is cut at the median of the difference of distances to two centres."""
    parts, done = [sample], []
    while parts:
        part = parts.pop()
        if len(part) <= max(1.5 * len(sample) / lists, 1):
            done.append(part.mean(axis=0))
            continue
        two = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            gap = squared(part, two[:1])[:, 0] - squared(part, two[1:])[:, 0]
            order = np.argsort(gap, kind="stable")
            near, far = part[order[: len(part) // 2]], part[order[len(part) // 2 :]]
            two = np.stack([near.mean(axis=0), far.mean(axis=0)])
        parts += [near, far]
    return np.array(done)


def build_graph(centroids: np.ndarray, degree: int, rng: np.random.Generator) -> Graph:
    """Ties of each centroid: of its nearest ones those that no nearer tie is closer to, so that ties point in all
    directions; free places go to the nearest ones left out, a quarter to random ones, for long hops."""
    n = len(centroids)
    degree = min(degree, n - 1) if n > 1 else 1
    if n == 1:
        return Graph(centroids, np.zeros((1, 1), np.int64), np.zeros(1, np.int64))
    hops, pool = degree // 4, min(3 * degree, n - 1)
    neighbours = np.empty((n, degree), np.int64)
    for low in range(0, n, 256):
        at = np.arange(low, min(low + 256, n))
        d = squared(centroids[at], centroids)
        d[np.arange(len(at)), at] = np.inf
        near = np.argpartition(d, pool - 1, axis=1)[:, :pool]
        gap = np.take_along_axis(d, near, axis=1)
        order = np.argsort(gap, axis=1, kind="stable")
        near, gap = np.take_along_axis(near, order, axis=1), np.take_along_axis(gap, order, axis=1)
        covered = np.zeros(near.shape, bool)  # some nearer tie is closer to it than the centroid is
        for j in range(pool):
            between = ((centroids[near] - centroids[near[:, j]][:, None, :]) ** 2).sum(axis=2)
            covered[:, j + 1 :] |= (~covered[:, j])[:, None] & (between < gap)[:, j + 1 :]
        first = np.argsort(covered, axis=1, kind="stable")[:, :degree]  # uncovered ones, then the others, each by distance
        neighbours[at] = np.take_along_axis(near, first, axis=1)
    if hops:
        neighbours[:, -hops:] = rng.integers(0, n, (n, hops))
    return Graph(centroids, neighbours, rng.choice(n, min(n, 8), replace=False))


def search_graph(graph: Graph, vectors: np.ndarray, beam: int, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) nearest first, of the best ``beam`` found for each vector by walking the graph; -1 and infinity
    where fewer were met. ``counted`` gets the number of distances computed.

    All vectors walk together. Each holds the best ``beam`` centroids it met and which ones it met at all; a step opens the
    nearest one not yet opened and measures those of its neighbours that are new. A walk ends when all of its beam is open.
    """
    n, width = len(graph.centroids), min(beam, len(graph.centroids))
    out_ids, out_d = np.empty((len(vectors), width), np.int64), np.empty((len(vectors), width))
    most = max(1, min(1024, (32 << 20) // n))  # walks at a time, by what they mark as met
    for low in range(0, len(vectors), most):
        v = vectors[low : low + most]
        rows = np.arange(len(v))
        met = np.zeros((len(v), n), bool)
        met[:, graph.entries] = True
        start = np.sqrt(squared(v, graph.centroids[graph.entries]))
        places = max(width, len(graph.entries))
        ids, d = np.full((len(v), places), -1, np.int64), np.full((len(v), places), np.inf)
        ids[:, : len(graph.entries)], d[:, : len(graph.entries)] = graph.entries, start
        opened = np.zeros(ids.shape, bool)
        measured = start.size
        while True:
            waiting = np.where(opened, np.inf, d)
            best = waiting.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(waiting[rows, best]))
            if not len(live):
                break
            opened[live, best[live]] = True
            near = graph.neighbours[ids[live, best[live]]]
            fresh = ~met[live[:, None], near] & graph.first[ids[live, best[live]]]
            met[live[:, None], near] = True
            who, which = np.nonzero(fresh)
            gap = np.full(near.shape, np.inf)
            gap[who, which] = np.sqrt(((graph.centroids[near[who, which]] - v[live[who]]) ** 2).sum(axis=1))
            measured += len(who)
            all_d = np.concatenate([d[live], gap], axis=1)
            keep = np.argpartition(all_d, places - 1, axis=1)[:, :places]
            d[live] = np.take_along_axis(all_d, keep, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, axis=1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1), keep, axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        out_d[low : low + most] = np.take_along_axis(d, order, axis=1)
        out_ids[low : low + most] = np.where(np.isfinite(out_d[low : low + most]), np.take_along_axis(ids, order, axis=1), -1)
        if counted is not None:
            counted.append(measured)
    return out_ids, out_d


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _file(graph: Graph, beam: int, dim: int, reach: float, most: int | None):
    """Tasks that name the lists of each vector: near enough by ratio, the nearest always."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids, d = search_graph(graph, _matrix(part.column("vector"), dim), beam)
                chosen = d <= d[:, :1] * reach + 1e-12
                if most is not None:
                    chosen[:, most:] = False
                row, place = np.nonzero(chosen & np.isfinite(d))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("vid"), taken.column("vector"), pa.array(ids[row, place].astype(np.int32))], ["vid", "vector", "list"])

    return file


def _compare(dim: int, k: int):
    """The ``k`` nearest vectors of a block to each query of its list, with ties to the smaller lowest id."""

    def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [], [], []
        if vectors.num_rows and queries.num_rows:
            v, low = _matrix(vectors.column("vector"), dim), vectors.column("low").to_numpy()
            order = np.argsort(low, kind="stable")
            v, vid = v[order], vectors.column("vid").to_numpy()[order]
            qid = queries.column("vid").to_numpy()
            q = _matrix(queries.column("vector"), dim)
            take = min(k, len(v))
            for i in range(len(q)):
                d = np.sqrt(((v - q[i]) ** 2).sum(axis=1))
                near = np.sort(np.partition(d, take - 1)[:take])[-1]
                best = np.flatnonzero(d <= near)
                best = best[np.argsort(d[best], kind="stable")][:take]
                out_q.append(np.full(len(best), qid[i]))
                out_v.append(vid[best])
                out_d.append(d[best])
        flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_v, np.int64), (out_d, np.float64))]
        return pa.table({"qid": flat[0].astype(np.int64), "vid": flat[1].astype(np.int64), "score": flat[2]})

    return compare


def nearest(vectors: DataFrame, queries: Column, k: int = 10, p: Lists = Lists(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest other rows found of every row for which ``queries`` holds.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Rows with a null id, or whose
    vector is null, zero, of another length than most, or holds nulls or numbers that are not finite take no part.

    Equal vectors are one entry with their k + 1 lowest ids, so that a vector that very many rows share costs one row. The
    index is fitted on a bounded sample: balanced clusters and a graph over their centroids. Every vector is filed by a
    walk on that graph, in several lists if it lies at a boundary; a query walks the same graph and reads the lists that
    the distance ratio selects. The vectors and the queries of a long list are split into blocks, of which each two meet in
    one task.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = f"query_id {dict(rows.dtypes)['id']}, rank int, vec_id {dict(rows.dtypes)['id']}, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    rows = rows.filter(F.size("vector") == dim)
    lowest = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("place") <= k + 1)
    asking = rows.filter("asks").select("vector").distinct().withColumn("asks", F.lit(True))
    entries = lowest.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(asking, "vector", "left")
    entries = stored(entries.select(F.monotonically_increasing_id().alias("vid"), "vector", "ids", F.element_at("ids", 1).alias("low"), F.coalesce("asks", F.lit(False)).alias("asks")), "entries")

    count = entries.count()
    rng = np.random.default_rng(SEED + 7)
    sample = entries.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(min(p.sample, max(p.sample_bytes // (8 * dim), 1)))
    points = _matrix(sample.select("vector").toArrow().column("vector"), dim)
    lists = int(min(max(count // p.list_size, 1), p.most_lists, len(points)))
    graph = build_graph(balanced_centroids(points, lists, rng), p.degree, rng)

    filed_schema = "vid long, vector array<double>, list int"
    filed = stored(entries.select("vid", "vector").mapInArrow(_file(graph, p.filing_beam, dim, p.spread, p.replicas), filed_schema), "lists")
    asked = stored(entries.filter("asks").select("vid", "vector").mapInArrow(_file(graph, p.beam, dim, p.ratio, None), filed_schema), "asked")
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / p.block).cast("int").alias("parts"))
    sizes = filed.groupBy("list").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks")).join(parts, "list")
    sizes = F.broadcast(stored(sizes, "sizes"))  # one row a list that is read, at most ``most_lists``
    part = F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")
    left = filed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).join(entries.select("vid", "low"), "vid")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "block", "part", "vid", "vector", "low")
    right = asked.join(sizes, "list").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("list", "block", "part", "vid", "vector")
    keys = ["list", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(dim, k + 1), "qid long, vid long, score double")
    met = found.groupBy("qid", "vid").agg(F.min("score").alias("score"))
    best = met.join(entries.select("vid", "ids", "low"), "vid")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "low"))
    best = best.withColumn("place", place).filter(F.col("place") <= k + 1).select("qid", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).filter(F.col("place") <= k + 1)
    best = stored(best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near")), "nearest")
    asking_rows = rows.filter("asks").join(entries.filter("asks").select("vector", F.col("vid").alias("qid")), "vector").select(F.col("id").alias("query_id"), "qid")
    own = asking_rows.join(best, "qid")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
