"""Removal of repeated byte strings through a distributed, common-prefix-aware merge sort of suffixes."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_BYTES, discard, sized, stored, text_key
from .textbatch import SEED, mixed, pieces

GRAM = 16


@dataclass(frozen=True)
class Repeats:
    """``length``: bytes of a string that must be found again. ``part``: suffixes that a part of the merge should hold; there
    are as many parts as that takes, the session's shuffle partitions at least. ``run``: suffixes a sorted run holds at
    most. ``broadcast``: bytes up to which a counted table is sent to all tasks; a larger one is joined by shuffle."""

    length: int = 400
    part: int = 60_000
    run: int = 20_000
    broadcast: int = BROADCAST_BYTES

    @property
    def window(self) -> int:
        """Positions among which an anchor is chosen; it lies in the first half of any string of ``length`` bytes."""
        return self.length // 2 - GRAM + 1

    @property
    def left(self) -> int:
        return self.window - 1

    @property
    def common(self) -> int:
        """Bytes after an anchor that two equal strings share at least."""
        return self.length - self.left


# Anchors ------------------------------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes by doubling
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return mixed(x[:-8] * np.uint64(0x9FB21C651E98DF25) ^ x[8:] * np.uint64(0xD6E8FEB86659FD93))


def anchors(data: np.ndarray, offsets: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of the anchors: the leftmost least hash among each string's first ``window`` positions.

    Equal strings choose the same place in them, whatever surrounds them.
    """
    w = p.window
    if len(data) < p.length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (_gram_hashes(data) >> np.uint64(32)) << np.uint64(32)
    h |= np.arange(len(h), dtype=np.uint64)
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    padded[:n] = h
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - w + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    doc_end = np.repeat(offsets[1:], np.diff(offsets))[:starts]
    whole = np.arange(starts) + p.length <= doc_end
    at = np.unique((least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return at, np.searchsorted(offsets, at, side="right") - 1


def common_hashes(data: np.ndarray, at: np.ndarray, p: Repeats) -> np.ndarray:
    """Hash of the ``common`` bytes after each anchor."""
    factors = np.random.default_rng(SEED + 5).integers(0, 2**62, p.common, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for low in range(0, len(at), 4096):
        block = data[at[low : low + 4096, None] + np.arange(p.common)].astype(np.uint64) + np.uint64(1)
        out[low : low + 4096] = block @ factors
    return mixed(out)


def _list_anchors(p: Repeats):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                at, doc = anchors(data, offsets, p)
                keys = batch.column("key").slice(low, high - low).take(pa.array(doc))
                hashes = common_hashes(data, at, p).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), keys, pa.array((at - offsets[doc]).astype(np.int32))], ["hash", "key", "pos"])

    return listed


# Runs ---------------------------------------------------------------------------------------------------------------


def pack_run(entries: list[tuple[bytes, bytes, bytes, bool]]) -> bytes:
    """Front-coded block of sorted (suffix, reversed left bytes, context, repeated): each suffix keeps what its
    predecessor does not share."""
    before, shared, rests, lefts, contexts, flags = b"", [], [], [], [], []
    for suffix, left, context, repeated in entries:
        n = lcp(before, suffix, 0)
        shared.append(n)
        rests.append(suffix[n:])
        lefts.append(left)
        contexts.append(context)
        flags.append(repeated)
        before = suffix
    head = np.array([shared, [len(r) for r in rests], [len(x) for x in lefts], flags], np.uint16)
    body = np.uint32(len(entries)).tobytes() + head.tobytes() + b"".join(contexts) + b"".join(rests) + b"".join(lefts)
    return zstandard.ZstdCompressor(level=3).compress(body)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes, bytes, bool]]:
    """(bytes shared with the predecessor, suffix, reversed left bytes, context, repeated) of each entry of a run."""
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    head = np.frombuffer(body, np.uint16, 4 * n, 4).reshape(4, n).tolist()
    context = 4 + 8 * n
    rest = context + 16 * n
    left = rest + sum(head[1])
    before = b""
    for shared, n_rest, n_left, flag in zip(*head):
        before = before[:shared] + body[rest : rest + n_rest]
        yield shared, before, body[left : left + n_left], body[context : context + 16], bool(flag)
        rest, left, context = rest + n_rest, left + n_left, context + 16


def lcp(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def merge_runs(runs: list[Iterator]) -> Iterator[tuple[int, bytes, bytes, bytes, bool]]:
    """Merge sorted front-coded runs by a loser tree; yields entries with the prefix shared with the last one put out.

    A loser remembers how much it shares with the winner that beat it. Two candidates that share different lengths with
    the last winner are ordered by that alone; only equal ones are compared, from the first byte not yet known.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k  # of each head with the last winner
    loser = [-1] * k

    def beats(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length is set to what it shares with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        n = lcp(a[1], b[1], shared[i])
        if (a[1][n:], a[2], i) <= (b[1][n:], b[2], j):
            shared[j] = n
            return i, j
        shared[i] = n
        return j, i

    winners = list(range(k))
    level = k // 2
    while level:  # play the first round from the leaves to the root
        pairs = [beats(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        winners = [w for w, _ in pairs]
        loser[level : 2 * level] = [x for _, x in pairs]
        level //= 2
    top = winners[0]
    while heads[top] is not None:
        _, suffix, left, context, flag = heads[top]
        yield shared[top], suffix, left, context, flag
        heads[top] = next(runs[top], None) if top < len(runs) else None
        shared[top] = heads[top][0] if heads[top] is not None else 0
        node = (top + k) // 2
        while node:
            top, loser[node] = beats(top, loser[node])
            node //= 2


# Clusters -----------------------------------------------------------------------------------------------------------


def cluster_reach(cluster: list[tuple[int, bytes, bytes, bool]], p: Repeats) -> list[tuple[int, int]]:
    """How far repeated strings reach to the left and right of each anchor of a cluster; (0, 0) where none does.

    ``cluster``: (prefix shared with the entry before, suffix, reversed left bytes, repeated) in suffix order. Neighbours
    are joined from the longest shared prefix down. Every group keeps its left sides in order, so that the longest left
    match of an entry is with a neighbour; of two groups the smaller is inserted into the larger.
    """
    n = len(cluster)
    reach = [(0, 0)] * n
    best = [-1] * n

    def note(i: int, level: int, match: int) -> None:
        if match > best[i]:
            best[i] = match
            if level + match >= p.length:
                reach[i] = (max(reach[i][0], match), max(reach[i][1], level))

    for i, (_, suffix, left, repeated) in enumerate(cluster):
        if repeated:
            note(i, len(suffix), len(left))
    group = list(range(n))
    order = {i: [(cluster[i][2], i)] for i in range(n)}

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for level, i in sorted(((cluster[i][0], i) for i in range(1, n)), reverse=True):
        a, b = root(i - 1), root(i)
        if len(order[a]) < len(order[b]):
            a, b = b, a
        group[b] = a
        into = order[a]
        for left, j in order.pop(b):
            at = bisect.bisect(into, (left, j))
            into.insert(at, (left, j))
            for near in (at - 1, at + 1):
                if 0 <= near < len(into):
                    match = lcp(left, into[near][0], 0)
                    note(j, level, match)
                    note(into[near][1], level, match)
    return reach


def _sorted_runs(p: Repeats, parts: int):
    """Tasks that turn the wanted anchors of whole texts into sorted, front-coded runs, one for each part of the merge,
    and list the context that stands at each anchor. Equal contexts of a run are one entry."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            by_part: dict[int, list] = {}
            for context, (suffix, left, part, repeated) in found.items():
                by_part.setdefault(part, []).append((suffix, left, context, repeated))
            found.clear()
            for part, entries in by_part.items():
                entries.sort()
                yield row([part], [pack_run(entries)], [None], [None], [None])

        def row(*columns) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "run", "key", "pos", "context"])

        for batch in batches:
            wanted = batch.column("wanted")
            keys, positions, contexts = [], [], []
            for low, high, data, offsets in pieces(batch.column("text")):
                raw = data.tobytes()
                for i in range(low, high):
                    start, end = int(offsets[i - low]), int(offsets[i - low + 1])
                    key = batch.column("key")[i].as_py()
                    places = np.array(wanted[i].as_py(), np.int64) + start
                    hashes = common_hashes(data, places, p)
                    for at, h in zip(places.tolist(), hashes.tolist()):
                        suffix = raw[at : min(at + p.length, end)]
                        left = raw[max(start, at - p.left) : at][::-1]
                        context = hashlib.blake2b(len(suffix).to_bytes(4, "big") + suffix + left, digest_size=16).digest()
                        known = found.get(context)
                        if known is None:
                            found[context] = [suffix, left, h % parts, False]
                        else:
                            known[3] = True
                        keys.append(key)
                        positions.append(at - start)
                        contexts.append(context)
                    if len(found) >= p.run:
                        yield from flush()
            if keys:
                yield row([None] * len(keys), [None] * len(keys), keys, positions, contexts)
        yield from flush()

    return runs


def _merged(p: Repeats):
    """Tasks that merge the runs of a part and give each context its reach."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come sorted by part; the runs of one part are held, compressed until the merge reads them."""
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("run")):
                if part != now and blobs:
                    yield from merged(blobs)
                    blobs = []
                now = part
                blobs.append(blob.as_py())
        if blobs:
            yield from merged(blobs)

    def merged(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, int]] = []
        cluster: list[list] = []
        for shared, suffix, left, context, repeated in merge_runs([read_run(b) for b in blobs]):
            if cluster and shared < p.common:
                out += _reaches(cluster, p)
                cluster = []
            if cluster and cluster[-1][4] == context:
                cluster[-1][3] = True
            else:
                cluster.append([shared, suffix, left, repeated, context])
            if len(out) > 50_000:
                yield _reach_batch(out)
                out = []
        out += _reaches(cluster, p)
        yield _reach_batch(out)

    return merge


def _reaches(cluster: list[list], p: Repeats) -> list[tuple[bytes, int, int]]:
    if len(cluster) == 1 and not cluster[0][3]:
        return []
    found = cluster_reach([tuple(c[:4]) for c in cluster], p)
    return [(c[4], a, b) for c, (a, b) in zip(cluster, found) if a + b]


def _reach_batch(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    context, before, after = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(context, pa.binary()), pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["context", "before", "after"])


def _spans(docs: DataFrame, p: Repeats, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Spans of each text by digest, and the stored tables they are read from."""
    own = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    long = own.filter(F.length("text") >= p.length)
    listed = stored(long.mapInArrow(_list_anchors(p), "hash long, key binary, pos int"), "anchors")
    counts = listed.groupBy("hash").agg(F.count("*").alias("n"))
    again = stored(counts.filter("n > 1").select("hash"), "repeated")
    wanted = listed.join(sized(again, 16, p.broadcast), "hash", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("wanted"))
    wanted = stored(wanted.withColumnRenamed("key", "__key"), "wanted")
    discard(listed, again)
    size = wanted.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("wanted")), F.lit(0)).alias("anchors")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.anchors // p.part))
    chosen = long.join(F.broadcast(wanted) if 64 * size.texts + 4 * size.anchors <= p.broadcast else wanted, F.col("key") == F.col("__key"))
    schema = "part int, run binary, key binary, pos int, context binary"
    both = stored(chosen.select("key", "text", "wanted").mapInArrow(_sorted_runs(p, parts), schema), "runs")
    discard(wanted)
    runs = both.filter("part is not null").select("part", "run").repartition(parts, "part").sortWithinPartitions("part")
    reach = stored(runs.mapInArrow(_merged(p), "context binary, before int, after int"), "reach")
    places = both.filter("part is null").select("key", "pos", "context").distinct()
    covers = places.join(reach, "context").select("key", (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("after")).alias("last")).distinct()
    order = Window.partitionBy("key").orderBy("first", "last")
    seen = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))  # a span ends where none so far goes on
    covers = covers.withColumn("fresh", F.when(seen >= F.col("first"), 0).otherwise(1))
    covers = covers.withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = covers.groupBy("key", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans")), [both, reach]


def repeated_spans(docs: DataFrame, p: Repeats = Repeats(), text_col: str = "text") -> DataFrame:
    """(key, spans): for each text with repeated bytes, by digest, its maximal runs (first, last + 1) in order.

    A byte is repeated when a string of ``length`` bytes that covers it starts anywhere else as well, in any document or
    the same. Exact: strings are tied to anchors chosen by content, anchors whose following bytes occur once are left out
    by counting hashes, and the suffixes at the others are sorted in runs where they are read, exchanged front-coded, and
    merged by loser trees. Sorted suffixes with their left sides tell how far each repeated string reaches.

    Null texts are empty; an empty table gives an empty result. Copies of a text, and repeated rows, count as occurrences.
    The merge has as many parts as the counted suffixes take; a task holds the runs of one part. A hash with very many
    suffixes is spread over the runs of all tasks and equal contexts of a run are one entry, so a part receives each
    distinct context once a run. Intermediates are deleted when the spans are stored.
    """
    spans, tables = _spans(docs, p, text_col)
    spans = stored(spans, "spans")
    discard(*tables)
    return spans


def cut_repeats(docs: DataFrame, p: Repeats = Repeats(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (repeated runs; empty if none) and ``kept`` (the remaining bytes, concatenated).

    Columns of these names are replaced. Rows with equal texts, null ids or no text are all kept.
    """
    docs = docs.drop("spans", "kept")
    spans = repeated_spans(docs, p, text_col).withColumnRenamed("key", "__key")
    size = spans.agg(F.coalesce(F.sum(64 + 8 * F.size("spans")), F.lit(0)).alias("s")).first().s
    marked = docs.withColumn("__text", text_key(text_col)).join(F.broadcast(spans) if size <= p.broadcast else spans, F.col("__text") == F.col("__key"), "left")
    listed = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["last"]))
    ends = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.length("__raw")))
    pieces_ = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("__raw"), a + 1, b - a).cast("string"))  # bytes as they are
    kept = F.when(F.size("spans") > 0, F.array_join(pieces_, "").cast("binary")).otherwise(F.col("__raw"))
    return marked.withColumns({"spans": listed, "__raw": raw}).withColumn("kept", kept).drop("__text", "__key", "__raw")
