"""N-gram Jaccard join: candidates from a MinHash LSH forest, verified exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import sized, stored, text_key
from .components import components
from .textbatch import SEED, per_document, pieces, shingles, word_hashes


@dataclass(frozen=True)
class Forest:
    """``trees`` tries over ``depth`` MinHash values. Matched prefixes begin at full depth and are shortened until a pair of
    similarity ``threshold`` shares one in some tree with probability ``recall``. ``block`` documents or
    ``block_shingles`` shingles at most meet in one task when verified."""

    threshold: float = 0.8
    size: int = 5
    trees: int = 20
    depth: int = 6
    recall: float = 0.9999
    block: int = 512
    block_shingles: int = 1_000_000

    def shortened(self, joins: Mapping[tuple[int, int], int]) -> list[int]:
        """Matched prefix length of each tree; ``joins[tree, n]``: leaves that share just n levels with the leaf before.

        Shortening a tree's prefix to n joins these leaves to their neighbours, and lowers the chance that a pair at the
        threshold is missed in all trees. The tree with the fewest new joins for its gain goes a level up, until the chance
        is low enough; of equal ones the longest prefix.
        """
        lengths = [self.depth] * self.trees

        def miss(n: int) -> float:
            return 1 - self.threshold**n

        while math.prod(map(miss, lengths)) > 1 - self.recall:
            price = [
                (joins.get((tree, n - 1), 0) / math.log(miss(n) / miss(n - 1)), -n, tree)
                for tree, n in enumerate(lengths) if n > 1
            ]
            if not price:
                raise ValueError("no prefix reaches the recall; use more trees")
            lengths[min(price)[2]] -= 1
        return lengths


def _signatures(p: Forest):
    """Tasks that sketch whole texts: digest of the shingle set, its size, and the path in each tree, two bytes a level."""
    rng = np.random.default_rng(SEED + 2)
    factors = rng.integers(0, 2**31, p.trees * p.depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    masks = rng.integers(0, 2**32, p.trees * p.depth, dtype=np.uint32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                hashes, _, _, first = word_hashes(data, offsets)
                values, first = shingles(hashes, first, p.size)
                short = (values >> np.uint64(32)).astype(np.uint32)
                counts = np.diff(first)
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:])]
                paths = np.zeros((high - low, p.trees * p.depth), np.dtype(">u2"))
                for i in range(p.trees * p.depth):
                    least = per_document((short ^ masks[i]) * factors[i], first, np.minimum, 0)
                    paths[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("key"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in paths], pa.binary())],
                    ["doc_id", "key", "digest", "n_shingles", "paths"],
                )

    return sketch


def _walk(p: Forest):
    """Tasks that walk sorted leaves: for each that shares levels with the leaf before it, how many, and for every prefix
    length the first leaf of the run that shares such a prefix. The first and last leaf of a task come with their paths."""

    def rows(uid, tree, levels, heads, paths) -> pa.RecordBatch:
        n = len(uid)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p.depth, pa.int32()), pa.array(heads.ravel()))
        columns = [pa.array(uid, pa.int64()), pa.array(tree, pa.int32()), pa.array(levels, pa.int32()), lists, pa.array(paths, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["uid", "tree", "levels", "heads", "path"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # tree, path, uid and heads of the leaf before
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, uid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "uid"))
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), ">u2").reshape(-1, p.depth)
            shared = np.zeros((len(uid), p.depth), bool)
            shared[1:] = (path[1:] == path[:-1]) & (tree[1:] == tree[:-1])[:, None]
            if last is not None:
                shared[0] = (path[0] == last[1]) & (tree[0] == last[0])
            shared = np.logical_and.accumulate(shared, axis=1)
            begin = np.maximum.accumulate(np.where(shared, -1, np.arange(len(uid))[:, None]), axis=0)
            heads = uid[np.maximum(begin, 0)]
            if last is not None:
                heads = np.where(begin < 0, last[3][None, :], heads)
            else:
                yield rows(uid[:1], tree[:1], [0], heads[:1], [path[0].tobytes()])
            joined = shared[:, 0]
            if joined.any():
                yield rows(uid[joined], tree[joined], shared[joined].sum(axis=1), heads[joined], [None] * int(joined.sum()))
            last = tree[-1], path[-1], uid[-1], heads[-1]
        if last is not None:
            yield rows([last[2]], [last[0]], [0], last[3][None, :], [last[1].tobytes()])

    return walk


def trie_joins(leaves: DataFrame, p: Forest) -> DataFrame:
    """(uid, tree, levels, heads): every leaf (uid, tree, path) that shares the first ``levels`` > 0 levels with the leaf
    before it in the order of its tree; ``heads[n]`` is a leaf of the same tree with the same first n levels.

    Sorted paths are the trie: leaves with the same prefix stand together. The sort is by range, and by ``uid`` within
    equal paths, so that a prefix shared by very many leaves spans tasks; the ends of the tasks, two each, are walked again.
    """
    schema = "uid long, tree int, levels int, heads array<long>, path binary"
    order = ["tree", "path", "uid"]
    walked = stored(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk(p), schema), "tries")
    ends = walked.filter("levels = 0").select(*order).distinct().coalesce(1).sortWithinPartitions(*order)
    return walked.unionAll(ends.mapInArrow(_walk(p), schema)).filter("levels > 0").select("uid", "tree", "levels", "heads")


def candidate_edges(sets: DataFrame, p: Forest) -> DataFrame:
    """(a, b): each node (uid, paths) with the head of its run in every tree, at the prefix lengths that reach the recall."""
    width = 2 * p.depth
    tree = sets.select("uid", "paths", F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))).alias("tree"))
    leaves = tree.select("uid", "tree", F.substring(F.col("paths"), F.col("tree") * width + 1, F.lit(width)).alias("path"))
    joins = trie_joins(leaves, p)
    seen = joins.groupBy("tree", "levels").agg(F.count("*").alias("n")).collect()  # trees x depth rows at most
    lengths = p.shortened({(r["tree"], r["levels"]): r["n"] for r in seen})
    length = F.element_at(F.array(*map(F.lit, lengths)), F.col("tree") + 1)
    return joins.filter(F.col("levels") >= length).select(F.col("uid").alias("a"), F.element_at("heads", length).alias("b"))


def _shingle_sets(p: Forest):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                hashes, _, _, first = word_hashes(data, offsets)
                values, first = shingles(hashes, first, p.size)
                sets = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [own.column(c) for c in ("uid", "root", "n_docs", "chunk", "chunks", "bin")] + [pa.array(sets, pa.binary())],
                    ["uid", "root", "n_docs", "chunk", "chunks", "bin", "set"],
                )

    return make


def overlaps(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of hashes, by products of incidence blocks."""
    n = len(sets)
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[inverse][shared[inverse]]
    owner = owner[shared[inverse]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), np.float64)
    for start in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        block = np.zeros((n, columns), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        total += block @ block.T
    return total


def _verify(threshold: float):
    """Links of the documents of one block: exact Jaccard over all pairs that share a candidate component."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
        sizes = np.array([len(s) for s in sets], np.float64)
        both = overlaps(sets)
        linked = both / (sizes[:, None] + sizes[None, :] - both) >= threshold
        root, chunk = rows["root"].to_numpy(), rows["chunk"].to_numpy()
        linked &= root[:, None] == root[None, :]
        if chunk.min() != chunk.max() and rows["chunks"].max() > 1:
            linked &= chunk[:, None] != chunk[None, :]
        np.fill_diagonal(linked, False)
        label = np.arange(len(rows))
        while True:
            lower = np.minimum(label, np.where(linked, label[None, :], len(rows)).min(axis=1))
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        uid = rows["uid"].to_numpy()
        return pd.DataFrame({"uid": uid, "links": linked @ rows["n_docs"].to_numpy(), "label": uid[label]})

    return verify


def jaccard_classes(docs: DataFrame, p: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, class, class_id, class_key, n_links) of every document.

    Two documents are linked when the Jaccard similarity of their sets of ``size``-word shingles (words of letters and
    digits, A-Z as a-z; a shorter text is one shingle) is ``threshold`` or more. ``n_links`` counts a document's links,
    copies included; ``class`` joins what links connect, and (class_id, class_key) is its least (id, text digest).

    Documents with equal sets are one node, so groups of copies cost one row. Each tree's paths are sorted into a trie, in
    which leaves that share a matched prefix are linked to one of them; what links connect is a candidate component. All pairs of a component are then
    compared exactly: small components share blocks, large ones are cut into chunks, and each pair of chunks is a block
    of its own, from which only link counts and one label a document come back. Documents without words (null, empty)
    have no links and are classes of their own.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("key"))
    kinds = dict(own.dtypes)
    schema = f"doc_id {kinds['doc_id']}, key binary, digest binary, n_shingles long, paths binary"
    sketched = stored(own.mapInArrow(_signatures(p), schema), "sketches")
    sets = sketched.filter("n_shingles > 0").groupBy("digest").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "key")).alias("least"), F.min("key").alias("key"),
        F.min("n_shingles").alias("n_shingles"), F.min("paths").alias("paths"),
    )
    sets = stored(sets.withColumn("uid", F.monotonically_increasing_id()), "sets")

    members = stored(components(candidate_edges(sets, p)), "candidates").join(sets.select(F.col("uid").alias("id"), "key", "n_docs", "n_shingles"), "id")

    sums = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    load = F.greatest(F.col("n") / p.block, F.col("m") / p.block_shingles)
    sums = stored(sums.select("root", load.alias("load"), F.ceil(load).cast("int").alias("chunks")), "sums")
    total = sums.agg(F.coalesce(F.sum(F.when(F.col("chunks") == 1, F.col("load"))), F.lit(0.0)).alias("s"), F.coalesce(F.max("chunks"), F.lit(0)).alias("most")).first()
    bins = math.ceil(total.s * 1.5) + 1
    needed = members.join(sums, "root").select(
        F.col("id").alias("uid"), "root", "n_docs", F.col("key").alias("__key"), "chunks",
        F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("id"), F.col("chunks"))).otherwise(0).cast("int").alias("chunk"),
        F.pmod(F.xxhash64("root"), F.lit(bins)).cast("int").alias("bin"),
    )
    needed = sized(stored(needed, "needed"), 128)
    texts = own.join(needed, F.col("key") == F.col("__key")).groupBy("uid", "root", "n_docs", "chunk", "chunks", "bin").agg(F.first("text").alias("text"))
    made = texts.mapInArrow(_shingle_sets(p), "uid long, root long, n_docs long, chunk int, chunks int, bin int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    made = made.withColumn("other", other)
    alone = F.col("chunks") == 1
    blocks = made.groupBy(
        F.when(alone, F.col("bin").cast("long")).otherwise(F.col("root")).alias("g"), alone.alias("s"),
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
    )
    verified = stored(blocks.applyInPandas(_verify(p.threshold), "uid long, links long, label long"), "verified")

    links = verified.groupBy("uid").agg(F.sum("links").alias("links"))
    joined = verified.filter("uid <> label").select(F.col("uid").alias("a"), F.col("label").alias("b"))
    if total.most > 1:
        label = components(joined).select(F.col("id").alias("uid"), F.col("root").alias("class"))
    else:
        label = joined.select(F.col("a").alias("uid"), F.col("b").alias("class"))
    classed = sets.join(links, "uid", "left").join(label, "uid", "left").withColumn("class", F.coalesce("class", "uid"))
    least = classed.groupBy("class").agg(F.min("least").alias("first"))
    classed = classed.join(least, "class").select(
        "digest", "class", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("class_key"),
        (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
    )
    classed = stored(classed, "classes")
    worded = sketched.select("doc_id", "key", "digest").join(classed, "digest", "left")
    wordless = F.col("digest").isNull()
    return worded.select(
        "doc_id", "key", "class", F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(wordless, F.col("key")).otherwise(F.col("class_key")).alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, p: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one document of each class: the one with the least (id, text digest), and of equal rows any one.

    Documents without words are all kept, but equal rows (id and text) once. All columns come back, whatever their names.
    """
    classes = stored(jaccard_classes(docs, p, id_col, text_col), "labelled")
    pairs = classes.groupBy("doc_id", "key").agg(
        F.count("*").alias("n"), F.min(F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("class_key") == F.col("key"))).alias("keep")
    )
    odd = stored(pairs.filter("not keep or n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("keep").alias("__keep")), "odd")
    marked = docs.withColumn("__text", text_key(text_col)).join(
        sized(odd, 64), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left"
    )
    plain = marked.filter("__keep is null").select(docs.columns)
    repeated = marked.filter("__keep").dropDuplicates(["__id", "__key"]).select(docs.columns)
    return plain.unionByName(repeated)
