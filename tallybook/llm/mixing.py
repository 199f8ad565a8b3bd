"""Mixing to target weights: soft domain membership and nonnegative document rates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .textbatch import IS_WORD, LOWER, pieces, spans


@dataclass(frozen=True)
class Mix:
    """``buckets`` hashed byte trigrams; a text counts as at most ``evidence`` of them, which keeps membership soft.
    ``steps``: most gradient steps, which end at a largest relative error of ``tolerance``."""

    buckets: int = 8192
    evidence: float = 4.0
    steps: int = 40
    tolerance: float = 1e-6


@dataclass(frozen=True)
class DomainModel:
    """``scores[b, k]``: log chance of trigram bucket b in domain k; ``prior[k]``: log share of labelled documents."""

    domains: tuple[str, ...]
    scores: np.ndarray
    prior: np.ndarray
    evidence: float


def _buckets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first) of the byte trigrams of each document, A-Z as a-z."""
    low = LOWER[data].astype(np.uint32)
    grams = low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16)) if len(low) > 2 else low[:0]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(grams)]
    inside = np.arange(len(grams)) + 3 <= offsets[1:][doc]
    bucket = ((grams[inside] * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(n)
    return bucket.astype(np.int64), np.searchsorted(doc[inside], np.arange(len(offsets)))


def learn_domains(labelled: DataFrame, domains: tuple[str, ...], p: Mix = Mix()) -> DomainModel:
    """Multinomial model of the domains from all rows (text, domain) given; other domains are left out.

    Every task sums its trigram counts; one row a bucket and domain comes back.
    """
    known = labelled.filter(F.col("domain").isin(*domains)).select(F.coalesce("text", F.lit("")).alias("text"), "domain")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((len(domains), p.buckets + 1)), False
        for batch in batches:
            label = np.array([domains.index(d) for d in batch.column("domain").to_pylist()], np.int64)
            rows |= len(label) > 0
            total[:, p.buckets] += np.bincount(label, minlength=len(domains))
            for low, high, data, offsets in pieces(batch.column("text")):
                bucket, first = _buckets(data, offsets, p.buckets)
                owner = np.repeat(label[low:high], np.diff(first))
                total[:, : p.buckets] += np.bincount(owner * p.buckets + bucket, minlength=len(domains) * p.buckets).reshape(len(domains), -1)
        if rows:
            k, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], ["k", "b", "n"])

    counts = np.zeros((len(domains), p.buckets + 1))
    for r in known.mapInArrow(count, "k int, b int, n double").groupBy("k", "b").agg(F.sum("n").alias("n")).collect():
        counts[r.k, r.b] = r.n
    grams = counts[:, :-1] + 0.5
    docs = counts[:, -1] + 0.5
    return DomainModel(tuple(domains), np.log(grams / grams.sum(axis=1, keepdims=True)).T.copy(), np.log(docs / docs.sum()), p.evidence)


def posteriors(model: DomainModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Domain posterior of each document; one without trigrams has the prior."""
    bucket, first = _buckets(data, offsets, len(model.scores))
    n = np.diff(first)
    logs = np.zeros((len(n), len(model.domains)))
    full = n > 0
    for k in range(len(model.domains)):
        if full.any():
            logs[full, k] = np.add.reduceat(model.scores[bucket, k], first[:-1][full])
    logs *= (np.minimum(n, model.evidence) / np.maximum(n, 1))[:, None]
    logs += model.prior
    chance = np.exp(logs - logs.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def membership(model: DomainModel, text: Column) -> Column:
    """Struct of ``tokens`` (words of a whole text) and ``posterior`` (one number a domain); null counts as empty."""

    @F.arrow_udf("struct<tokens:double,posterior:array<double>>")
    def score(column: pa.Array) -> pa.Array:
        tokens, chance = [np.zeros(0)], [np.zeros((0, len(model.domains)))]
        for _, _, data, offsets in pieces(column):
            starts, _ = spans(IS_WORD[data], offsets)
            tokens.append(np.diff(np.searchsorted(starts, offsets)).astype(np.float64))
            chance.append(posteriors(model, data, offsets))
        flat = np.concatenate(chance)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(model.domains), pa.int32()), pa.array(flat.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), lists], ["tokens", "posterior"])

    return score(F.coalesce(text, F.lit("")))


def rate(posterior: Column, moves: list[list[float]]) -> Column:
    """Rate of a document after the given gradient moves: from 1, each move is taken and cut off at zero."""
    value = F.lit(1.0)
    for move in moves:
        value = F.greatest(F.lit(0.0), value - sum((F.element_at(posterior, k + 1) * F.lit(float(m)) for k, m in enumerate(move)), F.lit(0.0)))
    return value


def fit_rates(members: DataFrame, targets: Mapping[str, float], p: Mix = Mix()) -> list[list[float]]:
    """Gradient moves of the rates; ``members`` is a stored table (tokens, posterior), domains in the order of ``targets``.

    Minimises the squared error of expected domain token totals, sum of rate x tokens x posterior, against the target
    weights' shares of all tokens, over rates of at least zero. Steps are taken in the token-weighted norm and errors
    measured in the whitened one, in which the curvature is 1 and the step length 1 is safe. A step is one aggregation
    that returns one number a domain; a rate depends on its document's posterior and the moves alone, so no rate is kept
    between steps.
    """
    k = len(targets)
    part = [F.element_at("posterior", i + 1) for i in range(k)]
    sums = members.agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * part[i] * part[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    total = sums["tokens"] or 0.0
    if not total:
        return []
    curve = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(curve, rcond=1e-9, hermitian=True)
    share = np.array(list(targets.values()), np.float64)
    aim = share / share.sum() * total
    moves: list[list[float]] = []
    for _ in range(p.steps):
        weighted = F.col("tokens") * rate(F.col("posterior"), moves)
        got = members.agg(*[F.sum(weighted * part[i]).alias(f"t{i}") for i in range(k)]).first()
        error = np.array([got[f"t{i}"] for i in range(k)]) - aim
        if np.abs(error).max() <= p.tolerance * total:
            break
        moves.append((inverse @ error).tolist())
    return moves


def reached(members: DataFrame, targets: Mapping[str, float], moves: list[list[float]], p: Mix = Mix()) -> tuple[dict[str, float], bool]:
    """(share of all tokens that each domain is expected to have after the moves, whether all targets are met).

    Steps end at ``steps`` also where targets are far or at the edge of what the documents allow; this tells. No tokens
    give no shares and meet nothing.
    """
    weighted = F.col("tokens") * rate(F.col("posterior"), moves)
    got = members.agg(F.sum("tokens").alias("n"), *[F.sum(weighted * F.element_at("posterior", i + 1)).alias(f"t{i}") for i in range(len(targets))]).first()
    if not got["n"]:
        return {}, False
    whole = sum(targets.values())
    shares = {d: got[f"t{i}"] / got["n"] for i, d in enumerate(targets)}
    return shares, all(abs(shares[d] - t / whole) <= p.tolerance for d, t in targets.items())


def draw_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A document's number in the draw of copies, from its id and text."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))


def copies(rate_: Column, draw: Column) -> Column:
    """Whole number of copies with the expected value ``rate_``."""
    chance = F.pmod(draw, F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate_ + chance).cast("int")


def mixed_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], p: Mix = Mix(), keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DomainModel, list[list[float]]]:
    """(table, model, moves): ``keep``, tokens, posterior and rate of every document.

    Texts without words have no tokens and the rate of their posterior. Equal texts have equal rates.
    """
    model = learn_domains(labelled, tuple(targets), p)
    members = docs.select(*keep, membership(model, F.col("text")).alias("m")).select(*keep, "m.tokens", "m.posterior")
    members = stored(members, "members")
    moves = fit_rates(members, targets, p)
    return members.withColumn("rate", rate(F.col("posterior"), moves)), model, moves


def resample(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], p: Mix = Mix()) -> DataFrame:
    """``docs`` with every document repeated as its rate asks: each row's copies are drawn by its id and text."""
    _, model, moves = mixed_rates(docs, labelled, targets, p, keep=())
    n = copies(rate(membership(model, F.col("text"))["posterior"], moves), draw_of())
    return docs.withColumn("__copies", n).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).drop("__copies", "__copy")
