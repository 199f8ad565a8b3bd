"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import draw
from .line_crf import sigmoid
from .textbatch import pieces, span_hashes, word_hashes


@dataclass(frozen=True)
class Fit:
    """``per_class`` documents of each label with at most ``most_features`` features are drawn. A feature gets a weight
    if ``support`` of them hold it, its likelihood ratio statistic between clean and toxic ones reaches ``evidence``, and
    it is among the ``kept`` strongest."""

    per_class: int = 4000
    most_features: int = 100_000
    bits: int = 20
    stems: tuple[int, ...] = (4, 6)
    support: int = 5
    evidence: float = 20.0
    kept: int = 1024
    steps: int = 25
    ridge: float = 0.1


@dataclass(frozen=True)
class SeverityModel:
    """P(grade <= j) = sigmoid(cuts[j] - sum of the weights of a text's features): the weights are shared by all cuts."""

    features: np.ndarray  # sorted
    weights: np.ndarray
    cuts: np.ndarray
    bits: int
    stems: tuple[int, ...]


def text_features(data: np.ndarray, offsets: np.ndarray, bits: int, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first): distinct hashed words and word beginnings of each document, and each one's first (one more at the end)."""
    hashes, starts, ends, first = word_hashes(data, offsets)
    shift = np.uint64(64 - bits)
    kinds = [hashes] + [span_hashes(data, starts, np.minimum(starts + n, ends)) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1)) for n in stems]
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(first)).astype(np.uint64)
    both = np.unique(np.concatenate([(docs << np.uint64(32)) | (k >> shift) for k in kinds]))
    doc = (both >> np.uint64(32)).astype(np.int64)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(doc, np.arange(len(offsets)))


def grades(rows: list[np.ndarray], toxic: np.ndarray, support: int) -> np.ndarray:
    """Severity of labelled documents: 0 clean; toxic ones 1, or 2 where the number of telling features is over the median.

    A feature is telling when ``support`` toxic documents hold it, and nine in ten of the documents that do are toxic.
    """
    grade = toxic.astype(np.int64)
    if not toxic.any():
        return grade
    values, counts = np.unique(np.concatenate(rows), return_counts=True)
    bad, bad_counts = np.unique(np.concatenate([r for r, t in zip(rows, toxic) if t]), return_counts=True)
    whole = counts[np.searchsorted(values, bad)]
    telling = bad[(bad_counts >= support) & (bad_counts >= 0.9 * whole)]
    held = np.array([np.isin(r, telling).sum() for r in rows])
    grade[toxic & (held > np.median(held[toxic]))] = 2
    return grade


def telling_features(rows: list[np.ndarray], toxic: np.ndarray, p: Fit) -> np.ndarray:
    """Features, in order, whose presence differs between toxic and clean documents beyond chance; equal rows count once."""
    if not rows:
        return np.zeros(0, np.uint32)
    one = list({r.tobytes(): i for i, r in enumerate(rows)}.values())
    values, inverse = np.unique(np.concatenate([rows[i] for i in one]), return_inverse=True)
    owner = np.repeat(np.arange(len(one)), [len(rows[i]) for i in one])
    label = toxic[one]
    bad = np.bincount(inverse, label[owner], minlength=len(values))
    good = np.bincount(inverse, ~label[owner], minlength=len(values))
    share = label.mean()
    ratio = np.zeros(len(values))
    for count, expected in ((bad, (bad + good) * share), (good, (bad + good) * (1 - share))):
        some = count > 0
        ratio[some] += 2 * count[some] * np.log(count[some] / expected[some])
    ratio[(bad + good < p.support) | (ratio < p.evidence)] = 0
    best = np.lexsort((values, -ratio))[: p.kept]
    return np.sort(values[best[ratio[best] > 0]])


def grade_chances(z: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of each grade, density of each cut) at the scores ``z``."""
    below = sigmoid(cuts[None, :] - z[:, None])
    chance = np.diff(np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1), axis=1)
    return np.maximum(chance, 1e-9), below * (1 - below)


def fit(rows: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, p: Fit) -> SeverityModel:
    """Fisher scoring of the ridge-penalised cumulative-link likelihood in the shared weights and both cuts."""
    kept = telling_features(rows, grade > 0, p)
    if not len(kept):
        return SeverityModel(kept, np.zeros(0), np.array([3.0, 6.0]), p.bits, p.stems)
    x = np.zeros((len(rows), len(kept)))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(kept, r[np.isin(r, kept)])] = 1
    share = np.array([weight[grade <= j].sum() for j in (0, 1)]) / weight.sum()
    share = np.clip(share + np.array([0.0, 1e-3]), 1e-3, 1 - np.array([2e-3, 1e-3]))
    cuts, theta = np.log(share / (1 - share)), np.zeros(len(kept))
    own = np.arange(len(rows))

    def worth(theta: np.ndarray, cuts: np.ndarray) -> float:
        if cuts[1] <= cuts[0]:
            return -np.inf
        return float((weight * np.log(grade_chances(x @ theta, cuts)[0][own, grade])).sum() - p.ridge / 2 * (theta @ theta))

    now = worth(theta, cuts)
    for _ in range(p.steps):
        chance, u = grade_chances(x @ theta, cuts)
        zero = np.zeros(len(rows))
        by_z = np.stack([-u[:, 0], u[:, 0] - u[:, 1], u[:, 1]], axis=1)  # change of each grade's chance with the score
        by_cut = [np.stack([u[:, 0], -u[:, 0], zero], axis=1), np.stack([zero, u[:, 1], -u[:, 1]], axis=1)]
        slopes = [weight * d[own, grade] / chance[own, grade] for d in (by_z, *by_cut)]
        score = np.concatenate([x.T @ slopes[0] - p.ridge * theta, [slopes[1].sum(), slopes[2].sum()]])
        cross = [[(weight[:, None] * a * b / chance).sum(axis=1) for b in (by_z, *by_cut)] for a in (by_z, *by_cut)]
        n = len(kept)
        info = np.zeros((n + 2, n + 2))
        info[:n, :n] = x.T @ (x * cross[0][0][:, None]) + p.ridge * np.eye(n)
        for j in (0, 1):
            info[:n, n + j] = info[n + j, :n] = x.T @ cross[0][j + 1]
            info[n, n + j] = info[n + j, n] = cross[1][j + 1].sum()
        info[n + 1, n + 1] = cross[2][2].sum()
        move = np.linalg.solve(info + 1e-6 * np.eye(n + 2), score)
        size = 1.0
        while size > 1e-4 and not (better := worth(theta + size * move[:n], cuts + size * move[n:])) > now:
            size /= 2
        if size <= 1e-4 or better - now < 1e-6 * abs(now):
            break
        theta, cuts, now = theta + size * move[:n], cuts + size * move[n:], better
    return SeverityModel(kept, theta, cuts, p.bits, p.stems)


def train(docs: DataFrame, labels: DataFrame, p: Fit = Fit()) -> SeverityModel:
    """Fit on a bounded sample of the labelled documents that are not held out."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                found, first = text_features(data, offsets, p.bits, p.stems)
                rows = [found[a:b].tobytes() if b - a <= p.most_features else None for a, b in zip(first[:-1], first[1:])]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column("label"), part.column("doc_id").cast(pa.string())], ["found", "label", "id"])

    drawn, weights = draw(docs, labels, "toxic", p.per_class)
    drawn = drawn.withColumn("label", F.col("label").cast("int"))
    rows = drawn.mapInArrow(blobs, "found binary, label int, id string").filter("found is not null").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["found"])))
    found = [np.frombuffer(r["found"], np.uint32) for r in rows]
    toxic = np.array([r["label"] == 1 for r in rows], bool)
    weight = np.array([weights[r["label"]] for r in rows], np.float64)
    return fit(found, grades(found, toxic, p.support), weight, p)


def chances(model: SeverityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each grade of each document."""
    found, first = text_features(data, offsets, model.bits, model.stems)
    z = np.zeros(len(offsets) - 1)
    if len(model.features):
        at = np.minimum(np.searchsorted(model.features, found), len(model.features) - 1)
        value = np.where(model.features[at] == found, model.weights[at], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(value)])
        z = sums[first[1:]] - sums[first[:-1]]
    chance = grade_chances(z, model.cuts)[0]
    return chance / chance.sum(axis=1, keepdims=True)


def severity(model: SeverityModel, text: Column) -> Column:
    """Struct of ``severity`` (expected grade, 0 to 2), ``grade`` (likeliest) and ``toxic`` (1 if a grade over 0 is likelier
    than not) of whole texts; null counts as empty, which has no features."""

    @F.arrow_udf("struct<severity:double,grade:int,toxic:int>")
    def score(column: pa.Array) -> pa.Array:
        p = np.concatenate([chances(model, data, offsets) for _, _, data, offsets in pieces(column)] or [np.zeros((0, 3))])
        return pa.StructArray.from_arrays(
            [pa.array(np.clip(p @ np.arange(3.0), 0, 2)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array((p[:, 0] < 0.5).astype(np.int32))],
            ["severity", "grade", "toxic"],
        )

    return score(F.coalesce(text, F.lit("")))
