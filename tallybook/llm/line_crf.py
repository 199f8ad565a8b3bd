"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import draw
from .textbatch import IS_WORD, pieces, span_hashes, spans

OWN = 19  # features of a line by itself


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit: ``per_class`` documents of each label of at most ``most_lines`` lines are drawn."""

    per_class: int = 4000
    most_lines: int = 2000
    steps: int = 200
    rate: float = 0.05
    ridge: float = 1e-3


@dataclass(frozen=True)
class LineModel:
    """``weights``: log odds of a good line for standardised features of a line and its neighbours, bias last.
    ``moves[i][j]``: score of line state j (1 good) after i."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray


def _byte_class(members) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(members)] = 1
    return table


UPPER = _byte_class(range(65, 91))
LETTER = _byte_class([*range(65, 91), *range(97, 123), *range(192, 256)])
DIGIT = _byte_class(range(48, 58))
SPACE = _byte_class(b" \t\r\v\f")
SENTENCE = _byte_class(b".,;:?!'\"()-")
SYMBOL = _byte_class(b"#$%&*+/<=>@[\\]^_`{|}~")
START = _byte_class([*range(128), *range(192, 256)])  # bytes that begin a character


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, first): OWN features and the length of every line, and each document's first line (one more at
    the end). A text without a line break, the empty one too, is one line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    doc = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1]))
    first = np.searchsorted(doc, np.arange(len(offsets)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    ends[-1] = len(data)
    same = np.zeros(len(doc), bool)
    same[:-1] = doc[1:] == doc[:-1]
    ends[same] -= 1
    n = len(starts)

    def per_line(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[ends] - sums[starts]

    size = (ends - starts).astype(np.float64)
    total = np.maximum(size, 1)
    upper = UPPER[data]
    accented = np.zeros(len(data), np.float32)  # capital letters of the Latin-1 block, two bytes each
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    counts = [per_line(x) for x in (upper + accented, LETTER[data], DIGIT[data], SPACE[data], SENTENCE[data], SYMBOL[data], START[data], (data == 124), (data == 33))]
    up, letters, digits, spaces, sentence, symbols, chars, bars, bangs = counts
    word_start, word_end = spans(IS_WORD[data], offsets)
    line = np.searchsorted(starts, word_start, side="right") - 1
    words = np.bincount(line, minlength=n).astype(np.float64)
    hashes = span_hashes(data, word_start, word_end)
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    stutter = np.bincount(line[follows], minlength=n)
    order = np.lexsort((hashes, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    kinds = np.bincount(line[order][fresh], minlength=n)
    short = np.bincount(line[(word_end - word_start) <= 3], minlength=n)
    some = np.maximum(words, 1)
    whole = span_hashes(data, starts, ends)
    order = np.lexsort((whole, doc))
    again = np.zeros(n, bool)
    equal = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    begin = np.where(size > 0, data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else 0, 0)
    out = np.stack([
        np.log1p(size), np.log1p(words), up / np.maximum(letters, 1), letters / total, digits / total, spaces / total, sentence / total,
        symbols / total, bars / some, bangs / some, (sentence + symbols) / some, chars / total, letters / some / 10, stutter / some,
        kinds / some, short / some, again.astype(np.float64), np.isin(last, (46, 33, 63)).astype(np.float64), (UPPER[begin] > 0).astype(np.float64),
    ], axis=1)
    return np.where(size[:, None] > 0, out, 0).astype(np.float32), size + 1, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of a line, of the lines before and after it (zero at the ends of a document), two end marks and a bias."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    opens[first[:-1]] = closes[first[1:] - 1] = True
    before[opens], after[closes] = 0, 0
    return np.concatenate([x, before, after, opens[:, None], closes[:, None], np.ones((n, 1))], axis=1)


def messages(odds: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of every line; documents are walked side by side, longest first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    forward, backward = np.empty(len(odds)), np.zeros(len(odds))
    alive = [int(np.searchsorted(-counts, -t, side="left")) for t in range(int(counts[0]))] if len(counts) else []
    for t, n in enumerate(alive):  # the first n documents have more than t lines
        at = begin[:n] + t
        forward[at] = odds[at]
        if t:
            f = forward[at - 1]
            forward[at] += np.logaddexp(f + moves[1, 1], moves[0, 1]) - np.logaddexp(f + moves[1, 0], moves[0, 0])
    for t in range(len(alive) - 1, 0, -1):
        at = begin[: alive[t]] + t
        b = backward[at] + odds[at]
        backward[at - 1] = np.logaddexp(b + moves[1, 1], moves[1, 0]) - np.logaddexp(b + moves[0, 1], moves[0, 0])
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(features: list[np.ndarray], good: list[int], weight: list[float], p: Fit) -> LineModel:
    """Weights that make each document's label likeliest on all its lines, by gradient steps on the chain likelihood."""
    if not features:
        return LineModel(np.zeros(OWN), np.ones(OWN), np.zeros(3 * OWN + 3), np.zeros((2, 2)))
    rows = np.concatenate(features).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    lines = np.diff(first)
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3)
    x = with_neighbours((rows - mean) / scale, first)
    y = np.repeat(np.array(good, np.float64), lines)
    w = np.repeat(np.array(weight) / lines, lines)  # each document counts once, whatever its length
    w /= w.sum()
    opens = np.zeros(len(y), bool)
    opens[first[:-1]] = True
    inner = np.flatnonzero(~opens)
    seen = np.array([[(w[inner] * (1 - y[inner])).sum(), 0.0], [0.0, (w[inner] * y[inner]).sum()]])
    theta, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    speed, moment = [np.zeros_like(theta), np.zeros_like(moves)], [np.zeros_like(theta), np.zeros_like(moves)]
    for step in range(1, p.steps + 1):
        odds = x @ theta
        forward, backward = messages(odds, first, moves)
        slope = x.T @ (w * (y - sigmoid(forward + backward))) - p.ridge * theta
        at_start, at_end = forward[inner - 1], odds[inner] + backward[inner]
        scores = np.stack([np.full(len(inner), moves[0, 0]), at_end + moves[0, 1], at_start + moves[1, 0], at_start + at_end + moves[1, 1]])
        scores = np.exp(scores - scores.max(axis=0)) if len(inner) else scores
        expected = (scores / scores.sum(axis=0) * w[inner]).sum(axis=1).reshape(2, 2) if len(inner) else np.zeros((2, 2))
        for value, grad, m, v in zip((theta, moves), (slope, seen - expected - p.ridge * moves), moment, speed):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineModel(mean, scale, theta, moves)


def document_scores(model: LineModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted mean over a document's lines of the marginal probability of good."""
    own, size, first = line_features(data, offsets)
    odds = with_neighbours((own - model.mean) / model.scale, first) @ model.weights
    forward, backward = messages(odds, first, model.moves)
    good = sigmoid(forward + backward)
    return np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1])


def train(docs: DataFrame, labels: DataFrame, p: Fit = Fit()) -> LineModel:
    """Fit on a bounded sample of the labelled documents that are not held out; only texts enter the features."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                own, _, first = line_features(data, offsets)
                rows = [own[a:b].tobytes() if b - a <= p.most_lines else None for a, b in zip(first[:-1], first[1:])]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column("label"), part.column("doc_id").cast(pa.string())], ["lines", "label", "id"])

    drawn, weights = draw(docs, labels, "quality", p.per_class)
    drawn = drawn.withColumn("label", F.col("label").cast("int"))
    rows = drawn.mapInArrow(blobs, "lines binary, label int, id string").filter("lines is not null").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["lines"])))
    features = [np.frombuffer(r["lines"], np.float32).reshape(-1, OWN) for r in rows]
    return fit(features, [r["label"] for r in rows], [weights[r["label"]] for r in rows], p)


def quality(model: LineModel, text: Column) -> Column:
    """Score 0 to 1 of whole texts, higher for good; null counts as empty, which is one empty line."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([document_scores(model, data, offsets) for _, _, data, offsets in pieces(column)] or [np.zeros(0)]))

    return score(F.coalesce(text, F.lit("")))
