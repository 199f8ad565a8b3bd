"""Periodic runs of words: stretches in which the same words come again and again at a fixed distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbatch import pieces, spans

IS_SPACE = np.zeros(256, dtype=bool)  # space, tab, line feed, vertical tab, form feed, carriage return
IS_SPACE[32] = IS_SPACE[9:14] = True
RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


@dataclass(frozen=True)
class Periods:
    """A run has ``least`` words or more and repeats its period ``times`` times or more (3 at least)."""

    least: int = 24
    times: int = 3

    def __post_init__(self):
        if self.times < 3 or self.least < 1:
            raise ValueError("a run must repeat its period three times or more, and hold a word")


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end) of every word, equal words having equal numbers, and for each text the index of its first
    word (one more at the end)."""
    inside = ~IS_SPACE[data]
    starts, ends = spans(inside, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, starts, ends, np.searchsorted(starts, offsets)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key, number of equal keys of each)."""
    _, rank, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, counts[rank]


def _stretches(words: np.ndarray, first: np.ndarray, p: Periods) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, stretch, word rank in the stretch) of the words that may lie in a run.

    Every word of a run occurs ``times`` times in it. So words that occur less often part a text, and stretches shorter
    than ``least`` go; what is left is parted again, as long as that removes a tenth of the words.
    """
    at = np.arange(len(words))
    part = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kind = words
    while len(at):
        rank, counts = _dense(part * (kind.max() + 1) + kind)
        often = counts >= p.times
        held, was, kind = at[often], part[often], rank[often]
        fresh = np.ones(len(held), bool)
        fresh[1:] = (np.diff(held) > 1) | (was[1:] != was[:-1])
        stretch = np.cumsum(fresh) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= p.least
        before = len(at)
        at, part, kind = held[long], stretch[long], kind[long]
        if len(at) > 0.9 * before:
            break
    if len(at):
        kind, _ = _dense(part * (kind.max() + 1) + kind)
    return at, part, kind


def find_runs(words: np.ndarray, first: np.ndarray, p: Periods = Periods()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of several texts at once, starts being indices into ``words``.

    A sparse table of diagonals: a word that matches the one ``lag`` words before lengthens the match on that diagonal,
    and a diagonal that ends after a long enough match is a run. Of the earlier occurrences of a word only those are
    followed that a run can use. At scale g = 1, 2, 4, ... the last earlier occurrence of the g words from here on is
    looked up; only lags over g / 2 and up to g belong to that scale. In a run whose smallest period q lies there, the g
    words come again after exactly q words and no sooner, so its diagonal grows word by word; a multiple of the smallest
    period never does. Hence one step a word and scale, also in a text of one word only, and every run once with its
    smallest period. The diagonals of all texts advance together.
    """
    at, part, rank = _stretches(words, first, p)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    g, before = 1, np.arange(len(at))  # places whose g words are worth a look, rank of those g words
    rank = rank.astype(np.int64)
    while len(before):
        order = np.argsort(rank, kind="stable")
        place, key = before[order], rank[order]
        same = key[1:] == key[:-1]
        lag = np.zeros(len(at), np.int64)
        lag[place[1:][same]] = (place[1:] - place[:-1])[same]
        hit = np.flatnonzero((lag > g // 2) & (lag <= g))
        if len(hit):
            fresh = np.ones(len(hit), bool)
            fresh[1:] = (np.diff(hit) > 1) | (lag[hit[1:]] != lag[hit[:-1]])
            begin = np.flatnonzero(fresh)
            match = np.diff(np.append(begin, len(hit))) + g - 1
            period = lag[hit[begin]]
            good = match >= np.maximum(p.least - period, (p.times - 1) * period)
            found.append((at[hit[begin]][good] - period[good], (match + period)[good], period[good]))
        # the next scale: twice as many words, of which both halves occur more than once
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        numbers = np.cumsum(np.append(True, ~same)) - 1
        wide = np.full(len(at) + g, -1, np.int64)
        wide[place[again]] = numbers[again]
        room = np.bincount(part, minlength=1)[part] >= p.times * (g + 1)
        both = np.flatnonzero((wide[: len(at)] >= 0) & (wide[g : g + len(at)] >= 0) & room)
        both = both[part[np.minimum(both + g, len(at) - 1)] == part[both]]
        rank = wide[both] * len(at) + wide[both + g]
        before, g = both, 2 * g
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _texts(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)])


def _of_piece(data: np.ndarray, offsets: np.ndarray, p: Periods) -> pa.Array:
    """Runs and collapsed text of each text of a piece."""
    words, starts, ends, first = word_numbers(data, offsets)
    start, length, period = find_runs(words, first, p)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    # a kept word is followed by one space unless it is the last one kept of its text
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    chosen = np.flatnonzero(kept)
    followed = chosen[:-1][doc[chosen[1:]] == doc[chosen[:-1]]]
    taken = np.zeros(len(data), bool)
    taken[~IS_SPACE[data]] = np.repeat(kept, ends - starts)
    written = data.copy()
    written[ends[followed]], taken[ends[followed]] = 32, True
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(taken, out=bounds[1:])
    of = np.searchsorted(first, start, side="right") - 1
    listed = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(first))).astype(np.int32)), listed)
    return pa.StructArray.from_arrays([runs, _texts(written[taken], bounds[offsets]).cast(pa.string())], ["runs", "collapsed"])


def collapse_runs(docs: DataFrame, p: Periods = Periods(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; in words, by start and period) and ``collapsed``: the text without
    the words that repeat the period before them, its words joined by one space.

    A run is a stretch of words with smallest period q (words q apart are identical) of at least ``least`` words and
    ``times`` periods that no neighbouring word extends. Words are what stands between ASCII white space. A word is left
    out if any run holds it after the run's first q words.

    Null and empty texts have no runs and an empty collapsed text; columns of the two names are replaced; rows, repeated
    ones too, are judged one by one and all kept. A text is read whole in one task, in time that grows with its words times
    the logarithm of their number, however often it repeats itself; nothing is shuffled.
    """

    @F.arrow_udf(RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        done = [_of_piece(data, offsets, p) for _, _, data, offsets in pieces(texts)]
        return pa.concat_arrays(done) if done else pa.array([], _RESULT_TYPE)

    kept = docs.drop("runs", "collapsed")
    return kept.withColumn("__found", judged(F.coalesce(F.col(text_col), F.lit("")))).select(*kept.columns, "__found.runs", "__found.collapsed")


_RESULT_TYPE = pa.struct([
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])
