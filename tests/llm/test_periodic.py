"""Periodic runs of words against a plain search over all lags."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallybook.llm import periodic


def plain(words, least, times):
    """Every maximal stretch of every lag; equal stretches keep their smallest period."""
    n, found = len(words), {}
    for lag in range(1, n // times + 1):
        i = lag
        while i < n:
            if words[i] != words[i - lag]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - lag]:
                j += 1
            if j - i + lag >= max(least, times * lag):
                found.setdefault((i - lag, j - i + lag), lag)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def quick(texts, least, times):
    words = np.array([w for t in texts for w in t], np.int64)
    first = np.cumsum([0] + [len(t) for t in texts])
    runs = list(zip(*(x.tolist() for x in periodic.find_runs(words, first, periodic.Periods(least, times)))))
    return [sorted((s - a, n, q) for s, n, q in runs if a <= s < b) for a, b in zip(first[:-1], first[1:])]


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 6)), max_size=8)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=3), st.integers(1, 9), st.integers(3, 4))
def test_runs_are_those_of_a_plain_search(texts, least, times):
    texts = [[w for block, n in t for w in block * n] for t in texts]
    assert quick(texts, least, times) == [plain(t, least, times) for t in texts]


def test_long_periods_and_one_word_only():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 500, 700).tolist()
    text = rng.integers(0, 500, 90).tolist() + block * 3 + block[:11] + [900] + [7] * 400 + (block[:5] * 6 + [901]) * 4
    assert quick([text], 24, 3) == [plain(text, 24, 3)]
    many = [7] * 300_000
    assert quick([many], 24, 3) == [[(0, 300_000, 1)]]


def test_shorter_periods_than_three_are_refused():
    with pytest.raises(ValueError):
        periodic.Periods(times=2)


def test_texts_of_all_kinds(docs_of):
    """Null, empty, blank and long texts, other white space, repeated rows, clashing columns."""
    loop = "un deux trois " * 9
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, loop), (4, loop), (None, loop), (5, "a b c\x0bd  e f"), (6, "x " * 40_000 + "end"), (7, "A a " * 20)]
    docs = docs_of(rows)
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse_runs(docs.withColumn("runs", docs["keep"])).collect()]
    assert sorted(got, key=str) == sorted([
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 27, 3)], "un deux trois"), (4, [(0, 27, 3)], "un deux trois"), (None, [(0, 27, 3)], "un deux trois"),
        (5, [], "a b c d e f"), (6, [(0, 40_000, 1)], "x end"), (7, [(0, 40, 2)], "A a"),
    ], key=str)


def test_empty_table(docs_of):
    out = periodic.collapse_runs(docs_of([]))
    assert out.collect() == [] and {"runs", "collapsed", "doc_id", "score"} <= set(out.columns)


def test_a_word_of_two_runs_is_left_out_once(docs_of):
    """Two runs share words: what one run drops stays dropped, whatever the other keeps."""
    words = ["a", "b"] * 14 + ["a"] * 30
    (row,) = periodic.collapse_runs(docs_of([(1, " ".join(words))])).collect()
    runs = [tuple(x) for x in row["runs"]]
    assert runs == plain(words, 24, 3) and len(runs) == 2 and runs[1][0] < runs[0][0] + runs[0][1]
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    assert row["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in dropped)
