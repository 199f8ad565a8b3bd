"""Secrets in texts: named patterns, and strings that a battery of randomness tests tells from ordinary ones."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .textbatch import LOWER, pieces, spans

RANDOM = "random"


@dataclass(frozen=True)
class Pattern:
    """Matches of ``regex`` (over bytes, leftmost, not overlapping) whose ``group`` has ``least`` characters or more.

    A text is searched only if it holds one of ``hints`` (lower case, letters of a text taken in lower case; empty: any)
    and ``solid`` characters of strings in a row; these must follow from the pattern.
    """

    kind: str
    regex: re.Pattern
    group: int = 0
    least: int = 1
    hints: tuple[bytes, ...] = ()
    solid: int = 0


@dataclass(frozen=True)
class Encoding:
    name: str
    symbols: str


def _span(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


DIGITS, SMALL, LARGE = _span("0", "9"), _span("a", "z"), _span("A", "Z")

# From the narrowest on: a string has the first encoding that holds all its characters. Digits alone are numbers.
ENCODINGS = (
    Encoding("hex", DIGITS + "abcdef"), Encoding("hex upper", DIGITS + "ABCDEF"), Encoding("small", SMALL), Encoding("large", LARGE),
    Encoding("base32", LARGE + "234567"), Encoding("base36", DIGITS + SMALL), Encoding("base36 upper", DIGITS + LARGE),
    Encoding("base62", DIGITS + LARGE + SMALL), Encoding("base64", LARGE + SMALL + DIGITS + "+/"), Encoding("base64 url", LARGE + SMALL + DIGITS + "-_"),
)
SYMBOLS = DIGITS + LARGE + SMALL + "+/-_"
CODE = np.full(256, -1, np.int64)
CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
PLACES = np.full((len(ENCODINGS), 256), -1, np.int64)  # value of a byte in each encoding
for _i, _e in enumerate(ENCODINGS):
    PLACES[_i, np.frombuffer(_e.symbols.encode(), np.uint8)] = np.arange(len(_e.symbols))


@dataclass(frozen=True)
class Battery:
    """Strings of ``least`` characters or more are tested. One whose combined p-value is under ``alpha`` is not random; of
    those reported at any length a share ``rate`` at most is expected to be ordinary."""

    least: int = 20
    alpha: float = 0.01
    rate: float = 0.01


# Tests --------------------------------------------------------------------------------------------------------------


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(values: np.ndarray, k: int) -> float:
    """Chi-squared test of ``k`` equally likely symbols, to both sides. Few symbols a cell are met by the exact mean and
    variance of the statistic; the cube root of a gamma variable with those is nearly normal."""
    n = len(values)
    counts = np.bincount(values, minlength=k)
    x = k / n * float((counts * counts).sum()) - n
    mean, variance = k - 1.0, 2.0 * (k - 1) * (n - 1) / n
    shape = 2 * mean * mean / variance
    z = ((max(x, 0.0) / mean) ** (1 / 3) - (1 - 2 / (9 * shape))) / math.sqrt(2 / (9 * shape))
    return two_sided(z)


def runs(values: np.ndarray, k: int) -> float:
    """Wald-Wolfowitz test: number of runs of values in the lower and upper half of the alphabet, given how many are in each."""
    high = values >= k / 2
    n, a = len(values), int(high.sum())
    if a in (0, n):
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * (n - a) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    met = 1 + int((high[1:] != high[:-1]).sum())
    return two_sided((met - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial(values: np.ndarray) -> float:
    """Correlation of each value with the next one."""
    n, x = len(values), values - values.mean()
    total = float((x * x).sum())
    if total == 0:
        return 2.0 ** (1 - n)
    return two_sided((float((x[1:] * x[:-1]).sum()) / total + 1 / n) * math.sqrt(n))


def randomness(values: np.ndarray, k: int) -> float:
    """Combined p-value of the battery; the tests may depend on each other, so the least one counts threefold."""
    return min(1.0, 3 * min(uniformity(values, k), runs(values, k), serial(values)))


def infer(raw: np.ndarray) -> int:
    """The number of the narrowest encoding of a string; -1 without any, or for digits alone."""
    if ((raw >= 48) & (raw <= 57)).all():
        return -1
    fits = (PLACES[:, raw] >= 0).all(axis=1)
    return int(fits.argmax()) if fits.any() else -1


# Scan ---------------------------------------------------------------------------------------------------------------


def _candidates(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, encoding) of strings: runs of string characters, or, where no encoding holds all of one, its parts of
    letters and digits."""
    for a, b in zip(starts.tolist(), ends.tolist()):
        encoding = infer(raw[a:b])
        if encoding >= 0:
            yield a, b, encoding
            continue
        plain = CODE[raw[a:b]] < 62
        edges = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8)))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if high - low >= least and (encoding := infer(raw[a + low : a + high])) >= 0:
                yield a + low, a + high, encoding


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("place", pa.int32()), ("kind", pa.string())])
_TESTED = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string()), ("encoding", pa.int32()), ("p", pa.float64())])
_SCAN = pa.struct([("base", pa.list_(_SPAN)), ("tested", pa.list_(_TESTED)), ("symbols", pa.list_(pa.int64()))])
_SCAN_SQL = ("struct<base:array<struct<start:bigint,end:bigint,place:int,kind:string>>,"
             "tested:array<struct<start:bigint,end:bigint,token:string,encoding:int,p:double>>,symbols:array<bigint>>")


def _scan_piece(data: np.ndarray, offsets: np.ndarray, patterns: Sequence[Pattern], p: Battery) -> list[dict]:
    """What is found in each text of a piece; its first text carries the symbol counts of all."""
    raw, low = data.tobytes(), LOWER[data].tobytes()
    letters = np.zeros(len(data) + 1, np.int64)  # characters before each byte
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    codes = CODE[data]
    starts, ends = spans(codes >= 0, offsets)
    longest = ends - starts
    out = [{"base": [], "tested": [], "symbols": None} for _ in range(len(offsets) - 1)]
    if out:
        out[0]["symbols"] = np.bincount(codes[codes >= 0], minlength=len(SYMBOLS)).tolist()

    def texts_with(hint: bytes) -> Iterator[int]:
        at = low.find(hint)
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(hint) <= offsets[doc + 1]:
                yield doc
                at = low.find(hint, int(offsets[doc + 1]))
            else:
                at = low.find(hint, at + 1)

    for place, pattern in enumerate(patterns):
        chosen = {d for h in pattern.hints for d in texts_with(h)} if pattern.hints else set(range(len(out)))
        if pattern.solid:
            chosen &= set((np.searchsorted(offsets, starts[longest >= pattern.solid], side="right") - 1).tolist())
        for doc in chosen:
            begin, end = int(offsets[doc]), int(offsets[doc + 1])
            for m in pattern.regex.finditer(raw, begin, end):
                a, b = m.span(pattern.group)
                if letters[b] - letters[a] >= pattern.least:
                    first = letters[begin]
                    out[doc]["base"].append({"start": int(letters[m.start()] - first), "end": int(letters[m.end()] - first), "place": place, "kind": pattern.kind})
    long = longest >= p.least
    for a, b, encoding in _candidates(data, starts[long], ends[long], p.least):
        doc = int(np.searchsorted(offsets, a, side="right")) - 1
        first, end = letters[offsets[doc]], b
        while end < offsets[doc + 1] and end < b + 2 and raw[end] == 61:  # padding
            end += 1
        chance = randomness(PLACES[encoding, data[a:b]], len(ENCODINGS[encoding].symbols))
        out[doc]["tested"].append({"start": int(letters[a] - first), "end": int(letters[end] - first), "token": raw[a:b].decode(), "encoding": encoding, "p": chance})
    return out


def scanned(docs: DataFrame, patterns: Sequence[Pattern], p: Battery, text_col: str) -> Column:
    @F.arrow_udf(_SCAN_SQL)
    def scan(texts: pa.Array) -> pa.Array:
        parts = [pa.array(_scan_piece(data, offsets, patterns, p), _SCAN) for _, _, data, offsets in pieces(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], _SCAN)

    return scan(F.coalesce(F.col(text_col), F.lit("")))


# Ordinary strings ---------------------------------------------------------------------------------------------------


def log_evidence(shares: np.ndarray):
    """A column function of tested strings: logarithm of how many times as likely each is among random strings of its
    encoding as among ordinary ones, whose characters have ``shares``."""
    surprise = -np.log(shares)
    sizes = np.log([len(e.symbols) for e in ENCODINGS])

    @F.arrow_udf("array<double>")
    def weighed(tested: pa.Array) -> pa.Array:
        flat = tested.flatten()
        tokens, kinds = flat.field("token").to_pylist(), flat.field("encoding").to_pylist()
        sums = [float(surprise[CODE[np.frombuffer(t.encode(), np.uint8)]].sum() - len(t) * sizes[k]) for t, k in zip(tokens, kinds)]
        lengths = np.array([len(x) for x in tested.to_pylist()], np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(sums, pa.float64()))

    return weighed


def thresholds(counts: dict[tuple[int, int], tuple[int, int]], rate: float) -> dict[int, int]:
    """The least whole log evidence reported in each band of lengths.

    ``counts``: (band, whole log evidence) to (strings, those that pass the battery). Evidence is an e-value: among ordinary
    strings it exceeds x with a chance of 1 / x at most. Of a band's strings m, the k strongest are reported if the weakest
    of them has evidence of m / (rate * k) or more: then the expected share of ordinary ones is ``rate`` at most.
    """
    out: dict[int, int] = {}
    for band in {b for b, _ in counts}:
        steps = sorted((e for b, e in counts if b == band), reverse=True)
        m, k = sum(counts[band, e][0] for e in steps), 0
        for e in steps:
            k += counts[band, e][1]
            if k and e >= math.log(m / (rate * k)):
                out[band] = e
    return out


def find_secrets(docs: DataFrame, patterns: Sequence[Pattern], p: Battery = Battery(), keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, and ``spans``: array of (kind, start, end) in characters, end exclusive, by
    start and order of the kinds.

    Matches of the patterns come first. The method adds spans of kind ``random``: strings (runs of letters, digits, ``+/-_``
    of ``least`` characters or more, and their padding) that overlap no match, that the tests of uniform symbols, of runs
    and of serial correlation under the inferred encoding do not call non-random, and that are strong enough evidence
    against an ordinary string of the corpus. The evidence, a likelihood ratio, grows with the length, and the bar is set for
    every band of lengths (half octaves) from all strings of that band in the corpus, so that the false discovery rate holds in each.

    Null and empty texts have no spans; repeated rows are judged one by one; an empty table gives an empty result; of columns with the names
    ``spans``, ``scan`` and ``evidence`` in ``keep`` the first is replaced. Texts are read whole in one task each; only the
    strings found go on to the second pass, nothing is shuffled but counts: of symbols, and of strings by band and whole log
    evidence (at most 400 steps a band).
    """
    names = [c for c in keep if c != "spans"]
    scan = docs.select(*[F.col(c).alias(f"keep{i}") for i, c in enumerate(names)], scanned(docs, patterns, p, text_col).alias("scan"))
    scan = stored(scan.select(*[f"keep{i}" for i in range(len(names))], "scan.base", "scan.tested", "scan.symbols"), "scan")
    sums = scan.agg(*[F.coalesce(F.sum(F.element_at("symbols", i + 1)), F.lit(0)).alias(f"s{i}") for i in range(len(SYMBOLS))]).first()
    totals = np.array(list(sums), float) + 1
    strings = scan.withColumn("evidence", log_evidence(totals / totals.sum())("tested"))

    def banded(t: Column) -> Column:
        return F.floor(2 * F.log2(F.length(t["token"]))).cast("int")

    step = F.floor(F.greatest(F.least(F.col("e"), F.lit(399.0)), F.lit(0.0))).cast("int")
    each = strings.select(F.explode(F.arrays_zip(F.col("tested").alias("t"), F.col("evidence").alias("e"))).alias("x")).select("x.t", "x.e")
    each = each.groupBy(banded(F.col("t")).alias("band"), step.alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("t.p") >= p.alpha).alias("passed"))
    bars = thresholds({(r["band"], r["step"]): (r["n"], r["passed"]) for r in each.collect()}, p.rate)
    spans_ = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    if bars:
        bar = F.create_map(*[F.lit(x) for pair in sorted(bars.items()) for x in pair])
        paired = F.zip_with("tested", "evidence", lambda t, e: F.when(
            (t["p"] >= p.alpha) & F.coalesce(e >= F.try_element_at(bar, banded(t)), F.lit(False))
            & ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
            F.struct(t["start"].alias("start"), F.lit(len(patterns)).alias("place"), t["end"].alias("end"), F.lit(RANDOM).alias("kind"))))
        spans_ = F.concat(spans_, F.filter(paired, lambda s: s.isNotNull()))
    listed = F.transform(F.array_sort(spans_), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return strings.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(names)], listed.alias("spans"))
