"""Fuzzy matches: the best window of a text for a short string, and greedy matching of two lists of names.

The likeness of two strings is 200 * L / (sum of their lengths), L being the longest common subsequence.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(short: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(short):
        bits[c] = bits.get(c, 0) | (1 << i)
    return bits


def _common(bits: dict[str, int], size: int, window: str) -> int:
    """Length of the longest common subsequence with the string of ``size`` whose characters' places are ``bits``."""
    full = (1 << size) - 1
    row = full
    for c in window:
        hit = row & bits.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def best_window(short: str, text: str, floor: float = 0.0) -> float:
    """The greatest likeness of ``short`` and a window of ``text``, from 0 to 100; 0 where none reaches ``floor``.

    Windows have the length of ``short``; at both ends of the text shorter ones count too. If ``short`` is the longer
    of the two they change places. Two empty strings are alike (100), an empty and another one aren't (0).

    No window is compared whose characters, as a bag, have too few in common with ``short`` to beat the best so far.
    """
    if len(short) > len(text):
        short, text = text, short
    m, n = len(short), len(text)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if short in text:
        return 100.0
    bits = _places(short)
    spare = {}
    for c in short:
        spare[c] = spare.get(c, 0) + 1
    best, same = 0.0, 0
    # One character enters at the end, one leaves at the start; spare[c] is how often c is still wanted.
    for end in range(1, n + m):
        if end <= n and (c := text[end - 1]) in spare:
            same += spare[c] > 0
            spare[c] -= 1
        begin = end - m
        if begin > 0 and (c := text[begin - 1]) in spare:
            spare[c] += 1
            same -= spare[c] > 0
        a, b = max(begin, 0), min(end, n)
        most = 200.0 * same / (m + b - a)
        if most > best and most >= floor:
            best = max(best, 200.0 * _common(bits, m, text[a:b]) / (m + b - a))
    return best if best >= floor else 0.0


def partial_ratios(shorts: Column, text: Column, floor: float = 0.0) -> Column:
    """``best_window`` of each of a list of strings in a whole text, which isn't copied for each; null where either is."""

    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        found = [None if x is None or y is None else [None if k is None else best_window(k, y, floor) for k in x] for x, y in pairs]
        return pa.array(found, pa.list_(pa.float64()))

    return run(shorts, text)


def _pieces(name: str, n: int) -> frozenset[str]:
    name = name.strip()
    return frozenset(name[i : i + n] for i in range(len(name) - n + 1)) if len(name) >= n else frozenset([name] if name else [])


def greedy_jaccard(one: list[str], two: list[str], n: int = 2, least: float = 0.55) -> float:
    """Jaccard likeness of two lists of names where like names count as shared.

    In order, each name of the first list takes the likest name of the second that is still free (the first of equally
    like ones), if the Jaccard likeness of their runs of ``n`` characters is at least ``least``. Empty and null names
    don't count; two lists without names are alike (1), one without and one with aren't (0). A pair is only looked at
    if the sizes of its sets allow ``least``.
    """
    a, b = [_pieces(x, n) for x in one if x], [_pieces(x, n) for x in two if x]
    if not a or not b:
        return float(not a and not b)
    free, shared = dict(enumerate(b)), 0
    for x in a:
        best, at = 0.0, -1
        for j, y in free.items():
            if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)):
                both = len(x & y)
                likeness = both / (len(x) + len(y) - both)
                if likeness > best:
                    best, at = likeness, j
        if at >= 0 and best >= least:
            del free[at]
            shared += 1
    return shared / (len(a) + len(b) - shared)


def soft_jaccard(one: Column, two: Column, n: int = 2, least: float = 0.55) -> Column:
    """``greedy_jaccard`` of two columns of lists of names; null where either list is."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else greedy_jaccard(x, y, n, least) for x, y in pairs], pa.float64())

    return run(one, two)
