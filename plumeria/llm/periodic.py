"""Periodic runs of words by the runs theorem: every run has a Lyndon root that is a longest Lyndon word.

The words of a batch of texts are numbered and laid end to end, each text closed by an end mark that comes before all
words. A suffix array by prefix doubling gives each suffix its rank. The longest Lyndon word that begins at a place ends
before the next place whose suffix is smaller; under the inverse order of the words, before the next whose suffix is
greater. Each such word is a candidate root: it is extended to the right by the longest common prefix of the suffixes
at its begin and its end, and to the left by the same in the reversed texts. Common prefixes are range minima over the
LCP array, looked up in a sparse table of which one level at a time is held. What reaches the asked exponent is a run.

All steps are numpy over whole batches. Only runs of three periods and more are sought, so a root has an equal
neighbour to its right; texts in which no candidate has one, most of them, go no further than the next smaller places.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.words import column_bytes, lean, slices, word_hashes

SHORTEST, PERIODS = 24, 3
#: Rounds of pointer jumping before the places that are left are followed one by one.
_ROUNDS = 48
_NONE = np.empty(0, np.int64)


def suffix_ranks(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of texts laid end to end, text by text.

    ``codes`` are words from 1 on, with a 0 at the end of each text; ``owner`` is the number of each place's text.
    """
    n = len(codes)
    if not n:
        return _NONE, _NONE
    bits, high = int(codes.max()).bit_length() or 1, int(owner[-1]).bit_length()
    width = max(1, (63 - high) // bits)
    key = owner.astype(np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= codes[k:]
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        # Suffixes of one text that are alike so far hold no end mark yet, so the place that follows is in the text.
        open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(open_):
            return order, rank
        suffix = order[open_]
        key = rank[suffix] * n + rank[suffix + width]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_] = suffix
        first[open_[1:]] |= key[1:] != key[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(first[open_], open_, 0))
        width *= 2


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length; the values are distinct and not negative."""
    n = len(values)
    values = np.append(values, -1)
    found = np.arange(1, n + 1)
    active = np.arange(n)
    for _ in range(_ROUNDS):
        after = found[active]
        greater = values[after] > values[active]
        active = active[greater]
        if not len(active):
            return found
        found[active] = found[after[greater]]
    for i in active[::-1].tolist():
        j, own = int(found[i]), values[i]
        while values[j] > own:
            j = int(found[j])
        found[i] = j
    return found


def lcp_array(codes: np.ndarray, owner: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix and the one before it in order, 0 across texts.

    Only irreducible values, those that can't be got from the place to the left, are found by comparing words; they
    sum to O(n log n). All others are one less than their left neighbour's.
    """
    n = len(codes)
    before = np.full(n, -1)
    same = owner[order[1:]] == owner[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    reducible = np.zeros(n, bool)
    inner = np.flatnonzero((before[1:] > 0) & (owner[1:] == owner[:-1])) + 1
    left = before[inner] - 1
    reducible[inner] = (codes[inner - 1] == codes[left]) & (owner[left] == owner[inner])
    places = np.flatnonzero(~reducible)
    values = np.zeros(len(places), np.int64)
    active = np.flatnonzero(before[places] >= 0)
    width = 8
    while len(active):
        width = min(2 * width, max(8, (1 << 20) // len(active)))
        padded = np.append(codes, np.zeros(width, codes.dtype))
        ahead = values[active][:, None] + np.arange(width)
        a, b = places[active][:, None] + ahead, before[places[active]][:, None] + ahead
        equal = padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
        whole = equal.all(axis=1)
        values[active] += np.where(whole, width, equal.argmin(axis=1))
        active = active[whole]
    by_place = np.zeros(n, np.int64)
    by_place[places] = values
    last = np.zeros(n, np.int64)
    last[places] = places
    last = np.maximum.accumulate(last)
    return (by_place[last] - (np.arange(n) - last))[order]


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high-1] for each query, from a sparse table of which one level is held at a time."""
    found = np.empty(len(low), np.int64)
    level = np.frexp((high - low).astype(float))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        asked = np.flatnonzero(level == k)
        found[asked] = np.minimum(values[low[asked]], values[high[asked] - (1 << k)])
        if len(values) <= 1 << k:
            break
        values = np.minimum(values[: -1 << k], values[1 << k :])
    return found


def _common(rank: np.ndarray, lcp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = rank[i], rank[j]
    return range_minima(lcp, np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def runs(codes: np.ndarray, lengths: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of at least ``shortest`` words and ``periods`` (2 or more) periods.

    ``codes`` holds the words of all texts as numbers from 1 on, ``lengths`` how many each text has. Ordered by text,
    start and period.
    """
    n_texts = len(lengths)
    ends = np.cumsum(lengths + 1) - 1  # of the end marks
    laid = np.zeros(len(codes) + n_texts, np.int64)
    owner = np.repeat(np.arange(n_texts), lengths + 1)
    is_word = np.ones(len(laid), bool)
    is_word[ends] = False
    laid[is_word] = codes
    order, rank = suffix_ranks(laid, owner)
    roots = []
    for values in (rank, len(laid) - rank):
        after = next_smaller(values)
        begin = np.flatnonzero(is_word)
        end = after[begin]
        fits = 2 * end - begin <= ends[owner[begin]]
        begin, end = begin[fits], end[fits]
        alike = (laid[begin] == laid[end]) & (laid[end - 1] == laid[2 * end - begin - 1])
        roots.append((begin[alike], end[alike]))
    begin, end = (np.concatenate(x) for x in zip(*roots, strict=True))
    none = (_NONE, _NONE, _NONE, _NONE)
    if not len(begin):
        return none

    # The texts with candidates alone; each keeps its stretch of the suffix array.
    chosen = np.unique(owner[begin])
    starts = ends - lengths
    stay = np.zeros(n_texts, bool)
    stay[chosen] = True
    held = stay[owner]
    shift = np.cumsum(~held)
    part, own = laid[held], np.repeat(np.arange(len(chosen)), lengths[chosen] + 1)
    sub_order = order[held[order]]
    sub_order = sub_order - shift[sub_order]
    sub_rank = np.empty(len(part), np.int64)
    sub_rank[sub_order] = np.arange(len(part))
    lcp = lcp_array(part, own, sub_order)
    right = _common(sub_rank, lcp, begin - shift[begin], end - shift[end])
    equal = right >= end - begin  # a run of three periods has a root with an equal neighbour, any run of two with LCP
    if periods > 2:
        begin, end, right = begin[equal], end[equal], right[equal]
    if not len(begin):
        return none

    sub_ends = np.cumsum(lengths[chosen] + 1) - 1
    sub_starts = sub_ends - lengths[chosen]
    mirrored = np.zeros(len(part), np.int64)
    inside = part > 0
    at = np.flatnonzero(inside)
    mirrored[sub_starts[own[at]] + sub_ends[own[at]] - 1 - at] = part[at]
    back_order, back_rank = suffix_ranks(mirrored, own)
    back = lcp_array(mirrored, own, back_order)
    text = owner[begin]
    left = np.zeros(len(begin), np.int64)
    inner = np.flatnonzero(begin > starts[text])
    of = own[begin[inner] - shift[begin[inner]]]
    turn = lambda x: sub_starts[of] + sub_ends[of] - 1 - (x - 1 - shift[x - 1])
    left[inner] = _common(back_rank, back, turn(begin[inner]), turn(end[inner]))

    period = end - begin
    length = period + right + left
    start = begin - left - starts[text]
    good = length >= np.maximum(shortest, periods * period)
    table = np.unique(np.stack((text[good], start[good], period[good], length[good]), axis=1), axis=0)
    return table[:, 0], table[:, 1], table[:, 3], table[:, 2]


def _strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The place of the run of greatest length over period, then least start, then least period."""
    return min(range(len(start)), key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("text", pa.string())])


def _found(ids: pa.Array, texts: pa.Array, shortest: int, periods: int) -> pa.RecordBatch:
    hashes, places = word_hashes(*column_bytes(texts), lower=False)
    lengths = np.diff(places)
    long = lengths >= max(shortest, periods)
    codes = np.unique(hashes[np.repeat(long, lengths)], return_inverse=True)[1].astype(np.int64) + 1
    text, start, length, period = runs(codes, lengths[long], shortest, periods)
    text = np.flatnonzero(long)[text] if len(text) else text
    own_runs: list[list[dict]] = [[] for _ in range(len(texts))]
    strongest: list[dict | None] = [None] * len(texts)
    lost: dict[int, np.ndarray] = {}
    bounds = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        i = int(text[low])
        s, n, q = start[low:high], length[low:high], period[low:high]
        own_runs[i] = [{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), q.tolist(), strict=True)]
        strongest[i] = own_runs[i][_strongest(s, n, q)]
        step = np.zeros(lengths[i] + 1, np.int64)
        np.add.at(step, s + q, 1)
        np.add.at(step, s + n, -1)
        lost[i] = np.cumsum(step)[:-1] > 0
    left = []
    for i, one in enumerate(texts.to_pylist()):
        words = (one or "").encode().split()  # bytes.split() cuts at ASCII white space, as the words are cut
        if i in lost:
            words = [words[k] for k in np.flatnonzero(~lost[i]).tolist()]
        left.append(b" ".join(words).decode())
    columns = [ids, pa.array(lengths, pa.int64()), pa.array(own_runs, pa.list_(_RUN)), pa.array(strongest, _RUN), pa.array(left, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, strongest, text) for each row of ``docs``, with no shuffle.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``runs`` are structs (start, length, period) of words, ordered by start and
    period: longest stretches that have this least period, of at least ``shortest`` words and ``periods`` periods
    (3 or more). ``strongest`` is the one of greatest length over period, then least start and period; null without
    runs. ``text`` has the words that no run holds beyond its first period, joined by one space. A null or empty text,
    and one of too few words, has no runs. Rows that share a doc_id, or have none, stay rows of their own. An empty
    table gives an empty result; other columns are ignored, whatever their names. A task holds some 200 bytes for each
    word of a batch, and of a longer text.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods aren't sought")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sizes = np.diff(column_bytes(batch.column(1))[1])
            group = (np.cumsum(sizes) - sizes) >> 21  # some 2 MB of text at once
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high > low:
                    yield _found(batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), shortest, periods)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    one = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(lean(run), f"doc_id long, n_words long, runs array<{one}>, strongest {one}, text string")
