"""Hashes of the words of many texts at once, with numpy over the bytes of an Arrow string column."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the memory of a task whatever the length of a text.
PIECE = 1 << 19
#: Rows of a batch that are handled at once.
ROWS = 512

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 1), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n+1 offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that begin and end where no word goes on."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        size = PIECE
        while (to := min(at + size, end)) < end:
            space = np.flatnonzero(_SPACE[data[at:to]])
            text = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            cut = max(at + int(space[-1]) + 1 if len(space) else at, text)
            if cut > at:
                to = cut
                break
            size *= 2  # a word longer than the piece
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """For each piece: prefix sums, the words' begins and ends in the piece, and the place of the piece in data."""
    for at, to in _pieces(data, offsets):
        part = data[at:to]
        inside = ~_SPACE[part]
        first = np.zeros(to - at + 1, bool)
        first[0] = first[-1] = True
        first[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
        begins = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
        ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
        values = _BYTE[_LOWER[part] if lower else part]
        values *= powers(_BASE, to - at)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        yield sums, begins, ends, at


def span_hash(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans of a piece, equal for equal bytes wherever they are."""
    raw = (sums[ends] - sums[begins]) * powers(_BASE_INVERSE, len(sums))[begins]
    return mix(raw + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in order, and n+1 offsets into them."""
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for sums, begins, ends, at in words(data, offsets, lower):
        hashes.append(span_hash(sums, begins, ends))
        places.append(begins + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of fewer words, of the whole sequence."""
    if not len(word):
        return word
    if len(word) < width:
        weights = powers(0xD1342543DE82EF95, len(word) + 1)[1:]
        return mix(np.sum(word * weights, keepdims=True) + np.uint64(len(word)))
    total = np.zeros(len(word) - width + 1, np.uint64)
    for k, weight in enumerate(powers(0xAF251AF3B0F025B5, width + 1)[1:]):
        total += word[k : len(word) - width + 1 + k] * weight
    return mix(total)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, handing back at its end what the allocators still hold: a worker lives on after its task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
