"""Byte-level BPE in numpy: the symbols of many words lie in one flat array and are merged round by round.

In a round every word merges its pair of the lowest rank, at all its places from left to right. The pairs' ranks are
found for all words at once by binary search over the sorted keys of the merge table. This equals merging one place
at a time, as a merge makes only symbols whose own pairs rank later.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.pieces import ChunkEncoder, WordCutter, checked, ranges, text_groups
from plumeria.llm.words import lean, slices

_NO_RANK = np.int64(1 << 40)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class ByteBPE:
    """A vocabulary file of the tokenizers library with a plain byte-level BPE model; others are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = checked(json.load(file))
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        characters = byte_characters()
        as_byte = {c: b for b, c in enumerate(characters)}
        self.first = np.array([vocabulary[c] for c in characters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        spelled = [b""] * self.size
        for token, number in vocabulary.items():
            spelled[number] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        for token, number in self.special.items():
            spelled[number] = token.encode()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs of symbols; the rank of a pair that isn't merged is greatest."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NO_RANK), self.made[at]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word)."""
        lengths = np.array([len(x) for x in words], np.int64)
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        last = np.append(word[:-1] != word[1:], True)[: len(word)]
        rank, made = self._pairs(symbol, np.append(symbol[1:], 0)[: len(symbol)])
        rank[last] = _NO_RANK
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while len(symbol):
            begins = np.flatnonzero(np.append(True, last[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(symbol))))
            open_ = lowest < _NO_RANK
            if not open_.all():
                done.append((word[~open_], symbol[~open_]))
                symbol, word, last, rank, made, lowest = (x[open_] for x in (symbol, word, last, rank, made, lowest))
                if not len(symbol):
                    break
            chosen = np.flatnonzero(rank == lowest)
            # Of places that follow one another, as in "aaa", every other one is merged.
            step = np.diff(chosen, prepend=-2) != 1
            if not step.all():
                run = np.maximum.accumulate(np.where(step, np.arange(len(chosen)), 0))
                chosen = chosen[(chosen - chosen[run]) % 2 == 0]
            symbol[chosen] = made[chosen]
            last[chosen] = last[chosen + 1]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            place = chosen - np.arange(len(chosen))  # where the merged symbols are afterwards
            symbol, word, last, rank, made = (x[keep] for x in (symbol, word, last, rank, made))
            near = np.concatenate((place, place[place > 0] - 1))
            near_rank, made[near] = self._pairs(symbol[near], symbol[np.minimum(near + 1, len(symbol) - 1)])
            rank[near] = np.where(last[near], _NO_RANK, near_rank)
        words_of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(words_of, kind="stable")], np.bincount(words_of, minlength=len(words))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word); a special token is a word of its own."""
        plain = np.array([word not in self.special for word in words], bool)
        ids, counts = self.merge_words([b"" if word in self.special else word.encode() for word in words])
        if not plain.all():
            at = (np.cumsum(counts) - counts)[~plain]
            ids = np.insert(ids, at, [self.special[word] for word in words if word in self.special])
            counts[~plain] = 1
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of texts from their ids, one text after another."""
        size = self.lengths[ids]
        data = self.spelling[ranges(self.starts[ids], size)]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        return [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> tuple[ByteBPE, ChunkEncoder]:
    model = ByteBPE(path)
    return model, ChunkEncoder(WordCutter(model.encode_words, model.special))


def _runs(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches):
        whole = batch.column(texts).fill_null("").to_pylist()
        for a, b in text_groups(whole):
            yield batch.slice(a, b - a), whole[a:b]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoder = load(path)
        for batch, texts in _runs(batches, 1):
            ids, counts = encoder(texts)
            ends = np.append(0, np.cumsum(counts))
            plain = ids.astype("<u4")
            hashed = [hashlib.sha256(plain[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            back = model.decode(ids, counts)
            said = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in back]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashed), pa.array(said)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = load(path)
        for batch, texts in _runs(batches, 1):
            ids, counts = encoder(texts)
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = load(path)
        for batch in slices(batches):
            lists = batch.column(1)
            counts = np.array([len(x) if x is not None else 0 for x in lists], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [x.decode("utf-8", "replace") for x in model.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _two(docs: DataFrame, doc_id: str, other: str, kind: str, name: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(other).cast(kind).alias(name))


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) for every row of ``docs``, as the tokenizers library encodes its whole text.

    ``path`` is a vocabulary file of that library with a byte-level BPE model, the same on every machine; neither
    truncation nor padding is used and no special tokens are added, but those written in a text become their ids.
    A null text counts as empty and has no ids. Null and repeated doc_ids are kept as they are, an empty table gives
    an empty result, and other columns are ignored, whatever their names. A task holds about a million characters at
    once, or one text.
    """
    return _two(docs, doc_id, text, "string", "text").mapInArrow(lean(_encoded(path)), "doc_id long, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text, bytes that aren't UTF-8 become replacement characters."""
    return _two(tokens, doc_id, ids, "array<int>", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded text in UTF-8. Rows as in ``encode``.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _two(docs, doc_id, text, "string", "text").mapInArrow(lean(_digests(path)), schema)
