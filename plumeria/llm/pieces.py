"""Encoding by distinct chunks: a text is cut where no token can go across, and each distinct chunk is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: How a byte-level BPE cuts a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The Unicode characters with the White_Space property (fixed values).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next white space. The words never hold white space after another
#: character, and the pattern looks ahead only from white space, so they can be found in each chunk alone.
CHUNKS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")

#: Distinct chunks that one task remembers, and their characters together.
REMEMBERED, CHARACTERS = 250_000, 6_000_000
#: The same where an encoder costs more than the memory.
REMEMBERED_MORE = 900_000
#: Words that are encoded together.
TOGETHER = 1 << 14


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def checked(content: dict) -> dict:
    """A vocabulary file's content, if the words that are cut here are those that it asks for; else an error."""
    model, cut = content["model"], content.get("pre_tokenizer") or {}
    faults = [
        model.get("type", "BPE") != "BPE" and "a model other than BPE",
        content.get("normalizer") is not None and "a normalizer",
        cut.get("type") != "ByteLevel" and "a pre-tokenizer other than ByteLevel",
        bool(cut.get("add_prefix_space")) and "add_prefix_space",
        not cut.get("use_regex", True) and "words without the usual pattern",
        any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        and "dropout, ignore_merges, byte_fallback, a prefix or a suffix",
        any(x.get(k) for x in content.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))
        and "added tokens that take in what is around them",
    ]
    if any(faults):
        raise ValueError("not covered: " + "; ".join(x for x in faults if x))
    return content


class Runs:
    """Numbers for distinct strings in order of appearance, and a run of integers for each."""

    class _Numbers(dict):
        def __init__(self) -> None:
            self.new: list[str] = []

        def __missing__(self, name: str) -> int:
            number = self[name] = len(self)
            self.new.append(name)
            return number

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        """``learn`` gives (flat integers, how many each) for new strings."""
        self._learn, self._remembered = learn, remembered
        self._numbers, self._held = self._Numbers(), 0
        self._values, self._lengths, self._starts = (np.empty(0, np.int64) for _ in range(3))

    def __call__(self, lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The runs of all strings, one after another, their lengths, and how many strings each list has."""
        if len(self._numbers) > self._remembered or self._held > CHARACTERS * self._remembered // REMEMBERED:
            self.__init__(self._learn, self._remembered)
        find = self._numbers.__getitem__
        which: list[int] = []
        counts = []
        for one in lists:
            which += map(find, one)
            counts.append(len(one))
        if new := self._numbers.new:
            values, lengths = self._learn(new)
            self._starts = np.concatenate((self._starts, len(self._values) + np.cumsum(lengths) - lengths))
            self._values = np.concatenate((self._values, values))
            self._lengths = np.concatenate((self._lengths, lengths))
            self._held += sum(map(len, new))
            self._numbers.new = []
        place = np.array(which, np.int64)
        lengths = self._lengths[place]
        return self._values[ranges(self._starts[place], lengths)], lengths, counts


def folded(lengths: np.ndarray, counts: Iterable[int]) -> np.ndarray:
    """Sums of consecutive runs of ``lengths``, as many each as ``counts`` says."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(counts, np.int64))))
    return ends[bounds[1:]] - ends[bounds[:-1]]


#: White space other than single spaces and line ends between other characters.
_OTHER = [x for x in "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]
_ASCII_OTHER = [x for x in _OTHER if x.isascii()] + ["  ", " \n", "\n ", "\n\n"]
_OTHER += ["  ", " \n", "\n ", "\n\n"]


def cut(text: str) -> list[str]:
    """The chunks of a text as keys: one after a space stands without it, any other is marked by a tab before it.

    A text whose white space is only single spaces and line ends is split at these, which is fastest.
    """
    if any(x in text for x in (_ASCII_OTHER if text.isascii() else _OTHER)) or text[-1:] in " \n" or text[:1] in " \n":
        return [x[1:] if x[0] == " " and x[1:2].isalnum() else "\t" + x for x in CHUNKS.findall(text)]
    keys: list[str] = []
    mark = "\t"
    for line in text.split("\n"):
        parts = line.split(" ")
        parts[0] = mark + parts[0]
        keys += parts
        mark = "\t\n"
    return keys


def whole(key: str) -> str:
    """The chunk of a key."""
    return key[1:] if key[0] == "\t" else " " + key


class ChunkEncoder:
    """Ids of texts; ``encode`` turns distinct chunks into (flat ids, number of ids of each chunk)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self._chunks = Runs(lambda keys: encode(list(map(whole, keys))), remembered)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        ids, lengths, counts = self._chunks(map(cut, texts))
        return ids, folded(lengths, counts)


class WordCutter:
    """Cuts chunks into words and encodes each distinct word once.

    ``special`` are strings that are one word wherever they stand.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: Iterable[str] = (), remembered: int = REMEMBERED):
        self._special = sorted(special, key=len, reverse=True)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")") if self._special else None
        self._find = regex.compile(PATTERN).findall

        def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [encode(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])

        self._words = Runs(learn, remembered)

    def _cut(self, chunk: str) -> list[str]:
        # Most chunks are a space and letters, and perhaps a mark; isalpha() is true for letters alone, as \p{L} is.
        if chunk[0] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        if not any(x in chunk for x in self._special):
            return self._find(chunk)
        parts = self._marks.split(chunk)  # every second one is special
        return [word for i, part in enumerate(parts) for word in ([part] if i % 2 else self._find(part))]

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths, counts = self._words(map(self._cut, chunks))
        return ids, folded(lengths, counts)


def text_groups(texts: list[str], characters: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts of about ``characters`` together; a longer text is a run of its own."""
    runs, at, size = [], 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > characters:
            runs.append((at, i))
            at, size = i, 0
        size += len(text)
    return [*runs, (at, len(texts))] if len(texts) > at else runs
