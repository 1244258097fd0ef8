"""Collocations: phrases counted exactly by the slots of minimal perfect hashes over the candidates that can be frequent.

Phrases go by 64-bit hashes of language and words. A task sums the phrases of its texts and deals the sums out by the
leading bits of the hash, so that a bin of hashes meets in one task. There a sketch of cells, as many as the bin has
hashes, bounds from above what occurs often enough; what passes are the candidates, a minimal perfect hash gives them
slots, with their keys stored for verification, and their sums are added up by slot. Of three words and more only
phrases are dealt out whose parts pass a filter of the frequent ones, one bit a cell; a full filter lets more
through, and no frequent phrase is lost. In a last scan the tasks give the words of what passes, and the bins keep what
their slots know as frequent, once. Counts of the two parts at each cut come by a join on the parts' hashes.

The texts are read once for words and pairs, once for each longer width and once for the words of the frequent phrases,
whatever the size of the input. What a task or the driver holds besides one bin has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm import perfect_hash
from plumeria.llm.common import stored
from plumeria.llm.perfect_hash import BINS
from plumeria.llm.words import _BASE, _BYTE, _LOWER, _pieces, column_bytes, lean, mix, powers, slices, span_hash

#: What ends a piece, and what separates words within it (fixed values).
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
LEAST, WORDS, INSIDE, TOP = 10, 3, 50, 2000
#: Cells of a width's filter at most and at least, and for each frequent phrase between these.
CELLS, LEAST_CELLS, ROOM = 1 << 28, 1 << 16, 32
#: Candidates that one perfect hash holds and that are counted at once.
ROUND_KEYS = 1 << 22
#: Phrases that a task holds before it gives their sums, or knows before it gives one again; and those that it holds with their words.
HELD, HELD_WORDS = 1 << 23, 1 << 20
#: Parts in which a language's phrases are ranked first.
_SALTS = 32

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[list(SPACES)] = True
_LOWER_BYTE = _BYTE[_LOWER]
#: Rows of shards with their counts by slot.
COUNTED = f"{perfect_hash.SCHEMA}, width int, counts binary, frequent long"
_COUNTED = pa.schema([*perfect_hash.ARROW, ("width", pa.int32()), ("counts", pa.binary()), ("frequent", pa.int64())])


class Words:
    """The words of a batch of texts in order: hash with language, place in the bytes, text, and piece."""

    def __init__(self, languages: pa.Array, texts: pa.Array):
        self.data, offsets = column_bytes(texts)
        self.begins, self.ends, self.hashes, self.piece = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        count = 0
        for at, to in _pieces(self.data, offsets):
            part = self.data[at:to]
            inside = ~_BETWEEN[part]
            first = np.zeros(to - at + 1, bool)
            first[0] = first[-1] = True
            first[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
            begins = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
            ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
            values = _LOWER_BYTE[part]
            values *= powers(_BASE, to - at)
            sums = np.zeros(to - at + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            broken = np.flatnonzero(_BREAK[part])
            self.begins.append(begins + at)
            self.ends.append(ends + at)
            self.hashes.append(span_hash(sums, begins, ends))
            self.piece.append(np.searchsorted(broken, begins) + count)
            count += len(broken)
        self.begins, self.ends, hashes, self.piece = (np.concatenate(x) for x in (self.begins, self.ends, self.hashes, self.piece))
        self.text = np.searchsorted(offsets, self.begins, "right") - 1
        self.languages = languages.to_pylist()
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in self.languages], np.uint64)
        self.hashes = mix(hashes * np.uint64(0xA24BAED4963EE407) + salt[self.text])

    def __len__(self) -> int:
        return len(self.hashes)

    def phrases(self, width: int, begins: np.ndarray) -> np.ndarray:
        """The hashes of the runs of ``width`` words from ``begins``, whether or not they lie in one piece."""
        if width == 1:
            return self.hashes[begins]
        total = np.full(len(begins), width, np.uint64)
        for k, weight in enumerate(powers(0xD6E8FEB86659FD93, width + 1)[1:]):
            total += self.hashes[begins + k] * weight
        return mix(total)

    def levels(self, flags: dict[int, np.ndarray], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, begins, hashes) of the runs in one piece whose parts pass their widths' flags, and which pass their
        own. All pass a width without flags."""
        together = (self.piece[1:] == self.piece[:-1]) & (self.text[1:] == self.text[:-1])
        alive = np.ones(len(self), bool)
        for width in range(1, upto + 1):
            if width > 1:
                alive = alive[:-1] & alive[1:]
            if width == 2:
                alive &= together
            begins = np.flatnonzero(alive)
            hashes = self.phrases(width, begins)
            if width in flags:
                good = _passes(flags[width], hashes)
                begins, hashes = begins[good], hashes[good]
                alive = np.zeros(len(alive), bool)
                alive[begins] = True
            yield width, begins, hashes

    def written(self, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs' words, A-Z in lower case, each with a space after it, or a line feed after the last; and the runs' bytes."""
        word = begins[:, None] + np.arange(width)
        lengths = (self.ends[word] - self.begins[word] + 1).ravel()
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[word].ravel() - ends + lengths, lengths)
        out = _LOWER[self.data[np.minimum(place, len(self.data) - 1)]]
        out[ends - 1] = 32
        out[ends[width - 1 :: width] - 1] = 10
        return out, lengths.reshape(-1, width).sum(1)


def _passes(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the cell of each hash is set in flags of one bit a cell."""
    cell = (hashes >> np.uint64(64 - (len(flags) * 8).bit_length() + 1)).astype(np.int64)
    return (flags[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in slices(batches):
        yield Words(batch.column(0), batch.column(1))


def _bins(keys: np.ndarray) -> np.ndarray:
    """Where the bins begin in sorted keys, and the end."""
    return np.append(np.searchsorted(keys, np.arange(1 << BINS, dtype=np.uint64) << np.uint64(64 - BINS)), len(keys))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, all their first bytes before all second ones: the leading bytes of a bin's steps are zeros, which shuffles compress."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[dict]]]:
    """The rows of one bin and width after another."""
    return groupby((row for batch in batches for row in batch.to_pylist()), itemgetter("bin", "width"))


def phrase_sums(rows: DataFrame, flags: dict, widths: range) -> DataFrame:
    """(bin, width, once, keys, counts): the phrases of ``widths`` words whose parts pass, in sums of up to ``HELD`` of them.
    Those in ``once`` came once."""
    schema = pa.schema([("bin", pa.int64()), ("width", pa.int32()), ("once", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def summed(width: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_counts=True)
        cuts, out = _bins(keys), []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own, counts = keys[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]]
            often = counts > 1
            out.append({"bin": k, "width": width, "once": _packed(own[~often]), "keys": _packed(own[often]), "counts": counts[often].tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, held = {k: x.value for k, x in flags.items()}, {width: [] for width in widths}, 0
        for words in _batches(batches):
            for width, _, hashes in words.levels(known, widths[-1]):
                if width in waiting:
                    waiting[width].append(hashes)
                    held += len(hashes)
            if held >= HELD:
                yield from (summed(width, waiting[width]) for width in widths)
                waiting, held = {width: [] for width in widths}, 0
        yield from (summed(width, waiting[width]) for width in widths)

    return rows.mapInArrow(lean(run), "bin long, width int, once binary, keys binary, counts binary")


def slot_counts(sums: DataFrame, least: int = LEAST, round_keys: int = ROUND_KEYS) -> DataFrame:
    """The shards of a perfect hash for each bin and width, over the phrases that can occur ``least`` times, with the
    counts by slot, and how many of them do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bin_, width), rows in _by_bin(batches):
            keys, n = [], []
            for row in rows:
                keys += [_unpacked(row["once"]), _unpacked(row["keys"])]
                n += [np.ones(len(keys[-2]), np.int64), np.frombuffer(row["counts"], np.int64)]
            keys, n = np.concatenate(keys), np.concatenate(n)
            cell = ((keys << np.uint64(BINS)) >> np.uint64(64 - len(keys).bit_length())).astype(np.int64)
            may = np.bincount(cell, weights=np.minimum(n, least))[cell] >= least
            keys, n = keys[may], n[may]
            shards = list(perfect_hash.cut(bin_, np.unique(keys), round_keys)) if len(keys) else []
            own = perfect_hash.Slots(shards)
            counts, at = np.zeros(len(own), np.int64), 0
            np.add.at(counts, own.find(keys), n)
            for shard in shards:
                to = at + len(shard["keys"]) // 8
                yield pa.RecordBatch.from_pylist([shard | {"width": width, "counts": counts[at:to].tobytes(), "frequent": int((counts[at:to] >= least).sum())}], schema=_COUNTED)
                at = to

    return sums.repartition("bin").sortWithinPartitions("bin", "width").mapInArrow(lean(run), COUNTED)


def frequent_flags(slots: DataFrame, width: int, least: int = LEAST, cells: int = CELLS) -> np.ndarray:
    """A bit for each cell of a filter: whether a phrase of ``width`` words that occurs ``least`` times falls into it. ``cells`` / 8 bytes at most."""
    own = slots.where(F.col("width") == width)
    n = own.agg(F.sum("frequent").alias("n")).first()["n"] or 0
    cells = min(cells, max(LEAST_CELLS, 1 << (ROOM * n).bit_length()))
    step = cells >> BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint64)[np.frombuffer(row["counts"], np.int64) >= least]
                bits = np.zeros(step, bool)
                bits[(keys >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64) & step - 1] = True
                yield pa.RecordBatch.from_pylist([{"bin": row["bin"], "bits": np.packbits(bits, bitorder="little").tobytes()}])

    out = np.zeros(cells // 8, np.uint8)
    for row in own.select("bin", "keys", "counts").mapInArrow(run, "bin long, bits binary").toLocalIterator():
        out[row["bin"] * step // 8 : (row["bin"] + 1) * step // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def phrase_words(rows: DataFrame, flags: dict, words: int = WORDS) -> DataFrame:
    """(bin, width, lang, keys, texts, n): the phrases of two words and more that pass, with their words, about once a
    task; and rows without keys that add up to a language's words."""
    schema = pa.schema([("bin", pa.int64()), ("width", pa.int32()), ("lang", pa.string()), ("keys", pa.binary()), ("texts", pa.binary()), ("n", pa.int64())])

    def dealt(width: int, codes: list[str], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, lang, sizes, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        begins, order = np.cumsum(sizes) - sizes, np.lexsort((keys, lang))
        keys, lang, sizes, begins = keys[order], lang[order], sizes[order], begins[order]
        ends = np.cumsum(sizes)
        place = np.repeat(begins - ends + sizes, sizes)
        place += np.arange(len(data))
        data = data[place]
        bins = (keys >> np.uint64(64 - BINS)).astype(np.int64)
        cuts = np.flatnonzero((np.diff(bins, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0)).tolist()
        out = []
        for at, to in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            texts = data[ends[at] - sizes[at] : ends[to - 1]]
            out.append({"bin": int(bins[at]), "width": width, "lang": codes[lang[at]], "keys": _packed(keys[at:to]), "texts": texts.tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, code, in_all = {k: x.value for k, x in flags.items()}, {}, {}
        told, waiting, held = {}, {}, 0
        for one in _batches(batches):
            if sum(map(len, told.values())) >= HELD:
                told = {}
            for lang, n in zip(one.languages, np.bincount(one.text, minlength=len(one.languages)).tolist(), strict=True):
                in_all[lang] = in_all.get(lang, 0) + n
            lang = np.array([code.setdefault(x, len(code)) for x in one.languages], np.int64)
            for width, begins, hashes in one.levels(known, words):
                if width == 1 or not len(hashes):
                    continue
                order = np.argsort(hashes)
                order = order[np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0]
                keys, own = hashes[order], told.get(width, hashes[:0])
                place = np.searchsorted(own, keys)
                fresh = place == len(own)
                fresh[~fresh] = own[place[~fresh]] != keys[~fresh]
                keys, begins = keys[fresh], begins[order[fresh]]
                told[width] = np.insert(own, place[fresh], keys)
                data, sizes = one.written(begins, width)
                waiting.setdefault(width, []).append((keys, lang[one.text[begins]], sizes, data))
                held += len(keys)
            if held >= HELD_WORDS:
                yield from (dealt(width, list(code), parts) for width, parts in waiting.items())
                waiting, held = {}, 0
        yield from (dealt(width, list(code), parts) for width, parts in waiting.items())
        yield pa.RecordBatch.from_pylist([{"bin": 0, "width": 0, "lang": lang, "n": n} for lang, n in in_all.items()], schema=schema)

    return rows.mapInArrow(lean(run), "bin long, width int, lang string, keys binary, texts binary, n long")


def frequent_phrases(texts: DataFrame, slots: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, lang, phrase, width, a, parts, inner, n): the phrases of two words and more that occur ``a >= least`` times
    by the slot of their bin, once; the hashes of the first and second part at each cut, and of the runs of two words
    and more inside. And the rows without a phrase of ``texts``."""
    hashes = pa.list_(pa.int64())
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("width", pa.int32()), ("a", pa.int64()), ("parts", hashes), ("inner", hashes), ("n", pa.int64())])

    def told(width: int, shards: list[dict], rows: list[dict]) -> pa.RecordBatch:
        own, total = perfect_hash.Slots(shards), np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(shards, key=itemgetter("sub"))])
        keys = np.concatenate([_unpacked(r["keys"]) for r in rows])
        langs = [r["lang"] for r in rows for _ in range(len(r["keys"]) // 8)]
        found = own.find(keys)
        good = np.flatnonzero(found >= 0)
        good = good[total[found[good]] >= least]
        slot, where = np.unique(found[good], return_index=True)
        where = good[where].tolist()
        lines = b"".join(r["texts"] for r in rows).split(b"\n")
        lang, phrase = pa.array([langs[i] for i in where], pa.string()), pa.array([lines[i].decode() for i in where], pa.string())
        one, begin = Words(lang, phrase), np.arange(len(where)) * width
        parts = [x for cut in range(1, width) for x in (one.phrases(cut, begin), one.phrases(width - cut, begin + cut))]
        inner = [one.phrases(k, begin + i) for k in range(2, width) for i in range(width - k + 1)]
        lists = []
        for each in (parts, inner):
            flat = np.stack(each, axis=1).ravel().view(np.int64) if each else np.empty(0, np.int64)
            lists.append(pa.ListArray.from_arrays(np.arange(len(where) + 1, dtype=np.int32) * len(each), flat))
        columns = [keys[where].view(np.int64), lang, phrase, np.full(len(where), width, np.int32), total[slot], *lists, pa.nulls(len(where), pa.int64())]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, width), rows in _by_bin(batches):
            rows = list(rows)
            if not width:
                yield pa.RecordBatch.from_pylist([{"lang": r["lang"], "n": r["n"]} for r in rows], schema=schema)
                continue
            shards, own = ([r for r in rows if (r["texts"] is None) == x] for x in (True, False))
            if shards and own:
                yield told(width, shards, own)

    both = slots.where("width > 1").drop("frequent").unionByName(texts, allowMissingColumns=True)
    out = "key long, lang string, phrase string, width int, a long, parts array<long>, inner array<long>, n long"
    return both.repartition("bin").sortWithinPartitions("bin", "width").mapInArrow(lean(run), out)


def counts_by_key(slots: DataFrame, least: int = LEAST) -> DataFrame:
    """(part, f): the phrases of any width that occur ``least`` times, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                often = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(counts[often])], names=["part", "f"])

    return slots.select("keys", "counts").mapInArrow(run, "part long, f long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) by exact decimals."""
    long = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", long(a) * long(a) * F.lit(1_000_000), long(left) * long(right))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    words: int = WORDS,
    inside: int = INSIDE,
    top: int | None = TOP,
    cells: int = CELLS,
    round_keys: int = ROUND_KEYS,
) -> DataFrame:
    """(lang, rank, phrase, width, a, l, r, n, score, cut): the first ``top`` collocations of each language, or all.

    A-Z in lower case, texts are cut at ``BREAKS`` into pieces and those at ``SPACES`` into words. Candidates are
    phrases of 2 to ``words`` words within a piece that occur ``a >= least`` times in texts of the language (null is
    ``und``), overlaps included; n counts the language's words. ``cut`` is the number of first words after which
    floor(1000000 a a / (l r)) is least, the first such; l and r count the two parts. A candidate is left out if a longer
    candidate with 100 f >= ``inside`` a holds its words in a row. Order: score and a descending, phrase by its bytes.
    Null and empty texts have no words, rows are counted one by one whether or not they repeat, an empty table gives
    an empty result, and other columns are ignored, whatever their names.
    """
    if cells & (cells - 1) or cells < LEAST_CELLS or words < 2 or least < 1 or least > 255:
        raise ValueError(f"cells: a power of two from {LEAST_CELLS} on; words: 2 at least; least: 1 to 255")
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    flags: dict = {}
    levels = []
    for widths in (range(1, 3), *(range(k, k + 1) for k in range(3, words + 1))):
        levels.append(stored(slot_counts(phrase_sums(rows, flags, widths), least, round_keys), "phrases-slots"))
        flags = flags | {widths[-1]: context.broadcast(frequent_flags(levels[-1], widths[-1], least, cells))}
    slots = reduce(DataFrame.unionByName, levels)
    found = stored(frequent_phrases(phrase_words(rows, flags, words), slots, least), "phrases-found")
    languages = found.where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = found.where("phrase IS NOT NULL")
    lookups = phrases.select("key", F.posexplode("parts").alias("at", "part")).join(counts_by_key(slots, least).hint("merge"), "part")
    by_cut = lookups.groupBy("key").agg(*[F.max(F.when(F.col("at") == k, F.col("f"))).alias(f"f{k}") for k in range(2 * words - 2)])
    counted = phrases.select("key", "lang", "phrase", "width", "a").join(by_cut, "key")

    cuts = []
    for c in range(1, words):
        left, right = F.col(f"f{2 * c - 2}"), F.col(f"f{2 * c - 1}")
        cuts.append(F.when(F.col("width") > c, F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(c).alias("cut"), left.alias("l"), right.alias("r"))))
    longest = phrases.select(F.explode("inner").alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    left = counted.select("key", "lang", "phrase", "width", "a", F.array_min(F.array(*cuts)).alias("best")).join(longest, "key", "left")
    left = left.where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # each language in parts first, so that none is sorted in one task
        salted = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
        left = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(languages, "lang").select("lang", "rank", "phrase", "width", "a", "best.l", "best.r", "n", "best.score", "best.cut")
