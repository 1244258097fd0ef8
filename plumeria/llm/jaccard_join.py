"""N-gram Jaccard join with signature trees: exact links between word-shingle sets, hot groups included.

Distinct shingle sets are the leaves of a forest. Sizes fall into levels; at a level with sizes up to ``u`` two linked
sets differ in at most ``d = 2u(1-t)/(1+t)`` tokens, so of ``d + 1 + s`` segments of the token space at least ``1 + s``
hold the same tokens in both. A root is one segment's content. One order over all contents, by a count sketch of the
tokens of the whole corpus, tells how rare the rarest token of a content is; a set leaves out its ``s`` commonest
contents. The rarest content that two linked sets share has ``s`` commoner ones beside it in both, so both keep it: no
linked pair is lost, and a passage that very many texts hold is hardly ever a root.

Below a root the sets are split by signatures relative to pivots. Every set is held against the smallest set of its
roots and against the one with the commonest tokens, which joins most groups of near copies in linear work. Roots
with the same smallest set ``p`` become one node. If it holds several components and more than ``LEAVES`` sets, its
children are the rare tokens that its sets have beyond ``p``: of two linked sets that aren't both linked with ``p``,
no smaller than ``p``, the overlap within ``p`` alone can't reach what their sizes need, so they share such a token.
What all sets of a node have in common is thereby left out, and the split goes on for ``ROUNDS`` levels.

The sets of every node that is still open make a signature tree of fixed fan-out: an inner node holds the OR of its
sets' token bitmaps, their size range and greatest excess (tokens beyond the set bits), and the range of their
components. The dual traversal goes down level by level with a table of node pairs as its frontier. It drops a pair
whose greatest possible overlap is below the overlap that their sizes need, and one whose sets are of one component.
What is left at the bottom is checked on whole sets.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import Tables, fresh_names, stored
from plumeria.llm.components import connected_components
from plumeria.llm.words import ROWS, column_bytes, lean, mix, shingle_hashes, slices, word_hashes

#: 64-bit integers of a set's bitmap, and of an inner node's, which is folded.
LANES, NODE_LANES = 32, 8
#: Sets of a node that isn't split further; children of an inner node; the greatest depth of a signature tree.
LEAVES, FANOUT_BITS, DEPTH = 16, 4, 7
#: Texts whose sets a task holds at once.
SLICE = 128
#: The largest size of a level over that of the level before; contents left out, as a share of ``d``.
STEP, SPARE = 1.4, 0.6
#: Sets of a root, by the sketch, from which its rows are dealt by joins that adaptive execution splits.
HOT_ROOT = 4096
#: Levels of splits by tokens beyond the pivot.
ROUNDS = 2
#: The count sketch over all tokens has 2**SKETCH_BITS counters, summed in PARTS parts: 1 MB at the driver.
SKETCH_BITS, PARTS = 20, 64
#: Steps of rarity for a doubling of a count.
RARITY = 7.9
#: Documents up to which their ids are broadcast, 8 bytes each, to fetch their texts; more are joined by a shuffle.
FETCHED = 2_000_000


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    word, ends = word_hashes(*column_bytes(texts))
    return [np.unique(shingle_hashes(word[a:b], width)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _set_ids(sets: list[np.ndarray]) -> pa.Array:
    """A hash of each set; null for the empty one."""
    ids = np.array([np.sum(mix(x), dtype=np.uint64) ^ np.bitwise_xor.reduce(mix(~x), initial=0) for x in sets], np.uint64)
    return pa.array(ids.view(np.int64), mask=np.array([not len(x) for x in sets], bool))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _spots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _part_rows(total: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, places within it, counts) of the counters that aren't zero."""
    size = len(total) // PARTS
    for part in range(PARTS):
        counts = total[part * size : (part + 1) * size]
        places = np.flatnonzero(counts)
        if len(places):
            yield part, places, counts[places]


COUNTED = "doc_id long, n long, id long, part int, places binary, counts binary"


def _counted(width: int):
    """Every row's set size and set id; at the end of a task the counters of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNTED.split(", ")]
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in slices(batches, SLICE):
            sets = _sets(batch.column(1), width)
            spots, counts = np.unique(_spots(np.concatenate([np.empty(0, np.uint64), *sets])), return_counts=True)
            total[spots] += counts.astype(np.uint32)
            none = [pa.nulls(len(sets), x) for x in (pa.int32(), pa.binary(), pa.binary())]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), _set_ids(sets), *none]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        rows = list(_part_rows(total))
        columns = [pa.nulls(len(rows), pa.int64())] * 3 + [pa.array([x[0] for x in rows], pa.int32())]
        columns += [pa.array([x[k].astype("<u4").tobytes() for x in rows], pa.binary()) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of many tasks as those of one; counts beyond 32 bits stay at the greatest."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    size = len(total) // PARTS
    for batch in slices(batches, 8):
        for part, places, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            total[np.frombuffer(places, "<u4").astype(np.int64) + part * size] += np.frombuffer(counts, "<u4")
    rows = list(_part_rows(np.minimum(total, 0xFFFFFFFF)))
    columns = [pa.array([x[0] for x in rows], pa.int32())]
    columns += [pa.array([x[k].astype("<u4").tobytes() for x in rows], pa.binary()) for k in (1, 2)]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "places", "counts"])


def _rarity(counted: DataFrame) -> np.ndarray:
    """For each counter a byte that grows with its count over the whole corpus, 1 MB in all."""
    schema = "part int, places binary, counts binary"
    parts = counted.where("part IS NOT NULL").select("part", "places", "counts").mapInArrow(_summed, schema)
    parts = parts.repartition(PARTS, "part").mapInArrow(_summed, schema)
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    size = len(total) // PARTS
    for row in parts.collect():  # PARTS rows, 8 bytes a counter at most
        total[np.frombuffer(row["places"], "<u4").astype(np.int64) + row["part"] * size] += np.frombuffer(row["counts"], "<u4")
    return np.minimum(254, np.log2(1 + total) * RARITY).astype(np.uint8)


def _order(tokens: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The tokens as keys of one order over all of them: by rarity, then by hash."""
    return rarity[_spots(tokens)].astype(np.uint64) << np.uint64(56) | tokens >> np.uint64(8)


def _first(keys: np.ndarray, count: int) -> np.ndarray:
    return keys if count >= len(keys) else np.partition(keys, count - 1)[:count] if count > 0 else keys[:0]


class Levels:
    """Size levels for one threshold: bounds, segments of the token space and spare segments."""

    def __init__(self, percent: int):
        self.keep = Fraction(percent, 100)
        self.loss = (1 - self.keep) / (1 + self.keep)
        self.upper = [1]
        self._segments: list[tuple[int, int]] = []

    def of(self, size: int) -> list[int]:
        """The levels of a set: its own, and those in which a larger set may be its partner."""
        largest = int(size / self.keep)
        while self.upper[-1] < largest:
            self.upper.append(max(self.upper[-1] + 1, int(self.upper[-1] * STEP)))
        for upper in self.upper[len(self._segments) :]:
            differ = int(2 * upper * self.loss)
            spare = int(SPARE * differ)
            self._segments.append((differ + 1 + spare if differ else 0, spare))
        low = bisect_left(self.upper, size)
        return [low, *(i for i in range(low + 1, len(self.upper)) if self.upper[i - 1] < largest)]

    def segments(self, level: int) -> tuple[int, int]:
        """The segments of the token space, and how many of their contents a set leaves out."""
        return self._segments[level]


def _roots(tokens: np.ndarray, rarity: np.ndarray, levels: Levels) -> np.ndarray:
    """The roots of a sorted set of tokens: its rarest contents at its levels, the rarity in the highest byte."""
    found = []
    common = rarity[_spots(tokens)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    for level in levels.of(len(tokens)):
        parts, spare = levels.segments(level)
        if not parts:
            continue
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as the tokens are
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        sized = np.diff(cuts)
        place = np.arange(parts, dtype=np.uint64) + np.uint64(level << 40)
        content = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(place * np.uint64(0x9E3779B97F4A7C15) + sized.astype(np.uint64)))
        rare = np.full(parts, 255, np.uint64)  # an empty segment is the commonest content
        full = sized > 0
        rare[full] = np.minimum.reduceat(common, cuts[:-1][full])
        found.append(_first(rare << np.uint64(56) | content >> np.uint64(8), parts - spare))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _rooted(width: int, percent: int, shared):
    """(id, sized, roots) of every set that isn't empty; ``sized`` packs its size and how common its tokens are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, levels = shared.value, Levels(percent)
        for batch in slices(batches, SLICE):
            sets = [x for x in _sets(batch.column(0), width) if len(x)]
            columns = [_set_ids(sets), pa.array([_sized(x, rarity) for x in sets], pa.int64())]
            columns.append(_lists([_roots(x, rarity, levels) for x in sets]))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "sized", "roots"])

    return run


def _sized(tokens: np.ndarray, rarity: np.ndarray) -> int:
    return len(tokens) << 16 | int(rarity[_spots(tokens)].mean() * 256)


def _leaves(width: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in slices(batches, SLICE):
            sets = [x for x in _sets(batch.column(0), width) if len(x)]
            maps = np.zeros((len(sets), LANES * 64), np.uint8)
            for row, tokens in zip(maps, sets, strict=True):
                row[(tokens % np.uint64(LANES * 64)).astype(np.int64)] = 1
            bits = np.packbits(maps, axis=1).view(np.uint64)
            size = np.array([len(x) for x in sets], np.int64)
            excess = size - maps.sum(axis=1, dtype=np.int64)
            sized = [_sized(x, rarity) for x in sets]
            code = [_code(_first(_order(x, rarity), max(1, len(x) // 4))) for x in sets]
            columns = [_set_ids(sets), pa.array(size), pa.array(sized, pa.int64()), pa.array(code, pa.int64())]
            columns += [pa.array(excess), _lists(list(bits)), _lists(sets)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in LEAF.split(", ")])

    return run


LEAF = "id long, n long, sized long, code long, excess long, bits array<long>, tokens array<long>"


def _code(rare: np.ndarray) -> int:
    """A set's way down a signature tree: least hashes of its rarer tokens, one digit for each level."""
    code = 0
    for level in range(DEPTH):
        least = int(mix(rare + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)).min())
        code = code << FANOUT_BITS | int(mix(np.array([least], np.uint64))[0]) & (1 << FANOUT_BITS) - 1
    return code


def least_shared(n: int, p: int, common: int, percent: int) -> int:
    """The least number of tokens beyond a pivot that a set shares with any set it may be linked with.

    The set has ``n`` tokens, the pivot ``p`` and no more than the other set, and ``common`` are in both. Not for two
    sets that are both linked with the pivot: they are of one component anyway.
    """
    other = max(p, -(-percent * n // 100))
    least = max(1, -(-percent * (n + other) // (100 + percent)) - common)
    if 100 * common >= percent * (n + p - common):  # the other set isn't linked with the pivot
        least = max(least, percent * (n - p) // (100 + percent) + 1)
    return least


def _beyond(percent: int, shared):
    """(g, id, sized, component) for the rare tokens that a set of node ``g`` has beyond the node's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in slices(batches, 256):
            pivot = batch.column(0).to_numpy().view(np.uint64)
            found = []
            for i, (a, b) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                mine, its = (np.asarray(x.values).view(np.uint64) for x in (a, b))
                own = np.setdiff1d(mine, its, assume_unique=True)
                need = least_shared(len(mine), len(its), len(mine) - len(own), percent)
                found.append(mix(_first(_order(own, rarity), len(own) - need + 1) ^ mix(pivot[i : i + 1])))
            columns = [_lists(found), *(batch.column(i) for i in (1, 2, 5))]
            yield pa.RecordBatch.from_arrays(columns, names=["roots", "id", "sized", "component"])

    return run


def _may_link(percent: int, x: Column, y: Column, lanes: int) -> Column:
    """Whether the greatest possible overlap of two nodes reaches the overlap that their sizes need.

    Sets overlap by no more than the bits that the ORs share and the lesser excess.
    """
    common = reduce(lambda a, b: a + b, [F.bit_count(x["any"][i].bitwiseAND(y["any"][i])) for i in range(lanes)])
    needed = (x["low"] + y["low"]) * percent <= (common + F.least(x["excess"], y["excess"])) * (100 + percent)
    return (x["high"] * 100 >= y["low"] * percent) & (y["high"] * 100 >= x["low"] * percent) & needed


def _verified(pairs: DataFrame, leaves: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps and then whose whole sets reach the threshold."""
    shape = F.struct(F.col("n").alias("low"), F.col("n").alias("high"), "excess", F.col("bits").alias("any"))
    one = leaves.select(F.col("id").alias("a"), shape.alias("x"))
    two = leaves.select(F.col("id").alias("b"), shape.alias("y"))
    passed = pairs.join(two, "b").join(one, "a").where(_may_link(percent, F.col("x"), F.col("y"), LANES)).select("a", "b")
    one = leaves.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    two = leaves.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    linked = both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent
    return passed.join(two, "b").join(one, "a").where(linked).select("a", "b")


def _met(rooted: DataFrame) -> DataFrame:
    """``rooted`` (g, id, sized, component), without repeats, where ``g`` holds several components."""
    held = rooted.groupBy("g").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u < v")
    return rooted.join(held.select("g").hint("merge"), "g").dropDuplicates(["g", "id"])


def _members(met: DataFrame) -> DataFrame:
    """``met`` with the pivots of g.

    p, p_n, p_of: the smallest set, its size and component; c, c_n, c_of: those of the set with the commonest tokens;
    held: the sets of g.
    """
    low = F.col("id").bitwiseAND(F.lit(0xFFFFFFFF))
    small = F.shiftleft(F.shiftright("sized", 16), 32).bitwiseOR(low)
    central = F.shiftleft(F.col("sized").bitwiseAND(F.lit(0xFFFF)), 32).bitwiseOR(low)
    pivots = met.groupBy("g").agg(
        F.min_by("id", small).alias("p"), F.min(F.shiftright("sized", 16)).alias("p_n"), F.min_by("component", small).alias("p_of"),
        F.max_by("id", central).alias("c"), F.max_by(F.shiftright("sized", 16), central).alias("c_n"),
        F.max_by("component", central).alias("c_of"), F.count("*").alias("held"),
    )
    return met.withColumn("n", F.shiftright("sized", 16)).join(pivots, "g")


def _spokes(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): every set and the pivots of its nodes of other components, where their sizes allow a link."""
    fits = lambda k: (F.col(k) * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col(k) * percent)
    to_small = members.where("id <> p AND component <> p_of").where(fits("p_n")).select(F.col("p").alias("a"), F.col("id").alias("b"))
    to_centre = members.where("held > 2 AND id <> c AND c <> p AND component <> c_of").where(fits("c_n")).select(F.col("c").alias("a"), F.col("id").alias("b"))
    pairs = to_small.unionByName(to_centre)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _side(df: DataFrame, suffix: str, keep: tuple[str, ...] = ("g",)) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{c}_{suffix}") for c in df.columns])


def _node(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Inner nodes over ``rows``: the OR of folded bitmaps, size range, greatest excess, range of components."""
    lanes = [F.bit_or(F.col("node.any")[i]).alias(f"any{i}") for i in range(NODE_LANES)]
    made = rows.groupBy(*keys).agg(
        F.min("node.low").alias("low"), F.max("node.high").alias("high"), F.max("node.excess").alias("excess"),
        F.min("u").alias("u"), F.max("v").alias("v"), *lanes,
    )
    folded = F.array(*[f"any{i}" for i in range(NODE_LANES)]).alias("any")
    return made.select(*keys, "u", "v", F.struct("low", "high", "excess", folded).alias("node"))


def _traversed(groups: DataFrame, leaves: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(a, b): the pairs of sets that the dual traversal of every node's signature tree is left with.

    ``groups``: (g, id, component). A tree is as deep as its number of sets needs.
    """
    counts = groups.groupBy("g").agg(F.count("*").alias("held"), F.min("component").alias("u"), F.max("component").alias("v"))
    depth = F.ceil(F.log(F.col("held") / LEAVES) / math.log(1 << FANOUT_BITS)).cast("int")
    counts = counts.where("u < v AND held > 2").select("g", F.least(F.greatest(depth, F.lit(0)), F.lit(DEPTH)).alias("depth"))
    cell = F.expr(f"shiftright(code, {FANOUT_BITS} * ({DEPTH} - depth))").alias("cell")
    sets = groups.join(counts, "g").join(leaves.select("id", "n", "code"), "id").select("g", "id", "component", "n", "depth", "code", cell)
    sets = tables.store(sets, "trees")
    deepest = sets.agg(F.max("depth").alias("d")).first()["d"] or 0

    def bottom(x: DataFrame) -> DataFrame:
        ordered = (F.col("component_x") != F.col("component_y")) & (F.col("id_x") < F.col("id_y"))
        fits = (F.col("n_x") * 100 >= F.col("n_y") * percent) & (F.col("n_y") * 100 >= F.col("n_x") * percent)
        return x.where(ordered & fits).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))

    slim = sets.select("g", "depth", "cell", "id", "component", "n")
    flat = slim.where("depth = 0").drop("depth", "cell")
    found = [bottom(_side(flat, "x").join(_side(flat, "y"), "g"))]
    if deepest:
        bits = F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [F.col("bits")[i + k] for k in range(0, LANES, NODE_LANES)]) for i in range(NODE_LANES)])
        excess = F.col("n") - F.aggregate("any", F.lit(0), lambda total, lane: total + F.bit_count(lane))
        small = leaves.select("id", "n", bits.alias("any"))
        small = small.select("id", F.struct(F.col("n").alias("low"), F.col("n").alias("high"), excess.alias("excess"), "any").alias("node"))
        inner = sets.where("depth > 0").select("g", "id", "depth", "cell", F.col("component").alias("u"), F.col("component").alias("v"))
        nodes = {0: tables.store(_node(inner.join(small, "id"), ["g", "depth", "cell"]), "nodes")}
        up = nodes[0].withColumn("height", F.lit(0))
        levels = [up]
        for height in range(1, deepest + 1):  # cells of the level above
            above = up.where(F.col("depth") > height - 1).withColumn("cell", F.shiftright("cell", FANOUT_BITS))
            up = _node(above, ["g", "depth", "cell"]).withColumn("height", F.lit(height))
            levels.append(up)
        every = tables.store(reduce(DataFrame.unionByName, levels), "nodes")
        frontier = every.where("height = depth").select("g", "depth", F.col("cell").alias("x"), F.col("cell").alias("y"))
        for level in range(1, deepest + 1):  # from the roots' children down
            now = every.where(F.col("height") == F.col("depth") - level).select("g", "cell", "u", "v", "node", F.shiftright("cell", FANOUT_BITS).alias("up"))
            one, two = _side(now, "x"), _side(now, "y")
            pairs = frontier.withColumnRenamed("x", "up_x").withColumnRenamed("y", "up_y").join(one, ["g", "up_x"]).join(two, ["g", "up_y"])
            several = (F.least("u_x", "u_y") < F.greatest("v_x", "v_y")) & (F.col("cell_x") <= F.col("cell_y"))
            pairs = pairs.where(several & _may_link(percent, F.col("node_x"), F.col("node_y"), NODE_LANES))
            frontier = tables.store(pairs.select("g", "depth", F.col("cell_x").alias("x"), F.col("cell_y").alias("y")), "frontier")
            own = _side(slim.where(F.col("depth") == level).drop("depth"), "x"), _side(slim.where(F.col("depth") == level).drop("depth"), "y")
            at = frontier.where(F.col("depth") == level).select("g", F.col("x").alias("cell_x"), F.col("y").alias("cell_y"))
            # Both orders of a pair of nodes, as the lesser id may be in either.
            at = at.unionByName(at.where("cell_x <> cell_y").select("g", F.col("cell_y").alias("cell_x"), F.col("cell_x").alias("cell_y")))
            found.append(bottom(at.join(own[0], ["g", "cell_x"]).join(own[1], ["g", "cell_y"])))
    return reduce(DataFrame.unionByName, found).distinct()


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A text's set holds the distinct runs of ``width`` words; words are runs of bytes other than ASCII white space,
    with A-Z in lower case. A text of fewer words has its whole sequence as its one shingle; without words, or null,
    the set is empty and linked with nothing. Two texts link when ``100 * intersection >= percent * union``.
    component_id is the smallest doc_id reachable by links, the document's own included. Copies share one leaf.
    A repeated doc_id gives a row for each of its rows, each with its own set; an empty table gives an empty result; a
    null doc_id takes part in links, and its component is null where no row of it has an id. Other columns are ignored,
    whatever their names. Shingles and sets are compared by 64-bit hashes.
    """
    placed = _placed(docs, width, percent, text, doc_id)
    # The smallest doc_id of each component; both joins are of stored tables, so adaptive execution splits hot groups.
    least = stored(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    named = placed.where("n > 0").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = placed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)


def _placed(docs: DataFrame, width: int, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, id, component) for every row of ``docs``: its set's size, the set, and the component of sets."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = tables.store(source.mapInArrow(lean(_counted(width)), COUNTED), "rows")
    rows = counted.where("part IS NULL").select("doc_id", "n", "id")
    shared = spark.sparkContext.broadcast(_rarity(counted))
    first = Tables(spark, "jaccard-sets")
    sets = first.store(source.select("text").mapInArrow(lean(_rooted(width, percent, shared)), "id long, sized long, roots array<long>"), "sets")
    rooted = sets.select(F.explode("roots").alias("g"), "id", "sized", F.col("id").alias("component"))
    # A root that isn't hot has few sets, by the sketch: its rows can meet in one task, in one shuffle.
    hot = F.shiftrightunsigned("g", 56) >= int(math.log2(1 + HOT_ROOT) * RARITY)
    met = _met(rooted.where(~hot).repartition("g")).unionByName(_met(rooted.where(hot)))
    met = tables.store(met, "met")
    first.drop()
    members = tables.store(_members(met), "members")

    # One document of each of these sets, and its leaf.
    wanted = members.select("id").distinct()
    fetched = rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    fetched = tables.store(fetched.select("doc_id").distinct(), "fetched")
    if fetched.count() <= FETCHED:
        fetched = F.broadcast(fetched)
    texts = source.join(fetched, source["doc_id"].eqNullSafe(fetched["doc_id"]), "left_semi").select("text")
    leaves = tables.store(texts.mapInArrow(lean(_leaves(width, shared)), LEAF).dropDuplicates(["id"]), "leaves")

    links, tested, open_ = [], [], []
    for level in range(ROUNDS + 1):
        spokes = tables.store(_spokes(members, percent), "spokes")
        tested.append(spokes)
        links.append(tables.store(_verified(spokes, leaves, percent), "links"))
        known = connected_components(reduce(DataFrame.unionByName, links))
        # Nodes: all sets that share a smallest set; two alone have met already.
        own = members.where("held > 2").select(F.col("p").alias("g"), "id", "sized").distinct()
        own = own.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        own = tables.store(own, "own")
        mixed = own.groupBy("g").agg(F.min("component").alias("u"), F.max("component").alias("v"), F.count("*").alias("held"))
        mixed = mixed.where("u < v AND held > 2").select("g", "held")
        nodes = tables.store(own.join(mixed, "g"), "nodes")
        last = level == ROUNDS
        open_.append((nodes if last else nodes.where(F.col("held") <= LEAVES)).select("g", "id"))
        large = nodes.where(F.col("held") > LEAVES)
        if last or large.isEmpty():
            break
        its = leaves.select(F.col("id").alias("g"), F.col("tokens").alias("its"))
        pairs = large.where("id <> g").join(its, "g").join(leaves.select("id", "tokens"), "id")
        pairs = pairs.select("g", "id", "sized", "tokens", "its", "component")
        split = pairs.mapInArrow(lean(_beyond(percent, shared)), "roots array<long>, id long, sized long, component long")
        split = tables.store(split, "split")
        rooted = split.select(F.explode("roots").alias("g"), "id", "sized", "component")
        members = tables.store(_members(tables.store(_met(rooted), "met")), "members")

    # What no pivot has settled: trees, traversed in pairs of nodes.
    groups = reduce(DataFrame.unionByName, open_).join(known, "id", "left").select("g", "id", F.coalesce("component", "id").alias("component"))
    groups = tables.store(groups.distinct(), "groups")
    pairs = _traversed(groups, leaves, percent, tables)
    pairs = tables.store(pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti"), "pairs")
    links.append(tables.store(_verified(pairs, leaves, percent), "links"))
    final = connected_components(reduce(DataFrame.unionByName, links))
    placed = rows.join(final, "id", "left").select("doc_id", "n", "id", F.coalesce("component", "id").alias("component"))
    placed = stored(placed, "jaccard-placed")
    tables.drop()
    return placed


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near copies, with all their columns.

    Of a group one row stays, that with the smallest doc_id; one with a null doc_id only in a group without ids. Rows
    without words stay. Rows are told apart by doc_id, and by their sets too where an id, or null, has several rows;
    of rows that are equal in both one stays. Other columns may have any names.
    """
    id_, id_set, own_set = fresh_names(docs, "id_", "set_", "own_set")
    placed = _placed(docs, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("d"), F.col("id").alias("i"))).alias("first")
    firsts = stored(placed.where("n > 0").groupBy("component").agg(first), "jaccard-first")
    rows = placed.join(firsts, "component", "left")
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("id") == F.col("first.i")))
    rows = rows.select("doc_id", "id", stays.alias("stays"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.bool_or("stays").alias("stays"))
    ids = stored(ids.where("n_rows > 1 OR NOT stays").select(F.col("doc_id").alias(id_), "stays"), "jaccard-ids")
    own = F.col("doc_id").cast("long")
    one = docs.join(ids.select(id_), own.eqNullSafe(F.col(id_)), "left_anti")
    several = ids.where("stays").select(id_)
    if several.isEmpty():
        return one
    wanted = rows.where("stays").join(several, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    wanted = wanted.select(F.col("doc_id").alias(id_), F.col("id").alias(id_set)).distinct()

    @F.arrow_udf("long")
    def set_id(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.int64())
        return pa.concat_arrays([_set_ids(_sets(texts[at : at + ROWS], width)) for at in range(0, len(texts), ROWS)])

    named = docs.join(several, own.eqNullSafe(F.col(id_)), "left_semi").withColumn(own_set, set_id(F.col("text").cast("string")))
    found = named.join(wanted, own.eqNullSafe(F.col(id_)) & F.col(own_set).eqNullSafe(F.col(id_set)), "left_semi")
    kept = found.where(F.col(own_set).isNotNull()).dropDuplicates(["doc_id", own_set]).unionByName(found.where(F.col(own_set).isNull()))
    return one.unionByName(kept.drop(own_set))
