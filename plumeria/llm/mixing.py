"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule goes to the source in whose part of the cumulative targets the golden-ratio point
``frac(i * 0.618...)`` falls, so every stretch of slots holds the sources close to their targets. A slot's rank among
its source's slots names the block that it takes: a source's documents are shuffled and laid end to end, again from
the start where the target exceeds them, and its target is cut into as many equal blocks (to a word) as it has slots.
Positions come from prefix sums in two steps, over hash buckets and within them, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import fresh_names, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 512
#: The step between points of the schedule, the golden ratio less 1.
GOLDEN = 0.6180339887498949
#: Parts of the unit interval by which slots meet sources, and slots that are ranked together.
_CELLS, _CHUNK = 4096, 1 << 16


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """(key, source, source_size, target) for (key, source, size): the share of all sizes, dealt by weight.

    Sources in code point order, null last, take ``weights`` in turn. A target stops at ``repeats`` times its source's
    size, and the excess goes to the others by weight until none is above: with the sources in order of size over
    weight, the level at which the rest fits is the first that its own source doesn't cut. The windows run over one
    row a source.
    """
    sums = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size").cast("double") * repeats
    one = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    one = one.withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    goal = F.sum("source_size").over(every).cast("double") * share
    cut = F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    one = one.withColumn("fits", (goal - cut) / rest)
    level = F.coalesce(F.min(F.when(F.col("fits") <= F.col("level"), F.struct("level", "fits"))).over(every)["fits"], F.max("level").over(every))
    target = F.least(F.col("cap"), level * F.col("weight"))
    return one.select("key", "source", "source_size", F.greatest(F.lit(0.0), target).alias("target"))


def _prefix(rows: DataFrame, by: str, part: str, amount: Column, order: list[Column]) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of ``by`` that come earlier, part by part."""
    sums = rows.groupBy(by, part).agg(F.sum(amount).alias("_in_part"))
    earlier = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, part, F.coalesce(F.sum("_in_part").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(sums, [by, part])
        .withColumn("before", F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_base")
    )


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS, golden: float = GOLDEN) -> DataFrame:
    """(slot, key, rank, first, last): the words ``first`` to ``last - 1`` of its source that each slot takes."""
    if not 0 < golden < 1:
        raise ValueError("the step between points must lie between 0 and 1")
    spark = targets.sparkSession
    words = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    slots = int(words // block_words) + 1 if words else 0
    whole = Window.partitionBy()
    upto = F.sum("target").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    shares = targets.where("target > 0").withColumn("to", upto / F.sum("target").over(whole))
    shares = shares.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("to", F.col("source").asc_nulls_last())), F.lit(0.0)))
    shares = shares.withColumn("to", F.when(F.col("to") == F.max("to").over(whole), F.lit(2.0)).otherwise(F.col("to")))
    cells = F.sequence((F.col("from") * _CELLS).cast("int"), F.least(F.col("to") * _CELLS, F.lit(_CELLS - 1)).cast("int"))
    parts = shares.select("key", "from", "to", F.explode(cells).alias("cell"))
    point = F.col("id") * F.lit(golden)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    points = points.withColumn("cell", (F.col("u") * _CELLS).cast("int"))
    dealt = points.join(parts, "cell").where("u >= from AND u < to").select("slot", "key")
    # A source too small for any slot gets one at the end.
    late = targets.where("target > 0").select("key").join(dealt, "key", "left_anti")
    late = late.select((F.lit(slots) + F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("slot"), "key")
    every = dealt.unionByName(late).withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    ranked = _prefix(every, "key", "chunk", F.lit(1), [F.col("slot")]).withColumnRenamed("before", "rank")
    counted = ranked.join(every.groupBy("key").agg(F.count("*").alias("n_slots")), "key")
    cut = counted.join(targets.select("key", F.round("target").cast("long").alias("words")), "key")
    cut = cut.withColumn("least", F.expr("words div n_slots")).withColumn("more", F.expr("words % n_slots"))
    first = F.col("rank") * F.col("least") + F.least("rank", "more")
    last = first + F.col("least") + (F.col("rank") < F.col("more")).cast("long")
    return cut.select("slot", "key", "rank", first.alias("first"), last.alias("last"), "least", "more", "words")


def _rank_of(word: str) -> Column:
    """The rank of the slot that takes a word of a source's line."""
    return F.expr(
        f"CASE WHEN {word} < more * (least + 1) THEN {word} div (least + 1) "
        f"ELSE more + ({word} - more * (least + 1)) div least END"
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: doc_id, key, size, source_size, target, taken, first_slot, position, one row for each row of ``docs``;
    taken counts the words that the mix takes of it, repeats included, and never exceeds ``repeats`` times its size;
    first_slot is the slot of the schedule in which the mix first comes to it, null where it never does. pieces: slot,
    key, rank, doc_id, position, begin, end: the words of a document that a slot takes, in order of slot the mix
    itself. A null text has size 0, a null source is a source of its own that comes last; sources whose documents are
    all empty have target 0. Documents are shuffled by the MD5 of seed and doc_id, so reruns agree; rows that share a
    doc_id follow one another by size. An empty table gives empty results. Other columns are ignored.
    """
    name = F.col(source).cast("string")
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.when(name.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), name)).alias("key"),
        name.alias("source"),
        word_count(F.col(text).cast("string")).alias("size"),
    )
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    slim = slim.withColumn("hash", shuffled).withColumn("bucket", F.substring("hash", 1, 4))
    slim = stored(slim, "mix-sizes")
    targets = stored(source_targets(slim, weights, share, repeats), "mix-targets")
    slots = stored(schedule(targets, block_words), "mix-slots")
    laid = _prefix(slim, "key", "bucket", F.col("size"), [F.col("hash"), F.col("doc_id"), F.col("size")])
    laid = laid.select("doc_id", "key", "size", F.col("before").alias("position"))
    placed = stored(laid.join(targets.select("key", "source_size", "target"), "key"), "mix-places")

    cut = slots.select("key", "least", "more", "words").distinct()
    times = placed.where("size > 0").join(cut, "key")
    times = times.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    times = times.withColumn("x", F.expr("position + round * source_size"))
    times = times.withColumn("y", F.least(F.col("x") + F.col("size"), F.col("words"))).where("x < y")
    times = times.withColumn("rank", F.explode(F.sequence(_rank_of("x"), _rank_of("(y - 1)"))))
    pieces = times.select("key", "rank", "doc_id", "position", "x", "y").join(
        slots.select("slot", "key", "rank", "first", "last"), ["key", "rank"]
    )
    begin, end = F.greatest("x", "first"), F.least("y", "last")
    pieces = pieces.select(
        "slot", "key", "rank", "doc_id", "position", (begin - F.col("x")).alias("begin"), (end - F.col("x")).alias("end")
    ).where("begin < end")
    taken = pieces.groupBy("key", "position").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"), F.min("slot").alias("first_slot"))
    full = placed.where("size > 0").join(taken, ["key", "position"], "left")
    documents = full.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).unionByName(
        placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    )
    return documents, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, rounded to whole documents, half up.

    Rows that share doc_id, source and size come as often as the most taken of them. Other columns may have any names.
    """
    id_, key_, size_, copies_, copy_ = fresh_names(docs, "id_", "key_", "size_", "copies_", "copy_")
    documents, _ = mix(docs, **options)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    wanted = documents.where("size > 0").groupBy("doc_id", "key", "size").agg(F.max(copies).alias(copies_))
    wanted = wanted.where(F.col(copies_) > 0).select(F.col("doc_id").alias(id_), F.col("key").alias(key_), F.col("size").alias(size_), copies_)
    name = F.col("source").cast("string")
    key = F.when(name.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), name))
    joined = docs.join(
        wanted,
        F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (key == F.col(key_)) & (word_count(F.col("text").cast("string")) == F.col(size_)),
    )
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies_))).alias(copy_)).drop(copy_)
