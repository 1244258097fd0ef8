"""Choices that depend on the choices before them, made for each request alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number


def mmr(candidates: DataFrame, request: str, k: int, weight: float = 0.7, pool: int = 4) -> DataFrame:
    """(request, place, item, score): maximal marginal relevance over the ``pool * k`` best of each request.

    ``candidates`` has request, item, score and emb; the pool is cut before the groups are formed, so a group is at
    most ``pool * k`` rows. Scores are scaled to 0 .. 1 in the pool; with k candidates or fewer the score decides.
    Ties go to the earlier place in the pool (higher score, then lower item).
    """
    w = Window.partitionBy(request).orderBy(F.desc("score"), "item")
    best = candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pool * k)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_r")
        score = group["score"].to_numpy(float)
        if len(group) > k:
            spread = score.max() - score.min()
            gain = (score - score.min()) / spread if spread > 0 else np.ones(len(score))
            vectors = np.stack(group["emb"].to_numpy()).astype(float)
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.where(size > 0, size, 1)
            taken, nearest = [], np.zeros(len(group))
            free = np.ones(len(group), bool)
            for step in range(k):
                value = np.where(free, weight * gain - (1 - weight) * nearest, -np.inf)
                best_ = int(np.argmax(value))
                taken.append(best_)
                free[best_] = False
                likeness = vectors @ vectors[best_]
                nearest = likeness if step == 0 else np.maximum(nearest, likeness)
            group = group.iloc[taken]
        return pd.DataFrame({request: group[request], "place": np.arange(len(group)), "item": group["item"], "score": group["score"]})

    kind = dict(candidates.dtypes)
    schema = f"{request} {kind[request]}, place long, item {kind['item']}, score {kind['score']}"
    return best.groupBy(request).applyInPandas(choose, schema)


def round_robin(lists: DataFrame, request: str, sources: list[str], cap: int) -> DataFrame:
    """(request, place, item, source): sources take turns, each with its first item that isn't there yet.

    ``lists`` has request, source, rank and item. A source needs no more than its first ``cap`` items, as each of its
    items is either new or there already.
    """
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    kept = lists.where((F.col("rank") < cap) & F.col("source").isin(sources))
    grouped = kept.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "rank", "item"))).alias("l"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, listed in zip(batch[request], batch["l"], strict=True):
                queues = {o: [] for o in range(1, len(sources) + 1)}
                for x in listed:
                    queues[x["o"]].append(x["item"])
                live, seen = {o: iter(q) for o, q in queues.items()}, set()
                while live and len(seen) < cap:
                    for o in list(live):
                        item = next((x for x in live[o] if x not in seen), None)
                        if item is None:
                            del live[o]
                            continue
                        rows.append((key, len(seen), item, sources[o - 1]))
                        seen.add(item)
                        if len(seen) >= cap:
                            break
            yield pd.DataFrame(rows, columns=[request, "place", "item", "source"])

    kind = dict(lists.dtypes)
    return grouped.mapInPandas(merge, f"{request} {kind[request]}, place long, item {kind['item']}, source string")


def deterministic_propensity(rank: Column, position: Column, slate: Column, explore: Column) -> Column:
    """The chance that the item of this rank stands at this place when ``explore`` places are drawn at random."""

    def choose(n: Column, k: Column) -> Column:
        fact = lambda x: F.factorial(x.cast("int")).cast("double")
        return F.when((k < 0) | (k > n) | (n < 0), 0.0).otherwise(fact(n) / (fact(k) * fact(n - k)))

    shift = position - rank
    ways = choose(position, shift) * choose(slate - position - 1, explore - shift) / choose(slate, explore)
    impossible = (rank < 0) | (rank >= slate - explore) | (shift < 0) | (shift > explore) | (position >= slate)
    return F.when(impossible, 0.0).otherwise(ways)


def exploration_slate(ranked: DataFrame, request: str, k: int, explore: int, seed: int = 0) -> DataFrame:
    """(request, position, item, explored, propensity) from ranked candidates (request, item, rank from 0).

    ``explore`` places and as many items outside of the deterministic ones are drawn uniformly, by repeatable hashes;
    the other places are filled in order of rank. No Python: draws are windows over a request's candidates.
    """
    size = F.count("*").over(Window.partitionBy(request))
    sized = ranked.withColumn("slate", F.least(size, F.lit(k))).withColumn("m", F.least(F.col("slate"), F.lit(explore)))
    sized = sized.withColumn("pool", size - (F.col("slate") - F.col("m")))
    fixed = sized.where(F.col("rank") < F.col("slate") - F.col("m"))
    drawn = sized.where(F.col("rank") >= F.col("slate") - F.col("m"))
    by_item = Window.partitionBy(request).orderBy(md5_number(F.lit(seed), F.lit("item"), F.col(request), F.col("item")), "item")
    drawn = drawn.withColumn("n", F.row_number().over(by_item) - 1).where(F.col("n") < F.col("m"))
    shapes = sized.groupBy(request).agg(F.first("slate").alias("slate"), F.first("m").alias("m"), F.first("pool").alias("pool"))
    places = shapes.withColumn("position", F.explode(F.sequence(F.lit(0), F.col("slate") - 1)))
    by_place = Window.partitionBy(request).orderBy(md5_number(F.lit(seed), F.lit("place"), F.col(request), F.col("position")), "position")
    places = places.withColumn("explored", F.row_number().over(by_place) <= F.col("m"))
    turn = F.row_number().over(Window.partitionBy(request, "explored").orderBy("position")) - 1
    places = places.withColumn("n", turn)
    a = places.where("explored").join(drawn.select(request, "n", "item"), [request, "n"])
    a = a.select(request, "position", "item", "explored", (F.col("m") / F.col("slate") / F.col("pool")).alias("propensity"))
    b = places.where("NOT explored").join(fixed.select(request, F.col("rank").alias("n"), "item"), [request, "n"])
    p = deterministic_propensity(F.col("n"), F.col("position"), F.col("slate"), F.col("m"))
    return a.unionByName(b.select(request, "position", "item", "explored", p.alias("propensity")))


def token_vector(token: str, size: int = 16) -> np.ndarray:
    """A repeatable unit vector for a token."""
    seed = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "little")
    vector = np.random.default_rng(seed).standard_normal(size)
    return vector / np.linalg.norm(vector)
