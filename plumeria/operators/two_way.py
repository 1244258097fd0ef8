"""Two-way splits of many clusters at once, and the decision whether to make them.

Lloyd's rounds run over all clusters and all their seeded starts together: a row is a point, a start is the plane
between its two centres, and a round is one join of points with planes and one partial sum for each (cluster, start).
Vectors count as whole numbers of 2**-20 and distances of 2**-24, so sums don't depend on the order of rows, equal
splits have equal gains and a start has ended when its sums stay the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions import fuzzy, text, vectors
from plumeria.functions.scores import md5_number
from plumeria.operators.rounds import cut

STARTS, ROUNDS, SEED = 10, 100, 42
#: Points of a block, and how many parts a whole number of a vector and of a distance has.
BLOCK, PARTS, FINE = 512, 1 << 20, 1 << 24

#: Words that name no topic (fixed values).
STOPWORDS = (
    "있다", "없다", "했다", "한다", "됐다", "된다", "이번", "오늘", "내일", "어제", "관련", "대한", "통해", "위해", "기준",
    "가능", "필요", "전망", "확대", "강화", "추진", "논란", "갈등", "문제", "발표", "공개", "확인", "진행", "조치", "대응", "검토", "주목",
    "정부", "국회", "대통령", "위원회", "당국", "업계", "시장", "증가", "감소", "상승", "하락",
)
#: What a word is, what is left out of a title, and the names of a side that are compared (fixed values).
WORD, ASIDE, MARKS, NAMES = r"[가-힣A-Za-z0-9]{2,}", r"\[[^\]]+\]|\([^)]*\)", r"[\s\-_·—–,.:;!?\"'`~]+", 8
#: Three points: the furthest stands out, and its names or distance differ (fixed values).
OUT_RATIO, OUT_DELTA, OUT_NAMES, OUT_DISTANCE = 1.35, 0.20, 0.18, 1.20
#: Never split above the first two, always with the next three (fixed values).
VETO_NAMES, VETO_TITLES, FORCE_NAMES, FORCE_SILHOUETTE, FORCE_POINTS = 0.55, 0.50, 0.12, 0.18, 5
#: The score from which on a cluster is split, in hundredths (fixed value).
ENOUGH = 180


def _squares(a: Column) -> Column:
    return vectors.dot(a, a)


def _plane(a: Column, b: Column) -> Column:
    """The direction from ``a`` to ``b`` and the product with it up to which a point is nearer to ``a``, or as near."""
    return F.struct(F.zip_with(a, b, lambda x, y: y - x).alias("w"), ((_squares(b) - _squares(a)) / 2).alias("c"))


def _near(vec: Column, plane: Column) -> Column:
    return vectors.dot(vec, plane["w"]) <= plane["c"]


def _real(whole: Column, over: Column) -> Column:
    return F.transform(whole, lambda x: x.cast("double") / over)


def _whole_points(points: DataFrame, size: int) -> DataFrame:
    """(cluster, id, vec, title), one row for each (cluster, id), with ``size`` whole numbers as its vector."""
    good = points.where("cluster IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    one = good.groupBy(F.col("cluster").cast("long").alias("cluster"), F.col("id").cast("long").alias("id")).agg(
        F.min(F.struct(F.col("vec").cast("array<double>").alias("vec"), F.coalesce("title", F.lit("")).alias("title"))).alias("p")
    )
    whole = F.array(*[F.coalesce(F.rint(F.get("p.vec", F.lit(i)) * PARTS).cast("long"), F.lit(0).cast("long")) for i in range(size)])
    return one.select("cluster", "id", whole.alias("vec"), F.col("p.title").alias("title"))


def _totals(points: DataFrame, size: int, *by: str) -> DataFrame:
    """(by, n, s): the number of points and the sum of their vectors."""
    sums = points.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.get("vec", F.lit(i))).alias(f"e{i}") for i in range(size)])
    return sums.select(*by, "n", vectors.gathered(size).alias("s"))


def _starts(points: DataFrame, starts: int, seed: int) -> DataFrame:
    """(cluster, start, plane): between a point drawn by a hash and one drawn with the square of its distance to it."""
    u = lambda which: (md5_number(F.lit(seed), F.lit(which), F.col("start"), F.col("id")) + 0.5) / 4294967296.0
    each = points.select("cluster", "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    first = each.groupBy("cluster", "start").agg(F.min_by(F.col("vec"), F.struct(u(0), "id")).alias("a"))
    of = first.groupBy("cluster").agg(F.collect_list(F.struct("start", "a")).alias("firsts"))  # ``starts`` of them
    away = points.join(of, "cluster").select("cluster", "id", "vec", F.inline("firsts"))
    away = away.withColumn("d", _squares(F.zip_with("vec", "a", lambda x, y: x - y))).where("d > 0")
    second = away.groupBy("cluster", "start").agg(F.first("a").alias("a"), F.min_by(F.col("vec"), F.struct(-F.log(u(1)) / F.col("d"), "id")).alias("b"))
    return second.select("cluster", "start", _plane(_real(F.col("a"), F.lit(1)), _real(F.col("b"), F.lit(1))).alias("plane"))


def _side_sums(points: DataFrame, planes: DataFrame, size: int) -> DataFrame:
    """(cluster, start, n0, s0): the number and the sum of the points on a start's near side."""
    of = planes.groupBy("cluster").agg(F.collect_list(F.struct("start", "plane")).alias("planes"))  # one a start
    each = points.join(of, "cluster").select("cluster", "vec", F.inline("planes")).where(_near(F.col("vec"), F.col("plane")))
    return _totals(each, size, "cluster", "start").select("cluster", "start", F.col("n").alias("n0"), F.col("s").alias("s0"))


def lloyd(points: DataFrame, totals: DataFrame, size: int, starts: int = STARTS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(cluster, plane): the plane of the best start of each cluster of ``points`` (cluster, id, vec) with sums ``totals``.

    Starts that have ended leave the rounds. The best one has the least sum of squares within its sides, the first of
    equally good ones. Clusters whose points are all equal have no row. After ``rounds`` rounds a start is taken as it is.
    """
    planes, before, ended = cut(_starts(points, starts, seed)), None, None
    for k in range(rounds):
        sums = _side_sums(points, planes, size).join(totals, "cluster").where("n0 < n")
        if before is not None:
            sums = sums.join(before, ["cluster", "start"], "left").withColumn("same", F.coalesce((F.col("n0") == F.col("b_n0")) & (F.col("s0") == F.col("b_s0")), F.lit(False)))
        else:
            sums = sums.withColumn("same", F.lit(False))
        sums = cut(sums.select("cluster", "start", "n0", "s0", "n", "s", "same"))
        a = _real(F.col("s0"), F.col("n0"))
        b = _real(F.zip_with("s", "s0", lambda x, y: x - y), F.col("n") - F.col("n0"))
        gain = F.col("n0") * _squares(a) + (F.col("n") - F.col("n0")) * _squares(b)
        now = sums.select("cluster", "start", "same", gain.alias("gain"), _plane(a, b).alias("plane"))
        done = now.where("same") if k + 1 < rounds else now
        ended = done.drop("same") if ended is None else ended.unionByName(done.drop("same"))
        going = sums.where("NOT same")
        if going.isEmpty():
            break
        before = going.select("cluster", "start", F.col("n0").alias("b_n0"), F.col("s0").alias("b_s0"))
        planes = now.where("NOT same").select("cluster", "start", "plane")
    return cut(ended.groupBy("cluster").agg(F.min_by("plane", F.struct(-F.col("gain"), "start")).alias("plane")))


def sides(points: DataFrame, size: int, starts: int = STARTS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(cluster, id, vec, title, n, side) for the points of ``_whole_points``; side 0 has the cluster's least id.

    Of three points the one furthest from their mean is alone. Clusters of one or two, or of equal points, have side null.
    """
    totals = cut(_totals(points, size, "cluster"))
    planes = lloyd(points.join(totals.where("n > 3").select("cluster"), "cluster", "left_semi"), totals, size, starts, rounds, seed)
    # A plane is one row a cluster; Spark splits the join of a hot cluster's points with it.
    met = points.join(totals, "cluster").join(planes, "cluster", "left")
    off = F.when(F.col("n") == 3, _squares(F.zip_with("vec", "s", lambda x, y: x * 3 - y)))
    lloyd_side = F.when(F.col("n") > 3, (~_near(F.col("vec"), F.col("plane"))).cast("int"))
    met = cut(met.select("cluster", "id", "vec", "title", "n", off.alias("off"), lloyd_side.alias("raw")))
    lead = met.groupBy("cluster").agg(
        F.min_by("raw", "id").alias("lead"), F.min("id").alias("least"),
        F.max(F.when(F.col("n") == 3, F.struct("off", "id"))).alias("far"), F.min(F.when(F.col("n") == 3, F.col("off"))).alias("nearest"),
    )
    alone = F.when(F.col("far.off") > F.col("nearest"), ((F.col("id") == F.col("far.id")) != (F.col("far.id") == F.col("least"))).cast("int"))
    side = F.when(F.col("n") == 3, alone).otherwise((F.col("raw") != F.col("lead")).cast("int"))
    return met.join(lead, "cluster").select("cluster", "id", "vec", "title", "n", side.alias("side"))


def _distances(dealt: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cluster, id, side, own, other): whole sums of each point's distances to the points of its side and of the other.

    A cluster is dealt into blocks by a hash of the id, every two blocks meet in a task, which gives sums only. The work
    is quadratic in a cluster's points, its memory isn't.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = dealt.select("cluster", "id", "vec", "side", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.select("cluster", F.col("own").alias("i"), every.alias("j"), "id", "vec", "side")
    right = own.select(F.col("cluster").alias("cluster"), every.alias("i"), F.col("own").alias("j"), F.col("vec").alias("vec"), F.col("side").alias("side"))

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["cluster", "id", "side", "own", "other"]
        if a.empty or b.empty:
            return pd.DataFrame({k: [] for k in names})
        x, y, s = np.stack(a["vec"]).astype(float) / PARTS, np.stack(b["vec"]).astype(float) / PARTS, b["side"].to_numpy()
        step, parts = max(1, (1 << 22) // y.size), []
        for at in range(0, len(x), step):
            d = np.rint(np.sqrt(((x[at : at + step, None] - y[None]) ** 2).sum(axis=2)) * FINE).astype(np.int64)
            parts.append(np.stack([d[:, s == 0].sum(axis=1), d[:, s == 1].sum(axis=1)], axis=1))
        both, mine = np.concatenate(parts), a["side"].to_numpy().astype(int)
        rows = np.arange(len(x))
        return a[["cluster", "id", "side"]].assign(own=both[rows, mine], other=both[rows, 1 - mine])[names]

    pairs = left.groupBy("cluster", "i", "j").cogroup(right.groupBy("cluster", "i", "j")).applyInPandas(met, "cluster long, id long, side int, own long, other long")
    return pairs.groupBy("cluster", "id", "side").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))


def _spread(split: DataFrame, block: int) -> DataFrame:
    """(cluster, all_intra, intra0, intra1, silhouette): mean distances of two points of a cluster and of its sides."""
    counts = split.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("side").alias("n1"))
    d = _distances(split, block).join(counts, "cluster")
    mine, rest = F.when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1")), F.when(F.col("side") == 1, F.col("n") - F.col("n1")).otherwise(F.col("n1"))
    a, b = F.col("own") / (mine - 1), F.col("other") / rest
    s = F.when((mine > 1) & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b)).otherwise(0.0)
    sums = d.groupBy("cluster", "n", "n1").agg(
        F.sum(F.col("own") + F.col("other")).alias("all"), F.sum(F.when(F.col("side") == 0, F.col("own"))).alias("d0"), F.sum(F.when(F.col("side") == 1, F.col("own"))).alias("d1"),
        F.sum(F.rint(s * 1e12).cast("long")).alias("s"),
    )
    n0 = F.col("n") - F.col("n1")
    mean = lambda total, n: F.when(n > 1, F.col(total) / FINE / (n * (n - 1))).otherwise(0.0)
    silhouette = F.when((n0 > 1) & (F.col("n1") > 1), F.col("s") / 1e12 / F.col("n")).otherwise(-1.0)
    return sums.select("cluster", mean("all", F.col("n")).alias("all_intra"), mean("d0", n0).alias("intra0"), mean("d1", F.col("n1")).alias("intra1"), silhouette.alias("silhouette"))


def _names(split: DataFrame) -> DataFrame:
    """(cluster, names0, names1): the words that most titles of a side hold; ties go to the longer word, then the lesser."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all("title", F.lit(WORD), F.lit(0))), F.array(*[F.lit(w) for w in STOPWORDS]))
    counts = split.select("cluster", "side", F.explode(words).alias("word")).groupBy("cluster", "side", "word").agg(F.count("*").alias("k"))
    place = F.row_number().over(Window.partitionBy("cluster", "side").orderBy(F.desc("k"), F.length("word").desc(), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= NAMES)
    of = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("place", "word")))), lambda x: x["word"])
    return top.groupBy("cluster").agg(of(0).alias("names0"), of(1).alias("names1"))


def _title_share(split: DataFrame) -> DataFrame:
    """(cluster, dup_ratio): the share of the most frequent normalised title among those that aren't empty."""
    title = F.regexp_replace(F.regexp_replace(F.lower("title"), ASIDE, " "), MARKS, "")
    counts = split.groupBy("cluster", title.alias("k")).agg(F.count("*").alias("c")).where("k <> ''")
    return counts.groupBy("cluster").agg((F.max("c") / F.sum("c")).alias("dup_ratio"))


def _outlying(split: DataFrame, means: DataFrame) -> DataFrame:
    """(cluster, stands_out) for clusters of three: the furthest from the mean against the second."""
    three = split.where("n = 3").join(means.groupBy("cluster").agg(F.collect_list("s").alias("both")), "cluster")
    whole = F.zip_with(F.col("both")[0], F.col("both")[1], lambda x, y: x + y)
    d = F.sqrt(_squares(F.zip_with("vec", whole, lambda x, y: x * 3 - y))) / (3 * PARTS)
    far = three.select("cluster", d.alias("d")).groupBy("cluster").agg(F.array_sort(F.collect_list("d")).alias("d"))
    ratio = F.when(F.col("d")[1] > 1e-9, F.col("d")[2] / (F.col("d")[1] + 1e-9)).otherwise(999.0)
    return far.select("cluster", ((ratio >= OUT_RATIO) & (F.col("d")[2] - F.col("d")[1] >= OUT_DELTA)).alias("stands_out"))


def _score() -> Column:
    """The signs of two topics, in hundredths."""
    step = lambda *cases: F.coalesce(*[F.when(c, v) for c, v in cases], F.lit(0))
    ratio, sil, names = F.col("dist_ratio"), F.col("silhouette"), F.col("names_jaccard")
    within = F.greatest("intra0", "intra1") / F.col("all_intra")
    tight = F.when(F.col("all_intra") > 1e-6, step((within <= 0.75, 70), (within <= 0.9, 25))).otherwise(0)
    uneven = (F.col("n") >= 6) & (F.least("n0", "n1") / F.greatest("n0", "n1") < 0.2)
    return step((ratio >= 1.2, 90), (ratio >= 1.08, 45)) + step((sil >= 0.1, 90), (sil >= 0.07, 35)) + step((names <= 0.15, 80), (names <= 0.35, 35)) + tight - F.when(uneven, 40).otherwise(0)


def split_decisions(points: DataFrame, size: int, starts: int = STARTS, rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(decisions, members): whether each cluster of ``points`` (cluster, id, vec, title) is two, and which point is where.

    A decision has (cluster, n, n0, n1, all_intra, intra0, intra1, centroid_dist, dist_ratio, silhouette, names_jaccard,
    dup_ratio, score, split, reason). Reasons: ``small`` (one or two points), ``equal`` (all points alike), ``outlier`` and
    ``three`` (three points, split and not), ``veto_names``, ``veto_titles``, ``force``, ``score``, ``held``. Members have
    (cluster, id, side); side 0 has the cluster's least id. Without sides a decision's measures are null.

    Rows without cluster, id or vector are left out, a null title is empty, points that share cluster and id are one,
    with the least vector and title; of a vector ``size`` elements count, missing ones as 0. Other columns don't matter,
    an empty table gives empty results.
    """
    split = cut(sides(cut(_whole_points(points, size)), size, starts, rounds, seed))
    halved = split.where("side IS NOT NULL")
    means = cut(_totals(halved, size, "cluster", "side"))
    mean = lambda side: F.max(F.when(F.col("side") == side, _real(F.col("s"), F.col("n") * PARTS)))
    part = lambda side: F.max(F.when(F.col("side") == side, F.col("n")))
    apart = means.groupBy("cluster").agg(part(0).alias("n0"), part(1).alias("n1"), mean(0).alias("m0"), mean(1).alias("m1"))
    apart = apart.select("cluster", "n0", "n1", vectors.euclidean(F.col("m0"), F.col("m1")).alias("centroid_dist"))
    measured = apart.join(_spread(halved, block), "cluster").join(_names(halved), "cluster", "left").join(_title_share(halved), "cluster", "left").join(_outlying(halved, means), "cluster", "left")
    none = F.array().cast("array<string>")
    names = [F.coalesce(k, none) for k in ("names0", "names1")]
    runs = [F.array_distinct(F.flatten(F.transform(k, lambda w: text.character_ngrams(w, 2)))) for k in names]
    exact = F.when(F.size(F.array_union(*runs)) == 0, 1.0).otherwise(text.jaccard(*runs))
    sized = split.groupBy("cluster").agg(F.count("*").alias("n"))
    all_ = sized.join(measured, "cluster", "left").withColumn("fuzzy", fuzzy.soft_jaccard(*names))
    all_ = all_.withColumn("names_jaccard", F.when(F.col("n0").isNull(), None).when(F.col("n") == 3, exact).otherwise(F.col("fuzzy")))
    all_ = all_.withColumns({"dist_ratio": F.col("centroid_dist") / (F.col("all_intra") + 1e-6), "dup_ratio": F.when(F.col("n0").isNotNull(), F.coalesce("dup_ratio", F.lit(0.0)))})
    all_ = all_.withColumn("score", F.when((F.col("n") > 3) & F.col("n0").isNotNull(), _score()))
    jaccard = F.col("names_jaccard")
    reason = (
        F.when(F.col("n") <= 2, "small").when(F.col("n0").isNull(), "equal")
        .when(F.col("n") == 3, F.when(F.col("stands_out") & ((jaccard <= OUT_NAMES) | (F.col("dist_ratio") >= OUT_DISTANCE)), "outlier").otherwise("three"))
        .when(jaccard >= VETO_NAMES, "veto_names").when(F.col("dup_ratio") >= VETO_TITLES, "veto_titles")
        .when((F.col("n") >= FORCE_POINTS) & (jaccard <= FORCE_NAMES) & (F.col("silhouette") >= FORCE_SILHOUETTE), "force")
        .when(F.col("score") >= ENOUGH, "score").otherwise("held")
    )
    found = all_.withColumn("reason", reason).withColumn("split", F.col("reason").isin("outlier", "force", "score"))
    columns = ["cluster", "n", "n0", "n1", "all_intra", "intra0", "intra1", "centroid_dist", "dist_ratio", "silhouette", "names_jaccard", "dup_ratio", "score", "split", "reason"]
    return found.select(*columns), split.select("cluster", "id", "side")
