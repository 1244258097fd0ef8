"""Judges held against people: rules chosen on one part of the clusters and valued on the other.

Every analysis scans its rows once, into counts by few values; rules, folds and thresholds then run over the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number
from plumeria.operators import asof, inference, quantiles
from plumeria.operators.rounds import cut

#: Least scores and most claims of the rules, the strictest first.
SCORES, CLAIMS = (5, 4, 3, 2, 1), (0, 1, 2, 3)


def kappa(n: Column, both: Column, one: Column, other: Column) -> Column:
    """Cohen's kappa of two yes/no judgements from the numbers of rows, of yes by both and by each; null where undefined."""
    same, chance = (n - one - other + 2 * both) / n, (one * other + (n - one) * (n - other)) / (n * n)
    return F.when((n > 0) & (chance < 1), F.round((same - chance) / (1 - chance), 9))


def fold_of(cluster: Column, folds: int, seed: int) -> Column:
    return (md5_number(F.lit(seed), cluster) % folds).alias("fold")


def _chosen(counts: DataFrame, *by: str) -> DataFrame:
    """(by, rule): the rule with the greatest kappa, the strictest of equally good ones."""
    value = kappa(*(F.col(c) for c in ("n", "tp", "p", "y")))
    return counts.groupBy(*by).agg(F.min_by(F.struct("place", "least_score", "most_claims"), F.struct(-F.coalesce(value, F.lit(-2.0)), "place")).alias("rule"))


def judge_metrics(rows: DataFrame, folds: int = 2, seed: int = 0, cross_family: bool = True) -> DataFrame:
    """(judge, family, n, n_same_family, oof_kappa, least_score, most_claims, spearman, failures, cost) for each judge.

    ``rows`` has (judge, family, made_by, cluster, score, claims, mean_score, publishable, style, cost). A rule passes a
    text from a least score on and up to a number of claims; a text without score, a failed call, passes none. For each
    fold of clusters the rule is chosen on the other folds; ``oof_kappa`` is that of all such verdicts with the people's,
    and the rule given is the one chosen on all rows. ``spearman`` holds the mean score against the people's style. With
    ``cross_family`` texts by the judge's own family don't count, but in ``n_same_family``.

    Rows without judge, cluster or ``publishable`` are left out, null claims are none, a null cost is 0. A judge without
    rows that count has no row, nor has any an empty table. kappa and spearman are null where they aren't defined.
    """
    good = rows.where("judge IS NOT NULL AND cluster IS NOT NULL AND publishable IS NOT NULL")
    same = F.lit(cross_family) & F.coalesce(F.col("family") == F.col("made_by"), F.lit(False))
    score, claims = F.coalesce(F.col("score"), F.lit(0)), F.least(F.coalesce(F.col("claims"), F.lit(0)), F.lit(max(CLAIMS) + 1))
    pairs = F.when(F.col("mean_score").isNotNull() & F.col("style").isNotNull(), F.struct(F.col("mean_score").alias("x"), F.col("style").alias("y")))
    counts = cut(good.groupBy(
        "judge", fold_of(F.col("cluster"), folds, seed), score.alias("score"), claims.alias("claims"), F.col("publishable").alias("human"), pairs.alias("pair"), same.alias("same")
    ).agg(F.count("*").alias("k"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.min("family").alias("family"), F.count_if(F.col("score").isNull()).alias("failures")))
    own = counts.where("NOT same")
    rule = F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("least_score"), F.lit(c).alias("most_claims")) for i, (s, c) in enumerate((s, c) for s in SCORES for c in CLAIMS)]))
    few = own.groupBy("judge", "fold", "score", "claims", "human").agg(F.sum("k").alias("k"))
    tried = few.select("judge", "fold", "score", "claims", "human", "k", rule)
    passes = (F.col("score") >= F.col("least_score")) & (F.col("claims") <= F.col("most_claims"))
    part = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    each = cut(tried.groupBy("judge", "fold", "place", "least_score", "most_claims").agg(F.sum("k").alias("n"), part(passes & F.col("human")).alias("tp"), part(passes).alias("p"), part(F.col("human")).alias("y")))
    whole = each.groupBy("judge", "place", "least_score", "most_claims").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "p", "y")])
    rest = each.alias("e").join(whole.alias("w"), ["judge", "place", "least_score", "most_claims"]).select("judge", "fold", "place", "least_score", "most_claims", *[(F.col(f"w.{c}") - F.col(f"e.{c}")).alias(c) for c in ("n", "tp", "p", "y")])
    held = each.join(_chosen(rest, "judge", "fold").select("judge", "fold", "rule.place"), ["judge", "fold", "place"])
    out = held.groupBy("judge").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "p", "y")]).select("judge", kappa(*(F.col(c) for c in ("n", "tp", "p", "y"))).alias("oof_kappa"))
    sums = counts.groupBy("judge").agg(
        F.min("family").alias("family"), part(~F.col("same")).alias("n"), part(F.col("same")).alias("n_same_family"),
        F.sum(F.when(~F.col("same"), F.col("failures")).otherwise(0)).alias("failures"), F.sum(F.when(~F.col("same"), F.col("cost")).otherwise(0.0)).alias("cost"),
    )
    found = sums.join(out, "judge").join(_chosen(whole, "judge"), "judge").join(_spearman(own), "judge", "left")
    return found.select("judge", "family", "n", "n_same_family", "oof_kappa", "rule.least_score", "rule.most_claims", "spearman", "failures", "cost")


def _spearman(counts: DataFrame) -> DataFrame:
    """(judge, spearman) from counts of pairs (x, y): ties share their mean rank. The windows run over a judge's distinct values."""
    pairs = counts.where("pair IS NOT NULL").groupBy("judge", "pair.x", "pair.y").agg(F.sum("k").alias("k"))

    def ranks(c: str) -> DataFrame:
        upto = F.sum("k").over(Window.partitionBy("judge").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        one = pairs.groupBy("judge", c).agg(F.sum("k").alias("k"))
        return one.select("judge", c, (upto - (F.col("k") - 1) / 2).alias(f"r{c}"))

    both = pairs.join(ranks("x"), ["judge", "x"]).join(ranks("y"), ["judge", "y"])
    mean = both.groupBy("judge").agg(F.sum("k").alias("n")).select("judge", ((F.col("n") + 1) / 2).alias("m"))
    a, b = F.col("rx") - F.col("m"), F.col("ry") - F.col("m")
    sums = both.join(mean, "judge").groupBy("judge").agg(F.sum(F.col("k") * a * b).alias("ab"), F.sum(F.col("k") * a * a).alias("aa"), F.sum(F.col("k") * b * b).alias("bb"))
    return sums.select("judge", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"))


def judge_choice(metrics: DataFrame, families: list[str], least_kappa: float, cross_family: bool = True) -> DataFrame:
    """(family, judge, oof_kappa, mode, least_score, most_claims): which judge of another family each generator's family gets.

    The one with the greatest kappa, then the least cost, then the least name; it is enforced by its rule from
    ``least_kappa`` on, else it only watches, without a rule. Without a judge whose kappa is defined that is null.
    """
    wanted = metrics.sparkSession.createDataFrame([(f,) for f in families], "of string")
    other = F.col("oof_kappa").isNotNull() & (~F.lit(cross_family) | F.coalesce(F.col("family") != F.col("of"), F.lit(True)))
    best = wanted.join(F.broadcast(metrics), other, "left").groupBy("of").agg(F.min_by(F.struct("judge", "oof_kappa", "least_score", "most_claims"), F.struct(-F.col("oof_kappa"), "cost", "judge")).alias("j"))  # one row a judge
    enforced = F.coalesce(F.col("j.oof_kappa") >= least_kappa, F.lit(False))
    return best.select(F.col("of").alias("family"), "j.judge", "j.oof_kappa", F.when(enforced, "enforce").otherwise("shadow").alias("mode"), *[F.when(enforced, F.col(f"j.{c}")).alias(c) for c in ("least_score", "most_claims")])


def confidence_gate(rows: DataFrame, least_auc: float, least_gain: float, folds: int = 2, seed: int = 0) -> DataFrame:
    """(n, n_unparsed, auc, baseline, oof, gain, threshold, recommended): is a threshold on the confidence better than the verdict?

    ``rows`` has (cluster, passed, confidence, truth, parsed). The score is the confidence of a pass and 1 less that of a
    fail. ``baseline`` is the balanced accuracy of the verdicts, ``oof`` that of thresholds chosen on the other folds of
    clusters (the least of equally good ones), ``threshold`` the one chosen on all rows.

    Rows that weren't parsed only count in ``n_unparsed``; those without cluster, verdict or truth are left out, a null
    confidence is 0. Measures are null where one of the two truths is missing. Distinct scores may be as many as the
    rows: their running sums go by a thousandth of the scale, then inside it.
    """
    good = rows.where("cluster IS NOT NULL AND passed IS NOT NULL AND truth IS NOT NULL")
    c = F.coalesce("confidence", F.lit(0.0))
    scored = good.select(fold_of(F.col("cluster"), folds, seed), F.when(F.col("passed"), c).otherwise(1 - c).alias("score"), "passed", "truth", F.coalesce("parsed", F.lit(True)).alias("parsed"))
    one = lambda x: F.count_if(F.col("parsed") & x)
    t, hit = F.col("truth"), F.col("passed")
    base = scored.agg(one(F.lit(True)).alias("n"), F.count_if(~F.col("parsed")).alias("n_unparsed"), one(t).alias("pos"), one(~t).alias("neg"), one(t & hit).alias("tp"), one(~t & ~hit).alias("tn"))
    values = cut(scored.where("parsed").groupBy("fold", "score").agg(F.count_if("truth").alias("pos"), F.count_if(~t).alias("neg")))
    # Set -1 is all rows, set f those outside fold f.
    sets = F.filter(F.sequence(F.lit(-1), F.lit(folds - 1)), lambda s: s != F.col("fold"))
    learned = values.withColumn("set", F.explode(sets)).groupBy("set", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    placed = learned.withColumn("at", F.floor(F.col("score") * 1000000).cast("long"))
    below = cut(asof.prefix_sums(placed, ["set"], "at", [F.col("score")], 1000, below_pos=F.col("pos"), below_neg=F.col("neg")).select("set", "score", "pos", "neg", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("below_pos", "below_neg")]))
    sums = below.groupBy("set").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("won"))
    balanced = F.round(((F.col("P") - F.col("below_pos")) / F.nullif("P", F.lit(0)) + F.col("below_neg") / F.nullif("N", F.lit(0))) / 2, 9)
    best = below.join(F.broadcast(sums), "set").groupBy("set").agg(F.min_by("score", F.struct(-F.coalesce(balanced, F.lit(-1.0)), "score")).alias("t"))  # one row a fold
    held = values.join(F.broadcast(best.where("set >= 0").select(F.col("set").alias("fold"), "t")), "fold", "left")
    yes = F.coalesce(F.col("score") >= F.col("t"), F.lit(False))
    oof = held.agg(F.sum(F.when(yes, F.col("pos")).otherwise(0)).alias("o_tp"), F.sum(F.when(~yes, F.col("neg")).otherwise(0)).alias("o_tn"))
    all_ = base.join(F.broadcast(oof)).join(F.broadcast(sums.where("set = -1").select(F.col("won"))), how="left").join(F.broadcast(best.where("set = -1").select("t")), how="left")  # one row each
    rate = lambda a, b: (F.col(a) / F.nullif("pos", F.lit(0)) + F.col(b) / F.nullif("neg", F.lit(0))) / 2
    found = all_.select("n", "n_unparsed", (F.col("won") / F.nullif("pos", F.lit(0)) / F.nullif("neg", F.lit(0))).alias("auc"), rate("tp", "tn").alias("baseline"), rate("o_tp", "o_tn").alias("oof"), F.col("t").alias("threshold"))
    gain = F.col("oof") - F.col("baseline")
    recommended = F.coalesce((F.col("auc") >= least_auc) & (gain >= least_gain), F.lit(False))
    return found.select("n", "n_unparsed", "auc", "baseline", "oof", gain.alias("gain"), "threshold", recommended.alias("recommended"))


def bake_off(rows: DataFrame, most_unsupported: float, most_drift: float, least_first_try: float, most_p95: float, attempts: tuple[int, int] = (3, 2), replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row for each candidate: its rates, its expected cost of 100 texts, whether it passes the gates, and who wins.

    ``rows`` has (candidate, item, drafted, publishable, unsupported, drift, blocked, responded, first_try, latency,
    generation_cost, tone_cost): a text, the people's verdict (null: none), what is wrong with it, its calls and costs.
    A text is generated and toned anew up to ``attempts`` times while it is blocked or drifts. Of the candidates that
    pass, the one with the best publishable rate is the top; the others are tied with it unless the interval of their
    paired difference, with items drawn anew, leaves 0 out. The cheapest of the tied ones wins, then the least name.

    Columns: candidate, n, n_failed, n_labelled, publishable_rate, unsupported_rate, drift_rate, block_rate,
    first_try_rate, p95_latency, cost_per_100, passes, n_pairs, diff, low, high (top less candidate, null but for those
    that pass and aren't the top), tied, winner. Rows without candidate or item are left out, null flags are no, null
    costs and calls are 0. A measure that nothing bears is null, and its gate not passed. Of repeated (candidate, item)
    the pairs take the best verdict. No pair of candidates is made but with the top; an item's verdicts share their draws.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    good = rows.where("candidate IS NOT NULL AND item IS NOT NULL")
    draft = yes("drafted")
    of_drafts = lambda x: F.avg(F.when(draft, x))
    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sums = good.groupBy("candidate").agg(
        F.count("*").alias("n"), F.count_if(~draft).alias("n_failed"), F.count("publishable").alias("n_labelled"), F.avg(F.col("publishable").cast("int")).alias("publishable_rate"),
        *[of_drafts(yes(c).cast("int")).alias(n) for c, n in (("unsupported", "unsupported_rate"), ("drift", "drift_rate"), ("blocked", "block_rate"))],
        (F.sum(amount("first_try")) / F.nullif(F.sum(amount("responded")), F.lit(0.0))).alias("first_try_rate"), F.avg(amount("generation_cost")).alias("g"), of_drafts(amount("tone_cost")).alias("t"),
    )
    slow = quantiles.percentiles(good, "candidate", "latency", [0.95]).select("candidate", F.col("percentile").alias("p95_latency"))
    tries = lambda p, most: F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0.0), lambda s, k: s + F.pow(p, k))
    cost = 100 * (F.col("g") * tries(F.col("block_rate"), attempts[0]) + F.col("t") * tries(F.col("drift_rate"), attempts[1]))
    gates = (F.col("unsupported_rate") <= most_unsupported) & (F.col("drift_rate") <= most_drift) & (F.col("first_try_rate") >= least_first_try) & (F.col("p95_latency") <= most_p95)
    found = cut(sums.join(slow, "candidate", "left").withColumn("cost_per_100", cost).withColumn("passes", F.coalesce(gates, F.lit(False))).drop("g", "t"))
    best = F.struct(-F.coalesce("publishable_rate", F.lit(-1.0)), F.coalesce("cost_per_100", F.lit(float("inf"))), "candidate")
    top = found.where("passes").agg(F.min_by("candidate", best).alias("top"))  # one row
    voted = good.where("publishable IS NOT NULL").groupBy("item", "candidate").agg(F.max(F.col("publishable").cast("int")).alias("v"))
    voted = voted.join(F.broadcast(found.where("passes").select("candidate")), "candidate")  # one row a candidate
    items = voted.groupBy("item").agg(F.collect_list(F.struct("candidate", "v")).alias("all")).join(F.broadcast(top))
    mine = F.get(F.filter("all", lambda x: x["candidate"] == F.col("top")), F.lit(0))["v"]
    apart = items.withColumn("mine", mine).where("mine IS NOT NULL").withColumn("others", F.filter("all", lambda x: x["candidate"] != F.col("top")))
    drawn = apart.select("item", "mine", "others", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b"))
    drawn = drawn.withColumn("w", F.when(F.col("b") == 0, 1).otherwise(inference.poisson_weight(seed, F.col("b"), F.col("item")))).where("w > 0").select("b", "w", "mine", F.inline("others"))
    each = drawn.groupBy("candidate", "b").agg((F.sum(F.col("w") * (F.col("mine") - F.col("v"))) / F.sum("w")).alias("d"), F.sum("w").alias("pairs"))
    whole = lambda c: F.max(F.when(F.col("b") == 0, F.col(c)))
    diffs = each.groupBy("candidate").agg(whole("pairs").alias("n_pairs"), whole("d").alias("diff"), F.percentile(F.when(F.col("b") > 0, F.col("d")), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    diffs = diffs.select("candidate", "n_pairs", "diff", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    joined = found.join(diffs, "candidate", "left").join(F.broadcast(top), how="left")
    tied = F.col("passes") & ((F.col("candidate") == F.col("top")) | F.col("low").isNull() | ((F.col("low") <= 0) & (F.col("high") >= 0)))
    joined = cut(joined.withColumn("tied", tied))
    wins = joined.where("tied").agg(F.min_by("candidate", F.struct(F.coalesce("cost_per_100", F.lit(float("inf"))), "candidate")).alias("best"))  # one row
    return joined.join(F.broadcast(wins)).withColumn("winner", F.coalesce(F.col("candidate") == F.col("best"), F.lit(False))).drop("best", "top")
