"""Studies of rankings: paired and nested intervals, decision rules, ties, candidate pools, baselines and negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number
from plumeria.operators import asof, inference, negatives
from plumeria.plans.features import AS_OF
from plumeria.plans.ranking import _SLOTS, _TASKS, GROUP, ranked_tasks, slots, targets, tasks
from plumeria.plans.registry import LOG, query
from plumeria.sources.tables import clicks, event_log, items, requests, table

DAY, SEEDS, MARGIN = 86400, 3, 0.02
#: The 97.5 % point of Student's t with SEEDS - 1 degrees of freedom (a fixed value).
T_SEEDS = 4.302652729911275


def reciprocal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, seed, a, b): reciprocal rank of the first click by popularity and by recency.

    Ties in popularity fall by the seed; groups without clicks are left out.
    """
    pool = tasks(spark, sf_dir).join(items(spark, sf_dir).select("item", "pub_s"), "item")
    pool = pool.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEEDS - 1).cast("long"))))
    w = Window.partitionBy(*GROUP, "seed")
    a = F.row_number().over(w.orderBy(F.desc("score"), md5_number(F.col("seed"), F.col("item")), "item"))
    b = F.row_number().over(w.orderBy(F.desc("pub_s"), "item"))
    placed = pool.withColumn("a", a).withColumn("b", b)
    first = lambda c: (1 / F.min(F.when(F.col("label") == 1, F.col(c)))).alias(c)
    return placed.groupBy(*GROUP, "seed").agg(first("a"), first("b")).where("a IS NOT NULL")


_MRR = f"""
    placed AS (SELECT user_id, day, seed, label, row_number() OVER (PARTITION BY user_id, day, seed ORDER BY score DESC,
               ('0x' || substr(md5(seed || ':' || item), 1, 8))::BIGINT, item) AS a,
               row_number() OVER (PARTITION BY user_id, day, seed ORDER BY pub_s DESC, item) AS b
               FROM task JOIN items USING (item), range({SEEDS}) g(seed)),
    mrr AS (SELECT user_id, day, seed, 1.0 / min(a) FILTER (label = 1) AS a, 1.0 / min(b) FILTER (label = 1) AS b
            FROM placed GROUP BY user_id, day, seed HAVING sum(label) > 0)
"""


def _poisson(name: str) -> str:
    return " + ".join(f"({name} >= {p:.8f})::INTEGER" for p in inference.POISSON)


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, s AS (SELECT 'popular' AS method, seed, avg(a) AS m FROM mrr GROUP BY seed UNION ALL SELECT 'recent', seed, avg(b) FROM mrr GROUP BY seed)
    SELECT method, count(*) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(avg(m) - {T_SEEDS} * stddev_samp(m) / sqrt(count(*)), 6) AS low,
           round(avg(m) + {T_SEEDS} * stddev_samp(m) / sqrt(count(*)), 6) AS high FROM s GROUP BY method""")
def seed_mean_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's mean over seeds, its deviation, and Student's interval."""
    by = reciprocal_ranks(spark, sf_dir).groupBy("seed").agg(F.avg("a").alias("popular"), F.avg("b").alias("recent"))
    long = by.unpivot("seed", ["popular", "recent"], "method", "m")
    half = T_SEEDS * F.stddev_samp("m") / F.sqrt(F.count("*"))
    cut = lambda x, n: F.round(x, 6).alias(n)
    return long.groupBy("method").agg(F.count("*").alias("seeds"), cut(F.avg("m"), "mean"), cut(F.stddev_samp("m"), "sd"), cut(F.avg("m") - half, "low"), cut(F.avg("m") + half, "high"))


def user_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, k, n): a user's summed difference of the two methods, and the groups summed."""
    return reciprocal_ranks(spark, sf_dir).groupBy("user_id").agg(F.sum(F.col("a") - F.col("b")).alias("k"), F.count("*").cast("double").alias("n"))


_PAIRED = f"""
    u AS (SELECT user_id, sum(a - b) AS k, count(*)::DOUBLE AS n FROM mrr GROUP BY user_id),
    d AS (SELECT b, k, n, ('0x' || substr(md5('0:' || b || ':' || user_id), 1, 8))::BIGINT / 4294967296.0 AS x FROM u, range(1, 201) r(b)),
    r AS (SELECT sum(({_poisson('x')}) * k) / sum(({_poisson('x')}) * n) AS r FROM d GROUP BY b),
    paired AS (SELECT (SELECT sum(k) / sum(n) FROM u) AS value, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM r)
"""


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, {_PAIRED} SELECT round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high,
    CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'undecided' END AS verdict FROM paired""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two methods on the same groups, users being drawn anew, and what it says."""
    found = inference.cluster_bootstrap(user_differences(spark, sf_dir), "user_id", "k", "n")
    return found.select(*[F.round(c, 6).alias(c) for c in ("value", "low", "high")], inference.verdict(F.col("low"), F.col("high")).alias("verdict"))


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, {_PAIRED} SELECT round(low, 6) AS low, round(high, 6) AS high,
    CASE WHEN low > -{MARGIN} THEN 'pass' WHEN high < -{MARGIN} THEN 'fail' ELSE 'hold' END AS gate FROM paired""")
def noninferiority_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass if the interval lies above the margin, fail if below it, else hold."""
    found = inference.cluster_bootstrap(user_differences(spark, sf_dir), "user_id", "k", "n")
    return found.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), inference.gate(F.col("low"), F.col("high"), MARGIN).alias("gate"))


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, c AS (SELECT user_id, seed, sum(a - b) AS k, count(*)::DOUBLE AS n FROM mrr GROUP BY user_id, seed),
    d AS (SELECT b, k, n, ('0x' || substr(md5('0:' || b || ':' || user_id), 1, 8))::BIGINT / 4294967296.0 AS x, ('0x' || substr(md5('1:' || b || ':' || seed), 1, 8))::BIGINT / 4294967296.0 AS y FROM c, range(1, 101) r(b)),
    w AS (SELECT b, k, n, ({_poisson('x')}) * ({_poisson('y')}) AS w FROM d), r AS (SELECT sum(w * k) / sum(w * n) AS r FROM w GROUP BY b HAVING sum(w * n) > 0)
    SELECT round((SELECT sum(k) / sum(n) FROM c), 6) AS value, count(*) AS replicates, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r""")
def nested_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and users both drawn anew in each replicate."""
    cells = reciprocal_ranks(spark, sf_dir).groupBy("user_id", "seed").agg(F.sum(F.col("a") - F.col("b")).alias("k"), F.count("*").cast("double").alias("n"))
    return inference.nested_bootstrap(cells, "user_id", "seed", "k", "n", 100).select(*[F.round(c, 6).alias(c) for c in ("value", "low", "high")], "replicates")


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, c AS (SELECT user_id, seed, sum(a - b) AS k, count(*)::DOUBLE AS n FROM mrr GROUP BY user_id, seed),
    d AS (SELECT seed, b, k, n, ('0x' || substr(md5('0:' || b || ':' || user_id), 1, 8))::BIGINT / 4294967296.0 AS x FROM c, range(1, 201) r(b)),
    r AS (SELECT seed, b, sum(({_poisson('x')}) * k) / sum(({_poisson('x')}) * n) AS r FROM d GROUP BY seed, b),
    s AS (SELECT seed, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM r GROUP BY seed),
    v AS (SELECT seed, sum(k) / sum(n) AS value FROM c GROUP BY seed),
    e AS (SELECT min(low) AS least, avg(value) AS mean, avg((high - low) / 2) AS half, stddev_samp(value) AS sd FROM s JOIN v USING (seed))
    SELECT round(mean, 6) AS mean, round(least, 6) AS least_low, round(mean - sqrt(half ** 2 + ({T_SEEDS} * sd / sqrt({SEEDS})) ** 2), 6) AS combined_low,
           least > 0 AND mean - sqrt(half ** 2 + ({T_SEEDS} * sd / sqrt({SEEDS})) ** 2) > 0 AS holds FROM e""")
def seed_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect holds if every seed's interval and the combined one lie above 0."""
    cells = reciprocal_ranks(spark, sf_dir).groupBy("user_id", "seed").agg(F.sum(F.col("a") - F.col("b")).alias("k"), F.count("*").cast("double").alias("n"))
    by = inference.cluster_bootstrap_by(cells, "seed", "user_id", "k", "n")
    one = by.agg(F.min("low").alias("least"), F.avg("value").alias("mean"), F.avg((F.col("high") - F.col("low")) / 2).alias("half"), F.stddev_samp("value").alias("sd"))
    low = F.col("mean") - F.sqrt(F.col("half") ** 2 + (T_SEEDS * F.col("sd") / SEEDS**0.5) ** 2)
    return one.select(F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least_low"), F.round(low, 6).alias("combined_low"), ((F.col("least") > 0) & (low > 0)).alias("holds"))


_JUDGES = ("j0", "j1", "j2", "ref")
_PREFERENCE = f"""
    r AS (SELECT user_id AS c, item % 3 AS g, j, k, value AS y, value * (1 + 0.1 * k) + 20 * ('0x' || substr(md5(j || ':' || event_id), 1, 8))::BIGINT / 4294967296.0 + CASE WHEN item % 3 = k THEN 5 ELSE 0 END AS x
          FROM log, (SELECT unnest({list(_JUDGES)}) AS j, unnest(range({len(_JUDGES)})) AS k) WHERE value IS NOT NULL AND item IS NOT NULL AND user_id IS NOT NULL),
    s AS (SELECT j, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, count(*) AS n FROM r GROUP BY j),
    cell AS (SELECT j, c, g, k, sum((x - mx) / sx - (y - my) / sy) AS e, count(*) AS n FROM r JOIN (SELECT j, mx, sx, my, sy FROM s) USING (j) GROUP BY ALL),
    draw AS (SELECT *, ('0x' || substr(md5('0:' || b || ':' || c), 1, 8))::BIGINT / 4294967296.0 AS u FROM cell, range(0, 101) t(b)),
    part AS (SELECT j, k, g, b, CASE WHEN b = 0 THEN 1 ELSE {_poisson('u')} END AS w, e, n FROM draw),
    gaps AS (SELECT a.j, a.k, b, f, sum(w * e) FILTER (g = f) / sum(w * n) FILTER (g = f) - sum(w * e) FILTER (g <> f) / sum(w * n) FILTER (g <> f) AS gap FROM part a, range(3) h(f) GROUP BY ALL),
    pair AS (SELECT o.j, o.f, o.b, o.gap, p.gap AS ref FROM gaps o JOIN gaps p ON p.j = 'ref' AND p.f = o.f AND p.b = o.b WHERE o.k = o.f AND o.j <> 'ref')
"""


@query(f"""WITH {LOG}, {_PREFERENCE} SELECT j AS judge, f AS family, (SELECT n FROM s WHERE s.j = pair.j) AS n, round(max(gap) FILTER (b = 0), 6) AS own_gap, round(max(ref) FILTER (b = 0), 6) AS reference_gap,
    round(max(gap - ref) FILTER (b = 0), 6) AS contrast, round(quantile_cont(gap - ref, 0.025) FILTER (b > 0), 6) AS low, round(quantile_cont(gap - ref, 0.975) FILTER (b > 0), 6) AS high FROM pair GROUP BY j, f""")
def self_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges, each with a liking for its own third of the items, held against one without: contrasts with users drawn anew."""
    log = event_log(spark, sf_dir).where("value IS NOT NULL AND item IS NOT NULL").select("event_id", "user_id", "value", (F.col("item") % 3).alias("made_by"))
    rated = log.select("*", F.posexplode(F.array(*map(F.lit, _JUDGES))).alias("k", "judge"))
    noise = 20 * md5_number(F.col("judge"), F.col("event_id")) / F.lit(4294967296.0)
    score = F.col("value") * (1 + 0.1 * F.col("k")) + noise + F.when(F.col("made_by") == F.col("k"), 5).otherwise(0)
    rows = rated.select("user_id", "made_by", "judge", F.col("k").cast("long").alias("family"), score.alias("score"), "value")
    found = inference.self_preference(rows, "user_id", "made_by", "judge", "family", "score", "value", "ref", replicates=100)
    return found.select("judge", "family", "n", *[F.round(c, 6).alias(c) for c in ("own_gap", "reference_gap", "contrast", "low", "high")])


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, f AS (SELECT day % 7 AS test, avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0) AS z FROM mrr WHERE seed = 0 GROUP BY day % 7),
    p AS (SELECT test, 2 / (1 + exp(1.5976 * abs(z) + 0.07056 * abs(z) ** 3)) AS p FROM f WHERE z IS NOT NULL),
    o AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM p)
    SELECT test, round(p, 6) AS p, round(least(1.0, max((m - i + 1) * p) OVER (ORDER BY i)), 6) AS adjusted, max((m - i + 1) * p) OVER (ORDER BY i) < 0.05 AS rejected FROM o""")
def holm_step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family of seven tests, one a day of the week; the windows run over its seven rows."""
    diff = F.col("a") - F.col("b")
    error = F.stddev_samp(diff) / F.sqrt(F.count("*"))
    family = reciprocal_ranks(spark, sf_dir).where("seed = 0").groupBy((F.col("day") % 7).alias("test")).agg((F.avg(diff) / F.nullif(error, F.lit(0.0))).alias("z"))
    return inference.holm(family.where("z IS NOT NULL").withColumn("p", inference.two_sided_p(F.col("z"))), "test", "p").select("test", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"), "rejected")


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, s AS (SELECT day % 7 AS cell, seed, round(avg(a), 9) AS a, round(avg(b), 9) AS b, count(*) AS n FROM mrr GROUP BY day % 7, seed)
    SELECT cell, count(*) AS seeds, count(*) FILTER (a > b) AS ahead, min(n) AS least_groups, count(*) FILTER (a > b) = count(*) AS consistent FROM s GROUP BY cell""")
def grid_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell by cell, in how many seeds one method is ahead."""
    by = reciprocal_ranks(spark, sf_dir).groupBy((F.col("day") % 7).alias("cell"), "seed").agg(F.round(F.avg("a"), 9).alias("a"), F.round(F.avg("b"), 9).alias("b"), F.count("*").alias("n"))
    ahead = F.count_if(F.col("a") > F.col("b"))
    return by.groupBy("cell").agg(F.count("*").alias("seeds"), ahead.alias("ahead"), F.min("n").alias("least_groups"), (ahead == F.count("*")).alias("consistent"))


@query(f"""WITH {LOG}, {_TASKS}, {_MRR}, h AS (SELECT *, ('0x' || substr(md5('slice:' || user_id), 1, 8))::BIGINT % 5 = 0 AS held FROM mrr),
    s AS (SELECT held, avg(a) AS a, avg(b) AS b FROM h GROUP BY held), c AS (SELECT a >= b AS first FROM s WHERE held)
    SELECT CASE WHEN first THEN 'popular' ELSE 'recent' END AS method, round(CASE WHEN first THEN a ELSE b END, 6) AS mrr FROM s, c WHERE NOT held""")
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method that is ahead on a slice of users, and its mean on the others."""
    held = md5_number(F.lit("slice"), F.col("user_id")) % 5 == 0
    one = reciprocal_ranks(spark, sf_dir).agg(*[F.avg(F.when(held == F.lit(x), F.col(c))).alias(f"{c}{int(x)}") for c in "ab" for x in (True, False)])
    first = F.col("a1") >= F.col("b1")
    return one.select(F.when(first, "popular").otherwise("recent").alias("method"), F.round(F.when(first, F.col("a0")).otherwise(F.col("b0")), 6).alias("mrr"))


@query(f"""WITH {LOG}, {_TASKS}, {_MRR} SELECT user_id, day, round(avg(a), 6) AS mean, round(min(a), 6) AS least, round(max(a), 6) AS most FROM mrr GROUP BY user_id, day""")
def tie_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's reciprocal rank over several draws of its ties."""
    return reciprocal_ranks(spark, sf_dir).groupBy(*GROUP).agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.min("a"), 6).alias("least"), F.round(F.max("a"), 6).alias("most"))


@query(f"""WITH {LOG}, {_TASKS}, {_MRR} SELECT seed, count(*) AS groups_, round(avg((a = 1)::INTEGER), 6) AS popular_first, round(avg((b = 1)::INTEGER), 6) AS recent_first FROM mrr GROUP BY seed""")
def positive_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of groups whose first item is a positive."""
    share = lambda c: F.round(F.avg((F.col(c) == 1).cast("int")), 6)
    return reciprocal_ranks(spark, sf_dir).groupBy("seed").agg(F.count("*").alias("groups_"), share("a").alias("popular_first"), share("b").alias("recent_first"))


@query(f"""WITH {LOG}, {_TASKS}, c AS (SELECT user_id, day, score, count(*) AS ties FROM task GROUP BY user_id, day, score)
    SELECT user_id, day, count(*) AS distinct_scores, arg_max(ties, score) AS top_tie FROM c GROUP BY user_id, day""")
def tie_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scores a group tells apart, and how many items share its best one."""
    by = tasks(spark, sf_dir).groupBy(*GROUP, "score").agg(F.count("*").alias("ties"))
    return by.groupBy(*GROUP).agg(F.count("*").alias("distinct_scores"), F.max_by("ties", "score").alias("top_tie"))


@query(f"""WITH {LOG}, {_TASKS}, n AS (SELECT user_id, day, count(*) AS size, sum(label) AS pos FROM task GROUP BY user_id, day),
    r AS (SELECT user_id, day, sum(label) FILTER (rank < 3) AS found FROM ranked GROUP BY user_id, day)
    SELECT count(*) AS pools, round(avg(size), 6) AS mean_size, quantile_cont(size, 0.5) AS median_size, min(size) AS least, max(size) AS most,
           round(avg(coalesce(found, 0) / pos) FILTER (pos > 0), 6) AS recall_3, round(avg(least(3, pos) / pos) FILTER (pos > 0), 6) AS best_recall_3 FROM n LEFT JOIN r USING (user_id, day)""")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the pools, recall at 3, and the recall at 3 that no order could exceed."""
    by = ranked_tasks(spark, sf_dir).groupBy(*GROUP).agg(F.count("*").alias("size"), F.sum("label").alias("pos"), F.sum(F.when(F.col("rank") < 3, F.col("label")).otherwise(0)).alias("found"))
    some = lambda x: F.round(F.avg(F.when(F.col("pos") > 0, x)), 6)
    return by.agg(
        F.count("*").alias("pools"), F.round(F.avg("size"), 6).alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.min("size").alias("least"), F.max("size").alias("most"),
        some(F.col("found") / F.col("pos")).alias("recall_3"), some(F.least(F.lit(3), F.col("pos")) / F.col("pos")).alias("best_recall_3"),
    )


@query(f"""WITH {LOG}, {_TASKS}, l AS (SELECT *, day = max(day) OVER (PARTITION BY user_id) AS latest FROM task)
    SELECT user_id, count(DISTINCT item) AS all_items, count(DISTINCT item) FILTER (latest) AS latest_day, count(DISTINCT item) FILTER (label = 1) AS clicked FROM l GROUP BY user_id""")
def pool_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's candidates over all days and of the latest day only."""
    pool = tasks(spark, sf_dir)
    last = pool.groupBy("user_id").agg(F.max("day").alias("last"))
    per_item = pool.join(last, "user_id").groupBy("user_id", "item").agg(F.max((F.col("day") == F.col("last")).cast("int")).alias("latest"), F.max("label").alias("label"))
    return per_item.groupBy("user_id").agg(F.count("*").alias("all_items"), F.sum("latest").alias("latest_day"), F.sum("label").alias("clicked"))


_SOURCES = """
    src AS (SELECT r.user_id, r.day, r.item, r.label, r.rank, row_number() OVER (PARTITION BY user_id, day ORDER BY pub_s DESC, item) - 1 AS fresh FROM ranked r JOIN items USING (item))
"""


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranked_tasks(spark, sf_dir).join(items(spark, sf_dir).select("item", "pub_s"), "item")
    return df.withColumn("fresh", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("pub_s"), "item")) - 1)


@query(f"""WITH {LOG}, {_TASKS}, {_SOURCES}, g AS (SELECT user_id, day, sum(label) AS pos, sum(label) FILTER (rank < 2) AS a, sum(label) FILTER (fresh < 2) AS b, sum(label) FILTER (rank < 2 OR fresh < 2) AS u,
        count(*) FILTER (rank < 2 OR fresh < 2) AS size FROM src GROUP BY user_id, day HAVING sum(label) > 0)
    SELECT count(*) AS groups_, round(avg(coalesce(a, 0) / pos), 6) AS popular_recall, round(avg(coalesce(b, 0) / pos), 6) AS recent_recall, round(avg(coalesce(u, 0) / pos), 6) AS union_recall, round(avg(size), 6) AS union_size FROM g""")
def source_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 2 of two sources and of their union, and the union's mean size."""
    a, b = F.col("rank") < 2, F.col("fresh") < 2
    hit = lambda x: F.sum(F.when(x, F.col("label")).otherwise(0))
    by = two_sources(spark, sf_dir).groupBy(*GROUP).agg(F.sum("label").alias("pos"), hit(a).alias("a"), hit(b).alias("b"), hit(a | b).alias("u"), F.count_if(a | b).alias("size")).where("pos > 0")
    mean = lambda c: F.round(F.avg(F.col(c) / F.col("pos")), 6)
    return by.agg(F.count("*").alias("groups_"), mean("a").alias("popular_recall"), mean("b").alias("recent_recall"), mean("u").alias("union_recall"), F.round(F.avg("size"), 6).alias("union_size"))


@query(f"""WITH {LOG}, {_TASKS}, {_SOURCES}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY CASE WHEN rank < 2 OR fresh < 2 THEN -rank ELSE '-inf'::DOUBLE END DESC, rank) - 1 AS second FROM src),
    g AS (SELECT user_id, day, 1.0 / (min(rank) FILTER (label = 1) + 1) AS full_, coalesce(1.0 / (min(second) FILTER (label = 1 AND (rank < 2 OR fresh < 2)) + 1), 0) AS two FROM s GROUP BY user_id, day HAVING sum(label) > 0)
    SELECT count(*) AS groups_, round(avg(full_), 6) AS full_mrr, round(avg(two), 6) AS two_stage_mrr, round(avg(two - full_), 6) AS difference FROM g""")
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking only what the sources found, against ranking the whole pool, group by group."""
    inside = (F.col("rank") < 2) | (F.col("fresh") < 2)
    score = F.when(inside, -F.col("rank").cast("double")).otherwise(F.lit(float("-inf")))
    second = F.row_number().over(Window.partitionBy(*GROUP).orderBy(score.desc(), "rank"))
    df = two_sources(spark, sf_dir).withColumn("inside", inside).withColumn("second", second)
    pos = F.col("label") == 1
    by = df.groupBy(*GROUP).agg((1 / (F.min(F.when(pos, F.col("rank"))) + 1)).alias("f"), F.coalesce(1 / F.min(F.when(pos & F.col("inside"), F.col("second"))), F.lit(0.0)).alias("t")).where("f IS NOT NULL")
    return by.agg(F.count("*").alias("groups_"), F.round(F.avg("f"), 6).alias("full_mrr"), F.round(F.avg("t"), 6).alias("two_stage_mrr"), F.round(F.avg(F.col("t") - F.col("f")), 6).alias("difference"))


@query(f"""WITH {LOG}, {_TASKS}, {_SOURCES} SELECT user_id, day, count(*) FILTER (rank < 3 AND fresh < 3) AS both_, round(count(*) FILTER (rank < 3 AND fresh < 3) / count(*) FILTER (rank < 3), 6) AS overlap FROM src GROUP BY user_id, day""")
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of one ranking's first three that another one has among its first three."""
    both = F.count_if((F.col("rank") < 3) & (F.col("fresh") < 3))
    return two_sources(spark, sf_dir).groupBy(*GROUP).agg(both.alias("both_"), F.round(both / F.count_if(F.col("rank") < 3), 6).alias("overlap"))


@query(f"""WITH {LOG}, {_TASKS}, b AS (SELECT 'fixed' AS method, user_id, day, label, row_number() OVER (PARTITION BY user_id, day ORDER BY item) AS r FROM task
        UNION ALL SELECT 'popular', user_id, day, label, rank + 1 FROM ranked
        UNION ALL SELECT 'random', user_id, day, label, row_number() OVER (PARTITION BY user_id, day ORDER BY ('0x' || substr(md5('random:' || user_id || ':' || day || ':' || item), 1, 8))::BIGINT, item) FROM task
        UNION ALL SELECT 'recent', user_id, day, label, row_number() OVER (PARTITION BY user_id, day ORDER BY pub_s DESC, item) FROM task JOIN items USING (item)),
    g AS (SELECT method, user_id, day, 1.0 / min(r) FILTER (label = 1) AS mrr, sum(label) FILTER (r <= 2) / sum(label) AS recall FROM b GROUP BY ALL HAVING sum(label) > 0)
    SELECT method, count(*) AS groups_, round(avg(mrr), 6) AS mrr, round(avg(coalesce(recall, 0)), 6) AS recall_2 FROM g GROUP BY method""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed order, popularity, chance and recency, on the same groups."""
    pool = tasks(spark, sf_dir).join(items(spark, sf_dir).select("item", "pub_s"), "item")
    w = Window.partitionBy(*GROUP)
    orders = {
        "fixed": [F.col("item")], "popular": [F.desc("score"), md5_number(F.lit(0), F.col("item")), F.col("item")],
        "random": [md5_number(F.lit("random"), F.col("user_id"), F.col("day"), F.col("item")), F.col("item")], "recent": [F.desc("pub_s"), F.col("item")],
    }
    placed = pool.select("*", *[F.row_number().over(w.orderBy(*o)).alias(m) for m, o in orders.items()]).unpivot([*GROUP, "label"], list(orders), "method", "r")
    found = F.coalesce(F.sum(F.when(F.col("r") <= 2, F.col("label"))), F.lit(0))
    by = placed.groupBy("method", *GROUP).agg((1 / F.min(F.when(F.col("label") == 1, F.col("r")))).alias("mrr"), (found / F.nullif(F.sum("label"), F.lit(0))).alias("recall")).where("mrr IS NOT NULL")
    return by.groupBy("method").agg(F.count("*").alias("groups_"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall_2"))


@query(f"""WITH {LOG}, {_TASKS}, g AS (SELECT user_id, day, item, round(ln(score + 1) - ln(-ln((('0x' || substr(md5('gumbel:' || user_id || ':' || day || ':' || item), 1, 8))::BIGINT + 0.5) / 4294967296.0)), 9) AS k FROM task),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY k DESC, item) AS place FROM g) SELECT user_id, day, item, place FROM r WHERE place <= 3""")
def gumbel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items drawn without replacement by their weights: the largest log weights with Gumbel noise."""
    u = (md5_number(F.lit("gumbel"), F.col("user_id"), F.col("day"), F.col("item")) + 0.5) / F.lit(4294967296.0)
    keyed = tasks(spark, sf_dir).withColumn("k", F.round(F.log(F.col("score") + F.lit(1.0)) - F.log(-F.log(u)), 9))
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("k"), "item")).cast("long")
    return keyed.withColumn("place", place).where("place <= 3").select(*GROUP, "item", "place")


@query(f"""WITH {LOG}, {_TASKS}, m AS (SELECT *, ('0x' || substr(md5('mask:' || user_id || ':' || day), 1, 8))::BIGINT % 4 = 0 AS masked FROM task)
    SELECT user_id, day, item, masked, CASE WHEN masked THEN 0 ELSE score END AS score FROM m""")
def popularity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity set to 0 for a repeatable quarter of the groups, as in training for new items."""
    masked = md5_number(F.lit("mask"), F.col("user_id"), F.col("day")) % 4 == 0
    return tasks(spark, sf_dir).select(*GROUP, "item", masked.alias("masked"), F.when(masked, 0).otherwise(F.col("score")).cast("long").alias("score"))


@query(f"""WITH {LOG}, x AS (SELECT event_id, s, ln(1 + greatest(value, 0)) AS x FROM log), f AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM x WHERE s < {AS_OF})
    SELECT event_id, round(coalesce((x - m) / nullif(sd, 0), 0), 6) AS scaled, (x IS NULL)::INTEGER AS missing FROM x, f""")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log values scaled by mean and deviation of the rows before the snapshot; missing ones become 0 with a mark."""
    x = F.log1p(F.greatest(F.col("value").cast("double"), F.lit(0.0)))
    log = event_log(spark, sf_dir).select("event_id", "s", F.when(F.col("value").isNotNull(), x).alias("x"))
    fitted = log.where(F.col("s") < AS_OF).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))  # one row
    scaled = F.coalesce((F.col("x") - F.col("m")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0))
    return log.join(F.broadcast(fitted)).select("event_id", F.round(scaled, 6).alias("scaled"), F.col("x").isNull().cast("int").alias("missing"))


@query(f"""WITH {LOG}, c AS (SELECT user_id, count(*) AS clicks FROM clicks WHERE s < {AS_OF} GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM log)
    SELECT user_id, coalesce(clicks, 0) AS clicks, CASE WHEN clicks >= 1 THEN 1 ELSE 0 END AS may_history, CASE WHEN clicks >= 5 THEN 1 ELSE 0 END AS may_category, 1 AS may_popular FROM u LEFT JOIN c USING (user_id)""")
def source_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources may offer candidates to a user: those whose signal the user has."""
    log = event_log(spark, sf_dir)
    before = (F.col("event_type") == "click") & (F.col("s") < AS_OF)
    by = log.groupBy("user_id").agg(F.count_if(before).alias("clicks"))
    return by.select("user_id", "clicks", (F.col("clicks") >= 1).cast("int").alias("may_history"), (F.col("clicks") >= 5).cast("int").alias("may_category"), F.lit(1).alias("may_popular"))


@query(f"WITH {LOG} SELECT event_id, coalesce(CASE WHEN i.item % 2 = 0 THEN i.item // 2 END, -1) AS place FROM log LEFT JOIN items i ON i.item = log.item AND i.item % 2 = 0")
def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of an event's item in a catalogue of every second item, -1 where it isn't there."""
    catalogue = items(spark, sf_dir).where("item % 2 = 0").select("item", F.expr("item div 2").alias("place"))
    return event_log(spark, sf_dir).join(catalogue, "item", "left").select("event_id", F.coalesce("place", F.lit(-1)).alias("place"))


@query(f"WITH {LOG}, k AS (SELECT DISTINCT user_id, item FROM clicks) SELECT event_id, (k.user_id IS NOT NULL)::INTEGER AS clicked FROM views LEFT JOIN k USING (user_id, item)")
def packed_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a view's (user, item) is among the clicked pairs; a pair without user or item is never."""
    key = ["user_id", "item"]
    pairs = clicks(spark, sf_dir).select(*key).distinct().withColumn("clicked", F.lit(1))
    return event_log(spark, sf_dir, "view").select("event_id", *key).join(pairs, key, "left").select("event_id", F.coalesce("clicked", F.lit(0)).alias("clicked"))


@query(f"""WITH {LOG}, c AS (SELECT item, count(*) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type = 'view') AS n FROM log GROUP BY item),
    x AS (SELECT k::DOUBLE / greatest(n, 1) AS a, (k::FLOAT / greatest(n, 1)::FLOAT)::FLOAT::DOUBLE AS b, CASE WHEN n > 0 THEN ln(n) END AS c, CASE WHEN n > 1 THEN ln(n) END AS d FROM c)
    SELECT 'ctr' AS name, max(abs(a - b)) <= 1e-6 AS within, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS mismatched FROM x
    UNION ALL SELECT 'log_views', coalesce(max(abs(c - d)), 0) <= 1e-6, count(*) FILTER ((c IS NULL) <> (d IS NULL)) FROM x""")
def parity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column by column, whether two ways to a feature agree, and how often only one of them is missing."""
    by = event_log(spark, sf_dir).groupBy("item").agg(F.count_if(F.col("event_type") == "click").alias("k"), F.count_if(F.col("event_type") == "view").alias("n"))
    n = F.greatest("n", F.lit(1))
    x = by.select(
        (F.col("k") / n).alias("a"), (F.col("k").cast("float") / n.cast("float")).cast("float").cast("double").alias("b"),
        F.when(F.col("n") > 0, F.log("n")).alias("c"), F.when(F.col("n") > 1, F.log("n")).alias("d"),
    )
    checks = [("ctr", "a", "b"), ("log_views", "c", "d")]
    sums = x.agg(*[f for m, p, q in checks for f in (F.coalesce(F.max(F.abs(F.col(p) - F.col(q))), F.lit(0.0)).alias(f"{m}_gap"), F.count_if(F.col(p).isNull() != F.col(q).isNull()).alias(f"{m}_odd"))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), (F.col(f"{m}_gap") <= 1e-6).alias("within"), F.col(f"{m}_odd").alias("mismatched")) for m, _, _ in checks])).alias("r")
    return sums.select(rows).select("r.*")


@query(f"""WITH {LOG}, g AS (SELECT user_id, s // 86400 AS day, count(*) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type = 'view') AS n FROM log GROUP BY ALL)
    SELECT round(sum(k) / sum(n), 6) AS pooled, round(avg(k / n) FILTER (n > 0), 6) AS mean_of_groups, quantile_cont(n, 0.5) FILTER (n > 0) AS median_views FROM g""")
def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks a view over all, the mean of the groups' rates, and the median number of views."""
    by = event_log(spark, sf_dir).groupBy("user_id", F.expr("s div 86400").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("k"), F.count_if(F.col("event_type") == "view").alias("n"))
    some = lambda x: F.when(F.col("n") > 0, x)
    return by.agg(F.round(F.sum("k") / F.sum("n"), 6).alias("pooled"), F.round(F.avg(some(F.col("k") / F.col("n"))), 6).alias("mean_of_groups"), F.percentile(some(F.col("n")), 0.5).alias("median_views"))


@query(f"""WITH {LOG}, d AS (SELECT DISTINCT user_id, s // 86400 AS day, item FROM log WHERE event_type IN ('click', 'view')), n AS (SELECT user_id, day, count(*) AS n FROM d GROUP BY ALL),
    w AS (SELECT user_id, day, n, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS m FROM n),
    b AS (SELECT w.user_id, w.day, count(*) AS both_ FROM w JOIN d x ON x.user_id = w.user_id AND x.day = w.day JOIN d y ON y.user_id = w.user_id AND y.day = w.before AND y.item = x.item GROUP BY ALL)
    SELECT user_id, day, round(1 - coalesce(both_, 0) / (n + m - coalesce(both_, 0)), 6) AS change FROM w LEFT JOIN b USING (user_id, day) WHERE before IS NOT NULL""")
def reactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a user's items of a day differ (Jaccard distance) from those of the user's day before."""
    seen = event_log(spark, sf_dir, "click", "view").select("user_id", F.expr("s div 86400").alias("day"), "item").distinct()
    days = seen.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    days = days.withColumn("before", F.lag("day").over(w)).withColumn("m", F.lag("n").over(w)).where("before IS NOT NULL")
    earlier = seen.withColumnRenamed("day", "before")
    both = seen.join(days, ["user_id", "day"]).join(earlier, ["user_id", "before", "item"]).groupBy("user_id", "day").agg(F.count("*").alias("both_"))
    b = F.coalesce("both_", F.lit(0))
    return days.join(both, ["user_id", "day"], "left").select("user_id", "day", F.round(1 - b / (F.col("n") + F.col("m") - b), 6).alias("change"))


@query(f"""WITH {LOG}, o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM log WHERE event_type IN ('click', 'view'))
    SELECT user_id, count(*) AS events, min(i) FILTER (event_type = 'click') AS first_click FROM o GROUP BY user_id""")
def first_click_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the first event of a user that is a click, from a count of those before it."""
    log = event_log(spark, sf_dir, "click", "view")
    at = F.struct("us", "event_id")
    first = log.groupBy("user_id").agg(F.count("*").alias("events"), F.min(F.when(F.col("event_type") == "click", at)).alias("first"))
    earlier = log.select("user_id", at.alias("at")).join(first, "user_id").groupBy("user_id").agg(F.count_if(F.col("at") <= F.col("first")).alias("i"))
    return first.join(earlier, "user_id").select("user_id", "events", F.when(F.col("first").isNotNull(), F.col("i")).alias("first_click"))


@query(f"WITH {LOG} SELECT event_type, item % 10 AS decade, grouping(event_type, item % 10)::BIGINT AS grouping_, count(*) AS n FROM log GROUP BY CUBE (event_type, item % 10)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = event_log(spark, sf_dir).withColumn("decade", F.col("item") % 10).cube("event_type", "decade")
    return cube.agg(F.grouping_id().alias("grouping_"), F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT event_type, s // 86400 AS day, count(*) AS n FROM log GROUP BY GROUPING SETS ((event_type), (s // 86400), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("day", F.expr("s div 86400"))
    return log.groupingSets([["event_type"], ["day"], []], "event_type", "day").agg(F.count("*").alias("n")).select("event_type", "day", "n")


@query(f"WITH {LOG} SELECT user_id, item FROM clicks INTERSECT SELECT user_id, item FROM views")
def clicked_and_viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).select("user_id", "item").intersect(event_log(spark, sf_dir, "view").select("user_id", "item"))


@query(f"WITH {LOG} SELECT user_id, item FROM clicks EXCEPT ALL SELECT user_id, item FROM views")
def clicked_beyond_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks less as many views of the same user and item."""
    return clicks(spark, sf_dir).select("user_id", "item").exceptAll(event_log(spark, sf_dir, "view").select("user_id", "item"))


@query(f"""WITH {LOG}, {_SLOTS}, x AS (SELECT s.*, rank = position AS hit FROM slots s LEFT JOIN target t USING (request, item)),
    e AS (SELECT sum(CASE WHEN hit THEN reward / propensity ELSE 0 END) / sum(CASE WHEN hit THEN 1 / propensity ELSE 0 END) AS estimate, avg(reward) FILTER (hit AND NOT explored) AS measured,
          sum(CASE WHEN hit THEN 1 / propensity ELSE 0 END) ** 2 / sum(CASE WHEN hit THEN 1 / propensity ** 2 ELSE 0 END) / count(*) AS ess FROM x)
    SELECT round(estimate, 6) AS estimate, round(measured, 6) AS measured, round(abs(estimate - measured) / measured, 6) AS relative_error, round(ess, 6) AS ess_ratio,
           abs(estimate - measured) / measured <= 0.15 AND ess >= 0.01 AS passes FROM e""")
def ope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An off-policy estimate against the rate measured where the policy itself was shown."""
    log = slots(spark, sf_dir)
    x = log.join(targets(log), ["request", "item"], "left").withColumn("hit", F.coalesce(F.col("rank") == F.col("position"), F.lit(False)))
    w = F.when(F.col("hit"), 1 / F.col("propensity")).otherwise(0.0)
    one = x.agg(
        (F.sum(w * F.col("reward")) / F.sum(w)).alias("e"), F.avg(F.when(F.col("hit") & ~F.col("explored"), F.col("reward"))).alias("m"),
        (F.sum(w) ** 2 / F.sum(w * w) / F.count("*")).alias("ess"),
    )
    error = F.abs(F.col("e") - F.col("m")) / F.col("m")
    return one.select(F.round("e", 6).alias("estimate"), F.round("m", 6).alias("measured"), F.round(error, 6).alias("relative_error"), F.round("ess", 6).alias("ess_ratio"), ((error <= 0.15) & (F.col("ess") >= 0.01)).alias("passes"))


@query(f"""WITH {LOG}, {_SLOTS} SELECT user_id, count(DISTINCT request) AS requests, count(*) AS slots, sum(reward)::BIGINT AS clicks, round(sum(reward) / count(*), 6) AS rate FROM slots
    WHERE request IN (SELECT request FROM slots WHERE explored) GROUP BY user_id""")
def policy_user_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by user of the requests that explored at least one place."""
    log = slots(spark, sf_dir)
    kept = log.join(log.where("explored").select("request").distinct(), "request", "left_semi")
    return kept.groupBy("user_id").agg(F.count_distinct("request").alias("requests"), F.count("*").alias("slots"), F.sum("reward").cast("long").alias("clicks"), F.round(F.sum("reward") / F.count("*"), 6).alias("rate"))


@query(f"""WITH {LOG}, p AS (SELECT item, row_number() OVER (ORDER BY pub_s, item) AS place, pub_s FROM items), c AS (SELECT event_id, user_id, item, s FROM clicks),
    n AS (SELECT c.*, (SELECT count(*) FROM p WHERE pub_s < c.s) AS pool FROM c), t AS (SELECT event_id, user_id, j, 1 + ('0x' || substr(md5('negative:' || event_id || ':' || j), 1, 8))::BIGINT % pool AS place FROM n, range(6) g(j) WHERE pool > 0),
    e AS (SELECT DISTINCT user_id, item FROM clicks), f AS (SELECT t.event_id, t.j, p.item FROM t JOIN p USING (place) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = t.user_id AND e.item = p.item)),
    g AS (SELECT event_id, item, min(j) AS j FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY j) AS k FROM g)
    SELECT event_id, k, item FROM r WHERE k <= 2""")
def drawn_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two items for each click: out by then, never clicked by the user, drawn by repeatable places in the pool.

    A draw names a place among the items in order of publication, so no click meets the whole pool.
    """
    return negatives.drawn(clicks(spark, sf_dir), items(spark, sf_dir).select("item", "pub_s"), 6, 2).select("event_id", F.col("k").cast("long").alias("k"), "item")


@query(f"""WITH {LOG}, o AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM clicks)
    SELECT user_id, any_value(n) AS clicks, min(s) AS first_s, max(s) AS last_s, min(s) FILTER (i > floor(n * 0.8)) AS answer_s FROM o GROUP BY user_id""")
def protocol_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's fit window and the second at which the last fifth of the clicks, the answers, begins."""
    w = Window.partitionBy("user_id")
    o = clicks(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("us", "event_id"))).withColumn("n", F.count("*").over(w))
    answer = F.min(F.when(F.col("i") > F.floor(F.col("n") * 0.8), F.col("s")))
    return o.groupBy("user_id").agg(F.max("n").alias("clicks"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), answer.alias("answer_s"))


@query(f"""WITH {LOG} SELECT gap, count(*) AS clicks, count(*) FILTER ((s + gap) // 86400 <> s // 86400) AS moved_day, count(*) FILTER ((s + gap) // 21600 <> s // 21600) AS moved_quarter
    FROM clicks, (SELECT unnest([0, 60, 600, 3600]) AS gap) GROUP BY gap""")
def gap_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clicks change their window when their times are off by a gap."""
    gaps = F.explode(F.array(*[F.lit(x) for x in (0, 60, 600, 3600)])).alias("gap")
    log = clicks(spark, sf_dir).select("s", gaps)
    moved = lambda w: F.count_if(F.expr(f"(s + gap) div {w} <> s div {w}"))
    return log.groupBy("gap").agg(F.count("*").alias("clicks"), moved(DAY).alias("moved_day"), moved(21600).alias("moved_quarter"))


@query(f"""WITH {LOG} SELECT r.req, count(c.event_id) AS to_request, count(c.event_id) FILTER (c.s < r.t // 86400 * 86400) AS to_day, count(c.event_id) FILTER (c.s < {AS_OF}) AS to_window
    FROM requests r LEFT JOIN clicks c ON c.user_id = r.user_id AND c.s < r.t GROUP BY r.req""")
def replay_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history that a request has with three cutoffs: its own time, its day's start, and the window's start."""
    asked = requests(spark, sf_dir)
    cuts = asked.select("req", "user_id", F.explode(F.array(*[F.struct(F.lit(n).alias("cut"), x.alias("at")) for n, x in (("t", F.col("t")), ("d", F.expr(f"t div {DAY} * {DAY}")), ("w", F.least("t", F.lit(AS_OF))))])).alias("c"))
    cuts = cuts.select("req", "user_id", "c.cut", "c.at")
    both = asof.merged(cuts, clicks(spark, sf_dir).select("user_id", "s"), "user_id", "at", "s")
    found = asof.prefix_sums(both, ["user_id"], "at", [F.col("at"), F.col("kind")], 7 * DAY, n=F.col("kind").cast("long")).where("kind = 0")
    each = found.select("request.req", "request.cut", "n").groupBy("req")
    return each.agg(*[F.max(F.when(F.col("cut") == c, F.col("n"))).alias(n) for c, n in (("t", "to_request"), ("d", "to_day"), ("w", "to_window"))])


_FOLDS = """
    f AS (SELECT n_chars, quality, ('0x' || substr(md5('fold:' || doc_id), 1, 8))::BIGINT % 2 AS fold FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    g AS (SELECT fold, t.cut, count(*) AS n, count(*) FILTER (n_chars >= t.cut AND quality = 1) AS tp, count(*) FILTER (n_chars >= t.cut) AS p, sum(quality) AS y FROM f, (SELECT unnest([100, 200, 400, 800, 1600]) AS cut) t GROUP BY ALL),
    k AS (SELECT *, (tp + (n - p - y + tp)) / n AS po, (p * y + (n - p) * (n - y)) / (n * n) AS pe FROM g),
    r AS (SELECT fold, cut, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0 END, 9) AS kappa FROM k)
"""


@query(f"""WITH {_FOLDS}, b AS (SELECT fold, arg_max(cut, kappa * 1000000 - cut / 1000000) AS cut FROM r GROUP BY fold)
    SELECT b.fold AS chosen_on, b.cut, round(r.kappa, 6) AS kappa FROM b JOIN r ON r.fold = 1 - b.fold AND r.cut = b.cut""")
def oof_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length rule that agrees best with the label on one fold, and its kappa on the other."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("long").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id")
    docs = docs.withColumn("fold", md5_number(F.lit("fold"), F.col("doc_id")) % 2)
    grid = docs.withColumn("cut", F.explode(F.array(*[F.lit(x) for x in (100, 200, 400, 800, 1600)])))
    yes = F.col("n_chars") >= F.col("cut")
    c = grid.groupBy("fold", "cut").agg(F.count("*").alias("n"), F.count_if(yes & (F.col("quality") == 1)).alias("tp"), F.count_if(yes).alias("p"), F.sum("quality").alias("y"))
    n, tp, p, y = (F.col(x).cast("double") for x in ("n", "tp", "p", "y"))
    po, pe = (tp + n - p - y + tp) / n, (p * y + (n - p) * (n - y)) / (n * n)
    r = c.select("fold", "cut", F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(0.0), 9).alias("kappa"))
    best = r.groupBy("fold").agg(F.max_by("cut", F.struct("kappa", -F.col("cut"))).alias("cut"))
    other = r.select((1 - F.col("fold")).alias("fold"), "cut", "kappa")
    return best.join(other, ["fold", "cut"]).select(F.col("fold").alias("chosen_on"), "cut", F.round("kappa", 6).alias("kappa"))


@query("""SELECT source, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS good,
    count(*) FILTER (quality = toxic) AS same, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by source and length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    kind = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    q, t = F.col("quality"), F.col("toxic")
    return docs.groupBy("source", kind.alias("bucket")).agg(F.count("*").alias("n"), F.count_if((q == 1) & (t == 0)).alias("good"), F.count_if(q == t).alias("same"), F.round(F.avg(q), 6).alias("quality"), F.round(F.avg(t), 6).alias("toxic"))


@query("""SELECT source, cap, count(*) AS n, round(avg((n > cap)::INTEGER), 6) AS cut_share, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM (SELECT source, length(text) AS n FROM documents WHERE text IS NOT NULL),
    (SELECT unnest([256, 512, 1024, 4096]) AS cap) GROUP BY source, cap""")
def truncation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of a source's texts a length limit would cut."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.char_length("text").alias("n"))
    grid = docs.withColumn("cap", F.explode(F.array(*[F.lit(x) for x in (256, 512, 1024, 4096)])))
    return grid.groupBy("source", "cap").agg(F.count("*").alias("n"), F.round(F.avg((F.col("n") > F.col("cap")).cast("int")), 6).alias("cut_share"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"))



@query("""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, ('0x' || substr(md5('batch:' || doc_id), 1, 8))::BIGINT % 64 AS w FROM documents)
    SELECT doc_id, w AS sort_window, (row_number() OVER (PARTITION BY w ORDER BY n, doc_id) - 1) // 32 AS batch FROM d""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 texts of like length, sorted inside windows that a hash deals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), (md5_number(F.lit("batch"), F.col("doc_id")) % 64).alias("sort_window"))
    place = F.row_number().over(Window.partitionBy("sort_window").orderBy("n", "doc_id")) - 1
    return docs.select("doc_id", "sort_window", F.floor(place / 32).alias("batch"))
