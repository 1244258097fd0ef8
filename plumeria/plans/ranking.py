"""Candidates, ranking metrics, off-policy estimates and interval estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeria.functions import scores, vectors
from plumeria.operators import inference, policy, ranking
from plumeria.plans.features import AS_OF, SIZE, _UNIT
from plumeria.plans.registry import LOG, query
from plumeria.sources.tables import clicks, event_log, items

GROUP = ["user_id", "day"]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, item, label, score): a user's items of a day, whether clicked, scored by popularity."""
    log = event_log(spark, sf_dir, "click", "view").withColumn("day", F.expr("s div 86400"))
    label = F.max((F.col("event_type") == "click").cast("int")).alias("label")
    popular = clicks(spark, sf_dir, until=AS_OF).groupBy("item").agg(F.count("*").alias("score"))
    return log.groupBy(*GROUP, "item").agg(label).join(popular, "item", "left").na.fill(0)


_TASKS = f"""
    popular AS (SELECT item, count(*) AS score FROM clicks WHERE s < {AS_OF} GROUP BY item),
    cand AS (SELECT user_id, s // 86400 AS day, item, max((event_type = 'click')::INTEGER) AS label FROM log
             WHERE event_type IN ('click', 'view') GROUP BY user_id, s // 86400, item),
    task AS (SELECT c.*, coalesce(p.score, 0) AS score FROM cand c LEFT JOIN popular p USING (item)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY score DESC,
               ('0x' || substr(md5('0:' || item), 1, 8))::BIGINT, item) - 1 AS rank FROM task)
"""


def ranked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(tasks(spark, sf_dir), GROUP, "score", "item")


@query(f"WITH {LOG}, {_TASKS} SELECT user_id, day, item, rank FROM ranked")
def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_tasks(spark, sf_dir).select(*GROUP, "item", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {LOG}, {_TASKS} SELECT user_id, day, string_agg(item::VARCHAR, ',' ORDER BY rank) AS items FROM ranked WHERE rank < 3 GROUP BY user_id, day")
def top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ranking.top_items(ranked_tasks(spark, sf_dir), GROUP, 3)
    return lists.select(*GROUP, F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"""WITH {LOG}, {_TASKS}, r AS (SELECT *, rank() OVER (PARTITION BY user_id, day ORDER BY score) AS f,
        count(*) OVER (PARTITION BY user_id, day, score) AS ties, count(*) OVER (PARTITION BY user_id, day) AS n FROM task)
    SELECT user_id, day, item, round(CASE WHEN n = 1 THEN 0.5 ELSE (f - 1 + (ties - 1) / 2.0) / (n - 1) END, 6) AS average_rank FROM r""")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.average_rank(tasks(spark, sf_dir), GROUP, "score").select(*GROUP, "item", F.round("average_rank", 6).alias("average_rank"))


@query(f"""WITH {LOG}, {_TASKS}, p AS (SELECT a.user_id, a.day, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
        FROM task a JOIN task b ON a.user_id = b.user_id AND a.day = b.day AND a.label = 1 AND b.label = 0 GROUP BY a.user_id, a.day)
    SELECT c.user_id, c.day, round(p.auc, 6) AS auc FROM (SELECT DISTINCT user_id, day FROM task) c LEFT JOIN p USING (user_id, day)""")
def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.group_auc(tasks(spark, sf_dir), GROUP, "score", "label").select(*GROUP, F.round("auc", 6).alias("auc"))


_METRICS = """
    sums AS (SELECT user_id, day, sum(label) AS n_pos, min(rank) FILTER (label = 1) AS first,
             coalesce(sum(1 / log2(rank + 2)) FILTER (label = 1 AND rank < 2), 0) AS gain, count(*) FILTER (label = 1 AND rank < 2) AS hits
             FROM ranked GROUP BY user_id, day),
    metrics AS (SELECT user_id, day, CASE WHEN n_pos > 0 THEN 1.0 / (first + 1) END AS mrr,
             CASE WHEN n_pos > 0 THEN gain / CASE WHEN n_pos = 1 THEN 1.0 ELSE 1.0 + 1 / log2(3) END END AS ndcg,
             CASE WHEN n_pos > 0 THEN hits / n_pos END AS recall FROM sums)
"""


@query(f"WITH {LOG}, {_TASKS}, {_METRICS} SELECT user_id, day, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM metrics")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.ranking_metrics(ranked_tasks(spark, sf_dir), GROUP, "label", 2)
    return found.select(*GROUP, *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "recall")])


@query(f"""WITH {LOG}, {_TASKS}, u AS (SELECT user_id, day, count(*) FILTER (label = 1 AND rank < 3) AS hits, count(*) FILTER (rank < 3) AS shown,
        sum(label) AS truth FROM ranked GROUP BY user_id, day), v AS (SELECT user_id, avg(hits / 3.0) AS p, avg(CASE WHEN truth > 0 THEN hits / truth END) AS r, count(*) AS lists FROM u GROUP BY user_id)
    SELECT count(*) AS users, round(avg(p), 6) AS precision_3, round(avg(r), 6) AS recall_3,
           round((SELECT count(DISTINCT item) FROM ranked WHERE rank < 3) / (SELECT count(DISTINCT item) FROM task), 6) AS coverage FROM v""")
def list_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at 3 as the mean over users, and the share of the catalogue that is shown."""
    df = ranked_tasks(spark, sf_dir)
    hit = (F.col("label") == 1) & (F.col("rank") < 3)
    lists = df.groupBy(*GROUP).agg(F.count_if(hit).alias("hits"), F.sum("label").alias("truth"))
    recall = F.when(F.col("truth") > 0, F.col("hits") / F.col("truth"))
    users = lists.groupBy("user_id").agg(F.avg(F.col("hits") / 3).alias("p"), F.avg(recall).alias("r"))
    one = users.agg(F.count("*").alias("users"), F.round(F.avg("p"), 6).alias("precision_3"), F.round(F.avg("r"), 6).alias("recall_3"))
    shown = df.agg((F.count_distinct(F.when(F.col("rank") < 3, F.col("item"))) / F.count_distinct("item")).alias("c"))
    return one.join(F.broadcast(shown)).select("users", "precision_3", "recall_3", F.round("c", 6).alias("coverage"))  # one row each


@query(f"""WITH {LOG}, {_TASKS}, e AS (SELECT user_id, day, i.item, {_UNIT} AS u FROM ranked JOIN items i USING (item) WHERE rank < 5),
    n AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY user_id, day),
    s AS (SELECT user_id, day, sum(x) AS x FROM (SELECT user_id, day, unnest(u) AS x, unnest(range(64)) AS dim FROM e) GROUP BY user_id, day, dim)
    SELECT user_id, day, round(1 - (sum(x * x) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 5) AS ild
    FROM s JOIN n USING (user_id, day) WHERE n >= 2 GROUP BY user_id, day""")
def intra_list_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine distance of a list's pairs from the length of the sum of its unit vectors: no pairs are made."""
    unit = items(spark, sf_dir).select("item", vectors.unit(F.col("emb")).alias("u"))
    lists = ranked_tasks(spark, sf_dir).where("rank < 5").join(unit, "item")
    sums = lists.groupBy(*GROUP).agg(F.count("*").alias("n"), *vectors.element_sums(F.col("u"), SIZE, F.lit(1.0))).where("n >= 2")
    total = vectors.gathered(SIZE)
    pairs = F.col("n") * (F.col("n") - 1)
    return sums.select(*GROUP, F.round(1 - (vectors.dot(total, total) - F.col("n")) / pairs, 5).alias("ild"))


@query(f"""WITH {LOG}, {_TASKS}, c AS (SELECT user_id, day, category, count(*) AS k FROM ranked JOIN items USING (item) WHERE rank < 10 GROUP BY ALL),
    p AS (SELECT *, k / sum(k) OVER (PARTITION BY user_id, day) AS p FROM c)
    SELECT user_id, day, round(abs(-sum(p * log2(p))), 6) AS entropy FROM p GROUP BY user_id, day""")
def category_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ranked_tasks(spark, sf_dir).where("rank < 10").join(items(spark, sf_dir).select("item", "category"), "item")
    counts = shown.groupBy(*GROUP, "category").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(*GROUP))
    return counts.withColumn("p", p).groupBy(*GROUP).agg(F.round(F.abs(F.sum(F.col("p") * F.log2("p"))), 6).alias("entropy"))


@query(f"""WITH {LOG}, {_TASKS}, k AS (SELECT item, count(*) AS shown FROM ranked WHERE rank < 5 GROUP BY item), n AS (SELECT sum(shown) AS all_, count(*) AS m FROM k)
    SELECT user_id, round(avg(-log2((shown + 1) / (all_ + m))), 5) AS novelty FROM ranked JOIN k USING (item), n WHERE rank < 5 GROUP BY user_id""")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean self-information of the shown items, with one added to every item's count."""
    top = ranked_tasks(spark, sf_dir).where("rank < 5")
    counts = top.groupBy("item").agg(F.count("*").alias("shown"))
    total = counts.agg(F.sum("shown").alias("all_"), F.count("*").alias("m"))
    p = (F.col("shown") + 1) / (F.col("all_") + F.col("m"))
    joined = top.join(counts, "item").join(F.broadcast(total))  # one row
    return joined.groupBy("user_id").agg(F.round(F.avg(-F.log2(p)), 5).alias("novelty"))


@query(f"""WITH {LOG}, {_TASKS}, b AS (SELECT user_id, day, score, avg(label) AS gain, sum(1 / log2(rank + 2)) AS disc, min(rank) AS at FROM ranked GROUP BY user_id, day, score),
    n AS (SELECT user_id, day, sum(label) AS n_pos, count(*) AS size FROM ranked GROUP BY user_id, day), i AS (SELECT r.user_id, r.day, sum(1 / log2(rank + 2)) AS ideal FROM ranked r JOIN n USING (user_id, day) WHERE rank < n_pos GROUP BY r.user_id, r.day)
    SELECT n.user_id, n.day, round(CASE WHEN n_pos = 0 THEN 1.0 ELSE (SELECT sum(gain * disc) FROM b WHERE b.user_id = n.user_id AND b.day = n.day) / ideal END, 6) AS expected_ndcg
    FROM n LEFT JOIN i USING (user_id, day)""")
def expected_tie_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG over whole groups as expected when ties fall at random; 1 for groups without positives."""
    df = ranked_tasks(spark, sf_dir).withColumn("d", ranking.discount(F.col("rank")))
    df = df.withColumn("n_pos", F.sum("label").over(Window.partitionBy(*GROUP)))
    ideal = F.sum(F.when(F.col("rank") < F.col("n_pos"), F.col("d")).otherwise(0.0)).alias("ideal")
    blocks = df.groupBy(*GROUP, "score").agg((F.avg("label") * F.sum("d")).alias("gain"), ideal)
    sums = blocks.groupBy(*GROUP).agg(F.sum("gain").alias("gain"), F.sum("ideal").alias("ideal"))
    return sums.select(*GROUP, F.round(F.when(F.col("ideal") > 0, F.col("gain") / F.col("ideal")).otherwise(1.0), 6).alias("expected_ndcg"))


@query(f"""WITH {LOG}, {_TASKS}, t AS (SELECT ranked.*, pub_s, row_number() OVER (PARTITION BY user_id, day ORDER BY pub_s DESC, item) - 1 AS fresh FROM ranked JOIN items USING (item))
    SELECT user_id, day, item, (rank < 2)::INTEGER AS src_popular, (fresh < 2)::INTEGER AS src_recent, (rank < 2)::INTEGER + (fresh < 2)::INTEGER AS src_count FROM t""")
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two sources has a candidate among its first two."""
    df = ranked_tasks(spark, sf_dir).join(items(spark, sf_dir).select("item", "pub_s"), "item")
    fresh = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("pub_s"), "item")) - 1
    df = df.withColumn("a", (F.col("rank") < 2).cast("int")).withColumn("b", (fresh < 2).cast("int"))
    return df.select(*GROUP, "item", F.col("a").alias("src_popular"), F.col("b").alias("src_recent"), (F.col("a") + F.col("b")).alias("src_count"))


@query(f"""WITH {LOG}, {_TASKS}, t AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM task WINDOW w AS (PARTITION BY user_id, day))
    SELECT user_id, day, item, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS scaled FROM t""")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*GROUP)
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    return tasks(spark, sf_dir).select(*GROUP, "item", F.round(scaled, 6).alias("scaled"))


@query(f"""WITH {LOG}, f AS (SELECT user_id, category, count(*) AS n FROM clicks JOIN items USING (item) WHERE s < {AS_OF} GROUP BY user_id, category),
    top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS r FROM f), cats AS (SELECT user_id, list(category) AS cats, count(*) AS ncat FROM top WHERE r <= 3 GROUP BY user_id)
    SELECT v.event_id, coalesce(ncat, 0) AS user_ncat, (list_contains(cats, category) IS TRUE)::INTEGER AS is_cat_match
    FROM views v JOIN items USING (item) LEFT JOIN cats USING (user_id) WHERE v.s >= {AS_OF}""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a viewed item's category is one of the three that the user clicked most before the snapshot."""
    kinds = items(spark, sf_dir).select("item", "category")
    counts = clicks(spark, sf_dir, until=AS_OF).join(kinds, "item").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "category"))
    cats = counts.withColumn("r", place).where("r <= 3").groupBy("user_id").agg(F.collect_set("category").alias("cats"))
    seen = event_log(spark, sf_dir, "view", since=AS_OF).join(kinds, "item").join(cats, "user_id", "left")
    return seen.select(
        "event_id", F.when(F.col("cats").isNull(), 0).otherwise(F.size("cats")).cast("long").alias("user_ncat"),
        F.coalesce(F.array_contains("cats", F.col("category")), F.lit(False)).cast("int").alias("is_cat_match"),
    )


# A slot log: a user's views of an hour are a slate; the propensity is a half for explored places, else 1.
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir, "view").withColumn("request", F.concat_ws("-", "user_id", F.expr("s div 86400")))
    place = F.row_number().over(Window.partitionBy("request").orderBy("us", "event_id")) - 1
    explored = scores.md5_number(F.lit("explore"), F.col("event_id")) % 3 == 0
    return log.select(
        "request", "user_id", place.alias("position"), "item", explored.alias("explored"), F.when(explored, 0.25).otherwise(0.75).alias("propensity"),
        (scores.md5_number(F.lit("reward"), F.col("event_id")) % 5 == 0).cast("double").alias("reward"),
    )


def targets(log: DataFrame) -> DataFrame:
    """A policy that shows a request's items by id."""
    distinct = log.select("request", "item").distinct()
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("item")) - 1)


_SLOTS = """
    slots AS (SELECT user_id || '-' || (s // 86400) AS request, user_id, item,
              row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY us, event_id) - 1 AS position,
              ('0x' || substr(md5('explore:' || event_id), 1, 8))::BIGINT % 3 = 0 AS explored,
              CASE WHEN ('0x' || substr(md5('explore:' || event_id), 1, 8))::BIGINT % 3 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS propensity,
              (('0x' || substr(md5('reward:' || event_id), 1, 8))::BIGINT % 5 = 0)::INTEGER::DOUBLE AS reward FROM views),
    target AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY item) - 1 AS rank FROM (SELECT DISTINCT request, item FROM slots)),
    m AS (SELECT s.*, t.rank = s.position AS hit FROM slots s LEFT JOIN target t USING (request, item)),
    sized AS (SELECT count(*)::DOUBLE AS slots FROM target)
"""


@query(f"""WITH {LOG}, {_SLOTS}, e AS (
        SELECT 'replay' AS estimator, explored AS scope, hit, CASE WHEN explored AND hit THEN 1 / propensity ELSE 0 END AS w, reward, true AS norm FROM m
        UNION ALL SELECT 'snips', true, hit, CASE WHEN hit THEN 1 / propensity ELSE 0 END, reward, true FROM m
        UNION ALL SELECT 'ips', true, hit, CASE WHEN hit THEN 1 / propensity ELSE 0 END, reward, false FROM m)
    SELECT estimator, round(sum(w * reward) / CASE WHEN bool_and(norm) THEN sum(w) ELSE any_value(slots) END, 5) AS value, count(*) FILTER (scope) AS n_slots,
           count(*) FILTER (scope AND hit) AS n_matched, round(sum(w) ** 2 / sum(w * w), 4) AS ess, round(sum(w) / any_value(slots), 5) AS coverage
    FROM e, sized GROUP BY estimator""")
def ope_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay over explored slots, self-normalised and plain inverse propensity over all slots."""
    log = slots(spark, sf_dir)
    target = targets(log)
    hit = F.col("target_rank") == F.col("position")
    weight = 1 / F.col("propensity")
    sizes = target.groupBy("request").agg(F.count("*").alias("n_slots"))
    found = policy.estimates(
        policy.matched(log, target), sizes, replay=(F.col("explored"), hit, weight, True),
        snips=(F.lit(True), hit, weight, True), ips=(F.lit(True), hit, weight, False),
    )
    return found.select("estimator", F.round("value", 5).alias("value"), "n_slots", "n_matched", F.round("ess", 4).alias("ess"), F.round("coverage", 5).alias("coverage"))


@query(f"""WITH {LOG}, {_SLOTS} SELECT position, count(*) AS slots, sum(reward)::BIGINT AS clicks, round(avg(reward), 6) AS ctr FROM slots WHERE explored GROUP BY position""")
def position_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = slots(spark, sf_dir).where("explored")
    return log.groupBy(F.col("position").cast("long").alias("position")).agg(F.count("*").alias("slots"), F.sum("reward").cast("long").alias("clicks"), F.round(F.avg("reward"), 6).alias("ctr"))


@query(f"""WITH {LOG}, {_SLOTS}, p AS (SELECT ln(position + 1.0) AS lr, sum(reward) AS k, count(*) AS n FROM slots WHERE explored GROUP BY position),
    g AS (SELECT i * 3.0 / 3000 AS eta FROM range(3001) r(i)), x AS (SELECT eta, sum(n * exp(-eta * lr)) AS exposure, sum(k) AS c, sum(k * lr) AS ranks FROM g, p GROUP BY eta),
    f AS (SELECT eta, round(c * ln(c / exposure) - eta * ranks - c, 9) AS fit FROM x)
    SELECT round(min(eta), 3) AS eta FROM f WHERE fit = (SELECT max(fit) FROM f)""")
def position_bias_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = slots(spark, sf_dir).where("explored").groupBy("position").agg(F.sum("reward").alias("clicks"), F.count("*").alias("slots"))
    return policy.position_bias_eta(by).select(F.round("eta", 3).alias("eta"))


@query(f"""WITH {LOG}, {_SLOTS}, s AS (SELECT position, count(*) FILTER (NOT explored) AS nd, sum(reward) FILTER (NOT explored) AS cd, count(*) FILTER (explored) AS ne, sum(reward) FILTER (explored) AS ce FROM slots GROUP BY position)
    SELECT round(sum((cd / nd - ce / ne) * ne) / sum(ne), 6) AS difference, count(*) AS strata, sum(ne)::BIGINT AS explored_slots FROM s WHERE nd > 0 AND ne > 0""")
def stratified_ctr_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of deterministic less explored slots, position by position, weighed by explored slots."""
    e = F.col("explored")
    strata = slots(spark, sf_dir).groupBy("position").agg(
        F.count_if(~e).alias("nd"), F.sum(F.when(~e, F.col("reward"))).alias("cd"), F.count_if(e).alias("ne"), F.sum(F.when(e, F.col("reward"))).alias("ce")
    )
    gap = (F.col("cd") / F.col("nd") - F.col("ce") / F.col("ne")) * F.col("ne")
    return strata.where("nd > 0 AND ne > 0").agg(F.round(F.sum(gap) / F.sum("ne"), 6).alias("difference"), F.count("*").alias("strata"), F.sum("ne").alias("explored_slots"))


@query(f"""WITH {LOG}, c AS (SELECT item, count(*) FILTER (event_type = 'click')::DOUBLE AS k, count(*)::DOUBLE AS n FROM log WHERE event_type IN ('click', 'view') GROUP BY item)
    SELECT item, round(greatest(0, (k / n + 1.9207294103 / n) / (1 + 3.8414588207 / n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588207 / (4 * n * n)) / (1 + 3.8414588207 / n)), 6) AS low,
           round(least(1, (k / n + 1.9207294103 / n) / (1 + 3.8414588207 / n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588207 / (4 * n * n)) / (1 + 3.8414588207 / n)), 6) AS high FROM c""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir, "click", "view")
    counts = log.groupBy("item").agg(F.count_if(F.col("event_type") == "click").alias("k"), F.count("*").alias("n"))
    low, high = scores.wilson(F.col("k"), F.col("n"))
    return counts.select("item", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {LOG}, {_SLOTS}, u AS (SELECT user_id, sum(reward) AS k, count(*) AS n FROM slots GROUP BY user_id),
    d AS (SELECT b, k, n, ('0x' || substr(md5('0:' || b || ':' || user_id), 1, 8))::BIGINT / 4294967296.0 AS x FROM u, range(1, 201) r(b)),
    w AS (SELECT b, k, n, (x >= 0.36787944)::INTEGER + (x >= 0.73575888)::INTEGER + (x >= 0.91969860)::INTEGER + (x >= 0.98101184)::INTEGER + (x >= 0.99634015)::INTEGER + (x >= 0.99940582)::INTEGER + (x >= 0.99991676)::INTEGER AS w FROM d),
    r AS (SELECT sum(w * k) / sum(w * n) AS r FROM w GROUP BY b)
    SELECT round((SELECT sum(k) / sum(n) FROM u), 6) AS value, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click rate of slots with a percentile interval, users being drawn anew."""
    users = slots(spark, sf_dir).groupBy("user_id").agg(F.sum("reward").alias("k"), F.count("*").cast("double").alias("n"))
    return inference.cluster_bootstrap(users, "user_id", "k", "n").select(*[F.round(c, 6).alias(c) for c in ("value", "low", "high")])
