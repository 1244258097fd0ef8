"""Judges of texts, held against the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.functions.scores import md5_number
from plumeria.operators import inference, judging
from plumeria.plans.registry import query
from plumeria.sources.tables import table

#: The judges, and the families that they and the texts' generators belong to.
JUDGES, FAMILIES = ("north", "south", "west"), ("f0", "f1", "f2")


def _hash(name: str) -> str:
    return f"('0x' || substr(md5('{name}:' || doc_id), 1, 8))::BIGINT"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges' grades of every labelled document; a better text has the better chance, and one call in 40 fails."""
    each = labelled(spark, sf_dir).select("*", F.posexplode(F.array(*map(F.lit, JUDGES))).alias("k", "judge"))
    draw = lambda name: md5_number(F.concat(F.lit(name), F.col("k").cast("string")), F.col("doc_id"))
    score = F.least(F.lit(5), 1 + draw("grade") % 4 + F.col("quality") * (draw("luck") % (2 + F.col("k"))))
    score = F.when(draw("fail") % 40 > 0, score)
    return each.select(
        "judge", F.concat(F.lit("f"), F.col("k").cast("string")).alias("family"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("made_by"),
        F.expr("doc_id div 4").alias("cluster"), score.alias("score"), (draw("claims") % 5).alias("claims"), (score + (draw("mean") % 4) / 4.0).alias("mean_score"),
        (F.col("quality") == 1).alias("publishable"), F.expr("1 + least(4, n_chars div 400)").alias("style"), (F.col("n_chars") * (1 + F.col("k"))).cast("double").alias("cost"),
    )


_DRAW = "('0x' || substr(md5('{}' || k || ':' || doc_id), 1, 8))::BIGINT"
_KAPPA = "round(CASE WHEN n > 0 AND (p * y + (n - p) * (n - y)) / (n * n) < 1 THEN ((n - p - y + 2 * tp) / n - (p * y + (n - p) * (n - y)) / (n * n)) / (1 - (p * y + (n - p) * (n - y)) / (n * n)) END, 9)"
_JUDGE = f"""
    b AS (SELECT doc_id, n_chars, quality, k, CASE WHEN {_DRAW.format('fail')} % 40 > 0 THEN least(5, 1 + {_DRAW.format('grade')} % 4 + quality * ({_DRAW.format('luck')} % (2 + k))) END AS score
          FROM documents JOIN labels USING (doc_id), (SELECT unnest([0, 1, 2]) AS k) WHERE quality IS NOT NULL),
    r AS (SELECT k, doc_id % 3 = k AS same, ('0x' || substr(md5('0:' || doc_id // 4), 1, 8))::BIGINT % 2 AS fold, score, {_DRAW.format('claims')} % 5 AS claims, score + {_DRAW.format('mean')} % 4 / 4.0 AS mean_score,
                 quality = 1 AS human, 1 + least(4, n_chars // 400) AS style, n_chars * (1 + k) AS cost FROM b),
    o AS (SELECT * FROM r WHERE NOT same),
    g AS (SELECT s AS least_score, c AS most_claims, (5 - s) * 4 + c AS place FROM (SELECT unnest([5, 4, 3, 2, 1]) AS s), (SELECT unnest([0, 1, 2, 3]) AS c)),
    e AS (SELECT k, fold, place, least_score, most_claims, count(*) AS n, count(*) FILTER (coalesce(score, 0) >= least_score AND claims <= most_claims) AS p, count(*) FILTER (coalesce(score, 0) >= least_score AND claims <= most_claims AND human) AS tp,
                 count(*) FILTER (human) AS y FROM o, g GROUP BY ALL),
    w AS (SELECT k, place, least_score, most_claims, sum(n) AS n, sum(p) AS p, sum(tp) AS tp, sum(y) AS y FROM e GROUP BY ALL),
    t AS (SELECT e.k, e.fold, e.place, w.n - e.n AS n, w.p - e.p AS p, w.tp - e.tp AS tp, w.y - e.y AS y FROM e JOIN w USING (k, place)),
    best AS (SELECT k, fold, place FROM (SELECT *, row_number() OVER (PARTITION BY k, fold ORDER BY coalesce({_KAPPA}, -2) DESC, place) AS i FROM t) WHERE i = 1),
    full_fit AS (SELECT k, least_score, most_claims FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce({_KAPPA}, -2) DESC, place) AS i FROM w) WHERE i = 1),
    out AS (SELECT k, sum(n) AS n, sum(p) AS p, sum(tp) AS tp, sum(y) AS y FROM e JOIN best USING (k, fold, place) GROUP BY k),
    x AS (SELECT k, mean_score, style, row_number() OVER (PARTITION BY k ORDER BY mean_score) AS i, row_number() OVER (PARTITION BY k ORDER BY style) AS j FROM o WHERE mean_score IS NOT NULL),
    rho AS (SELECT k, corr(ri, rj) AS spearman FROM (SELECT k, avg(i) OVER (PARTITION BY k, mean_score) AS ri, avg(j) OVER (PARTITION BY k, style) AS rj FROM x) GROUP BY k),
    m AS (SELECT ['north', 'south', 'west'][k + 1] AS judge, 'f' || k AS family, count(*) FILTER (NOT same) AS n, count(*) FILTER (same) AS n_same_family, count(*) FILTER (NOT same AND score IS NULL) AS failures,
                 sum(cost) FILTER (NOT same)::DOUBLE AS cost, k FROM r GROUP BY k),
    metrics AS (SELECT m.judge, m.family, m.n, m.n_same_family, (SELECT {_KAPPA} FROM out WHERE out.k = m.k) AS oof_kappa, f.least_score, f.most_claims, rho.spearman, m.failures, m.cost FROM m JOIN full_fit f USING (k) JOIN rho USING (k))
"""


@query(f"WITH {_JUDGE} SELECT judge, family, n, n_same_family, round(oof_kappa, 6) AS oof_kappa, least_score, most_claims, round(spearman, 6) AS spearman, failures, cost FROM metrics")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each judge agrees with the labels on texts of other families, by rules chosen on other clusters."""
    found = judging.judge_metrics(judged(spark, sf_dir))
    return found.withColumns({"oof_kappa": F.round("oof_kappa", 6), "spearman": F.round("spearman", 6)})


@query(f"""WITH {_JUDGE}, c AS (SELECT w.family, m.judge, m.oof_kappa, m.least_score, m.most_claims, row_number() OVER (PARTITION BY w.family ORDER BY m.oof_kappa DESC, m.cost, m.judge) AS i
        FROM (SELECT unnest(['f0', 'f1', 'f2']) AS family) w JOIN metrics m ON m.family <> w.family AND m.oof_kappa IS NOT NULL)
    SELECT family, judge, round(oof_kappa, 6) AS oof_kappa, CASE WHEN oof_kappa >= 0.1 THEN 'enforce' ELSE 'shadow' END AS mode, CASE WHEN oof_kappa >= 0.1 THEN least_score END AS least_score, CASE WHEN oof_kappa >= 0.1 THEN most_claims END AS most_claims FROM c WHERE i = 1""")
def judge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge that the texts of each family get, and whether its rule is enforced."""
    found = judging.judge_choice(judging.judge_metrics(judged(spark, sf_dir)), list(FAMILIES), 0.1)
    return found.withColumn("oof_kappa", F.round("oof_kappa", 6))


@query(f"""WITH g AS (SELECT ('0x' || substr(md5('0:' || doc_id // 4), 1, 8))::BIGINT % 2 AS fold, n_chars > 600 AS passed, {_hash('sure')} % 1000003 / 1000003.0::DOUBLE AS c, quality = 1 AS truth, {_hash('parsed')} % 20 > 0 AS parsed
        FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    s AS (SELECT *, CASE WHEN passed THEN c ELSE 1 - c END AS score FROM g WHERE parsed),
    u AS (SELECT set, score, truth FROM s, (SELECT unnest([-1, 0, 1]) AS set) WHERE set <> fold),
    a AS (SELECT set, score, sum(count(*) FILTER (truth)) OVER w AS ge_pos, sum(count(*) FILTER (NOT truth)) OVER w AS ge_neg, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM u GROUP BY set, score WINDOW w AS (PARTITION BY set ORDER BY score DESC)),
    n AS (SELECT set, sum(pos) AS P, sum(neg) AS N FROM a GROUP BY set),
    b AS (SELECT set, score AS t FROM (SELECT set, score, row_number() OVER (PARTITION BY set ORDER BY round((ge_pos / P + (N - ge_neg) / N) / 2, 9) DESC, score) AS i FROM a JOIN n USING (set)) WHERE i = 1),
    auc AS (SELECT sum(a.pos * (n.N - ge_neg + a.neg / 2)) / any_value(n.P) / any_value(n.N) AS auc FROM a JOIN n USING (set) WHERE set = -1),
    k AS (SELECT count(*) AS n, (count(*) FILTER (truth AND passed) / count(*) FILTER (truth) + count(*) FILTER (NOT truth AND NOT passed) / count(*) FILTER (NOT truth)) / 2 AS baseline,
                 (count(*) FILTER (truth AND score >= t) / count(*) FILTER (truth) + count(*) FILTER (NOT truth AND score < t) / count(*) FILTER (NOT truth)) / 2 AS oof FROM s JOIN b ON b.set = s.fold)
    SELECT n, (SELECT count(*) FROM g WHERE NOT parsed) AS n_unparsed, round(auc, 6) AS auc, round(baseline, 6) AS baseline, round(oof, 6) AS oof, round(oof - baseline, 6) AS gain, (SELECT round(t, 6) FROM b WHERE set = -1) AS threshold,
           auc >= 0.7 AND oof - baseline >= 0.02 AS recommended FROM k, auc""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a threshold on a judge's confidence tells good documents better than its verdict."""
    draw = lambda name: md5_number(F.lit(name), F.col("doc_id"))
    rows = labelled(spark, sf_dir).select(
        F.expr("doc_id div 4").alias("cluster"), (F.col("n_chars") > 600).alias("passed"), (draw("sure") % 1000003 / F.lit(1000003.0)).alias("confidence"),
        (F.col("quality") == 1).alias("truth"), (draw("parsed") % 20 > 0).alias("parsed"),
    )
    found = judging.confidence_gate(rows, 0.7, 0.02)
    return found.withColumns({c: F.round(c, 6) for c in ("auc", "baseline", "oof", "gain", "threshold")})


_U = "('0x' || substr(md5('0:' || b || ':' || item), 1, 8))::BIGINT / 4294967296.0"
_BAKED = f"""
    d AS (SELECT doc_id AS item, n_chars, quality, k FROM documents JOIN labels USING (doc_id), (SELECT unnest([0, 1, 2, 3]) AS k) WHERE quality IS NOT NULL),
    r AS (SELECT k, item, {_DRAW.format('made').replace('doc_id', 'item')} % 50 > 0 AS drafted, CASE WHEN {_DRAW.format('read').replace('doc_id', 'item')} % 9 > 0 THEN {_DRAW.format('good').replace('doc_id', 'item')} % 100 < 60 + 20 * quality - [0, 1, 9, 0][k + 1] END AS publishable,
                 {_DRAW.format('number').replace('doc_id', 'item')} % 100 < [3, 3, 3, 30][k + 1] AS unsupported, {_DRAW.format('drift').replace('doc_id', 'item')} % 100 < 5 + k AS drift, {_DRAW.format('block').replace('doc_id', 'item')} % 100 < 10 AS blocked,
                 {_DRAW.format('first').replace('doc_id', 'item')} % 100 < 96 AS first_try, 1 + n_chars / 1000.0 * (1 + k) AS latency, n_chars * (4 - k) / 1000000.0 AS g, n_chars / 2000000.0 AS t FROM d),
    m AS (SELECT k, count(*) AS n, count(*) FILTER (NOT drafted) AS n_failed, count(publishable) AS n_labelled, avg(publishable::INTEGER) AS publishable_rate, avg(unsupported::INTEGER) FILTER (drafted) AS unsupported_rate,
                 avg(drift::INTEGER) FILTER (drafted) AS drift_rate, avg(blocked::INTEGER) FILTER (drafted) AS block_rate, sum(first_try::INTEGER) / (2.0 * count(*)) AS first_try_rate, quantile_cont(latency::DOUBLE, 0.95) AS p95_latency,
                 avg(g) AS g, avg(t) FILTER (drafted) AS t FROM r GROUP BY k),
    c AS (SELECT *, 100 * (g * (1 + block_rate + block_rate ** 2) + t * (1 + drift_rate)) AS cost_per_100, unsupported_rate <= 0.1 AND drift_rate <= 0.2 AND first_try_rate >= 0.4 AND p95_latency <= 100 AS passes FROM m),
    top AS (SELECT k AS top FROM c WHERE passes ORDER BY publishable_rate DESC, cost_per_100, k LIMIT 1),
    p AS (SELECT r.k, r.item, x.publishable::INTEGER - r.publishable::INTEGER AS d FROM r JOIN c USING (k), top, r x WHERE x.k = top AND x.item = r.item AND r.k <> top AND c.passes AND r.publishable IS NOT NULL AND x.publishable IS NOT NULL),
    w AS (SELECT k, b, d, {" + ".join(f"({_U} >= {p})::INTEGER" for p in inference.POISSON)} AS w FROM p, (SELECT unnest(range(1, 101)) AS b)),
    v AS (SELECT k, b, sum(w * d) / sum(w) AS d FROM w GROUP BY k, b HAVING sum(w) > 0),
    q AS (SELECT k, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM v GROUP BY k),
    s AS (SELECT k, count(*) AS n_pairs, avg(d) AS diff FROM p GROUP BY k),
    f AS (SELECT c.*, n_pairs, diff, low, high, passes AND (k = top OR low IS NULL OR low <= 0 AND high >= 0) AS tied FROM c LEFT JOIN s USING (k) LEFT JOIN q USING (k), top)
"""


@query(f"""WITH {_BAKED} SELECT 'c' || k AS candidate, n, n_failed, n_labelled, round(publishable_rate, 6) AS publishable_rate, round(unsupported_rate, 6) AS unsupported_rate, round(drift_rate, 6) AS drift_rate, round(block_rate, 6) AS block_rate,
    round(first_try_rate, 6) AS first_try_rate, round(p95_latency, 6) AS p95_latency, round(cost_per_100, 6) AS cost_per_100, passes, n_pairs, round(diff, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, tied,
    k = (SELECT k FROM f WHERE tied ORDER BY cost_per_100, k LIMIT 1) AS winner FROM f""")
def bake_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidates on every labelled document: gates, expected costs, paired differences and the one to adopt."""
    each = labelled(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    draw = lambda name: md5_number(F.concat(F.lit(name), F.col("k").cast("string")), F.col("doc_id"))
    by = lambda *x: F.element_at(F.array(*map(F.lit, x)), F.col("k") + 1)
    rows = each.select(
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("candidate"), F.col("doc_id").alias("item"), (draw("made") % 50 > 0).alias("drafted"),
        F.when(draw("read") % 9 > 0, draw("good") % 100 < 60 + 20 * F.col("quality") - by(0, 1, 9, 0)).alias("publishable"),
        (draw("number") % 100 < by(3, 3, 3, 30)).alias("unsupported"), (draw("drift") % 100 < 5 + F.col("k")).alias("drift"), (draw("block") % 100 < 10).alias("blocked"),
        F.lit(2).alias("responded"), (draw("first") % 100 < 96).cast("int").alias("first_try"), (1 + F.col("n_chars") / 1000.0 * (1 + F.col("k"))).alias("latency"),
        (F.col("n_chars") * (4 - F.col("k")) / 1000000.0).alias("generation_cost"), (F.col("n_chars") / 2000000.0).alias("tone_cost"),
    )
    found = judging.bake_off(rows, 0.1, 0.2, 0.4, 100.0, replicates=100)
    measures = ("publishable_rate", "unsupported_rate", "drift_rate", "block_rate", "first_try_rate", "p95_latency", "cost_per_100", "diff", "low", "high")
    return found.withColumns({c: F.round(c, 6) for c in measures})
