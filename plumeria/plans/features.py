"""Popularity, vectors, as-of lookups, sessions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeria.functions import scores, vectors
from plumeria.operators import asof, sessions
from plumeria.plans.registry import LOG, query
from plumeria.sources.tables import clicks, event_log, items, requests, table, views

#: 2024-01-20 00:00:00, the instant of the snapshots; popularity is read two seconds earlier.
AS_OF, LAG = 1_705_708_800, 2
HOUR, DAY = 3600, 86400
END = AS_OF - LAG
SIZE = 64


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, clicks_6h, clicks_24h, clicks_48h, inviews_24h) in one scan of the log."""
    log = event_log(spark, sf_dir, "click", "view").where(F.col("s").between(END - 48 * HOUR, END - 1))
    click = F.col("event_type") == "click"
    since = lambda h: F.col("s") >= END - h * HOUR
    return log.groupBy("item").agg(
        *[F.count_if(click & since(h)).alias(f"clicks_{h}h") for h in (6, 24, 48)],
        F.count_if(~click & since(24)).alias("inviews_24h"),
    )


_POPULARITY = f"""
    pop AS (SELECT item, count(*) FILTER (event_type = 'click' AND s >= {END} - 21600) AS clicks_6h,
                   count(*) FILTER (event_type = 'click' AND s >= {END} - 86400) AS clicks_24h,
                   count(*) FILTER (event_type = 'click') AS clicks_48h,
                   count(*) FILTER (event_type = 'view' AND s >= {END} - 86400) AS inviews_24h
            FROM log WHERE event_type IN ('click', 'view') AND s >= {END} - 172800 AND s < {END} GROUP BY item)
"""


@query(f"""WITH {LOG}, {_POPULARITY}
    SELECT i.item, coalesce(clicks_6h, 0) AS clicks_6h, coalesce(clicks_24h, 0) AS clicks_24h,
           coalesce(clicks_48h, 0) AS clicks_48h, coalesce(inviews_24h, 0) AS inviews_24h,
           round(coalesce(clicks_24h, 0) / greatest(coalesce(inviews_24h, 0), 1), 6) AS pop_ctr_24h
    FROM items i LEFT JOIN pop USING (item) WHERE pub_s <= {AS_OF}
    ORDER BY coalesce(clicks_6h, 0) DESC, pub_s DESC, i.item DESC LIMIT 20""")
def pop_windows_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing click windows, click-through rate and the twenty most popular items."""
    catalogue = items(spark, sf_dir).where(F.col("pub_s") <= AS_OF).select("item", "pub_s")
    joined = catalogue.join(popularity(spark, sf_dir), "item", "left").na.fill(0)
    rate = F.round(scores.ctr(F.col("clicks_24h"), F.col("inviews_24h")), 6).alias("pop_ctr_24h")
    top = joined.orderBy(F.desc("clicks_6h"), F.desc("pub_s"), F.desc("item")).limit(20)
    return top.select("item", "clicks_6h", "clicks_24h", "clicks_48h", "inviews_24h", rate)


@query(f"""WITH {LOG}, v AS (SELECT item, emb, sqrt(list_sum(list_transform(emb, lambda x: x::DOUBLE * x))) AS n FROM items)
    SELECT item, round(n, 6) AS norm, round(CASE WHEN n > 0 THEN emb[1] / n ELSE 0 END, 6) AS first,
           round(CASE WHEN n > 0 THEN emb[64] / n ELSE 0 END, 6) AS last FROM v""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = items(spark, sf_dir).select("item", vectors.norm(F.col("emb")).alias("n"), vectors.unit(F.col("emb")).alias("u"))
    return one.select("item", F.round("n", 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[SIZE - 1], 6).alias("last"))


@query(f"""WITH {LOG}, q AS (SELECT emb FROM items WHERE item = 0)
    SELECT i.item, round(list_cosine_similarity(i.emb::DOUBLE[], q.emb::DOUBLE[]), 5) AS cosine FROM items i, q
    WHERE pub_s BETWEEN {AS_OF} - 1209600 AND {AS_OF} AND item <> 0
    ORDER BY list_cosine_similarity(i.emb::DOUBLE[], q.emb::DOUBLE[]) DESC, item LIMIT 20""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest items to one query vector among those of two weeks; exact."""
    all_ = items(spark, sf_dir)
    one = all_.where("item = 0").select(F.col("emb").alias("q"))  # one row
    near = all_.where(F.col("pub_s").between(AS_OF - 14 * DAY, AS_OF) & (F.col("item") != 0)).join(F.broadcast(one))
    scored = near.select("item", vectors.cosine(F.col("emb"), F.col("q")).alias("c"))
    return scored.orderBy(F.desc("c"), "item").limit(20).select("item", F.round("c", 5).alias("cosine"))


@query(f"""WITH {LOG}, e AS (SELECT category, unnest(emb) AS x, unnest(range(64)) AS dim FROM items)
    SELECT category, dim::INTEGER AS dim, count(*) AS n, round(avg(x::DOUBLE), 5) AS mean FROM e GROUP BY category, dim""")
def category_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = items(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), *vectors.element_sums(F.col("emb"), SIZE, F.lit(1.0)))
    long = sums.select("category", "n", F.posexplode(vectors.gathered(SIZE)).alias("dim", "total"))
    return long.select("category", "dim", "n", F.round(F.col("total") / F.col("n"), 5).alias("mean"))


_UNIT = "list_transform(emb, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(emb, lambda y: y::DOUBLE * y))))"


@query(f"""WITH {LOG}, w AS (SELECT c.user_id, pow(0.5, ({AS_OF} - s) / 604800.0) AS w, {_UNIT} AS u
               FROM clicks c JOIN items USING (item) WHERE s < {AS_OF}),
    p AS (SELECT user_id, dim, sum(w * x) AS x, count(*) AS n
          FROM (SELECT user_id, w, unnest(u) AS x, unnest(range(64)) AS dim FROM w) GROUP BY user_id, dim),
    q AS (SELECT unnest({_UNIT}) AS y, unnest(range(64)) AS dim FROM items WHERE item = 7)
    SELECT user_id, max(n) AS n, round(sum(x * y) / sqrt(sum(x * x)), 5) AS cosine FROM p JOIN q USING (dim) GROUP BY user_id""")
def decayed_profile_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's profile is the half-life weighted sum of clicked unit vectors; its cosine to one item."""
    unit = items(spark, sf_dir).select("item", vectors.unit(F.col("emb")).alias("u"))
    seen = clicks(spark, sf_dir, until=AS_OF).join(unit, "item")
    weight = scores.half_life(F.lit(AS_OF) - F.col("s"), 7 * DAY)
    sums = seen.groupBy("user_id").agg(F.count("*").alias("n"), *vectors.element_sums(F.col("u"), SIZE, weight))
    target = unit.where("item = 7").select(F.col("u").alias("q"))
    both = sums.select("user_id", "n", vectors.gathered(SIZE).alias("p")).join(F.broadcast(target))
    return both.select("user_id", "n", F.round(vectors.cosine(F.col("p"), F.col("q")), 5).alias("cosine"))


@query(f"""WITH {LOG}, pref AS (SELECT user_id, dim, sum(x) AS x FROM (
        SELECT user_id, unnest({_UNIT}) AS x, unnest(range(64)) AS dim FROM log JOIN items USING (item)
        WHERE event_type = 'signup' AND s < {AS_OF}) GROUP BY user_id, dim),
    hist AS (SELECT user_id, dim, sum(w * x) AS x FROM (
        SELECT user_id, exp(-0.05 * (({AS_OF} - s) // 86400)) AS w, unnest({_UNIT}) AS x, unnest(range(64)) AS dim
        FROM clicks JOIN items USING (item) WHERE s < {AS_OF}) GROUP BY user_id, dim),
    un AS (SELECT user_id, dim, 0.4 * x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM pref
           UNION ALL SELECT user_id, dim, 0.6 * x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) FROM hist),
    v AS (SELECT user_id, dim, sum(x) AS x FROM un GROUP BY user_id, dim)
    SELECT user_id, round(sqrt(sum(x * x)), 5) AS length, round(max(x) FILTER (dim = 0) / sqrt(sum(x * x)), 5) AS first
    FROM v GROUP BY user_id""")
def onboarding_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.4 of the preferred items' direction and 0.6 of the clicked ones', which fade by days."""
    unit = items(spark, sf_dir).select("item", vectors.unit(F.col("emb")).alias("u"))
    log = event_log(spark, sf_dir, "click", "signup", until=AS_OF).join(unit, "item")
    click = F.col("event_type") == "click"
    fade = F.exp(F.lit(-0.05) * F.floor((F.lit(AS_OF) - F.col("s")) / DAY))
    sums = log.withColumn("kind", click.cast("int")).groupBy("user_id", "kind").agg(
        *vectors.element_sums(F.col("u"), SIZE, F.when(click, fade).otherwise(1.0))
    )
    share = F.when(F.col("kind") == 1, 0.6).otherwise(0.4)
    parts = sums.select("user_id", share.alias("share"), vectors.unit(vectors.gathered(SIZE)).alias("u"))
    both = parts.groupBy("user_id").agg(*vectors.element_sums(F.col("u"), SIZE, F.col("share")))
    v = both.select("user_id", vectors.gathered(SIZE).alias("v"))
    length = vectors.norm(F.col("v"))
    return v.select("user_id", F.round(length, 5).alias("length"), F.round(F.col("v")[0] / length, 5).alias("first"))


@query(f"""WITH {LOG} SELECT r.req, count(c.event_id) AS n_24h, count(c.event_id) FILTER (c.s >= r.t - 21600) AS n_6h
    FROM requests r LEFT JOIN clicks c ON c.user_id = r.user_id AND c.s >= r.t - 86400 AND c.s < r.t GROUP BY r.req""")
def asof_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of the user in the day and in the six hours before each request."""
    asked = requests(spark, sf_dir).withColumn("low", F.col("t") - DAY)
    found = asof.window_join(asked, clicks(spark, sf_dir).select("user_id", "s"), "user_id", "low", "t", "s", DAY)
    counts = found.groupBy("req").agg(F.count("*").alias("n_24h"), F.count_if(F.col("s") >= F.col("t") - 6 * HOUR).alias("n_6h"))
    return asked.select("req").join(counts, "req", "left").na.fill(0)


@query(f"""WITH {LOG} SELECT r.req, coalesce(max(c.s), -1) AS last_s, round((any_value(r.t) - max(c.s)) / 3600.0, 6) AS hours
    FROM requests r LEFT JOIN clicks c ON c.user_id = r.user_id AND c.s < r.t GROUP BY r.req""")
def last_event_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = asof.merged(requests(spark, sf_dir), clicks(spark, sf_dir).select("user_id", "s"), "user_id", "t", "s")
    found = asof.last_before(both, ["user_id"], "at", [F.col("at"), F.col("kind")], 7 * DAY, F.col("event.s"))
    found = found.where("kind = 0")
    return found.select("request.req", F.coalesce("last", F.lit(-1)).alias("last_s"), F.round((F.col("at") - F.col("last")) / F.lit(3600.0), 6).alias("hours"))


@query(f"""WITH {LOG}, r AS (SELECT req, t, s, item, row_number() OVER (PARTITION BY req ORDER BY s DESC, item DESC, event_id DESC) AS place
        FROM requests JOIN clicks USING (user_id) WHERE s < t AND s >= t - 604800)
    SELECT req, place::INTEGER AS place, item, s FROM r WHERE place <= 5""")
def last_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five last clicks of the week before each request, by (second, item)."""
    asked = requests(spark, sf_dir).withColumn("low", F.col("t") - 7 * DAY)
    found = asof.window_join(asked, clicks(spark, sf_dir).select("user_id", "s", "item", "event_id"), "user_id", "low", "t", "s", DAY)
    return asof.last_n(found, ["req"], [F.desc("s"), F.desc("item"), F.desc("event_id")], 5).select("req", "place", "item", "s")


@query(f"""WITH {LOG} SELECT r.req, count(c.event_id) AS hist_len,
           round(coalesce(sum(pow(0.5, (r.t - c.s) / 604800.0)), 0), 5) AS weight
    FROM requests r LEFT JOIN clicks c ON c.user_id = r.user_id AND c.s < r.t GROUP BY r.req""")
def hist_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decayed weight of a user's whole past at each request in one pass.

    ``2^((s - t) / h)`` falls into a factor of the event and one of the request, so a running sum over the events
    serves all requests; both refer to the snapshot's instant to stay in range.
    """
    both = asof.merged(requests(spark, sf_dir), clicks(spark, sf_dir).select("user_id", "s"), "user_id", "t", "s")
    half = F.lit(7.0 * DAY)
    weight = F.when(F.col("kind") == 1, F.pow(F.lit(2.0), (F.col("at") - AS_OF) / half)).otherwise(0.0)
    summed = asof.prefix_sums(both, ["user_id"], "at", [F.col("at"), F.col("kind")], 7 * DAY, n=F.col("kind"), w=weight)
    return summed.where("kind = 0").select(
        "request.req", F.col("n").cast("long").alias("hist_len"), F.round(F.col("w") * F.pow(F.lit(2.0), (F.lit(AS_OF) - F.col("at")) / half), 5).alias("weight")
    )


@query(f"""WITH {LOG}, m AS (SELECT req, category, count(*) AS n FROM requests r JOIN clicks c USING (user_id) JOIN items USING (item)
        WHERE c.s < r.t AND c.s >= r.t - 604800 GROUP BY req, category)
    SELECT req, category, n, round(n / sum(n) OVER (PARTITION BY req), 6) AS share FROM m""")
def category_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).withColumn("low", F.col("t") - 7 * DAY)
    seen = clicks(spark, sf_dir).join(items(spark, sf_dir).select("item", "category"), "item").select("user_id", "s", "category")
    counts = asof.window_join(asked, seen, "user_id", "low", "t", "s", DAY).groupBy("req", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("req")), 6))


_SESSIONS = """
    g AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 1800 THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    sess AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id)::BIGINT AS session FROM g)
"""


@query(f"WITH {LOG}, {_SESSIONS} SELECT event_id, user_id, session, min(s) OVER (PARTITION BY user_id, session) AS session_start FROM sess")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(event_log(spark, sf_dir)).select("event_id", "user_id", F.col("session").cast("long").alias("session"), "session_start")


@query(f"""WITH {LOG}, {_SESSIONS}, l AS (SELECT r.req, max(e.s) AS last, arg_max(e.session, (e.s, e.event_id)) AS session, any_value(r.t) AS t
        FROM requests r LEFT JOIN sess e ON e.user_id = r.user_id AND e.s < r.t GROUP BY r.req)
    SELECT req, CASE WHEN t - last <= 1800 THEN session ELSE -1 END AS session FROM l""")
def request_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session of the last event before a request when it is within the gap, else -1."""
    events = sessions.sessionize(event_log(spark, sf_dir)).select("user_id", "s", "event_id", "session")
    both = asof.merged(requests(spark, sf_dir), events, "user_id", "t", "s")
    value = F.when(F.col("kind") == 1, F.struct("event.s", "event.event_id", "event.session"))
    found = asof.last_before(both, ["user_id"], "at", [F.col("at"), F.col("kind")], 7 * DAY, value).where("kind = 0")
    near = F.col("at") - F.col("last.s") <= sessions.GAP_S
    return found.select("request.req", F.when(near, F.col("last.session").cast("long")).otherwise(F.lit(-1)).cast("long").alias("session"))


@query(f"""WITH {LOG}, {_SESSIONS}, n AS (SELECT user_id, session, s, event_type, lead(event_type) OVER (PARTITION BY user_id, session ORDER BY s, event_id) AS next FROM sess)
    SELECT user_id, session, count(*) AS n, max(s) - min(s) AS seconds, count(*) FILTER (event_type = 'view' AND next = 'click') AS view_then_click
    FROM n GROUP BY user_id, session""")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sessions.sessionize(event_log(spark, sf_dir))
    after = F.lead("event_type").over(Window.partitionBy("user_id", "session").orderBy("s", "event_id"))
    return events.withColumn("next", after).groupBy("user_id", F.col("session").cast("long").alias("session")).agg(
        F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("seconds"),
        F.count_if((F.col("event_type") == "view") & (F.col("next") == "click")).alias("view_then_click"),
    )


@query(f"""WITH {LOG}, {_POPULARITY}, h AS (SELECT item, greatest(0, ({AS_OF} - pub_s) / 3600.0) AS hours, category FROM items WHERE pub_s <= {AS_OF})
    SELECT h.item, round(hours, 4) AS hours_since_pub, (hours <= 24)::INTEGER AS is_fresh_24h, (hours <= 168)::INTEGER AS is_fresh_7d,
           round(exp(-hours / 48) + ln(1 + coalesce(clicks_24h, 0)) / 5, 5) AS recency_popularity,
           round(0.5 * exp(-hours / 48) + 0.2 * ln(1 + coalesce(clicks_6h, 0)), 5) AS cold_score,
           row_number() OVER (ORDER BY round(0.5 * exp(-hours / 48) + 0.2 * ln(1 + coalesce(clicks_6h, 0)), 9) DESC, hours, h.item DESC) AS cold_rank
    FROM h LEFT JOIN pop USING (item)""")
def cold_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness flags, the popularity score, and the order for users without signals (age, then id break ties)."""
    live = items(spark, sf_dir).where(F.col("pub_s") <= AS_OF).select("item", scores.hours_since(F.lit(AS_OF), F.col("pub_s")).alias("hours"))
    joined = live.join(popularity(spark, sf_dir), "item", "left").na.fill(0)
    cold = scores.heuristic_v2((0.0, 0.0, 0.5, 0.2), F.lit(0.0), F.lit(0.0), F.col("hours"), F.col("clicks_6h"))
    order = Window.orderBy(F.round("cold", 9).desc(), "hours", F.desc("item"))  # one row an item that is live
    return joined.withColumn("cold", cold).select(
        "item", F.round("hours", 4).alias("hours_since_pub"), (F.col("hours") <= 24).cast("int").alias("is_fresh_24h"),
        (F.col("hours") <= 168).cast("int").alias("is_fresh_7d"),
        F.round(scores.recency_popularity(F.col("hours"), F.col("clicks_24h")), 5).alias("recency_popularity"),
        F.round("cold", 5).alias("cold_score"), F.row_number().over(order).cast("long").alias("cold_rank"),
    )


@query(f"""WITH {LOG}, c AS (SELECT item, count(*) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type = 'view') AS n
        FROM log WHERE s < {AS_OF} AND event_type IN ('click', 'view') GROUP BY item), p AS (SELECT sum(k) / sum(n) AS p0 FROM c)
    SELECT item, k AS clicks, n AS inviews, round((k + 20 * p0) / (n + 20), 6) AS shrunk_ctr FROM c, p""")
def shrunk_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click-through rates drawn to the rate of all items."""
    log = event_log(spark, sf_dir, "click", "view", until=AS_OF)
    click = F.col("event_type") == "click"
    counts = log.groupBy("item").agg(F.count_if(click).alias("clicks"), F.count_if(~click).alias("inviews"))
    prior = counts.agg((F.sum("clicks") / F.sum("inviews")).alias("p0"))  # one row
    return counts.join(F.broadcast(prior)).select(
        "item", "clicks", "inviews", F.round(scores.shrunk_ctr(F.col("clicks"), F.col("inviews"), F.col("p0"), 20), 6).alias("shrunk_ctr")
    )
