"""The request feature matrix and what is fitted on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeria.functions import vectors
from plumeria.operators import asof, boosting, density
from plumeria.operators import feature_matrix as matrix
from plumeria.operators import pairwise, profile_state, roots, rounds, search, spans
from plumeria.plans.features import _POPULARITY, _UNIT, AS_OF, popularity
from plumeria.plans.registry import LOG, query
from plumeria.sources.tables import clicks, event_log, items, table, views

#: Candidates of a request: the bought item and those at these distances from it.
STEPS = (0, 1, 7, 19, 40)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req, user_id, t, items): the requests, each with five candidates of the catalogue."""
    bought = event_log(spark, sf_dir, "purchase").select(F.col("event_id").alias("req"), "user_id", (F.col("s") + 1).alias("t"), "item")
    n = items(spark, sf_dir).agg(F.count("*").alias("n"))  # one row
    places = F.array(*[(F.col("item") + k) % F.col("n") for k in STEPS])
    return bought.join(F.broadcast(n)).select("req", "user_id", "t", F.when(F.col("n") > 0, places).alias("items"))


def static_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, category): those of the items with which a user signed up."""
    signed = event_log(spark, sf_dir, "signup").select("user_id", "item")
    return signed.join(items(spark, sf_dir).select("item", "category"), "item").select("user_id", "category").distinct()


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, user_age, user_gender): unknown for every fifth user."""
    users = event_log(spark, sf_dir).select("user_id").where("user_id IS NOT NULL").distinct()
    known = F.col("user_id") % 5 != 0
    return users.select("user_id", F.when(known, 20 + F.col("user_id") % 50).alias("user_age"), F.when(known, F.col("user_id") % 2).alias("user_gender"))


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = clicks(spark, sf_dir).select("user_id", "item", "s"), views(spark, sf_dir).select("item", "s")
    return matrix.feature_matrix(asked(spark, sf_dir), *log, items(spark, sf_dir), static_categories(spark, sf_dir), people(spark, sf_dir), dtype="double")


_ASKED = f"""
    n AS (SELECT count(*) AS n FROM items),
    pairs AS (SELECT req, user_id, t, item FROM (SELECT event_id AS req, user_id, s + 1 AS t, unnest([{", ".join(f"(item + {k}) % n" for k in STEPS)}]) AS item
              FROM log, n WHERE event_type = 'purchase') GROUP BY ALL),
    asks AS (SELECT DISTINCT req, user_id, t FROM pairs),
    seen AS (SELECT user_id, event_id, s, category, {_UNIT} AS u FROM clicks JOIN items USING (item)),
    marked AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 1800 THEN NULL ELSE s END AS begin FROM seen),
    placed AS (SELECT *, max(begin) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM marked),
    past AS (SELECT a.req, a.t, p.s, p.category, p.u, p.session FROM asks a JOIN placed p ON p.user_id = a.user_id AND p.s < a.t),
    last AS (SELECT req, max(s) AS last, max(session) AS session, count(*) AS hist_len, count(*) FILTER (s >= t - 86400) AS short_len FROM past GROUP BY req),
    live AS (SELECT req, count(*) AS sess_len FROM past JOIN last USING (req) WHERE t - last <= 1800 AND past.session = last.session GROUP BY req),
    dims AS (SELECT req, unnest(u) AS x, unnest(range(64)) AS dim, pow(0.5, (t - s) / 604800.0) AS w, s >= t - 86400 AS short, t - last <= 1800 AND past.session = last.session AS sess
             FROM past JOIN last USING (req)),
    v AS (SELECT req, dim, sum(w * x) AS h, coalesce(sum(x) FILTER (short), 0) AS sh, coalesce(sum(x) FILTER (sess), 0) AS se FROM dims GROUP BY req, dim),
    unit AS (SELECT item, unnest({_UNIT}) AS y, unnest(range(64)) AS dim FROM items),
    cosines AS (SELECT req, item, sum(h * y) / sqrt(sum(h * h)) AS hist_cos, CASE WHEN sum(sh * sh) > 0 THEN sum(sh * y) / sqrt(sum(sh * sh)) ELSE 0 END AS short_cos,
                       CASE WHEN sum(se * se) > 0 THEN sum(se * y) / sqrt(sum(se * se)) ELSE 0 END AS sess_cos
                FROM pairs JOIN v USING (req) JOIN unit USING (item, dim) GROUP BY req, item),
    shares AS (SELECT req, category, count(*) / sum(count(*)) OVER (PARTITION BY req) AS share FROM past GROUP BY req, category),
    static AS (SELECT DISTINCT user_id, category FROM log JOIN items USING (item) WHERE event_type = 'signup'),
    ncat AS (SELECT user_id, count(*) AS ncat FROM static GROUP BY user_id),
    pops AS (SELECT req, p.item, count(*) FILTER (event_type = 'click' AND s >= t - 21600) AS c6, count(*) FILTER (event_type = 'click' AND s >= t - 86400) AS c24,
                    count(*) FILTER (event_type = 'click') AS c48, count(*) FILTER (event_type = 'view' AND s >= t - 86400) AS v24
             FROM pairs p JOIN log l ON l.item = p.item AND s < t AND s >= t - 172800 AND event_type IN ('click', 'view') GROUP BY req, p.item),
    f AS (SELECT p.req, p.item, greatest(0, (p.t - pub_s) / 3600.0) AS hours, i.category, p.user_id, p.t FROM pairs p JOIN items i USING (item))
"""


@query(f"""WITH {LOG}, {_ASKED}
    SELECT f.req, f.item, round(hours, 4) AS hours_since_pub, (hours <= 24)::INTEGER AS is_fresh_24h, (hours <= 168)::INTEGER AS is_fresh_7d,
           round(coalesce(hist_cos, 0), 5) + 0.0 AS hist_cos, (static.user_id IS NOT NULL)::INTEGER AS cat_match_count, (static.user_id IS NOT NULL)::INTEGER AS is_cat_match,
           f.category::INTEGER AS news_category, CASE WHEN f.user_id % 5 <> 0 THEN 20 + f.user_id % 50 END::INTEGER AS user_age,
           CASE WHEN f.user_id % 5 <> 0 THEN f.user_id % 2 END::INTEGER AS user_gender, coalesce(ncat, 0)::INTEGER AS user_ncat,
           coalesce(c6, 0)::INTEGER AS pop_clicks_6h, coalesce(c24, 0)::INTEGER AS pop_clicks_24h, coalesce(c48, 0)::INTEGER AS pop_clicks_48h,
           coalesce(v24, 0)::INTEGER AS pop_inviews_24h, round(coalesce(c24, 0) / greatest(coalesce(v24, 0), 1), 5) AS pop_ctr_24h,
           round(coalesce(short_cos, 0), 5) + 0.0 AS short_cos, coalesce(short_len, 0)::INTEGER AS short_len, round(coalesce(sess_cos, 0), 5) + 0.0 AS sess_cos,
           coalesce(sess_len, 0)::INTEGER AS sess_len, round((f.t - last) / 3600.0, 4) AS hours_since_last_event,
           round(coalesce(share, 0), 5) AS cat_share, coalesce(hist_len, 0)::INTEGER AS hist_len
    FROM f LEFT JOIN cosines USING (req, item) LEFT JOIN static ON static.user_id = f.user_id AND static.category = f.category
    LEFT JOIN ncat ON ncat.user_id = f.user_id LEFT JOIN pops ON pops.req = f.req AND pops.item = f.item LEFT JOIN last ON last.req = f.req
    LEFT JOIN live ON live.req = f.req LEFT JOIN shares ON shares.req = f.req AND shares.category = f.category""")
def request_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 22 columns of every request and candidate, rounded for comparison."""
    places = {"hours_since_pub": 4, "hours_since_last_event": 4} | dict.fromkeys(("hist_cos", "pop_ctr_24h", "short_cos", "sess_cos", "cat_share"), 5)
    shown = [F.round(c, places[c]).alias(c) if c in places else F.col(c).cast("int").alias(c) for c in matrix.COLUMNS]
    return matrix_rows(spark, sf_dir).select("req", "item", *shown)


#: The four terms of the heuristic score.
TERMS = ("hist_cos", "short_cos", "recency", "popularity")


def design_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req, x, label): the four terms of each candidate, and whether it is the one that was bought."""
    bought = event_log(spark, sf_dir, "purchase").select(F.col("event_id").alias("req"), F.col("item").alias("bought"))
    terms = F.array("hist_cos", "short_cos", F.exp(-F.col("hours_since_pub") / 48.0), F.log1p("pop_clicks_6h"))
    return matrix_rows(spark, sf_dir).join(bought, "req").select("req", terms.alias("x"), (F.col("item") == F.col("bought")).cast("int").alias("label"))


@query()
def pairwise_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, weight, share, groups, pairs, converged): the heuristic's weights fitted to what was bought, pair by pair."""
    fit = pairwise.fit(design_rows(spark, sf_dir), "req", "x", "label")
    weights = fit.weights or [None] * len(TERMS)
    total = sum(abs(w) for w in fit.weights) or None
    rows = [(t, w, w / total if total else None, fit.groups, fit.pairs, fit.converged) for t, w in zip(TERMS, weights, strict=True)]
    return spark.createDataFrame(rows, "term string, weight double, share double, groups long, pairs long, converged boolean")  # one row a term


@query()
def boosted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req, item, bought, score, place): candidates of the later fifth of requests by trees fitted to the earlier ones."""
    bought = event_log(spark, sf_dir, "purchase").select(F.col("event_id").alias("req"), F.col("item").alias("own"), (F.col("s") + 1).alias("t"))
    x = F.array(*[F.col(c).cast("double") for c in matrix.COLUMNS]).alias("x")
    rows = rounds.cut(matrix_rows(spark, sf_dir).join(bought, "req").select("req", "item", "t", x, (F.col("item") == F.col("own")).cast("int").alias("bought")))
    parted = rows.join(F.broadcast(rows.agg(F.percentile_approx("t", 0.8).alias("until"))))  # one row
    ranker = boosting.fit(parted.where("t <= until"), "req", "item", "x", "bought", trees=10)
    scored = parted.where("t > until").select("req", "item", "bought", ranker.score(F.col("x")).alias("score"))
    place = F.row_number().over(Window.partitionBy("req").orderBy(F.desc("score"), "item"))  # five candidates a request
    return scored.withColumn("place", place.cast("long"))


@query()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, item, cluster, size): the clusters of the items that came out within one month, by density of their vectors."""
    month = F.expr("pub_s div 2592000").alias("batch")
    found = density.clusters(items(spark, sf_dir).select(month, F.col("item").alias("id"), F.col("emb").alias("vec")))
    sizes = found.where("cluster IS NOT NULL").groupBy("batch", "cluster").agg(F.count("*").alias("size"))
    return found.join(sizes, ["batch", "cluster"], "left").select("batch", F.col("id").alias("item"), "cluster", "size")


@query(f"""WITH {LOG}, e AS (SELECT user_id, s, category, {_UNIT} AS u, max(s) OVER (PARTITION BY user_id) AS anchor FROM clicks JOIN items USING (item)),
    d AS (SELECT user_id, dim, sum(w * x) AS x FROM (SELECT user_id, pow(0.5, (anchor - s) / 604800.0) AS w, unnest(u) AS x, unnest(range(64)) AS dim FROM e) GROUP BY user_id, dim),
    n AS (SELECT user_id, round(sqrt(sum(x * x)), 5) AS length, round(max(x) FILTER (dim = 0), 5) + 0.0 AS first FROM d GROUP BY user_id),
    c AS (SELECT user_id, category, count(*) AS k FROM e GROUP BY user_id, category)
    SELECT user_id, any_value(anchor) AS anchor_s, count(*) AS hist_len, any_value(length) AS length, any_value(first) AS first,
           (SELECT max(k) FROM c WHERE c.user_id = e.user_id) AS top_count, count(DISTINCT category) AS categories
    FROM e JOIN n USING (user_id) GROUP BY user_id""")
def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable profile of every user: anchor, events, length and first element of the sum, and its categories."""
    unit = items(spark, sf_dir).select("item", "category", vectors.unit(F.col("emb")).alias("vec"))
    found = profile_state.profile_states(clicks(spark, sf_dir).join(unit, "item"))
    return found.select(
        "user_id", "anchor_s", "hist_len", F.round(vectors.norm(F.col("hist_sum")), 5).alias("length"), F.round(F.col("hist_sum")[0], 5).alias("first"),
        F.array_max(F.map_values("counts")).alias("top_count"), F.size("counts").cast("long").alias("categories"),
    )


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, length(coalesce(text, '')) AS size FROM documents),
    lines AS (SELECT doc_id, i, size, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS b, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM l),
    windows AS (SELECT doc_id, k, k * 400 AS b, least(k * 400 + 500, length(text)) AS e FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range((length(coalesce(text, '')) + 399) // 400)) AS k FROM documents))
    SELECT w.doc_id, w.k AS "window", count(*) AS lines, count(*) FILTER (w.b <= l.b AND l.e <= w.e) AS whole_lines, sum(least(w.e, l.e) - greatest(w.b, l.b))::BIGINT AS covered
    FROM windows w JOIN lines l ON l.doc_id = w.doc_id AND l.b < w.e AND w.b < l.e AND l.b < l.e GROUP BY ALL""")
def window_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window of 500 characters, every 400: the lines that it meets, those it holds whole, and the characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length("text")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a document's own lines
    lines = rows.withColumn("end", F.sum(F.char_length("line") + 1).over(w) - 1).select("doc_id", F.struct("i", (F.col("end") - F.char_length("line")).alias("b"), F.col("end").alias("e")).alias("id"))
    lines = lines.select("doc_id", "id", F.col("id.b").alias("begin"), F.col("id.e").alias("end"))
    cuts = docs.where(size > 0).select("doc_id", size.alias("size"), F.explode(F.sequence(F.lit(0), F.expr("(char_length(text) + 399) div 400 - 1"))).alias("k"))
    windows = cuts.select("doc_id", F.struct("k", (F.col("k") * 400).alias("b"), F.least(F.col("k") * 400 + 500, "size").alias("e")).alias("id"))
    windows = windows.select("doc_id", "id", F.col("id.b").cast("long").alias("begin"), F.col("id.e").cast("long").alias("end"))
    found = spans.overlaps(windows, lines, "doc_id")
    whole = (F.col("left_id.b") <= F.col("right_id.b")) & (F.col("right_id.e") <= F.col("left_id.e"))
    return found.groupBy("doc_id", F.col("left_id.k").cast("long").alias("window")).agg(F.count("*").alias("lines"), F.count_if(whole).alias("whole_lines"), F.sum(F.col("end") - F.col("begin")).alias("covered"))


@query(f"""WITH RECURSIVE {LOG}, z AS (SELECT ln(1 + value) - 2 AS z FROM log WHERE value IS NOT NULL),
    b AS (SELECT 0 AS i, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi
          UNION ALL SELECT i + 1, CASE WHEN r < 0.1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN r < 0.1 THEN hi ELSE (lo + hi) / 2 END
          FROM (SELECT i, lo, hi, (SELECT avg(1 / (1 + exp(-(z + (lo + hi) / 2)))) FROM z) AS r FROM b WHERE i < 50))
    SELECT round((lo + hi) / 2, 5) AS bias, round((SELECT avg(1 / (1 + exp(-(z + (lo + hi) / 2)))) FROM z), 5) AS rate FROM b WHERE i = 50""")
def calibrated_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant that brings the mean click probability of the events' scores to one in ten."""
    scores = event_log(spark, sf_dir).where("value IS NOT NULL").select((F.log1p("value") - 2).alias("z"))
    bias, rate = roots.calibrated(scores, "z", 0.1)
    return spark.createDataFrame([(round(bias, 5), round(rate, 5))], "bias double, rate double")  # one row


#: The declared space of the popularity score, and the configurations drawn from it.
SPACE, CONFIGS = {"half_life": (6.0, 336.0, "log"), "alpha": (0.0, 1.0, "uniform")}, 24
_DRAW = "('0x' || substr(md5('{0}:' || i), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE"


@query(f"""WITH {LOG}, {_POPULARITY}, c AS (SELECT i AS config, exp(ln(6.0) + {_DRAW.format("half_life")} * (ln(336.0) - ln(6.0))) AS half_life, {_DRAW.format("alpha")} AS alpha FROM range({CONFIGS}) r(i)),
    r AS (SELECT i.item, greatest(0, ({AS_OF} - pub_s) / 3600.0) AS hours, coalesce(clicks_24h, 0) AS n, coalesce(k, 0) AS later FROM items i LEFT JOIN pop USING (item)
          LEFT JOIN (SELECT item, count(*) AS k FROM clicks WHERE s >= {AS_OF} AND s < {AS_OF} + 259200 GROUP BY item) USING (item) WHERE pub_s <= {AS_OF}),
    f AS (SELECT config, half_life, alpha, count(*) AS evaluated, corr(alpha * ln(1 + n) + (1 - alpha) * pow(0.5, hours / half_life), later) AS fit FROM r, c GROUP BY ALL)
    SELECT config, round(half_life, 5) AS half_life, round(alpha, 5) AS alpha, evaluated, round(fit, 5) + 0.0 AS fit,
           row_number() OVER (ORDER BY round(fit, 9) DESC NULLS LAST, config) AS place FROM f""")
def space_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drawn popularity score against the clicks of the three days after, all on the same items in one scan."""
    later = clicks(spark, sf_dir, since=AS_OF, until=AS_OF + 259200).groupBy("item").agg(F.count("*").alias("later"))
    live = items(spark, sf_dir).where(F.col("pub_s") <= AS_OF).select("item", F.greatest(F.lit(0.0), (F.lit(AS_OF) - F.col("pub_s")) / 3600.0).alias("hours"))
    rows = live.join(popularity(spark, sf_dir).select("item", "clicks_24h"), "item", "left").join(later, "item", "left").na.fill(0)
    score = F.col("alpha") * F.log1p("clicks_24h") + (1 - F.col("alpha")) * F.pow(F.lit(0.5), F.col("hours") / F.col("half_life"))
    found = search.searched(rows, search.configurations(spark, CONFIGS, SPACE), score, "later")
    return found.select("config", F.round("half_life", 5).alias("half_life"), F.round("alpha", 5).alias("alpha"), "evaluated", F.round("fit", 5).alias("fit"), "place")


@query(f"""WITH {LOG}, u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS n, count(*) FILTER (event_type = 'purchase') AS bought FROM log GROUP BY user_id),
    k AS (SELECT k, avg(bought / n) AS rate FROM u, range(1, 31) r(k) WHERE n >= k GROUP BY k), b AS (SELECT sum(bought) / sum(n) AS base FROM u WHERE n > 0),
    v AS (SELECT k, coalesce(abs(rate - base) <= 0.1 * base, FALSE) AS holds FROM k, b)
    SELECT (SELECT min(k) FROM v WHERE k > coalesce((SELECT max(k) FROM v WHERE NOT holds), 0)) AS smallest, round(base, 6) AS base, (SELECT count(*) FROM v) AS sizes FROM b""")
def monotone_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least number of clicks from which on users' mean purchase rate stays within a tenth of the pooled one."""
    log = event_log(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought")).where("n > 0")
    sizes = F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(30).cast("long")))).alias("k")
    rates = log.select(sizes, (F.col("bought") / F.col("n")).alias("rate")).groupBy("k").agg(F.avg("rate").alias("rate"))
    base = log.agg((F.sum("bought") / F.sum("n")).alias("base"))  # one row
    verdicts = rates.join(F.broadcast(base)).withColumn("holds", F.abs(F.col("rate") - F.col("base")) <= 0.1 * F.col("base"))
    found = search.smallest_that_holds(verdicts, "k", "holds")  # one row
    counted = verdicts.agg(F.count("*").alias("sizes"))
    return found.join(F.broadcast(base)).join(F.broadcast(counted)).select("smallest", F.round("base", 6).alias("base"), "sizes")


@query(f"""WITH {LOG}, r AS (SELECT event_id AS req, user_id, s + 1 AS t, item FROM log WHERE event_type = 'purchase'),
    p AS (SELECT r.req, r.item, c.item AS seen, row_number() OVER (PARTITION BY r.req ORDER BY c.s DESC, c.item DESC, c.event_id DESC) AS place
          FROM r JOIN clicks c ON c.user_id = r.user_id AND c.s < t AND c.s >= t - 604800 JOIN items k ON k.item = c.item),
    m AS (SELECT req, place, list_cosine_similarity(a.emb::DOUBLE[], b.emb::DOUBLE[]) AS c, p.item = seen AS same FROM p JOIN items a ON a.item = p.item JOIN items b ON b.item = seen WHERE place <= 10)
    SELECT req, count(*) AS n, round(max(c), 5) + 0.0 AS best, round(list_avg(list(c ORDER BY c DESC)[:3]), 5) + 0.0 AS top3, round(max(c) FILTER (place = 1), 5) + 0.0 AS latest, max(same::INTEGER) AS in_recent
    FROM m GROUP BY req""")
def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like the bought item is to the ten last clicked ones: the most, the mean of the three most, the latest, and whether it is one of them."""
    known = items(spark, sf_dir).select("item", "emb")
    bought = event_log(spark, sf_dir, "purchase").select(F.col("event_id").alias("req"), "user_id", (F.col("s") + 1).alias("t"), (F.col("s") + 1 - 604800).alias("low"), "item")
    log = clicks(spark, sf_dir).select("user_id", "s", F.col("item").alias("seen"), "event_id").join(known.select(F.col("item").alias("seen"), F.col("emb").alias("b")), "seen")
    found = asof.window_join(bought.where("user_id IS NOT NULL"), log, "user_id", "low", "t", "s", 86400)
    last = asof.last_n(found, ["req"], [F.desc("s"), F.desc("seen"), F.desc("event_id")], 10)
    c = last.join(known, "item").select("req", "place", vectors.cosine(F.col("emb"), F.col("b")).alias("c"), (F.col("item") == F.col("seen")).cast("int").alias("same"))
    three = F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, 3)  # ten at most
    sums = c.groupBy("req").agg(F.count("*").alias("n"), F.max("c").alias("best"), three.alias("three"), F.max(F.when(F.col("place") == 1, F.col("c"))).alias("latest"), F.max("same").alias("in_recent"))
    mean = F.aggregate("three", F.lit(0.0), lambda a, x: a + x) / F.size("three")
    return sums.select("req", "n", F.round("best", 5).alias("best"), F.round(mean, 5).alias("top3"), F.round("latest", 5).alias("latest"), "in_recent")
