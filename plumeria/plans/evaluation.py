"""Agreement, classification and clustering quality, samples and splits, re-ranking and slates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeria.functions import scores, vectors
from plumeria.operators import asof, datasets, greedy, inference, nearest, ranking
from plumeria.plans.features import _UNIT, AS_OF, SIZE
from plumeria.plans.ranking import GROUP, _TASKS, ranked_tasks
from plumeria.plans.registry import LOG, query
from plumeria.sources.tables import clicks, event_log, items, requests, table, views

DAY = 86400


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, truth, guess, size): the quality label, and a rule on length as a second judge."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    guess = (F.col("n_chars") > 600).cast("int")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), guess.alias("guess"), F.col("n_chars").alias("size"))


_JUDGED = "judged AS (SELECT doc_id, quality AS truth, (n_chars > 600)::INTEGER AS guess, n_chars AS size FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_JUDGED} SELECT truth, guess, count(*) AS n FROM judged GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy("truth", "guess").agg(F.count("*").alias("n"))


@query(f"""WITH {_JUDGED}, k AS (SELECT c, count(*) FILTER (truth = c AND guess = c) AS tp, count(*) FILTER (truth = c) AS t, count(*) FILTER (guess = c) AS g FROM judged, (VALUES (0), (1)) v(c) GROUP BY c)
    SELECT c AS class, round(CASE WHEN g > 0 THEN tp / g ELSE 0 END, 6) AS precision, round(CASE WHEN t > 0 THEN tp / t ELSE 0 END, 6) AS recall, round(CASE WHEN t + g > 0 THEN 2 * tp / (t + g) ELSE 0 END, 6) AS f1,
           round(avg(CASE WHEN t + g > 0 THEN 2 * tp / (t + g) ELSE 0 END) OVER (), 6) AS macro_f1 FROM k""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by class from the confusion counts, and the mean F1."""
    counts = judged(spark, sf_dir).groupBy("truth", "guess").agg(F.count("*").alias("n"))
    one = lambda c, other: F.sum(F.when(F.col(c) == F.col("class"), F.col("n")).otherwise(0)).alias(other)
    both = counts.withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    k = both.groupBy("class").agg(F.sum(F.when((F.col("truth") == F.col("class")) & (F.col("guess") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"), one("truth", "t"), one("guess", "g"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = safe(2 * F.col("tp"), F.col("t") + F.col("g"))
    return k.select("class", F.round(safe(F.col("tp"), F.col("g")), 6).alias("precision"), F.round(safe(F.col("tp"), F.col("t")), 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.avg(f1).over(Window.partitionBy()), 6).alias("macro_f1"))


@query(f"""WITH {_JUDGED}, s AS (SELECT avg((truth = guess)::INTEGER) AS po, avg(truth) AS a, avg(guess) AS b, count(*) FILTER (truth = 1 AND guess = 1) / count(*) FILTER (truth = 1) AS tpr, count(*) FILTER (truth = 0 AND guess = 0) / count(*) FILTER (truth = 0) AS tnr FROM judged)
    SELECT round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa, round((tpr + tnr) / 2, 6) AS balanced_accuracy FROM s""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, g = F.col("truth"), F.col("guess")
    s = judged(spark, sf_dir).agg(
        F.avg((t == g).cast("int")).alias("po"), F.avg(t).alias("a"), F.avg(g).alias("b"),
        (F.count_if((t == 1) & (g == 1)) / F.count_if(t == 1)).alias("tpr"), (F.count_if((t == 0) & (g == 0)) / F.count_if(t == 0)).alias("tnr"),
    )
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return s.select(F.round((F.col("po") - pe) / (1 - pe), 6).alias("kappa"), F.round((F.col("tpr") + F.col("tnr")) / 2, 6).alias("balanced_accuracy"))


@query(f"""WITH {_JUDGED}, r AS (SELECT truth, avg(rn) OVER (PARTITION BY size) AS rs, avg(rt) OVER (PARTITION BY truth) AS rq FROM (SELECT *, row_number() OVER (ORDER BY size) AS rn, row_number() OVER (ORDER BY truth) AS rt FROM judged))
    SELECT round(corr(rs, rq), 6) AS spearman FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of length and label; average ranks come from prefix sums over counts of distinct values."""
    df = judged(spark, sf_dir)

    def ranks(c: str) -> DataFrame:
        counts = df.groupBy(c).agg(F.count("*").alias("_n"))
        earlier = asof.prefix_sums(counts, [], c, [F.col(c)], 1024, before=F.col("_n"))
        return earlier.select(c, (F.col("before") + (F.col("_n") + 1) / 2).alias(f"rank_{c}"))

    return df.join(ranks("size"), "size").join(ranks("truth"), "truth").agg(F.round(F.corr("rank_size", "rank_truth"), 6).alias("spearman"))


@query("""WITH c AS (SELECT label AS t, vec_id % 7 AS p, count(*) AS n FROM embeddings GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER () AS all_ FROM c)
    SELECT round(sum(n * n / np) / any_value(all_), 6) AS precision, round(sum(n * n / nt) / any_value(all_), 6) AS recall FROM m""")
def bcubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-cubed precision and recall from the contingency table."""
    c = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("t"), (F.col("vec_id") % 7).alias("p")).agg(F.count("*").alias("n"))
    of = lambda k: F.sum("n").over(Window.partitionBy(k))
    m = c.select("n", of("p").alias("np"), of("t").alias("nt"))
    return m.agg(F.round(F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n"), 6).alias("precision"), F.round(F.sum(F.col("n") * F.col("n") / F.col("nt")) / F.sum("n"), 6).alias("recall"))


@query("""WITH c AS (SELECT label AS t, vec_id % 7 AS p, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS x, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY t)) AS a, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY p)) AS b, (SELECT sum(n) FROM c) AS n)
    SELECT round((x - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS adjusted_rand FROM s""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("t"), (F.col("vec_id") % 7).alias("p")).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    total = lambda k: c.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(k))
    s = c.agg(F.sum(pairs(F.col("n"))).alias("x"), F.sum("n").alias("n")).join(F.broadcast(total("t"))).join(F.broadcast(total("p")))  # one row each
    by_chance = F.col("t") * F.col("p") / pairs(F.col("n"))
    return s.select(F.round((F.col("x") - by_chance) / ((F.col("t") + F.col("p")) / 2 - by_chance), 6).alias("adjusted_rand"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label < 8 GROUP BY label), a AS (SELECT count(*) AS all_, count(*) FILTER (label >= 8) AS noise FROM embeddings)
    SELECT count(*) AS clusters, round(any_value(noise) / any_value(all_), 6) AS noise_ratio, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS largest FROM c, a""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sizes of clusters, labels from 8 on being noise."""
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    real = F.when(F.col("label") < 8, F.col("n"))
    return sizes.agg(
        F.count(real).alias("clusters"), F.round(F.sum(F.when(F.col("label") >= 8, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("noise_ratio"),
        F.min(real).alias("least"), F.percentile(real, F.lit(0.5)).alias("median"), F.max(real).alias("largest"),
    )


_DOT = "list_sum(list_transform(range(1, 65), lambda k: a.emb[k]::DOUBLE * b.emb[k]))"


@query(f"""WITH {LOG}, n AS (SELECT a.item, a.category, b.category AS other, row_number() OVER (PARTITION BY a.item ORDER BY round({_DOT}, 9) DESC, b.item) AS r FROM items a JOIN items b ON a.item <> b.item WHERE a.item % 20 = 0),
    v AS (SELECT item, category, other, count(*) AS votes, min(r) AS nearest FROM n WHERE r <= 10 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes DESC, nearest) AS place FROM v)
    SELECT item, category, other AS voted FROM w WHERE place = 1""")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that most of the ten nearest other items have, ties to the nearest; every twentieth item is asked.

    Items lie in blocks; the asked ones are sent to every block, which gives its ten best before blocks are merged. All
    pairs are looked at, so the products grow with the square of the items, at a few nanoseconds each.
    """
    every = items(spark, sf_dir).select(F.col("item").alias("id"), F.col("category").alias("tag"), F.col("emb").alias("vec"))
    found = nearest.nearest(every, every.where("id % 20 = 0"), 10)
    kind = every.schema["tag"].dataType
    best = found.select("q", F.col("q_tag").cast(kind).alias("category"), F.col("tag").cast(kind).alias("other"), F.col("place").alias("r"))
    votes = best.groupBy("q", "category", "other").agg(F.count("*").alias("votes"), F.min("r").alias("nearest"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("votes"), "nearest"))
    return votes.withColumn("p", place).where("p = 1").select(F.col("q").alias("item"), "category", F.col("other").alias("voted"))


_COSINE = f"CASE WHEN {_DOT.replace('b.', 'a.')} * {_DOT.replace('a.', 'b.')} > 0 THEN {_DOT} / (sqrt({_DOT.replace('b.', 'a.')}) * sqrt({_DOT.replace('a.', 'b.')})) ELSE 0 END"


@query(f"""WITH {LOG}, n AS (SELECT a.item AS asked, b.item, round({_COSINE}, 9) AS c FROM items a JOIN items b ON a.item <> b.item WHERE a.item % 20 = 0 AND b.pub_s BETWEEN {AS_OF} - 1209600 AND {AS_OF}),
    r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY c DESC, item) AS place FROM n)
    SELECT asked, place, item, round(c, 5) AS cosine FROM r WHERE place <= 20""")
def knn_topk_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_topk`` for every twentieth item: its twenty nearest among the items of two weeks; exact, in blocks."""
    blocks = 16
    every = items(spark, sf_dir).select("item", "emb", "pub_s")
    here = every.where(F.col("pub_s").between(AS_OF - 14 * DAY, AS_OF)).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    asked = every.where("item % 20 = 0").select(F.col("item").alias("asked"), F.col("emb").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = here.join(asked, "block").where("item <> asked")
    near = pairs.select("block", "asked", "item", F.round(vectors.cosine(F.col("emb"), F.col("q")), 9).alias("c"))
    order = [F.desc("c"), "item"]
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("asked", "block").orderBy(*order))).where("place <= 20")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*order)).cast("long")).where("place <= 20")
    return best.select("asked", "place", "item", F.round("c", 5).alias("cosine"))


@query(f"""WITH {LOG}, v AS (SELECT item, category, {_UNIT} AS u FROM items i), e AS (SELECT item, category, unnest(u) AS x, unnest(range(64)) AS d FROM v),
    t AS (SELECT category AS c, d, sum(x) AS total FROM e GROUP BY ALL), n AS (SELECT category AS c, count(*) AS n FROM v GROUP BY category), s AS (SELECT e.item, e.category, t.c, sum(e.x * t.total) AS s FROM e JOIN t USING (d) GROUP BY ALL),
    k AS (SELECT item, category, max(CASE WHEN category = c AND n > 1 THEN 1 - (s - 1) / (n - 1) END) AS a, min(CASE WHEN category <> c THEN 1 - s / n END) AS b FROM s JOIN n USING (c) GROUP BY ALL)
    SELECT category, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM k GROUP BY category""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine silhouette of the labels from sums of unit vectors by label: no pairs are made."""
    v = items(spark, sf_dir).select("item", "category", vectors.unit(F.col("emb")).alias("u"))
    sums = v.groupBy("category").agg(F.count("*").alias("n"), *vectors.element_sums(F.col("u"), SIZE, F.lit(1.0)))
    centres = sums.select(F.col("category").alias("c"), "n", vectors.gathered(SIZE).alias("total"))
    far = v.join(F.broadcast(centres))  # one row a label
    own = F.col("category") == F.col("c")
    s = vectors.dot(F.col("u"), F.col("total"))
    a = F.max(F.when(own & (F.col("n") > 1), 1 - (s - 1) / (F.col("n") - 1)))
    b = F.min(F.when(~own, 1 - s / F.col("n")))
    each = far.groupBy("item", "category").agg(a.alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("silhouette"))


@query(f"""WITH {LOG}, {_TASKS}, t AS (SELECT r.user_id, r.day, r.item, r.rank, row_number() OVER (PARTITION BY r.user_id, r.day ORDER BY pub_s DESC) AS other FROM ranked r JOIN items USING (item) WHERE r.rank < 20)
    SELECT a.user_id, a.day, round(avg(sign(a.rank - b.rank) * sign(a.other - b.other)), 6) AS tau FROM t a JOIN t b ON a.user_id = b.user_id AND a.day = b.day AND a.item < b.item GROUP BY a.user_id, a.day""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two orders of a list's first twenty items; pairs are made inside the list only."""
    t = ranked_tasks(spark, sf_dir).where("rank < 20").join(items(spark, sf_dir).select("item", "pub_s"), "item")
    lists = t.groupBy(*GROUP).agg(F.collect_list(F.struct("rank", "pub_s")).alias("l")).where(F.size("l") > 1)
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.signum((x["rank"] - y["rank"]).cast("double")) * -F.signum((x["pub_s"] - y["pub_s"]).cast("double")))))
    return lists.select(*GROUP, F.round(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs), 6).alias("tau"))


@query(f"""WITH {LOG}, r AS (SELECT req, t FROM requests) SELECT req, count(item) AS pool FROM r LEFT JOIN items ON pub_s BETWEEN t - 172800 AND t GROUP BY req""")
def pool_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items came out in the two days before each request: the difference of two prefix counts, no pairs."""
    cuts = F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("t") + 1).alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("t") - 2 * DAY).alias("at"))))
    asked = requests(spark, sf_dir).select("req", cuts.alias("c")).select("req", "c.sign", "c.at", F.lit(0).alias("all_"))
    out = items(spark, sf_dir).select("pub_s", F.lit(0).alias("all_"))
    both = asof.merged(asked, out, "all_", "at", "pub_s")
    counted = asof.prefix_sums(both, [], "at", [F.col("at"), F.col("kind")], 7 * DAY, n=F.col("kind").cast("long")).where("kind = 0")
    return counted.groupBy("request.req").agg(F.sum(F.col("request.sign") * F.col("n")).alias("pool"))


_MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(f"""WITH {LOG}, p AS (SELECT req, user_id, t, item FROM requests JOIN items ON pub_s BETWEEN t - 604800 AND t),
    u AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.event_type IN ('click', 'view') AND l.user_id = p.user_id AND l.item = p.item AND l.s < p.t)),
    r AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY {_MD5.format("'7:' || req || ':' || item")}, req, item) AS place FROM u)
    SELECT req, item FROM r WHERE place <= 4""")
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four repeatable negatives of a request among the week's items that the user hasn't met before."""
    asked = datasets.pool(requests(spark, sf_dir), items(spark, sf_dir).select("item", "pub_s"), "t", "pub_s", 7 * DAY)
    seen = event_log(spark, sf_dir, "click", "view").select("user_id", "item", "s")
    free = datasets.unseen(asked, seen, "user_id", "item", "t", "s")
    return datasets.first_by_hash(free, ["req"], 4, 7, "req", "item").select("req", "item")


@query(f"""WITH {LOG}, g AS (SELECT user_id, min(s) AS t, count(*) AS n FROM clicks GROUP BY user_id), u AS (SELECT *, sum(n) OVER (ORDER BY t, user_id) AS upto, sum(n) OVER () AS total FROM g),
    c AS (SELECT arg_min(upto, (abs(upto - total * 0.8), upto)) AS cut FROM u) SELECT CASE WHEN upto <= cut THEN 'train' ELSE 'valid' END AS part, count(*) AS users, sum(n)::BIGINT AS rows FROM u, c GROUP BY part""")
def group_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = datasets.group_safe_split(clicks(spark, sf_dir), "user_id", "s", 0.8)
    return parts.groupBy("part").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("rows"))


@query(f"""WITH {LOG}, h AS (SELECT user_id, count(*) FILTER (s < {AS_OF}) AS before, count(*) FILTER (s >= {AS_OF}) AS after FROM clicks GROUP BY user_id)
    SELECT CASE WHEN before = 0 THEN 'new' WHEN before < 5 THEN 'cold' ELSE 'warm' END AS kind, count(*) AS users, sum(after)::BIGINT AS answers FROM h WHERE after > 0 GROUP BY kind""")
def cold_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = clicks(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("s") < AS_OF).alias("before"), F.count_if(F.col("s") >= AS_OF).alias("after"))
    kind = scores.bucket(F.col("before"), [1, 5], ["new", "cold", "warm"])
    return h.where("after > 0").groupBy(kind.alias("kind")).agg(F.count("*").alias("users"), F.sum("after").alias("answers"))


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY {_MD5.format("'3:' || user_id")}, user_id) AS place, count(*) OVER () AS n FROM u)
    SELECT user_id, place <= ceil(0.1 * n) AS tenth, place <= ceil(0.5 * n) AS half FROM r""")
def nested_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their place in one fixed permutation, so smaller samples lie in larger ones.

    The place is a prefix sum over hash ranges, so the permutation of very many users isn't one task's.
    """
    users = event_log(spark, sf_dir).select("user_id").distinct().withColumn("h", scores.md5_number(F.lit(3), F.col("user_id")))
    users = users.withColumn("part", F.expr("h div 4194304"))  # 1024 ranges
    counts = users.groupBy("part").agg(F.count("*").alias("n"))
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("h", "user_id"))
    one = users.join(bases, "part").withColumn("place", place)
    return one.select("user_id", (F.col("place") <= F.ceil(F.lit(0.1) * F.col("total"))).alias("tenth"), (F.col("place") <= F.ceil(F.lit(0.5) * F.col("total"))).alias("half"))


@query(f"""WITH b AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), s AS (SELECT *, size * 100.0::DOUBLE / sum(size) OVER () AS share FROM b), f AS (SELECT *, floor(share) AS base, round(share - floor(share), 9) AS rest, 100 - sum(floor(share)) OVER () AS left_ FROM s),
    t AS (SELECT lang, size, base + (row_number() OVER (ORDER BY rest DESC, lang) <= left_)::INTEGER AS take FROM f), r AS (SELECT doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY {_MD5.format("'5:' || doc_id")}, doc_id) AS place FROM documents d)
    SELECT doc_id, r.lang, round(size / take, 6) AS weight FROM r JOIN t USING (lang) WHERE place <= take""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents, languages in proportion, with the number that each stands for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    strata = datasets.largest_remainder(docs.groupBy("lang").agg(F.count("*").alias("size")), "size", 100)
    sample = datasets.first_by_hash(docs.join(strata, "lang"), ["lang"], F.col("take"), 5, "doc_id")
    return sample.select("doc_id", "lang", F.round(F.col("size") / F.col("take"), 6).alias("weight"))


@query(f"""WITH {LOG} SELECT (s - 1704067200) // 259200 AS block, count(*) AS n, sum(count(*)) OVER (ORDER BY (s - 1704067200) // 259200 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS earlier FROM clicks GROUP BY 1""")
def time_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three days and the events of the blocks before, on which each may learn (one row a block)."""
    block = datasets.time_block(F.col("s"), 1_704_067_200, 3 * DAY).alias("block")
    counts = clicks(spark, sf_dir).groupBy(block).agg(F.count("*").alias("n"))
    return counts.withColumn("earlier", F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))


@query(f"""WITH {LOG}, c AS (SELECT user_id, category, count(*) AS n FROM clicks JOIN items USING (item) WHERE s < {AS_OF} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS place FROM c)
    SELECT user_id, place, category FROM r WHERE place <= 3""")
def static_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = items(spark, sf_dir).select("item", "category")
    counts = clicks(spark, sf_dir, until=AS_OF).join(kinds, "item").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "category"))
    return counts.withColumn("place", place.cast("long")).where("place <= 3").select("user_id", "place", "category")


@query(f"""WITH {LOG}, {_TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY label DESC, {_MD5.format("'2:' || item")}, item) AS place FROM task) SELECT user_id, day, item, label FROM r WHERE place <= 2 OR label = 1""")
def pool_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of two candidates, positives always kept."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("label"), scores.md5_number(F.lit(2), F.col("item")), "item")
    df = ranked_tasks(spark, sf_dir).withColumn("place", F.row_number().over(w))
    return df.where("place <= 2 OR label = 1").select(*GROUP, "item", "label")


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(all_, item, score, emb, pub_s): the items of the two weeks before the snapshot, which every user is offered.

    Items and scores don't depend on the user: they are ranked once, as one request named ``all_``.
    """
    snapshot = spark.range(1).select(F.lit(0).alias("all_"), F.lit(AS_OF).cast("long").alias("t"))
    pairs = datasets.pool(snapshot, items(spark, sf_dir), "t", "pub_s", 14 * DAY)
    popular = clicks(spark, sf_dir, until=AS_OF).groupBy("item").agg(F.count("*").alias("n"))
    fresh = F.exp(-(F.lit(AS_OF) - F.col("pub_s")) / (48 * 3600.0))
    return pairs.join(popular, "item", "left").select("all_", "item", F.round(fresh + F.log1p(F.coalesce("n", F.lit(0)).cast("double")) / 5, 9).alias("score"), "emb", "pub_s")


def for_users(spark: SparkSession, sf_dir: str, one: DataFrame) -> DataFrame:
    """``one``, a list for all, as a list of each user of the log."""
    users = event_log(spark, sf_dir).select("user_id").where("user_id IS NOT NULL").distinct()
    return users.crossJoin(one.drop("all_"))


@query()
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten items a user, relevant and unlike one another."""
    best = greedy.mmr(offered(spark, sf_dir), "all_", 10)
    return for_users(spark, sf_dir, best).select("user_id", "place", "item", F.round("score", 6).alias("score"))


@query()
def round_robin_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources in turn, thirty items a user."""
    o = offered(spark, sf_dir)
    by = lambda name, *order: o.select("all_", "item", F.lit(name).alias("source"), (F.row_number().over(Window.partitionBy("all_").orderBy(*order)) - 1).alias("rank"))
    lists = by("popular", F.desc("score"), "item").unionByName(by("recent", F.desc("pub_s"), "item")).unionByName(by("other", scores.md5_number(F.lit(1), F.col("item")), "item"))
    return for_users(spark, sf_dir, greedy.round_robin(lists, "all_", ["popular", "recent", "other"], 30))


@query()
def exploration_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slates of ten places, two of them explored, with exact propensities."""
    ranked = ranking.ranked(offered(spark, sf_dir), ["all_"], "score", "item").select("all_", "item", "rank")
    ranked = for_users(spark, sf_dir, ranked)
    return greedy.exploration_slate(ranked, "user_id", 10, 2).select("user_id", "position", "item", "explored", F.round("propensity", 9).alias("propensity"))


@query(f"""WITH {LOG}, a AS (SELECT user_id, item, min(s) AS first_view FROM views GROUP BY ALL), b AS (SELECT user_id, item, min(s) AS first_click FROM clicks GROUP BY ALL)
    SELECT user_id, item, coalesce(first_view, -1) AS first_view, coalesce(first_click, -1) AS first_click FROM a FULL JOIN b USING (user_id, item)""")
def impression_click_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First view and first click of every user and item that have either."""
    a = views(spark, sf_dir).groupBy("user_id", "item").agg(F.min("s").alias("first_view"))
    b = clicks(spark, sf_dir).groupBy("user_id", "item").agg(F.min("s").alias("first_click"))
    return a.join(b, ["user_id", "item"], "full").na.fill(-1)


@query("""WITH g AS (SELECT least(n_chars // 700, 5) AS a, least(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) // 120, 5) AS b FROM documents),
    o AS (SELECT count(*) AS n, sum(abs(a - b)) AS l, sum((a - b) * (a - b)) AS q, count(*) FILTER (a <> b) AS u FROM g WHERE a IS NOT NULL AND b IS NOT NULL),
    e AS (SELECT sum(abs(x.a - y.b) * x.n * y.n) AS l, sum((x.a - y.b) * (x.a - y.b) * x.n * y.n) AS q, sum(x.n * y.n) FILTER (x.a <> y.b) AS u
          FROM (SELECT a, count(*) AS n FROM g GROUP BY a) x, (SELECT b, count(*) AS n FROM g GROUP BY b) y)
    SELECT n, round(1 - o.u * n / e.u, 6) AS unweighted, round(1 - o.l * n / e.l, 6) AS linear, round(1 - o.q * n / e.q, 6) AS quadratic FROM o, e""")
def graded_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two grades of a document's size, by characters and by words."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    grades = table(spark, sf_dir, "documents").select(F.expr("least(n_chars div 700, 5)").alias("a"), F.least(F.floor(words / 120), F.lit(5)).cast("long").alias("b"))
    found = inference.weighted_kappa(grades, "a", "b")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("unweighted", "linear", "quadratic")])
