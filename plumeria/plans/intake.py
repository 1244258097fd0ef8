"""What comes in and goes out: list columns, merges, ledgers, dates, cleaning rules, health and export checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.functions import scores, text
from plumeria.plans.features import AS_OF
from plumeria.plans.operations import _RUNS, runs
from plumeria.plans.ranking import _SLOTS, _TASKS, GROUP, slots, tasks
from plumeria.plans.registry import LOG, query
from plumeria.sources import lists
from plumeria.sources.tables import clicks, event_log, items, table

HOUR, DAY = 3600, 86400


def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, inview, clicked): a user's viewed items of a day in order, and those clicked, as list columns."""
    log = event_log(spark, sf_dir, "click", "view").withColumn("day", F.expr("s div 86400"))
    seen = F.array_sort(F.collect_list(F.when(F.col("event_type") == "view", F.struct("us", "event_id", "item"))))
    clicked = F.collect_set(F.when(F.col("event_type") == "click", F.col("item")))
    return log.groupBy(*GROUP).agg(F.transform(seen, lambda x: x["item"]).alias("inview"), clicked.alias("clicked"))


@query(f"""WITH {LOG}, v AS (SELECT user_id, s // 86400 AS day, item, row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY us, event_id) - 1 AS place FROM views),
    k AS (SELECT DISTINCT user_id, s // 86400 AS day, item FROM clicks)
    SELECT v.user_id, v.day, v.place, v.item, (k.item IS NOT NULL)::INTEGER AS clicked FROM v LEFT JOIN k USING (user_id, day, item)""")
def inview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of shown items as rows, with whether an item is in the row's list of clicks."""
    return lists.inview_rows(behaviours(spark, sf_dir), GROUP)


@query(f"WITH {LOG} SELECT user_id, s // 86400 AS day, item, count(*) AS n, count(DISTINCT us) AS times FROM clicks GROUP BY ALL")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two zipped list columns, items and times, as rows, counted."""
    lists_ = clicks(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("us", "item")).alias("l"))
    history = lists_.select("user_id", F.col("l.item").alias("items"), F.col("l.us").alias("times"))
    rows = lists.history_rows(history, ["user_id"])
    return rows.groupBy("user_id", F.expr(f"time div {DAY * 1_000_000}").alias("day"), "item").agg(F.count("*").alias("n"), F.count_distinct("time").alias("times"))


@query(f"""WITH {LOG}, d AS (SELECT DISTINCT user_id, s // 86400 AS day FROM log WHERE event_type = 'purchase')
    SELECT v.user_id, v.s // 86400 AS day, count(*) AS shown, count(DISTINCT item) AS items FROM views v JOIN d ON d.user_id = v.user_id AND d.day = v.s // 86400 GROUP BY ALL""")
def request_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shown lists of the days on which a user bought, by a semi-join on the request."""
    bought = event_log(spark, sf_dir, "purchase").select("user_id", F.expr("s div 86400").alias("day")).distinct()
    kept = behaviours(spark, sf_dir).join(bought, GROUP, "left_semi").where(F.size("inview") > 0)
    return kept.select(*GROUP, F.size("inview").cast("long").alias("shown"), F.size(F.array_distinct("inview")).cast("long").alias("items"))


@query("""WITH n AS (SELECT doc_id, lang, source, md5(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS h FROM documents), old AS (SELECT * FROM n WHERE lang = 'en'), fresh AS (SELECT * FROM n WHERE lang <> 'en' OR lang IS NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM fresh)
    SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM old WHERE old.h = f.h) THEN 'stored' WHEN r > 1 THEN 'repeated' ELSE 'new' END AS verdict FROM f""")
def merge_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of other languages merged into the English store: stored already, repeated within, or new."""
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    n = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(norm).alias("h"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    old = n.where(english).select("h").distinct().withColumn("stored", F.lit(True))
    fresh = n.where(~english)
    first = fresh.groupBy("h").agg(F.min("doc_id").alias("first"))
    verdict = F.when(F.col("stored"), "stored").when(F.col("doc_id") != F.col("first"), "repeated").otherwise("new")
    return fresh.join(first, "h").join(old, "h", "left").select("doc_id", verdict.alias("verdict"))


@query(f"""WITH {LOG}, {_SLOTS} SELECT request, any_value(user_id) AS user_id, count(*) AS places, count(*) FILTER (explored) AS explored, string_agg(item::VARCHAR, ',' ORDER BY position) AS items FROM slots GROUP BY request""")
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each request beside its impressions, as the log's two tables are written."""
    requests_, _ = lists.request_and_impressions(slots(spark, sf_dir))
    return requests_.select("request", "user_id", "places", "explored", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV lines and parsed again under a schema."""
    line = F.to_csv(F.struct("o_orderkey", "o_totalprice", "o_orderstatus"))
    parsed = F.from_csv(line, "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING", {"mode": "FAILFAST"})
    return table(spark, sf_dir, "orders").select(parsed.alias("r")).select("r.*")


@query(f"WITH {LOG} SELECT user_id, count(*) AS entries, round(sum(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END), 4) AS balance FROM log GROUP BY user_id")
def json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of JSON lines folded to balances: purchases add, errors take back."""
    lines = event_log(spark, sf_dir).select(F.to_json(F.struct("user_id", "event_type", "value")).alias("line"))
    entry = F.from_json("line", "user_id BIGINT, event_type STRING, value DOUBLE")
    rows = lines.select(entry.alias("e")).select("e.*")
    amount = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", -F.col("value")).otherwise(0.0)
    return rows.groupBy("user_id").agg(F.count("*").alias("entries"), F.round(F.sum(amount), 4).alias("balance"))


@query("""WITH n AS (SELECT vec_id, len(embedding) AS size, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
    SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(size) AS least_size, max(size) AS most_size, round(min(norm), 4) AS least_norm, round(max(norm), 4) AS most_norm, count(*) FILTER (norm < 1e-6 OR isnan(norm)) AS bad FROM n""")
def pack_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedding pack must show before it is used: ids, sizes and norms."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    n = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("size"), norm.alias("norm"))
    return n.agg(
        F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), F.min("size").alias("least_size"), F.max("size").alias("most_size"),
        F.round(F.min("norm"), 4).alias("least_norm"), F.round(F.max("norm"), 4).alias("most_norm"), F.count_if((F.col("norm") < 1e-6) | F.isnan("norm")).alias("bad"),
    )


@query("""WITH r AS (SELECT source, ('0x' || substr(md5(doc_id || '|' || coalesce(lang, '') || '|' || coalesce(source, '') || '|' || n_chars || '|' || coalesce(text, '')), 1, 12))::BIGINT AS h FROM documents)
    SELECT source, count(*) AS rows_, sum(h)::BIGINT AS checksum FROM r GROUP BY source UNION ALL SELECT 'TRAILER', count(*), sum(h)::BIGINT FROM r""")
def export_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and an order-free checksum of an export, by source and in its trailer.

    Sums are exact as decimals. From some 65,000 rows on they can pass the 63 bits of the column, where the SQL's cast
    fails; a checksum is then the sum modulo 2**64 in two's complement, and below that the sum itself.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("|", *[part(c) for c in ("doc_id", "lang", "source", "n_chars", "text")])
    h = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(15,0)")
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows_"), F.sum(h).alias("sum_"))
    all_ = by.agg(F.lit("TRAILER").alias("source"), F.coalesce(F.sum("rows_"), F.lit(0)).alias("rows_"), F.sum("sum_").alias("sum_"))
    return by.unionByName(all_).select("source", "rows_", text.in_64_bits(F.col("sum_")).alias("checksum"))


@query("""WITH h AS (SELECT source, md5(coalesce(text, '')) AS h FROM documents), c AS (SELECT source, h, count(*) AS n FROM h GROUP BY ALL), s AS (SELECT source, sum(n)::BIGINT AS parsed, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS dup FROM c GROUP BY source)
    SELECT source, parsed, dup, parsed >= 5 AND dup / parsed >= 0.05 AS suspect FROM s""")
def same_body_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that return one body for many pages."""
    body = F.md5(F.coalesce("text", F.lit(""))).alias("h")
    by = table(spark, sf_dir, "documents").groupBy("source", body).agg(F.count("*").alias("n"))
    s = by.groupBy("source").agg(F.sum("n").alias("parsed"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup"))
    return s.select("source", "parsed", "dup", ((F.col("parsed") >= 5) & (F.col("dup") / F.col("parsed") >= 0.05)).alias("suspect"))


@query(f"""WITH {LOG}, {_RUNS}, h AS (SELECT job, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, max(seconds) AS longest FROM runs GROUP BY job)
    SELECT job, n, failed, CASE WHEN n < 10 THEN 'too few' WHEN failed / n > 0.5 THEN 'down' WHEN failed / n > 0.1 THEN 'degraded' ELSE 'healthy' END AS health, round(longest, 4) AS longest FROM h""")
def extract_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's health by its share of failures."""
    h = runs(spark, sf_dir).groupBy("job").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("seconds").alias("longest"))
    share = F.col("failed") / F.col("n")
    health = F.when(F.col("n") < 10, "too few").when(share > 0.5, "down").when(share > 0.1, "degraded").otherwise("healthy")
    return h.select("job", "n", "failed", health.alias("health"), F.round("longest", 4).alias("longest"))


@query(f"""WITH {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY us DESC, event_id DESC) AS r FROM log), l AS (SELECT item, any_value(event_type) FILTER (r = 1) AS last_kind, count(*) FILTER (event_type = 'error') AS errors FROM o GROUP BY item)
    SELECT item AS feed, errors FROM l WHERE last_kind = 'error'""")
def retry_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds whose last fetch failed."""
    by = event_log(spark, sf_dir).groupBy("item").agg(F.max_by("event_type", F.struct("us", "event_id")).alias("last_kind"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return by.where("last_kind = 'error'").select(F.col("item").alias("feed"), "errors")


@query(f"""WITH {LOG} SELECT item, pub_s FROM items WHERE pub_s >= {AS_OF - DAY} AND pub_s < {AS_OF} AND len(emb) > 0 AND item NOT IN (SELECT item FROM clicks WHERE s >= {AS_OF - DAY} AND s < {AS_OF} AND item IS NOT NULL)""")
def lookback_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the last day that have a vector and that nobody has taken yet."""
    fresh = items(spark, sf_dir).where((F.col("pub_s") >= AS_OF - DAY) & (F.col("pub_s") < AS_OF) & (F.size("emb") > 0))
    taken = clicks(spark, sf_dir).where((F.col("s") >= AS_OF - DAY) & (F.col("s") < AS_OF)).select("item")
    return fresh.join(taken, "item", "left_anti").select("item", "pub_s")


@query(f"""WITH {LOG}, {_RUNS}, h AS (SELECT job, s // 3600 AS hour, bool_or(status = 'succeeded') AS ok, max(seconds) AS longest FROM runs GROUP BY ALL),
    a AS (SELECT job, count(*) AS hours, count(*) FILTER (ok) AS good, quantile_cont(longest, 0.95) AS p95 FROM h GROUP BY job)
    SELECT job, 'A1' AS rule, round(good / hours, 6) AS value, good / hours >= 0.99 AS holds FROM a UNION ALL SELECT job, 'B1', round(p95, 6), p95 <= 300 FROM a UNION ALL SELECT job, 'C1', hours::DOUBLE, hours >= 24 FROM a""")
def sla_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a service level, job by job: good hours, the 95th percentile of durations, hours seen."""
    h = runs(spark, sf_dir).groupBy("job", F.expr("s div 3600").alias("hour")).agg(F.bool_or(F.col("status") == "succeeded").alias("ok"), F.max("seconds").alias("longest"))
    a = h.groupBy("job").agg(F.count("*").alias("hours"), F.count_if("ok").alias("good"), F.percentile("longest", 0.95).alias("p95"))
    share = F.col("good") / F.col("hours")
    rules = [("A1", F.round(share, 6), share >= 0.99), ("B1", F.round("p95", 6), F.col("p95") <= 300), ("C1", F.col("hours").cast("double"), F.col("hours") >= 24)]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("value"), p.alias("holds")) for n, v, p in rules])).alias("r")
    return a.select("job", cells).select("job", "r.*")


@query(f"WITH {LOG} SELECT event_id, us // 1000000 - 32400 AS utc_s, (us // 1000000 - 32400) // 86400 AS utc_day FROM log")
def naive_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without a zone read as Korean time and turned to UTC."""
    naive = F.expr("timestamp_micros(us)")
    utc = F.unix_seconds(F.to_utc_timestamp(naive, "Asia/Seoul"))
    return event_log(spark, sf_dir).select("event_id", utc.alias("utc_s"), F.floor(utc / DAY).alias("utc_day"))


@query(f"""WITH {LOG}, w AS (SELECT user_id, min(s // 86400) AS a, max(s // 86400) AS b FROM log GROUP BY user_id)
    SELECT user_id, i AS first_day, least(i + 2, b) AS last_day FROM w, unnest(range(a, b + 1, 3)) AS r(i)""")
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days in windows of three at most, as a paged source is asked for them."""
    w = event_log(spark, sf_dir).groupBy("user_id").agg(F.min(F.expr("s div 86400")).alias("a"), F.max(F.expr("s div 86400")).alias("b"))
    first = F.explode(F.sequence("a", "b", F.lit(3).cast("long"))).alias("first_day")
    return w.select("user_id", "b", first).select("user_id", "first_day", F.least(F.col("first_day") + 2, F.col("b")).alias("last_day"))


@query(f"""WITH {LOG}, t AS (SELECT event_id, CASE item % 4 WHEN 0 THEN '2024-01-' || (1 + item % 28) WHEN 1 THEN '2024-02-30' WHEN 2 THEN 'soon' ELSE '2024-03-01' END AS said FROM log)
    SELECT event_id, TRY_CAST(said AS DATE) IS NOT NULL AS known, datediff('day', DATE '1970-01-01', TRY_CAST(said AS DATE)) AS day FROM t""")
def safe_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in texts, null where they are none."""
    k = F.col("item") % 4
    said = F.when(k == 0, F.concat(F.lit("2024-01-"), (1 + F.col("item") % 28).cast("string"))).when(k == 1, "2024-02-30").when(k == 2, "soon").otherwise("2024-03-01")
    date = said.try_cast("date")
    return event_log(spark, sf_dir).select("event_id", date.isNotNull().alias("known"), F.unix_date(date).cast("long").alias("day"))


@query(f"""WITH {LOG}, c AS (SELECT user_id, category, count(*) FILTER (s < {AS_OF}) AS old, count(*) AS n FROM clicks JOIN items USING (item) GROUP BY ALL)
    SELECT user_id, category, n FROM c""")
def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of counts by category, before and after the snapshot, merged key by key."""
    kinds = clicks(spark, sf_dir).join(items(spark, sf_dir).select("item", "category"), "item")
    part = lambda where: kinds.where(where).groupBy("user_id", "category").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))
    old, new = part(F.col("s") < AS_OF).withColumnRenamed("m", "a"), part(F.col("s") >= AS_OF).withColumnRenamed("m", "b")
    none = F.create_map().cast("map<bigint,bigint>")
    both = old.join(new, "user_id", "full").select("user_id", F.map_zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias("m"))
    return both.select("user_id", F.explode("m").alias("category", "n"))


@query(r"""WITH c AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, md5(trim(regexp_replace(CASE WHEN source = 'src1' THEN regexp_replace(text, '(?i)(share|subscribe|sign in)\b.*', '', 'g') ELSE regexp_replace(text, '^\[[^\]]*\]\s*', '') END, '\s+', ' ', 'g'), ' ')) AS cleaned FROM c""")
def press_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by source: what follows a site's own controls in a line goes, or a mark in brackets at the beginning."""
    text = F.coalesce("text", F.lit(""))
    rules = F.when(F.col("source") == "src1", F.regexp_replace(text, r"(?i)(share|subscribe|sign in)\b[^\n]*", "")).otherwise(F.regexp_replace(text, r"^\[[^\]]*\]\s*", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(rules, r"\s+", " "))).alias("cleaned"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(p|div|li|ul|br|h[1-6]|article|nav|footer)\b[^>]*>', e'\n', 'g'), '<[^>]*>', '', 'g') AS h FROM a)
    SELECT page_id, md5(trim(regexp_replace(h, '\s+', ' ', 'g'), ' ')) AS text FROM b""")
def policy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a notice's HTML: scripts go, block tags become line ends, other tags nothing."""
    h = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?i)</?(p|div|li|ul|br|h[1-6]|article|nav|footer)\b[^>]*>", "\n")
    h = F.regexp_replace(h, r"<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(h, r"\s+", " "))).alias("text"))


#: The columns of a feature table in their order; its hash must be the one that a model was fitted with.
SCHEMA = ("score", "pub_age_h", "category")
SCHEMA_HASH = hashlib.sha256(",".join(f"{x}:float" for x in SCHEMA).encode()).hexdigest()


@query(f"""WITH {LOG}, {_TASKS}, x AS (SELECT user_id, day, t.item, t.score::FLOAT AS score, (greatest(0, day * 86400 - pub_s) / 3600.0)::FLOAT AS pub_age_h, category::FLOAT AS category FROM task t JOIN items USING (item))
    SELECT user_id, day, item, score, pub_age_h, category, '{SCHEMA_HASH}' = sha256('score:float,pub_age_h:float,category:float') AS fits FROM x""")
def feature_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as floats in a fixed order, with the gate that a model asks for."""
    pool = tasks(spark, sf_dir).join(items(spark, sf_dir).select("item", "category", "pub_s"), "item")
    age = F.greatest(F.lit(0), F.col("day") * DAY - F.col("pub_s")) / F.lit(3600.0)
    x = pool.select(*GROUP, "item", F.col("score").cast("float").alias("score"), age.cast("float").alias("pub_age_h"), F.col("category").cast("float").alias("category"))
    named = ",".join(f"{n}:{t}" for n, t in x.dtypes if n in SCHEMA)
    return x.withColumn("fits", F.sha2(F.lit(named).cast("binary"), 256) == SCHEMA_HASH)


@query(f"""WITH {LOG}, {_TASKS}, x AS (SELECT user_id, day, item, score, CASE WHEN category > 1 THEN score / (category - 1.0) END AS shadow FROM task JOIN items USING (item))
    SELECT user_id, day, item, score AS active, round(shadow, 6) AS shadow, shadow IS NULL AS shadow_failed FROM x""")
def score_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An active score and a shadow one, whose faults leave a null and touch nothing else."""
    pool = tasks(spark, sf_dir).join(items(spark, sf_dir).select("item", "category"), "item")
    shadow = F.try_divide(F.col("score"), F.col("category") - F.lit(1.0))
    return pool.select(*GROUP, "item", F.col("score").alias("active"), F.round(shadow, 6).alias("shadow"), shadow.isNull().alias("shadow_failed"))


@query(f"""WITH {LOG}, {_SLOTS}, l AS (SELECT max(s) AS last FROM views) SELECT CASE WHEN explored THEN 'explored' ELSE 'ranked' END AS origin, count(*) AS places, count(DISTINCT request) AS requests FROM slots, l
    WHERE split_part(request, '-', 2)::BIGINT >= l.last // 86400 - 1 GROUP BY ALL""")
def source_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the places of the last two days' answers came from."""
    log = slots(spark, sf_dir).withColumn("day", F.substring_index("request", "-", -1).cast("long"))
    last = log.agg(F.max("day").alias("last"))  # one row
    recent = log.join(F.broadcast(last)).where("day >= last - 1")
    return recent.groupBy(F.when(F.col("explored"), "explored").otherwise("ranked").alias("origin")).agg(F.count("*").alias("places"), F.count_distinct("request").alias("requests"))


@query(f"""WITH {LOG}, x AS (SELECT event_id, s, item, value, ({AS_OF} - s) AS age FROM log WHERE s < {AS_OF})
    SELECT event_id, round(greatest(0.1, pow(0.5, floor(age / 86400) / 7.0)), 6) AS floored, round(pow(item % 10 + 1.0, -0.8), 6) AS examined, round(1 / (1 + exp(-coalesce(value, 0) / 100)), 6) AS chance,
           CASE WHEN item IS NULL THEN 'unknown' WHEN 2024 - (1940 + item % 80) < 20 THEN '10s' WHEN 2024 - (1940 + item % 80) < 30 THEN '20s' WHEN 2024 - (1940 + item % 80) < 40 THEN '30s' WHEN 2024 - (1940 + item % 80) < 50 THEN '40s'
                WHEN 2024 - (1940 + item % 80) < 60 THEN '50s' ELSE '60+' END AS band, CASE WHEN item > 0 THEN 2 / 10.0 / item END AS propensity,
           round((CASE WHEN item % 3 = 0 THEN 0.5 + 0.3 ELSE 0.5 END) * (0.01 * (item % 100)) + CASE WHEN item % 3 = 0 THEN 0 ELSE 0.3 * 0.5 END + 0.1 * exp(-age / 3600.0 / 48) + 0.1 * least(1.0, ln(1 + item::DOUBLE) / 5), 6) AS prior FROM x""")
def scalar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay by whole days, examination by place, click chance, age band, exploring propensity, and the prior score."""
    x = event_log(spark, sf_dir, until=AS_OF).withColumn("age", F.lit(AS_OF) - F.col("s"))
    long, short = F.lit(0.01) * (F.col("item") % 100), F.when(F.col("item") % 3 != 0, F.lit(0.5))
    return x.select(
        "event_id", F.round(scores.floored_decay(F.col("age"), 7, 0.1), 6).alias("floored"), F.round(scores.examination(F.col("item") % 10, F.lit(0.8)), 6).alias("examined"),
        F.round(scores.sigmoid(F.coalesce(F.col("value"), F.lit(0.0)) / 100), 6).alias("chance"), scores.age_band(1940 + F.col("item") % 80, 2024).alias("band"),
        scores.explore_propensity(2, 10, F.col("item")).alias("propensity"),
        F.round(scores.heuristic_v1((0.5, 0.3, 0.1, 0.1), long, short, F.col("age") / F.lit(3600.0), F.col("item")), 6).alias("prior"),
    )
