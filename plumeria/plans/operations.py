"""Job runs, schedules, retention, ledgers and other operating reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeria.functions.scores import bucket, md5_number
from plumeria.operators import asof, quantiles
from plumeria.plans.features import AS_OF
from plumeria.plans.registry import LOG, query
from plumeria.sources.tables import event_log, table

HOUR, DAY = 3600, 86400
FIRST, LAST = 1_704_067_200, 1_706_659_200  # 2024-01-01 and 2024-01-31


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, job, s, status, seconds): events as job runs; an error is a failed run."""
    log = event_log(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return log.select(F.col("event_id").alias("run_id"), F.concat(F.lit("job"), (F.col("user_id") % 4).cast("string")).alias("job"), "s", status.alias("status"), F.abs(F.col("value")).alias("seconds"))


_RUNS = """runs AS (SELECT event_id AS run_id, 'job' || (user_id % 4) AS job, s, CASE event_type WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, abs(value) AS seconds FROM log)"""


def slots(spark: SparkSession, step: int = HOUR) -> DataFrame:
    """(slot): every hour of the reported window."""
    return spark.range(FIRST, LAST, step).select(F.col("id").alias("slot"))


@query(f"""WITH {LOG}, {_RUNS}, r AS (SELECT s // 3600 * 3600 AS slot, bool_or(status = 'succeeded') AS ok FROM runs WHERE job = 'job1' GROUP BY 1)
    SELECT count(*) AS slots, count(r.slot) AS started, count(*) FILTER (ok) AS succeeded FROM range({FIRST}, {LAST}, 3600) g(slot) LEFT JOIN r USING (slot)""")
def hourly_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hours of the window had a run of the job, and a good one."""
    one = runs(spark, sf_dir).where("job = 'job1'").groupBy(F.expr("s div 3600 * 3600").alias("slot")).agg(F.bool_or(F.col("status") == "succeeded").alias("ok"), F.lit(1).alias("here"))
    return slots(spark).join(one, "slot", "left").agg(F.count("*").alias("slots"), F.count("here").alias("started"), F.count_if(F.coalesce("ok", F.lit(False))).alias("succeeded"))


@query(f"""WITH {LOG}, {_RUNS}, r AS (SELECT s // 3600 * 3600 AS slot, bool_or(status = 'succeeded') AS ok FROM runs WHERE job = 'job1' GROUP BY 1),
    j AS (SELECT slot, coalesce(ok, false)::INTEGER AS ok FROM range({FIRST}, {LAST}, 3600) g(slot) LEFT JOIN r USING (slot)),
    w AS (SELECT sum(ok) OVER f AS s, count(*) OVER f AS c FROM j WINDOW f AS (ORDER BY slot ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING))
    SELECT count(*) AS windows, count(*) FILTER (s = 48) AS whole, min(s)::BIGINT AS least FROM w WHERE c = 48""")
def sliding48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 48 consecutive hours. The calendar's hours, a few thousand rows, are one window."""
    one = runs(spark, sf_dir).where("job = 'job1'").groupBy(F.expr("s div 3600 * 3600").alias("slot")).agg(F.bool_or(F.col("status") == "succeeded").alias("ok"))
    ok = slots(spark).join(one, "slot", "left").select("slot", F.coalesce("ok", F.lit(False)).cast("int").alias("ok"))
    frame = Window.orderBy("slot").rowsBetween(0, 47)
    w = ok.select(F.sum("ok").over(frame).alias("s"), F.count("*").over(frame).alias("c")).where("c = 48")
    return w.agg(F.count("*").alias("windows"), F.count_if(F.col("s") == 48).alias("whole"), F.min("s").alias("least"))


@query(f"""WITH {LOG}, {_RUNS}, g AS (SELECT job, s - lag(s) OVER (PARTITION BY job ORDER BY s, run_id) AS gap FROM runs WHERE status = 'succeeded')
    SELECT job, count(*) AS good, count(gap) AS gaps, count(*) FILTER (gap >= 3600) AS over_1h, max(gap) AS longest_s FROM g GROUP BY job""")
def gaps_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between good runs; the run before is looked up in two steps, so a job's runs are dealt over hours."""
    good = runs(spark, sf_dir).where("status = 'succeeded'")
    before = asof.last_before(good, ["job"], "s", [F.col("s"), F.col("run_id")], HOUR, F.col("s"))
    g = before.select("job", (F.col("s") - F.col("last")).alias("gap"))
    return g.groupBy("job").agg(F.count("*").alias("good"), F.count("gap").alias("gaps"), F.count_if(F.col("gap") >= HOUR).alias("over_1h"), F.max("gap").alias("longest_s"))


@query(f"""WITH {LOG}, {_RUNS} SELECT coalesce(job, '(all)') AS job, count(*) AS n, count(*) FILTER (status = 'succeeded') AS good,
        string_agg(DISTINCT status, ',' ORDER BY status) AS kinds FROM runs GROUP BY ROLLUP (job)""")
def rollup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.collect_set("status")), ",").alias("kinds")
    rolled = runs(spark, sf_dir).rollup("job").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "succeeded").alias("good"), kinds)
    return rolled.select(F.coalesce("job", F.lit("(all)")).alias("job"), "n", "good", "kinds")


@query(f"""WITH {LOG}, {_RUNS} SELECT job, round(quantile_cont(seconds, 0.5), 5) AS median, round(quantile_cont(seconds, 0.95), 5) AS p95, round(max(seconds), 5) AS longest,
        round(quantile_cont(seconds, 0.75) FILTER (s >= {AS_OF} - 604800), 5) AS recent_p75, round(quantile_cont(seconds, 0.75) FILTER (s < {AS_OF} - 604800), 5) AS before_p75
        FROM runs WHERE s < {AS_OF} GROUP BY job""")
def delay_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's percentiles over all its runs and over those of the last week and before; no task holds a job."""
    timed = runs(spark, sf_dir).where(F.col("s") < AS_OF)
    part = F.when(F.col("s") >= AS_OF - 7 * DAY, "recent").otherwise("before")
    rows = timed.select(F.explode(F.array(F.lit("all"), part)).alias("part"), "job", "seconds").select(F.concat_ws(":", "part", "job").alias("key"), "seconds")
    found = quantiles.percentiles(rows, "key", "seconds", [0.5, 0.75, 0.95]).withColumn("job", F.substring_index("key", ":", -1))
    p = lambda part, q: F.round(F.max(F.when(F.col("key").startswith(part) & (F.col("share") == q), F.col("percentile"))), 5)
    shares = found.groupBy("job").agg(p("all", 0.5).alias("median"), p("all", 0.95).alias("p95"), p("recent", 0.75).alias("recent_p75"), p("before", 0.75).alias("before_p75"))
    longest = timed.groupBy("job").agg(F.round(F.max("seconds"), 5).alias("longest"))
    return longest.join(shares, "job", "left").select("job", "median", "p95", "longest", "recent_p75", "before_p75")


@query("""WITH d AS (SELECT source, n_chars, doc_id % 4 = 0 AS recent FROM documents),
    p AS (SELECT source, count(*) FILTER (recent) AS n_recent, count(*) FILTER (NOT recent) AS n_before, quantile_cont(n_chars, 0.75) FILTER (recent) AS a, quantile_cont(n_chars, 0.75) FILTER (NOT recent) AS b FROM d GROUP BY source)
    SELECT source, n_recent, n_before, round(a / b, 6) AS ratio, (n_recent >= 5 AND n_before >= 5 AND NOT (a / b BETWEEN 0.5 AND 2)) AS drifted FROM p""")
def length_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose upper quartile of length moved by more than half or double; every fourth id is the recent part."""
    recent = F.col("doc_id") % 4 == 0
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", recent.alias("recent"))
    q = lambda c: F.percentile(F.when(c, F.col("n_chars")), F.lit(0.75))
    p = docs.groupBy("source").agg(F.count_if("recent").alias("n_recent"), F.count_if(~F.col("recent")).alias("n_before"), q(F.col("recent")).alias("a"), q(~F.col("recent")).alias("b"))
    ratio = F.col("a") / F.col("b")
    enough = (F.col("n_recent") >= 5) & (F.col("n_before") >= 5)
    return p.select("source", "n_recent", "n_before", F.round(ratio, 6).alias("ratio"), (enough & ~ratio.between(0.5, 2)).alias("drifted"))


@query(f"""WITH {LOG}, {_RUNS} SELECT job, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
        round(count(*) FILTER (status = 'failed') / count(*), 6) AS failure_ratio FROM runs GROUP BY job""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = runs(spark, sf_dir).groupBy("job").pivot("status", ["succeeded", "failed"]).count().na.fill(0)
    return wide.select("job", "succeeded", "failed", F.round(F.col("failed") / (F.col("failed") + F.col("succeeded")), 6).alias("failure_ratio"))


@query(f"""WITH {LOG}, c AS (SELECT event_id, user_id, item, count(*) OVER (PARTITION BY user_id, item ORDER BY s RANGE BETWEEN 172800 PRECEDING AND 1 PRECEDING) AS prior FROM views)
    SELECT event_id, prior, prior > 0 AS repeated, prior >= 3 AS fatigued FROM c""")
def fatigue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of an item that the user saw in the 48 hours before, and those seen three times."""
    seen = event_log(spark, sf_dir, "view")
    frame = Window.partitionBy("user_id", "item").orderBy("s").rangeBetween(-2 * DAY, -1)
    prior = seen.select("event_id", F.count("*").over(frame).alias("prior"))
    return prior.select("event_id", "prior", (F.col("prior") > 0).alias("repeated"), (F.col("prior") >= 3).alias("fatigued"))


@query("""SELECT user_id, k AS item, n FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL) WHERE n >= 3""")
def fatigued_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir, "view").groupBy("user_id", "item").agg(F.count("*").alias("n")).where("n >= 3")


@query("""WITH d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha, length(coalesce(text, '')) AS size FROM documents)
    SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha) THEN 'ok' ELSE 'duplicate' END AS status, sha AS content_sha256,
           CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha) THEN size ELSE 0 END AS content_length FROM d""")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of a body is ok, later ones are duplicates with an empty body.

    The first of each body is an aggregate that is combined before its shuffle; a join marks it, so a body with very
    many copies doesn't meet in one task.
    """
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(body.cast("binary"), 256).alias("content_sha256"), F.length(body).alias("size"))
    firsts = docs.groupBy("content_sha256").agg(F.min("doc_id").alias("first"))
    ok = F.col("doc_id") == F.col("first")
    return docs.join(firsts, "content_sha256").select("doc_id", F.when(ok, "ok").otherwise("duplicate").alias("status"), "content_sha256", F.when(ok, F.col("size")).otherwise(0).cast("long").alias("content_length"))


@query("""WITH d AS (SELECT doc_id, source, text, n_chars, doc_id % 30 AS age_days, ('0x' || substr(md5('st:' || doc_id), 1, 8))::BIGINT % 4 = 0 AS awaiting, source IN ('src1', 'src2') AS exempt FROM documents),
    t AS (SELECT *, age_days >= 14 AND NOT exempt AND (text <> '' OR NOT awaiting) AS purge FROM d)
    SELECT doc_id, purge, CASE WHEN purge THEN -1 ELSE n_chars END AS body_chars, n_chars AS kept_length, sha256(text) AS kept_sha256 FROM t""")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired bodies that aren't exempt go (shown as -1); their hash and length stay."""
    docs = table(spark, sf_dir, "documents")
    expired, exempt = F.col("doc_id") % 30 >= 14, F.col("source").isin("src1", "src2")
    awaiting = md5_number(F.lit("st"), F.col("doc_id")) % 4 == 0
    purge = expired & ~exempt & ((F.col("text") != "") | ~awaiting)
    return docs.select("doc_id", purge.alias("purge"), F.when(purge, F.lit(-1)).otherwise(F.col("n_chars")).alias("body_chars"), F.col("n_chars").alias("kept_length"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("""WITH d AS (SELECT source, doc_id % 30 AS age_days, source IN ('src1', 'src2') AS exempt, n_chars FROM documents)
    SELECT source, count(*) FILTER (age_days >= 14) AS expired, count(*) FILTER (age_days >= 14 AND NOT exempt) AS overdue, max(age_days)::BIGINT AS oldest_days FROM d GROUP BY source""")
def retention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.col("doc_id") % 30
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count_if(age >= 14).alias("expired"), F.count_if((age >= 14) & ~F.col("source").isin("src1", "src2")).alias("overdue"), F.max(age).alias("oldest_days")
    )


@query(f"""WITH {LOG}, {_RUNS}, e AS (SELECT job, slot FROM (SELECT DISTINCT job FROM runs), range({FIRST}, {LAST}, 7200) g(slot)),
    m AS (SELECT e.job, slot, count(run_id) > 0 AS started, coalesce(bool_or(status = 'succeeded'), false) AS ok FROM e LEFT JOIN runs r ON r.job = e.job AND r.s >= slot AND r.s < slot + 1200 GROUP BY e.job, slot)
    SELECT job, count(*) AS scheduled, count(*) FILTER (started) AS started, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT started) AS missed FROM m GROUP BY job""")
def schedule_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots every two hours that a run started within twenty minutes of; a run meets its slot by arithmetic."""
    step, late = 2 * HOUR, 1200
    one = runs(spark, sf_dir)
    kinds = one.select("job").distinct()
    expected = kinds.withColumn("slot", F.explode(F.sequence(F.lit(FIRST), F.lit(LAST - step), F.lit(step))))
    hits = one.withColumn("slot", F.expr(f"s div {step} * {step}")).where(F.col("s") < F.col("slot") + late)
    hits = hits.groupBy("job", F.col("slot").cast("int").alias("slot")).agg(F.bool_or(F.col("status") == "succeeded").alias("ok"), F.lit(1).alias("here"))
    return expected.join(hits, ["job", "slot"], "left").groupBy("job").agg(
        F.count("*").alias("scheduled"), F.count("here").alias("started"), F.count_if(F.coalesce("ok", F.lit(False))).alias("succeeded"), F.count_if(F.col("here").isNull()).alias("missed")
    )


@query(f"""WITH {LOG}, {_RUNS}, b AS (SELECT *, sum((status = 'succeeded')::INTEGER) OVER (PARTITION BY job ORDER BY s, run_id) AS island FROM runs),
    c AS (SELECT *, count(*) FILTER (status = 'failed') OVER (PARTITION BY job, island ORDER BY s, run_id) AS failures FROM b),
    t AS (SELECT job, min((s, run_id)) AS tripped FROM c WHERE failures >= 3 GROUP BY job)
    SELECT r.job, count(*) AS runs, count(*) FILTER ((r.s, r.run_id) > tripped) AS deferred FROM runs r LEFT JOIN t USING (job) GROUP BY r.job""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After three failures in a row a job's later runs are put off; successes begin a new count.

    Failures so far, and those at the last success, are looked up in two steps: a job's runs are dealt over hours.
    """
    one, order = runs(spark, sf_dir), [F.col("s"), F.col("run_id")]
    bad = F.col("status") == "failed"
    counted = asof.prefix_sums(one, ["job"], "s", order, HOUR, failed=bad.cast("int"))
    counted = asof.last_before(counted, ["job"], "s", order, HOUR, F.when(~bad, F.col("failed")))
    third = bad & (F.col("failed") + 1 - F.coalesce("last", F.lit(0)) >= 3)
    tripped = counted.where(third).groupBy("job").agg(F.min(F.struct("s", "run_id")).alias("t"))
    late = F.coalesce(F.struct("s", "run_id") > F.col("t"), F.lit(False))
    return one.join(tripped, "job", "left").groupBy("job").agg(F.count("*").alias("runs"), F.count_if(late).alias("deferred"))


@query("""SELECT event_type, key, count(*) AS n, sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT))::BIGINT AS total
    FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY event_type, key""")
def json_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of the events' JSON as a row."""
    pairs = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "number"))
    return pairs.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


@query(f"""WITH {LOG}, {_RUNS} SELECT job, max(s) FILTER (status = 'succeeded') AS last_good, arg_max(status, (s, run_id)) AS last_status,
        count(*) FILTER (status = 'failed' AND s >= {AS_OF} - 86400) AS failed_24h, count(*) FILTER (seconds > 50) AS slow FROM runs WHERE s < {AS_OF} GROUP BY job""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = F.col("status") == "succeeded", F.col("status") == "failed"
    return runs(spark, sf_dir).where(F.col("s") < AS_OF).groupBy("job").agg(
        F.max(F.when(good, F.col("s"))).alias("last_good"), F.max_by("status", F.struct("s", "run_id")).alias("last_status"),
        F.count_if(bad & (F.col("s") >= AS_OF - DAY)).alias("failed_24h"), F.count_if(F.col("seconds") > 50).alias("slow"),
    )


#: (from day, until day or null, nano-dollars a token).
PRICES = ((0, 9, 150), (10, 19, 120), (20, None, 90))


@query(f"""WITH {LOG}, prices(a, b, nusd) AS (VALUES (0, 9, 150), (10, 19, 120), (20, NULL, 90)), d AS (SELECT (s - {FIRST}) // 86400 AS day, abs(value)::DOUBLE AS v FROM log WHERE event_type = 'purchase')
    SELECT day, any_value(nusd)::BIGINT AS nusd, (sum(floor(v)) * any_value(nusd))::BIGINT AS cost_nusd FROM d JOIN prices ON day >= a AND (b IS NULL OR day <= b) GROUP BY day""")
def price_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs in whole nano-dollars at the price that holds on the day; usage is summed by day before it meets prices."""
    day = F.expr(f"(s - {FIRST}) div {DAY}")
    used = event_log(spark, sf_dir, "purchase").groupBy(day.alias("day")).agg(F.sum(F.floor(F.abs("value"))).alias("tokens"))
    prices = spark.createDataFrame(PRICES, "a long, b long, nusd long")
    valid = (F.col("day") >= F.col("a")) & (F.col("b").isNull() | (F.col("day") <= F.col("b")))
    return used.join(F.broadcast(prices), valid).select("day", "nusd", (F.col("tokens") * F.col("nusd")).alias("cost_nusd"))  # three prices


@query(f"""WITH {LOG}, e AS (SELECT event_id, (s - {FIRST}) // 86400 AS day, user_id AS run, (floor(abs(value)) * 1000)::BIGINT AS nusd, event_id % 3 AS kind FROM log WHERE event_type = 'purchase')
    SELECT day, coalesce(sum(nusd) FILTER (kind > 0), 0)::BIGINT AS committed, coalesce(sum(nusd) FILTER (kind = 0), 0)::BIGINT AS open, count(*) FILTER (kind = 0) AS open_count,
           sum(sum(nusd) FILTER (kind > 0)) OVER (ORDER BY day)::BIGINT AS running FROM e GROUP BY day""")
def spend_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations, of which two in three are settled, folded by day with the running total (one row a day)."""
    bought = event_log(spark, sf_dir, "purchase")
    reserved = bought.select("event_id", F.expr(f"(s - {FIRST}) div {DAY}").alias("day"), (F.floor(F.abs("value")) * 1000).alias("nusd"))
    settled = reserved.where("event_id % 3 > 0").select("event_id", F.lit(True).alias("settled"))
    folded = reserved.join(settled, "event_id", "left")
    done = F.coalesce("settled", F.lit(False))
    by_day = folded.groupBy("day").agg(F.sum(F.when(done, F.col("nusd")).otherwise(0)).alias("committed"), F.sum(F.when(done, 0).otherwise(F.col("nusd"))).alias("open"), F.count_if(~done).alias("open_count"))
    return by_day.withColumn("running", F.sum("committed").over(Window.orderBy("day")))


@query(f"""WITH {LOG} SELECT event_type AS purpose, user_id % 3 AS provider, count(*) AS calls, round(avg(value), 5) AS latency, count(*) FILTER (value < 1) AS failures FROM log GROUP BY ALL""")
def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.groupBy(F.col("event_type").alias("purpose"), (F.col("user_id") % 3).alias("provider")).agg(F.count("*").alias("calls"), F.round(F.avg("value"), 5).alias("latency"), F.count_if(F.col("value") < 1).alias("failures"))


@query(f"""WITH {LOG}, a AS (SELECT c.item, count(*) AS n, CASE WHEN user_id % 70 < 20 THEN '10s' WHEN user_id % 70 < 30 THEN '20s' WHEN user_id % 70 < 40 THEN '30s' WHEN user_id % 70 < 50 THEN '40s' WHEN user_id % 70 < 60 THEN '50s' ELSE '60+' END AS band FROM clicks c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY n DESC, item) AS place FROM a) SELECT band, place, item, n FROM r WHERE place <= 3""")
def top_by_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = bucket(F.col("user_id") % 70, [20, 30, 40, 50, 60], ["10s", "20s", "30s", "40s", "50s", "60+"])
    counts = event_log(spark, sf_dir, "click").groupBy(band.alias("band"), "item").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("n"), "item"))
    return counts.withColumn("place", place.cast("long")).where("place <= 3").select("band", "place", "item", "n")


@query(f"""WITH {LOG}, k AS (SELECT (s + 32400) // 86400 AS day, item, count(*) AS n FROM clicks GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, item) AS place FROM k)
    SELECT day, string_agg(item::VARCHAR, ',' ORDER BY place) AS items FROM r WHERE place <= 5 GROUP BY day""")
def daily_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most clicked items of each day of Seoul time, as the table that is replaced by day."""
    counts = event_log(spark, sf_dir, "click").groupBy(F.expr("(s + 32400) div 86400").alias("day"), "item").agg(F.count("*").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "item"))).where("place <= 5")
    lists = top.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("l"))
    return lists.select("day", F.array_join(F.transform("l", lambda x: x["item"].cast("string")), ",").alias("items"))


@query("""WITH known AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 10 = 0), incoming AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 10 > 0),
    f AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY sha) AS first FROM incoming)
    SELECT count(*) FILTER (first AND k.sha IS NULL) AS inserted, count(*) FILTER (NOT first OR k.sha IS NOT NULL) AS skipped FROM f LEFT JOIN known k USING (sha)""")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many incoming articles are new; the same insert again would add none."""
    from plumeria.sources.sinks import new_rows

    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    known, incoming = docs.where("doc_id % 10 = 0"), docs.where("doc_id % 10 > 0")
    inserted = new_rows(incoming, known, "sha", "doc_id").agg(F.count("*").alias("inserted"))
    return incoming.agg(F.count("*").alias("n")).join(F.broadcast(inserted)).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))  # one row each


@query(f"""WITH {LOG}, m AS (SELECT s // 3600 AS h, avg(value) FILTER (event_type = 'click') AS cpu, avg(value) FILTER (event_type = 'view') AS net FROM log GROUP BY 1)
    SELECT round(quantile_cont(cpu, 0.95), 5) AS cpu_p95, round(quantile_cont(net, 0.95), 5) AS net_p95, CASE WHEN quantile_cont(cpu, 0.95) < 20 AND quantile_cont(net, 0.95) < 20 THEN 'idle' ELSE 'busy' END AS verdict FROM m""")
def idle_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir, "click", "view").groupBy(F.expr("s div 3600").alias("h"))
    m = log.agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("cpu"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("net"))
    p = m.agg(F.percentile("cpu", F.lit(0.95)).alias("cpu"), F.percentile("net", F.lit(0.95)).alias("net"))
    return p.select(F.round("cpu", 5).alias("cpu_p95"), F.round("net", 5).alias("net_p95"), F.when((F.col("cpu") < 20) & (F.col("net") < 20), "idle").otherwise("busy").alias("verdict"))


@query(f"""WITH {LOG} SELECT day, name, sum(n)::BIGINT AS n FROM (SELECT s // 86400 AS day, 'clicks' AS name, count(*) AS n FROM clicks GROUP BY 1 UNION ALL SELECT s // 86400, 'views', count(*) FROM views GROUP BY 1) GROUP BY ALL""")
def labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of the log under their names."""
    day = F.expr("s div 86400").alias("day")
    one = lambda kind, name: event_log(spark, sf_dir, kind).groupBy(day).agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
    return one("click", "clicks").unionByName(one("view", "views")).select("day", "name", "n")


@query(f"""WITH {LOG} SELECT count(*) AS users FROM (SELECT user_id FROM clicks UNION SELECT user_id FROM views)""")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda kind: event_log(spark, sf_dir, kind).select("user_id")
    return one("click").union(one("view")).distinct().agg(F.count("*").alias("users"))


@query(f"""WITH {LOG}, p AS (SELECT user_id, item FROM clicks WHERE s < {AS_OF}), pop AS (SELECT item, count(*) AS n FROM clicks WHERE s < {AS_OF} GROUP BY item),
    pref AS (SELECT DISTINCT user_id, label AS cat FROM log JOIN embeddings ON vec_id = item WHERE event_type = 'signup'),
    u AS (SELECT DISTINCT user_id FROM log WHERE event_type = 'signup' AND user_id % 20 = 0),
    c AS (SELECT u.user_id, pop.item, n, EXISTS (SELECT 1 FROM pref f WHERE f.user_id = u.user_id AND f.cat = e.label) AS is_pref FROM u, pop JOIN embeddings e ON e.vec_id = pop.item WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = u.user_id AND p.item = pop.item)),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_pref DESC, n DESC, item) AS place FROM c)
    SELECT user_id, place, item FROM r WHERE place <= 20""")
def fallback_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of every twentieth user, as the SQL has them; ``fallback_list_every_user`` has all."""
    return fallback_list_every_user(spark, sf_dir).where("user_id % 20 = 0")


@query()
def fallback_list_every_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popular items for users with preferences: preferred kinds first, seen ones left out, twenty at most.

    Items are ranked once within their kind. Of a kind no more than the first twenty unseen can be on a list, so
    twenty and as many as the user has seen of it are offered; other kinds only where the preferred ones can't fill it.
    """
    seen = event_log(spark, sf_dir, "click", until=AS_OF).select("user_id", "item")
    kinds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("cat"))
    place = F.row_number().over(Window.partitionBy("cat").orderBy(F.desc("n"), "item"))
    pool = seen.groupBy("item").agg(F.count("*").alias("n")).join(kinds, "item").withColumn("rank", place)
    sizes = pool.groupBy(F.col("cat").alias("kind")).agg(F.max("rank").alias("size"))  # one row a kind
    met = seen.distinct().join(kinds, "item").groupBy("user_id", "cat").agg(F.count("*").alias("met"))
    signup = event_log(spark, sf_dir, "signup").where("user_id IS NOT NULL")
    prefs = signup.join(kinds, "item", "left").groupBy("user_id").agg(F.collect_set("cat").alias("cats"))
    asked = prefs.crossJoin(F.broadcast(sizes)).withColumnRenamed("user_id", "u")
    asked = asked.join(met, (F.col("u") == F.col("user_id")) & F.col("kind").eqNullSafe(F.col("cat")), "left")
    asked = asked.select(F.col("u").alias("user_id"), "kind", "size", F.coalesce("met", F.lit(0)).alias("met"), F.coalesce(F.array_contains("cats", F.col("kind")), F.lit(False)).alias("is_pref"))
    preferred = F.sum(F.when(F.col("is_pref"), F.col("size") - F.col("met")).otherwise(0)).over(Window.partitionBy("user_id"))
    asked = asked.withColumn("preferred", preferred).where("is_pref OR preferred < 20")
    ranks = F.sequence(F.lit(1), F.least("size", F.col("met") + 20).cast("int"))
    ranks = asked.select("user_id", "kind", "is_pref", F.explode(ranks).alias("place"))
    offered = ranks.join(pool, F.col("kind").eqNullSafe(F.col("cat")) & (F.col("place") == F.col("rank"))).drop("place")
    fresh = offered.join(seen.distinct(), ["user_id", "item"], "left_anti")
    order = Window.partitionBy("user_id").orderBy(F.desc("is_pref"), F.desc("n"), "item")
    return fresh.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 20").select("user_id", "place", "item")
