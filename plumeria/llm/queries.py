"""The corpus operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm import bpe, html_extract, matroska, mixing, quality, token_files, toxicity, warc_fixity
from plumeria.llm.common import table
from plumeria.llm.exact_dedup import exact_dedup
from plumeria.llm.jaccard_join import jaccard_components
from plumeria.llm.line_dedup import deduped_lines
from plumeria.llm.periodic import periodic_runs
from plumeria.llm.phrases import collocations


def vocabulary() -> str:
    """The public vocabulary file that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op2_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.media_column(table(spark, sf_dir, "documents")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=0)
    return token_files.read_documents(files)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc_fixity.write_archive(table(spark, sf_dir, "pages"))
    return warc_fixity.audit(archive, warc_fixity.damaged_copy(archive))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.rate(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = deduped_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def with_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text): by a hash of its id, a tenth of the documents repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    d = d.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("words"))
    d = d.selectExpr("doc_id", "text", "words", "size(words) AS n", "h div 10 AS g")
    d = d.selectExpr("*", "CASE WHEN n > 0 THEN cast(g % n AS int) END AS a")
    d = d.selectExpr("*", "cast(1 + (n - a) div (3 + g % 8) AS int) AS p")
    again = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(1 + (n - a) div p AS int))), 1, n - a)"
    return d.selectExpr("doc_id", f"CASE WHEN n > 0 THEN concat_ws(' ', concat(slice(words, 1, a), {again})) ELSE text END AS text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_min_cut": op1_html_min_cut,
    "op2_matroska_media": op2_matroska_media,
    "op3_source_mixing": op3_source_mixing,
    "op4_token_files": op4_token_files,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_ordinal": op9_quality_ordinal,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::DOUBLE AS total,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
            FROM d GROUP BY source
        ), c AS (  -- a level is right where the targets at it, cut at their caps, give the goal
            SELECT *, 2 * total / w AS level, 1.5 * sum(total) OVER () AS goal FROM s
        ), f AS (
            SELECT a.source, a.level,
                   (any_value(a.goal) - sum(CASE WHEN b.level < a.level THEN 2 * b.total ELSE 0 END))
                   / sum(CASE WHEN b.level < a.level THEN 0 ELSE b.w END) AS fits
            FROM c a CROSS JOIN c b GROUP BY a.source, a.level
        ), t AS (
            SELECT c.source, c.total, least(2 * c.total, c.w * (SELECT min_by(fits, level) FROM f WHERE fits <= level)) AS target FROM c
        ), p AS (
            SELECT d.doc_id, d.source, d.size, t.total, t.target, round(t.target)::BIGINT AS words,
                   (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id)) - d.size)::BIGINT AS position
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), shares AS (  -- each source's part of the unit interval, the last one open
            SELECT source, least(2 * total, target) AS target, round(target)::BIGINT AS words, lead(source IS NULL) OVER o IS NULL AS last,
                   coalesce(sum(target) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS low,
                   sum(target) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () AS high
            FROM t WHERE target > 0 WINDOW o AS (ORDER BY source NULLS LAST)
        ), n AS (
            SELECT floor(sum(target) / 512)::BIGINT + 1 AS slots FROM t WHERE target > 0
        ), points AS (
            SELECT i AS slot, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u
            FROM n, unnest(range(slots)) AS r(i)
        ), dealt AS (
            SELECT slot, source, words FROM points JOIN shares ON u >= low AND (u < high OR last)
        ), late AS (
            SELECT (SELECT slots FROM n) - 1 + row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END) AS slot, source, words
            FROM shares WHERE NOT EXISTS (SELECT 1 FROM dealt WHERE dealt.source IS NOT DISTINCT FROM shares.source)
        ), ranked AS (
            SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank,
                   words // count(*) OVER (PARTITION BY source) AS least_, words % count(*) OVER (PARTITION BY source) AS more
            FROM (SELECT * FROM dealt UNION ALL SELECT * FROM late)
        ), cut AS (
            SELECT DISTINCT source, least_, more FROM ranked
        ), wanted AS (
            SELECT p.*, CASE WHEN size = 0 OR position >= words THEN NULL WHEN position < more * (least_ + 1) THEN position // (least_ + 1)
                             ELSE more + (position - more * (least_ + 1)) // least_ END AS rank
            FROM p LEFT JOIN cut ON p.source IS NOT DISTINCT FROM cut.source
        )
        SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, target,
               (greatest(0, least(position + size, words) - position)
                + greatest(0, least(position + total + size, words) - position - total))::BIGINT AS taken, slot::BIGINT AS first_slot
        FROM wanted LEFT JOIN ranked ON wanted.source IS NOT DISTINCT FROM ranked.source AND wanted.rank = ranked.rank
    """,
    "op6_warc_fixity": r"""
        WITH c AS (
            SELECT *, count(*) OVER () // 4096 + 1 AS shards FROM pages
        ), r AS (
            SELECT page_id, shards, ('0x' || substr(md5('damage:' || page_id), 1, 15))::BIGINT % 101 AS draw,
                   'WARC/1.1' || e'\r\n' || 'WARC-Type: resource' || e'\r\n' || 'WARC-Record-ID: <urn:uuid:'
                   || md5(page_id::VARCHAR)[1:8] || '-' || md5(page_id::VARCHAR)[9:12] || '-' || md5(page_id::VARCHAR)[13:16]
                   || '-' || md5(page_id::VARCHAR)[17:20] || '-' || md5(page_id::VARCHAR)[21:32] || '>' || e'\r\n'
                   || 'WARC-Target-URI: ' || coalesce(url, '') || e'\r\n' || 'Content-Type: text/html' || e'\r\n'
                   || 'Content-Length: ' || strlen(coalesce(html, '')) || e'\r\n\r\n' || coalesce(html, '') || e'\r\n\r\n' AS record
            FROM c
        ), h AS (
            SELECT *, sha256(record) AS sha, ('0x' || substr(sha256(record), 1, 15))::BIGINT % shards AS shard FROM r
        )
        SELECT page_id, shard, row_number() OVER w - 1 AS seq,
               (sum(strlen(record)) OVER w - strlen(record))::BIGINT AS offset, strlen(record) AS length,
               sha AS record_sha256,
               CASE draw WHEN 7 THEN 'changed' WHEN 53 THEN 'changed' WHEN 23 THEN 'missing' ELSE 'ok' END AS status
        FROM h WINDOW w AS (PARTITION BY shard ORDER BY page_id, sha)
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
    """,
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3
                   THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS s
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter
            FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * inter >= 90 * (p.n + q.n - inter)
        ), steps AS (
            SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links
        ), reach AS (
            SELECT doc_id AS u, doc_id AS v FROM documents
            UNION
            SELECT r.u, s.v FROM reach r JOIN steps s ON r.v = s.u
        ), least AS (
            SELECT u, min(v) AS component_id FROM reach GROUP BY u
        )
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, l.component_id
        FROM documents d JOIN least l ON l.u = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
    """,
    "op11_line_dedup": r"""
        WITH l AS (
            SELECT row, doc_id, unnest(s) AS line, unnest(range(len(s))) AS i, len(s) AS n_lines
            FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
        ), k AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), held AS (
            SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key
            HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 3
        ), j AS (
            SELECT k.*, held.key IS NOT NULL AND doc_id IS DISTINCT FROM keep AS lost FROM k LEFT JOIN held ON held.key = k.key
        )
        SELECT any_value(doc_id) AS doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM j GROUP BY row
    """,
    "op13_phrase_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), p AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
        ), g AS (
            SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]),
                   list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS phrase
            FROM p
        ), f AS (
            SELECT lang, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY lang, phrase
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(w) = 1 GROUP BY lang
        ), c AS (
            SELECT * FROM f WHERE len(w) >= 2 AND f >= 10
        ), cuts AS (
            SELECT lang, phrase, f AS a, unnest(range(1, len(w))) AS k, w FROM c
        ), scored AS (
            SELECT x.lang, x.phrase, x.a, k, l.f AS l, r.f AS r,
                   ((x.a::HUGEINT * x.a * 1000000) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[:k], ' ')
                        JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k+1:], ' ')
        ), best AS (
            SELECT lang, phrase, a, unnest(min_by({'l': l, 'r': r, 'score': score}, {'s': score, 'k': k})) FROM scored GROUP BY lang, phrase, a
        ), kept AS (
            SELECT b.* FROM best b WHERE NOT EXISTS (
                SELECT 1 FROM c WHERE len(c.w) = 3 AND c.lang = b.lang AND len(string_split(b.phrase, ' ')) = 2
                AND (array_to_string(c.w[1:2], ' ') = b.phrase OR array_to_string(c.w[2:3], ' ') = b.phrase) AND 100 * c.f >= 50 * b.a)
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
}
