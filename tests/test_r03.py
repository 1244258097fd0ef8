"""Findings of the third round, each on a small table that failed before."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumeria.functions import text
from plumeria.operators import boosting, nearest, pairwise, shingles
from plumeria.operators import feature_matrix as matrix
from plumeria.plans import text as plans
from plumeria.plans.catalog import ORACLE_SQL, QUERIES
from tests.test_whole import edits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_sql(name, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con.execute(ORACLE_SQL[name]).fetchall()


def test_export_checksums_pass_63_bits(spark, tmp_path):
    """100,000 rows of one line whose 48-bit hash is large; sums of few rows stay as they were."""
    i = next(i for i in range(10_000) if hashlib.md5(f"{i}|en|s|1|x".encode()).hexdigest() > "fe")
    h = int(hashlib.md5(f"{i}|en|s|1|x".encode()).hexdigest()[:12], 16)
    many = spark.range(100_000).selectExpr(f"{i}L AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    few = spark.createDataFrame([(1, "y", "en", "t", 1), (2, None, None, None, 0)], DOCS)
    many.unionByName(few).write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.source: (x.rows_, x.checksum) for x in QUERIES["export_integrity"](spark, str(tmp_path)).collect()}
    one, two = (int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in ("1|en|t|1|y", "2|||0|"))
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    assert 100_000 * h >= 1 << 63
    assert found == {"s": (100_000, signed(100_000 * h)), "t": (1, one), None: (1, two), "TRAILER": (100_002, signed(100_000 * h + one + two))}


def test_export_of_no_rows_has_a_trailer(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["export_integrity"](spark, str(tmp_path))
    assert [tuple(x) for x in found.collect()] == [("TRAILER", 0, None)] == by_sql("export_integrity", documents=f"{tmp_path}/documents.parquet")
    assert dict(found.dtypes)["checksum"] == "bigint"


def test_titles_differ_by_bytes_as_in_sql(spark, tmp_path):
    """Accents and Hangul: two or three bytes an edit, so some pairs are no pairs."""
    base = "the same beginning of one of the titles "
    texts = [base, base.replace("of one", "öf öne"), base.replace("o", "ó"), base.replace("titles", "títlés"), base.replace("titles", "tít한é"), base.replace("one", "two"), "é" * 40, "é" * 38 + "e", "", None]
    spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = by_sql("near_dup_titles", documents=f"{tmp_path}/documents.parquet")
    assert len(want) >= 4
    assert sorted(map(tuple, QUERIES["near_dup_titles"](spark, str(tmp_path)).collect())) == sorted(want)


def test_votes_of_nearest_with_copies_and_nulls(spark, tmp_path):
    """Copies that tie by the hundred, products that tie when rounded, null vectors; tiles of a few rows."""
    rng = random.Random(4)
    hot = [rng.gauss(0, 1) for _ in range(64)]
    rows = []
    for i in range(600):
        vec = hot if i % 3 == 0 else [x + 1e-11 * rng.random() for x in hot] if i % 50 == 1 else [rng.gauss(0, 1) for _ in range(64)]
        rows.append((i, None if i in (40, 77) else vec, rng.randrange(3)))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    want = by_sql("knn_vote", embeddings=f"{tmp_path}/embeddings.parquet", events=f"{tmp_path}/events.parquet")
    found = QUERIES["knn_vote"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_a_tile_gives_few_pairs_however_many_tie():
    ids, vectors = np.arange(5000), np.ones((5000, 4))
    found = list(nearest.candidates(vectors[:20], vectors, ids[:20], ids, 10, 9))
    assert sum(len(i) for i, _, _ in found) == 200
    assert [j.tolist() for i, j, _ in found][0][:10] == list(range(1, 11))


def test_differences_of_many_groups_are_those_of_each(monkeypatch):
    monkeypatch.setattr(pairwise, "TOGETHER", 7)
    rng = np.random.default_rng(1)
    groups = [(rng.normal(size=(a, 3)), rng.normal(size=(b, 3))) for a, b in ((1, 4), (2, 2), (3, 5), (1, 1), (1, 6), (2, 3))]
    batch = pa.RecordBatch.from_pylist([{"positive": x.ravel().tolist(), "negative": y.ravel().tolist()} for x, y in groups])
    found = [(*d, a) for ds, weights in pairwise._differences(batch, 3, 2) for d, a in zip(ds.tolist(), weights.tolist(), strict=True)]
    want = [(*(p - q).tolist(), 1 / (len(x) * len(y))) for x, y in groups for p in x for q in y]
    assert sorted(found) == sorted(want)


def test_gradients_of_many_lists_are_those_of_each(monkeypatch):
    monkeypatch.setattr(boosting, "PAIRS", 60)
    rng = np.random.default_rng(2)
    sizes = np.array([1, 1, 3, 5, 5, 5, 5, 5, 40, 40, 300, 2], np.int32)
    labels, scores = rng.integers(0, 3, sizes.sum()).astype(float), rng.normal(size=sizes.sum()).round(1)
    want = [boosting.gradients(y, s) for y, s in zip(np.split(labels, np.cumsum(sizes)[:-1]), np.split(scores, np.cumsum(sizes)[:-1]), strict=True)]
    for found, one in zip(boosting.all_gradients(labels, scores, sizes), zip(*want, strict=True), strict=True):
        assert (found == np.concatenate(one)).all()


def test_shared_runs_are_exact_however_full_the_filter(spark, tmp_path, monkeypatch):
    """Runs over the ends of pieces, characters beyond 16 bits, repeats, short and null texts; a filter of 64 bits lets all pass."""
    rng = random.Random(6)
    known = ["".join(rng.choice("abé한😀\n") for _ in range(k)) for k in (0, 5, 15, 16, 17, 40, 90)]
    texts = [*known, None, known[5] + known[6], "xx" + known[6][20:50] + "yy" + known[6][20:50], "".join(rng.choice("ab") for _ in range(300)), known[6][1:17]]
    cut = lambda x: {x[i : i + 16] for i in range(len(x) - 15)}
    all_ = set().union(*map(cut, known))
    want = {i: len(cut(x or "") & all_) for i, x in enumerate(texts) if cut(x or "") & all_}
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    base = spark.createDataFrame([(x,) for x in [*known, None]], "text string")
    for bits in (64, 1 << 20):
        assert {x.id: x.shared for x in shingles.shared(frame, base, 16, bits).collect()} == want
    every = np.ones(8, np.uint8) * 255
    monkeypatch.setattr(shingles, "PIECE", 21)
    assert set(shingles._passed(known[6], 16, every, 64)) == set(shingles._passed(known[6], 16, None, 64)) == cut(known[6])
    points = np.frombuffer((known[6] + known[6][3:30]).encode("utf-32-le"), np.uint32)
    for n in (1, 3, 16, 21):
        h = shingles.hashes(points, n).tolist()
        assert len(h) == len(points) - n + 1
        assert len(set(h)) == len({tuple(points[i : i + n]) for i in range(len(h))})


def test_amounts_are_read_from_their_stretches_only(spark):
    """Any order of tokens, against the reading of all tokens of the text one by one."""
    rng = random.Random(7)
    parts = ["1", "2,000", "3.5", "1,2345", "7.", "$", "만", "조", "천억", "%", "%p", "%포인트", "원", "명", "bp", "b", "billion", "million", "x", ",", ".", "2024년", "3월 5일", "\n", " ", "  ", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    frame = spark.createDataFrame([(x,) for x in texts], "t string")
    whole = text._amounts(F.regexp_replace("t", text.DATE, " ; "))
    assert frame.where(text.numbers(F.col("t")) != whole).count() == 0
    assert frame.where(F.size(whole) > 1).count() > 500


def test_only_stretches_with_a_unit_or_scale_are_read(spark):
    """300,000 plain characters and 20,000 bare numbers hold 3,000 amounts, each read by itself."""
    frame = spark.range(1).selectExpr("concat(repeat('some plain words ', 20000), repeat('7 8,000 9.5; ', 7000), repeat('5% and 3만 5천 명; ', 1500)) AS t")
    found = frame.select(text.numbers(F.col("t")).alias("x")).first()["x"]
    assert [(x.value, x.unit) for x in found] == [(5.0, "%"), (35_000.0, "명")] * 1500


def test_normal_forms_are_made_a_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "HELD", 10)
    texts = ["é" * 4, None, "plain", "", "ㅎ한", "x" * 30, "ä"]
    slices = list(text._normal_slices(pa.array(texts, pa.string())))
    assert len(slices) > 1 and max(sum(len(x or "") for x in s[:-1]) for s in slices) <= 10
    assert [x for s in slices for x in s] == [None if x is None else unicodedata.normalize("NFC", x) for x in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.nfc("t").alias("n"), text.nfc_digest("t").alias("d"))
    for i, n, d in frame.collect():
        one = None if texts[i] is None else unicodedata.normalize("NFC", texts[i])
        assert n == one
        assert (d and tuple(d)) == (None if one is None else (hashlib.sha256(one.encode()).hexdigest(), one != texts[i], len(one)))


def test_a_full_bucket_costs_its_requests_no_pass_each():
    """Two users' days in four batches, one of them full, held against each request's own clicks."""
    rng = np.random.default_rng(3)
    day = matrix.DAY
    rows = []
    for key, n in ((1, 3), (2, 400)):
        for at in np.sort(rng.integers(9 * day, 11 * day, n)).tolist():
            rows.append({"side": 0, "key": key, "bucket": 10, "at": at, "kind": 0, "req": None, "vec": rng.normal(size=3).tolist(), "category": int(rng.integers(4))})
    rows += [{"side": 0, "key": k, "bucket": 10, "at": int(at), "kind": 2, "req": i, "vec": None, "category": None} for i, (k, at) in enumerate(zip(rng.integers(1, 3, 90), rng.integers(10 * day, 11 * day, 90), strict=True))]
    rows.sort(key=lambda r: (r["key"], r["at"], r["kind"]))
    types = {"side": pa.int32(), "key": pa.int64(), "bucket": pa.int64(), "at": pa.int64(), "kind": pa.int32(), "req": pa.int64(), "vec": pa.list_(pa.float64()), "category": pa.int32()}
    table = pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(types.items())))
    whole = list(matrix._whole_groups((table.slice(at, 130) for at in range(0, len(rows), 130)), ("side", "key", "bucket")))
    assert [len(set(x.column("key").to_pylist()) & {1}) for x, _ in whole].count(1) == 1 and sum(x.num_rows for x, _ in whole) == len(rows)
    lists, ints = pa.list_(pa.float64()), ("kind", "req", "key", "bucket", "at", "item", "short_n", "n", "first", "last", "tail_n")
    schema = pa.schema([*((x, pa.int64()) for x in ints), *((x, lists) for x in ("short", "decayed", "tail")), ("counts", pa.list_(pa.int64())), ("whole", pa.bool_())])
    found = [r for x, group in whole for b in matrix._user_batches(x, group, 4, matrix.Settings(), schema) for r in b.to_pylist()]
    assert [r["kind"] for r in found].count(1) == 2 and [r["kind"] for r in found].count(0) == 90
    for r in found:
        own = [x for x in rows if x["kind"] == 0 and x["key"] == r["key"] and (r["kind"] == 1 or x["at"] < r["at"])]
        if r["kind"] == 0:
            assert r["short_n"] == sum(x["at"] >= r["at"] - day for x in own)
            assert np.allclose(r["short"] or [0] * 3, sum((np.array(x["vec"]) for x in own if x["at"] >= r["at"] - day), np.zeros(3)))
        own = [x for x in own if x["at"] >= 10 * day]
        assert (r["n"] or 0) == len(own)
        if own:
            last = [x for i, x in enumerate(own) if all(b["at"] - a["at"] <= 1800 for a, b in zip(own[i:], own[i + 1 :], strict=False))]
            assert np.allclose(r["decayed"], sum(np.array(x["vec"]) * 0.5 ** ((own[-1]["at"] - x["at"]) / (7 * day)) for x in own))
            assert np.allclose(r["tail"], sum(np.array(x["vec"]) for x in last))
            assert (r["first"], r["last"], r["tail_n"], r["whole"]) == (own[0]["at"], own[-1]["at"], len(last), len(last) == len(own))
            assert r["counts"] == np.bincount([x["category"] for x in own], minlength=4).tolist()


def one_beginning(rng, n):
    """Titles of one beginning whose ends are drawn, and as many with some edits anywhere."""
    tail = lambda k: "".join(rng.choice("etaoinshrdlu é") for _ in range(k))
    base = ["All rights reserved.\n" + tail(rng.choice([13, 16, 19, 19, 19])) for _ in range(n)]
    near = []
    for x in base:
        y = list(x)
        for _ in range(rng.randint(1, 7)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.choice([0, 1, 1])] = rng.choice(["", tail(1)])
        near.append("".join(y)[:40])
    return base + near


def test_titles_of_one_beginning_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "TOGETHER", 7)
    titles = sorted(set(one_beginning(random.Random(8), 60)))
    spark.createDataFrame([(i, x, "en", None, 1) for i, x in enumerate(titles)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    alike = lambda x, y: 100 * edits(x, y) <= 15 * max(len(x), len(y))
    want = [(i, j) for i, x in enumerate(titles) for j in range(i + 1, len(titles)) if alike(x, titles[j])]
    assert len(want) > 20
    assert sorted((x.a, x.b) for x in QUERIES["near_titles"](spark, str(tmp_path)).collect()) == want


def test_few_titles_of_one_beginning_are_compared(spark):
    """No pair of d edits has more than 2 d pairs of characters apart, and nearly all others have."""
    titles = [x for x in one_beginning(random.Random(9), 80) if len(x) >= 34]
    rows = spark.createDataFrame(list(enumerate(titles)), "i int, t string").withColumn("p", text.pair_planes(F.col("t")))
    rows = rows.select("i", "t", *[F.col("p")[w].alias(f"p{w}") for w in range(text.PLANES)])
    apart = text.pairs_apart("x.p{w}", "y.p{w}", range(-6, 4))
    both = rows.alias("x").join(rows.alias("y"), F.expr("length(x.t) >= length(y.t) AND x.i <> y.i AND length(x.t) - length(y.t) <= 6"))
    found = both.select("x.i", "y.i", F.expr(f"bit_count(({apart}) & (shiftleft(1L, length(x.t) - 1) - 1))")).collect()
    exact = [(edits(titles[i], titles[j]), n) for i, j, n in found]
    assert sum(d <= 6 for d, _ in exact) > 40
    assert all(n <= 2 * d for d, n in exact if d <= 6)
    assert sum(n <= 12 for d, n in exact if d > 6) < 0.1 * len(exact)
