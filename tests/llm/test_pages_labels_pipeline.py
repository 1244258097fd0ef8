from __future__ import annotations

import hashlib
import itertools
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeria.llm import html_extract, quality, toxicity, warc_fixity
from tests.llm.test_dedup_jaccard import SCHEMA, brute, documents, norm

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div id="content"><h1>The   title</h1><p>First paragraph with <b>bo</b>ld &amp; &eacute;t&eacute;,&nbsp;long enough to be prose.<p>Second one, not closed,
 over two lines.</p><div class="ad-box">Buy now, it is cheap</div><form><input><button>Send</button> Mail us your wishes</form>
<ul><li>one point of the article</li><li>another point of it</li></ul>
<section class="comments"><article class="comment"><p>I liked this text a lot, dear author.</p></article></section></div>
<aside><p>Side text which is long enough to be prose as well, is it not.</p></aside><div class="cookie-notice">We use cookies</div>
<footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    text, kept, blocks, _ = html_extract.main_text(PAGE)
    assert text == (
        "The title First paragraph with bold & été, long enough to be prose. Second one, not closed, over two lines. "
        "one point of the article another point of it"
    )
    assert 0 < kept < blocks


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="no-comments"><p>Some text of the page, long enough.</p></body>', "Some text of the page, long enough."),
        ('<article class="post comments-open"><h1>T</h1><p>Some text.</p></article>', "T Some text."),
        ('<div title="the hidden valley"><p>Some text of the page.</p></div>', "Some text of the page."),
        ('<div class="popular-science"><p>Some text of it.</p><p>More text of it, in words.</p></div>', "Some text of it. More text of it, in words."),
        ("<p data-a=don't>It is text, said Ann's friend.</p><p>More text's here.</p>", "It is text, said Ann's friend. More text's here."),
        ("<!-->It is text. <p>More of it comes here.</p>", "It is text. More of it comes here."),
        ("<!-- <p>Not this.</p> --!><p title='a > b'>It is text, this one.</p>", "It is text, this one."),
        ('<form id="page"><nav><a>x</a></nav><article><p>Text in a form.</p></article></form>', "Text in a form."),
        ("<article><p>Text.</p><aside><p>Side text, long enough to be prose, is it not.</p></aside><p>End.</p></article>", "Text. End."),
        ('<article><p>Text.</p></article><div class="comment-list"><article class="comment"><p>I liked it, dear author.</p></article></div>', "Text."),
        ("<article><p>Text.</p><p hidden>Not seen.</p><p style='display: none'>Nor this.</p><p aria-hidden=true>Nor this.</p></article>", "Text."),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page)[0] == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>A story begins here, long before all.</p><p>Yes</p><p>It goes on here, and on, to the end.</p>", "A story begins here, long before all. Yes It goes on here, and on, to the end."),
        ("<article><h1>A</h1><p>In words, it is said.</p><ul><li><a href=x>A link text</a></li><li>point</li></ul></article>", "A In words, it is said. A link text point"),
        ("<div><a href=a>News</a></div><div><a href=b>Sport</a></div><div>Read this, now.</div><div><a href=c>Play</a></div><div><a href=d>Win</a></div>", ""),
    ],
)
def test_edges_set_labels(page, text):
    """Pages that the costs of single blocks get wrong."""
    found = html_extract.blocks(page)
    costs = html_extract.capacities(found)
    assert " ".join(x.text for x, (a, b) in zip(found, costs, strict=True) if a > b) != text
    assert html_extract.main_text(page)[0] == text
    assert html_extract.main_text(page)[3] > 0


def test_deep_pages_take_linear_time():
    for page in ("<b>" * 40_000 + "<p>x</p>" * 2000, "<div>" * 40_000 + "a<p>b" * 2000, "<span>x</div></b>" * 20_000):
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 10


def test_weights_are_fitted_to_places(spark):
    """What is short and numbered is content here; a fit learns it, from no more pages than it may."""
    item = "<article>" + "".join(f"<p>{i} {i}{i}</p>" for i in range(12)) + "</article>"
    prose = "<nav>" + "<p>Words of the menu, in a sentence that ends.</p>" * 12 + "</nav>"
    df = spark.createDataFrame([(i % 40, "u", item + prose) for i in range(80)], "page_id long, url string, html string")
    weights = html_extract.fit(df)
    digits, ended = (html_extract.LOOKS.index(x) for x in ("digits", "ended"))
    assert weights[digits] > html_extract.PRIOR[digits] + 0.5
    assert weights[ended] < html_extract.PRIOR[ended] - 0.5
    assert (html_extract.fit(df.where("false")) == html_extract.PRIOR).all()
    assert (html_extract.fit(df.withColumn("html", F.lit("<p>x</p>"))) == html_extract.PRIOR).all()


@pytest.mark.parametrize("page", ["", "plain", "<", "<p", "<!-- open", "</p></div>", "<script>x", "<a href='>'>", "\x00<p>퟿", "<p>" * 3000 + "x"])
def test_odd_pages(page):
    html_extract.main_text(page)


def test_extract_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (1, "u", PAGE), (4, "x", "<article><p>" + "word " * 200_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("blocks", F.lit(1))
    found = html_extract.extract(df).collect()
    assert len(found) == 6
    assert {x.n_chars == len(x.text) for x in found} == {True}
    assert {x.text for x in found if x.page_id in (2, 3)} == {""}
    assert [x.n_chars for x in found if x.page_id == 4] == [999_999]
    assert html_extract.extract(df.limit(0)).count() == 0


@given(st.integers(1, 7), st.data())
@settings(max_examples=200, deadline=None)
def test_minimum_cut_is_minimal(n, data):
    terminals = [(data.draw(st.integers(0, 9)), data.draw(st.integers(0, 9))) for _ in range(n)]
    edges = [(i, j, data.draw(st.integers(1, 6))) for i in range(n) for j in range(i + 1, n) if data.draw(st.booleans())]

    def cost(sides):
        return sum(b if s else a for (a, b), s in zip(terminals, sides, strict=True)) + sum(c for i, j, c in edges if sides[i] != sides[j])

    least = min(map(cost, itertools.product([False, True], repeat=n)))
    assert cost(html_extract.minimum_cut(terminals, edges)) == least


def pages(spark, n):
    rows = [(i, f"http://h/{i}", None if i % 17 == 0 else "" if i % 19 == 0 else f"<p>{i}</p>" * (i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("x")).withColumn("hash", F.lit(1))


def test_fixity_locates_damage(spark):
    archive = warc_fixity.write_archive(pages(spark, 120), shard_records=25)
    replica = warc_fixity.damaged_copy(archive)
    found = {x.page_id: x.status for x in warc_fixity.audit(archive, replica, fanout=3).collect()}
    draw = {i: int(hashlib.md5(f"damage:{i}".encode()).hexdigest()[:15], 16) % 101 for i in range(120)}
    want = {i: {7: "changed", 53: "changed", 23: "missing"}.get(draw[i], "ok") for i in range(120)}
    assert found == want
    assert {x.status for x in warc_fixity.audit(archive, archive, fanout=3).collect()} == {"ok"}
    back = {x.page_id: x.status for x in warc_fixity.audit(replica, archive, fanout=3).collect()}
    assert {i: {"missing": "added"}.get(s, s) for i, s in want.items()} == back


def test_fixity_offsets_and_roots(spark):
    archive = warc_fixity.write_archive(pages(spark, 60), shard_records=20)
    rows = sorted(archive.collect(), key=lambda x: (x.shard, x.seq))
    for shard, group in itertools.groupby(rows, lambda x: x.shard):
        at = 0
        for k, x in enumerate(group):
            assert (x.shard, x.seq, x.offset, x.length) == (shard, k, at, len(x.record))
            assert bytes(x.record).startswith(b"WARC/1.1\r\n")
            at += x.length
    tree = warc_fixity.merkle_tree(archive, fanout=4)
    assert tree.levels[-1].count() == 1
    other = warc_fixity.merkle_tree(archive.where("page_id <> 7"), fanout=4, shape=warc_fixity.extent(archive))
    assert [(x.shard, x.seq) for x in warc_fixity.differing(tree, other, 4).collect()] == [(x.shard, x.seq) for x in rows if x.page_id == 7]
    empty = warc_fixity.write_archive(pages(spark, 0))
    assert warc_fixity.audit(empty, empty).count() == 0


def test_archive_of_repeated_rows_and_null_ids(spark):
    page = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (None, "u", "c"), (None, "u", "c"), (2, None, None)]
    rows = spark.createDataFrame(page * 3, "page_id long, url string, html string").withColumn("copies", F.lit("x")).withColumn("sha", F.lit(1))
    archive = warc_fixity.write_archive(rows, shard_records=4)
    found = sorted(archive.collect(), key=lambda x: (x.shard, x.seq))
    assert sorted(str(x.page_id) for x in found) == sorted(str(x[0]) for x in page * 3)
    for _, group in itertools.groupby(found, lambda x: x.shard):
        at = 0
        for k, x in enumerate(group):
            assert (x.seq, x.offset, x.length) == (k, at, len(x.record))
            at += x.length
    assert {x.status for x in warc_fixity.audit(archive, archive, fanout=3).collect()} == {"ok"}


def corpus(spark, n=900):
    """Invented sentences; toxic ones hold an insult, groups are named in some of both, more often in toxic ones."""
    rng = random.Random(11)
    plain = [f"wort{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        if rng.random() < (0.6 if toxic else 0.15):
            words.insert(rng.randrange(len(words)), rng.choice(["muslim", "gay", "women"]))
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Drongo", "blighter,", "nitwit!", "cadness", "cadly"]))
        bad = rng.random() < 0.3
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels)
    found = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, x in found.items() if x.held_out} == set(held)
    assert sum(found[i].predicted == truth[i][2] for i in held) / len(held) > 0.97
    neutral = documents(spark, [(1, "wort1 muslim wort2"), (2, "wort1 people wort2"), (3, "wort1 christian wort2"), (4, None), (5, ""), (6, "nitwit"), (6, "wort9"), (None, "x")])
    scores = sorted((x.doc_id or 0, x.score) for x in toxicity.score(neutral, model).collect())
    by = dict(scores[1:])
    assert abs(by[1] - by[2]) < 0.05
    assert abs(by[1] - by[3]) < 0.05
    assert by[4] == by[5] < 0.5
    assert toxicity.score(neutral.limit(0), model).count() == 0
    clean = toxicity.clean_documents(neutral, model)
    assert clean.columns == neutral.columns
    assert sorted(x.text or "" for x in clean.where("doc_id = 6").collect()) == ["wort9"]


def test_counterfactual_term_lowers_the_weight_of_mentions(spark, monkeypatch):
    docs, labels, _ = corpus(spark)
    pair = documents(spark, [(1, "wort1 muslim wort2"), (2, "wort1 people wort2")])

    def gap() -> float:
        found = {x.doc_id: x.score for x in toxicity.score(pair, toxicity.fit(docs, labels)).collect()}
        return abs(found[1] - found[2])

    with_it = gap()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    assert with_it < gap()


def test_classifiers_without_labels(spark):
    docs, labels, _ = corpus(spark, 20)
    none = labels.limit(0)
    assert {x.score for x in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert quality.rate(docs, quality.fit(docs, none)).count() == 20


def test_held_out_labels_are_never_used(spark):
    docs, labels, _ = corpus(spark, 300)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    wrong = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 0).otherwise(F.col("quality")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, wrong)
    assert a.chosen.tolist() == b.chosen.tolist()
    assert a.weights.tolist() == b.weights.tolist()
    assert quality.fit(docs, labels).weights.tolist() == quality.fit(docs, wrong).weights.tolist()


def test_quality_grades(spark):
    docs, labels, truth = corpus(spark)
    model = quality.fit(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    found = {x.doc_id: x for x in quality.rate(docs, model).collect()}
    held = [t for t in truth if found[t[0]].held_out]
    assert sum(found[i].kept == bool(q) for i, q, _ in held) / len(held) > 0.97
    mean = lambda grade: sum(found[i].expected_grade for i, q, t in held if (q and 2 - t) == grade) / max(1, sum((q and 2 - t) == grade for _, q, t in held))
    assert mean(0) < mean(1) < mean(2)
    odd = documents(spark, [(1, None), (2, ""), (2, "x" * 100_000), (None, "a")])
    assert quality.rate(odd, model).count() == 4
    assert quality.rate(odd.limit(0), model).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    docs, labels, _ = corpus(spark, 200)
    rng = random.Random(2)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, rows[i][1] + " \n") for i in range(10)]
    rows += [(3000 + i, rows[i][1] + f" extra{rng.random()}") for i in range(30)] + [(4000, None), (4001, "")]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard", "source_mixing", "bpe"]
    exact = stages["exact_dedup"](spark, df, "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    assert {x.doc_id for x in exact.collect()} == {min(g)[1] for g in groups.values()}
    kept = [(x.doc_id, x.text) for x in exact.collect()]
    near = stages["ngram_jaccard"](spark, exact, "")
    assert {x.doc_id for x in near.collect()} == {i for i, (_, c) in brute(kept, 5, 80).items() if i == c}
    mixed = stages["source_mixing"](spark, near, "")
    assert exact.columns == near.columns == mixed.columns == df.columns
    tokens = stages["bpe"](spark, mixed, "")
    assert tokens.count() == mixed.count()


def test_pipeline_runs_whole(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = corpus(spark, 120)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert 0 < out.count() <= 240


def test_stages_with_clashing_columns(spark):
    """Columns named as the stages name their own, on rows that make every branch run: repeated and null ids."""
    from plumeria.llm import exact_dedup, jaccard_join, mixing

    names = ["_id", "_points", "_sha", "_set", "_copies", "_copy", "_key", "_size", "id_", "points_", "sha_", "set_", "own_set", "own_sha", "ID_", "n_points", "stays", "key", "size", "norm", "salt"]
    names = [n for k, n in enumerate(names) if n.lower() not in {x.lower() for x in names[:k]}]
    text = "one two three four five six seven"
    docs = [(1, text, "a"), (1, text, "a"), (1, text + " ", "a"), (2, text.upper(), "a"), (None, text, None), (None, "of its own kind", "b"), (3, None, "b"), (3, "another text", "b")]
    frame = spark.createDataFrame([(*d, *range(len(names))) for d in docs], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for stage, ids in ((exact_dedup.kept_documents, [1, 2, 3, 3, None]), (jaccard_join.first_of_groups, [1, 3, 3, None]), (mixing.mixed_documents, None)):
        found = stage(frame)
        assert found.columns == frame.columns
        rows = found.collect()
        assert all(tuple(r)[3:] == tuple(range(len(names))) for r in rows)
        if ids is not None:
            assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == ids
