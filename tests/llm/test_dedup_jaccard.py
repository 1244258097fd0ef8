from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.llm import jaccard_join
from plumeria.llm.components import connected_components
from plumeria.llm.exact_dedup import exact_dedup, kept_documents
from plumeria.llm.jaccard_join import first_of_groups, jaccard_components, least_shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (id, text), with further columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumn("key", F.lit(1)).withColumn("n", F.lit("x")).withColumn("id", F.lit(2)).withColumn("component", F.lit(0))


def texts(seed: int, n: int, copies: int):
    """Texts over a small vocabulary, near copies of some, one group of many, and edge cases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(n)]
    out = [" ".join(x) for x in base]
    for x in rng.choices(base, k=copies) + [base[0] * 3] * copies:
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            y[rng.randrange(len(y))] = rng.choice(words)
        out.append(" ".join(y))
    out += ["", None, " \t\n", "a", "A  b", "a b", "x y z", out[1], out[1].upper(), out[1] + "\n", "long " * 3000, "é ü é ü 日本 語"]
    return list(enumerate(out))


def brute(rows, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_components_equal_brute_force(spark, width, percent, seed):
    rows = texts(seed, 60, 40)
    found = jaccard_components(documents(spark, rows).repartition(5), width, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute(rows, width, percent)


def test_chained_near_copies_form_one_component(spark):
    words = [f"v{i}" for i in range(120)]
    rows = [(100 + i, " ".join(words[i : i + 80])) for i in range(0, 40, 2)]
    found = jaccard_components(documents(spark, rows), 3, 90).collect()
    assert {x.component_id for x in found} == {100}


def test_least_shared_holds_for_every_linked_pair():
    """Over small universes: linked sets that aren't both linked with a smallest set share so many tokens beyond it."""
    rng = random.Random(12)
    seen = 0
    for _ in range(30_000):
        percent = rng.choice([60, 75, 80, 90])
        p = set(rng.sample(range(40), rng.randint(1, 30)))
        x = p ^ set(rng.sample(range(60), rng.randint(0, 14)))
        y = x ^ set(rng.sample(range(60), rng.randint(0, 4)))
        linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)  # noqa: E731, B023
        if min(len(x), len(y)) < len(p) or not linked(x, y) or (linked(x, p) and linked(y, p)):
            continue
        seen += 1
        shared = len((x & y) - p)
        assert shared >= least_shared(len(x), len(p), len(x & p), percent)
        assert shared >= least_shared(len(y), len(p), len(y & p), percent)
    assert seen > 200


def test_linked_sets_share_a_root():
    """Whatever the order of the contents; also for a sketch that calls everything equally common."""
    rng = np.random.default_rng(13)
    sketches = [rng.integers(0, k, 1 << jaccard_join.SKETCH_BITS, dtype=np.uint8) for k in (1, 250)]
    for trial in range(3000):
        rarity = sketches[trial % 2]
        percent = int(rng.choice([50, 80, 90, 99]))
        levels = jaccard_join.Levels(percent)
        x = np.unique(rng.integers(0, 2**64, rng.integers(1, 200), dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.05], rng.integers(0, 2**64, rng.integers(0, 6), dtype=np.uint64))))
        both = len(np.intersect1d(x, y))
        if len(y) and not np.array_equal(x, y) and 100 * both >= percent * (len(x) + len(y) - both):
            assert len(np.intersect1d(jaccard_join._roots(x, rarity, levels), jaccard_join._roots(y, rarity, levels)))


@pytest.mark.parametrize("percent", [80])
def test_hot_passage_and_large_near_copy_groups(spark, percent, monkeypatch):
    """Nodes far above LEAVES, split by rare tokens and by deep trees; no link is lost and none made up."""
    rng = random.Random(21)
    word = lambda k: f"u{rng.randrange(k)}"
    passage, base = [word(10**6) for _ in range(60)], [word(10**6) for _ in range(90)]
    rows = []
    for _ in range(70):  # around one passage, mostly not linked
        rows.append(" ".join([word(10**6) for _ in range(rng.randint(5, 30))] + passage))
    for _ in range(90):  # near copies at and below the threshold
        y = list(base)
        for _ in range(rng.randint(0, 6)):
            y[rng.randrange(len(y))] = word(40)
        rows.append(" ".join(y))
    rows = list(enumerate(rows))
    want = brute(rows, 3, percent)
    assert len({c for _, c in want.values()}) > 30
    for leaves, rounds in [(3, 0), (4, 1)]:
        monkeypatch.setattr(jaccard_join, "LEAVES", leaves)
        monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
        found = jaccard_components(documents(spark, rows), 3, percent).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == want


def test_jaccard_of_empty_repeated_and_null_rows(spark):
    assert jaccard_components(documents(spark, []), 3, 90).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (3, "")]
    found = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_components(documents(spark, rows), 3, 90).collect()), key=str)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (3, 0, 3)], key=str)


def test_first_of_groups_keeps_columns(spark):
    rows = texts(5, 30, 10)
    kept = first_of_groups(documents(spark, rows), 5, 80)
    want = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    assert {x.doc_id for x in kept.collect()} == want
    assert kept.columns == documents(spark, rows).columns


def test_connected_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 30)] + [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(30)]
    found = {x.id: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}
    for _ in range(60):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == {k: v for k, v in parent.items() if any(k in p and p[0] != p[1] for p in links)}


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def want_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("options", [{}, {"bucket_capacity": 2, "max_depth": 5}, {"key": "length(norm)"}])
def test_exact_dedup_equals_brute_force(spark, options):
    """Also with buckets that are overfull at the greatest depth, and with a bad hash that chains different texts."""
    if "key" in options:
        options = {"key": F.expr(options["key"]).cast("long")}
    rows = texts(7, 40, 20) + [(1000 + i, "same text") for i in range(50)] + [(2000, "same  text"), (2001, "sam etext\x0b\x0c")]
    found = exact_dedup(documents(spark, rows), **options).collect()
    assert {x.doc_id: (x.keep_id, x.group_size, x.text_sha256) for x in found} == want_dedup(rows)
    assert all(x.kept == (x.doc_id == x.keep_id) for x in found)
    assert len(found) == len(rows)


def test_exact_dedup_of_empty_and_repeated_rows(spark):
    ends = exact_dedup(documents(spark, [(-(2**63), "x"), (2**63 - 1, "x"), (5, "y")])).collect()
    assert {(x.doc_id, x.keep_id) for x in ends} == {(-(2**63), -(2**63)), (2**63 - 1, -(2**63)), (5, 5)}
    assert exact_dedup(documents(spark, [])).count() == 0
    found = exact_dedup(documents(spark, [(1, "x"), (1, "x"), (2, "x ")])).collect()
    assert sorted((x.doc_id, x.keep_id, x.group_size) for x in found) == [(1, 2, 3), (1, 2, 3), (2, 2, 3)]
    kept = kept_documents(documents(spark, [(1, "x"), (2, "x "), (3, None), (4, "")]))
    assert {x.doc_id for x in kept.collect()} == {2, 3}


def kept_texts(df):
    return sorted(((x.doc_id, x.text) for x in df.collect()), key=repr)


def test_kept_documents_decides_by_row(spark):
    """Null ids, a null row that is the longest of its group, and repeated ids with other texts, copies and lengths."""
    rows = [(None, "alone"), (None, "two"), (None, "two"), (None, "g r o u p"), (1, "group"), (2, "gro up")]
    rows += [(7, "copy"), (7, "copy"), (7, "other"), (7, "c o p y"), (8, "other"), (9, None), (None, " ")]
    kept = kept_texts(kept_documents(documents(spark, rows)))
    assert kept == sorted([(None, "alone"), (None, "two"), (2, "gro up"), (7, "c o p y"), (7, "other"), (9, None)], key=repr)
    found = exact_dedup(documents(spark, rows)).collect()
    assert {x.keep_id for x in found if x.doc_id in (1, 2)} == {2}


def test_first_of_groups_decides_by_row(spark):
    """A repeated id with a near copy and a unique text, near copies under one id, null ids, and texts without words."""
    rng = random.Random(8)
    fresh = lambda: [f"{rng.random()}" for _ in range(60)]
    a, b, c, d, e = (fresh() for _ in range(5))
    text = " ".join
    near = lambda x: text([*x[:-1], "changed"])
    rows = [(1, text(a)), (5, near(a)), (5, text(b)), (6, text(c)), (6, text(c)), (None, text(d)), (2, near(d)), (None, text(e)), (None, near(e)), (3, ""), (3, None), (None, "")]
    kept = kept_texts(first_of_groups(documents(spark, rows), 5, 80))
    assert len(kept) == 8
    for row in [(1, text(a)), (5, text(b)), (6, text(c)), (2, near(d)), (3, ""), (3, None), (None, "")]:
        assert kept.count(row) == 1
    assert sum(row in kept for row in [(None, text(e)), (None, near(e))]) == 1
