"""Line dedup, periodic runs and collocations against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumeria.llm import line_dedup, perfect_hash, periodic, phrases
from plumeria.llm.queries import QUERIES, with_periods

WHITE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def plain_lines(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(WHITE).translate(lower)
    held = defaultdict(set)
    for id_, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(id_)
    out = []
    for id_, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < 3 or id_ == max((d for d in held[key(x)] if d is not None), default=None)]
        out.append((id_, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def line_documents():
    rng = random.Random(3)
    common = [f"{'Ünd a common line, number ' if k % 2 else 'a line of its own sort, '}{k}" for k in range(12)]
    docs = []
    for i in range(300):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper().replace("Ü", "ü") if rng.random() < 0.2 else x]) + rng.choice(["", "\r"]) for x in rng.choices(common, k=rng.randint(0, 3))]
        lines += [f"a line that only document {i} has" for _ in range(rng.randint(0, 2))] + ["short"] * rng.randint(0, 2)
        if i % 3 == 0:
            lines.append("what a third of all documents have")
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(7, docs[7][1]), (7, "a line of its own sort, 2"), (None, docs[9][1]), (None, docs[10][1]), (900, None), (901, ""), (902, "\n\n")]
    docs += [(903, "twenty code points.."), (904, "Twenty code points.."), (905, " twenty code points.. "), (906, "nineteen points ...")]
    docs += [(907 + k, "only without ids are we three") for k in range(2)] + [(None, "only without ids are we three")]
    return docs + [(950 + k, "long " * 40_000 + "\n" + "x" * 200_000) for k in range(3)]


@pytest.mark.parametrize("bits", [line_dedup.BITS, 1 << 19])
def test_lines(spark, bits):
    docs = line_documents()
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, digest string, keep int").repartition(7)
    found = line_dedup.deduped_lines(frame, bits=bits)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_lines(docs)


def test_lines_filters_of_any_tasks(spark):
    """Whatever tasks see of the keys, those of two documents pass; one document's own repeats needn't."""
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 3000, np.uint64)
    owner = [rng.integers(0, 40, 2) for _ in keys]
    for tasks in (1, 3):
        parts = [line_dedup.Filters(1 << 19) for _ in range(tasks)]
        for d in range(40):
            own = np.array([k for k, o in zip(keys, owner, strict=True) for x in o if x == d], np.uint64)
            parts[d % tasks].add(own, np.full(len(own), d))
        state = [np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)]
        for p in parts:
            at = np.flatnonzero(p.once)
            line_dedup._merge(state, at, [p.once[at], p.twice[at]])
        place, mask = line_dedup._probes(keys, 1 << 19)
        passed = ((state[1][place] & mask) != 0).all(axis=1)
        twice = np.array([len(set(o.tolist())) == 2 for o in owner])
        assert passed[twice].all() and passed[~twice].mean() < 0.05


def test_lines_of_an_empty_table(spark):
    assert line_dedup.deduped_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        line_dedup.deduped_lines(spark.createDataFrame([], "doc_id long, text string"), least=1)


# Runs


def plain_runs(words, shortest=24, periods=3):
    """All maximal stretches of their least period, one period after another."""
    out, n = {}, len(words)
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, end = i, j + p
            if end - start >= max(shortest, periods * p) and not any(s <= start and end <= e and p % q == 0 for (s, e), q in out.items()):
                out[start, end] = p
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def random_words(rng):
    kind = rng.randrange(6)
    n = rng.choice([0, 1, 5, 23, 24, 25, 60, 200])
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        return [rng.choice("abc") for _ in range(rng.randint(0, 9))] + (unit * 40)[:n] + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    if kind == 3:
        unit = (["x"] * rng.randint(1, 30) + ["y"] * rng.randint(1, 3)) * 4
        return unit * rng.randint(1, 4)
    if kind == 4:
        a, b = ["a"], ["a", "b"]
        for _ in range(9):
            a, b = b, b + a
        return b
    return [f"w{rng.randrange(50)}" for _ in range(n)]


def test_runs_of_words():
    rng = random.Random(8)
    for shortest in (24, 3):
        texts = [random_words(rng) for _ in range(150)]
        number = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}, key=lambda w: sha(w)))}
        codes = np.array([number[w] for t in texts for w in t], np.int64)
        got = defaultdict(list)
        for t, s, n, q in zip(*(x.tolist() for x in periodic.runs(codes, np.array([len(t) for t in texts]), shortest)), strict=True):
            got[t].append((s, n, q))
        want = {i: plain_runs(t, shortest) for i, t in enumerate(texts)}
        assert dict(got) == {i: x for i, x in want.items() if x}
        assert sum(map(len, want.values())) > 100


def test_next_smaller():
    rng = np.random.default_rng(1)
    saw = np.concatenate([[0], np.arange(500, 1, -1)])
    for values in (rng.permutation(400), np.arange(300), np.arange(300)[::-1].copy(), saw, rng.permutation(1), rng.permutation(0)):
        want = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]
        assert periodic.next_smaller(values).tolist() == want


def plain_op12(id_, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(id_).encode()) if id_ is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    lost = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = sha("".join(f"{s},{length},{q}\n" for s, length, q in found))
    left = sha(" ".join(w for k, w in enumerate(words) if k not in lost))
    return (id_, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest, left)


def test_runs_query(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, rng.choice([" ", "  ", "\n", " \t"]).join(random_words(rng))) for i in range(250)]
    docs += [(5, docs[5][1]), (None, "a " * 40), (None, None), (400, None), (401, ""), (402, " \n "), (403, "é\xa0ß " * 30), (404, "w" * 100_000)]
    docs.append((405, " ".join(f"v{k % 997}" for k in range(9000))))
    docs.append((406, "begin " + "again and again " * 30_000))
    slow = {405, 406}
    spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted((tuple(x) for x in found.collect() if x.doc_id not in slow), key=repr)
    assert rows == sorted((plain_op12(*d) for d in docs if d[0] not in slow), key=repr)
    assert [(x.n_runs, x.start, x.length, x.period) for x in found.where("doc_id = 406").collect()] == [(1, 1, 90_000, 3)]
    assert [(x.n_runs, x.start, x.length, x.period) for x in found.where("doc_id = 405").collect()] == [(1, 0, 9000, 997)]
    left = periodic.periodic_runs(with_periods(spark.createDataFrame([(406, docs[-1][1])], "doc_id long, text string"))).first()
    assert left.text == "begin again and again" and left.n_words == 90_001


def test_runs_of_an_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Phrases


def plain_phrases(docs, least=10, words=3, inside=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(int), defaultdict(int)
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            own = re.findall(r"[^ \t]+", piece)
            n[lang] += len(own)
            for k in range(1, words + 1):
                for i in range(len(own) - k + 1):
                    f[lang, tuple(own[i : i + k])] += 1
    rows = defaultdict(list)
    long = {key for key, a in f.items() if a >= least and len(key[1]) > 1}
    for lang, p in long:
        a = f[lang, p]
        if any(x == lang and len(q) > len(p) and 100 * f[x, q] >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for x, q in long):
            continue
        score, cut = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], cut))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0], x[5]) for lang, own in rows.items() for i, x in enumerate(sorted(own)[:top], 1))


def phrase_documents():
    rng = random.Random(12)
    vocabulary = ["New", "york", "York", "city", "ÉTÉ", "été", "a", "the", "of", "\xa0", "x" * 300] + [f"w{k}" for k in range(40)]
    docs = []
    for i in range(160):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(3):
            own.insert(rng.randint(0, len(own)), rng.choice(["new york city", "NEW  york\tcity", "the the the the", "of a"]))
        own += [x for _ in range(4) for x in rng.choice(["w1 w2", "w3 w4 w5", "w6 été", "a w7", "w8 w1 the", "of w2 w2"]).split()]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\r\n"]) for w in own)
        docs.append((i, text, rng.choice(["en", "en", "de", None, "und", ""])))
    return docs + [(5, docs[5][1], docs[5][2]), (None, docs[6][1], "en"), (900, None, "en"), (901, "", "fr"), (902, " .,\n", "fr"), (903, "z" * 700_000 + " of a" * 120_000, "en")]


@pytest.mark.parametrize(("words", "options"), [(3, {}), (3, {"cells": 1 << 16, "round_keys": 150, "top": 30}), (4, {"least": 5, "inside": 80, "top": None}), (2, {})])
def test_phrases(spark, words, options):
    docs = phrase_documents()
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, lang string, phrase int, key string").repartition(5)
    found = phrases.collocations(frame, words=words, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
    want = plain_phrases(docs, options.get("least", 10), words, options.get("inside", 50), options.get("top", 2000) or 10**9)
    assert sorted(map(tuple, found.collect())) == want
    assert len(want) > 30


def test_phrases_scores_past_64_bits(spark):
    big = 4_000_000_000
    row = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long").select(phrases._score(*map(F.col, "alr"))).first()
    assert row[0] == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_phrases_read_texts_as_often_whatever_the_number_of_phrases(spark):
    """Far more different phrases than cells, and frequent ones than a round's keys: more are dealt out, texts are read no more often."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(1000)) + ".", rng.choice(["en", "de"])) for i in range(120)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).mapInArrow(counted, "doc_id long, text string, lang string")
    found = phrases.collocations(frame, cells=1 << 16, round_keys=500).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect()
    assert sorted(map(tuple, found)) == plain_phrases(docs)
    assert read.value == 3 * len(docs)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(spark, n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1))
    sizes, bits, stored = perfect_hash.build(keys)
    assert sorted(stored.tolist()) == keys.tolist() and sum(sizes) == 64 * len(bits)
    own = [(r["bin"], r["keys"]) for half in (keys[::2], keys[::3], keys) for batch in perfect_hash.binned(half) for r in batch.to_pylist()]
    frame = spark.createDataFrame(own, "bin long, keys binary").repartition(3)
    slots = perfect_hash.Slots(perfect_hash.shards(frame, 16).collect())
    assert sorted(slots.find(keys).tolist()) == list(range(len(keys)))
    assert (slots.find(keys + np.uint64(1)) == -1).all()
    part = perfect_hash.Slots(perfect_hash.shards(frame, 16).where("bin % 3 = 1").collect())
    held = (keys >> np.uint64(54)) % np.uint64(3) == 1
    assert ((part.find(keys) >= 0) == held).all() and len(part) == held.sum()
