"""Queries that do the whole job, against brute force over small tables that are made here."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest

from plumeria.plans.catalog import QUERIES
from plumeria.plans.features import AS_OF

ITEMS, USERS = 700, 30


@pytest.fixture(scope="module")
def log():
    """(user, kind, item, second): few clicks of many items; two users have seen most of the popular ones."""
    rng = random.Random(1)
    out = [(user, "signup", rng.choice([*range(0, ITEMS, 7), ITEMS + 5]), AS_OF - 900_000) for user in range(USERS) for _ in range(2)]
    out += [(rng.randrange(USERS), "click", item, AS_OF - rng.randint(1, 800_000)) for item in range(ITEMS) for _ in range(rng.choice([1, 1, 2, 4, 9]) if item % 7 else 1)]
    out += [(user, "click", item, AS_OF - 5) for user in (3, 20) for item in range(ITEMS) if item % 9]
    return out + [(4, "click", 1, AS_OF), (5, "click", None, AS_OF - 9)]


@pytest.fixture(scope="module")
def kinds():
    """Every seventh item, all of them little clicked, is of the first kind; one has no kind."""
    return {item: None if item == 10 else item % 7 for item in range(ITEMS)}


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(2)
    return {item: [0.0] * 64 if item == 40 else [rng.gauss(0, 1) for _ in range(64)] for item in range(ITEMS)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, log, kinds, vectors):
    folder = tmp_path_factory.mktemp("whole")
    rows = [(i, u, kind, float(i), json.dumps({} if item is None else {"k": item}), s) for i, (u, kind, item, s) in enumerate(log)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, s long")
    events.selectExpr("event_id", "user_id", "event_type", "value", "props", "cast(timestamp_seconds(s) as timestamp_ntz) as ts").write.parquet(f"{folder}/events.parquet")
    rows = [(item, vectors[item], kinds[item]) for item in range(ITEMS)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def want_fallback(log, kinds):
    seen, liked, n = defaultdict(set), defaultdict(set), defaultdict(int)
    for user, kind, item, s in log:
        if kind == "signup":
            liked[user] |= {kinds[item]} - {None} if item in kinds else set()
        elif item is not None and s < AS_OF:
            seen[user].add(item)
            n[item] += 1
    ranking = sorted(n, key=lambda x: (-n[x], x))
    for user, cats in liked.items():
        fresh = [x for x in ranking if x not in seen[user]]
        ordered = [x for x in fresh if kinds[x] in cats] + [x for x in fresh if kinds[x] not in cats]
        yield from ((user, place, item) for place, item in enumerate(ordered[:20], 1))


def test_fallback_lists_of_every_user_take_the_whole_ranking(spark, tables, log, kinds):
    want = sorted(want_fallback(log, kinds))
    assert sorted(map(tuple, QUERIES["fallback_list_every_user"](spark, tables).collect())) == want
    assert sorted(map(tuple, QUERIES["fallback_list"](spark, tables).collect())) == [x for x in want if x[0] % 20 == 0]


def offer(log):
    """(item, score) of the items of two weeks in order of score."""
    import math

    published = {item: 1_704_067_200 + item * 25_200 for item in range(ITEMS)}
    n = defaultdict(int)
    for _, kind, item, s in log:
        n[item] += kind == "click" and s < AS_OF
    score = {x: round(math.exp(-(AS_OF - p) / 172_800) + math.log1p(n[x]) / 5, 9) for x, p in published.items() if AS_OF - 14 * 86_400 <= p <= AS_OF}
    return sorted(score.items(), key=lambda x: (-x[1], x[0])), published


def test_every_user_is_offered_lists(spark, tables, log, vectors):
    import numpy as np

    users = sorted({x[0] for x in log})
    assert any(u % 20 for u in users)
    offered, published = offer(log)

    pool = offered[:40]
    gain = np.array([s for _, s in pool])
    gain = (gain - gain.min()) / (gain.max() - gain.min())
    unit = np.array([vectors[x] for x, _ in pool], np.float32).astype(float)
    size = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(size > 0, size, 1)
    taken = []
    while len(taken) < 10:
        value = [-np.inf if i in taken else 0.7 * gain[i] - 0.3 * max([float(unit[i] @ unit[j]) for j in taken], default=0.0) for i in range(len(pool))]
        taken.append(int(np.argmax(value)))
    want = sorted((u, place, pool[i][0]) for u in users for place, i in enumerate(taken))
    found = QUERIES["mmr_rerank"](spark, tables).collect()
    assert sorted((x.user_id, x.place, x.item) for x in found) == want

    found = defaultdict(list)
    for x in sorted(QUERIES["round_robin_union"](spark, tables).collect(), key=lambda x: (x.user_id, x.place)):
        found[x.user_id].append((x.source, x.item))
    assert sorted(found) == users
    recent = sorted(published, key=lambda x: -published[x])
    recent = [x for x in recent if x in dict(offered)]
    for got in found.values():
        assert len(got) == len({x for _, x in got}) == 30
        assert [s for s, _ in got[:3]] == ["popular", "recent", "other"]
        assert got[0][1] == offered[0][0]
        assert got[1][1] == next(x for x in recent if x != got[0][1])

    slates = defaultdict(list)
    for x in QUERIES["exploration_slate"](spark, tables).collect():
        slates[x.user_id].append(x)
    assert sorted(slates) == users
    for slate in slates.values():
        assert sorted(x.position for x in slate) == list(range(10))
        assert sum(x.explored for x in slate) == 2
        assert len({x.item for x in slate}) == 10


def test_every_twentieth_item_is_asked_for_its_nearest(spark, tables, log, vectors):
    import numpy as np

    unit = np.array([vectors[x] for x in range(ITEMS)], np.float32).astype(float)
    size = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(size > 0, size, 1)
    near = [x for x, _ in offer(log)[0]]
    want = []
    for asked in range(0, ITEMS, 20):
        best = sorted((-round(float(unit[asked] @ unit[x]), 9), x) for x in near if x != asked)[:20]
        want += [(asked, place, x) for place, (_, x) in enumerate(best, 1)]
    found = QUERIES["knn_topk_asked"](spark, tables).collect()
    assert sorted((x.asked, x.place, x.item) for x in found) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_titles_equal_brute_force(spark, tmp_path):
    """Edits anywhere in a title, its beginning included, equal titles, short ones, and rows without a source."""
    rng = random.Random(3)
    letters = "abcdefgh é"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 8, 15, 27, 34, 39, 40, 60]))) for _ in range(40)]
    texts = base + ["", "", None]
    for x in base * 4:
        y = list(x)
        for _ in range(rng.randint(0, 7)):
            at = rng.choice([0, 1, rng.randrange(len(y) + 1)])
            y[at : at + rng.choice([0, 1, 1])] = rng.choice(["", rng.choice(letters)])
        texts.append("".join(y))
    rows = [(i, rng.choice(["s", "s", None]), x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    classes = defaultdict(list)
    for i, source, x in rows:
        classes[source, (x or "")[:40]].append(i)
    want = {(s, min(ids), len(ids), min(ids), len(ids), 100.0) for (s, _), ids in classes.items() if len(ids) > 1}
    known = list(classes.items())
    for k, ((s, x), m) in enumerate(known):
        for (r, y), n in known[k + 1 :]:
            if s == r and 100 * edits(x, y) <= 15 * max(len(x), len(y)):
                (a, n_a), (b, n_b) = sorted([(min(m), len(m)), (min(n), len(n))])
                want.add((s, a, n_a, b, n_b, round(100 * (1 - edits(x, y) / max(len(x), len(y))), 4)))
    found = [tuple(x) for x in QUERIES["near_titles"](spark, str(tmp_path)).collect()]
    assert len(want) > 60
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_whole_texts_are_read(spark, tmp_path):
    """Turns that differ after 60 characters, words after 400 characters, and titles that differ after 30."""
    import re

    rng = random.Random(5)
    turns = [(c, k, "the same beginning " * 4 + "".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 90)))) for c in range(4) for k in range(5)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    want = {}
    for (c, k, a), (d, _, b) in zip(turns, turns[1:], strict=False):
        if c == d:
            want[c, k] = round(len(pairs(a) & pairs(b)) / len(pairs(a) | pairs(b)), 6)
    assert min(want.values()) < 1
    assert {(x.conv_id, x.turn): x.jaccard for x in QUERIES["char_ngram_jaccard"](spark, str(tmp_path)).collect()} == want

    title = "a long title of one press, the "
    docs = [(i, "s", f"{title}{i % 4 and i}th\n" + "short " * 90 + ("\nbelated" if i % 3 else " remote") + ("\tsecondly" if i < 9 else "")) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n, k = defaultdict(int), defaultdict(int)
    for _, _, x in docs:
        k[re.sub("[^a-z0-9]+", " ", x.split("\n")[0].lower()).strip()] += 1
        for word in {w for w in re.split(r"\s+", x.lower()) if len(w) >= 6}:
            n[word] += 1
    best = sorted(n, key=lambda w: (-n[w], -len(w), w))[:3]
    assert "belated" in best
    found = QUERIES["document_terms"](spark, str(tmp_path)).collect()
    assert sorted((x.place, x.term, x.coverage) for x in found) == [(i, w, round(n[w] / 20, 6)) for i, w in enumerate(best, 1)]
    found = QUERIES["first_line_ratio"](spark, str(tmp_path)).collect()
    assert [(x.source, x.top_share, x.titles) for x in found] == [("s", max(k.values()) / 20, 20)]


def test_no_window_holds_all_runs_of_a_job(spark, tmp_path):
    """Gaps, and a breaker whose failures lie in several hours, from plans whose windows over rows go by hour."""
    rng = random.Random(6)
    rows = [(i, rng.randrange(8), rng.choice(["error", "click", "click"]), 1.0, "{}", 1_704_067_200 + rng.randint(0, 90_000)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, s long")
    events.selectExpr("event_id", "user_id", "event_type", "value", "props", "cast(timestamp_seconds(s) as timestamp_ntz) as ts").write.parquet(f"{tmp_path}/events.parquet")
    gaps, broken = [], []
    for job in range(4):
        mine = sorted((s, i, kind == "error") for i, user, kind, _, _, s in rows if user % 4 == job)
        good = [s for s, _, bad in mine if not bad]
        between = [b - a for a, b in zip(good, good[1:], strict=False)]
        gaps.append((f"job{job}", len(good), len(between), sum(x >= 3600 for x in between), max(between)))
        third = [k for k in range(2, len(mine)) if all(x[2] for x in mine[k - 2 : k + 1])]
        broken.append((f"job{job}", len(mine), len(mine) - 1 - third[0] if third else 0))
    assert any(x[2] for x in broken)
    for name, want in (("gaps_lag", gaps), ("circuit_breaker", broken)):
        found = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_bucket" in line for line in windows)
