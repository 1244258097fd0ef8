"""Best windows and greedy matches against versions that try everything."""

from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeria.functions import fuzzy
from plumeria.plans.catalog import QUERIES


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_window(short, text):
    if len(short) > len(text):
        short, text = text, short
    m, n = len(short), len(text)
    if not m:
        return 100.0 if not n else 0.0
    windows = [text[max(e - m, 0) : min(e, n)] for e in range(1, n + m)]
    return max(200 * common(short, x) / (m + len(x)) for x in windows)


@settings(max_examples=400, deadline=None)
@given(st.text("abcé𝔸 ", max_size=12), st.text("abcé𝔸 ", max_size=30), st.sampled_from([0.0, 60.0, 85.0]))
def test_best_window(short, text, floor):
    want = plain_window(short, text)
    assert abs(fuzzy.best_window(short, text, floor) - (want if want >= floor else 0.0)) < 1e-9


def test_long_strings_and_texts():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    short = text[41_000:41_090]
    spoilt = short[:30] + "zz" + short[32:]
    assert fuzzy.best_window(short, text, 90) == 100
    assert abs(fuzzy.best_window(spoilt, text, 90) - 200 * 88 / 180) < 2.5
    assert fuzzy.best_window("q" * 50, text, 85) == 0


def plain_greedy(one, two, least):
    sets = lambda names: [{x[i : i + 2] for i in range(len(x) - 1)} or ({x} if x else set()) for x in (y.strip() for y in names if y)]
    a, b = sets(one), sets(two)
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    used, shared = set(), 0
    for x in a:
        scores = [(len(x & y) / max(len(x | y), 1), -j) for j, y in enumerate(b) if j not in used]
        if scores and max(scores)[0] >= least and max(scores)[0] > 0:
            used.add(-max(scores)[1])
            shared += 1
    return shared / (len(a) + len(b) - shared)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc ", max_size=6), max_size=6), st.lists(st.text("abc ", max_size=6), max_size=6), st.sampled_from([0.2, 0.55, 1.0]))
def test_greedy(one, two, least):
    assert abs(fuzzy.greedy_jaccard(one, two, 2, least) - plain_greedy(one, two, least)) < 1e-12


def test_columns_with_nulls(spark):
    rows = [(["abc", None, ""], "xxabdxx", ["ab"]), (None, "a", None), (["a"], None, ["a"]), ([], "", [])]
    frame = spark.createDataFrame(rows, "a array<string>, b string, c array<string>")
    found = frame.select(fuzzy.partial_ratios(F.col("a"), F.col("b")).alias("r"), fuzzy.soft_jaccard(F.col("a"), F.col("c")).alias("s")).collect()
    assert found[0].r[1] is None and found[0].r[2] == 0 and abs(found[0].r[0] - 200 / 3) < 1e-9
    assert [x.r for x in found[1:]] == [None, None, []]
    assert [x.s for x in found] == [0.0, None, 1.0, 1.0]


def test_query(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))).capitalize()
    rows = [(9, 1, "assistant", "Alone Words"), (9, 2, "user", None), (9, 3, "assistant", "Again 'x y'"), (9, 4, "system", "Again"), (None, 1, "assistant", None)]
    for conv in range(12):
        for turn in range(6):
            text = " ".join(word() for _ in range(rng.randint(0, 12)))
            if turn % 2 and rows[-1][3]:
                last = rows[-1][3]
                text += f' "{last[2:20]}" {last[:7]}'
            rows.append((20 + conv, turn, "assistant" if turn % 2 else "user", text))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, asked = {}, {}
    names = lambda x: list(dict.fromkeys(re.findall(r"\b([A-Z][a-z]{3,})\b", x)))
    for conv, turn, role, text in rows:
        text = text or ""
        if role == "user":
            asked[conv] = text
        if role == "assistant":
            source, mine, quoted = asked.get(conv, ""), names(text), list(dict.fromkeys(a or b for a, b in re.findall("\"([^\"]+)\"|'([^']+)'", text)))
            held = [sum(plain_window(x, source) >= least for x in xs) for xs, least in ((mine, 85), (quoted, 90))]
            want[conv, turn] = (len(mine), held[0], len(quoted), held[1], round(plain_greedy(mine, names(source), 0.55), 6))
    found = {(r.conv_id, r.turn): (r.names, r.supported, r.quotes, r.quotes_supported, r.likeness) for r in QUERIES["name_support"](spark, str(tmp_path)).collect()}
    assert sum(v[3] for v in want.values()) > 10 and sum(v[1] for v in want.values()) > 20
    assert found == want
