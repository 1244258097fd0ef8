"""Judges, their choice and the confidence gate against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from plumeria.operators import judging

ROWS = "judge string, family string, made_by string, cluster long, score long, claims long, mean_score double, publishable boolean, style long, cost double, fold string"
GATE = "cluster long, passed boolean, confidence double, truth boolean, parsed boolean, n long"


def fold(cluster, folds):
    return int(hashlib.md5(f"0:{cluster}".encode()).hexdigest()[:8], 16) % folds


def kappa(a, b):
    a, b = np.array(a, bool), np.array(b, bool)
    chance = a.mean() * b.mean() + (1 - a.mean()) * (1 - b.mean())
    return None if chance >= 1 else round(float(((a == b).mean() - chance) / (1 - chance)), 9)


def ranks(x):
    return [sum(v < k for v in x) + (sum(v == k for v in x) + 1) / 2 for k in x]


def plain_metrics(rows, folds):
    out = {}
    for judge in {r[0] for r in rows if r[0]}:
        all_ = [r for r in rows if r[0] == judge and r[3] is not None and r[7] is not None]
        own = [r for r in all_ if r[1] != r[2]]
        if not own:
            continue
        passes = lambda r, rule: r[4] is not None and r[4] >= rule[0] and (r[5] or 0) <= rule[1]
        rules = [(s, c) for s in judging.SCORES for c in judging.CLAIMS]

        def best(part, rules=rules, passes=passes):
            return max(rules, key=lambda k: (-2 if not part or (v := kappa([passes(r, k) for r in part], [r[7] for r in part])) is None else v, -rules.index(k)))

        chosen = {f: best([r for r in own if fold(r[3], folds) != f]) for f in range(folds)}
        pairs = [(r[6], r[8]) for r in own if r[6] is not None and r[8] is not None]
        a, b = (np.array(ranks(k)) for k in zip(*pairs, strict=True))
        out[judge] = (
            len(own), len(all_) - len(own), kappa([passes(r, chosen[fold(r[3], folds)]) for r in own], [r[7] for r in own]), *best(own),
            float(np.corrcoef(a, b)[0, 1]) if a.std() * b.std() else None, sum(r[4] is None for r in own), sum(r[9] or 0 for r in own),
        )
    return out


@pytest.mark.parametrize("folds", [2, 3])
def test_judges(spark, folds):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        good = bool(rng.random() < 0.6)
        j = k % 4
        score = None if rng.random() < 0.05 else int(np.clip(rng.integers(1, 4) + 2 * good * (rng.random() < 0.3 * j), 1, 5))
        made = f"f{rng.integers(0, 3)}" if rng.random() > 0.05 else None
        rows.append((f"j{j}", f"f{j}", made, int(rng.integers(0, 60)), score, None if rng.random() < 0.1 else int(rng.integers(0, 9)), None if score is None else score + 0.25, good, int(rng.integers(1, 3 + good)), float(k % 7) if k % 9 else None, "x"))
    rows += [("same", "f1", "f1", 1, 3, 0, 3.0, True, 1, 1.0, "x"), ("one", "f9", "f1", 1, 3, 0, 3.0, True, 1, 1.0, "x"), ("no", "f9", "f1", 1, 3, 0, 3.0, False, 1, 0.0, "x"), (None, "f1", "f2", 1, 3, 0, 3.0, True, 1, 1.0, "x"), ("j0", "f0", "f2", None, 3, 0, 3.0, True, 1, 1.0, "x"), ("j0", "f0", "f2", 1, 3, 0, 3.0, None, 1, 1.0, "x")]
    metrics = judging.judge_metrics(spark.createDataFrame(rows, ROWS), folds=folds)
    got = {r.judge: r for r in metrics.collect()}
    want = plain_metrics(rows, folds)
    assert set(got) == set(want) == {"j0", "j1", "j2", "j3", "one", "no"}
    for judge, (n, same, oof, least, most, spearman, failures, cost) in want.items():
        r = got[judge]
        assert (r.n, r.n_same_family, r.oof_kappa, r.least_score, r.most_claims, r.failures) == (n, same, oof, least, most, failures), judge
        assert r.cost == pytest.approx(cost) and (r.spearman is None if spearman is None else r.spearman == pytest.approx(spearman))
    assert got["one"].oof_kappa == 0 and got["no"].oof_kappa is None and max(r.oof_kappa or 0 for r in got.values()) > 0.15
    families = ["f0", "f3", "other"]
    least = sorted(r.oof_kappa for r in got.values() if r.oof_kappa is not None)[-2] + 1e-6
    choice = {r.family: r for r in judging.judge_choice(metrics, families, least).collect()}
    for f in families:
        other = [r for r in got.values() if r.family != f and r.oof_kappa is not None]
        best = min(other, key=lambda r: (-r.oof_kappa, r.cost, r.judge))
        enforced = best.oof_kappa >= least
        assert (choice[f].judge, choice[f].mode, choice[f].least_score) == (best.judge, "enforce" if enforced else "shadow", best.least_score if enforced else None)
    assert {r.mode for r in choice.values()} == {"enforce", "shadow"}


def test_no_judges(spark):
    metrics = judging.judge_metrics(spark.createDataFrame([], ROWS))
    assert metrics.collect() == []
    assert [tuple(r) for r in judging.judge_choice(metrics, ["f0"], 0.1).collect()] == [("f0", None, None, "shadow", None, None)]


def plain_gate(rows, folds):
    good = [r for r in rows if None not in (r[0], r[1], r[3])]
    own = [(fold(r[0], folds), (r[2] or 0.0) if r[1] else 1 - (r[2] or 0.0), r[1], r[3]) for r in good if r[4] is not False]

    def balanced(said, truth):
        p, n = sum(truth), len(truth) - sum(truth)
        return None if not p or not n else (sum(s and t for s, t in zip(said, truth, strict=True)) / p + sum(not s and not t for s, t in zip(said, truth, strict=True)) / n) / 2

    def best(part):
        values = sorted({r[1] for r in part})
        score = {t: round(b, 9) if (b := balanced([r[1] >= t for r in part], [r[3] for r in part])) is not None else -1 for t in values}
        return max(values, key=lambda t: (score[t], -t)) if values else None

    at = {f: best([r for r in own if r[0] != f]) for f in range(folds)}
    truth = [r[3] for r in own]
    said = [at[r[0]] is not None and r[1] >= at[r[0]] for r in own]
    pos, neg = [r[1] for r in own if r[3]], [r[1] for r in own if not r[3]]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg) if pos and neg else None
    return len(own), len(good) - len(own), auc, balanced([r[2] for r in own], truth), balanced(said, truth), best(own)


@pytest.mark.parametrize("kind", ["distinct", "ties", "one truth", "one cluster"])
def test_gate(spark, kind):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        truth = bool(rng.random() < 0.5) or kind == "one truth"
        c = float(np.clip(rng.normal(0.4 + 0.3 * truth, 0.2), 0, 1))
        c = round(c, 1) if kind == "ties" else c
        passed = bool(rng.random() < 0.5)
        c = c if passed else 1 - c
        rows.append((5 if kind == "one cluster" else int(rng.integers(0, 50)), passed, None if k % 31 == 0 else c, truth, [True, None, False][min(2, k % 13)] if k % 5 == 0 else True, 1))
    rows += [(None, True, 0.5, True, True, 1), (1, None, 0.5, True, True, 1), (1, True, 0.5, None, True, 1)]
    r = judging.confidence_gate(spark.createDataFrame(rows, GATE), 0.6, 0.05).collect()[0]
    n, unparsed, auc, baseline, oof, threshold = plain_gate(rows, 2)
    assert (r.n, r.n_unparsed) == (n, unparsed) and unparsed > 0
    for got, want in ((r.auc, auc), (r.baseline, baseline), (r.oof, oof), (r.threshold, threshold)):
        assert got is None if want is None else got == pytest.approx(want, abs=1e-9)
    assert r.recommended == (auc is not None and auc >= 0.6 and oof - baseline >= 0.05)
    assert r.recommended == (kind in ("distinct", "ties"))


def test_gate_of_an_empty_table(spark):
    r = judging.confidence_gate(spark.createDataFrame([], GATE), 0.6, 0.05).collect()
    assert [tuple(x) for x in r] == [(0, 0, None, None, None, None, None, False)]


BAKED = "candidate string, item long, drafted boolean, publishable boolean, unsupported boolean, drift boolean, blocked boolean, responded int, first_try int, latency double, generation_cost double, tone_cost double, b int"


def texts(rng, name, n, good, price, unsupported=0.02):
    return [
        (name, k, bool(k % 10), bool(rng.random() < good) if k % 7 else None, bool(rng.random() < unsupported), k % 9 == 0, k % 4 == 0, 2, 2 - (k % 8 == 0), float(k % 50), price, price / 2 if k % 3 else None, 1)
        for k in range(n)
    ]


def test_bake_off(spark):
    rng = np.random.default_rng(5)
    rows = texts(rng, "dear", 400, 0.9, 3.0) + texts(rng, "alike", 400, 0.88, 1.0) + texts(rng, "worse", 400, 0.5, 0.1) + texts(rng, "wrong", 400, 1.0, 0.1, 0.5)
    rows += [("unread", 1, None, None, None, None, None, None, None, None, None, None, 1), (None, 1, *rows[0][2:]), ("dear", None, *rows[0][2:])]
    got = {r.candidate: r for r in judging.bake_off(spark.createDataFrame(rows, BAKED), 0.1, 0.3, 0.9, 60.0).collect()}
    assert set(got) == {"dear", "alike", "worse", "wrong", "unread"}
    for name in ("dear", "alike", "worse", "wrong"):
        own = [r for r in rows if r[0] == name and r[1] is not None]
        drafts, votes = [r for r in own if r[2]], [r[3] for r in own if r[3] is not None]
        block, drift = np.mean([r[6] for r in drafts]), np.mean([r[5] for r in drafts])
        cost = 100 * (np.mean([r[10] for r in own]) * (1 + block + block**2) + np.mean([r[11] or 0 for r in drafts]) * (1 + drift))
        r = got[name]
        assert (r.n, r.n_failed, r.n_labelled) == (400, 40, len(votes))
        for a, b in ((r.publishable_rate, np.mean(votes)), (r.unsupported_rate, np.mean([x[4] for x in drafts])), (r.first_try_rate, np.mean([x[8] for x in own]) / 2), (r.p95_latency, np.percentile([x[9] for x in own], 95)), (r.cost_per_100, cost)):
            assert a == pytest.approx(b)
    assert {k for k, r in got.items() if r.passes} == {"dear", "alike", "worse"} and got["unread"].unsupported_rate is None
    assert {k for k, r in got.items() if r.tied} == {"dear", "alike"} and [k for k, r in got.items() if r.winner] == ["alike"]
    top = max(("dear", "alike"), key=lambda k: got[k].publishable_rate)
    vote = {(r[0], r[1]): r[3] for r in rows}
    d = [vote[top, k] - vote["worse", k] for k in range(400) if k % 7]
    assert got["worse"].n_pairs == len(d) and got["worse"].diff == pytest.approx(np.mean(d)) and got["worse"].low > 0
    half = 1.96 * np.std(d) / len(d) ** 0.5
    assert got["worse"].low == pytest.approx(np.mean(d) - half, abs=0.03) and got["worse"].high == pytest.approx(np.mean(d) + half, abs=0.03)


def test_bake_off_without_survivors(spark):
    rows = texts(np.random.default_rng(6), "only", 30, 0.5, 1.0)
    r = judging.bake_off(spark.createDataFrame(rows + rows[:3], BAKED), 0.1, 0.3, 0.9, 1.0).collect()[0]
    assert (r.n, r.passes, r.tied, r.winner, r.diff) == (33, False, False, False, None)
    assert judging.bake_off(spark.createDataFrame([], BAKED), 0.1, 0.3, 0.9, 1.0).collect() == []
