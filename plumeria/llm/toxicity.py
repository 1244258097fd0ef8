"""A toxicity classifier with counterfactual regularisation.

A document's features are the words that it holds and their beginnings, by hash. Of a bounded sample of labelled
documents, the features that go with the label are chosen by their log-likelihood ratio, and logistic weights are
fitted to them. The loss also holds, for sentences that mention a group, the squared change of the score when the
group's term is swapped for another one or for a neutral word; so a mention by itself doesn't move the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.labelled import held_out, training_rows
from plumeria.llm.words import column_bytes, slices, span_hash, words

#: Labelled documents that are learned from, and features that are kept, at most.
SAMPLE, FEATURES = 20_000, 4096
#: The least log-likelihood ratio, and the least number of documents with the label, of a feature.
LEAST_RATIO, LEAST_DOCUMENTS = 12.0, 3
THRESHOLD = 0.7
#: Terms for groups of people that are swapped for one another, and neutral words in their place.
IDENTITY_TERMS = (
    "women men woman man girls boys gay lesbian straight queer transgender black white asian latino african european "
    "american arab indian chinese muslim christian jewish hindu buddhist atheist catholic immigrant refugee disabled "
    "blind deaf old young frauen männer femmes hommes mujeres hombres juden muslime christen juifs musulmans chrétiens "
    "judíos musulmanes cristianos"
).split()
NEUTRAL_TERMS = ("people", "person", "someone")
#: Weight of the squared score changes, and of the squared weights.
COUNTERFACTUAL, RIDGE = 1.0, 0.05
PREFIXES = (5, 6, 7, 8)

_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, feature) of the words of all texts and of their beginnings; ``keep`` marks low 20 bits to keep."""
    which, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for sums, begins, ends, at in words(data, offsets):
        for _ in range(3):  # marks around a word
            ends = ends - (_MARKS[data[ends + (at - 1)]] & (ends - begins > 1))
            begins = begins + (_MARKS[data[begins + at]] & (ends - begins > 1))
        text = np.searchsorted(offsets, begins + at, "right") - 1
        for size in (0, *PREFIXES):
            long_ = ends - begins > size
            cut = begins[long_] + size if size else ends
            hashed = span_hash(sums, begins[long_] if size else begins, cut) + np.uint64(size)
            owner = text[long_] if size else text
            if keep is not None:
                hit = keep[hashed & np.uint64(0xFFFFF)]
                hashed, owner = hashed[hit], owner[hit]
            which.append(owner)
            found.append(hashed)
    return np.concatenate(which), np.concatenate(found)


def _of_words(terms: list[str]) -> list[np.ndarray]:
    which, found = features(*column_bytes(pa.array([x.lower() for x in terms], pa.string())))
    return [np.unique(found[which == i]) for i in range(len(terms))]


def _distinct(which: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, which))
    which, found = which[order], found[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (found[1:] != found[:-1])
    return which[new], found[new]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        label = batch.column(1).to_numpy(zero_copy_only=False) > 0
        which, found = _distinct(*features(*column_bytes(batch.column(0))))
        values, place = np.unique(found, return_inverse=True)
        toxic = np.bincount(place, label[which], len(values)).astype(np.int64)
        every = np.bincount(place, minlength=len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(every), pa.array(toxic)], names=["feature", "n", "t"])


def _table(chosen: np.ndarray) -> np.ndarray:
    keep = np.zeros(1 << 20, bool)
    keep[(chosen & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return keep


def _hits(texts: pa.Array, chosen: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, place in the sorted ``chosen``) of the chosen features of each text, each once."""
    which, found = features(*column_bytes(texts), keep)
    place = np.minimum(np.searchsorted(chosen, found), max(0, len(chosen) - 1))
    hit = chosen[place] == found if len(chosen) else np.zeros(len(found), bool)
    return _distinct(which[hit], place[hit])


@dataclass
class ToxicityModel:
    """Sorted feature hashes, their weights, and the constant."""

    chosen: np.ndarray
    weights: np.ndarray
    constant: float


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from the labelled documents that aren't held out, at most ``sample`` of them.

    The tasks count features and send the driver at most ``FEATURES`` of them and, for each sampled document, which of
    these it has. Without labels every score is a half.
    """
    rows = training_rows(docs, labels, F.col("toxic"), sample, text, doc_id).withColumn("text", F.lower("text"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    n, t = float(total["n"]), float(total["t"])
    terms = _of_words([*IDENTITY_TERMS, *NEUTRAL_TERMS])
    found = np.empty(0, np.uint64)
    if 0 < t < n:
        counts = rows.mapInArrow(_counts, "feature long, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        part = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
        a, of = F.col("t").cast("double"), F.col("n").cast("double")
        ratio = 2 * (part(a, of, t / n) + part(of - a, of, 1 - t / n))
        good = counts.where((F.col("t") >= LEAST_DOCUMENTS) & (a / of > t / n)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
        best = good.orderBy(F.desc("ratio"), "feature").limit(FEATURES).select("feature").collect()
        found = np.array([x["feature"] for x in best], np.int64).view(np.uint64)
    chosen = np.unique(np.concatenate((found, *terms)))
    keep = _table(chosen)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            which, place = _hits(batch.column(0), chosen, keep)
            ends = np.searchsorted(which, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["label", "places"])

    seen = [(x["label"], x["places"]) for x in rows.mapInArrow(hits, "label int, places array<int>").collect()]
    seen.sort()
    swaps = _swaps([places for _, places in seen], [np.searchsorted(chosen, x) for x in terms])
    weights, constant = _solve([places for _, places in seen], np.array([x for x, _ in seen], float), swaps, len(chosen))
    return ToxicityModel(chosen, weights, constant)


def _swaps(documents: list[list[int]], terms: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features that a swap takes away, features that it brings): one for each pair of terms, one for each mention."""
    out = [(terms[i], terms[j]) for i in range(len(IDENTITY_TERMS)) for j in ((i + 1) % len(IDENTITY_TERMS), len(IDENTITY_TERMS) + i % len(NEUTRAL_TERMS))]
    whole = {frozenset(x.tolist()): i for i, x in enumerate(terms[: len(IDENTITY_TERMS)])}
    for number, places in enumerate(documents):
        held = set(places)
        for features_, i in whole.items():
            if features_ <= held:
                out.append((terms[i], terms[(i + 1 + number) % len(terms)]))
    return out


def _solve(
    documents: list[list[int]], label: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], size: int, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the mean logistic loss and both penalties, by Adam steps over all rows."""
    n = len(documents)
    prior = (label.sum() + 1) / (n + 2)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not 0 < label.sum() < n:
        return w, b
    row = np.repeat(np.arange(n), [len(x) for x in documents])
    column = np.array([p for x in documents for p in x], np.int64)
    pair = np.repeat(np.arange(len(swaps)), [len(a) + len(c) for a, c in swaps])
    moved = np.concatenate([np.concatenate((a, c)) for a, c in swaps])
    sign = np.concatenate([np.repeat((1.0, -1.0), (len(a), len(c))) for a, c in swaps])
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(b + np.bincount(row, w[column], n)))) - label
        change = np.bincount(pair, sign * w[moved], len(swaps))
        slope = np.bincount(column, error[row], size) / n + 2 * RIDGE * w / n
        slope += 2 * COUNTERFACTUAL / len(swaps) * np.bincount(moved, sign * change[pair], size)
        slope = np.append(slope, error.mean())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    The score lies between 0 and 1, higher where label 1 is likelier, and depends on the whole text alone; a null or
    empty text has the score of a text without chosen features. Null and repeated doc_ids are kept, an empty table
    gives an empty result, and other columns are ignored, whatever their names.
    """
    chosen, weights, constant = model.chosen, model.weights, model.constant

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _table(chosen)
        for batch in slices(batches, 1024):
            which, place = _hits(batch.column(1), chosen, keep)
            logit = constant + np.bincount(which, weights[place], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-logit)))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.col(text).cast("string")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass.

    Rows that share a doc_id are judged each by its own text.
    """
    name = "_lower"
    while name in docs.columns:
        name = f"_{name}"
    chosen, weights, constant = model.chosen, model.weights, model.constant
    columns = list(range(len(docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _table(chosen)
        for batch in slices(batches, 1024):
            which, place = _hits(batch.column(len(columns)), chosen, keep)
            logit = constant + np.bincount(which, weights[place], batch.num_rows)
            yield batch.select(columns).filter(pa.array(1 / (1 + np.exp(-logit)) < threshold))

    return docs.withColumn(name, F.lower(F.col("text").cast("string"))).mapInArrow(run, docs.schema)
