"""A quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

One weight vector, shared by all grades, gives a document's place on a line; ordered thresholds cut the line into
grades, so P(grade <= k) = 1 / (1 + exp(place - threshold_k)). The expected grade orders documents, and the tail
probability P(grade >= least) selects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.labelled import held_out, training_rows
from plumeria.llm.words import column_bytes, mix, slices, span_hash, words

#: Labelled documents that are learned from, at most, and hashed features.
SAMPLE, SIZE = 8_000, 1 << 12
RIDGE = 0.05
#: The least grade of a document that is kept, and the least probability of it.
LEAST_GRADE, LEAST_PROBABILITY = 1, 0.3

_KIND = np.zeros(256, np.uint8)  # how a byte looks: letter, capital, digit, beyond ASCII, or the mark itself
_KIND[33:127] = np.arange(33, 127)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, feature, value) of all texts, each feature of a text once.

    The features are words (present or not), and the look of words: how they begin, end and go on, by the share of the
    text's words that look so, and the share of words that came before in the text. Every value is bounded, whatever
    the text's length.
    """
    n = len(offsets) - 1
    which, bucket, kind, word_of, hashed = ([np.empty(0, np.int64)] for _ in range(5))
    for sums, begins, ends, at in words(data, offsets):
        text = np.searchsorted(offsets, begins + at, "right") - 1
        name = span_hash(sums, begins, ends)
        first, last = _KIND[data[begins + at]], _KIND[data[ends + (at - 1)]]
        middle = _KIND[data[np.minimum(begins + 1, ends - 1) + at]]
        before = _KIND[data[np.maximum(ends - 2, begins) + at]]
        look = first.astype(np.uint64) << np.uint64(24) | middle.astype(np.uint64) << np.uint64(16) | before.astype(np.uint64) << np.uint64(8) | last
        for values, tag in ((look, 1), (np.uint64(1) + last, 2), (name, 3)):
            which.append(text)
            bucket.append((mix(values + np.uint64(tag << 40)) % np.uint64(SIZE - 2)).astype(np.int64))
            kind.append(np.full(len(text), tag))
        word_of.append(text)
        hashed.append(name.view(np.int64))
    which, bucket, kind = (np.concatenate(x) for x in (which, bucket, kind))
    word_of, hashed = np.concatenate(word_of), np.concatenate(hashed)
    counts = np.bincount(word_of, minlength=n).astype(float)
    key = (which * 4 + kind) * SIZE + bucket
    keys, many = np.unique(key, return_counts=True)
    which, kind, bucket = keys // (4 * SIZE), keys // SIZE % 4, keys % SIZE
    share = many / counts[which]
    value = np.where(kind == 3, 1 / np.sqrt(1 + np.minimum(counts[which], 400)), 3 * share)
    order = np.lexsort((hashed, word_of))
    again = np.zeros(len(order), bool)
    again[1:] = (word_of[order][1:] == word_of[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
    repeated = np.bincount(word_of[order], again, n) / np.maximum(counts, 1)
    texts = np.arange(n)
    which = np.concatenate((which, texts, texts))
    bucket = np.concatenate((bucket, np.full(n, SIZE - 2), np.full(n, SIZE - 1)))
    value = np.concatenate((value, 3 * repeated, 1 / (1 + counts)))
    return which, bucket, value


@dataclass
class QualityModel:
    """Weights by feature, and ascending thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        which, bucket, value = features(*column_bytes(batch.column(0)))
        order = np.argsort(which, kind="stable")
        ends = pa.array(np.searchsorted(which[order], np.arange(batch.num_rows + 1)).astype(np.int32))
        buckets = pa.ListArray.from_arrays(ends, pa.array(bucket[order].astype(np.int16)))
        values = pa.ListArray.from_arrays(ends, pa.array(value[order].astype(np.float32)))
        yield pa.RecordBatch.from_arrays([batch.column(1), buckets, values], names=["label", "buckets", "values"])


def fit(
    docs: DataFrame, labels: DataFrame, grade=None, grades: int = 3, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE
) -> QualityModel:
    """Learn from at most ``sample`` rated documents that aren't held out.

    ``grade`` is a column over ``labels`` with 0 .. grades-1; by default 0 is bad quality, 1 good but toxic, 2 good.
    The driver receives the sample's features, a few hundred numbers a document.
    """
    if grade is None:
        grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    rows = training_rows(docs, labels, grade, sample, text, doc_id)
    table = rows.mapInArrow(_rows, "label int, buckets array<smallint>, values array<float>").toArrow()
    label = table.column("label").to_numpy()
    parts = table.column("buckets").chunks
    lengths = np.concatenate([np.empty(0, np.int64), *(np.diff(x.offsets.to_numpy()) for x in parts)])
    bucket = np.concatenate([np.empty(0, np.int64), *(x.flatten().to_numpy() for x in parts)])
    value = np.concatenate([np.empty(0), *(x.flatten().to_numpy() for x in table.column("values").chunks)])
    return _solve(np.repeat(np.arange(len(label)), lengths.astype(np.int64)), bucket, value, label.astype(np.int64), grades)


def _solve(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray, grades: int, steps: int = 400) -> QualityModel:
    """Weights and thresholds of the greatest likelihood with a ridge, by Adam steps over all rows.

    The thresholds are the first one and positive gaps, whose logarithms are fitted, so they stay in order.
    """
    n = len(label)
    below = np.array([(np.count_nonzero(label <= k) + 1) / (n + 2) for k in range(grades - 1)])
    start = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    theta = np.concatenate((np.zeros(SIZE), start[:1], gaps))
    if not n:
        return QualityModel(theta[:SIZE], start)
    first, second = np.zeros(len(theta)), np.zeros(len(theta))
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, cuts = theta[:SIZE], theta[SIZE] + np.concatenate((np.zeros(1), np.cumsum(np.exp(theta[SIZE + 1 :]))))
        place = np.bincount(row, w[bucket] * value, n)
        cumulative = 1 / (1 + np.exp(np.clip(place[:, None] - cuts, -40, 40)))
        edge = np.concatenate((np.zeros((n, 1)), cumulative, np.ones((n, 1))), axis=1)
        chance = np.maximum(edge[rows, label + 1] - edge[rows, label], 1e-12)
        slope_of = edge * (1 - edge)
        up, down = slope_of[rows, label + 1] / chance, slope_of[rows, label] / chance
        by_place = (up - down) / n
        by_cut = np.zeros((n, grades + 1))
        by_cut[rows, label + 1] -= up
        by_cut[rows, label] += down
        by_cut = by_cut[:, 1:-1].sum(axis=0) / n
        slope = np.empty(len(theta))
        slope[:SIZE] = np.bincount(bucket, value * by_place[row], SIZE) + 2 * RIDGE * w / n
        slope[SIZE] = by_cut.sum()
        slope[SIZE + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(theta[SIZE + 1 :])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return QualityModel(theta[:SIZE], theta[SIZE] + np.concatenate((np.zeros(1), np.cumsum(np.exp(theta[SIZE + 1 :])))))


def rate(
    docs: DataFrame,
    model: QualityModel,
    least: int = LEAST_GRADE,
    probability: float = LEAST_PROBABILITY,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept) of every row of ``docs``.

    tail_probability is P(grade >= least); a document is kept from ``probability`` on. A null text counts as empty;
    empty texts are rated as such. Null and repeated doc_ids are kept, an empty table gives an empty result, and other
    columns are ignored, whatever their names.
    """
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            which, bucket, value = features(*column_bytes(batch.column(1)))
            place = np.bincount(which, weights[bucket] * value, batch.num_rows)
            above = 1 - 1 / (1 + np.exp(np.clip(place[:, None] - thresholds, -40, 40)))
            columns = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, least - 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rated = rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return rated.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= probability).alias("kept")
    )
