"""Toxicity by a linear classifier over character n-grams.

Features are the n-grams inside a text's distinct words (a space stands for a
word's edge), hashed into buckets and counted as present or not. They are scaled
by naive Bayes log-count ratios; logistic regression on the scaled features gives
the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import chunks, class_sample, code_points, mix, span_hashes, worker_state

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
_SPACE = np.uint32(32)


def _word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a chunk (code points on end, where each begins) and the (text, word) pairs, once each."""
    codes, starts = code_points(texts, lower=True)
    inside = worker_state("toxicity", "word_table", _word_table)[codes]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    inner = starts[(starts > 0) & (starts < len(codes))]
    split = np.unique(inner[inside[inner] & inside[inner - 1]])
    begins, ends = np.sort(np.concatenate([begins, split])), np.sort(np.concatenate([ends, split]))
    hashes = span_hashes(mix(codes[inside].astype(np.uint64)), begins, ends)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    text = np.searchsorted(starts, begins, side="right") - 1
    pairs = np.unique(text * len(first) + word)
    lengths = (ends - begins)[first]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(begins[first], lengths)
    count = max(len(first), 1)
    return codes[index], offsets, pairs // count, pairs % count


def word_features(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (word, bucket) pairs of words: n-grams of every size, edges included."""
    count = len(offsets) - 1
    lengths = np.diff(offsets) + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    padded = np.full(at[-1], _SPACE, np.uint32)
    padded[np.arange(len(codes)) + 2 * np.repeat(np.arange(count), np.diff(offsets)) + 1] = codes
    word = np.repeat(np.arange(count), lengths)
    values = mix(padded.astype(np.uint64) + np.uint64(1))
    found_words, found = [], []
    for n in SIZES:
        if len(padded) < n:
            continue
        total = np.zeros(len(padded) - n + 1, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x100000001B3) + values[k : k + len(total)]
        whole = word[: len(total)] == word[n - 1 :]
        found.append(mix(total[whole] + np.uint64(n)) % np.uint64(BUCKETS))
        found_words.append(word[: len(total)][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_words), np.concatenate(found).astype(np.int64)


def features(texts: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (text, bucket) pairs of a chunk, once each; with ``chosen``, only buckets marked there."""
    codes, offsets, text, word = distinct_words(texts)
    owner, bucket = word_features(codes, offsets)
    if chosen is not None:
        kept = chosen[bucket]
        owner, bucket = owner[kept], bucket[kept]
        some = np.zeros(max(len(offsets) - 1, 1), bool)
        some[owner] = True
        text, word = text[some[word]], word[some[word]]
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    low, high = np.searchsorted(owner, word), np.searchsorted(owner, word, side="right")
    sizes = high - low
    index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    pairs = np.unique(np.repeat(text, sizes) * BUCKETS + bucket[index])
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Model:
    """Weights of the buckets that count (log-count ratio times fitted weight), and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1500,
    alpha: float = 1.0,
    least_ratio: float = 1.0,
    least_texts: int = 4,
    penalty: float = 1e-3,
    steps: int = 200,
) -> Model:
    """A model from ``docs`` (id, text) and ``labels`` (id, label 1 or 0).

    Other labels and ids without a text are left out. ``per_class`` bounds the
    sample: about so many texts of each class, by a hash of ``id``; their
    features are found where the texts are. Buckets whose log-count ratio lies
    within ``least_ratio`` of 0, or that fewer than ``least_texts`` texts show,
    are left out, so that long texts gather no noise. The bias is set back to
    the share of label 1 among all labels. With labels of one kind only, or
    none, every score is the same.
    """
    sizes, sample = class_sample(labels, per_class, "toxicity")
    if len(sizes) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 4.0 if 1 in sizes else -4.0)
    sample = docs.select("id", "text").join(F.broadcast(sample), "id").select("label", "text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            text, bucket = features(batch.column("text"))
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), lists], ["label", "buckets"])

    rows = sample.mapInArrow(found, "label int, buckets array<int>").toArrow().combine_chunks()
    label = rows.column("label").to_numpy().astype(np.float64)
    lists = rows.column("buckets").combine_chunks()
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    return train(row, flat, label, sizes[1] / (sizes[0] + sizes[1]), alpha, least_ratio, least_texts, penalty, steps)


def train(row, flat, label, share, alpha, least_ratio, least_texts, penalty, steps) -> Model:
    """Logistic regression on present features times their log-count ratio."""
    positive, n1 = label > 0, max(label.sum(), 1)
    n0 = max(len(label) - label.sum(), 1)
    p = np.bincount(flat[positive[row]], minlength=BUCKETS)
    q = np.bincount(flat[~positive[row]], minlength=BUCKETS)
    ratio = np.log((p + alpha) / (n1 + 2 * alpha)) - np.log((q + alpha) / (n0 + 2 * alpha))
    buckets = np.flatnonzero((np.abs(ratio) >= least_ratio) & (p + q >= least_texts))
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    used = place[flat] >= 0
    row, column = row[used], place[flat[used]]
    scale = ratio[buckets]
    weights, bias = np.zeros(len(buckets)), 0.0
    moment, speed = np.zeros(len(buckets) + 1), np.zeros(len(buckets) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, (weights * scale)[column], minlength=len(label)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        gradient = np.append(np.bincount(column, error[row], minlength=len(buckets)) * scale + penalty * weights, error.sum())
        moment, speed = 0.9 * moment + 0.1 * gradient, 0.99 * speed + 0.01 * gradient**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-10)
        weights, bias = weights - move[:-1], bias - move[-1]
    odds = share * n0 / ((1 - share) * n1)
    return Model(buckets, weights * scale, float(bias + np.log(max(odds, 1e-9))))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text)`` with the chance of label 1, ``score``.

    Null, empty and word-less texts get the score of no feature at all. Rows
    come back as often as they came in, with the columns named in ``carry``.
    """
    buckets, weights, bias = model.buckets, model.weights, model.bias

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weight = np.zeros(BUCKETS, bool), np.zeros(BUCKETS)
        chosen[buckets], weight[buckets] = True, weights
        for batch in chunks(batches):
            text, bucket = features(batch.column("text"), chosen)
            z = np.bincount(text, weight[bucket], minlength=batch.num_rows) + bias
            chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ["id", *carry]), pa.array(chance)], ["id", *carry, "score"])

    names = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("id", *carry))
    return docs.select(*dict.fromkeys(["id", *carry, "text"])).mapInArrow(scored, f"{names}, score double")
