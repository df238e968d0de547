"""Quality by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text
is compressed with each, block by block, so that a long text leans on the
dictionaries to its end; the normalised difference of the two sizes, with the
compression ratio and the length, is calibrated to the chance of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import chunks, class_sample, utf8

DICTIONARY_BYTES = 1 << 16
BLOCK_BYTES = 1024
LEVEL = 2
_SAMPLE_BYTES = 2048


@dataclass
class Model:
    """Two dictionaries, and the scaling and weights of the calibration (bias last)."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def train_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts; where they are too few to train one, their own bytes."""
    samples = [t[i : i + _SAMPLE_BYTES] for t in texts for i in range(0, len(t), _SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def measures(texts: pa.Array, good: bytes, bad: bytes) -> np.ndarray:
    """Per text: size difference, ratio and log length, with their products."""
    data, offsets = utf8(texts)
    view = memoryview(data.tobytes())
    with_good, with_bad = _compressor(good), _compressor(bad)
    sizes = np.empty((len(texts), 2))
    for i in range(len(texts)):
        start, stop = int(offsets[i]), int(offsets[i + 1])
        blocks = [view[k : min(k + BLOCK_BYTES, stop)] for k in range(start, max(stop, start + 1), BLOCK_BYTES)]
        sizes[i] = sum(len(with_good.compress(b)) for b in blocks), sum(len(with_bad.compress(b)) for b in blocks)
    length = np.diff(offsets)
    total = sizes.sum(axis=1)
    d = (sizes[:, 1] - sizes[:, 0]) / total
    ratio = np.minimum(total / 2 / np.maximum(length, 1), 2.0)
    long = np.log1p(length)
    return np.stack([d, ratio, np.minimum(ratio, 1) ** 2, long, d * long, ratio * long, d * d], axis=1)


def calibrate(values: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by damped Newton steps."""
    centre, spread = values.mean(axis=0), values.std(axis=0) + 1e-9
    x = np.column_stack([(values - centre) / spread, np.ones(len(values))])
    ridge = 1e-2 * np.eye(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - label * z) + w @ ridge @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - label)) + ridge @ w
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        step = 1.0
        while step > 1e-4 and loss(w - step * move) > loss(w):
            step /= 2
        w = w - step * move
        if np.abs(step * move).max() < 1e-6:
            break
    return centre, spread, w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1600, longest: int = 32_768) -> Model:
    """A model from ``docs`` (id, text) and ``labels`` (id, label 1 or 0).

    Other labels and ids without a text are left out. ``per_class`` bounds the
    sample, by a hash of ``id``: half of it makes the dictionaries (texts of up
    to ``longest`` bytes, so that the driver's share is bounded too), the other
    half, compressed where it is, the calibration, weighted back to the share
    of the classes. Labels of one kind only, or none, give the same score
    everywhere.
    """
    sizes, sample = class_sample(labels, per_class, "quality")
    if len(sizes) < 2:
        none = np.zeros(7)
        return Model(b"", b"", none, none + 1, np.append(none, 4.0 if 1 in sizes else -4.0))
    sample = docs.select("id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "id")
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0
    read = sample.where(half & (F.octet_length("text") <= longest)).select("label", "text").collect()
    good = train_dictionary([r.text.encode() for r in read if r.label == 1])
    bad = train_dictionary([r.text.encode() for r in read if r.label == 0])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = measures(batch.column("text"), good, bad).tolist()
            columns = [batch.column("label").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "x"])

    rows = sample.where(~half).select("label", "text").mapInArrow(measured, "label int, x array<double>").collect()
    if not rows:
        rows = sample.select("label", "text").mapInArrow(measured, "label int, x array<double>").collect()
    if not rows:
        none = np.zeros(7)
        return Model(good, bad, none, none + 1, np.append(none, np.log(sizes[1] / sizes[0])))
    label = np.array([r.label for r in rows], float)
    weight = np.where(label > 0, sizes[1] / max(label.sum(), 1), sizes[0] / max((1 - label).sum(), 1))
    return Model(good, bad, *calibrate(np.array([r.x for r in rows]), label, weight * len(label) / weight.sum()))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text)`` with the chance of label 1, ``score``.

    Null counts as the empty text, which has a score of its own. Rows come back
    as often as they came in, with the columns named in ``carry``.
    """
    good, bad, centre, spread, weights = model.good, model.bad, model.centre, model.spread, model.weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = (measures(batch.column("text"), good, bad) - centre) / spread
            chance = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ["id", *carry]), pa.array(chance)], ["id", *carry, "score"])

    names = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("id", *carry))
    return docs.select("id", *carry, "text").mapInArrow(scored, f"{names}, score double")
