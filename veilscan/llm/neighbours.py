"""Nearest neighbours by shifted space-filling curves.

Each curve projects the vectors onto a few random directions, shifts them at random
and orders them along a Hilbert curve; the order is cut into ranges of equal size. A
query is compared with the ranges around its own on every curve, and what the curves
find is merged and ranked by the exact distance. How many ranges that takes follows
from a bounded sample of queries whose true neighbours are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import cut

CURVES, DIRECTIONS, BITS = 8, 8, 6
#: Ranges of a curve at most, and vectors that a range should have at least.
RANGES, LEAST_IN_RANGE = 64, 32
#: Vectors compared in one group; larger ranges are split by a hash.
CELL_ROWS = 20_000
#: Queries of one group, about; those of a cell with more are dealt into blocks, and its vectors meet each block.
CELL_QUERIES = 4_096


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2**bits (Skilling's transform)."""
    x = places.astype(np.int64).copy()
    count = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(count):
            up = (x[:, i] & bit) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap if i else 0
        bit >>= 1
    for i in range(1, count):
        x[:, i] ^= x[:, i - 1]
    turned = np.zeros(len(x), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turned ^= np.where(x[:, -1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turned[:, None]
    key = np.zeros(len(x), np.int64)
    for level in reversed(range(bits)):
        for i in range(count):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


@dataclass
class Curves:
    """Directions, ranges of the projections, shifts, and where each curve is cut."""

    directions: np.ndarray
    low: np.ndarray
    width: np.ndarray
    shift: np.ndarray
    edges: list[np.ndarray]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        top = (1 << BITS) - 1
        out = np.empty((len(vectors), len(self.directions)), np.int64)
        for t in range(out.shape[1]):
            unit = np.clip((vectors @ self.directions[t] - self.low[t]) / self.width[t], 0, 1)
            out[:, t] = hilbert_keys(((unit + self.shift[t]) / 1.5 * top).astype(np.int64), BITS)
        return out

    def ranges(self, vectors: np.ndarray) -> np.ndarray:
        keys = self.keys(vectors)
        return np.stack([np.searchsorted(e, keys[:, t], side="right") for t, e in enumerate(self.edges)], axis=1)


def fit_curves(sample: np.ndarray, total: int, curves: int = CURVES, seed: int = 7) -> Curves:
    """Curves for vectors like those of a bounded sample."""
    random = np.random.default_rng(seed)
    size = sample.shape[1]
    count = min(DIRECTIONS, size)
    directions = np.stack([np.linalg.qr(random.normal(size=(size, size)))[0][:, :count] for _ in range(curves)])
    projected = np.einsum("nd,tdk->tnk", sample, directions)
    low = projected.min(axis=1)
    width = np.maximum(projected.max(axis=1) - low, 1e-12)
    made = Curves(directions, low, width, random.random((curves, count)) / 2, [])
    keys = made.keys(sample)
    ranges = int(min(RANGES, max(total // LEAST_IN_RANGE, 1)))
    at = np.arange(1, ranges) / ranges
    made.edges = [np.quantile(keys[:, t], at, method="nearest") for t in range(curves)]
    return made


def _closest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows of its nearest vectors and the distances; ties go to smaller ids."""
    rough = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None] - 2 * queries @ vectors.T
    take = min(count + 6, len(vectors))
    near = np.argpartition(rough, take - 1, axis=1)[:, :take]
    # The rough distances decide only where they differ clearly.
    limit = np.take_along_axis(rough, near, 1).max(axis=1)
    scale = (queries**2).sum(axis=1) + (vectors**2).sum(axis=1).max()
    rows, found, distances = [], [], []
    for k in range(len(queries)):
        own = near[k] if take == len(vectors) else np.flatnonzero(rough[k] <= limit[k] + 1e-12 * scale[k])
        d = np.sqrt(((vectors[own] - queries[k]) ** 2).sum(axis=1))
        best = np.lexsort((ids[own], d))[:count]
        rows.append(np.full(len(best), k))
        found.append(own[best])
        distances.append(d[best])
    index = np.stack([np.concatenate(rows), np.concatenate(found)])
    return index, np.concatenate(distances)


def _searched(cells: DataFrame, wanted: DataFrame, count: int, kind: str) -> DataFrame:
    """Nearest vectors of each query within each cell: ``(query, found, distance)``."""

    def compare(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query": [], "found": [], "distance": []})
        x, ids = np.stack(vectors["vector"].to_numpy()).astype(np.float64), vectors["id"].to_numpy()
        parts = []
        for at in range(0, len(queries), 256):
            some = queries.iloc[at : at + 256]
            index, distance = _closest(np.stack(some["asked"].to_numpy()).astype(np.float64), x, ids, count)
            parts.append(
                pd.DataFrame({"query": some["query"].to_numpy()[index[0]], "found": ids[index[1]], "distance": distance})
            )
        return pd.concat(parts)

    schema = f"query {kind}, found {kind}, distance double"
    wanted = wanted.select("cell", F.col("id").alias("query"), F.col("vector").alias("asked"))
    return cells.groupBy("cell").cogroup(wanted.groupBy("cell")).applyInPandas(compare, schema)


def usable(vectors: DataFrame) -> DataFrame:
    """``(id, vector)`` without null ids, and null, empty, zero or not wholly finite vectors.

    Vectors of another length than most have take no part either (of lengths as
    frequent, the smaller counts).
    """
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    sound = vectors.select("id", "vector").where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad & some)
    common = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("vector") == (common.n if common else 0))


def nearest(
    vectors: DataFrame,
    is_query: str,
    count: int = 10,
    recall: float = 0.96,
    sample_rows: int = 20_000,
    sample_queries: int = 64,
    cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """The ``count`` nearest rows of each query: ``(query_id, rank, id, score)``.

    ``is_query`` is SQL over ``id``; candidates are all usable rows but the
    query's own. The score is the Euclidean distance in double precision; ties
    go to the smaller id. Equal vectors are searched for once, their smallest
    ids then take their places. Ids that repeat count once, with the vector
    that comes first in order. ``recall`` is what the ranges around a query
    are to reach on up to ``sample_queries`` queries with known neighbours.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    empty = "query_id {0}, rank int, id {0}, score double".format(kind)
    spark = vectors.sparkSession
    rows = cut(usable(vectors).groupBy("id").agg(F.min("vector").alias("vector")))
    kinds = cut(rows.groupBy("vector").agg(F.min("id").alias("id")))
    total = kinds.count()
    if not total:
        return spark.createDataFrame([], empty)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / total))
    sample = kinds.where(draw).limit(2 * sample_rows).select("vector").toPandas()["vector"]
    sample = np.stack((sample if len(sample) else kinds.limit(1).toPandas()["vector"]).to_numpy()).astype(np.float64)
    curves = fit_curves(sample, total)
    ranges, salts = len(curves.edges[0]) + 1, -(-total // (RANGES * CELL_ROWS))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                values = np.stack([np.array(v) for v in batch.column("vector").to_pylist()])
                found = pa.array(curves.ranges(values).astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), found], ["id", "vector", "ranges"])

    item = vectors.schema["vector"].dataType.simpleString()
    placed = cut(kinds.select("id", "vector").mapInArrow(located, f"id {kind}, vector {item}, ranges array<int>"))
    asked = cut(rows.where(is_query).withColumnRenamed("id", "query_id").join(kinds, "vector").select("query_id", "id"))
    wanted = placed.join(asked.select("id").distinct(), "id")

    def cell(curve: str, place: str) -> str:
        return f"cast(({curve} * {ranges} + {place}) * {salts} as long)"

    spread = placed.selectExpr("id", "vector", "posexplode(ranges) as (curve, place)")
    salt = f"pmod(xxhash64(id), {salts})"
    cells = spread.selectExpr(f"{cell('curve', 'place')} + {salt} as cell", "id", "vector")
    every = f"explode(sequence(0L, {salts - 1}L)) as salt"

    # The true neighbours of some queries, by all ranges of one curve, show how wide the windows must be.
    tried = cut(wanted.orderBy(F.xxhash64("id")).limit(sample_queries))
    first = spread.where("curve = 0").selectExpr(f"{cell('0', 'place')} + {salt} as cell", "id", "vector")
    whole = tried.selectExpr("id", "vector", f"explode(sequence(0L, {ranges * salts - 1}L)) as cell")
    by_distance = Window.partitionBy("query").orderBy("distance", "found")
    true = _searched(first, whole, count + 1, kind).withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= count + 1)
    place = placed.select(F.col("id").alias("found"), F.col("ranges").alias("there"))
    here = tried.select(F.col("id").alias("query"), F.col("ranges").alias("here"))
    away = F.array_min(F.zip_with("here", "there", lambda a, b: F.abs(a - b)))
    gaps = [r[0] for r in true.where("query <> found").join(F.broadcast(here), "query").join(place, "found").select(away).collect()]
    width = int(np.quantile(gaps, recall, method="higher")) if gaps else 0

    windows = wanted.selectExpr("id", "vector", "posexplode(ranges) as (curve, place)").selectExpr(
        "id", "vector", "curve", f"explode(sequence(greatest(place - {width}, 0), least(place + {width}, {ranges - 1}))) as near"
    )
    blocks = max(1, -(-asked.count() * min(2 * width + 1, ranges) // (ranges * cell_queries)))
    windows = windows.selectExpr("id", "vector", "curve", "near", every).selectExpr(
        f"({cell('curve', 'near')} + salt) * {blocks} + pmod(xxhash64(id), {blocks}) as cell", "id", "vector"
    )
    each = cells.selectExpr("cell", "id", "vector", f"explode(sequence(0L, {blocks - 1}L)) as block")
    found = _searched(each.selectExpr(f"cell * {blocks} + block as cell", "id", "vector"), windows, count + 1, kind).distinct()
    best = found.withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= count + 1)
    # Rows of equal vectors: a query needs no more than the smallest ``count + 1`` ids of each.
    in_kind = Window.partitionBy("vector").orderBy("id")
    copies = rows.withColumn("n", F.row_number().over(in_kind)).where(F.col("n") <= count + 1)
    copies = copies.withColumnRenamed("id", "member").join(kinds, "vector").select(F.col("id").alias("found"), "member")
    answers = (
        asked.withColumnRenamed("id", "query")
        .join(best.select("query", "found", "distance"), "query")
        .join(copies, "found")
        .where("member <> query_id")
    )
    ranked = Window.partitionBy("query_id").orderBy("distance", "member")
    return (
        answers.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= count)
        .select("query_id", "rank", F.col("member").alias("id"), F.col("distance").alias("score"))
    )
