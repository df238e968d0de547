"""What the operators share: Arrow chunks, worker state, numbering, lineage cuts."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.session import work_dir

#: Bytes of text that a Python function works on at a time.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def remainder(name: str, divisor: int) -> Column:
    """crc32 of an id, written as decimal text, modulo ``divisor``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % divisor


def cut(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in the shared folder: the lineage ends here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def with_row(df: DataFrame, apart: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """The columns used, under the operators' names, and the whole row as ``row``.

    Whatever other columns of the input are called, they can't clash. Used
    columns of the input that are named in ``apart`` are not in ``row`` too, so
    that long texts go to Python once; ``kept_rows`` needs them carried along
    under their own names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in apart])
    return df.select(row.alias("row"), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def kept_rows(df: DataFrame, condition: Column | str, names: list[str], apart: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``with_row`` that fulfil a condition, in their own columns ``names``, of which some were ``apart``."""
    return df.where(condition).select(*[(F.col(c) if c in apart else F.col("row")[c]).alias(c) for c in names])


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of text (and ``rows`` rows), or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            stop = min(stop, start + (rows or batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (one more entry than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts on end, and where each text begins."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    starts = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(), dtype=np.int64)])
    data, _ = utf8(texts)
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), starts


#: ASCII digits and lower-case letters, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (64-bit); spans are ordered, disjoint and not empty.

    A polynomial in an odd base, summed per span, then scrambled with the length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest - 1, _STEP)]), dtype=np.uint64)
    index = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = values if len(values) == len(index) else values[index + np.repeat(starts, lengths)]
    sums = np.add.reduceat(flat * powers[index], np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * _STEP)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of every text: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

    Returns the 64-bit hash of each word, the text it is in, the words before
    each text (one entry more than texts), and (bytes, starts, ends).
    """
    data, offsets = utf8(texts)
    data = LOWER[data]
    inside = WORD_BYTE[data]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[1:-1] = np.diff(inside.view(np.int8))
    if len(data):
        edges[0], edges[-1] = inside[0], -int(inside[-1])
    # Where one text ends in a word and the next begins with one, the run is two words.
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    split = np.unique(inner[inside[inner] & inside[inner - 1]])
    starts = np.flatnonzero(edges == 1)
    ends = np.flatnonzero(edges == -1)
    if len(split):
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    hashes = span_hashes(_BYTE_VALUE[data[np.flatnonzero(inside)]], starts, ends)
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return hashes, text, first, (data, starts, ends)


def worker_state(operator: str, name: str, make: Callable[[], object]) -> object:
    """An object that the Python worker keeps from task to task, until it gets a task of another operator.

    Workers go from one stage to the next; what all operators keep would add up.
    """
    home = sys.modules.setdefault("_veilscan_worker", types.ModuleType("_veilscan_worker"))
    if getattr(home, "operator", None) != operator:
        home.operator, home.kept = operator, {}
    if name not in home.kept:
        home.kept[name] = make()
    return home.kept[name]


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def salts_for(spark: SparkSession, rows: int, each: int = 200_000) -> int:
    """Into how many parts a key is split so that a part stays small, whatever the key's share."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, salts: int) -> DataFrame:
    """``df`` with a gapless number from 0 within each value of ``by``.

    Every key is split into ``salts`` parts by a hash of ``order`` (which
    identifies a row); rows are numbered within a part, and the parts' counts,
    one small row each, give where a part begins. ``df`` is read twice, so it
    should be a written table.
    """
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(*by, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return (
        salted.withColumn("_within", within)
        .join(starts, [*by, "_part"])
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_part", "_start", "_within")
    )


def class_sample(labels: DataFrame, per_class: int, seed: str) -> tuple[dict[int, int], DataFrame]:
    """How many ids have label 1 and 0, and about ``per_class`` ids of each, by a hash of the id.

    ``labels`` is ``(id, label)``; ids that have both labels, or another one, are left out.
    """
    clean = (
        labels.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("id")
        .agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("_other"))
        .where(F.col("label") == F.col("_other"))
        .drop("_other")
    )
    sizes = {r.label: r.n for r in clean.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(per_class / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return sizes, clean.where(draw < share)
