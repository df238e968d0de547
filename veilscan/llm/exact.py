"""Exact deduplication by content-defined chunk recipes.

A normalised text is cut where a rolling hash of its last bytes says so. Distinct
chunks are moved once to verify that a digest stands for one content; a text is
then the ordered list of its chunks' identifiers, and only those lists are
compared and moved, however long the texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import LOWER, chunks, cut, mix, utf8

SHORTEST, LONGEST = 512, 16_384
_MASK = np.uint64((1 << 11) - 1)
_GEAR = mix(np.arange(1001, 1257, dtype=np.uint64))


def _marks(data: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last 32 bytes allows a cut."""
    total, width = _GEAR[data], 1
    while width < 32 and len(total) > width:
        total[width:] = total[width:] + (total[:-width] << np.uint64(width))
        width *= 2
    return np.flatnonzero(total & (_MASK << np.uint64(20)) == 0) + 1


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text begin and end; no places for an empty text.

    A chunk has ``SHORTEST`` to ``LONGEST`` bytes but for the last one, so a
    window never reaches back into the text before.
    """
    marks, out = _marks(data), []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if start == stop:
            out.append([])
            continue
        own = marks[np.searchsorted(marks, start + SHORTEST) : np.searchsorted(marks, stop)].tolist()
        places, k = [start], 0
        while stop - places[-1] > SHORTEST:
            least = places[-1] + SHORTEST
            while k < len(own) and own[k] < least:
                k += 1
            place = min(own[k] if k < len(own) else stop, places[-1] + LONGEST)
            if place >= stop:
                break
            places.append(place)
        out.append([*places, stop])
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[memoryview, list[memoryview]]]:
    data, offsets = utf8(batch.column("text"))
    data = LOWER[data]
    view = memoryview(data.tobytes())
    for k, places in enumerate(cuts(data, offsets)):
        yield view[offsets[k] : offsets[k + 1]], [view[a:b] for a, b in zip(places, places[1:], strict=False)]


def ambiguous_digests(docs: DataFrame, digest_bytes: int = 16) -> list[bytes]:
    """Digests that stand for more than one chunk content (none, unless digests are short).

    Every distinct chunk of ``(text)`` is moved once, after the copies of a task are put together.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = {bytes(p) for _, pieces in _pieces(batch) for p in pieces}
            digests = [hashlib.blake2b(p, digest_size=digest_bytes).digest() for p in found]
            columns = [pa.array(digests, pa.binary()), pa.array(list(found), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "content"])

    distinct = docs.select("text").mapInArrow(contents, "digest binary, content binary").distinct()
    twice = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [bytes(r.digest) for r in twice.select("digest").collect()]


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """``(id, text)`` to ``(id, text_sha256, recipe)``.

    The recipe is the list of verified chunk identifiers: the digest, or the
    content itself where a digest proved ambiguous. ``text_sha256`` is of the
    text with A-Z lower-cased. Null counts as empty, whose recipe is empty.
    """
    ambiguous = frozenset(ambiguous_digests(docs, digest_bytes))
    kind = docs.schema["id"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def identifier(piece: memoryview) -> bytes:
            digest = hashlib.blake2b(piece, digest_size=digest_bytes).digest()
            return b"=" + bytes(piece) if digest in ambiguous else digest

        for batch in chunks(batches):
            whole, lists = [], []
            for text, pieces in _pieces(batch):
                whole.append(hashlib.sha256(text).hexdigest())
                lists.append([identifier(p) for p in pieces])
            columns = [batch.column("id"), pa.array(whole, pa.string()), pa.array(lists, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_sha256", "recipe"])

    return docs.select("id", "text").mapInArrow(listed, f"id {kind}, text_sha256 string, recipe array<binary>")


def exact_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z.

    ``(id, text)`` to ``(id, keep_id, group_size, kept, text_sha256)``, one row
    for each that came in. The largest id of a group stays; rows that repeat
    it with the same text are marked kept too. A null id never stays. Null
    texts are equal to the empty text.
    """
    lists = cut(recipes(docs, digest_bytes))
    groups = lists.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return lists.join(groups, "recipe").select(
        "id", "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )
