"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Tokens of both stand for the same bytes. A byte offset where tokens of both end is a
shared cut. An interval of tokens is cut at the shared end nearest its middle, which is
looked for outwards from there, each end of the one tokenizer by bisection among those
of the other; the two sides are then intervals of their own. What lies between two
neighbouring cuts is a group: its tokens are linked, each with each.

How many documents hold a pair of ids linked is counted over the whole corpus. Texts
are worked on in chunks. A chunk's distinct pairs, not those of each text, meet the
counts, and then the chunk's own rows, which were written away in one piece.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import chunks, code_points, utf8, worker_state
from veilscan.llm.tokens import Memory, Strings, fingerprint, lists_of, load_vocabulary, parse_vocabulary
from veilscan.session import work_dir

#: Linked pairs that are put together at a time.
PAIRS = 1 << 20
_ID = np.int64(1 << 20)


class Pieces:
    """The second tokenizer: a sentencepiece model, and the bytes of its pieces."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        contents = {}
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            contents[i] = bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i) else piece.replace("▁", " ").encode()
        self.strings = Strings(contents)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.processor.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int32, int(counts.sum())), counts


class Aligner:
    """Both tokenizers, and the decimal forms of their ids."""

    def __init__(self, vocabulary: str, model: bytes) -> None:
        parsed = parse_vocabulary(vocabulary)
        self.first, self.first_bytes = Memory(parsed), Strings(parsed.contents)
        self.second = Pieces(model)
        count = max(len(self.first_bytes.sizes), len(self.second.strings.sizes))
        self.decimals = Strings({3 * i + k: b"%d%s" % (i, sign) for i in range(count) for k, sign in enumerate((b",", b"|", b";"))})

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers on end, and how many each text has.

        A text that is null or empty, or whose tokens are not the bytes of a
        space and it, has none.
        """
        plain = [t or "" for t in texts.to_pylist()]
        spaced = pa.array([" " + t if t else "" for t in plain], pa.large_string())
        sides = (self.first.encode(*code_points(spaced)), self.second.encode(plain))
        data, offsets = utf8(spaced)
        whole = np.diff(offsets) > 0
        raw = memoryview(data.tobytes())
        for (ids, counts), strings in zip(sides, (self.first_bytes, self.second.strings), strict=True):
            bounds = np.concatenate([[0], np.cumsum(counts)])
            joined = strings.joined(ids, bounds)
            whole &= [raw[a:b] == own for a, b, own in zip(offsets, offsets[1:], joined, strict=False)]
        out = []
        for ids, counts in sides:
            out += [ids[np.repeat(whole, counts)], np.where(whole, counts, 0)]
        return tuple(out)


def shared_cuts(one: np.ndarray, two: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each end of ``one`` is an end of ``two``, by divide and conquer; both ascend.

    ``bounds``: where each interval of ``one`` begins, and the end. All
    intervals of a round go side by side. From an interval's middle the search
    goes outwards in widening steps, until a shared end is met; what was passed
    has none, so each end is bisected once.
    """
    cut = np.zeros(len(one), bool)
    low, high = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    left = right = (low + high) // 2  # the ends from left to right (exclusive) are known
    width = np.ones(len(low), np.int64)
    while len(low):
        here = (left > low) | (right < high)
        low, high, left, right, width = (v[here] for v in (low, high, left, right, width))
        if not len(low):
            break
        start, stop = np.maximum(left - width, low), np.minimum(right + width, high)
        sizes = (left - start) + (stop - right)
        before = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(before, sizes) + np.repeat(start, sizes)
        at += np.where(at >= np.repeat(left, sizes), np.repeat(right - left, sizes), 0)
        place = np.minimum(np.searchsorted(two, one[at]), len(two) - 1)
        met = two[place] == one[at]
        owner = np.repeat(np.arange(len(low)), sizes)
        cut[at[met]] = True
        found = np.zeros(len(low), bool)
        found[owner[met]] = True
        # Where a cut was met, the ends left of what is known and those right of it are intervals of their own.
        parts = [(low[found], start[found]), (stop[found], high[found])]
        fresh = [np.concatenate([p[k] for p in parts]) for k in (0, 1)]
        middle = (fresh[0] + fresh[1]) // 2
        rest = ~found
        left = np.concatenate([start[rest], middle])
        right = np.concatenate([stop[rest], middle])
        width = np.concatenate([2 * width[rest], np.ones(len(middle), np.int64)])
        low, high = np.concatenate([low[rest], fresh[0]]), np.concatenate([high[rest], fresh[1]])
    return cut


class Alignment:
    """Groups of a chunk's tokens: ``group_one`` and ``group_two`` say in which group each token is."""

    def __init__(self, aligner: Aligner, texts: pa.Array) -> None:
        self.aligner = aligner
        self.one, self.count_one, self.two, self.count_two = aligner.tokens(texts)
        ends_one = np.cumsum(aligner.first_bytes.sizes[self.one])
        ends_two = np.cumsum(aligner.second.strings.sizes[self.two])
        self.bounds_one = np.concatenate([[0], np.cumsum(self.count_one)])
        self.bounds_two = np.concatenate([[0], np.cumsum(self.count_two)])
        # The ends of texts are shared, so all texts' intervals go together.
        self.cut_one = shared_cuts(ends_one, ends_two, self.bounds_one)
        shared = ends_one[self.cut_one]
        self.group_one = np.searchsorted(shared, ends_one)
        self.group_two = np.searchsorted(shared, ends_two)
        self.ends = shared
        groups = len(shared)
        self.size_one, self.size_two = np.bincount(self.group_one, minlength=groups), np.bincount(self.group_two, minlength=groups)
        # Groups before each text, one entry more than texts.
        self.before = np.concatenate([[0], np.cumsum(self.cut_one)])[self.bounds_one]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2``; nothing for a text without tokens."""
        last_two = np.ones(len(self.two), bool)
        last_two[:-1] = self.group_two[1:] != self.group_two[:-1]
        start_one, start_two = np.cumsum(self.size_one) - self.size_one, np.cumsum(self.size_two) - self.size_two
        signs = np.zeros(len(self.one) + len(self.two), np.int64)
        signs[np.arange(len(self.one)) + start_two[self.group_one]] = 3 * self.one.astype(np.int64) + self.cut_one
        after = (start_one + self.size_one)[self.group_two]
        signs[np.arange(len(self.two)) + after] = 3 * self.two.astype(np.int64) + 2 * last_two
        joined = self.aligner.decimals.joined(signs, self.bounds_one + self.bounds_two)
        return [hashlib.sha256(text[:-1]).hexdigest() if len(text) else "" for text in joined]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): how often each text holds each pair of ids linked; sorted by text and pair."""
        text = np.repeat(np.arange(len(self.count_one)), np.diff(self.before)).astype(np.int64)
        start_one, start_two = np.cumsum(self.size_one) - self.size_one, np.cumsum(self.size_two) - self.size_two
        links = self.size_one * self.size_two
        owner, code, times = [], [], []
        ends = np.cumsum(links)
        at = 0
        while at < len(links):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            for keys, n in self._linked(at, stop, links, start_one, start_two):
                owner.append(text[at:stop][keys >> 42])
                code.append(keys & np.int64((1 << 42) - 1))
                times.append(n)
            at = stop
        if not owner:
            return (np.zeros(0, np.int64),) * 3
        owner, code, times = map(np.concatenate, (owner, code, times))
        order = np.lexsort((code, owner))
        owner, code, times = owner[order], code[order], times[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(code, prepend=-1).astype(bool))
        return owner[first], code[first], np.add.reduceat(times, first)

    def _linked(self, at, stop, links, start_one, start_two) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of (group from ``at``, pair) with their number; one large group is put together from its distinct ids."""
        if stop == at + 1 and links[at] > PAIRS:
            sides = []
            for ids, start, size in ((self.one, start_one[at], self.size_one[at]), (self.two, start_two[at], self.size_two[at])):
                sides.append(np.unique(ids[start : start + size], return_counts=True))
            (x, n_x), (y, n_y) = sides
            step = max(1, PAIRS // len(y))
            for low in range(0, len(x), step):
                code = x[low : low + step].astype(np.int64)[:, None] * _ID + y
                yield code.reshape(-1), (n_x[low : low + step, None] * n_y).reshape(-1)
            return
        some = links[at:stop]
        group = np.repeat(np.arange(stop - at), some)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(some) - some, some)
        wide = self.size_two[at:stop][group]
        x = self.one[start_one[at:stop][group] + inside // wide].astype(np.int64)
        y = self.two[start_two[at:stop][group] + inside % wide]
        yield (group.astype(np.int64) << 42) + x * _ID + y, np.ones(len(group), np.int64)

    def measures(self) -> dict[str, np.ndarray]:
        """Per text: tokens of each, groups, links."""
        links = np.concatenate([[0], np.cumsum(self.size_one * self.size_two)])[self.before]
        return {"n_a": self.count_one, "n_b": self.count_two, "n_groups": np.diff(self.before), "n_links": np.diff(links)}


def tokenizers(spark: SparkSession, vocabulary_path: str, model_path: str):
    """Both tokenizer files, sent to every executor once (a few MB, whatever the data)."""
    text = load_vocabulary(vocabulary_path)
    with open(model_path, "rb") as file:
        model = file.read()
    return spark.sparkContext.broadcast((fingerprint(text) + hashlib.blake2b(model, digest_size=8).hexdigest(), text, model))


def _aligner(value: tuple[str, str, bytes]) -> Aligner:
    name, text, model = value
    return worker_state("tokens", f"aligner_{name}", lambda: Aligner(text, model))


def align(docs: DataFrame, both) -> DataFrame:
    """``(id, text)`` to ``(id, groups)``: (a, b, end) with the ids of each and the byte where the group ends.

    The first tokenizer reads a space and the text, the second adds that space
    itself; special tokens written out in a text are plain text. ``end`` counts
    from that space. A text that is null or empty, or whose tokens are not the
    bytes of a space and it, has no groups. Other columns are left out.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(both.value)
        for batch in chunks(batches):
            found = Alignment(aligner, batch.column("text"))
            lists = [lists_of(found.one, found.size_one), lists_of(found.two, found.size_two)]
            text = np.repeat(np.arange(batch.num_rows), np.diff(found.before))
            first = np.concatenate([[0], found.ends])[found.before[:-1]]
            ends = pa.array(found.ends - first[text])
            groups = pa.StructArray.from_arrays([*lists, ends], ["a", "b", "end"])
            rows = pa.ListArray.from_arrays(pa.array(found.before.astype(np.int32)), groups)
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows], ["id", "groups"])

    return docs.select("id", "text").mapInArrow(aligned, f"id {kind}, groups array<struct<a:array<int>,b:array<int>,end:bigint>>")


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


def chunk_rows(docs: DataFrame, both) -> DataFrame:
    """A row for each chunk of texts: its name, its texts' rows in one piece, its distinct pairs and in how many texts each is."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(both.value)
        for batch in chunks(batches):
            found = Alignment(aligner, batch.column("text"))
            text, code, times = found.pairs()
            kinds, place, texts = np.unique(code, return_inverse=True, return_counts=True)
            counts = np.bincount(text, minlength=batch.num_rows)
            columns = {"id": batch.column("id")} | {k: pa.array(v.astype(np.int64)) for k, v in found.measures().items()}
            columns |= {"groups_sha256": pa.array(found.digests(), pa.string())}
            columns |= {"places": lists_of(place, counts), "times": pa.ListArray.from_arrays(lists_of(place, counts).offsets, pa.array(times))}
            own = pa.array([_packed(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)))], pa.binary())
            lists = [pa.array([v.astype(np.int64)], pa.list_(pa.int64())) for v in (kinds, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes], pa.binary()), own, *lists], ["chunk", "rows", "pairs", "texts"])

    return docs.select("id", "text").mapInArrow(worked, "chunk binary, rows binary, pairs array<bigint>, texts array<bigint>")


def _counted(each: DataFrame) -> DataFrame:
    """``(pair, n, best)``: texts that hold a pair linked, and whether no pair of its first id is in more of them."""
    counts = each.groupBy("pair").agg(F.sum("texts").alias("n"))
    first = F.shiftright("pair", 20).alias("first")
    # One row for each id of the first vocabulary at most.
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    joined = counts.withColumn("first", first).join(F.broadcast(most), "first")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def linked_ids(docs: DataFrame, both) -> DataFrame:
    """``(a, b, n, best)``: in how many texts ids are linked, and whether that is the most for ``a``."""
    each = chunk_rows(docs, both).select(F.explode(F.arrays_zip("pairs", "texts")).alias("_p")).select(F.col("_p.pairs").alias("pair"), "_p.texts")
    second: Column = F.col("pair").bitwiseAND(F.lit((1 << 20) - 1))
    return _counted(each).select(F.shiftright("pair", 20).cast("int").alias("a"), second.cast("int").alias("b"), "n", "best")


def measured(docs: DataFrame, both) -> DataFrame:
    """``(id, text)`` to the numbers and the digest of each text's alignment.

    ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``:
    ``n_best`` is the number of links whose pair is in as many texts as any of
    its first id, ``count_sum`` the sum of those numbers over all links. Texts
    without tokens (see ``align``) have zeros and an empty digest. Rows come
    back as often as they came in, and each counts as a text.
    """
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    folder = f"{work_dir(spark)}/alignment-{uuid.uuid4().hex}"
    chunk_rows(docs, both).write.parquet(folder)
    rows = spark.read.parquet(folder)
    each = rows.select("chunk", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "_p"))
    each = each.select("chunk", "place", F.col("_p.pairs").alias("pair"), "_p.texts")
    known = each.select("chunk", "place", "pair").join(_counted(each), "pair")
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    joined = rows.select("chunk", "rows").join(known, "chunk", "left").select("rows", "known")
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = pa.ipc.open_stream(batch.column("rows")[k].as_py()).read_next_batch()
                known = batch.column("known")[k].values
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if known is not None and len(known):
                    place = known.field("place").to_numpy()
                    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                    n[place] = known.field("n").to_numpy()
                    best[place] = known.field("best").to_numpy(zero_copy_only=False)
                bounds = own.column("places").offsets.to_numpy()
                places, times = own.column("places").values.to_numpy(), own.column("times").values.to_numpy()
                sums = [np.concatenate([[0], np.cumsum(times * v[places])]) for v in (best, n)]
                columns = [own.column("id"), *(own.column(c) for c in names)]
                columns += [pa.array(np.diff(s[bounds])) for s in sums]
                columns.append(own.column("groups_sha256"))
                yield pa.RecordBatch.from_arrays(columns, ["id", *names, "n_best", "count_sum", "groups_sha256"])

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in [*names, "n_best", "count_sum"]) + ", groups_sha256 string"
    return joined.mapInArrow(summed, schema)
