"""CSV files read in parallel, quoted line breaks and all.

Whether a line begins inside a quoted field depends on everything before it. So every
line is a function on two states, outside or inside of quotes, and so is every block of
lines that Spark reads as one split. One narrow pass gives the functions of the blocks;
a prefix scan over a file's blocks composes them, which says in what state each block
begins; a second narrow pass then reads the records. A record that runs on from one
block into others is put together from its parts, which are the only lines to be
shuffled. However large a quoted file is, all of its blocks are read side by side.

A quote opens a field only as its first character; elsewhere outside of quotes it is
a character like others. Inside, two quotes are one, and what follows the closing quote
belongs to the field. Lines end with LF, CR LF or CR. Empty and blank lines are no
records. What follows a quote that is never closed is not read; ``unclosed`` says where.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.operators.names import BROADCAST_BYTES, BROADCAST_ROWS
from veilscan.session import settled
from veilscan.sources.encoding import CP1251_UNDEFINED

_QUOTE, _BOM = b'"', b"\xef\xbb\xbf"
#: What names a block.
_BLOCK = ["file", "start", "length"]
#: Bytes of lines that are parsed at a time.
PART = 1 << 20


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside of quotes, if it begins outside or inside of them."""
    at = 0
    while True:
        quote = line.find(_QUOTE, at)
        if quote < 0:
            return inside
        if inside:
            if line[quote + 1 : quote + 2] == _QUOTE:
                at = quote + 2
                continue
            inside = False
        elif quote == 0 or line[quote - 1] in b",\r\n":
            inside = True
        at = quote + 1


def records(data: bytes) -> Iterator[list[bytes]]:
    """The records of some whole lines, as lists of fields; blank ones are left out."""
    at, end, fields = 0, len(data), []
    newline = carriage = -1  # the next ones, looked for only when passed
    while at < end:
        parts = []
        quoted = data[at : at + 1] == _QUOTE
        if quoted:
            at += 1
            while True:
                quote = data.find(_QUOTE, at)
                if quote < 0:
                    return  # never closed
                parts.append(data[at:quote])
                at = quote + 1
                if data[at : at + 1] != _QUOTE:
                    break
                parts.append(_QUOTE)
                at += 1
        if newline < at:
            newline = data.find(b"\n", at)
            newline = end if newline < 0 else newline
        if carriage < at:
            carriage = data.find(b"\r", at)
            carriage = end if carriage < 0 else carriage
        line = min(newline, carriage)
        comma = data.find(b",", at, line)
        stop = line if comma < 0 else comma
        fields.append(b"".join([*parts, data[at:stop]]) if quoted else data[at:stop])
        at = stop + 1
        if comma >= 0:
            if at < end:
                continue
            fields.append(b"")
        elif data[stop : stop + 2] == b"\r\n":
            at += 1
        if len(fields) > 1 or quoted or fields[0].strip(b" \t"):
            yield fields
        fields = []


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line's bytes, with the file and the block of it that was read; a block's lines come in order."""
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in zip(("file_path", "file_block_start", "file_block_length"), _BLOCK)]
    value = F.col("value").cast("binary")
    marked = (F.col("_metadata.file_block_start") == 0) & F.startswith(value, F.lit(_BOM))
    own = F.when(marked, F.substring(value, len(_BOM) + 1, (1 << 31) - 1)).otherwise(value)
    return spark.read.option("lineSep", "\n").text(path).select(*meta, own.alias("value"))


def _by_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches that are of one block each, with the values of ``columns``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for name in _BLOCK:
            column = batch.column(name)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(batch.column(c)[int(a)].as_py() for c in columns), batch.slice(a, b - a)


def _functions(lines: DataFrame) -> DataFrame:
    """What each block does to the two states, and what its bytes can be.

    ``outside`` and ``inside`` say whether it ends inside of quotes if it begins
    so, ``leaves`` whether a line of it ends outside if it begins inside.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_BLOCK, "outside", "inside", "leaves", "utf8", "undefined"]
        known, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*known, *state)], names)

        for block, batch in _by_block(batches, _BLOCK):
            if block != known:
                if known is not None:
                    yield row()
                known, state = block, [False, True, False, True, False]
            for line in batch.column("quoted").drop_null().to_pylist():
                outside, inside = ends_inside(line, False), ends_inside(line, True)
                state[0], state[1] = (inside if state[0] else outside), (inside if state[1] else outside)
                state[2] |= not state[1]
            state[3] &= pc.all(batch.column("utf8")).as_py()
            state[4] |= pc.any(batch.column("undefined")).as_py()
        if known is not None:
            yield row()

    value = F.col("value")
    undefined = F.contains(value, F.lit(CP1251_UNDEFINED.encode("latin-1")))
    # Lines without a quote leave both states as they are, and stay in the JVM.
    sent = lines.select(
        *_BLOCK,
        F.when(F.contains(value, F.lit(_QUOTE)), value).alias("quoted"),
        F.is_valid_utf8(value.cast("string")).alias("utf8"),
        undefined.alias("undefined"),
    )
    schema = "file string, start bigint, length bigint, outside boolean, inside boolean, leaves boolean, utf8 boolean, undefined boolean"
    return sent.mapInArrow(summed, schema)


def csv_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each block of the files: the state it begins in, and the encoding of its file.

    ``(file, start, length, begins, ends, leaves, owner, closed, encoding)``:
    ``begins`` and ``ends`` are true inside of quotes; ``owner`` is the start of
    the block in which the record began that this block begins in; ``closed``
    tells that the record which is open at its end (or runs all through it) is
    closed later. A block is a state transition, so they are composed: a block
    that ends the same from both states sets the state, one that swaps them
    turns it over, and others leave it.
    """
    blocks = _functions(_lines(spark, path))
    whole = Window.partitionBy("file")
    order = whole.orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets, swaps = F.col("outside") == F.col("inside"), F.col("outside") & ~F.col("inside")
    blocks = blocks.withColumn("_swaps", F.sum(swaps.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    setting = F.when(sets, F.struct("outside", F.col("_swaps").alias("at")))
    blocks = blocks.withColumn("_set", F.last(setting, ignorenulls=True).over(before))
    turned = (F.coalesce(F.lag("_swaps").over(order), F.lit(0)) - F.coalesce("_set.at", F.lit(0))) % 2 == 1
    blocks = blocks.withColumn("begins", F.coalesce("_set.outside", F.lit(False)) != turned)
    blocks = blocks.withColumn("ends", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside")))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    encoding = F.when(F.bool_and("utf8").over(whole), "utf-8").when(~F.bool_or("undefined").over(whole), "cp1251").otherwise("latin-1")
    return blocks.select(
        *_BLOCK,
        "begins",
        "ends",
        "leaves",
        F.last(F.when(~F.col("begins") | F.col("leaves"), F.col("start")), ignorenulls=True).over(before).alias("owner"),
        F.coalesce(F.bool_or(F.col("begins") & F.col("leaves")).over(after), F.lit(False)).alias("closed"),
        encoding.alias("encoding"),
    )


def unclosed(blocks: DataFrame) -> DataFrame:
    """``(file, start)``: files with a quote that is never closed, and the block it is in."""
    last = F.max_by(F.struct("ends", "begins", "leaves", "owner", "start"), "start").alias("b")
    runs = F.col("b.begins") & ~F.col("b.leaves")
    return blocks.groupBy("file").agg(last).where("b.ends").select("file", F.when(runs, F.col("b.owner")).otherwise(F.col("b.start")).alias("start"))


def _with_blocks(lines: DataFrame, blocks: DataFrame, small: bool) -> DataFrame:
    """Lines with what is known of their block, in order within it."""
    if small:
        return lines.join(F.broadcast(blocks), _BLOCK, "left")
    numbered = lines.withColumn("_line", F.monotonically_increasing_id())
    joined = numbered.join(blocks, _BLOCK, "left")
    return joined.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "_line").drop("_line")


def _split(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[pa.RecordBatch]:
    """The records that begin and end in a block; or with ``parts`` what a block has of longer ones."""
    known = None
    pending: list[bytes] = []
    state, head, first = False, False, False

    def found(data: bytes, info: tuple, header: bool) -> Iterator[pa.RecordBatch]:
        rows = list(records(data))[1 if header else 0 :]
        if rows and not parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([info[0]] * len(rows)), pa.array([info[-1]] * len(rows)), pa.array(rows, pa.list_(pa.binary()))],
                ["file", "encoding", "fields"],
            )

    def part(data: bytes, info: tuple, owner: int, header: bool) -> Iterator[pa.RecordBatch]:
        if parts:
            values = {"file": info[0], "encoding": info[-1], "owner": owner, "start": info[1], "part": data, "header": header}
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values.values()], list(values))

    def finished(info: tuple) -> Iterator[pa.RecordBatch]:
        """What is left at the end of a block."""
        if info is None or not (pending or state):
            return
        closed, owner = info[7], info[6]
        if head:
            if closed:  # the record runs all through the block
                yield from part(b"".join(pending), info, owner, False)
        elif state and closed:
            yield from part(b"".join(pending), info, info[1], first)
        else:
            yield from found(b"".join(pending), info, first)

    columns = [*_BLOCK, "begins", "ends", "leaves", "owner", "closed", "encoding"]
    for info, batch in _by_block(batches, columns):
        if info[3] is None:
            raise ValueError(f"{info[0]} was cut into other blocks the second time: keep executors and settings as they are while it is read")
        if info != known:
            yield from finished(known)
            known, pending, size = info, [], 0
            state = head = info[3]
            first = info[1] == 0
        for line in batch.column("value").to_pylist():
            line += b"\n"
            if _QUOTE in line:
                state = ends_inside(line, state)
            pending.append(line)
            size += len(line)
            if state:
                continue
            if head:
                yield from part(b"".join(pending), info, info[6], False)
                head, pending, size = False, [], 0
            elif size >= PART:
                rest = b"".join(pending)
                # A header is a record: it goes with the first part that holds one.
                if first and not next(records(rest), None):
                    continue
                yield from found(rest, info, first)
                first, pending, size = False, [], 0
    yield from finished(known)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from all parts of each."""
    for batch in batches:
        for k in range(batch.num_rows):
            file, encoding, data, header = (batch.column(c)[k].as_py() for c in ("file", "encoding", "data", "header"))
            rows = list(records(data))[1 if header else 0 :]
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(rows), pa.string()), pa.array([encoding] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.binary()))],
                ["file", "encoding", "fields"],
            )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, encoding, fields)``: every record of the files but each file's first, the header; fields are bytes."""
    blocks = settled(csv_blocks(spark, path))
    extent = (F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("file") + 64).alias("size"), F.bool_or(F.col("begins") | F.col("ends")).alias("open"))
    known = blocks.agg(*extent).first()
    small = known.n <= BROADCAST_ROWS and (known.size or 0) <= BROADCAST_BYTES
    lines = _with_blocks(_lines(spark, path), blocks, small)
    schema = "file string, encoding string, fields array<binary>"
    whole = lines.mapInArrow(lambda batches: _split(batches, False), schema)
    if not known.open:
        return whole
    parts = lines.where("begins or ends").mapInArrow(
        lambda batches: _split(batches, True), "file string, encoding string, owner bigint, start bigint, part binary, header boolean"
    )
    ordered = F.array_sort(F.collect_list(F.struct("start", "part")))
    together = parts.groupBy("file", "encoding", "owner").agg(ordered.alias("parts"), F.bool_or("header").alias("header"))
    data = F.aggregate("parts", F.lit(b""), lambda left, p: F.concat(left, p["part"])).alias("data")
    return whole.unionByName(together.select("file", "encoding", data, "header").mapInArrow(_joined, schema))


def csv_header(spark: SparkSession, path: str) -> list[bytes]:
    """The first record of the first file (by path); it may have line breaks in quotes."""
    for file in sorted(spark.read.text(path).inputFiles())[:1]:
        lines = _lines(spark, file)
        # The first block is read as far as it must be; the others only for a header that goes on in them.
        rows, left = 16, True
        while left:
            read = [bytes(r.value) + b"\n" for r in lines.where("start = 0").select("value").limit(rows).collect()]
            header, left, rows = next(records(b"".join(read)), None), len(read) == rows, rows * 16
            if header is not None:
                return header
        ordered = lines.withColumn("_line", F.monotonically_increasing_id()).orderBy("start", "_line").select("value")
        rows, left = 256, True
        while left:
            read = [bytes(r.value) + b"\n" for r in ordered.limit(rows).collect()]
            header, left, rows = next(records(b"".join(read)), None), len(read) == rows, rows * 16
            if header is not None:
                return header
    return []
