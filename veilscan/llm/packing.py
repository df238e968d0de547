"""Packing token pieces into sequences by linear grouping.

All decisions are made on the histogram of lengths, which has at most as many
entries as a sequence has places. Large lengths are rounded up within groups of
equal cardinality; the best mixes of those few sizes are found by column
generation; real lengths then take the groups' places, and small ones go best-fit
into what is left. The plan, runs of sequences with one content, is joined back by
length and rank, so no task ever sees all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import chunks, cut, numbered, salts_for
from veilscan.llm.tokens import _memory, encode_batch, lists_of

CAPACITY = 1024


def pieces(docs: DataFrame, vocabulary, end_id: int, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``(id, text)`` to token pieces ``(id, piece, start, length, ids_crc32, ids)``.

    A text's ids, then ``end_id``. Only what is longer than ``capacity`` is cut,
    into full pieces; the first one takes what is over. Null counts as empty,
    which is ``end_id`` alone. ``ids_crc32`` is of the ids as little-endian
    unsigned 32-bit numbers. Without ``with_ids`` the ids themselves stay behind.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(*vocabulary.value)
        for batch in chunks(batches):
            ids, counts = encode_batch(memory, batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<i4")
            counts = counts + 1
            full = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), full)
            number = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            first = counts - (full - 1) * capacity
            length = np.where(number == 0, first[row], capacity)
            start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
            at = np.concatenate([[0], np.cumsum(length)])
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            columns = [batch.column("id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start)]
            columns += [pa.array(length), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, lists_of(ids, length)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("id", "text").mapInArrow(cut_up, schema)


def _best_mix(sizes: list[int], worth: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The mix of sizes that is worth most within the capacity, no size more often than there are pieces of it."""
    value, taken = np.zeros(capacity + 1), []
    for k, size in enumerate(sizes):
        count = np.zeros(capacity + 1, np.int32)
        if worth[k] > 1e-12:
            best = value.copy()
            for n in range(1, min(capacity // size, int(demand[k])) + 1):
                better = np.full(capacity + 1, -1.0)
                better[n * size :] = value[: capacity + 1 - n * size] + n * worth[k]
                wins = better > best + 1e-12
                best[wins], count[wins] = better[wins], n
            value = best
        taken.append(count)
    at, mix = capacity, {}
    for k in reversed(range(len(sizes))):
        if n := int(taken[k][at]):
            mix[k] = n
            at -= n * sizes[k]
    return float(value[capacity]), mix


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[dict[int, int], int]]:
    """Mixes of few sizes with how often each is taken, by column generation, rounded down.

    The linear programme asks for the fewest sequences that hold the demand; a
    new mix comes in while it is worth more than a sequence.
    """
    count, wanted = len(sizes), np.array(demand, float)
    mixes = [{k: max(min(capacity // size, int(demand[k])), 1)} for k, size in enumerate(sizes)]
    basis = np.diag([float(m[k]) for k, m in enumerate(mixes)])
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(axis=0)
        value, mix = _best_mix(sizes, worth, wanted, capacity)
        if value <= 1 + 1e-7:
            break
        column = np.zeros(count)
        for k, n in mix.items():
            column[k] = n
        direction, amounts = inverse @ column, inverse @ wanted
        enters = direction > 1e-9
        if not enters.any():
            break
        ratio = np.where(enters, amounts / np.where(enters, direction, 1), np.inf)
        out = int(ratio.argmin())
        mixes[out], basis[:, out] = mix, column
    amounts = np.linalg.solve(basis, wanted)
    return [(m, int(a + 1e-6)) for m, a in zip(mixes, amounts, strict=True) if a + 1e-6 >= 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Runs ``(sequences, {length: pieces in each})`` that place every piece of the histogram.

    Where the large lengths begin is tried at four places; the plan of fewest sequences is taken.
    """
    tried = [grouped_plan(histogram, capacity, int(capacity * part), 64 if part > 0.3 else 48) for part in (0.0625, 0.25, 0.333, 0.4)]
    return min(tried, key=lambda runs: sum(often for often, _ in runs))


def grouped_plan(histogram: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[int, dict[int, int]]]:
    """A plan that rounds lengths above ``small`` up in ``groups`` groups of equal cardinality."""
    runs: list[list] = [[n, {length: 1}] for length, n in histogram.items() if length == capacity]
    large = sorted(((length, n) for length, n in histogram.items() if small < length < capacity), reverse=True)
    total = sum(n for _, n in large)
    # Equal cardinality: pieces by descending length, cut every ``total / groups``; a group's size is its largest.
    members: list[list[list[int]]] = []
    step, filled = -(-total // groups) if total else 1, 0
    for length, n in large:
        while n:
            if filled % step == 0:
                members.append([])
            part = min(n, step - filled % step)
            members[-1].append([length, part])
            filled, n = filled + part, n - part
    merged: dict[int, list[list[int]]] = {}
    for group in members:
        merged.setdefault(group[0][0], []).extend(group)
    sizes = sorted(merged, reverse=True)
    demand = [sum(n for _, n in merged[s]) for s in sizes]
    stacks = {k: merged[s][::-1] for k, s in enumerate(sizes)}  # the largest last in, first out
    for k in stacks:
        stacks[k].reverse()
    chosen = configurations(sizes, demand, capacity) if sizes else []
    for mix, often in sorted(chosen, key=lambda c: sorted(c[0])):
        # Real lengths take the places, as long as the same ones last.
        while often:
            slots = [(k, n) for k, n in mix.items()]
            if any(not stacks[k] for k, _ in slots):
                break
            several = {k: stacks[k][0] for k, _ in slots}
            times = min([often, *(several[k][1] // n for k, n in slots)])
            content: dict[int, int] = {}
            if times:
                for k, n in slots:
                    content[several[k][0]] = content.get(several[k][0], 0) + n
                    several[k][1] -= n * times
            else:
                # A boundary between two lengths lies within this sequence.
                if any(sum(n for _, n in stacks[k]) < m for k, m in slots):
                    break
                times = 1
                for k, m in slots:
                    while m:
                        part = min(m, stacks[k][0][1])
                        content[stacks[k][0][0]] = content.get(stacks[k][0][0], 0) + part
                        stacks[k][0][1] -= part
                        m -= part
                        if not stacks[k][0][1]:
                            stacks[k].pop(0)
            for k, _ in slots:
                while stacks[k] and not stacks[k][0][1]:
                    stacks[k].pop(0)
            runs.append([times, content])
            often -= times
    rest: dict[int, int] = {length: n for length, n in histogram.items() if length <= small and length < capacity}
    for stack in stacks.values():
        for length, n in stack:
            rest[length] = rest.get(length, 0) + n
    return best_fit(runs, rest, capacity)


def best_fit(runs: list, rest: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Place the other pieces, the longest first, each where the least room is left over."""
    gaps: list[list] = [[] for _ in range(capacity + 1)]
    for often, content in runs:
        if often:
            gaps[capacity - sum(k * n for k, n in content.items())].append([often, content])
    for length in sorted(rest, reverse=True):
        n = rest[length]
        gap = length
        while n:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // length
                if n >= each:
                    gaps[capacity - each * length].append([n // each, {length: each}])
                if n % each:
                    gaps[capacity - n % each * length].append([1, {length: n % each}])
                break
            often, content = gaps[gap].pop()
            each = min(gap // length, n)
            times = min(often, n // each)
            if often > times:
                gaps[gap].append([often - times, content])
            fuller = dict(content)
            fuller[length] = fuller.get(length, 0) + each
            gaps[gap - each * length].append([times, fuller])
            n -= times * each
            gap = length
    return [(often, content) for runs_ in gaps for often, content in runs_ if often]


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece, length, ...)`` with ``sequence_id`` and ``offset``.

    Sequences hold at most ``capacity``, their pieces stand gapless from 0. A
    length below 1 or above the capacity is an error. Rows that repeat another
    one are pieces of their own.
    """
    spark = cut_up.sparkSession
    cut_up = cut(cut_up)
    histogram = {int(r.length): r.n for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if histogram and (min(histogram) < 1 or max(histogram) > capacity):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    slots, ranked, sequence = [], dict.fromkeys(histogram, 0), 0
    for often, content in plan(histogram, capacity):
        offset = 0
        for length in sorted(content, reverse=True):
            each = content[length]
            slots.append((length, ranked[length], ranked[length] + often * each, sequence, each, offset))
            ranked[length] += often * each
            offset += length * each
        sequence += often
    names = ["length", "_low", "_high", "_sequence", "_each", "_offset"]
    # Its size follows the number of different lengths, not of pieces. From a list, workers would be started to convert it.
    columns = np.array(slots, np.int64).reshape(-1, len(names)).T
    places = F.broadcast(spark.createDataFrame(pa.table([pa.array(c) for c in columns], names)))
    rows = numbered(cut_up, ["length"], ["id", "piece"], "_rank", salts_for(spark, sum(histogram.values())))
    inside = (rows["length"] == places["length"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    placed = rows.join(places, inside).drop(places["length"])
    turn = F.col("_rank") - F.col("_low")
    return placed.withColumns(
        {
            "sequence_id": F.col("_sequence") + F.expr("(_rank - _low) div _each"),
            "offset": F.col("_offset") + turn % F.col("_each") * F.col("length"),
        }
    ).drop("_rank", "_low", "_high", "_sequence", "_each", "_offset")
