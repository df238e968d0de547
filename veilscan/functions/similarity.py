"""String similarity and greedy leader clustering of near-equal values.

The similarity is the Ratcliff-Obershelp ratio: the longest common block of two strings,
then the same left and right of it. All pairs of a batch are worked on side by side: a
worklist of (pair, ranges) gives up its longest blocks in one sweep, and what lies left
and right of them is the next worklist. ``native_similarity`` is a JVM-only
approximation for callers who prefer speed over the exact ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.session import settled, unsized

# Fixed value: two values are one when their ratio is above this.
SAME_VALUE_RATIO = 0.85

STRINGS = T.ArrayType(T.StringType())
GROUPS = T.ArrayType(STRINGS)

#: Cells of a sweep: pairs times the characters of the longer side.
SWEEP = 1 << 18
#: Values that are compared with each other in one task.
CHUNK = 4096
#: Values of a group of which one task of a later round gives the leaders.
ROUND = 8 * CHUNK
_NONE_A, _NONE_B = np.uint32(0xFFFFFFFE), np.uint32(0xFFFFFFFF)


def _matrix(values: list[str], filler: np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each value in a row, filled up, and the lengths."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    out = np.full((len(values), int(sizes.max(initial=0))), filler, np.uint32)
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = codes
    return out, sizes


def _longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest common block of each two rows; the earliest in a, then in b."""
    size, end_a, end_b = (np.zeros(len(a), np.int64) for _ in range(3))
    run = np.zeros((len(a), b.shape[1] + 1), np.int32)
    for at in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (a[:, at, None] == b)
        last = run.argmax(axis=1)
        found = run[np.arange(len(a)), last]
        longer = found > size
        size[longer], end_a[longer], end_b[longer] = found[longer], at + 1, last[longer]
    return end_a - size, end_b - size, size


def matching_characters(first: list[str], second: list[str]) -> np.ndarray:
    """How many characters of each pair are in common blocks."""
    a, size_a = _matrix(first, _NONE_A)
    b, size_b = _matrix(second, _NONE_B)
    total = np.zeros(len(first), np.int64)
    work = np.stack([np.arange(len(first)), np.zeros_like(size_a), size_a, np.zeros_like(size_b), size_b])
    while True:
        work = work[:, (work[1] < work[2]) & (work[3] < work[4])]
        if not work.shape[1]:
            return total
        following = []
        # Ranges of about the same length go together, so that little is filled up.
        work = work[:, np.argsort(np.maximum(work[2] - work[1], work[4] - work[3]), kind="stable")]
        width = np.maximum(work[2] - work[1], work[4] - work[3])
        at = 0
        while at < work.shape[1]:
            near = width[at : at + SWEEP // int(width[at]) + 1]
            stop = at + max(1, int(np.searchsorted(near * np.arange(1, len(near) + 1), SWEEP, side="right")))
            pair, low_a, high_a, low_b, high_b = work[:, at:stop]
            sides = []
            for codes, low, high, filler in ((a, low_a, high_a, _NONE_A), (b, low_b, high_b, _NONE_B)):
                places = low[:, None] + np.arange(int((high - low).max()))
                inside = places < high[:, None]
                sides.append(np.where(inside, codes[pair[:, None], np.where(inside, places, 0)], filler))
            start_a, start_b, size = _longest_blocks(*sides)
            start_a, start_b = start_a + low_a, start_b + low_b
            some = size > 0
            np.add.at(total, pair[some], size[some])
            following.append(np.stack([pair, low_a, start_a, low_b, start_b])[:, some])
            following.append(np.stack([pair, start_a + size, high_a, start_b + size, high_b])[:, some])
            at = stop
        work = np.concatenate(following, axis=1)


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """Ratcliff-Obershelp ratios of pairs; 1 for two empty strings."""
    sizes = np.fromiter((len(x) + len(y) for x, y in zip(first, second, strict=True)), np.int64, len(first))
    return np.where(sizes > 0, 2.0 * matching_characters(first, second) / np.maximum(sizes, 1), 1.0)


@F.arrow_udf(T.DoubleType())
def similarity_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of two strings; null if one is null."""
    first, second = a.to_pylist(), b.to_pylist()
    known = np.array([x is not None and y is not None for x, y in zip(first, second, strict=True)], bool)
    found = np.zeros(len(first))
    found[known] = ratios(*([v for v, k in zip(side, known, strict=True) if k] for side in (first, second)))
    return pa.array(found, pa.float64(), mask=~known)


def native_similarity(a: Column, b: Column) -> Column:
    """Exact when one value contains the other or characters are substituted."""
    la, lb = F.length(a), F.length(b)
    contained = F.contains(a, b) | F.contains(b, a)
    return F.when(la + lb == 0, 1.0).when(contained, 2.0 * F.least(la, lb) / (la + lb)).otherwise(
        1.0 - F.levenshtein(a, b) / F.greatest(la, lb)
    )


def _grams(values: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, gram) of all runs of ``size`` characters; a gram's second occurrence in a value is another gram."""
    codes, sizes = _matrix(values, _NONE_A)
    place = np.arange(codes.shape[1] - size + 1) if codes.shape[1] >= size else np.zeros(0, np.int64)
    owner, at = np.nonzero(place[None, :] + size <= sizes[:, None]) if len(place) else (np.zeros(0, np.int64),) * 2
    gram = np.zeros(len(owner), np.uint64)
    for k in range(size):
        gram = (gram << np.uint64(21)) | codes[owner, at + k].astype(np.uint64)
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    places = np.arange(len(owner))
    occurrence = places - np.maximum.accumulate(np.where(fresh, places, 0))
    return owner, gram << np.uint64(20) | occurrence.astype(np.uint64)


def _shared(x: list[str], y: list[str], size: int, step: int = 2048) -> np.ndarray:
    """How many grams each two values have in common."""
    (owner_x, gram_x), (owner_y, gram_y) = _grams(x, size), _grams(y, size)
    both = np.intersect1d(gram_x, gram_y)
    shared = np.zeros((len(x), len(y)), np.float32)
    sides = []
    for owner, gram, count in ((owner_x, gram_x, len(x)), (owner_y, gram_y, len(y))):
        place = np.minimum(np.searchsorted(both, gram), max(len(both) - 1, 0))
        known = both[place] == gram if len(both) else np.zeros(len(gram), bool)
        sides.append((owner[known], place[known], count))
    for low in range(0, len(both), step):
        parts = []
        for owner, place, count in sides:
            here = (place >= low) & (place < low + step)
            part = np.zeros((count, min(step, len(both) - low)), np.float32)
            part[owner[here], place[here] - low] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    return shared


def close_pairs(x: list[str], y: list[str], threshold: float, earlier: bool = False) -> np.ndarray:
    """Places (in x, in y) of all pairs above the ratio; with ``earlier`` only those whose y comes before x.

    M matching characters are in at most 1 + (len x - M) + (len y - M) blocks,
    and a block of n has n - 1 pairs of neighbours. So the characters and the
    neighbours that two values share bound M from above, for all pairs at once.
    """
    size_x, size_y = (np.fromiter(map(len, v), np.int64, len(v)) for v in (x, y))
    both = size_x[:, None] + size_y[None, :]
    # The least M that is above the threshold.
    needed = np.floor(threshold * both / 2 + 1e-9) + 1
    may = (np.minimum(size_x[:, None], size_y[None, :]) >= needed) | (both == 0)
    if earlier:
        may &= np.arange(len(y))[None, :] < np.arange(len(x))[:, None]
    if may.any():
        may &= (_shared(x, y, 1) >= needed - 0.5) | (both == 0)
    if may.any():
        may &= (_shared(x, y, 2) >= 3 * needed - 1 - both - 0.5) | (both == 0)
    i, j = np.nonzero(may)
    near = [np.zeros((0, 2), np.int64)]
    for low in range(0, len(i), 1 << 15):
        p, q = i[low : low + (1 << 15)], j[low : low + (1 << 15)]
        above = ratios([x[k] for k in p], [y[k] for k in q]) > threshold
        near.append(np.stack([p[above], q[above]], axis=1))
    return np.concatenate(near)


def _order(value: str) -> tuple[int, str]:
    return -len(value), value


def leaders(values: list[str], threshold: float = SAME_VALUE_RATIO, rows: int = 256) -> list[str]:
    """Longest-first greedy clustering: one leader per group of near-equal values.

    Values go in blocks of ``rows``: what is near a leader of an earlier block
    falls out, then the block's own are taken one after the other.
    """
    order = sorted(set(values), key=_order)
    kept: list[str] = []
    for at in range(0, len(order), rows):
        block = order[at : at + rows]
        covered = np.zeros(len(block), bool)
        for low in range(0, len(kept), CHUNK):
            covered[close_pairs(block, kept[low : low + CHUNK], threshold)[:, 0]] = True
        block = [v for v, c in zip(block, covered, strict=True) if not c]
        if len(block) > 1:
            later: dict[int, list[int]] = {}
            for i, j in close_pairs(block, block, threshold, earlier=True).tolist():
                later.setdefault(i, []).append(j)
            own: set[int] = set()
            for i in range(len(block)):
                if own.isdisjoint(later.get(i, ())):
                    own.add(i)
            block = [block[i] for i in sorted(own)]
        kept += block
    return kept


@F.arrow_udf(GROUPS)
def _leaders_of_groups(groups: pa.Array) -> pa.Array:
    return pa.array(
        [None if g is None else [leaders(values) for values in g] for g in groups.to_pylist()],
        pa.list_(pa.list_(pa.string())),
    )


def leaders_exact(groups: Column) -> Column:
    """Leaders of every value list in an array of lists.

    Rows whose lists hold at most one value each (nearly all of them) are not
    sent to Python: they are their own leaders.
    """
    distinct = F.transform(groups, F.array_distinct)
    busy = F.when(F.exists(distinct, lambda g: F.size(g) > 1), distinct)
    return F.coalesce(_leaders_of_groups(busy), distinct)


def leaders_native(values: Column, threshold: float = SAME_VALUE_RATIO) -> Column:
    """Leaders of one value list by ``native_similarity``, inside the JVM."""
    longest_first = F.array_sort(
        F.array_distinct(values),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1)
        .when(a > b, 1)
        .otherwise(0),
    )
    return F.aggregate(
        longest_first,
        F.array().cast(STRINGS),
        lambda kept, v: F.when(F.exists(kept, lambda k: native_similarity(k, v) > threshold), kept).otherwise(
            F.concat(kept, F.array(v))
        ),
    )


def leaders_of_rows(
    values: DataFrame, keys: list[str], value: str = "value", threshold: float = SAME_VALUE_RATIO, chunk: int = CHUNK
) -> DataFrame:
    """``(keys, value)`` to the leaders of each group of equal ``keys``, however many values it has.

    Groups of up to ``chunk`` distinct values are settled at once. Of a larger
    one, the first ``chunk`` values (the longest, then by code point) give their
    leaders; everything later is compared with those, in blocks side by side,
    and what is near none of them goes on to the next round, whose chunk is eight
    times as large, up to ``ROUND``. So no task holds more than a chunk of leaders
    and a block of values, of which it compares ``CHUNK`` by 512 at a time, no pairs
    are emitted, and a small ``chunk`` does not make for many rounds, each of which
    is planned on the driver. Null values are left out, null keys are a group like others.
    """
    largest = max(chunk, ROUND)
    spare = F.struct(*(F.col(f"`{k}`").alias(k) for k in keys)).alias("g")
    left = values.select(spare, F.col(f"`{value}`").alias("value"))
    left = unsized(settled(left.where(F.col("value").isNotNull()).distinct()))
    kind = left.schema["g"].dataType.simpleString()
    # Few bytes, much work: by a number, so that these shuffles are not put together into one task.
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct((-F.length("value")).alias("size"), F.col("value").alias("value"))

    def first(group: pa.Table) -> pa.Table:
        found = leaders(group.column("value").to_pylist(), threshold)
        same = group.column("g").take(pa.array(np.zeros(len(found), np.int64)))
        return pa.table({"g": same, "value": pa.array(found, pa.string())})

    def later(block: pa.Table, heads: pa.Table) -> pa.Table:
        known, mine = heads.column("value").to_pylist(), block.column("value").to_pylist()
        near = np.zeros(len(mine), bool)
        for low in range(0, len(mine), 512):
            for at in range(0, len(known), CHUNK):
                near[low + close_pairs(mine[low : low + 512], known[at : at + CHUNK], threshold)[:, 0]] = True
        return block.select(["g", "value"]).filter(pa.array(~near))

    def own_leaders(rows: DataFrame) -> DataFrame:
        # By "g" alone, Spark would take the shuffle of a join by "g" for this one, and put its parts together.
        dealt = rows.select("g", "value", F.xxhash64("g").alias("own")).repartition(spread, "g", "own")
        return dealt.groupBy("g", "own").applyInArrow(first, f"g {kind}, value string")

    parts = []
    while True:
        large = settled(left.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk))
        if large.isEmpty():
            parts.append(own_leaders(left))
            break
        parts.append(settled(own_leaders(left.join(large, "g", "left_anti"))))
        # The first values of a large group: those of each salt, then those of them all.
        salted = left.join(large, "g").withColumn("_salt", F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / (4 * chunk))))
        for by in (["g", "_salt"], ["g"]):
            ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(place)))
            salted = ranked.where(F.col("_rank") <= chunk).drop("_rank")
        heads = settled(salted)
        found = settled(own_leaders(heads))
        parts.append(found)
        last = heads.groupBy("g").agg(F.max(place).alias("last"), F.ceil(F.max("n") / chunk).cast("int").alias("blocks"))
        rest = left.join(last, "g").where(place > F.col("last"))
        rest = rest.select("g", "value", F.pmod(F.xxhash64("value"), "blocks").cast("int").alias("block"))
        wide = found.join(last, "g").select("g", "value", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        sides = (side.repartition(spread, "g", "block").groupBy("g", "block") for side in (rest, wide))
        compared = next(sides).cogroup(next(sides))
        left = unsized(settled(compared.applyInArrow(later, f"g {kind}, value string")))
        chunk = min(8 * chunk, largest)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*(F.col("g")[k].alias(k) for k in keys), F.col("value").alias(value))
