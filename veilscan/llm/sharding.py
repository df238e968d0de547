"""Sharding by balanced label propagation, in DataFrame operations alone.

Rows with an equal link key are neighbours; a key's rows with one label are a cell.
Labels begin as an even deal. Round by round a join with the key's tally sends each
cell towards the label that most of its neighbours have, as far as the quotas of the
labels allow, which are wider than a shard. At the end the linked rows stand in order
of label and key, and shards are cut out of that order at their exact sizes; what a
label has too much goes to the next shard, key by key. Rows without a neighbour fill up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import cut, numbered, salts_for, with_row

#: Priorities in which cells that want to move are admitted.
_STEPS = 1024
#: A label may hold so many times the rows of a shard while labels propagate.
_WIDE = 1.25


def _by_number(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _thresholds(wanted: list, quotas: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], int], dict]:
    """The priority below which cells of each pair of labels are admitted, and how many rows those have."""
    limit, taken = {}, {}
    for r in sorted(wanted, key=lambda r: r.step):
        pair = (r.label, r.target)
        if pair in limit:
            continue
        if taken.get(pair, 0) + r.n > quotas[pair]:
            limit[pair] = r.step
        else:
            taken[pair] = taken.get(pair, 0) + r.n
    return {p: limit.get(p, _STEPS) for p in quotas}, taken


def _admitted(wanted: list, loads: list[int], quotas: list[int]) -> dict[tuple[int, int], int]:
    """Thresholds under which no label ends above its quota (or its load, where that is above), given what leaves it too.

    All that want to move may, at first; what flows into a label that would
    end too full is cut down until none does.
    """
    flows: dict[tuple[int, int], int] = {}
    for r in wanted:
        flows[r.label, r.target] = flows.get((r.label, r.target), 0) + r.n
    while True:
        limit, taken = _thresholds(wanted, flows)
        after, inflow = list(loads), [0] * len(quotas)
        for (a, b), n in taken.items():
            after[a] -= n
            after[b] += n
            inflow[b] += n
        excess = [max(after[s] - max(quotas[s], loads[s]), 0) if inflow[s] else 0 for s in range(len(quotas))]
        if not any(excess):
            return limit
        for pair, n in taken.items():
            over = excess[pair[1]]
            if over:
                flows[pair] = min(n - 1, n * (inflow[pair[1]] - over) // inflow[pair[1]]) if n else 0


def _slices(loads: list[int], caps: list[int]) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the linked rows in order of their labels: no shard above its cap, as few rows as can be in another than their label's."""
    out, at, rest = [], 0, 0
    for s, load in enumerate(loads):
        take = min(caps[s], rest + load)
        out.append((s, at, at + take))
        at, rest = at + take, rest + load - take
    room = [caps[s] - (high - low) for s, low, high in out]
    for s, free in enumerate(room):
        take = min(free, rest)
        if take:
            out.append((s, at, at + take))
            at, rest = at + take, rest - take
    return out


def _joined(rows: DataFrame, by_key: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """``rows`` with what is known of each key; ``hot`` tells the few keys with many rows, which are not shuffled."""
    few, many = by_key.where(hot), by_key.where(~hot)
    return rows.where(hot).join(F.broadcast(few.drop("hot")), on).unionByName(rows.where(~hot).join(many.drop("hot"), on))


def _labelled(linked: DataFrame, count: int, quota: int, rounds: int) -> DataFrame:
    """``(key, first, label, n, hot)``: cells of (key, hot, first) rows with the label that they end with."""
    cells = cut(linked.groupBy("key", "hot", "first").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.col("first")))
    for turn in range(rounds):
        sums = cells.groupBy("key", "label").agg(F.sum("n").alias("n"))
        tally = F.struct("n", F.xxhash64("key", "label", F.lit(turn)).alias("h"), "label")
        tallies = sums.groupBy("key").agg(F.max(tally).alias("best"), F.collect_list(F.struct("label", "n")).alias("own"))
        of_own = F.element_at(F.filter("own", lambda c: c.label == F.col("label")), 1)["n"]
        # A label that is as strong as the best one holds on to it in every second round.
        better = (F.col("best.n") > of_own) | F.lit(turn % 2 == 0)
        moving = cut(
            cells.join(tallies, "key").select(
                "key", "hot", "first", "n", "label",
                F.when(better, F.col("best.label")).otherwise(F.col("label")).alias("target"),
                F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(_STEPS)).cast("int").alias("step"),
            )
        )
        loads = dict(moving.groupBy("label").agg(F.sum("n")).collect())
        wanted = moving.where("target <> label").groupBy("label", "target", "step").agg(F.sum("n").alias("n")).collect()
        if not wanted:
            if turn % 2 == 0:
                break
            continue
        limit = _admitted(wanted, [loads.get(s, 0) for s in range(count)], [quota] * count)
        pairs = [limit.get((a, b), 0) for a in range(count) for b in range(count)]
        allowed = F.col("step") < F.element_at(_by_number(pairs), F.col("label") * count + F.col("target") + 1)
        cells = cut(moving.withColumn("label", F.when(allowed, F.col("target")).otherwise(F.col("label"))).drop("target", "step"))
    return cells


def _ordered(linked: DataFrame, salts: int) -> DataFrame:
    """``linked`` (key, hot, label, _row) with ``place``: gapless from 0 in each label, the rows of a key side by side.

    Sums by label and key give where a key's rows begin, by parts of the keys
    and then within a part; within a key, rows are numbered, by parts where it is hot.
    """
    sums = linked.groupBy("label", "key", "hot").agg(F.count(F.lit(1)).alias("n"))
    sums = cut(sums.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(salts))))
    before = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("label", "_part").agg(F.sum("n").alias("n"))
    parts = parts.select("label", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("label", "_part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["label", "_part"])
    begins = cut(begins.select("label", "key", "hot", (F.col("_before") + F.col("_inside")).alias("_begin")))
    usual = linked.where("not hot").withColumn("_in", F.row_number().over(Window.partitionBy("label", "key").orderBy("_row")) - 1)
    many = numbered(linked.where("hot"), ["label", "key"], ["_row"], "_in", salts)
    both = _joined(usual.unionByName(many), begins, ["label", "key"], F.col("hot"))
    return both.withColumn("place", F.col("_begin") + F.col("_in")).drop("_begin", "_in")


def shards(rows: DataFrame, count: int = 8, rounds: int = 8) -> DataFrame:
    """``rows`` (id, key, ...) with ``shard`` (0 to count - 1) and ``slot`` in it.

    Row counts of shards differ by at most one. ``key`` links rows that have
    it equal; null links nothing, the empty string is a key like others. A key
    with more rows than a shard holds is spread over neighbouring shards. Every
    row is placed, rows that repeat another one too; slots are gapless from 0.
    Other columns may have any name; ``shard`` and ``slot`` of the input are replaced.
    """
    base = cut(with_row(rows, key="key").withColumn("_row", F.monotonically_increasing_id()))
    total = base.count()
    salts = salts_for(rows.sparkSession, total)
    # No more than 50 keys for each shard have so many rows.
    often = max(total // (count * 50), 1)
    sizes = base.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    sizes = cut(sizes.withColumn("hot", F.col("copies") > often))
    keyed = base.where(F.col("key").isNotNull()).join(F.broadcast(sizes.where("hot").select("key", "hot")), "key", "left")
    others = keyed.where(F.col("hot").isNull()).drop("hot").join(sizes.where("not hot").select("key", "hot"), "key", "left")
    marked = cut(keyed.where("hot").unionByName(others).unionByName(base.where(F.col("key").isNull()).withColumn("hot", F.lit(None).cast("boolean"))))
    linked = marked.where(F.col("hot").isNotNull()).withColumn("first", F.pmod(F.xxhash64("_row"), F.lit(count)).cast("int"))
    caps = [total // count + (s < total % count) for s in range(count)]
    cells = _labelled(linked, count, max(int(_WIDE * max(caps)), 1), rounds)
    labelled = cut(_joined(linked, cells.select("key", "hot", "first", "label"), ["key", "first"], F.col("hot")))
    placed = _ordered(labelled, salts)
    found = dict(labelled.groupBy("label").agg(F.count(F.lit(1))).collect())
    loads = [found.get(s, 0) for s in range(count)]
    before = [sum(loads[:s]) for s in range(count)]
    place = F.col("place") + F.element_at(_by_number(before), F.col("label") + 1)
    shard, slot, filled = F.lit(count - 1), F.lit(0), [0] * count
    for s, low, high in _slices(loads, caps):
        inside = (F.col("_place") >= low) & (F.col("_place") < high)
        shard, slot = F.when(inside, F.lit(s)).otherwise(shard), F.when(inside, F.col("_place") - low + filled[s]).otherwise(slot)
        filled[s] += high - low
    linked = placed.withColumn("_place", place).select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    single = numbered(marked.where(F.col("hot").isNull()).withColumn("_all", F.lit(0)), ["_all"], ["_row"], "_number", salts)
    shard, slot, at = F.lit(count - 1), F.lit(0), 0
    for s in range(count):
        inside = (F.col("_number") >= at) & (F.col("_number") < at + caps[s] - filled[s])
        shard, slot = F.when(inside, F.lit(s)).otherwise(shard), F.when(inside, F.col("_number") - at + filled[s]).otherwise(slot)
        at += caps[s] - filled[s]
    single = single.select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    own = [F.col("row")[c].alias(c) for c in rows.columns if c.lower() not in ("shard", "slot")]
    return linked.unionByName(single).select(*own, "shard", "slot")
