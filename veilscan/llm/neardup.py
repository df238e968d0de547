"""Near-duplicates by ProbMinHash.

A text is the multiset of its shingles (five words). Every shingle is a Poisson
process of arrivals whose rate is its weight, and each arrival falls into one of
the signature's registers; the first arrival in a register leaves its shingle there,
and a process ends as soon as its arrivals come too late for any register. Two
texts agree in a register with their probability Jaccard similarity. Bands of
registers give candidates, which are verified by the exact similarity.

Candidates are never emitted as pairs: a text with too many shingles that no other
candidate has is left out, the others are compared with one typical text of a bucket
they are in, which settles most buckets. Texts of buckets that then still hold several
groups are gathered into clusters, and a cluster is compared block by block. With p
the share of x's weight on shingles it has in common with y, and q that of y, the
similarity is at most 1 / (1/p + 1/q - 1), and just that if no shingle repeats; two
matrix products give it for all pairs of two blocks, and only what passes is measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import chunks, cut, mix, span_hashes, words
from veilscan.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A similarity is a sum of floats, which may end just below its exact value.
ROUNDING = 1e-9
BANDS, BAND_REGISTERS = 24, 5
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of a chunk, sorted by text then shingle, and the words of each text.

    A text of fewer than five words is one shingle, one without words has none.
    The weight is how often the shingle occurs.
    """
    hashes, text, first, _ = words(texts)
    counts = np.diff(first)
    n = max(len(hashes) - SHINGLE_WORDS + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        total = total * _FOLD + hashes[k : k + n]
    whole = text[:n] == text[SHINGLE_WORDS - 1 :] if n else np.zeros(0, bool)
    found, owner = mix(total[whole]), text[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    found = np.concatenate([found, span_hashes(hashes, first[short], first[short] + counts[short])])
    owner = np.concatenate([owner, short])
    order = np.argsort(found)
    order = order[np.argsort(owner[order], kind="stable")]
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], found[at], np.diff(at, append=len(found)), counts


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The shingle that arrives first in each register of each text; 0 where a text has none."""
    signature = np.zeros((texts, registers), np.uint64)
    earliest = np.full((texts, registers), np.inf)
    time, turn = np.zeros(len(shingle)), 0
    while len(shingle):
        turn += 1
        random = mix(shingle + np.uint64(turn * 0xA0761D6478BD642F % 2**64))
        time = time - np.log(((random >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / weight
        register = ((random & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        sooner = np.flatnonzero(time < earliest[owner, register])
        sooner = sooner[np.argsort(-time[sooner])]  # the earliest is written last
        earliest[owner[sooner], register[sooner]] = time[sooner]
        signature[owner[sooner], register[sooner]] = shingle[sooner]
        alive, place = np.unique(owner, return_inverse=True)
        going = time < earliest[alive].max(axis=1)[place]
        owner, shingle, weight, time = owner[going], shingle[going], weight[going], time[going]
    return signature


def similarity(x: np.ndarray, x_weight: np.ndarray, y: np.ndarray, y_weight: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted, distinct); 0 if one is empty."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = x_weight[i].astype(float), y_weight[j].astype(float)
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    # The sum over j of max(x_j / x_i, y_j / y_i) splits where y_j / x_j passes y_i / x_i.
    below = x_weight.sum() - a.sum() + np.cumsum(a)
    above = y_weight.sum() - np.cumsum(b)
    return float((1 / (below / a + above / b)).sum())


def signed(docs: DataFrame) -> DataFrame:
    """``(id, text)`` to ``(id, same, buckets)``: a digest of the words, and a hash for each band."""
    kind = docs.schema["id"].dataType.simpleString()
    registers = BANDS * BAND_REGISTERS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            owner, shingle, weight, counts = shingles(batch.column("text"))
            signature = signatures(owner, shingle, weight, batch.num_rows, registers)
            folded = signature.reshape(-1, BANDS, BAND_REGISTERS)
            bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), folded.shape[:2])
            for k in range(BAND_REGISTERS):
                bucket = mix(bucket * _FOLD + folded[:, :, k])
            hashes, _, first, _ = words(batch.column("text"))
            view = memoryview(hashes.tobytes())
            same = [hashlib.blake2b(view[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(first, first[1:], strict=False)]
            lengths = np.where(counts > 0, BANDS, 0)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = pa.array(bucket[counts > 0].reshape(-1).view(np.int64))
            columns = [batch.column("id"), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "same", "buckets"])

    return docs.select("id", "text").mapInArrow(sign, f"id {kind}, same binary, buckets array<bigint>")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)`` with their exact ``similarity``; ``texts`` is ``(id, text)``, one row for each id."""
    kind = texts.schema["id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half in chunks(batches, "text_a"):
            for batch in chunks(iter([half]), "text_b"):
                sides = []
                for side in ("a", "b"):
                    ids, place = np.unique(np.array(batch.column(side)), return_inverse=True)
                    rows = pa.array(np.unique(place, return_index=True)[1])
                    owner, shingle, weight, _ = shingles(batch.column(f"text_{side}").take(rows))
                    sides.append((place, np.searchsorted(owner, np.arange(len(ids) + 1)), shingle, weight))
                found = np.zeros(batch.num_rows)
                for k in range(batch.num_rows):
                    both = []
                    for place, starts, shingle, weight in sides:
                        here = slice(starts[place[k]], starts[place[k] + 1])
                        both += [shingle[here], weight[here]]
                    found[k] = similarity(*both)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "similarity"]
                )

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return wide.mapInArrow(verify, f"a {kind}, b {kind}, similarity double")


def lonely_share(texts: DataFrame) -> DataFrame:
    """``(id, lonely)`` of ``(id, text)``: the share of a text's weight on shingles that no other of the texts has.

    A row is there for each text with such a shingle. Only sums by shingle and
    by text are shuffled, summed within each task first.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            owner, shingle, weight, _ = shingles(batch.column("text"))
            share = weight / np.bincount(owner, weight, batch.num_rows)[owner]
            columns = [batch.column("id").take(pa.array(owner)), pa.array(shingle.view(np.int64)), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "shingle", "share"])

    each = texts.select("id", "text").mapInArrow(shares, f"id {kind}, shingle bigint, share double")
    owners = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("_last"), F.min("share").alias("share"))
    return owners.where("id = _last").groupBy("id").agg(F.sum("share").alias("lonely"))


def _may_pair(x: Column, y: Column, least: float) -> Column:
    """Whether texts of which at least these shares are not in common can be similar enough."""
    return 1 / (1 - x) + 1 / (1 - y) <= 1 + 1 / F.lit(least) + ROUNDING


def near_links(classes: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame | None:
    """Links (a, b) between classes that lead wherever candidates of ``least`` similarity lead.

    Two texts that share a bucket end up in one component if they are similar
    enough; the links are those that were needed to see so. ``classes`` is
    (id, buckets), ``docs`` (id, text); none come back if no bucket has two texts.
    """
    crowds = classes.select("id", F.explode("buckets").alias("bucket"))
    sizes = crowds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowds = cut(crowds.join(sizes, "bucket"))
    if crowds.isEmpty():
        return None
    # The more company a text has in its buckets, the more typical it is of them.
    typical = crowds.groupBy("id").agg((-F.sum("n")).alias("far"))
    texts = cut(docs.select("id", "text").join(typical, "id").dropDuplicates(["id"]))
    # A text that is too much its own can't be similar to any other.
    alone = lonely_share(texts)
    texts = texts.join(alone, "id", "left").withColumn("lonely", F.coalesce("lonely", F.lit(0.0)))
    texts = cut(texts.where(F.col("lonely") <= 1 - least + ROUNDING))
    members = cut(crowds.drop("n").join(texts.select("id", "far", "lonely"), "id"))
    centres = members.groupBy("bucket").agg(F.min(F.struct("far", "id", "lonely")).alias("centre"), F.count(F.lit(1)).alias("_n"))
    members = cut(members.join(centres.where("_n > 1").drop("_n"), "bucket"))
    # One centre for each text, so that there are no more pairs than texts.
    others = members.where("id <> centre.id").groupBy("id").agg(F.min("centre").alias("chosen"), F.first("lonely").alias("lonely"))
    chosen = cut(others.select("id", "chosen.id", "lonely", F.col("chosen.lonely").alias("_lonely")).toDF("id", "chosen", "lonely", "_lonely"))
    pairs = chosen.where(_may_pair(F.col("lonely"), F.col("_lonely"), least))
    links = compared(pairs.select(F.col("chosen").alias("a"), F.col("id").alias("b")), texts.select("id", "text"))
    links = cut(links.where(F.col("similarity") >= least - ROUNDING).select("a", "b"))
    labels = components(links)
    # Buckets that still hold several groups; their centre is left out where it was the choice of all.
    labelled = (
        members.select("bucket", "id", F.col("centre.id").alias("centre"))
        .join(chosen.select("id", "chosen"), "id", "left")
        .join(labels, "id", "left")
        .select("bucket", "id", "centre", "chosen", F.coalesce("component", "id").alias("component"))
    )
    other = F.col("id") != F.col("centre")
    ends = labelled.groupBy("bucket").agg(
        F.bool_and(~other | (F.col("chosen") == F.col("centre"))).alias("_settled"),
        F.min("component").alias("_low"),
        F.max("component").alias("_high"),
        F.min(F.when(other, F.col("component"))).alias("_low_other"),
        F.max(F.when(other, F.col("component"))).alias("_high_other"),
        F.min(F.when(other, F.col("id"))).alias("_first_other"),
    )
    several = F.when(F.col("_settled"), F.col("_low_other") < F.col("_high_other")).otherwise(F.col("_low") < F.col("_high"))
    first = F.when(F.col("_settled"), F.col("_first_other")).otherwise(F.col("centre")).alias("first")
    mixed = labelled.join(ends.where(several), "bucket").where(other | ~F.col("_settled"))
    mixed = cut(mixed.select("id", "component", first).distinct())
    if mixed.isEmpty():
        return links
    # A text leads to its smallest "first", and its other ones lead there too: about one link a text.
    lowest = mixed.groupBy("id").agg(F.min("first").alias("low"), F.collect_set("first").alias("firsts"))
    across = lowest.select(F.col("low").alias("a"), F.explode("firsts").alias("b")).where("a <> b").distinct()
    clusters = components(lowest.select(F.col("low").alias("a"), F.col("id").alias("b")).union(across))
    rest = mixed.select("id", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "id")
    return cut(links.union(block_links(rest.join(texts.select("id", "text", "lonely"), "id"), least)))


def block_links(members: DataFrame, least: float, rows: int = 256, size: int = 1 << 20) -> DataFrame:
    """Links (a, b) within clusters, between texts of different components; one for each two components at most.

    ``members`` is (id, component, cluster, text, lonely), one row for each id.
    Every cluster is dealt into blocks of about ``rows`` texts and ``size``
    bytes, and each pair of blocks is one task's work, however large the
    cluster. Two texts that both have more of their own than two equal shares
    may be are not similar, so blocks of such texts meet the other blocks only.
    """
    kind = members.schema["id"].dataType.simpleString()
    high = ~_may_pair(F.col("lonely"), F.col("lonely"), least)
    members = cut(members.withColumn("_high", high))

    def blocks(which: Column) -> Column:
        number, volume = F.count(F.when(which, 1)), F.sum(F.when(which, F.octet_length("text")).otherwise(0))
        return F.ceil(F.greatest(number / rows, volume / size)).cast("int")

    extent = members.groupBy("cluster").agg(blocks(~F.col("_high")).alias("_low_blocks"), blocks(F.col("_high")).alias("_high_blocks"))
    dealt = members.join(extent.where("_low_blocks > 0"), "cluster")
    drawn = F.pmod(F.xxhash64("id"), F.when(F.col("_high"), F.col("_high_blocks")).otherwise(F.col("_low_blocks"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("_high"), drawn + F.col("_low_blocks")).otherwise(drawn))
    last = F.when(F.col("_high"), F.col("_low_blocks")).otherwise(F.col("_low_blocks") + F.col("_high_blocks")) - 1
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    paired = dealt.select(
        "cluster", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "id", "component", "text"
    )

    def compare(group: pa.Table) -> pa.Table:
        ids, component, block = (group.column(c).to_numpy() for c in ("id", "component", "block"))
        owner, shingle, weight, _ = shingles(group.column("text").combine_chunks())
        found = _close_pairs(owner, shingle, weight, component, block, least)
        a, b = pa.array(found[:, 0]), pa.array(found[:, 1])
        columns = {"a": group.column("id").take(a), "b": group.column("id").take(b)}
        return pa.table(columns | {"of_a": group.column("component").take(a), "of_b": group.column("component").take(b)})

    found = paired.groupBy("cluster", "low", "high").applyInArrow(compare, f"a {kind}, b {kind}, of_a {kind}, of_b {kind}")
    ends = (F.least("of_a", "of_b").alias("of_a"), F.greatest("of_a", "of_b").alias("of_b"))
    return found.groupBy(*ends).agg(F.min(F.struct("a", "b")).alias("link")).select("link.*")


def _close_pairs(owner, shingle, weight, component, block, least: float) -> np.ndarray:
    """Pairs of rows of different components that are similar, enough of them to join all that are."""
    count, total = len(component), np.bincount(owner, weight, len(component))
    one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    kinds, place, seen = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = seen[place] > 1
    rows, columns, weights = owner[shared], np.unique(place[shared], return_inverse=True)[1], weight[shared]
    p, q = np.zeros((len(one), len(two)), np.float32), np.zeros((len(one), len(two)), np.float32)
    step = 8192
    for low in range(0, int(columns.max(initial=-1)) + 1, step):
        here = (columns >= low) & (columns < low + step)
        weighted = np.zeros((count, step), np.float32)
        weighted[rows[here], columns[here] - low] = weights[here]
        present = (weighted > 0).astype(np.float32)
        p += weighted[one] @ present[two].T
        q += present[one] @ weighted[two].T
    p, q = p / np.maximum(total[one], 1)[:, None], q / np.maximum(total[two], 1)[None]
    bound = np.where((p > 0) & (q > 0), 1 / (1 / np.maximum(p, 1e-9) + 1 / np.maximum(q, 1e-9) - 1), 0)
    bound[component[one][:, None] == component[two][None]] = 0
    i, j = np.nonzero(bound >= least - 1e-4)
    best = np.argsort(-bound[i, j])
    starts, parent = np.searchsorted(owner, np.arange(count + 1)), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    for a, b in zip(one[i[best]], two[j[best]], strict=True):
        x, y = root(component[a]), root(component[b])
        if x != y:
            sides = [slice(starts[k], starts[k + 1]) for k in (a, b)]
            if similarity(shingle[sides[0]], weight[sides[0]], shingle[sides[1]], weight[sides[1]]) >= least - ROUNDING:
                found.append((a, b))
                parent[x] = y
    return np.array(found, np.int64).reshape(-1, 2)


def near_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Near-duplicate groups of ``(id, text)``, ids unique and not null.

    ``(id, class_id, group_id, group_size, kept)``: a class is texts with the
    same words in the same order, named by its smallest id; a group is what
    links of ``least`` similarity or more join, named by its smallest id, which
    is the one that stays. A text without words (null and empty too) is its
    own group. Rows that repeat an id are in the group of its first class.
    """
    docs = docs.where(F.col("id").isNotNull())
    prints = cut(signed(docs))
    with_words = F.size("buckets") > 0
    classes = cut(
        prints.where(with_words)
        .groupBy("same")
        .agg(F.min("id").alias("class_id"), F.first("buckets").alias("buckets"))
    )
    links = near_links(classes.withColumnRenamed("class_id", "id").drop("same"), docs, least)
    named = classes.select("same", "class_id")
    if links is None:
        named = named.withColumn("group_id", F.col("class_id"))
    else:
        labels = components(links).select(F.col("id").alias("class_id"), "component")
        named = named.join(labels, "class_id", "left").select(
            "same", "class_id", F.coalesce("component", "class_id").alias("group_id")
        )
    found = prints.where(with_words).select("id", "same").join(named, "same").select("id", "class_id", "group_id")
    alone = prints.where(~with_words).select("id", F.col("id").alias("class_id"), F.col("id").alias("group_id"))
    rows = cut(found.union(alone))
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "group_id").select("id", "class_id", "group_id", "group_size", (F.col("id") == F.col("group_id")).alias("kept"))
