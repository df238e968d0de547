"""Spelling variants by k-d trees over letter counts.

Words that are one edit apart have nearly the same letters: a replaced letter takes one
from one count and adds one to another, an inserted one adds one. So the counts of near
words are at most two apart in all, one down and one up. Words of a length form a k-d
tree over their counts. Its upper part, from a sample, deals the words into cells, and
a word asks in every cell whose box is that near; within a cell a tree of its own words
is searched in the same way. What is left is compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import chunks, code_points, cut

#: One word in so many occurrences loses a letter (by a hash), so that a corpus has misspellings to find.
SLIPS = 97
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: Words of all lengths that the upper trees are fitted on, at most about.
SAMPLE = 100_000
#: Words of a cell, about.
CELL = 16_000
#: Words of a leaf of a cell's own tree.
LEAF = 24
#: a-z, and groups of the other letters. A letter's dimension may be shared: counts then differ less, never more.
DIMENSIONS = 32

# A-Z to a-z, the letters of the class as they are, everything else to a blank; one byte is one character.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Entries of a task's own counts, before they are sent on.
_HELD = 200_000


def word_counts(docs: DataFrame, slips: int | None = SLIPS) -> DataFrame:
    """``(word, n)``: how often each word occurs in the texts of ``(id, text)``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.
    With ``slips``, a run whose crc32 of ``<id>:<run>`` it divides loses the
    letter at that crc32 modulo its length; a null id is written as nothing.
    Null and empty texts have no words. Counts are summed within a task first.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def sent() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            for key, text in zip(batch.column("key").to_pylist(), texts, strict=True):
                if not text:
                    continue
                before = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if slips:
                        sign = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
                        if not sign % slips:
                            at = sign % len(run)
                            run = run[:at] + run[at + 1 :]
                    held[run] = held.get(run, 0) + n
                if len(held) > _HELD:
                    yield sent()
        yield sent()

    keyed = docs.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "text")
    return keyed.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: pa.Array) -> np.ndarray:
    """How often each word has the letters of each dimension."""
    codes, starts = code_points(words)
    dimension = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (DIMENSIONS - 26))
    owner = np.repeat(np.arange(len(words)), np.diff(starts))
    return np.bincount(owner * DIMENSIONS + dimension, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int16)


def letters_of(words: pa.Array) -> np.ndarray:
    """Words of one length as rows of code points."""
    codes, starts = code_points(words)
    return codes.reshape(len(words), -1) if len(words) else codes.reshape(0, 0)


@dataclass
class Node:
    """A box of letter counts: the least and the most of each, and either two halves or a leaf."""

    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    halves: list[Node] = field(default_factory=list)
    number: int = -1
    blocks: int = 1


def grow(counts: np.ndarray, rows: np.ndarray, leaf: float, tight: bool = True, low=None, high=None) -> Node:
    """The tree of some rows, cut at the letter that halves them best until ``leaf`` or less are left.

    ``tight`` boxes hold just the rows; the others cover all of the space, as
    words outside a sample need it. Equal counts can't be cut.
    """
    own = counts[rows]
    if tight and len(rows):
        low, high = own.min(axis=0), own.max(axis=0)
    elif low is None:
        low, high = np.zeros(DIMENSIONS, np.int16), np.full(DIMENSIONS, np.iinfo(np.int16).max, np.int16)
    node = Node(low, high, rows)
    if len(rows) <= leaf:
        return node
    middle = np.median(own, axis=0)
    best = None
    for step in (0, -1):  # cut below or above the median
        limit = np.floor(middle).astype(np.int16) + step
        share = (own <= limit).mean(axis=0)
        letter = int(np.argmin(np.abs(share - 0.5)))
        if 0 < share[letter] < 1 and (best is None or abs(share[letter] - 0.5) < best[0]):
            best = (abs(share[letter] - 0.5), letter, int(limit[letter]))
    if best is None:
        varied = np.flatnonzero(own.min(axis=0) < own.max(axis=0))
        if not len(varied):
            return node
        best = (0, int(varied[0]), int(own[:, varied[0]].min()))
    _, letter, limit = best
    under, over = high.copy(), low.copy()
    under[letter], over[letter] = limit, limit + 1
    below = own[:, letter] <= limit
    node.rows = rows[:0]
    node.halves = [grow(counts, rows[below], leaf, tight, low, under), grow(counts, rows[~below], leaf, tight, over, high)]
    return node


def reached(node: Node, counts: np.ndarray, rows: np.ndarray, down: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves and the rows whose counts are within one up, and ``down`` (0 or 1) down, of the leaf's box."""
    own = counts[rows]
    up = np.maximum(node.low - own, 0).sum(axis=1) <= 1
    rows = rows[up & (np.maximum(own - node.high, 0).sum(axis=1) <= down)]
    if not len(rows):
        return
    if not node.halves:
        yield node, rows
    for half in node.halves:
        yield from reached(half, counts, rows, down)


def leaves(node: Node) -> Iterator[Node]:
    if not node.halves:
        yield node
    for half in node.halves:
        yield from leaves(half)


def upper_trees(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Node]:
    """A tree for each length, of a sample by hash; leaves are cells of about ``cell`` words, numbered."""
    total = words.count()
    share = min(1.0, sample / max(total, 1))
    draw = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = words.where(draw).select("word", F.length("word").alias("size")).toPandas()
    trees = {}
    for size, own in drawn.groupby("size"):
        counts = letter_counts(pa.array(own["word"].sort_values(), pa.string()))
        tree = grow(counts, np.arange(len(counts)), cell * share, tight=False)
        for number, leaf in enumerate(leaves(tree)):
            leaf.number, leaf.blocks = number, max(1, -(-len(leaf.rows) // max(int(cell * share), 1)))
            leaf.rows = leaf.rows[:0]
        trees[int(size)] = tree
    return trees


def _whole() -> Node:
    """The tree of a length that the sample does not have."""
    tree = grow(np.zeros((0, DIMENSIONS), np.int16), np.zeros(0, np.int64), 1, tight=False)
    tree.number = 0
    return tree


def dealt(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """``(size, cell, block, asks, word, n)``: each word at home in a cell, and asking in cells of near boxes.

    ``size`` is the length of the cell's words; a word asks among those of its
    own length and of one letter more. A cell that can't be cut further is dealt
    into blocks by hash, and is asked in each.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield from dealt_rows(batch.slice(at, 4096))

    def dealt_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words_, counts = batch.column("word"), letter_counts(batch.column("word"))
        lengths = pc.utf8_length(words_).to_numpy()
        for size in np.unique(lengths):
            own = np.flatnonzero(lengths == size)
            for asked, down in ((size, 1), (size + 1, 0)):
                for leaf, rows in reached(trees.get(int(asked)) or _whole(), counts, own, down):
                    blocks = np.tile(np.arange(leaf.blocks), len(rows))
                    rows = np.repeat(rows, leaf.blocks)
                    yield rows_of(batch, rows, asked, leaf.number, blocks, True)
                    if asked == size:
                        home = rows[::leaf.blocks]
                        inside = (counts[home] >= leaf.low).all(axis=1) & (counts[home] <= leaf.high).all(axis=1)
                        home = home[inside]
                        block = np.array([zlib.crc32(w.encode()) for w in words_.take(pa.array(home)).to_pylist()], np.int64) % leaf.blocks
                        yield rows_of(batch, home, size, leaf.number, block, False)

    def rows_of(batch: pa.RecordBatch, rows: np.ndarray, size: int, cell: int, block: np.ndarray, asks: bool) -> pa.RecordBatch:
        same = [pa.array(np.full(len(rows), v, np.int32)) for v in (size, cell)]
        asking = pa.array(np.full(len(rows), asks))
        taken = [batch.column(c).take(pa.array(rows)) for c in ("word", "n")]
        return pa.RecordBatch.from_arrays([*same, pa.array(block.astype(np.int32)), asking, *taken], ["size", "cell", "block", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(deal, "size int, cell int, block int, asks boolean, word string, n bigint")


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each two rows of letters are one replaced, or (``y`` one longer) one inserted letter apart."""
    size = x.shape[1]
    if y.shape[1] == size:
        return (x != y).sum(axis=1) == 1
    front = np.concatenate([x != y[:, :size], np.ones((len(x), 1), bool)], axis=1).argmax(axis=1)
    back = np.concatenate([(x != y[:, 1:])[:, ::-1], np.ones((len(x), 1), bool)], axis=1).argmax(axis=1)
    return front + back >= size


class Cell:
    """The words of a cell, all of one length, with their tree."""

    def __init__(self, words: pa.Array, places: np.ndarray) -> None:
        self.letters, self.counts, self.places = letters_of(words), letter_counts(words), places
        self.tree = grow(self.counts, np.arange(len(words)), LEAF)

    def near(self, asking: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of near words: those that ask, as long or a letter shorter, and those of the cell.

        ``places`` order words of the same length, so that a pair is found from one side only.
        """
        x, counts = letters_of(asking), letter_counts(asking)
        down = 1 if x.shape[1] == self.letters.shape[1] else 0
        found = [(np.zeros(0, np.int64),) * 2]
        for leaf, rows in reached(self.tree, counts, np.arange(len(counts)), down):
            a, b = np.repeat(rows, len(leaf.rows)), np.tile(leaf.rows, len(rows))
            if down:
                earlier = places[a] < self.places[b]
                a, b = a[earlier], b[earlier]
            close = np.abs(counts[a] - self.counts[b]).sum(axis=1) <= 2
            a, b = a[close], b[close]
            edited = one_edit(x[a], self.letters[b])
            found.append((places[a[edited]], self.places[b[edited]]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``(a, n_a, b, n_b)``: pairs of distinct words of ``(word, n)`` that one edit makes equal, each once.

    One edit inserts, deletes or replaces one code point. ``a`` is shorter, or
    smaller in code-point order. Empty words have no letters to compare and must not be given.
    """

    def searched(group: pa.Table) -> pa.Table:
        group = group.sort_by("word").combine_chunks()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        size = group.column("size")[0].as_py()
        lengths = pc.utf8_length(group.column("word")).to_numpy()
        place = np.arange(len(group))
        home = place[~asks]
        parts = [(np.zeros(0, np.int64),) * 2]
        if len(home):
            # Code-point order is the order of the sorted rows; equal words are apart by rows only, and never one edit.
            cell = Cell(group.column("word").take(pa.array(home)).combine_chunks(), home)
            for asked in (size - 1, size):
                rows = place[asks & (lengths == asked)]
                # So many words ask at a time: what is held is bounded by that and the cell.
                for at in range(0, len(rows), 1 << 14):
                    some = rows[at : at + (1 << 14)]
                    parts.append(cell.near(group.column("word").take(pa.array(some)).combine_chunks(), some))
        a, b = (pa.array(np.concatenate([p[k] for p in parts])) for k in (0, 1))
        word, n = group.column("word"), group.column("n")
        return pa.table({"a": word.take(a), "n_a": n.take(a), "b": word.take(b), "n_b": n.take(b)})

    words = cut(words.select("word", "n"))
    rows = dealt(words, upper_trees(words, sample, cell))
    return rows.groupBy("size", "cell", "block").applyInArrow(searched, "a string, n_a bigint, b string, n_b bigint")


def _order(n: Column, word: Column) -> Column:
    """Smallest for the most frequent word, then for the first in code-point order."""
    return F.struct((-n).alias("n"), word.alias("word"))


def variants(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``(word, n)``, words unique, to ``(word, form, root, n, n_near, form_n)``.

    ``form`` is the near word of largest ``n`` (ties: the first in code-point
    order) if that is at least twice the word's own, else null; ``root`` is where
    forms lead to. Numbers of occurrences at least double with each form, so no
    chain is longer than their logarithm.
    """
    words = cut(words.select("word", "n"))
    pairs = cut(near_words(words, sample, cell))
    one = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other"))
    both = one.union(pairs.select("b", "a", "n_a"))
    nearest = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(_order(F.col("n_other"), F.col("other"))).alias("best"))
    joined = words.join(nearest, "word", "left").withColumn("_formed", -F.col("best.n") >= 2 * F.col("n"))
    formed = cut(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("_formed"), F.col("best.word")).alias("form"),
            F.when(F.col("_formed"), -F.col("best.n")).alias("form_n"),
        )
    )
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(roots.join(onward, "root", "left").select("word", "root", "next"))
        roots = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.where("next is not null").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
