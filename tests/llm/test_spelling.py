"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import spelling
from veilscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, slips=97):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            sign = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and sign % slips == 0:
                run = run[: sign % len(run)] + run[sign % len(run) + 1 :]
            out[run] += 1
    return out


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def by_hand(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        forms[w] = form
        out[w] = (form, n, len(near), counts[form] if form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def made(rng, number):
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(number)]
    for _ in range(3 * number):
        w = rng.choice(base)
        k = rng.randrange(len(w))
        base.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxÿ") + w[k:], w[:k] + rng.choice("abcxÿ") + w[k + 1 :]]))
    return {w: rng.choice([1, 2, 3, 5, 8, 13, 40]) for w in base if w}


@pytest.mark.parametrize("sample, cell", [(100_000, 2_000), (100_000, 20), (150, 10), (1, 5)])
def test_variants_against_all_words(spark, sample, cell):
    rng = random.Random(7)
    counts = made(rng, 300)
    # Words of the same letters can't be cut apart by counts.
    counts |= {"".join(rng.sample("abcdefgh", 8)): 4 for _ in range(60)} | {"a" * k: 3 for k in range(1, 60)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {tuple(r) for r in spelling.variants(words, sample, cell).collect()}
    assert found == by_hand(counts)


def test_word_counts(spark, frame, nothing):
    docs, texts = frame
    more = "Ärger ärger ÄRGER naïve×÷ÿ don't a" + "B" * 5000 + " ſtar İx word " + " ".join(f"some{k}word" for k in "abcdefghij") * 40
    rows = [*enumerate(texts), (4, texts[4]), *((k, more) for k in range(100, 160)), (None, more)]
    given = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "id long, text string, n int, key string")
    assert {r.word: r.n for r in spelling.word_counts(given).collect()} == dict(counted(rows))
    assert {r.word: r.n for r in spelling.word_counts(given, slips=None).collect()} == dict(counted(rows, None))
    assert spelling.word_counts(nothing).count() == 0
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0


def test_tree_boxes_hold_their_words():
    rng = random.Random(2)
    words = pa.array(["".join(rng.choice("abcdef") for _ in range(7)) for _ in range(800)])
    counts = spelling.letter_counts(words)
    tree = spelling.grow(counts, np.arange(800), 20)
    ends = list(spelling.leaves(tree))
    assert sorted(r for leaf in ends for r in leaf.rows) == list(range(800))
    for leaf in ends:
        own = counts[leaf.rows]
        assert (own >= leaf.low).all() and (own <= leaf.high).all()
    # Box pruning leaves most leaves out.
    asked = sum(len(rows) for _, rows in spelling.reached(tree, counts, np.arange(800), 1))
    assert asked < 0.6 * 800 * len(ends)


def test_query_against_all_words(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = {w: n for w, n in counted(rows).items() if len(w) >= 5 and n >= 3}
    found = {tuple(r) for r in QUERIES["op13_spelling"](spark, SF).collect()}
    assert found == by_hand(counts) and len(found) > 100
