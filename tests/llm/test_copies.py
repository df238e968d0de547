"""Exact and near copies against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import exact, neardup
from veilscan.llm.components import components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_by_hand(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    return groups


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_groups(spark, frame, nothing, digest_bytes):
    docs, texts = frame
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(40_000))
    more = [(100, long), (101, long[:-1]), (102, long.upper()), (103, long[:20_000] + "X" + long[20_001:]), (103, long), (None, long), (4, texts[4])]
    docs = docs.union(spark.createDataFrame(more, "id long, text string"))
    rows = [*enumerate(texts), *more]
    found = sorted(tuple(r) for r in exact.exact_groups(docs, digest_bytes).drop("text_sha256").fillna(-1).collect())
    wanted = []
    for ids in groups_by_hand(rows).values():
        keep = max(i for i in ids if i is not None)
        wanted += [(-1 if i is None else i, keep, len(ids), i == keep) for i in ids]
    assert found == sorted(wanted)
    assert exact.exact_groups(nothing).count() == 0


def test_a_short_digest_is_ambiguous(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(600)], "id long, text string")
    assert exact.ambiguous_digests(docs, 1) and not exact.ambiguous_digests(docs)
    assert exact.exact_groups(docs, 1).where("group_size > 1").count() == 0


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    out = {}
    for k in range(max(1, len(words) - 4) if words else 0):
        out[tuple(words[k : k + 5])] = out.get(tuple(words[k : k + 5]), 0) + 1
    return out


def by_definition(x, y):
    x = {k: v / sum(x.values()) for k, v in x.items()}
    y = {k: v / sum(y.values()) for k, v in y.items()}
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))


def noisy(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = "w%06d" % rng.randrange(10**6)
    return " ".join(out)


def test_similarity_is_probability_jaccard():
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.choice("abcdefg") for _ in range(rng.randint(1, 60))]
        a, b = " ".join(words), noisy(rng, words, rng.randint(0, 8))
        owner, shingle, weight, _ = neardup.shingles(pa.array([a, b]))
        got = neardup.similarity(shingle[owner == 0], weight[owner == 0], shingle[owner == 1], weight[owner == 1])
        assert got == pytest.approx(by_definition(shingles(a), shingles(b)))


def test_signatures_estimate_it():
    words = [f"t{i}" for i in range(200)]
    a, b = " ".join(words), " ".join(words[:150] + [f"u{i}" for i in range(50)])
    owner, shingle, weight, _ = neardup.shingles(pa.array([a, b, a]))
    s = neardup.signatures(owner, shingle, weight, 3, 2000)
    assert (s > 0).all() and (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - by_definition(shingles(a), shingles(b))) < 0.04


def test_near_groups_against_all_pairs(spark, frame, nothing):
    """A hot family with every degree of likeness, small families, chains and clean texts."""
    rng = random.Random(5)
    rows = list(enumerate(frame[1]))
    family = [f"f{i}" for i in range(150)]
    rows += [(1000 + i, noisy(rng, family, rng.randint(0, 9))) for i in range(120)]
    for f in range(12):
        base = [f"g{f}x{i}" for i in range(100)]
        rows += [(2000 + 10 * f + i, noisy(rng, base, i)) for i in range(4)]
    chain = [f"c{i}" for i in range(140)]
    rows += [(3000 + i, " ".join(chain[8 * i : 8 * i + 90])) for i in range(6)]
    rows += [(4000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(80))) for i in range(40)]
    rows += [(5000, rows[20][1].upper()), (5001, (rows[20][1] + " ") * 2)]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = {r.id: r for r in neardup.near_groups(docs).collect()}
    assert len(found) == len(rows)
    have, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i, t in rows if have[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(have[a].keys() & have[b].keys()) * 3 > len(have[a]) and by_definition(have[a], have[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    wrong = [i for i in found if found[i].group_id != root(i)]
    assert not wrong, wrong
    assert all(found[i].kept == (found[i].group_id == i) for i in found)
    assert neardup.near_groups(nothing).count() == 0
    twice = neardup.near_groups(docs.where("id < 15").union(docs.where("id < 15")))
    assert twice.count() == 30 and twice.where("group_id <> id").count() == 4


@pytest.mark.parametrize("shared, every", [(12, 15), (48, 60), (52, 65), (60, 75), (64, 80)])
def test_a_similarity_of_just_the_limit_is_near(spark, shared, every):
    """Texts that begin a longer one, at exactly 0.8, and one shingle short of it."""
    words = [f"e{i}" for i in range(every + 4)]
    x, y, below = " ".join(words), " ".join(words[: shared + 4]), " ".join(words[: shared + 3])
    have = pa.array([x, y])
    owner, shingle, weight, _ = neardup.shingles(have)
    assert list(weight) == [1] * (shared + every) and 5 * shared == 4 * every
    docs = spark.createDataFrame([(1, x), (2, y)], "id long, text string")
    assert [r.group_id for r in neardup.near_groups(docs).collect()] == [1, 1]
    docs = spark.createDataFrame([(1, x), (2, below)], "id long, text string")
    assert sorted(r.group_id for r in neardup.near_groups(docs).collect()) == [1, 2]
    # The comparison by blocks has its own limit.
    side = np.array([0, 1])
    assert len(neardup._close_pairs(owner, shingle, weight, side, side, 0.8)) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}
