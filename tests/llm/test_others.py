"""Licences, sharding, neighbours, registered queries and the pipeline."""

import random
import re

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from veilscan.llm import licences, neighbours, sharding
from veilscan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    ok, note = compare(QUERIES[name](spark, SF), connect(SF).sql(ORACLES[name]))
    assert ok, note


def test_licence_phrases_by_hand(spark, frame, nothing):
    rng = random.Random(4)
    words = "under the mit license apache version 2 cc by nc foo 0".split()
    texts = [*frame[1], "CC-BY-NC 4.0; Apache License, Version 2.0 under the MIT License!"]
    texts += [" ".join(rng.choice(words) for _ in range(200)) for _ in range(200)]
    texts += ["x " * 50_000 + "under the mit license cc by nc " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: r for r in licences.scan(docs).collect()}
    for i, text in enumerate(texts):
        own = licences.split_words(text or "")
        places = sorted(
            (k, label)
            for phrase, label in licences.PHRASES.items()
            for k in range(len(own))
            if own[k : k + len(phrase.split())] == phrase.split()
        )
        assert found[i].n_words == len(own) and sorted((p.start, p.label) for p in found[i].places) == places
    assert licences.scan(nothing).count() == 0


def test_licence_texts_are_covered(spark):
    notice = licences.TEMPLATES["bsd"]
    broken = re.sub("without modification", "with no change at all", notice)
    texts = [notice, "intro words " + broken + " and more", notice[: len(notice) // 3], "some other words entirely"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: [(s.label, round(s.share, 2)) for s in r.spans] for r in licences.scan(docs).collect()}
    assert found[0] == [("bsd", 1.0)] and found[1][0][0] == "bsd" and found[1][0][1] > 0.8
    assert found[2] == [] and found[3] == []


@pytest.mark.parametrize("label", sorted(licences.TEMPLATES))
def test_every_template_is_found_by_its_words(label):
    """Whole, with a word in twelve changed, and not with every fourth word changed (runs of three are too short)."""
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES)
    words = licences.split_words(licences.TEMPLATES[label])

    def shares(text):
        known = [scanner.numbers.get(w, -1) for w in text]
        matches = []
        for k in range(len(known) + 1):  # runs of known words, as the operator cuts them
            if k == len(known) or known[k] < 0:
                begin = max((i for i in range(k) if known[i] < 0), default=-1) + 1
                matches += [(s + begin, n, t, p) for s, n, t, p in scanner.runs(known[begin:k])[1]]
        return {scanner.labels[n]: share for n, _, _, share in scanner.chained(matches)}

    assert shares(words)[label] == 1.0
    changed = [w if k % 12 != 11 else "zzz" for k, w in enumerate(words)]
    runs = [len(r.split()) for r in " ".join(changed).split("zzz")]
    assert sum(n for n in runs if n >= scanner.least_match) / len(words) - 0.02 <= shares(changed)[label] <= 1.0
    assert label not in shares([w if k % 4 != 3 else "zzz" for k, w in enumerate(words)])


def test_matching_statistics_by_hand():
    rng = random.Random(9)
    lists = [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    automaton = licences.SuffixAutomaton(lists)
    runs = {tuple(x[a:b]) for x in lists for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
    items = [rng.randrange(4) for _ in range(400)]
    for at, (length, _) in enumerate(automaton.statistics(items)):
        assert length == max((n for n in range(1, 26) if tuple(items[max(at + 1 - n, 0) : at + 1]) in runs and n <= at + 1), default=0)


def extra_shards(placed, sizes):
    return sum(len({r.shard for r in placed if r.id // 1000 == g}) - 1 for g, n in enumerate(sizes) if n > 1)


@pytest.mark.parametrize(
    "sizes, most",
    [([], 0), ([1], 0), ([40] * 5 + [1] * 100, 20), ([100], 7), ([3] * 50, 14), ([1] * 7, 0), ([60, 2, 2, 2], 8), ([9] * 9, 16),
     ([2] * 100, 10), ([5] * 40, 40), ([50, 30, 1, 1, 1] + [2] * 20, 16)],
)
def test_shards(spark, sizes, most):
    rows = [(1000 * g + k, f"g{g}" if n > 1 else None) for g, n in enumerate(sizes) for k in range(n)]
    placed = sharding.shards(spark.createDataFrame(rows, "id long, key string"), 8).collect()
    counts = np.bincount([r.shard for r in placed], minlength=8)
    assert len(placed) == len(rows) and {r.id for r in placed} == {r[0] for r in rows}
    assert counts.max() - counts.min() <= 1
    for s in range(8):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(counts[s]))
    even = sum(min(n, 8) - 1 for n in sizes if n > 1)
    assert extra_shards(placed, sizes) <= min(most, even)


def least_extra(sizes, count):
    """The fewest extra shards of any even placing, by trying them all."""
    total = sum(sizes)
    caps = tuple(total // count + (s < total % count) for s in range(count))

    def splits(n, room):
        if len(room) == 1:
            return [(n,)] if n <= room[0] else []
        return [(k, *rest) for k in range(min(n, room[0]) + 1) for rest in splits(n - k, room[1:])]

    states = {caps: 0}
    for n in sizes:
        following = {}
        for room, cost in states.items():
            for split in splits(n, room):
                left = tuple(r - k for r, k in zip(room, split, strict=True))
                new = cost + sum(k > 0 for k in split) - 1
                following[left] = min(following.get(left, new), new)
        states = following
    return min(states.values())


@pytest.mark.parametrize("sizes", [[2, 2, 2, 2, 2, 2], [5, 4, 3], [6, 1, 1, 1, 3], [4, 4, 4, 2, 2]])
def test_shards_against_the_best_placing(spark, sizes):
    rows = [(1000 * g + k, f"g{g}" if n > 1 else None) for g, n in enumerate(sizes) for k in range(n)]
    placed = sharding.shards(spark.createDataFrame(rows, "id long, key string"), 3).collect()
    best = least_extra(sizes, 3)
    # One cut at each boundary between shards is what slices may cost.
    assert best <= extra_shards(placed, sizes) <= best + 2


def test_shards_of_rows_that_repeat(spark):
    rows = [(1, "a")] * 5 + [(2, None)] * 4 + [(None, None)] * 2
    placed = sharding.shards(spark.createDataFrame(rows, "id long, key string"), 4).collect()
    assert len(placed) == 11 and len({(r.shard, r.slot) for r in placed}) == 11


def test_shards_with_any_other_columns(spark):
    """Names that the operator uses itself, null and empty keys, a null id."""
    rows = [(i, ["a", "", None][i % 3] if i < 30 else f"k{i // 2}", i, "x", 2.0, None, True) for i in range(60)] + [(None, "", 7, "x", 1.0, None, False)]
    names = "id long, key string, shard int, label string, first double, hot string, _row boolean"
    placed = sharding.shards(spark.createDataFrame(rows, names), 4)
    assert placed.columns == ["id", "key", "label", "first", "hot", "_row", "shard", "slot"]
    found = placed.collect()
    assert sorted(np.bincount([r.shard for r in found])) == [15, 15, 15, 16]
    assert len({(r.shard, r.slot) for r in found}) == 61 and sum(r.id is None for r in found) == 1
    assert sum(len({r.shard for r in found if r.key == k}) - 1 for k in {r.key for r in found} - {None}) <= 5


def test_hilbert_curve_visits_neighbours():
    places = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(neighbours.hilbert_keys(places, 3))
    assert len(set(neighbours.hilbert_keys(places, 3))) == 512
    assert (np.abs(np.diff(places[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("cell_queries", [neighbours.CELL_QUERIES, 2])
def test_neighbours_against_brute_force(spark, cell_queries):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 12)).astype(np.float32)
    x[2000:2400] = x[0]
    x[2400:2403] = x[100]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] * 12), (5300, [None] * 12), (5400, []), (None, [1.0] * 12), (7, rows[7][1])]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    found = neighbours.nearest(vectors, "id % 100 = 0", cell_queries=cell_queries).collect()
    ids, hits = np.arange(3000), 0
    for q in range(0, 3000, 100):
        own = sorted((r.rank, r.id, r.score) for r in found if r.query_id == q)
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        wanted = [i for i in np.lexsort((ids, d)) if i != q][:10]
        assert [r[0] for r in own] == list(range(1, 11)) and all(r[2] == pytest.approx(d[r[1]], abs=1e-12) for r in own)
        hits += len({r[1] for r in own} & set(wanted))
        if q in (0, 2000, 2100):
            assert [r[1] for r in own] == wanted
    assert hits / 300 >= 0.9 and {r.query_id for r in found} == set(range(0, 3000, 100))
    few = neighbours.nearest(vectors.where("id in (0, 1, 2)"), "id % 100 = 0").collect()
    assert sorted(r.id for r in few) == [1, 2]
    assert neighbours.nearest(vectors.where("false"), "id % 100 = 0").count() == 0
    assert neighbours.nearest(vectors.where("id in (5000, 5100)"), "id % 100 = 0").count() == 0


def test_every_operator_has_a_query():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10


def test_pipeline(spark, tmp_path):
    """Columns, kept rows and awkward input, stage by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "no id at all", "en", "s", 1), (9001, None, "en", "s", 1), (9002, "", None, None, None), (9003, "12345", "en", "s", 5)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.where("doc_id = 3"))
    docs = docs.selectExpr("*", "1 as row", "'x' as score", "2 as id", "'y' as `same`")
    known = {r.doc_id: r.text for r in docs.collect()}
    texts = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert after.columns == docs.columns
            assert after.exceptAll(docs).isEmpty()
            texts = {r.doc_id: r.text for r in after.collect()}
            assert all(texts[i] == known[i] for i in texts)
            assert not {9001, 9002, 9003} & texts.keys()
            docs = after
    assert {r.doc_id for r in after.select("doc_id").collect()} == texts.keys()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_drops_unlearned_languages_and_letter_junk(spark):
    """A language that no label names, and random letters, go; held-back documents of the learned ones stay."""
    docs = spark.read.parquet(SF.replace("0.001", "0.1") + "/documents.parquet").where("lang is not null and text is not null")
    some = docs.where("lang in ('de', 'en', 'es')")
    foreign = docs.where("lang = 'fr' and length(text) >= 400").limit(200).withColumn("lang", F.lit(None).cast("string"))
    rng = random.Random(8)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)) for _ in range(200)]
    junk = spark.createDataFrame([(10**9 + i, t, None, None, len(t)) for i, t in enumerate(junk)], docs.schema)
    before = {"own": some, "foreign": foreign, "junk": junk}
    tagged = [d.withColumn("source", F.lit(name)) for name, d in before.items()]
    after = corpus_pipeline.known_language(spark, tagged[0].union(tagged[1]).union(tagged[2]), SF)
    left = {r["source"]: r["count"] for r in after.groupBy("source").count().collect()}
    share = {name: left.get(name, 0) / d.count() for name, d in before.items()}
    print(share)
    assert share["own"] >= 0.99 and share["foreign"] <= 0.1 and share["junk"] <= 0.01


def test_pipeline_run_against_brute_force(spark, monkeypatch):
    """``run`` on planted toxic texts, exact and near copies: what stays, and every token of it."""
    rng = random.Random(3)
    clean, toxic = [f"calm{i}" for i in range(60)], [f"vile{i}" for i in range(60)]

    def text(words, n=60):
        return " ".join(rng.choice(words) + " and the plain other words" for _ in range(n // 5))

    rows = [(i, text(clean)) for i in range(1, 201)] + [(i, text(toxic)) for i in range(201, 301)]
    labels = [(i, int(i > 200)) for i in range(1, 301) if i % 2]
    rows += [(1000 + i, rows[i][1].upper()) for i in range(5)]  # copies of 1 to 5: the largest ids stay
    long = text(clean, 300).split()
    near = [" ".join(long), " ".join([*long[:-1], "changed"]), " ".join(["other", *long[1:]])]
    rows += [(2000 + i, t) for i, t in enumerate(near)]  # the smallest id stays
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    tables = {"documents": docs, "labels": spark.createDataFrame(labels, "doc_id long, toxic int")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf, name: tables[name])
    found = corpus_pipeline.run(spark, SF).collect()
    wanted = ({*range(6, 201)} | {*range(1000, 1005)}) | {2000}
    assert {r.doc_id for r in found} == wanted, (sorted(wanted - {r.doc_id for r in found})[:9], sorted({r.doc_id for r in found} - wanted)[:9])
    places, pieces = {}, {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for every, skip in ((places, 0), (pieces, 1)):
        for parts in every.values():
            end = 0
            for part in sorted(parts):
                assert part[skip] == end
                end += part[-1]
            assert skip or end <= 1024
