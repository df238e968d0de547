"""Documents in parts against the same documents in one cell."""

import random

import pytest
from pyspark.sql import functions as F

from veilscan.catalog import fixtures as fx
from veilscan.functions import similarity
from veilscan.functions.matching import find_places
from veilscan.functions.similarity import leaders, leaders_of_rows
from veilscan.plans.parts import part_matches, part_verdicts
from veilscan.plans.scan import scan
from veilscan.sources.corpus import corpus_table

PIECES = [
    "серия 45 08 123456", "45 08", "123456", "ИНН: 123456789012", "123456789013", "+7 912", "345-67-89", "a@b.ru", "01.02.1999",
    "карта 4111 1111", "1111 1111", "Иванова", "Мария Петровна", "Иван Петров", "живёт: Нижний", "Новгород", "Москва", "диагноз",
    "группа", "крови", "ул. Ленина", "д. 5", "77 АР", "document no.", "71123456", "ABCDEFGHIJKLMNOPQRSTUVWX", "ок", ",", "вход по Face", "ID",
]


def listed(rows):
    return sorted((r.doc_id, r.category, r.value, r.line or 0) for r in rows)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(11)
    rows = []
    for doc in range(4):
        for page in range([1, 14, 9, 20][doc]):
            text = rng.choice(["\n", " "]).join(rng.choice(PIECES) for _ in range(rng.randint(0, 3)))
            rows.append((doc, 2 * page + doc, text))
    return spark.createDataFrame(rows, "doc_id long, page long, text string").cache()


@pytest.fixture(scope="module")
def whole(spark, pages):
    scanned = scan(corpus_table(pages), names=fx.names(spark), places=fx.places(spark)).collect()
    matches = [(r.doc_id, m.type, m.value, int(m.location.split()[1]) if m.location else 0) for r in scanned for m in r.markup.matches]
    return sorted(matches), {r.doc_id: (r.markup.categories, len(r.markup.matches), r.markup.protection_level, r.markup.recommendations) for r in scanned}


@pytest.mark.parametrize("size, context", [(5, 12), (1000, 5)])
def test_parts_equal_the_whole(spark, pages, whole, size, context):
    parts = corpus_table(pages, pages_per_part=size, context_pages=context)
    matches = part_matches(parts, names=fx.names(spark), places=fx.places(spark)).cache()
    assert listed(matches.collect()) == whole[0]
    found = {r.doc_id: (r.categories, r.total_matches, r.protection_level, r.recommendations) for r in part_verdicts(parts, matches).collect()}
    assert found == whole[1]


def test_a_match_through_several_parts(spark):
    """Numbers that overlap the next ones: what a match covers is not found again, what follows it is."""
    lines = ["45", "08", "123456", "45 08", "123456 45", "08", "123456", "x", "45 08 123456 45", "08 123456"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, page long, text string")
    want = [(m.type, m.value) for m in scan(corpus_table(pages)).first().markup.matches]
    for size in (1, 3):
        parts = corpus_table(pages, pages_per_part=size, context_pages=4)
        assert sorted((r.category, r.value) for r in part_matches(parts).collect()) == sorted(want)


def test_documents_without_anything(spark):
    pages = spark.createDataFrame([(1, 1, ""), (2, 1, None), (3, 1, "x"), (None, 1, "a@b.ru")], "doc_id long, page long, text string")
    parts = corpus_table(pages, pages_per_part=1)
    found = part_verdicts(parts, part_matches(parts)).collect()
    assert {(r.doc_id, r.total_matches, r.protection_level) for r in found} == {(3, 0, "none"), (None, 1, "low")}
    assert part_matches(parts.where("false")).count() == 0


def test_starts_and_lines(spark):
    texts = ["", "ab", "a\nab\n\nab ab", "ab" * 500, "x\ufdd0ab\ufdd1 ab", "é😀ab\nab"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", find_places(F.col("t"), "ab").alias("p"))
    for r in frame.collect():
        starts = [k for k in range(len(r.t)) if r.t.startswith("ab", k)]
        assert [(p.value, p.line, p.start) for p in r.p] == [("ab", 1 + r.t[:k].count("\n"), k) for k in starts]


@pytest.mark.parametrize("chunk", [60, 4096])
def test_leaders_of_large_groups(spark, chunk):
    rng = random.Random(chunk)
    rows = [(g, f"ИНН: {rng.randrange(10**4):012d}") for g in ("a", "b") for _ in range(90)]
    rows += [(None, v) for _, v in rows[:30]] + [("c", "x"), ("c", "x"), ("d", None), ("e", "")]
    rows += [("b", "".join(rng.choice("абвгд ") for _ in range(rng.randint(0, 12)))) for _ in range(60)]
    found = leaders_of_rows(spark.createDataFrame(rows, "k string, value string"), ["k"], chunk=chunk).collect()
    want = {g: sorted(leaders([v for k, v in rows if k == g and v is not None])) for g in ("a", "b", "c", "e", None)}
    assert {g: sorted(r.value for r in found if r.k == g) for g in want} == want and len(found) == sum(map(len, want.values()))


def test_few_rounds_for_many_leaders(spark, monkeypatch):
    """1,500 values, nearly all of them leaders: 94 rounds of 16 values, or a few that grow."""
    steps, plain = [], similarity.settled

    def counted(df):
        steps.append(df)
        assert len(steps) <= 30, "a round for each chunk"
        return plain(df)

    monkeypatch.setattr(similarity, "settled", counted)
    rng = random.Random(5)
    values = ["".join(rng.choice("абвгдежз") for _ in range(12)) for _ in range(1500)]
    values += [v[:-1] for v in values[::10]]
    found = leaders_of_rows(spark.createDataFrame([(1, v) for v in values], "k int, value string"), ["k"], chunk=16)
    assert sorted(r.value for r in found.collect()) == sorted(leaders(values))


def test_estimates_do_not_grow_with_the_rounds(spark, monkeypatch):
    """Five rounds of eight values: the planner's size of what is left is no product of all rounds' joins."""
    plain, digits = similarity.settled, []

    def measured(df):
        out = plain(df)
        digits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        assert digits[-1] <= 1000, f"a size of {digits[-1]} binary digits after {len(digits)} steps"
        return out

    monkeypatch.setattr(similarity, "settled", measured)
    monkeypatch.setattr(similarity, "ROUND", 8)
    rng = random.Random(7)
    values = ["".join(rng.choice("абвгдежз") for _ in range(12)) for _ in range(36)]
    values += [v[:-1] for v in values[::6]]
    found = leaders_of_rows(spark.createDataFrame([(1, v) for v in values], "k int, value string"), ["k"], chunk=8)
    assert sorted(r.value for r in found.collect()) == sorted(leaders(values)) and len(digits) > 20


def test_few_rounds_for_many_values(spark, monkeypatch):
    """A first chunk as large as a task compares at once does not stay the largest: 300 leaders are no 38 rounds of eight."""
    steps, plain = [], similarity.settled

    def counted(df):
        steps.append(df)
        assert len(steps) <= 20, "a round for each chunk"
        return plain(df)

    monkeypatch.setattr(similarity, "settled", counted)
    monkeypatch.setattr(similarity, "CHUNK", 8)
    rng = random.Random(13)
    values = ["".join(rng.choice("абвгдежз") for _ in range(12)) for _ in range(300)]
    values += [v[:-1] for v in values[::10]]
    found = leaders_of_rows(spark.createDataFrame([(1, v) for v in values], "k int, value string"), ["k"], chunk=8)
    assert sorted(r.value for r in found.collect()) == sorted(leaders(values))


def test_groups_are_dealt_out_after_a_join(spark, monkeypatch):
    """Groups that one task settles go to as many tasks as there are shuffle partitions, however few their bytes."""
    steps, plain = [], similarity.settled
    monkeypatch.setattr(similarity, "settled", lambda df: steps.append(plain(df)) or steps[-1])
    rows = [(k, f"{k}-{n:05d}" * 2) for k in range(30) for n in range(3 if k else 9)]
    leaders_of_rows(spark.createDataFrame(rows, "k int, value string"), ["k"], chunk=4)
    tasks = [s._jdf.rdd().getNumPartitions() for s in steps if s.columns == ["g", "value"] and s.where("g.k > 0").count()]
    assert tasks[1] == int(spark.conf.get("spark.sql.shuffle.partitions"))
