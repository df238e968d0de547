"""Similarity, merging of near-equal values, roll-ups."""

from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan.functions.similarity import leaders, native_similarity, similarity_ratio
from veilscan.operators import rollup
from veilscan.plans.scan import scan


def brute_leaders(values, threshold=0.85):
    kept = []
    for v in sorted(set(values), key=lambda v: (-len(v), v)):
        if not any(SequenceMatcher(None, v, k).ratio() > threshold for k in kept):
            kept.append(v)
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("0123 ин", min_size=0, max_size=14), max_size=25))
def test_leaders_equal_brute_force(values):
    assert leaders(values) == brute_leaders(values)


def test_leaders_of_many_values():
    values = [f"{100000000000 + i * 7919}" for i in range(3000)]
    assert leaders(values[:400]) == brute_leaders(values[:400])
    assert 0 < len(leaders(values)) < 3000


def test_known_ratios(spark):
    pairs = [("ИНН 123456789012", "123456789012"), ("ИНН: 123456789012", "123456789012"), ("12345678901", "12345678902"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(similarity_ratio("a", "b"), native_similarity(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 3) for r in rows] == [0.857, 0.828, 0.909, 1.0]
    assert [round(r[1], 3) for r in rows[:3]] == [0.857, 0.828, 0.909]


def test_merging_in_a_document(texts_df):
    text = "123456789012 и ИНН 123456789012 и 123456789013\nИНН: 999999999999\nпочта a@b.ru a@b.ru"
    for similarity in ("exact", "native"):
        markup = scan(texts_df([text]), similarity=similarity).first().markup
        assert [(m.type, m.value, m.location) for m in markup.matches] == [
            ("email", "a@b.ru", "строка 3"),
            ("email", "a@b.ru", "строка 3"),
            ("inn", "ИНН: 999999999999", None),
            ("inn", "ИНН 123456789012", None),
            # Near the bare number, but the leader is the longer form.
            *([("inn", "123456789013", None)] if not _near("123456789013", "ИНН 123456789012", similarity) else []),
        ]


def _near(a, b, similarity):
    if similarity == "exact":
        return SequenceMatcher(None, a, b).ratio() > 0.85
    return False


def test_levels_and_measures(spark):
    rows = [([],), (["email"],), (["address", "date_of_birth"],), (["a", "b", "snils"],), (list("abcde"),), (["special_pii", *"abcdef"],)]
    df = spark.createDataFrame(rows, "c array<string>")
    out = df.select(rollup.protection_level(F.size("c")).alias("level"), rollup.recommendations(F.col("c")).alias("r")).collect()
    assert [r.level for r in out] == ["none", "low", "low", "medium", "high", "critical"]
    assert [r.r for r in out] == [
        [],
        ["Уведомить владельца данных"],
        [],
        ["Ограничить доступ к файлу", "Зашифровать хранилище", "Провести аудит доступа"],
        ["Провести аудит доступа"],
        ["Применить законодательство о биометрических данных", "Провести аудит доступа"],
    ]


def test_clean_document_is_reported_as_none(texts_df):
    markup = scan(texts_df([" \n"])).first().markup
    assert (markup.categories, markup.matches, markup.protection_level, markup.recommendations) == ([], [], "none", [])
