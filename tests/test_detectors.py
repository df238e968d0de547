"""What each detector finds, quirks included."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan.operators.detect import detect, explode_matches
from veilscan.plans.scan import scan

# text -> matches as (detector, value, line)
CASES = {
    "паспорт 1234567890": [],  # the keyword itself is healed away
    "серия 1234567890": [("passport_rf", "серия 1234567890", 1)],
    "серия и номер 1234567890": [],
    "СЕРИЯ №: 45 08 123456": [("passport_rf", "СЕРИЯ №: 45 08 123456", 1)],
    "x 45 08 123456 y": [("passport_rf", "45 08 123456", 1)],
    "x 145 08 123456 y": [],
    "x 45 08 1234567 y": [],
    "45\n08\n123456": [("passport_rf", "45\n08\n123456", 1)],
    "т +7 999 123-45-67": [],  # no word boundary between a space and a plus
    "т 8 999 123-45-67": [("phone", "8 999 123-45-67", 1)],
    "т8+7 999 123-45-67": [("phone", "+7 999 123-45-67", 1)],
    "т 8(999)123-45-67.": [("phone", "8(999)123-45-67", 1)],
    "т 8 999 123-45-678": [],
    "x ул. Ленина, д. 5": [],
    "x ул. Ленина д. 5": [("address", "ул. Ленина д. 5", 1)],
    "x\nул.  Мира \n д.  12к3": [("address", "ул. Мира д. 12к3", 2)],
    "город Омск дом 5": [],
    "город Омск д. 5": [],
    "ул. Московская д. 5": [("address", "ул. М0ск0вская д. 5", 1)],
    "декабря в д. 5": [("address", "бря в д. 5", 1)],
    "права 77 ОВ 123456": [("passport_rf", "77 08 123456", 1)],
    "права 77 АР 123456": [("driver_license", "77 АР 123456", 1)],
    "права 77ар123456": [],
    "ИНН: 1234567890123": [("inn", "ИНН: 123456789012", 1)],
    "ИНН 1234567890": [("inn", "ИНН 1234567890", 1)],
    "№ 123456789012 ок": [("inn", "123456789012", 1)],
    "№ 1234567890123 ок": [],
    "internationalisation": [("passport_intl", "internationa1isation", 1)],  # l is healed
    "passport AB1234567": [("passport_intl", "passport A31234567", 1)],
    "PASSPORT AB1234567": [],
    "document no. 71 ": [],
    "document no: 7112345 ": [("passport_intl", "document no: 7112345", 1)],
    "ıınternatıonalısatıon": [("passport_intl", "ıınternatıona1ısatıon", 1)],
    "99.99.9999 и 2024-13-45": [("date", "99.99.9999", 1), ("date", "2024-13-45", 1)],
    "112-233-445 95": [("snils", "11223344595", 1)],
    "112-233-445 96": [],
    "11223344595": [],
    "001-001-998 77": [("snils", "00100199877", 1)],
    "4111 1111 1111 1111": [("bank_card", "4111111111111111", 1)],
    "4111-1111-1111-1112": [],
    "a\n\nb c@d.org e@f.ru": [("email", "c@d.org", 3), ("email", "e@f.ru", 3)],
    "Диагноз: ДИАБЕТ, вич.": [("special", "диагноз", 1), ("special", "диабет", 1), ("special", "вич", 1)],
    "вичи спидометр предиагноз": [],
    "лечение  в  больнице": [("special", "лечение", 1)],
    "Группа  крови, Face_ID, МКБ-10": [
        ("special", "группа  крови", 1), ("special", "face_id", 1), ("special", "мкб-10", 1),
    ],
    "группа крови, МКБ 10, онкологию": [
        ("special", "группа крови", 1), ("special", "мкб 10", 1), ("special", "онкологию", 1),
    ],
    "": [],
    "  \n\t ": [],
}


@pytest.fixture(scope="module")
def found(texts_df):
    df = explode_matches(detect(texts_df(list(CASES))))
    by_doc = {i: [] for i in range(len(CASES))}
    for r in df.orderBy("doc_id", "ord").collect():
        by_doc[r.doc_id].append((r.detector, r.value, r.line))
    return by_doc


@pytest.mark.parametrize("i", range(len(CASES)), ids=list(CASES))
def test_case(found, i):
    text = list(CASES)[i]
    assert found[i] == CASES[text]


def test_overlap_counts_in_both_categories(texts_df):
    rows = scan(texts_df(["серия 45 08 123456 дата 01.02.1990 01.02.1990"])).first().markup
    assert rows.categories == ["date_of_birth", "passport"]
    assert [m.type for m in rows.matches] == ["date_of_birth", "date_of_birth", "passport"]
    assert [m.location for m in rows.matches] == ["строка 1", "строка 1", None]


def test_max_chars_is_a_choice(texts_df):
    df = texts_df(["x" * 600_000 + " 2024-01-02"])
    assert scan(df).first().markup.categories == ["date_of_birth"]
    assert scan(df, max_chars=500_000).first().markup.categories == []


def _luhn_digit(body: str) -> str:
    total = sum((d * 2 - 9 if d * 2 > 9 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _control(number: str) -> str:
    return f"{sum(int(d) * (9 - i) for i, d in enumerate(number)) % 101 % 100:02d}"


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    cards=st.lists(st.text("0123456789", min_size=15, max_size=15), min_size=20, max_size=20),
    numbers=st.lists(st.integers(1001999, 999999999), min_size=20, max_size=20),
    where=st.integers(0, 15),
)
def test_checksums_are_sharp(texts_df, cards, numbers, where):
    """A valid number is found; the same number with one digit changed is not."""
    good = [c + _luhn_digit(c) for c in cards]
    bad = [c[:where] + str((int(c[where]) + 1) % 10) + c[where + 1 :] for c in good]
    snils = [f"{n:09d}" for n in numbers]
    snils_bad = [f"{n} {(int(_control(n)) + 1) % 100:02d}" for n in snils]
    texts = good + bad + [f"{n} {_control(n)}" for n in snils] + snils_bad
    rows = detect(texts_df(texts), lines=False).select("doc_id", F.transform("matches", lambda m: m["detector"]).alias("ds"))
    hits = {r.doc_id: set(r.ds) for r in rows.collect()}
    assert all("bank_card" in hits[i] for i in range(20))
    assert not any("bank_card" in hits[i] for i in range(20, 40))
    assert all("snils" in hits[i] for i in range(40, 60))
    assert not any("snils" in hits[i] for i in range(60, 80))


def test_scan_does_not_depend_on_partitioning(spark, sf):
    from veilscan.catalog.fixtures import pii_docs

    df = pii_docs(spark, sf)
    one = {r.doc_id: r.markup for r in scan(df.coalesce(1)).collect()}
    many = {r.doc_id: r.markup for r in scan(df.orderBy(F.rand(7)).repartition(13)).collect()}
    assert one == many
