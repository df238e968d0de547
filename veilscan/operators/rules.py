"""The detector rule table.

A rule is one row: which text it reads (OCR-healed or raw), the pattern, a
cheap necessary condition, a validator and a normaliser. Detection compiles
every rule to native column expressions; adding a detector is adding a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from string import ascii_letters, digits

from pyspark.sql import Column

from veilscan.functions.checks import luhn_valid, snils_valid
from veilscan.functions.dialect import DIGIT, SPACE, WORD, WORD_END, WORD_START
from veilscan.functions.text import collapse_ws, digits_only, lower_trim

VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": luhn_valid, "snils": snils_valid}
NORMALISERS: dict[str, Callable[[Column], Column]] = {
    "digits": digits_only,
    "collapse": collapse_ws,
    "lower": lower_trim,
}


@dataclass(frozen=True)
class Rule:
    """One detector.

    ``guard`` is a pattern and ``literal`` a plain substring that every text
    with a match must hold. ``ascii_pattern`` finds the same matches, faster,
    in texts without the letters of ``FOLDING_LETTERS``. All three only save
    work and never change a result.
    """

    detector: str
    category: str
    pattern: str
    healed: bool = False
    guard: str | None = None
    literal: str | None = None
    ascii_pattern: str | None = None
    validator: str | None = None
    normaliser: str | None = None


# Categories read from the healed text, and the categories whose
# near-equal values are merged per document (and lose their line).
HEALED_CATEGORIES = frozenset(
    {"passport", "inn", "snils", "phone", "bank_card", "driver_license", "date_of_birth", "address"}
)
MERGED_CATEGORIES = ("passport", "inn", "snils", "driver_license", "full_name")

# The detector patterns, in detector order, in Java's dialect.
# (?iu) folds case for Cyrillic too. A leading (?=[...]) names the characters a
# match can start with, which is the cheapest test for the regex engine.
_D, _S, _W = DIGIT, SPACE, WORD
_SEP = rf"[{_S}\-.,_]"

PASSPORT_RF = (
    rf"(?=[ПпСс[0-9]{_D}])(?iu:"
    rf"(?:п[аa]сп[оa]рт(?:ные[{_S}]+данные)?|серия(?:[{_S}]+и[{_S}]+номер)?)[:{_S}#№]{{0,10}}"
    rf"{_D}{{2}}{_SEP}{{0,5}}{_D}{{2}}{_SEP}{{0,5}}{_D}{{6}}"
    rf"|(?<!{_D}){_D}{{2}}{_SEP}{{1,5}}{_D}{{2}}{_SEP}{{1,5}}{_D}{{6}}(?!{_D}))"
)
# The letters outside ASCII that fold to Latin i, s and k.
FOLDING_LETTERS = "İıſK"


def _passport_intl(folding: str) -> str:
    """The pattern with ``folding`` counted among the Latin letters.

    Letters are listed one by one: the engine tests such a class by one lookup.
    """
    latin, number = ascii_letters + folding, ascii_letters + digits + folding
    return (
        rf"(?=[PIACVDpiacvd{folding}])(?:"
        rf"[PIACVpiacv{folding[:2]}](?=[{latin}<]{{4}}[{number}<]{{10}})"
        rf"[{latin}<]{{1,2}}[{latin}<]{{3}}[{number}<]{{10,50}}"
        rf"|(?iu:passport|document[{_S}]*no\.?)[^A-Za-z0-9А-Яа-я{folding}]{{0,10}}[{number}]{{6,12}}{WORD_END})"
    )


PASSPORT_INTL, PASSPORT_INTL_ASCII = _passport_intl(FOLDING_LETTERS), _passport_intl("")
INN = (
    rf"(?=[Ии[0-9]{_D}])(?:(?iu:инн)[:{_S}#№]{{0,10}}{_D}{{10,12}}"
    rf"|{WORD_START}{_D}{{12}}{WORD_END})"
)
SNILS = rf"(?={_D}){WORD_START}{_D}{{3}}[-{_S}]?{_D}{{3}}[-{_S}]?{_D}{{3}}[-{_S}]{_D}{{2}}{WORD_END}"
# A word boundary before "+" holds only after a word character.
PHONE = (
    rf"(?=[+8])(?:(?<=[{_W}])\+7|{WORD_START}8)"
    rf"[-{_S}]?\(?{_D}{{3}}\)?[-{_S}]?{_D}{{3}}[-{_S}]?{_D}{{2}}[-{_S}]?{_D}{{2}}{WORD_END}"
)
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,64}\.[A-Za-z]{2,7}"
BANK_CARD = rf"(?={_D}){WORD_START}(?:{_D}{{4}}[-{_S}]?){{3}}{_D}{{4}}{WORD_END}"
DRIVER_LICENSE = rf"(?={_D}){WORD_START}{_D}{{2}}[{_S}]?[А-ЯA-Z]{{2}}[{_S}]?{_D}{{6}}{WORD_END}"
DATE_OF_BIRTH = (
    rf"(?={_D}){WORD_START}(?:{_D}{{2}}\.{_D}{{2}}\.{_D}{{4}}|{_D}{{4}}-{_D}{{2}}-{_D}{{2}}){WORD_END}"
)
ADDRESS = (
    r"(?=[гупбшнГУПБШН])(?iu)(?:г\.|город|ул\.|улица|пр-?т\.?|проспект|пер\.|переулок|"
    r"б-?р\.?|бульвар|пл\.|площадь|шоссе|набережная)"
    rf"[{_S}{_W}\-«»\"'.]{{1,100}}?(?:д\.|дом)[{_S}]*{_D}{{1,5}}[{_W}]{{0,5}}"
)
SPECIAL = (
    rf"{WORD_START}(?=[б-дил-орсэБ-ДИЛ-ОРСЭFf])(?iu)(?:"
    rf"диагноз|диабет|онкол[{_W}]{{0,30}}|вич{WORD_END}|спид{WORD_END}|"
    rf"инвалид[{_W}]{{0,30}}|группа[{_S}]{{1,5}}крови|мкб[-{_S}]?{_D}{{1,5}}|"
    rf"рецепт{WORD_END}|лечени[{_W}]{{0,30}}|госпитализац[{_W}]{{0,30}}|"
    rf"биометр[{_W}]{{0,30}}|дактилоскоп[{_W}]{{0,30}}|распознавание[{_S}]{{1,5}}лиц|"
    rf"face[{_S}_-]{{0,5}}id{WORD_END}|fingerprint{WORD_END}|"
    rf"религи[{_W}]{{0,30}}|вероисповедан[{_W}]{{0,30}}|"
    rf"национальност[{_W}]{{0,30}}|расов[{_W}]{{0,30}}|этническ[{_W}]{{0,30}})"
)

# Every number detector needs two digits, at most one separator, two digits.
NUMBER_GUARD = rf"{_D}{{2}}[-.{_S}]?{_D}{{2}}"
# An address ends in a house mark followed by its number.
ADDRESS_GUARD = rf"[Дд](?:\.|[Оо][Мм])[{_S}]*{_D}"
SPECIAL_GUARD = "(?=[FfЀ-ӿᲀ-᲏])(?:[Ѐ-ӿᲀ-᲏]|[Ff][Aa][Cc][Ee]|[Ff][IiİıI][Nn][Gg][Ee][Rr])"

DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("passport_rf", "passport", PASSPORT_RF, True, NUMBER_GUARD),
    Rule("passport_intl", "passport", PASSPORT_INTL, True, ascii_pattern=PASSPORT_INTL_ASCII),
    Rule("inn", "inn", INN, True, NUMBER_GUARD),
    Rule("snils", "snils", SNILS, True, NUMBER_GUARD, validator="snils", normaliser="digits"),
    Rule("phone", "phone", PHONE, True, NUMBER_GUARD),
    Rule("email", "email", EMAIL, literal="@"),
    Rule("bank_card", "bank_card", BANK_CARD, True, NUMBER_GUARD, validator="luhn", normaliser="digits"),
    Rule("driver_license", "driver_license", DRIVER_LICENSE, True, NUMBER_GUARD),
    Rule("date", "date_of_birth", DATE_OF_BIRTH, True, NUMBER_GUARD),
    Rule("address", "address", ADDRESS, True, ADDRESS_GUARD, normaliser="collapse"),
    Rule("special", "special_pii", SPECIAL, False, SPECIAL_GUARD, normaliser="lower"),
)


def rule(detector: str, rules: Iterable[Rule] = DEFAULT_RULES) -> Rule:
    return next(r for r in rules if r.detector == detector)


def rules_from_rows(rows: Iterable[Mapping]) -> tuple[Rule, ...]:
    """Rules from configuration rows (dicts or ``Row.asDict()``).

    ``healed`` follows the category where a row does not say.
    """
    made = []
    for row in rows:
        known = {k: v for k, v in row.items() if v is not None}
        known.setdefault("healed", known["category"] in HEALED_CATEGORIES)
        for kind, names in (("validator", VALIDATORS), ("normaliser", NORMALISERS)):
            if kind in known and known[kind] not in names:
                raise ValueError(f"unknown {kind}: {known[kind]!r}")
        made.append(Rule(**known))
    return tuple(made)
