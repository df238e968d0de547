"""Checksum validators as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.text import digits_only

# Numbers up to this one were issued before the control digits existed.
SNILS_UNCHECKED_UP_TO = 1001998

_OTHER_DIGITS = [chr(c) for c in range(0x80, 0xD800) if unicodedata.category(chr(c)) == "Nd"]


def _plain_digits(text: Column) -> Column:
    """Digits only, every script's decimal digits written as 0-9."""
    return F.translate(
        digits_only(text), "".join(_OTHER_DIGITS), "".join(str(unicodedata.digit(d)) for d in _OTHER_DIGITS)
    )


def luhn_valid(card: Column) -> Column:
    """Luhn checksum over the digits; fewer than 13 digits never pass."""
    digits = _plain_digits(card)
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.transform(places, lambda d: d.try_cast("int")),
            lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return F.when(F.length(digits) < 13, F.lit(False)).otherwise(F.coalesce(total % 10 == 0, F.lit(False)))


def snils_valid(number: Column) -> Column:
    """Control digits of an insurance number: weights 9..1, modulo 101."""
    digits = _plain_digits(number)

    def place(i: int) -> Column:
        return F.substring(digits, i + 1, 1).try_cast("int")

    weighted = sum((place(i) * (9 - i) for i in range(1, 9)), place(0) * 9)
    control = F.when(weighted % 101 == 100, 0).otherwise(weighted % 101)
    unchecked = F.substring(digits, 1, 9).try_cast("int") <= SNILS_UNCHECKED_UP_TO
    ok = unchecked | (control == F.substring(digits, 10, 2).try_cast("int"))
    return F.when(F.length(digits) == 11, F.coalesce(ok, F.lit(False))).otherwise(F.lit(False))
