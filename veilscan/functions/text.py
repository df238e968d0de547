"""Scalar text functions, all built from native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.dialect import DIGIT, SPACE

# OCR look-alikes and the digits they are read as.
OCR_FROM = "OоОЗзBВIlS"
OCR_TO = "0003038115"

# The usual limits on how much text is looked at. The library
# scans whole texts unless one of these is passed on purpose.
MAX_SCAN_CHARS = 500_000
MAX_NAME_CHARS = 5_000

_OUTER_SPACE = rf"^[{SPACE}]+|[{SPACE}]+$"


def heal_ocr_digits(text: Column) -> Column:
    """Replace letters that OCR confuses with digits."""
    return F.translate(text, OCR_FROM, OCR_TO)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(rf"[^{SPACE}]")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(text, _OUTER_SPACE, "")


def truncate_text(text: Column, max_chars: int = MAX_SCAN_CHARS) -> Column:
    return F.substring(text, 1, max_chars)


def prefix_for_names(text: Column, max_chars: int = MAX_NAME_CHARS) -> Column:
    return F.substring(text, 1, max_chars)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, rf"[^{DIGIT}]", "")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def lower_trim(text: Column) -> Column:
    return F.lower(strip(text))


def clean_for_names(text: Column) -> Column:
    """Drop OCR noise and Latin letters, then capitalise every word."""
    noise_free = F.regexp_replace(text, r"[~|`^_\\]", " ")
    return F.initcap(collapse_ws(F.regexp_replace(noise_free, "[a-zA-Z]", "")))


def first_three_words(name: Column) -> Column:
    return F.array_join(F.slice(F.split(collapse_ws(name), " "), 1, 3), " ")


def normalize_phone(phone: Column) -> Column:
    """Bring a phone number to 7XXXXXXXXXX where its length allows it."""
    digits = digits_only(phone)
    return (
        F.when((F.length(digits) == 11) & digits.startswith("8"), F.concat(F.lit("7"), F.substring(digits, 2, 10)))
        .when(F.length(digits) == 10, F.concat(F.lit("7"), digits))
        .otherwise(digits)
    )


def file_format(path: Column) -> Column:
    """Last suffix of the file name, lower-cased, without the dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def format_key(fmt: Column) -> Column:
    return F.lower(F.regexp_replace(fmt, r"^\.+", ""))


def path_order(path: Column) -> Column:
    """Sort key that compares paths part by part."""
    return F.split(path, "/")
