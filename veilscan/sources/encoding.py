"""Bytes to text with the encoding fallbacks utf-8, cp1251, latin-1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.dialect import SPACE, WORD

# cp1251 is a single-byte code page, so it is read as latin-1 and its upper half
# is mapped. Byte 0x98 is the one it leaves undefined.
_UPPER = bytes(b for b in range(0x80, 0x100) if b != 0x98)
LATIN1_UPPER, CP1251_UPPER = _UPPER.decode("latin-1"), _UPPER.decode("cp1251")
CP1251_UNDEFINED = "\x98"


def from_cp1251(latin1: Column) -> Column:
    """Text read as latin-1 that was cp1251, unless it holds the undefined byte."""
    return F.when(F.contains(latin1, F.lit(CP1251_UNDEFINED)), latin1).otherwise(
        F.translate(latin1, LATIN1_UPPER, CP1251_UPPER)
    )


def to_cp1251(text: Column) -> Column:
    """The bytes of a text in cp1251."""
    return F.encode(F.translate(text, CP1251_UPPER, LATIN1_UPPER), "ISO-8859-1")


def text_decode(content: Column) -> Column:
    """Decode with fallbacks, drop a byte order mark, unify line ends."""
    utf8 = F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")
    text = F.coalesce(F.regexp_replace(utf8, "^﻿", ""), from_cp1251(F.decode(content, "ISO-8859-1")))
    return F.regexp_replace(text, "\r\n?", "\n")


@F.pandas_udf(T.StringType())
def _utf16_leniently(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-16-le", errors="ignore"))


def binary_text_salvage(content: Column) -> Column:
    """What reads as text in an unknown binary: utf-16 and cp1251, noise blanked.

    Malformed utf-16 makes the SQL decoder fail, hence the one Python step.
    """
    cp1251 = F.translate(
        F.decode(content, "ISO-8859-1"), LATIN1_UPPER + CP1251_UNDEFINED, CP1251_UPPER
    )
    both = F.concat(_utf16_leniently(content), F.lit(" "), cp1251)
    return F.regexp_replace(both, rf"[^{WORD}{SPACE}@.,\-]", " ")
