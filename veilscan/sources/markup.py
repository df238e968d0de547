"""Text out of HTML and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5, name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.matching import bound
from veilscan.functions.text import strip

# Elements whose text is not shown, comments and declarations. An unclosed
# script, style or comment runs to the end of the page.
_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    + "".join(rf"|<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "template", "rt", "rp"))
    + r"|<[!?][^>]*>"
)
_TAG = r"""</?[a-zA-Z](?:"[^"]*+"|'[^']*+'|[^'">])*+>|</?[a-zA-Z][^>]*+>"""
_REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?"

# Named references, from the standard library's HTML 5 table, the most usual
# first. One string is far lighter in a query plan than a map of 2,000 entries.
_USUAL = ("amp", "lt", "gt", "quot", "nbsp", "apos")
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_ORDER = sorted(_NAMED, key=lambda n: (n not in _USUAL, n not in name2codepoint, n))
_ENTRY, _IS = "\x02", "\x03"
_TABLE = _ENTRY + "".join(name + _IS + _NAMED[name] + _ENTRY for name in _ORDER)
_LONGEST = max(map(len, _NAMED.values()))


def _code_point(code: Column) -> Column:
    """The character of a code point; numbers 128-159 are read as cp1252."""
    upper = "".join(bytes([b]).decode("cp1252", "replace") for b in range(128, 160))
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.between(128, 159), F.substring(F.lit(upper), (code - 127).cast("int"), F.lit(1)))
        .when(valid, char)
        .otherwise("�")
    )


def _referenced(reference: Column) -> Column:
    """What a reference stands for; numbers may have any count of leading zeros. An unknown name stays, without its semicolon."""
    name = F.rtrim(F.substring(reference, 2, 1 << 30), F.lit(";"))
    digits = F.regexp_replace(name, "^#[xX]?0*", "")
    # Eight digits or more are beyond the last code point, in either base.
    short = F.when(F.length(digits) < 8, digits)
    number = F.when(name.rlike("^#[xX]"), F.conv(short, 16, 10).try_cast("bigint")).otherwise(short.try_cast("bigint"))
    # Bound once: a lambda's argument is a value, not an expression repeated in every use.
    numeric = F.element_at(F.transform(F.array(F.coalesce(number, F.lit(0))), _code_point), 1)
    at = F.position(F.concat(F.lit(_ENTRY), name, F.lit(_IS)), F.lit(_TABLE))
    entry = F.substring(F.lit(_TABLE), at + F.length(name) + 2, F.lit(_LONGEST + 1))
    named = F.when(at > 0, F.substring_index(entry, _ENTRY, 1)).otherwise(F.concat(F.lit("&"), name))
    return F.when(name.startswith("#"), numeric).otherwise(named)


def unescape_html(text: Column) -> Column:
    """Resolve numeric and named character references in one pass, in linear time.

    The references are found once per text and paired with the pieces between them.
    """
    pieces = F.split(text, _REFERENCE, -1)
    names = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    resolved = F.zip_with(pieces, names, lambda p, n: F.concat(p, F.when(n.isNull(), "").otherwise(_referenced(n))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(resolved, "")).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: text nodes trimmed, empty ones dropped, joined by a space."""
    shown = F.regexp_replace(html, _HIDDEN, "<x>")
    nodes = F.transform(F.split(shown, _TAG, -1), lambda n: strip(unescape_html(n)))
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


TEXT_OR_ERROR = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


# A pandas UDF on purpose: Spark folds a chain of UDFs of one kind into one plan
# node and repeats every expression between them; merging uses an Arrow UDF.
@F.pandas_udf(TEXT_OR_ERROR)
def _judged_by_library(documents: pd.Series) -> pd.DataFrame:
    """(text, error) of documents that are left to the standard library."""
    rows = []
    for document in documents:
        text, error = None, None
        if document is not None:
            try:
                text = json.dumps(json.loads(document), ensure_ascii=False).encode("utf-8", "replace").decode("utf-8")
            except (ValueError, RecursionError) as problem:
                error = str(problem)
        rows.append((text, error))
    return pd.DataFrame(rows, columns=["text", "error"])


_ESCAPE = r"\\(?:u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)"
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
# Control characters are in no valid document, so they can stand for an escaped quote and a backslash.
_OWN_QUOTE, _OWN_BACKSLASH = "\x01", "\x02"
#: What plain decimal arithmetic on digits does not settle: more than 15 of them, exponents of three.
_LONG_NUMBER = "(?=[0-9]*[.eE])[0-9.]{17,}|[0-9.][eE][+-]?[0-9]{3}"


def _replaced(text: Column, pattern: str, resolve: Callable[[Column], Column]) -> Column:
    """Every match replaced by what ``resolve`` makes of it, in one pass."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(pieces, found, lambda p, n: F.concat(p, F.when(n.isNull(), "").otherwise(resolve(n)))), "")


def _decimal(number: Column) -> Column:
    """A number with a fraction or an exponent in its shortest form: 1.50 is 1.5, 1e2 is 100.0, 1e-7 is 1e-07."""
    plain = F.regexp_extract(number, "[0-9.]+", 0)
    exponent = F.coalesce(F.regexp_extract(number, "[eE]([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))
    whole = F.substring_index(plain, ".", 1)
    every = F.replace(plain, F.lit("."), F.lit(""))
    led = F.ltrim(every, F.lit("0"))
    digits = F.rtrim(led, F.lit("0"))
    point = F.length(whole) - F.length(every) + F.length(led) + exponent

    def written(v: Column) -> Column:
        d, at = v["digits"], v["point"]
        zeros = F.repeat(F.lit("0"), F.greatest(-at, at - F.length(d), F.lit(0)))
        scientific = F.concat(
            F.substring(d, 1, 1),
            F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, 2, 400))).otherwise(""),
            F.when(at > 0, "e+").otherwise("e-"),
            F.when(F.abs(at - 1) < 10, "0").otherwise(""),
            F.abs(at - 1).cast("string"),
        )
        positional = (
            F.when(at <= 0, F.concat(F.lit("0."), zeros, d))
            .when(at >= F.length(d), F.concat(d, zeros, F.lit(".0")))
            .otherwise(F.concat(d.substr(F.lit(1), at), F.lit("."), d.substr(at + 1, F.length(d))))
        )
        sign = F.when(number.startswith("-"), "-").otherwise("")
        return F.concat(sign, F.when(d == "", "0.0").when((at < -3) | (at > 16), scientific).otherwise(positional))

    return bound(F.struct(digits.alias("digits"), point.alias("point")), written)


def _between_strings(piece: Column) -> Column:
    """What stands between string literals: one space after commas and colons, numbers in their shortest form."""

    def shortest(tight: Column) -> Column:
        number = _replaced(tight, _NUMBER, lambda n: F.when(n.rlike("[.eE]"), _decimal(n)).when(n == "-0", "0").otherwise(n))
        return F.when(tight.rlike("[0-9][.eE]|-0"), number).otherwise(tight)

    found = bound(F.translate(piece, " \t\n\r", ""), shortest)
    return F.replace(F.replace(found, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))


def _escape(found: Column) -> Column:
    """An escape of a string literal in its shortest form."""
    kind = F.substring(found, 2, 1)
    high, low = F.conv(F.substring(found, 3, 4), 16, 10).cast("bigint"), F.conv(F.substring(found, 9, 4), 16, 10).cast("bigint")
    paired = F.decode(F.unhex(F.lpad(F.hex((high - 0xD800) * 1024 + low - 0xDC00 + 0x10000), 8, "0")), "UTF-32")
    short = F.element_at(F.create_map(*(F.lit(v) for pair in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")) for v in pair)), high.cast("int"))
    control = F.concat(F.lit(_OWN_BACKSLASH), F.coalesce(short, F.concat(F.lit("u"), F.lpad(F.lower(F.hex(high)), 4, "0"))))
    coded = (
        F.when(F.length(found) > 6, paired)
        .when(high < 32, control)
        .when(high == 34, _OWN_QUOTE)
        .when(high == 92, _OWN_BACKSLASH * 2)
        .when(high.between(0xD800, 0xDFFF), "?")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(high), 8, "0")), "UTF-32"))
    )
    return (
        F.when(kind == "u", coded)
        .when(kind == '"', _OWN_QUOTE)
        .when(kind == "\\", _OWN_BACKSLASH * 2)
        .when(kind == "/", "/")
        .otherwise(F.concat(F.lit(_OWN_BACKSLASH), kind))
    )


def _one_line(document: Column) -> Column:
    """A valid document on one line.

    Escapes come first, the only thing that could hide a quote; the text is then
    cut at its quotes, and every second piece is what stands between literals.
    """
    plain = F.when(F.contains(document, F.lit("\\")), _replaced(document, _ESCAPE, _escape)).otherwise(document)
    pieces = F.transform(F.split(plain, '"', -1), lambda p, i: F.when(i % 2 == 0, _between_strings(p)).otherwise(p))
    return F.replace(F.replace(F.array_join(pieces, '"'), F.lit(_OWN_QUOTE), F.lit('\\"')), F.lit(_OWN_BACKSLASH), F.lit("\\"))


def json_parse(document: Column | str) -> Column:
    """(text, error): the document (text or bytes) on one line without ASCII escapes.

    Members keep their order. Documents that Spark's parser takes are rewritten
    in the JVM; the parser ends at the first value, so it is asked within an
    array and within an object, of which trailing text breaks one. What it
    refuses (broken ones, equal names of which the last counts, NaN, very long
    ones), and numbers of more digits than decimals settle, is judged by the
    standard library, and a broken document's error is worded by it. Null
    counts as empty.
    """
    document = F.col(document) if isinstance(document, str) else document
    whole = document.cast("string")
    # Bytes that are no UTF-8 are left out.
    lenient = F.coalesce(F.regexp_replace(F.make_valid_utf8(whole), "\ufffd", ""), F.lit(""))
    text = F.when(F.is_valid_utf8(whole), whole).otherwise(lenient)

    def refused(t: Column) -> Column:
        inside = (F.concat(F.lit("["), t, F.lit("]")), F.concat(F.lit('{"":'), t, F.lit("}")))
        return F.when(F.try_parse_json(inside[0]).isNull() | F.try_parse_json(inside[1]).isNull() | t.rlike(_LONG_NUMBER), t)

    # The library sees what is refused, and gives nothing for the rest, so that nothing is parsed a second time.
    judged = _judged_by_library(bound(text, refused))
    native = judged["text"].isNull() & judged["error"].isNull()
    return F.when(native, F.struct(bound(text, _one_line).alias("text"), F.lit(None).cast("string").alias("error"))).otherwise(judged)


def json_text(document: Column) -> Column:
    """One-line JSON; null where the document does not parse."""
    return json_parse(document)["text"]
