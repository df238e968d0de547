"""Pattern matches with the place and the line each one starts on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Noncharacters of Unicode, which no text holds: they mark where a match begins and ends.
_MARK, _END, _INSTEAD = "\ufdd0", "\ufdd1", "\ufdd2"
#: Values that a running sum adds up at a time.
_BLOCK = 64


def find_all(text: Column, pattern: str) -> Column:
    """All non-overlapping whole matches, left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's argument is no expression repeated in every use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(values: Column) -> Column:
    """For each value of an array, the sum of those before it; by blocks, so that long arrays stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, v: a + v)

    count = F.ceil(F.size(values) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: total(F.slice(values, (b - 1) * _BLOCK + 1, _BLOCK)))
    bases = bound(blocks, lambda bs: F.transform(bs, lambda v, b: total(F.slice(bs, 1, b))))
    return bound(
        bases,
        lambda bs: F.transform(
            values,
            lambda v, i: F.get(bs, (i / _BLOCK).cast("int")) + total(F.slice(values, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
        ),
    )


def _marked(text: Column, pattern: str) -> Column:
    """The text with a mark before and one after every match: one run of the pattern."""
    own = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_END))
    clean = F.when(own, F.translate(text, _MARK + _END, _INSTEAD * 2)).otherwise(text)
    return F.regexp_replace(clean, F.lit(pattern), F.lit(_MARK + "$0" + _END))


def _values(marked: Column) -> Column:
    pieces = F.split(marked, _MARK, -1)
    return F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.substring_index(p, _END, 1))


def _lines(marked: Column) -> Column:
    return F.flatten(
        F.transform(
            F.split(marked, "\n", -1),
            lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.translate(line, _MARK, ""))),
        )
    )


def _starts(marked: Column) -> Column:
    """Where each match starts, in characters from 0: what lies before its mark, without the marks themselves."""
    lengths = F.transform(F.split(marked, _MARK, -1), lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
    return bound(lengths, lambda ls: F.slice(sums_before(ls), 2, F.size(ls)))


def _where_marked(marked: Column, found: Column, kind: str) -> Column:
    """Most texts hold no match, and are not taken apart."""
    return F.when(F.contains(marked, F.lit(_MARK)), found).when(marked.isNotNull(), F.array().cast(kind))


def find_lines(text: Column, pattern: str) -> Column:
    """Every match as (value, line), its 1-based line; the pattern runs once, and a match may itself hold newlines."""

    def found(m: Column) -> Column:
        return F.zip_with(_values(m), _lines(m), lambda v, n: F.struct(v.alias("value"), n.alias("line")))

    return bound(_marked(text, pattern), lambda m: _where_marked(m, found(m), "array<struct<value:string,line:int>>"))


def find_places(text: Column, pattern: str) -> Column:
    """Every match as (value, line, start), the number of characters before it; the pattern runs once."""

    def found(m: Column) -> Column:
        return F.transform(
            F.arrays_zip(_values(m).alias("value"), _lines(m).alias("line"), _starts(m).alias("start")),
            lambda x: F.struct(x["value"].alias("value"), x["line"].alias("line"), x["start"].alias("start")),
        )

    return bound(_marked(text, pattern), lambda m: _where_marked(m, found(m), "array<struct<value:string,line:int,start:int>>"))
