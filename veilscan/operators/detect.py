"""Detectors side by side over one scan of the text.

Everything here is narrow: each document becomes arrays of matches in its own
row, so detection never shuffles. ``explode_matches`` gives the long form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.matching import find_all, find_lines, find_places
from veilscan.functions.similarity import leaders_exact, leaders_native
from veilscan.functions.text import heal_ocr_digits, truncate_text
from veilscan.operators.rules import (
    DEFAULT_RULES,
    FOLDING_LETTERS,
    MERGED_CATEGORIES,
    NORMALISERS,
    VALIDATORS,
    Rule,
)

MATCH = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)
MATCHES = T.ArrayType(MATCH)

_RAW, _HEALED, _OWN_LINES = "_raw", "_healed", "_own_lines"


@dataclass(frozen=True)
class Plugin:
    """A detector given as a column function ``text -> array<match>``.

    Wrap Python code in a pandas or Arrow UDF that returns ``MATCHES``;
    ``isolated`` keeps a failing one from failing the job.
    """

    detector: str
    category: str
    find: Callable[[Column], Column]
    healed: bool = False


#: The category of the record that a failing plug-in leaves.
FAILURE = "detector_failure"


def isolated(
    detect: Callable[[str], list[tuple[str, str, int | None]]], detector: str, record: bool = False
) -> Callable[[Column], Column]:
    """A plug-in UDF around ``text -> [(category, value, line)]``.

    A text on which ``detect`` raises yields no matches from this detector and
    leaves those of every other detector in place. With ``record`` it yields
    one match of category ``detector_failure`` whose value is the error's
    kind, for ``detector_failures`` to count.
    """

    @F.pandas_udf(MATCHES)
    def run(texts):
        def one(text):
            try:
                return [
                    {"category": c, "detector": detector, "value": v, "line": n} for c, v, n in detect(text or "")
                ]
            except Exception as problem:
                failure = {"category": FAILURE, "detector": detector, "value": type(problem).__name__, "line": None}
                return [failure] if record else []

        return texts.map(one)

    return run


def with_sources(df: DataFrame, text: Column, *carried: str | Column) -> DataFrame:
    """``carried`` and the two forms in which detectors read a text: as it is, and healed."""
    df = df.select(*carried, text.alias(_RAW))
    names = [c for c in df.columns if c != _RAW]
    return df.select(*(F.col(f"`{c}`") for c in names), _RAW, heal_ocr_digits(F.col(_RAW)).alias(_HEALED))


def source_of(healed: bool) -> Column:
    """The form of the text, from ``with_sources``, that a detector reads."""
    return F.col(_HEALED if healed else _RAW)


def _source(rule: Rule | Plugin) -> Column:
    return source_of(rule.healed)


def _may_match(rule: Rule, guards: dict) -> Column | None:
    condition = None
    if rule.literal is not None:
        condition = F.contains(_source(rule), F.lit(rule.literal))
    if rule.guard is not None:
        flag = F.col(guards[rule.healed, rule.guard])
        condition = flag if condition is None else condition & flag
    return condition


def _found(rule: Rule, guards: dict, find: Callable[[Column, str], Column], kind: str) -> Column:
    """What ``find`` gives for a rule's pattern, on the texts that may hold a match; the pattern runs once."""
    values, condition = find(_source(rule), rule.pattern), _may_match(rule, guards)
    if rule.ascii_pattern is not None:
        folding = reduce(or_, (F.contains(_source(rule), F.lit(c)) for c in FOLDING_LETTERS))
        values = F.when(folding, values).otherwise(find(_source(rule), rule.ascii_pattern))
    if condition is not None:
        values = F.when(condition, values).otherwise(F.array().cast(kind))
    return values.alias(f"_v_{rule.detector}")


def _shape(rule: Rule, lines: bool) -> Column:
    """The rule's found values as match structs, validated and normalised."""
    values = F.col(f"_v_{rule.detector}")

    def match(value: Column, line: Column) -> Column:
        return F.struct(
            F.lit(rule.category).alias("category"),
            F.lit(rule.detector).alias("detector"),
            value.alias("value"),
            line.cast("int").alias("line"),
        )

    if lines:
        shaped = F.transform(values, lambda v: match(v["value"], v["line"]))
    else:
        shaped = F.transform(values, lambda v: match(v, F.lit(None)))
    if rule.validator:
        check = VALIDATORS[rule.validator]
        shaped = F.filter(shaped, lambda m: check(m["value"]))
    if rule.normaliser:
        clean = NORMALISERS[rule.normaliser]
        shaped = F.transform(shaped, lambda m: m.withField("value", clean(m["value"])))
    return F.when(F.size(values) > 0, shaped).otherwise(F.array().cast(MATCHES))


_WITH_LINES = "array<struct<value:string,line:int>>"
_WITH_PLACES = "array<struct<value:string,line:int,start:int>>"


def _guarded(df: DataFrame, carried: Sequence[str], rules: Sequence[Rule]) -> tuple[DataFrame, dict]:
    """The sources with the outcome of every guard, and under which name each is."""
    guards = {(r.healed, r.guard): None for r in rules if r.guard is not None}
    guards = {key: f"_g{i}" for i, key in enumerate(guards)}
    flags = (source_of(healed).rlike(p).alias(name) for (healed, p), name in guards.items())
    return df.select(*carried, _RAW, _HEALED, *flags), guards


def raw_places(df: DataFrame, text: Column, carried: Sequence[str], rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """``carried`` and (detector, value, line, start): every match of every rule as found, neither validated nor normalised."""
    df, guards = _guarded(with_sources(df, text, *carried), carried, rules)
    df = df.select(*carried, *(_found(r, guards, find_places, _WITH_PLACES) for r in rules))

    def named(r: Rule) -> Column:
        own = F.lit(r.detector).alias("detector")
        return F.transform(
            f"_v_{r.detector}", lambda v: F.struct(own, v["value"].alias("value"), v["line"].alias("line"), v["start"].alias("start"))
        )

    return df.select(*carried, F.explode_outer(F.concat(*map(named, rules))).alias("_p")).where("_p is not null").select(*carried, "_p.*")


def checked(matches: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rows with (detector, value) of ``raw_places``: those that their rule's validator takes, normalised, with ``category``."""
    value, holds, category = F.col("value"), F.lit(True), F.lit(None).cast("string")
    for r in rules:
        own = F.col("detector") == r.detector
        category = F.when(own, r.category).otherwise(category)
        if r.normaliser:
            value = F.when(own, NORMALISERS[r.normaliser](F.col("value"))).otherwise(value)
        if r.validator:
            holds = F.when(own, VALIDATORS[r.validator](F.col("value"))).otherwise(holds)
    return matches.where(holds).withColumn("category", category).withColumn("value", value)


def clashing(columns: Iterable[str]) -> bool:
    """Whether input columns have names that the detectors use themselves."""
    return any(c.startswith("_") or c.lower() in ("matches", "markup", "name_matches") for c in columns)


def set_aside(
    df: DataFrame, carried: Sequence[str], text: str, context: str | None
) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """The input under names that can't clash, and a function that gives the names back to a result.

    An input column named like the result's new column is replaced by it.
    """
    used = [F.col(f"`{c}`").alias(n) for c, n in ((text, "text"), (context, "context")) if c]
    safe = df.select(*(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(carried)), *used)

    def named_back(out: DataFrame, new: str) -> DataFrame:
        return out.select(*(F.col(f"kept{i}").alias(c) for i, c in enumerate(carried) if c.lower() != new), new)

    return safe, named_back


def detect(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = DEFAULT_RULES,
    plugins: Sequence[Plugin] = (),
    lines: bool | str = True,
    max_chars: int | None = None,
    keep: Sequence[str] | None = None,
    context: str | None = None,
) -> DataFrame:
    """Add ``matches``: all detectors' matches, in detector order.

    ``lines`` may be ``"kept"``: lines only where they survive the merging of
    near-equal values. ``keep`` names the columns to carry (all but the text
    by default, so that no later step drags the text along).

    ``context`` names a column with the text that follows, for texts that are
    parts of a longer one: matches may run into it, but those that start in it
    are left to the next part.
    """
    carried = [c for c in df.columns if c not in (text, context)] if keep is None else list(keep)
    if clashing(carried):
        safe, named_back = set_aside(df, carried, text, context)
        options = {"rules": rules, "plugins": plugins, "lines": lines, "max_chars": max_chars}
        return named_back(detect(safe, "text", context=context and "context", **options), "matches")
    raw = F.coalesce(F.col(text), F.lit(""))
    if context is not None:
        own_lines = F.when(F.col(context).isNotNull(), 1 + F.length(raw) - F.length(F.translate(raw, "\n", "")))
        df = df.withColumn(_OWN_LINES, own_lines)
        carried, lines = [*carried, _OWN_LINES], True
        raw = F.concat_ws("\n", raw, F.col(context))
    if max_chars is not None:
        raw = truncate_text(raw, max_chars)
    df, guards = _guarded(with_sources(df, raw, *carried), carried, rules)

    def wants_line(r: Rule) -> bool:
        return r.category not in MERGED_CATEGORIES if lines == "kept" else bool(lines)

    found = [
        _found(r, guards, find_lines, _WITH_LINES) if wants_line(r) else _found(r, guards, find_all, "array<string>") for r in rules
    ]
    df = df.select(*carried, _RAW, _HEALED, *found)
    parts = [_shape(r, wants_line(r)) for r in rules]
    parts += [F.coalesce(p.find(_source(p)), F.array().cast(MATCHES)) for p in plugins]
    df = df.select(*carried, (F.concat(*parts) if parts else F.array().cast(MATCHES)).alias("matches"))
    if context is None:
        return df
    # A plug-in may give no line; such a match is kept.
    own = F.filter("matches", lambda m: F.coalesce(m["line"] <= F.col(_OWN_LINES), F.lit(True)))
    return df.select(*carried[:-1], own.alias("matches"))


def explode_matches(df: DataFrame, matches: str = "matches") -> DataFrame:
    """Long form: one row per match with its order in the document.

    ``posexplode_outer`` plus a filter, because a plain explode makes the
    optimizer run every pattern a second time for its size check.
    """
    others = [c for c in df.columns if c != matches]
    return (
        df.select(*others, F.posexplode_outer(matches).alias("ord", "m"))
        .where(F.col("m").isNotNull())
        .select(*others, "ord", "m.category", "m.detector", "m.value", "m.line")
    )


def plugin_rows(
    df: DataFrame, find: Callable[[object, str], Iterable[tuple[str, str, int | None]]], detector: str, text: str = "text"
) -> DataFrame:
    """Every column but the text, and (category, detector, value, line): a row for each match that a Python detector yields.

    ``find(state, text)`` runs as a table function beside each text, so it may
    yield any number of matches, one by one. ``state`` is a dict of the task's
    own, for what is dear to build (an automaton, a connection). A text on which
    it raises gives a row of category ``detector_failure`` with the error's
    kind, after what it had yielded; other texts go on.
    """

    class Rows:
        def __init__(self) -> None:
            self.state: dict = {}

        def eval(self, body: str):
            try:
                for category, value, line in find(self.state, body or ""):
                    yield category, detector, value, line
            except Exception as problem:
                yield FAILURE, detector, type(problem).__name__, None

    rows = F.udtf(Rows, returnType="category string, detector string, value string, line int")
    others = [c for c in df.columns if c != text]
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), F.col(f"`{text}`").alias("_body"))
    found = own.lateralJoin(rows(F.col("_body").outer()))
    taken = ("category", "detector", "value", "line")
    return found.select(*(F.col("_row")[c].alias(c) for c in others if c not in taken), *taken)


def detector_failures(df: DataFrame, matches: str = "matches") -> DataFrame:
    """(detector, error, texts): on how many texts a recorded plug-in failed, by the error's kind."""
    failed = explode_matches(df, matches).where(F.col("category") == FAILURE)
    return failed.groupBy("detector", F.col("value").alias("error")).agg(F.count("*").alias("texts"))


def dedup_split(matches: Column) -> tuple[Column, list[tuple[str, Column]]]:
    """Matches that pass unchanged, and the values of each merged category."""

    def values_of(category: str) -> Column:
        return F.transform(F.filter(matches, lambda m: m["category"] == category), lambda m: m["value"])

    plain = F.filter(matches, lambda m: ~m["category"].isin(*MERGED_CATEGORIES))
    return plain, [(c, values_of(c)) for c in MERGED_CATEGORIES]


def merge_near_equal(df: DataFrame, matches: str = "matches", similarity: str = "exact") -> DataFrame:
    """Replace the matches of merged categories by one match per leader value.

    ``similarity`` is ``exact`` (Ratcliff-Obershelp) or ``native`` (JVM only).
    A document's values come from one text cell, so the work stays in its row.
    """
    others = [c for c in df.columns if c != matches]
    plain, merged = dedup_split(F.col(matches))
    df = df.select(*others, plain.alias("_plain"), F.array(*(values for _, values in merged)).alias("_groups"))
    if similarity == "exact":
        groups = leaders_exact(F.col("_groups"))
    elif similarity == "native":
        groups = F.transform("_groups", lambda values: leaders_native(values))
    else:
        raise ValueError(f"unknown similarity: {similarity!r}")
    df = df.select(*others, "_plain", groups.alias("_leaders"))
    names = F.array(*(F.lit(c) for c, _ in merged))
    leaders = F.flatten(
        F.transform(
            "_leaders",
            lambda group, i: F.transform(
                group,
                lambda v: F.struct(
                    F.get(names, i).alias("category"),
                    F.lit(None).cast("string").alias("detector"),
                    v.alias("value"),
                    F.lit(None).cast("int").alias("line"),
                ),
            ),
        )
    )
    return df.select(*others, F.concat("_plain", leaders).alias(matches))
