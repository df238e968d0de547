"""One verdict for documents that come in parts, whatever their size.

Parts are scanned side by side, each with a piece of what follows it. A match belongs to
the part that it starts in. Where it runs on into the next part, that part is read again
from where the match ends, as one long text would be. Lines and word positions count on
from part to part by running sums over small rows. Values that merge, names and
categories are put together by shuffles of matches; no text is moved or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.similarity import leaders_of_rows
from veilscan.operators.detect import checked, raw_places
from veilscan.operators.names import found_in_parts, name_hits, name_longest, token_count
from veilscan.operators.rollup import protection_level, recommendations
from veilscan.operators.rules import DEFAULT_RULES, MERGED_CATEGORIES, Rule
from veilscan.session import settled


def _extents(parts: DataFrame, count_words: bool) -> DataFrame:
    """(doc, part, next, own, lines, words, words_before): how far a part goes, and what is before it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = F.col("context").isNotNull()
    # The line break that joins a part to the next one is its own.
    sizes = parts.select(
        "doc",
        "part",
        (F.length(text) + more.cast("int")).alias("own"),
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("bigint").alias("_lines"),
        (token_count(F.col("text")) if count_words else F.lit(0)).cast("bigint").alias("words"),
    )
    order = Window.partitionBy("doc").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return settled(
        sizes.select(
            "doc",
            "part",
            F.lead("part").over(order).alias("next"),
            "own",
            "words",
            F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("lines"),
            F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"),
        )
    )


def _joined(left: DataFrame, right: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """A join on ``doc``, which may be null, and other columns; one copy of them is kept."""
    named = right.select(*(F.col(c).alias(f"_{c}") if c in ("doc", *on) else F.col(c) for c in right.columns if how == "inner" or c in ("doc", *on)))
    condition = F.col("doc").eqNullSafe(F.col("_doc"))
    for name in on:
        condition &= F.col(name) == F.col(f"_{name}")
    return left.join(named, condition, how).drop("_doc", *(f"_{c}" for c in on))


def _running_on(found: DataFrame, extents: DataFrame) -> DataFrame:
    """(doc, part, detector, over): how many characters of a part belong to a match that starts before it."""
    own = found.groupBy("doc", "part", "detector").agg(F.max(F.col("start") + F.length("value") - F.col("own")).alias("over"))
    level = own.where("over > 0")
    reached = None
    while True:
        # Where a match runs all through a part, what is left of it reaches the one after.
        level = _joined(level, extents, "part").where("next is not null")
        level = settled(level.select("doc", F.col("next").alias("part"), "detector", "over"))
        reached = level if reached is None else reached.unionByName(level)
        through = _joined(level, extents, "part").where("over > own")
        level = through.select("doc", "part", "detector", (F.col("over") - F.col("own")).alias("over"))
        if level.isEmpty():
            return settled(reached.groupBy("doc", "part", "detector").agg(F.max("over").alias("over")))


def _owned(parts: DataFrame, extents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc, part, own, detector, value, line, start): matches as one long text has them, by the part they start in."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = (F.length(text) + F.col("context").isNotNull().cast("int")).alias("own")
    sized = parts.select("doc", "part", own, F.concat_ws("\n", text, F.col("context")).alias("text"))
    found = settled(raw_places(sized, F.col("text"), ["doc", "part", "own"], rules).where("start < own"))
    known = None
    while True:
        over = _running_on(found, extents)
        news = over
        if known is not None:
            ended = _joined(known, over, "part", "detector", how="left_anti").withColumn("over", F.lit(0))
            news = settled(over.exceptAll(known).unionByName(ended))
        if news.isEmpty():
            return found
        # Those parts are read again from where the match ends, for that detector alone.
        wanted = news.groupBy("doc", "part", "over").agg(F.collect_set("detector").alias("wanted"))
        passed = F.substring(F.col("text"), F.lit(1), F.col("over"))
        breaks = F.length(passed) - F.length(F.translate(passed, "\n", ""))
        again = _joined(sized, wanted, "part").select(
            "doc",
            "part",
            "own",
            "over",
            "wanted",
            breaks.alias("breaks"),
            F.substring(F.col("text"), F.col("over") + 1, F.length("text")).alias("text"),
        )
        fresh = raw_places(again, F.col("text"), ["doc", "part", "own", "over", "wanted", "breaks"], rules)
        fresh = fresh.where(F.array_contains("wanted", F.col("detector"))).select(
            "doc", "part", "own", "detector", "value", (F.col("line") + F.col("breaks")).alias("line"), (F.col("start") + F.col("over")).alias("start")
        )
        stay = _joined(found, news, "part", "detector", how="left_anti")
        found, known = settled(stay.unionByName(fresh.where("start < own"))), over


def _named(parts: DataFrame, extents: DataFrame, names: DataFrame | None, places: DataFrame | None) -> DataFrame:
    """(doc, category, detector, value): places one by one, and the longest name of each first word."""
    text = F.concat_ws("\n", F.coalesce(F.col("text"), F.lit("")), F.col("context"))
    sized = _joined(parts, extents, "part").select("doc", text.alias("text"), "words", "words_before")
    hits = name_hits(sized, names, places, "text", "doc", own="words", before="words_before")
    found = settled(found_in_parts(hits, "doc"))
    listed = found.where("place is not null").select("doc", F.lit("address").alias("category"), F.lit("location").alias("detector"), F.col("place").alias("value"))
    longest = name_longest(found.where("name is not null").select("doc", "pos", "name"), "doc")
    return listed.unionByName(
        longest.select("doc", F.lit("full_name").alias("category"), F.lit("full_name").alias("detector"), F.col("name").alias("value"))
    )


def part_matches(
    parts: DataFrame,
    doc: str = "doc_id",
    rules: Sequence[Rule] = DEFAULT_RULES,
    names: DataFrame | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """(doc, category, detector, value, line): what a scan of the whole documents would list.

    ``parts`` is (doc, part, text, context), as ``corpus_table`` with
    ``pages_per_part`` gives it. Merged categories come as their leaders,
    without detector and line. A match may run through what ``context`` holds.
    """
    parts = parts.select(F.col(f"`{doc}`").alias("doc"), "part", "text", "context")
    extents = _extents(parts, names is not None or places is not None)
    owned = _owned(parts, extents, rules)
    placed = _joined(owned, extents, "part").select("doc", "detector", "value", (F.col("line") + F.col("lines")).cast("int").alias("line"))
    found = checked(placed, rules)
    if names is not None or places is not None:
        found = found.unionByName(_named(parts, extents, names, places), allowMissingColumns=True)
    found = settled(found.select("doc", "category", "detector", "value", "line"))
    merged = F.col("category").isin(*MERGED_CATEGORIES)
    leaders = leaders_of_rows(found.where(merged), ["doc", "category"])
    both = found.where(~merged).unionByName(leaders, allowMissingColumns=True)
    return both.select(F.col("doc").alias(doc), "category", "detector", "value", "line")


def part_verdicts(parts: DataFrame, matches: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, categories, total_matches, protection_level, recommendations): a row for each document of ``parts``."""
    sums = matches.groupBy(F.col(f"`{doc}`").alias("_doc")).agg(
        F.array_sort(F.collect_set("category")).alias("categories"), F.count(F.lit(1)).alias("total_matches")
    )
    every = parts.select(F.col(f"`{doc}`").alias(doc)).distinct()
    joined = every.join(sums, F.col(f"`{doc}`").eqNullSafe(F.col("_doc")), "left")
    categories = F.coalesce("categories", F.array().cast("array<string>"))
    rows = joined.select(F.col(f"`{doc}`"), categories.alias("categories"), F.coalesce("total_matches", F.lit(0)).alias("total_matches"))
    return rows.select(
        "*", protection_level(F.size("categories")).alias("protection_level"), recommendations(F.col("categories")).alias("recommendations")
    )
