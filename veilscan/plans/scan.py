"""The whole scan: text in, one markup or report row per document out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import file_format
from veilscan.operators.dedup import content_dedup, content_hash, first_of_copies
from veilscan.operators.detect import MATCHES, Plugin, clashing, detect, explode_matches, merge_near_equal, set_aside
from veilscan.operators.names import name_matches
from veilscan.operators.rollup import markup
from veilscan.operators.rules import DEFAULT_RULES, Rule


def scan(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    rules: Sequence[Rule] = DEFAULT_RULES,
    plugins: Sequence[Plugin] = (),
    names: DataFrame | None = None,
    places: DataFrame | None = None,
    max_chars: int | None = None,
    max_name_chars: int | None = None,
    similarity: str = "exact",
    context: str | None = None,
) -> DataFrame:
    """All columns but the text, plus ``markup``.

    Without gazetteers the plan has no shuffle. With them, the name matches
    (small rows) are joined to the match arrays by ``key``; the text itself is
    never shuffled. ``context`` is for parts of documents, see ``corpus_table``.
    """
    if context is not None and (names is not None or places is not None):
        raise ValueError("gazetteers need whole documents, not parts of them")
    carried = [c for c in df.columns if c not in (text, context)]
    if clashing(carried):
        safe, named_back = set_aside(df, carried, text, context)
        options = {"rules": rules, "plugins": plugins, "names": names, "places": places, "max_chars": max_chars}
        options |= {"max_name_chars": max_name_chars, "similarity": similarity, "context": context and "context"}
        return named_back(scan(safe, "text", f"kept{carried.index(key)}" if key in carried else key, **options), "markup")
    found = detect(df, text, rules, plugins, lines="kept", max_chars=max_chars, context=context)
    if names is not None or places is not None:
        extra = name_matches(df, text, key, names, places, max_name_chars)
        found = found.join(extra, key, "left").select(
            *(c for c in found.columns if c != "matches"),
            F.concat("matches", F.coalesce("name_matches", F.array().cast(MATCHES))).alias("matches"),
        )
    return markup(merge_near_equal(found, similarity=similarity))


def matches_table(
    df: DataFrame, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES, plugins: Sequence[Plugin] = ()
) -> DataFrame:
    """Long form of every detector's matches. It holds personal data."""
    return explode_matches(detect(df, text, rules, plugins))


def report(
    df: DataFrame,
    text: str = "text",
    path: str = "path",
    dedup: str | None = "after",
    **options,
) -> DataFrame:
    """Report rows for a corpus of (path, text), first copy of each text only.

    ``dedup="after"`` drops copies after the scan: the scan is narrow, so what
    is shuffled per document is its hash, path and verdict, not its text.
    ``"before"`` shuffles the texts once and scans no copy; it pays where copies
    are a large share of the corpus. ``None`` reports every document.
    """
    if dedup not in ("after", "before", None):
        raise ValueError(f"unknown dedup: {dedup!r}")
    keyed = df.select(path, text)
    if dedup == "before":
        keyed = content_dedup(keyed, content=text, path=path)
    elif dedup == "after":
        keyed = keyed.withColumn("file_hash", content_hash(F.col(text)))
    rows = scan(keyed, text, key=path, **options)
    if dedup == "after":
        rows = first_of_copies(rows.select(path, "file_hash", F.struct(*report_columns(path)).alias("row")), path=path)
        return rows.select("row.*")
    return rows.select(*report_columns(path))


def report_columns(path: str = "path") -> list:
    """Report columns, in file order, over a row that holds ``markup``."""
    digest = F.sha2(F.col(path), 256)
    batch_id = F.concat_ws(
        "-", *(F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    )
    return [
        batch_id.alias("batch_id"),
        F.col(path).alias("file_path"),
        F.array_join("markup.categories", ", ").alias("categories"),
        F.size("markup.matches").cast("bigint").alias("total_matches"),
        F.col("markup.protection_level").alias("protection_level"),
        file_format(F.col(path)).alias("file_format"),
        F.array_join("markup.recommendations", "; ").alias("recommendations"),
    ]
