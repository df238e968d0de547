"""Corpora whose text was obtained elsewhere, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.text import is_blank

CONTEXT_PAGES = 5


def corpus_table(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page",
    text: str = "text",
    pages_per_part: int | None = None,
    context_pages: int = CONTEXT_PAGES,
) -> DataFrame:
    """(doc, part, text, context): pages in order, joined by newline, empty ones skipped.

    A document is one row, part 0, whatever its number of pages, so that it
    gets one verdict; its text must fit a cell (2 GB).

    ``pages_per_part`` cuts documents by page range instead: no row then holds
    more than that many pages, and ``plans.parts`` puts the parts' matches
    together to one verdict for a document of any size. ``context`` is how the
    text goes on in the parts that follow, ``context_pages`` pages of it, null
    where there is none: a match may run on from one part into the next.
    """
    kept = pages.where(F.coalesce(F.col(text), F.lit("")) != "")
    if pages_per_part is None:
        whole = kept.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("ps"))
        joined_text = F.array_join(F.transform("ps", lambda p: p[text]), "\n").alias("text")
        return whole.select(doc, F.lit(0).cast("bigint").alias("part"), joined_text, F.lit(None).cast("string").alias("context"))
    ranged = kept.select(doc, F.floor(F.col(page) / pages_per_part).alias("part"), page, text)
    grouped = ranged.groupBy(doc, "part").agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("ps"))
    texts = F.transform("ps", lambda p: p[text])
    parts = grouped.select(doc, "part", F.array_join(texts, "\n").alias("text"))
    # Only the first pages of a part go on to the parts before it, wherever pages or whole parts are missing.
    heads = grouped.select(F.col(doc).alias("_doc"), F.col("part").alias("_part"), F.slice(texts, 1, context_pages).alias("_head"))
    after = Window.partitionBy("_doc").orderBy("_part").rowsBetween(1, max(context_pages, 1))
    following = F.slice(F.flatten(F.collect_list("_head").over(after)), 1, context_pages)
    heads = heads.select("_doc", "_part", F.when(F.size(following) > 0, F.array_join(following, "\n")).alias("context"))
    same = F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part"))
    return parts.join(heads, same, "left").select(doc, "part", "text", "context")


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents that hold something to scan."""
    return df.where(~is_blank(F.col(text)))
