"""Byte-identical documents: hash and keep the first by path.

The first copy is found by a partial aggregate (a hash held by a third of all
rows shrinks to one row per task before the shuffle), never by a window over
the copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import path_order


def content_hash(content: Column) -> Column:
    """SHA-256, in hex, of the bytes."""
    return F.sha2(content, 256)


def first_of_copies(df: DataFrame, file_hash: str = "file_hash", path: str = "path") -> DataFrame:
    """One row per hash, that of the first path; all columns kept.

    Meant for narrow rows (path, hash, markup): the rows themselves ride in
    the aggregate, so no join back is needed.
    """
    columns = df.columns
    return (
        df.groupBy(file_hash)
        .agg(F.min(F.struct(path_order(F.col(path)).alias("_order"), *(c for c in columns if c != file_hash))).alias("r"))
        .select(*(F.col(file_hash) if c == file_hash else F.col(f"r.{c}").alias(c) for c in columns))
    )


def content_dedup(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Drop later copies of the same content.

    Only (hash, path) goes through the aggregate; the survivors are joined
    back by path, which is unique, so a hot hash cannot make a hot join key.
    """
    hashed = df.withColumn("file_hash", content_hash(F.col(content)))
    first = first_of_copies(hashed.select("file_hash", path), path=path)
    return hashed.join(first.select(path), path, "left_semi")
