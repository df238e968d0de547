"""A stream of which only contents that were not met before are scanned.

The output table is the state: it holds the hash of every content that was scanned. A
batch is first cut down to the first path of each of its hashes, then to hashes that no
earlier batch has; only the texts of those go on to the scan. What is shuffled for that
is hashes and paths. A batch writes its own folder, so one that is run again after a
failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan.functions.text import path_order
from veilscan.operators.dedup import content_hash
from veilscan.operators.names import is_small
from veilscan.plans.scan import scan
from veilscan.session import settled


def known_contents(spark: SparkSession, folder: str, before: int, event_time: str | None = None, since=None) -> DataFrame | None:
    """(file_hash): contents that batches before one have scanned, as far back as ``since``; none before the first."""
    if not before:
        return None
    rows = spark.read.parquet(f"{folder}").where(F.col("batch") < before)
    if event_time is not None and since is not None:
        rows = rows.where(F.col(event_time) >= since)
    return rows.select("file_hash").distinct()


def scan_batch(
    batch: DataFrame,
    number: int,
    folder: str,
    text: str = "text",
    path: str = "path",
    event_time: str | None = None,
    within: str | None = None,
    **options,
) -> None:
    """Scan what is new in one batch and write it to ``folder/batch=number``.

    Of copies in a batch the first path counts, of copies in several batches
    the first batch. With ``event_time`` and ``within``, contents are forgotten
    that much before the batch's first event. ``options`` go to ``scan``.
    """
    spark = batch.sparkSession
    hashed = batch.withColumn("file_hash", content_hash(F.coalesce(F.col(text), F.lit(""))))
    order = F.struct(path_order(F.col(path).cast("string")).alias("order"), F.col(path).alias("path"))
    first = hashed.groupBy("file_hash").agg(F.min(order).alias("first")).select("file_hash", F.col("first.path").alias(path))
    since = None
    if event_time is not None and within is not None:
        since = batch.agg(F.min(event_time) - F.expr(f"interval {within}")).first()[0]
    known = known_contents(spark, folder, number, event_time, since)
    if known is not None:
        first = first.join(known, "file_hash", "left_anti")
    first = settled(first)
    new = hashed.join(F.broadcast(first) if is_small(first) else first, ["file_hash", path], "left_semi")
    # A path that comes twice with the same content is one row.
    scanned = scan(new, text, key="file_hash", **options).dropDuplicates(["file_hash"])
    scanned.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def start_new_content_scan(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Scan the contents of a stream that were not met before, batch by batch; ``options`` go to ``scan_batch``.

    Gazetteers may be given too: within a batch, names and places are found as in a table.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: scan_batch(batch, number, folder, **options)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
