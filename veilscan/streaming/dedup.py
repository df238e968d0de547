"""The scan over a stream of documents, each distinct content once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan.operators.dedup import content_hash
from veilscan.plans.scan import scan


def stream_content_dedup(
    stream: DataFrame,
    text: str = "text",
    event_time: str | None = None,
    within: str | None = None,
    forever: bool = False,
) -> DataFrame:
    """Drop documents whose content was seen before, and scan the rest.

    The scan is narrow and comes first, so the shuffle to the state store
    carries hashes and verdicts instead of texts. With ``event_time`` and
    ``within`` hashes are forgotten after that delay. State without a bound
    has to be asked for: ``forever`` remembers every hash (use the RocksDB
    state store for that).
    """
    if (within is None or event_time is None) and not forever:
        raise ValueError("give event_time and within, or ask for state without a bound by forever=True")
    hashed = stream.withColumn("file_hash", content_hash(F.col(text)))
    scanned = scan(hashed, text, key="file_hash")
    if forever:
        return scanned.dropDuplicates(["file_hash"])
    return scanned.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["file_hash"])


def start_table_sink(scanned: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the verdicts to a Parquet folder, exactly once per document."""
    writer = scanned.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
