"""Report and match sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

REPORT_COLUMNS = (
    "batch_id", "file_path", "categories", "total_matches", "protection_level", "file_format", "recommendations",
)


def write_report(rows: DataFrame, output_dir: str, run_id: str, fmt: str = "csv", single_file: bool = False) -> str | None:
    """Write report rows under ``output_dir/reports_<run_id>``; None if there are none.

    The rows are counted while they are written, so the scan behind them runs
    once and nothing is kept; an empty folder is removed. ``single_file`` is
    for reports known to be small. ``parquet`` reports are partitioned by
    protection level.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown report format: {fmt!r}")
    count, path = Observation(), f"{output_dir.rstrip('/')}/reports_{run_id}"
    rows = rows.select(*REPORT_COLUMNS).observe(count, F.count(F.lit(1)).alias("n"))
    out = rows.coalesce(1) if single_file else rows
    if fmt == "csv":
        out.write.option("header", True).option("escape", '"').csv(path)
    else:
        out.write.partitionBy("protection_level").parquet(path)
    if count.get.get("n"):
        return path
    context = rows.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return None


def write_matches(matches: DataFrame, path: str) -> str:
    """Write the long-form matches. They are personal data: guard the folder."""
    matches.write.partitionBy("category").parquet(path)
    return path
