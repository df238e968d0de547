"""A directory of files in, report rows and a quarantine out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.operators.dedup import content_hash, first_of_copies
from veilscan.plans.scan import report_columns, scan
from veilscan.sources.files import extract_text, file_scan, format_route, with_status


def file_rows(
    files: DataFrame, formats: Iterable[str] | None = None, extractors: dict | None = None, longest: int | None = None, **options
) -> DataFrame:
    """(path, file_hash, status, errors, row): what became of each file of (path, length, content).

    Files of other formats are left out, later copies of the same bytes too. A
    file of more than ``longest`` bytes fails by its length alone, unread; the
    others go on. ``options`` go to ``scan``. The files may be listed by
    ``file_scan`` or come from any table that stores them.
    """
    listed = format_route(files, formats)
    fits = F.lit(True) if longest is None else F.col("length") <= longest
    hashed = listed.where(fits).select("path", "content", "file_format").withColumn("file_hash", content_hash(F.col("content")))
    texts = extract_text(hashed, extractors=extractors)
    scanned = scan(texts, key="path", **options)
    rows = first_of_copies(
        scanned.select("path", "file_hash", "status", "errors", F.struct(*report_columns("path")).alias("row"))
    )
    if longest is None:
        return rows
    too_long = listed.where(~fits).select("path", "length")
    error = F.concat(F.lit("file too large: "), F.col("length"), F.lit(" bytes"))
    failed = with_status(too_long, F.lit(None).cast("string"), error)
    return rows.unionByName(failed.select("path", "status", "errors"), allowMissingColumns=True)


def directory_rows(
    spark: SparkSession, root: str, formats: Iterable[str] | None = None, extractors: dict | None = None, **options
) -> DataFrame:
    """``file_rows`` of the files under ``root``, up to the length that the binary source reads."""
    longest = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return file_rows(file_scan(spark, root), formats, extractors, longest, **options)


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report rows, quarantine) of ``directory_rows``."""
    done = rows.where(F.col("status") == "done").select("row.*")
    return done, rows.where(F.col("status") == "failed").select("path", "status", "errors")


def directory_report(
    spark: SparkSession, root: str, formats: Iterable[str] | None = None, extractors: dict | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(report rows, quarantine) of the files under ``root``.

    Both come from one plan; to write both, write ``directory_rows`` once and
    split what is read back, as the command line does.
    """
    return split_rows(directory_rows(spark, root, formats, extractors, **options))
