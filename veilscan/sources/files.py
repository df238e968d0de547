"""Directories of files: listing, routing by format, text per file."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.text import file_format, format_key
from veilscan.sources.csv_blocks import records
from veilscan.sources.encoding import CP1251_UNDEFINED, binary_text_salvage, text_decode
from veilscan.sources.markup import TEXT_OR_ERROR, html_text, json_parse
from veilscan.sources.tables import MISSING, decoded_name, distinct_names

# The formats routed by default, and those a text can be named for.
DEFAULT_FORMATS = (
    "pdf", "doc", "docx", "rtf", "html",
    "csv", "xls", "xlsx", "parquet",
    "json",
    "png", "jpg", "jpeg", "gif", "bmp",
    "mp4",
)
KNOWN_FORMATS = (
    "pdf", "docx", "doc", "rtf", "html", "txt", "md",
    "csv", "xls", "xlsx", "parquet",
    "json",
    "png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff",
    "mp4", "avi", "mov", "mkv",
)


def file_scan(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root``: path, modificationTime, length, content.

    ``content`` is read only where a later step asks for it. Spark does not
    list names that start with "." or "_". A missing root raises.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def format_route(df: DataFrame, formats: Iterable[str] | None = None, path: str = "path") -> DataFrame:
    """Keep files of the allowed formats (the default set if none are given)."""
    allowed = [f.lower() for f in (formats or DEFAULT_FORMATS)]
    return df.withColumn("file_format", file_format(F.col(path))).where(F.col("file_format").isin(*allowed))


def _csv_lines(content: bytes) -> str:
    """The header and each row of a CSV file as a line, by the rules of ``read_csv_table``."""
    undefined = CP1251_UNDEFINED.encode("latin-1")
    try:
        encoding = "utf-8"
        content.decode(encoding)
    except UnicodeDecodeError:
        encoding = "latin-1" if undefined in content else "cp1251"
    rows = records(content.removeprefix(b"\xef\xbb\xbf"))
    names = distinct_names([decoded_name(n) for n in next(rows, [])])
    lines, empty = [" ".join(names)] if names else [], set(MISSING)
    for row in rows:
        if len(row) <= len(names):
            values = [f.decode(encoding) for f in row]
            lines.append(" ".join(["" if v in empty else v for v in values] + [""] * (len(names) - len(row))))
    return "".join(line + "\n" for line in lines)


def _row_lines(content: bytes) -> str:
    """The header and each row of a Parquet file as a line."""
    file = pq.ParquetFile(pa.BufferReader(content))
    lines = [" ".join(file.schema_arrow.names)]
    for batch in file.iter_batches():
        lines += [" ".join(row) for row in zip(*(_as_strings(c) for c in batch.columns))]
    return "\n".join(lines)


def _as_strings(column: pa.Array) -> list[str]:
    """A column's values as text, nulls as nothing."""
    try:
        return pc.fill_null(column.cast(pa.string()), "").to_pylist()
    except pa.ArrowException:  # nested values, bytes that are no text
        return ["" if v is None else str(v) for v in column.to_pylist()]


def _texts(read: Callable[[bytes], str], contents: pd.Series) -> pd.DataFrame:
    texts, errors = [], []
    for content in contents:
        text, error = None, None
        if content is not None:
            try:
                text = read(bytes(content))
            except (pa.ArrowException, OSError) as problem:
                error = str(problem)
        texts.append(text)
        errors.append(error)
    return pd.DataFrame({"text": texts, "error": errors})


@F.pandas_udf(TEXT_OR_ERROR)
def csv_parse(contents: pd.Series) -> pd.DataFrame:
    """(text, error) of CSV files whose bytes are one cell each."""
    return _texts(_csv_lines, contents)


def csv_text(content: Column) -> Column:
    """A CSV file's text: a line for the header and for each row, fields a space apart, without quotes."""
    return csv_parse(content)["text"]


@F.pandas_udf(TEXT_OR_ERROR)
def parquet_text(contents: pd.Series) -> pd.DataFrame:
    """(text, error) of Parquet files whose bytes are one cell each."""
    return _texts(_row_lines, contents)


def _plain(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(None).cast("string").alias("error"))


# One function content -> struct(text, error) per format that Spark can read as
# a file; register more with ``extractors=`` of ``extract_text``.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "txt": lambda content: _plain(text_decode(content)),
    "md": lambda content: _plain(text_decode(content)),
    "html": lambda content: _plain(html_text(text_decode(content))),
    "doc": lambda content: _plain(binary_text_salvage(content)),
    "json": json_parse,
    "csv": csv_parse,
    "parquet": parquet_text,
}


def extract_text(
    files: DataFrame,
    content: str = "content",
    fmt: str = "file_format",
    extractors: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Add ``text``, ``status`` and ``errors``; drop the content.

    One pass over the files. An extractor is handed the content of its own
    format only, so nothing else is sent to the Python ones. A format without
    an extractor fails once: its text has to come in through ``corpus_table``.
    """
    key = format_key(F.col(fmt))
    missing = F.concat(F.lit("no text extractor for format: "), F.coalesce(key, F.lit("")))
    extracted = F.struct(F.lit(None).cast("string").alias("text"), missing.alias("error"))
    for name, extract in (EXTRACTORS | (extractors or {})).items():
        own = key == name
        extracted = F.when(own, extract(F.when(own, F.col(content)))).otherwise(extracted)
    others = [c for c in files.columns if c != content]
    return with_status(files.select(*others, extracted.alias("_x")), F.col("_x.text"), F.col("_x.error")).drop("_x")


def with_status(df: DataFrame, text: Column, error: Column) -> DataFrame:
    """Errors as data: ``text``, ``status`` (done or failed) and ``errors``."""
    failure = F.struct(F.lit(1).alias("attempt"), error.alias("error"))
    return df.select(
        "*",
        text.alias("text"),
        F.when(error.isNull(), "done").otherwise("failed").alias("status"),
        F.when(error.isNull(), F.array().cast("array<struct<attempt:int,error:string>>"))
        .otherwise(F.array(failure))
        .alias("errors"),
    )
