"""Tables as text: one line of text per row, or one text per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.operators.detect import detect, explode_matches
from veilscan.operators.rules import DEFAULT_RULES, Rule
from veilscan.sources.csv_blocks import csv_header, csv_records
from veilscan.sources.encoding import from_cp1251


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input enough partitions for the pattern stage.

    A file of one row group is read by one task. Inputs with at least as many
    splits as cores pass unchanged, so nothing large is ever shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *(keys or ()))


def quoted(name: str) -> str:
    """A column name that may hold dots or back-ticks, as an expression takes it."""
    return "`" + name.replace("`", "``") + "`"


def row_text(columns: Sequence[str]) -> Column:
    """All values of a row as one line; nulls become empty strings."""
    return F.concat_ws(" ", *(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in columns))


def table_rows_text(
    df: DataFrame, key: Sequence[str] = (), columns: Sequence[str] | None = None, header: bool = True
) -> DataFrame:
    """``key`` columns and ``text``, one row per table row.

    Rows stay rows, so the table is scanned in parallel and without a length
    limit. A match may span cells but not rows. The header is one more row
    with null keys.
    """
    columns = list(df.columns if columns is None else columns)
    rows = df.select(*map(quoted, key), row_text(columns).alias("text"))
    if not header:
        return rows
    schema = rows.schema
    nulls = [F.lit(None).cast(schema[k].dataType).alias(k) for k in key]
    first = df.sparkSession.range(1).select(*nulls, F.lit(" ".join(columns)).alias("text"))
    return first.unionByName(rows)


def table_cell_scan(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
) -> DataFrame:
    """Which columns hold which category: hits and distinct values.

    Equal cells of a column are put together, within each task first, and
    scanned once. Counting distinct values goes through (column, category,
    value), so neither a dominant column nor a dominant value becomes one
    task's work.
    """
    columns = list(df.columns if columns is None else columns)
    named = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast("string").alias("cell")) for c in columns))
    cells = df.select(F.explode(named).alias("_c")).select("_c.*").where(F.col("cell").isNotNull())
    cells = cells.groupBy("column_name", "cell").agg(F.count("*").alias("_times"))
    found = explode_matches(detect(cells, "cell", rules, lines=False))
    per_value = found.groupBy("column_name", "category", "value").agg(F.sum("_times").alias("n"))
    return per_value.groupBy("column_name", "category").agg(
        F.sum("n").alias("hits"), F.count("*").alias("distinct_values")
    )


# What an all-string read takes for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)


def decoded_name(data: bytes) -> str:
    """A header field in the first encoding that fits."""
    for encoding in ("utf-8", "cp1251"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def distinct_names(names: Sequence[str]) -> list[str]:
    """Column names as they are, but numbered where one was there before (``a``, ``a.1``), and where there is none.

    Names that differ in case alone count as equal, as Spark resolves them.
    """
    named = [n or f"Unnamed: {i}" for i, n in enumerate(names)]
    taken, out, seen = {n.lower() for n in named}, [], {}
    for name in named:
        new, key = name, name.lower()
        if key in seen:
            while new.lower() in taken:
                seen[key] += 1
                new = f"{name}.{seen[key]}"
            taken.add(new.lower())
        seen.setdefault(key, 0)
        out.append(new)
    return out


def read_csv_table(spark: SparkSession, path: str, file: str | None = None, missing: Sequence[str] = MISSING) -> DataFrame:
    """A CSV table with every column a string; each file in its own encoding.

    Large files are read in parallel, quoted line breaks and all (see
    ``csv_blocks``). Rows with too many fields, empty ones included, are
    skipped; short rows are filled up; what stands for a missing value becomes
    empty. The files share the first one's header, equal names are numbered.
    ``file`` names a column to hold the file's path. Without a header there is
    no column and no row.
    """
    names = distinct_names([decoded_name(n) for n in csv_header(spark, path)])
    rows = csv_records(spark, path).where(F.size("fields") <= len(names))

    def clean(i: int) -> Column:
        field = F.get("fields", F.lit(i))
        other = F.decode(field, "ISO-8859-1")
        text = F.when(F.col("encoding") == "utf-8", field.cast("string")).when(F.col("encoding") == "cp1251", from_cp1251(other)).otherwise(other)
        return F.when(text.isin(*missing), "").otherwise(F.coalesce(text, F.lit("")))

    own = [F.col("file").alias(file)] if file else []
    return rows.select(*(clean(i).alias(n) for i, n in enumerate(names)), *own)
