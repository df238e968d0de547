"""spark-submit entry: python -m veilscan --dataset DIR [--output DIR]."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from veilscan.plans.directory import directory_rows, split_rows
from veilscan.plans.report import write_report


def main(argv: list[str] | None = None) -> str | None:
    parser = argparse.ArgumentParser(prog="veilscan", description="Find personal data in a directory of files.")
    parser.add_argument("--dataset", required=True, help="folder with the files")
    parser.add_argument("--output", default="reports", help="folder for the report")
    parser.add_argument("--formats", help="comma-separated formats (default: the routed ones)")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("veilscan").getOrCreate()
    formats = args.formats.split(",") if args.formats else None
    run, output = datetime.now().strftime("%Y%m%d-%H%M%S"), args.output.rstrip("/")
    # One pass over the files; report and quarantine are split from what it wrote.
    written = f"{output}/rows_{run}"
    directory_rows(spark, args.dataset, formats).write.parquet(written)
    rows, failed = split_rows(spark.read.parquet(written))
    failed.write.json(f"{output}/quarantine_{run}")
    return write_report(rows, output, run)


if __name__ == "__main__":
    main()
