"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query writes all its rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from veilscan.catalog.queries import QUERIES
from veilscan.session import local_session

HEADLINE = (
    "directory_report", "report_rows", "doc_markup", "doc_markup_with_names", "matches_table", "all_matches",
    "content_dedup", "stream_content_dedup", "fuzzy_dedup", "fuzzy_dedup_native", "table_cell_scan",
    "table_rows_text", "csv_table_text", "html_text", "json_text", "text_decode", "corpus_table",
    "detect_passport_rf", "detect_passport_intl", "detect_inn", "detect_snils", "detect_phone", "detect_email",
    "detect_bank_card", "detect_driver_license", "detect_date", "detect_address", "detect_special",
    "detect_full_name", "detect_location", "heal_ocr_digits", "similarity_ratio", "report_csv",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    # The first detector run compiles the patterns' code; no query should pay for that.
    QUERIES["all_matches"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
