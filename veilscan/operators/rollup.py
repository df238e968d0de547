"""Roll matches up to one verdict per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories that call for restricted access, and the measures.
CRITICAL_CATEGORIES = ("passport", "inn", "snils", "bank_card", "driver_license")
RESTRICT, ENCRYPT = "Ограничить доступ к файлу", "Зашифровать хранилище"
BIOMETRIC_LAW = "Применить законодательство о биометрических данных"
NOTIFY = "Уведомить владельца данных"
AUDIT = "Провести аудит доступа"


def categories_of(matches: Column) -> Column:
    """Distinct categories, sorted."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["category"])))


def protection_level(n_categories: Column) -> Column:
    return (
        F.when(n_categories == 0, "none")
        .when(n_categories <= 2, "low")
        .when(n_categories <= 4, "medium")
        .when(n_categories <= 6, "high")
        .otherwise("critical")
    )


def recommendations(categories: Column) -> Column:
    """Ordered measures for a set of categories."""

    def when(condition: Column, *measures: str) -> Column:
        return F.when(condition, F.array(*(F.lit(m) for m in measures))).otherwise(F.array().cast("array<string>"))

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(categories, F.array(*(F.lit(n) for n in names)))

    return F.concat(
        when(any_of(*CRITICAL_CATEGORIES), RESTRICT, ENCRYPT),
        when(any_of("special_pii"), BIOMETRIC_LAW),
        when(any_of("email", "phone"), NOTIFY),
        when(F.size(categories) >= 3, AUDIT),
    )


def location(line: Column) -> Column:
    return F.concat(F.lit("строка "), line.cast("string"))


def markup(df: DataFrame, matches: str = "matches") -> DataFrame:
    """Replace the match array by a ``markup`` struct; no match gives level none."""
    others = [c for c in df.columns if c != matches]
    df = df.select(*others, matches, categories_of(F.col(matches)).alias("_categories"))
    listed = F.transform(
        matches,
        lambda m: F.struct(
            m["category"].alias("type"), m["value"].alias("value"), location(m["line"]).alias("location")
        ),
    )
    return df.select(
        *others,
        F.struct(
            F.col("_categories").alias("categories"),
            listed.alias("matches"),
            protection_level(F.size("_categories")).alias("protection_level"),
            recommendations(F.col("_categories")).alias("recommendations"),
        ).alias("markup"),
    )


def detector_counts(matches: DataFrame, *keys: str) -> DataFrame:
    """Hits per detector before merging, from the long form."""
    return matches.groupBy(*keys, "detector").agg(F.count("*").alias("hits"))


def exact_distinct_values(matches: DataFrame, *keys: str) -> DataFrame:
    """Distinct values per key and category, as rows: no group is collected."""
    return matches.select(*keys, "category", "value").distinct()
