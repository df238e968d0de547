"""Input columns of any name, and plug-ins that yield rows."""

from pyspark.sql import functions as F

from veilscan.catalog import fixtures as fx
from veilscan.operators.detect import detect, plugin_rows
from veilscan.plans.scan import scan

NAMES = "doc_id long, text string, matches int, _raw int, _v_inn int, _g0 int, markup string, `a.b` int"


def test_columns_that_the_detectors_use_themselves(spark):
    rows = [(1, "почта a@b.ru ИНН: 123456789012 Иванова Мария", 1, 2, 3, 4, "m", 5), (2, None, 1, 2, 3, 4, "m", 5)]
    df = spark.createDataFrame(rows, NAMES)
    plain = df.select("doc_id", "text")
    found, want = detect(df), {r.doc_id: r.matches for r in detect(plain).collect()}
    assert found.columns == ["doc_id", "_raw", "_v_inn", "_g0", "markup", "a.b", "matches"]
    assert {r.doc_id: r.matches for r in found.collect()} == want
    scanned = scan(df, names=fx.names(spark))
    assert scanned.columns == ["doc_id", "matches", "_raw", "_v_inn", "_g0", "a.b", "markup"]
    assert {r.doc_id: r.markup for r in scanned.collect()} == {r.doc_id: r.markup for r in scan(plain, names=fx.names(spark)).collect()}


def test_a_plugin_that_yields_rows(spark):
    def letters(state, text):
        state.setdefault("seen", []).append(text)
        for number, c in enumerate(text, 1):
            if c == "!":
                raise KeyError(c)
            yield "letter", c, number

    rows = [(1, "ab", "x", 7), (2, None, "x", 7), (3, "c!d", "x", 7), (4, "", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, category string, _body int")
    found = plugin_rows(df, letters, "letters")
    assert found.columns == ["doc_id", "_body", "category", "detector", "value", "line"]
    got = sorted((r.doc_id, r.category, r.value, r.line or 0) for r in found.collect())
    assert got == [(1, "letter", "a", 1), (1, "letter", "b", 2), (3, "detector_failure", "KeyError", 0), (3, "letter", "c", 1)]
    assert plugin_rows(df.where("false"), letters, "letters").count() == 0


def test_each_pattern_runs_once_for_values_and_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = detect(docs)._jdf.queryExecution().optimizedPlan().toString()
    # Eleven detectors, one of them in two forms; one run of a pattern marks values and lines.
    assert plan.count("regexp_extract_all") == 0 and plan.count("$0") == 12
    assert detect(docs).select(F.size("matches").alias("n")).where("n > 0").count() >= 0
