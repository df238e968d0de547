"""Plans stay narrow; hot keys and large gazetteers change no result."""

from plan_text import plan_of
from pyspark.sql import functions as F

from veilscan.catalog import fixtures as fx
from veilscan.operators import names as nm
from veilscan.operators.detect import detect, explode_matches
from veilscan.operators.names import locations, name_candidates, name_hits
from veilscan.plans.scan import report, scan
from veilscan.sources.corpus import corpus_table
from veilscan.sources.files import file_scan, format_route


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_scan_is_one_narrow_pass(spark, sf):
    df = scan(documents(spark, sf).select("doc_id", "text"))
    plan = plan_of(df)
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_every_pattern_runs_once(spark, sf):
    optimized = detect(documents(spark, sf).select("doc_id", "text"), lines=False)._jdf.queryExecution().optimizedPlan()
    assert optimized.toString().count("regexp_extract_all") == 12  # 11 detectors, one in two forms
    exploded = explode_matches(detect(documents(spark, sf).select("doc_id", "text"), lines=False))
    assert exploded._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 12


def test_report_shuffles_verdicts_only(spark, sf):
    df = documents(spark, sf).select(F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    plan = plan_of(report(df))
    assert plan.count("Exchange") == 1
    assert "partial_min" in plan  # copies shrink before the shuffle
    above = plan.split("Exchange")[0]
    assert "_raw" not in above and "text#" not in above


def test_listing_does_not_read_content(spark, sf):
    plan = plan_of(format_route(file_scan(spark, sf), {"parquet"}).select("path"))
    assert "content" not in plan


def test_gazetteer_is_broadcast_only_when_small(spark, sf):
    df = fx.pii_docs(spark, sf)
    args = dict(names=fx.names(spark), places=fx.places(spark))
    small, large = name_hits(df, **args, small=True), name_hits(df, **args, small=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan_of(small)
        assert "BroadcastHashJoin" not in plan_of(large)
        for step in (name_candidates, locations):
            assert sorted(map(tuple, step(small).collect())) == sorted(map(tuple, step(large).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert nm.is_small(fx.names(spark))
    assert not nm.is_small(fx.names(spark), rows=3)
    assert not nm.is_small(fx.names(spark), size=10)


def test_names_shuffle_once(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = plan_of(nm.name_matches(df, names=fx.names(spark), places=fx.places(spark)))
    stream_side = [line for line in plan.split("\n") if "Exchange hashpartitioning(doc_id" in line]
    assert len(stream_side) == 1
    assert plan.count("FileScan") == 1


def test_places(spark, texts_df):
    places = spark.createDataFrame([("Нижний Новгород",), ("Новгород",), ("Нижний",), ("Ростов на Дону",)], "token string")
    names = spark.createDataFrame([("Ивановой", "Иванова"), ("Мария", None)], "token string, normal string")
    df = texts_df(["из НИЖНИЙ новгород, новгород", "Ростов, на Дону", "ростов на дону", "ивановой мария петровна пётр"])
    found = {tuple(r)[::2] for r in locations(name_hits(df, places=places)).collect()}
    assert found == {(0, "Нижний Новгород"), (0, "Новгород"), (2, "Ростов на Дону")}
    named = [tuple(r) for r in name_candidates(name_hits(df, names=names)).collect()]
    assert named == [(3, 0, "Иванова Мария Петровна")]


def test_hot_copies(spark):
    """A third of all rows are copies of one text."""
    df = spark.range(3000).select(
        F.concat(F.lit("d/"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(".html")).alias("path"),
        F.when(F.col("id") % 3 == 0, F.lit("почта a@b.ru")).otherwise(F.concat(F.lit("n"), F.col("id"))).alias("text"),
    )
    rows = report(df).collect()
    assert len(rows) == 2001
    assert sorted(rows) == sorted(report(df, dedup="before").collect())
    assert report(df, dedup=None).count() == 3000
    assert [r.file_path for r in rows if r.categories == "email"] == ["d/00000.html"]


def test_pages_group_in_bounded_parts(spark):
    pages = spark.range(95).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("page"), F.when(F.col("id") == 3, "").otherwise(F.concat(F.lit("p"), "id")).alias("text")
    )
    whole = corpus_table(pages).collect()
    assert [(r.doc_id, r.part) for r in whole] == [(1, 0)]
    assert whole[0].text == "\n".join(f"p{i}" for i in range(95) if i != 3)
    parts = {r.part: r.text for r in corpus_table(pages, pages_per_part=10).collect()}
    assert len(parts) == 10
    assert "\n".join(parts[i] for i in sorted(parts)) == whole[0].text


def test_matches_run_on_into_the_next_part(spark):
    texts = ["a 45 08", "123456 b", "ул. Мира", "д. 5", "x@y.org", "8 999 123", "45-67.", "нет"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, page long, text string")
    want = {(m.type, m.value) for m in scan(corpus_table(pages)).first().markup.matches}
    assert want == {
        ("passport", "45 08\n123456"), ("address", "ул. Мира д. 5"), ("email", "x@y.org"), ("phone", "8 999 123\n45-67"),
    }
    for size in (1, 2, 3, 5):
        parts = scan(corpus_table(pages, pages_per_part=size, context_pages=2), context="context").collect()
        assert [(m.type, m.value) for r in parts for m in r.markup.matches].__len__() == 4
        assert {(m.type, m.value) for r in parts for m in r.markup.matches} == want
