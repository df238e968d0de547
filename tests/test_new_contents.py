"""A stream of new contents over several batches and restarts, against one scan of everything."""

from datetime import datetime

from veilscan.catalog import fixtures as fx
from veilscan.catalog import queries
from veilscan.streaming.new_contents import start_new_content_scan

SCHEMA = "path string, at timestamp, text string"
DAY = [datetime(2024, 1, d) for d in range(1, 6)]


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    start_new_content_scan(stream, str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True, **options).awaitTermination()
    return sorted((r.batch, r.path, r.markup.categories) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_batches_and_restarts(spark, tmp_path):
    mail = "почта a@b.ru"
    add(spark, tmp_path, [("b/x", DAY[0], mail), ("a/y", DAY[0], mail), ("c", DAY[0], "ничего"), ("c", DAY[0], "ничего"), ("d", DAY[0], None)])
    first = [(0, "a/y", ["email"]), (0, "c", []), (0, "d", [])]
    assert run(spark, tmp_path) == first
    # A copy with a smaller path in a later batch is not scanned again.
    add(spark, tmp_path, [("a/a", DAY[1], mail), ("e", DAY[1], "серия 45 08 123456"), ("f", DAY[1], "")])
    assert run(spark, tmp_path) == [*first, (1, "e", ["passport"])]
    add(spark, tmp_path, [("g", DAY[2], mail)])
    assert run(spark, tmp_path) == [*first, (1, "e", ["passport"])]


def test_contents_are_forgotten_and_names_found(spark, tmp_path):
    text = "клиент Иванова Мария Петровна, ок"
    for day in (0, 1, 4):
        add(spark, tmp_path, [(f"p{day}", DAY[day], text)])
        found = run(spark, tmp_path, event_time="at", within="2 days", names=fx.names(spark))
    assert found == [(0, "p0", ["full_name"]), (2, "p4", ["full_name"])]


def test_arriving_files_grow_with_the_input(spark, tmp_path, monkeypatch, sf):
    """As many files as there are tasks, not four that each take a fourth of all texts; two batches all the same."""
    monkeypatch.setattr(queries, "work_dir", lambda spark: str(tmp_path))
    queries.QUERIES["stream_new_contents"](spark, sf)
    (folder,) = tmp_path.glob("stream-*")
    assert len(list(folder.glob("in/*.parquet"))) >= spark.sparkContext.defaultParallelism
    assert sorted(p.name for p in folder.glob("out/batch=*")) == ["batch=0", "batch=1"]
