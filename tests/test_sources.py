"""Files, encodings, tables, markup, sinks, streaming."""

import csv
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilscan.__main__ import main
from veilscan.functions.text import file_format, format_key, path_order
from veilscan.operators.dedup import content_dedup
from veilscan.plans.directory import directory_report
from veilscan.plans.report import write_report
from veilscan.sources.encoding import binary_text_salvage, text_decode
from veilscan.sources.files import format_route
from veilscan.sources.markup import html_text, json_parse
from veilscan.sources.tables import read_csv_table, table_cell_scan, table_rows_text
from veilscan.streaming.dedup import start_table_sink, stream_content_dedup


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "content, text",
    [
        ("Привет".encode(), "Привет"),
        ("﻿Привет\r\nмир\rда".encode(), "Привет\nмир\nда"),
        ("Ёж №5".encode("cp1251"), "Ёж №5"),
        (b"\x98\xcf", "\x98Ï"),
        (b"\xed\xa0\x80", b"\xed\xa0\x80".decode("cp1251")),
        (b"", ""),
    ],
)
def test_text_decode(spark, content, text):
    assert one(spark, text_decode, content, "binary") == text


def test_binary_salvage(spark):
    content = "Иван, 8-999".encode("utf-16-le") + b"\xff\xd8" + "Пётр*".encode("cp1251") + b"\x98"
    import re

    both = content.decode("utf-16-le", errors="ignore") + " " + content.decode("cp1251", errors="ignore")
    assert one(spark, binary_text_salvage, content, "binary") == re.sub(r"[^\w\s@.,\-]", " ", both)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<b> b </b>\n\tc</p>", "a b c"),
        ("<title>T &amp; U</title><script>if(a<b){}</script>x<style>p{}</style>", "T & U x"),
        ("a<!-- <p>no</p> -->b<!DOCTYPE html>", "a b"),
        ('<a href="x>y">z</a>', "z"),
        ("&#1048;&#x41;&laquo;&nbsp;&raquo; &unknown; 1 < 2", "ИA«\xa0» &unknown 1 < 2"),
        ("x<script>never closed", "x"),
        ("<template>t</template><ruby>a<rt>b</rt></ruby>", "a"),
        ("&#146;&#0;&#55296;", "’��"),
        ("", ""),
    ],
)
def test_html_text(spark, html, text):
    assert one(spark, html_text, html, "string") == text


@pytest.mark.parametrize("document", ['{"b": 1.50, "a": ["\\u0418", null, 1e2]}', '"x"', "[1,2]", "{", "", "nul"])
def test_json(spark, document):
    row = one(spark, json_parse, document, "string")
    try:
        assert (row.text, row.error) == (json.dumps(json.loads(document), ensure_ascii=False), None)
    except ValueError as problem:
        assert (row.text, row.error) == (None, str(problem))


def test_formats_and_paths(spark):
    paths = ["a/b.PDF", "a/.html", "a-b/x.tar.json", "a/noext", "a/b.bak", "a.csv/x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in format_route(df).collect()} == {"a/b.PDF", "a-b/x.tar.json"}
    assert {r.path for r in format_route(df, {"bak"}).collect()} == {"a/b.bak"}
    assert {r.path for r in format_route(df, set()).collect()} == {"a/b.PDF", "a-b/x.tar.json"}
    assert df.select(file_format(F.col("path"))).collect()[2][0] == "json"
    assert one(spark, format_key, "..HTML", "string") == "html"
    ordered = [r.path for r in df.orderBy(path_order(F.col("path"))).collect()]
    assert ordered == sorted(paths, key=lambda p: p.split("/"))


def test_content_dedup_keeps_the_first_path(spark):
    rows = [("a-b/x", "t"), ("a/x", "t"), ("b", "u"), ("c", "t")]
    kept = content_dedup(spark.createDataFrame(rows, "path string, content string"))
    assert {r.path for r in kept.collect()} == {"a/x", "b"}
    twice = content_dedup(kept.drop("file_hash"))
    assert twice.count() == 2


def test_csv_table(spark, tmp_path):
    utf = tmp_path / "u.csv"
    utf.write_text('id,имя\n1,"Иван, ""Петров"""\n2\n3,a,b\n4,\n', encoding="utf-8-sig")
    rows = [tuple(r) for r in read_csv_table(spark, str(utf)).collect()]
    expected = pd.read_csv(utf, dtype=str, on_bad_lines="skip").fillna("")
    assert rows == [tuple(r) for r in expected.itertuples(index=False)]
    assert read_csv_table(spark, str(utf)).columns == list(expected.columns)
    win = tmp_path / "w.csv"
    win.write_bytes("id,имя\n1,Пётр №5\n".encode("cp1251"))
    table = read_csv_table(spark, str(win))
    assert table.columns == ["id", "имя"]
    assert [tuple(r) for r in table.collect()] == [("1", "Пётр №5")]
    assert [r.text for r in table_rows_text(table).collect()] == ["id имя", "1 Пётр №5"]


def test_table_cells(spark):
    df = spark.createDataFrame([(1, "a@b.ru", "2020-01-02"), (2, "a@b.ru", None), (3, "c@d.org", "x")], "id int, m string, d string")
    found = {tuple(r) for r in table_cell_scan(df).collect()}
    assert found == {("m", "email", 3, 2), ("d", "date_of_birth", 1, 1)}


@pytest.fixture
def dataset(tmp_path):
    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    (root / "a.html").write_text("<p>почта</p><p>a@b.ru</p>", encoding="utf-8")
    (root / "sub" / "copy.html").write_text("<p>почта</p><p>a@b.ru</p>", encoding="utf-8")
    (root / "b.json").write_text('{"k": "серия 45 08 123456"}', encoding="utf-8")
    (root / "bad.json").write_text('{"k": ', encoding="utf-8")
    (root / "c.CSV").write_text("name,birth\nИван Петров,2000-01-02\n", encoding="cp1251")
    (root / "d.pdf").write_bytes(b"%PDF-1.4")
    (root / "e.txt").write_text("a@b.ru")
    (root / "f.doc").write_bytes("тел 8 999 123-45-67 ".encode("utf-16-le"))
    pd.DataFrame({"mail": ["x@y.org", None]}).to_parquet(root / "g.parquet")
    (root / "h.html").write_text("<p>ничего</p>", encoding="utf-8")
    return root


def test_directory(spark, dataset):
    rows, failed = directory_report(spark, str(dataset))
    found = {r.file_path.rsplit("/data/")[1]: (r.categories, r.total_matches, r.protection_level) for r in rows.collect()}
    assert found == {
        "a.html": ("email", 1, "low"),
        "b.json": ("passport", 1, "low"),
        "c.CSV": ("date_of_birth", 1, "low"),
        "f.doc": ("phone", 1, "low"),
        "g.parquet": ("email", 1, "low"),
        "h.html": ("", 0, "none"),
    }
    bad = {r.path.rsplit("/data/")[1]: [(e.attempt, e.error) for e in r.errors] for r in failed.collect()}
    assert set(bad) == {"bad.json", "d.pdf"}
    assert bad["d.pdf"] == [(1, "no text extractor for format: pdf")]
    assert bad["bad.json"][0][1].startswith("Expecting value")


def test_directory_formats_and_extractors(spark, dataset):
    pdf = {"pdf": lambda content: F.struct(F.lit("a@b.ru").alias("text"), F.lit(None).cast("string").alias("error"))}
    rows, failed = directory_report(spark, str(dataset), formats={"txt", "pdf"}, extractors=pdf)
    assert {r.file_format: r.categories for r in rows.collect()} == {"txt": "email", "pdf": "email"}
    assert failed.count() == 0


def test_cli(spark, dataset, tmp_path):
    path = main(["--dataset", str(dataset), "--output", str(tmp_path / "out")])
    names = sorted((tmp_path / "out").glob("reports_*/part-*.csv"))
    rows = [r for n in names for r in csv.DictReader(n.open(encoding="utf-8"))]
    assert len(rows) == 6 and path.startswith(str(tmp_path / "out" / "reports_"))
    assert {r["categories"] for r in rows} >= {"email", ""}
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        main(["--dataset", str(tmp_path / "missing")])


def test_report_sinks(spark, dataset, tmp_path):
    rows, _ = directory_report(spark, str(dataset))
    assert write_report(rows.where("false"), str(tmp_path), "none") is None
    assert not list(tmp_path.glob("reports_none*"))
    single = write_report(rows, str(tmp_path), "one", single_file=True)
    assert len(list((tmp_path / "reports_one").glob("part-*.csv"))) == 1 and single.endswith("reports_one")
    path = write_report(rows, str(tmp_path), "pq", fmt="parquet")
    assert {r.protection_level for r in spark.read.parquet(path).collect()} == {"low", "none"}


def test_stream(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, at timestamp, text string"

    def add(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def run(**options):
        options = options or {"forever": True}
        stream = spark.readStream.schema(schema).parquet(source)
        verdicts = stream_content_dedup(stream, **options).select("id", "markup.categories")
        suffix = "w" if "within" in options else ""
        start_table_sink(verdicts, out + suffix, mark + suffix, available_now=True).awaitTermination()
        return spark.read.parquet(out + suffix).collect()

    from datetime import datetime

    add([(1, datetime(2024, 1, 1), "a@b.ru"), (2, datetime(2024, 1, 1), "a@b.ru"), (3, datetime(2024, 1, 1), "x")])
    assert sorted(r.categories for r in run()) == [[], ["email"]]
    add([(4, datetime(2024, 1, 2), "a@b.ru"), (5, datetime(2024, 1, 2), "серия 45 08 123456")])
    assert sorted(r.categories for r in run()) == [[], ["email"], ["passport"]]
    assert len(run(event_time="at", within="1 hour")) >= 3


def test_csv_files_as_they_are_met(spark, tmp_path):
    """An encoding per file, newlines in quotes, dotted names, surplus fields that are empty."""
    (tmp_path / "a.csv").write_bytes('имя,e.mail\nПётр,a@b.ru\n"серия 45\n08 123456",x\n1,a@b.ru,\nshort\n"a,b",\n'.encode())
    (tmp_path / "b.csv").write_bytes("имя,e.mail\nПётр,c@d.ru\n".encode("cp1251"))
    table = read_csv_table(spark, str(tmp_path))
    assert table.columns == ["имя", "e.mail"]
    assert sorted(tuple(r) for r in table.collect()) == sorted(
        [("Пётр", "a@b.ru"), ("серия 45\n08 123456", "x"), ("short", ""), ("a,b", ""), ("Пётр", "c@d.ru")]
    )
    assert "Пётр c@d.ru" in [r.text for r in table_rows_text(table).collect()]
    found = {(r.column_name, r.category): (r.hits, r.distinct_values) for r in table_cell_scan(table).collect()}
    assert found == {("имя", "passport"): (1, 1), ("e.mail", "email"): (2, 2)}


def test_references_take_linear_time(spark):
    many, padded = "<p>" + "&#1048;" * 10_000 + "</p>", "&#0000000000065;&#x0000000042;&#99999999;&bogus;&amp;"
    rows = spark.createDataFrame([(many,), (padded,)], "h string").select(html_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in rows] == ["И" * 10_000, "AB�&bogus&"]


def test_places_that_overlap(spark):
    """A place counts from the end of the last one that counted; any number of words."""
    from veilscan.operators import names

    listed = ["Нижний Новгород", "Новгород Великий", "Великий Устюг", "Старый Новый Большой Город"]
    places = spark.createDataFrame([(p,) for p in listed], "token string")
    text = "Нижний Новгород Великий Устюг и Старый Новый Большой Город"
    hits = names.name_hits(spark.createDataFrame([(1, text)], "doc_id long, text string"), places=places)
    assert sorted((r.pos, r.place) for r in names.locations(hits).collect()) == [
        (0, "Нижний Новгород"), (2, "Великий Устюг"), (5, "Старый Новый Большой Город"),
    ]


def test_csv_content(spark):
    from veilscan.sources.files import csv_text

    rows = [(b'a,b\n"x, ""y""\nz",1\n', 'a b\nx, "y"\nz 1\n'), ("имя,№\n".encode("cp1251"), "имя №\n"), (b"", ""), (None, None)]
    frame = spark.createDataFrame(rows, "c binary, want string").select(csv_text(F.col("c")).alias("got"), "want")
    assert all(r.got == r.want for r in frame.collect())


def test_a_file_beyond_the_limit_fails_alone(spark, tmp_path):
    for name, size in (("small", 10), ("large", 5_000)):
        (tmp_path / f"{name}.html").write_text("<p>a@b.ru</p>" + "x" * size)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows, failed = directory_report(spark, str(tmp_path))
        assert [r.file_path.rsplit("/", 1)[1] for r in rows.collect()] == ["small.html"]
        (one,) = failed.collect()
        assert one.path.endswith("large.html") and "too large" in one.errors[0].error
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_failures_of_detectors_are_counted(spark, texts_df):
    from veilscan.operators.detect import Plugin, detect, detector_failures, isolated

    def picky(text):
        if "bad" in text:
            raise KeyError(text)
        return [("word", text, 1)]

    found = detect(texts_df(["good", "bad", "bad too"]), rules=[], plugins=[Plugin("picky", "word", isolated(picky, "picky", record=True))])
    assert [tuple(r) for r in detector_failures(found).collect()] == [("picky", "KeyError", 2)]
