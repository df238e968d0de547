"""CSV files against a parser that walks character by character."""

import random

import pytest
from pyspark.sql import functions as F

from veilscan.sources import csv_blocks as csv_blocks_module
from veilscan.sources.csv_blocks import csv_blocks, csv_records, ends_inside, records, unclosed
from veilscan.sources.files import csv_text
from veilscan.sources.tables import MISSING, distinct_names, read_csv_table, table_rows_text


def by_hand(text):
    """All records of a text: a walk with the states of a field's beginning, its inside, quotes, and a quote in quotes."""
    rows, row, field, state = [], [], "", "begin"
    quoted, k = False, 0
    while k < len(text):
        c = text[k]
        if state == "quotes":
            if c == '"':
                state = "quote"
            else:
                field += c
        elif state == "quote" and c == '"':
            field, state = field + c, "quotes"
        elif c == '"' and state == "begin":
            state, quoted = "quotes", True
        elif c == ",":
            row, field, state = [*row, field], "", "begin"
        elif c in "\r\n":
            if text[k : k + 2] == "\r\n":
                k += 1
            rows.append((row + [field], quoted))
            row, field, state, quoted = [], "", "begin", False
        else:
            field, state = field + c, "inside"
        k += 1
    if state != "quotes" and (row or field or quoted):
        rows.append((row + [field], quoted))
    return [r for r, q in rows if len(r) > 1 or q or r[0].strip(" \t")]


def table_by_hand(text):
    header, *rows = by_hand(text.removeprefix("﻿"))
    kept = [r + [""] * (len(header) - len(r)) for r in rows if len(r) <= len(header)]
    return header, [tuple("" if v in MISSING else v for v in r) for r in kept]


def made(rng, size):
    signs = ['"', '""', ",", "\n", "a", "bc", " ", "é", "\r\n", '"x,y"', '"p\nq"', "NA", "1", "\r"]
    return "".join(rng.choice(signs) for _ in range(size))


def test_records_of_random_texts():
    rng = random.Random(1)
    for _ in range(6000):
        text = made(rng, rng.randint(0, 25))
        assert [[f.decode() for f in r] for r in records(text.encode())] == by_hand(text), text


def test_states_of_lines_compose():
    rng = random.Random(2)
    for _ in range(3000):
        lines = [made(rng, 6).replace("\n", "").encode() for _ in range(4)]
        state = False
        for line in lines:
            state = ends_inside(line, state)
        assert state == ends_inside(b"\n".join(lines), False), lines


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in kept]
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [37, 200, 4000])
def test_blocks_of_any_size(spark, tmp_path, small_blocks, size):
    """Random files, of which each is cut into many blocks; their quotes are closed at the end."""
    rng = random.Random(size)
    small_blocks(size)
    rows = []
    for k in range(4):
        body = made(rng, 700)
        while by_hand("h,i,j\n" + body + "\nzz,zz")[-1] != ["zz", "zz"]:
            body += rng.choice(['"', "\n"])
        text = ("﻿" if k % 2 else "") + "h,i,j\n" + body + "\n" + "plain,row,%d\n" % k * 5
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        rows += table_by_hand(text)[1]
    table = read_csv_table(spark, str(tmp_path))
    assert csv_blocks(spark, str(tmp_path)).count() > (10 if size < 1000 else 3)
    assert table.columns == ["h", "i", "j"]
    assert sorted(tuple(r) for r in table.collect()) == sorted(rows)
    assert table.count() == len(rows)


def test_blocks_that_are_too_many_to_broadcast(spark, tmp_path, small_blocks, monkeypatch):
    """Lines then meet their blocks by a shuffle, and are put in order again."""
    monkeypatch.setattr(csv_blocks_module, "BROADCAST_ROWS", 0)
    small_blocks(60)
    rows = [(str(k), "x\n" * (k % 9) + f'"{k}", y') for k in range(60)]
    text = "a,b\n" + "".join('%s,"%s"\n' % (a, b.replace('"', '""')) for a, b in rows)
    (tmp_path / "a.csv").write_text(text)
    assert sorted(tuple(r) for r in read_csv_table(spark, str(tmp_path)).collect()) == sorted(rows)


def test_long_fields_and_many_quotes(spark, tmp_path, small_blocks):
    small_blocks(100_000)
    fields = ['"' + "x,\n" * 350_000 + '"', '"' + '""' * 100_000 + '"', "y" * 1_000_000, '"' + "z" * 3_000 + '"', ",".join("abc")]
    text = "a,b\n" + "".join(f"{i},{f}\n" for i, f in enumerate(fields)) + "5,last\n"
    (tmp_path / "long.csv").write_text(text)
    found = {r.a: r.b for r in read_csv_table(spark, str(tmp_path)).collect()}
    assert found == {"0": "x,\n" * 350_000, "1": '"' * 100_000, "2": "y" * 1_000_000, "3": "z" * 3_000, "5": "last"}
    many = "a,b\n" + ",".join("c" * 200_000) + "\n1,2\n"
    assert [len(r) for r in records(many.encode())] == [2, 200_000, 2]


def test_one_record_through_many_blocks(spark, tmp_path, small_blocks):
    """Also where it is the header, and where the file has no line end."""
    small_blocks(50)
    (tmp_path / "a.csv").write_bytes(('"' + "h\n" * 200 + '",i\n1,"' + "k\n" * 300 + '"\n2,3').encode())
    table = read_csv_table(spark, str(tmp_path))
    assert table.columns == ["h\n" * 200, "i"]
    assert sorted(tuple(r) for r in table.collect()) == [("1", "k\n" * 300), ("2", "3")]


def test_a_quote_that_is_never_closed(spark, tmp_path, small_blocks):
    small_blocks(40)
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 30 + '3,"' + "x\n" * 100)
    (tmp_path / "b.csv").write_text("a,b\n4,5\n")
    found = sorted(tuple(r) for r in read_csv_table(spark, str(tmp_path)).collect())
    assert found == [("1", "2")] * 30 + [("4", "5")]
    (bad,) = unclosed(csv_blocks(spark, str(tmp_path))).collect()
    assert bad.file.endswith("a.csv") and 80 <= bad.start <= 124


def test_files_as_users_have_them(spark, tmp_path):
    text = 'имя,n,n\r\nПётр,NA,"null"\r\n5" pipe,1,2\r\n6" pipe,3\r\n3,4,5,6\r\n3,4,5,\r\n  \r\n\r\n"a""b"c,"x\r\ny",-nan\r\n'
    (tmp_path / "a.csv").write_bytes(text.encode("cp1251"))
    table = read_csv_table(spark, str(tmp_path), file="from")
    assert table.columns == ["имя", "n", "n.1", "from"]
    found = sorted(tuple(r)[:3] for r in table.collect())
    assert found == sorted([("Пётр", "", ""), ('5" pipe', "1", "2"), ('6" pipe', "3", ""), ('a"bc', "x\r\ny", "")])
    assert table.count() == 4 and table.where("n = '1'").count() == 1
    lines = [r.text for r in table_rows_text(table.drop("from")).collect()]
    assert sorted(lines) == sorted(["имя n n.1", "Пётр  ", '5" pipe 1 2', '6" pipe 3 ', 'a"bc x\r\ny '])
    one = spark.createDataFrame([(text.encode("cp1251"),)], "c binary").select(csv_text(F.col("c")).alias("x")).first().x
    assert sorted(one.replace("\r\n", "<br>").rstrip("\n").split("\n")) == sorted(x.replace("\r\n", "<br>") for x in lines)


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_csv_table(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text("\n\n")
    assert csv_records(spark, str(tmp_path)).count() == 0
    frame = spark.createDataFrame([(b"",), (None,), (b"a,b\n",)], "c binary").select(csv_text(F.col("c")).alias("x"))
    assert [r.x for r in frame.collect()] == ["", None, "a b\n"]


def test_names_that_are_equal():
    assert distinct_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    assert distinct_names(["a", "", "A", "b"]) == ["a", "Unnamed: 1", "A.1", "b"]
