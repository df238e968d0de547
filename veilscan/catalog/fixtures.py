"""Test corpora derived from the given tables.

Every fixture is one SELECT that Spark and DuckDB evaluate alike, so the query
and its SQL check read the same rows and both grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.sources.tables import spread

# Documents as files; the format follows the document number.
DOCS = """
select doc_id, text,
       source || '/' || cast(doc_id as string) || '.' ||
       case doc_id % 6 when 0 then 'txt' when 1 then 'html' when 2 then 'CSV'
                       when 3 then 'json' when 4 then 'pdf' else 'bak' end as path
from documents
"""

# One Russian record per customer, one line per kind of personal data.
PII_DOCS = """
select k as doc_id, case when k % 29 = 28 then '  ' || chr(10) || chr(9) || ' ' else concat_ws(chr(10),
  'Запись ' || cast(k as string),
  case when k % 2 = 0 then 'ИНН: ' || cast(100000000000 + k * 7919 as string) || ' ок' end,
  case when k % 3 = 0 then 'ид ' || snils || ' ' || lpad(cast(control as string), 2, '0') || ' ок' end,
  case when k % 9 = 0 then 'ид ' || snils || ' ' || lpad(cast((control + 1) % 100 as string), 2, '0') || ' ок' end,
  case when k % 4 = 0 then 'тел 8 (912) 345-67-' || lpad(cast(k % 100 as string), 2, '0') || ' ок' end,
  case when k % 4 = 1 then 'тел +7 912 345-67-' || lpad(cast(k % 100 as string), 2, '0') || ' ок' end,
  case when k % 5 = 0 then 'почта user' || cast(k as string) || '@example.com ок' end,
  case when k % 16 = 0 then 'права 77 АР ' || tail || ' ок' end,
  case when k % 16 = 8 then 'права 77 ОВ ' || tail || ' ок' end,
  case when k % 10 = 0 then 'дата 01.02.19' || lpad(cast(k % 100 as string), 2, '0') || ' ок' end,
  case when k % 11 = 0 then 'адрес ул. Ленина д. ' || cast(k % 99 + 1 as string) || ' ок' end,
  case when k % 11 = 1 then 'адрес ул. Ленина, д. ' || cast(k % 99 + 1 as string) || ' ок' end,
  case when k % 12 = 0 then 'Диагноз: грипп' end,
  case when k % 13 = 0 then 'серия 45 08 ' || tail || ' ок' end,
  case when k % 17 = 0 then 'клиент ' || case k % 3 when 0 then 'Иванова Мария Петровна'
       when 1 then 'СИДОРОВ Пётр Иванович' else 'кузнецова анна' end || ', ок' end,
  case when k % 34 = 0 then 'клиент Иванова Анна, ок' end,
  case when k % 19 = 0 then 'живёт: ' || case k % 2 when 0 then 'Нижний Новгород' else 'Москва' end || '. ок' end,
  case when k % 14 = 0 then 'повтор ИНН: ' || cast(100000000000 + k * 7919 + 5 as string) || ' ок' end,
  case when k % 14 = 7 then cast(100000000000 + k * 7919 as string) || ' и ИНН ' || cast(100000000000 + k * 7919 as string) end,
  case when k % 30 = 0 then 'копия user' || cast(k as string) || '@example.com, user' || cast(k as string) || '@example.com' end,
  case when k % 21 = 0 then 'document no. 71' || tail || ' ок' end,
  case when k % 26 = 0 then 'паспорта 4508-' || tail || ' 45 08 ' || tail end,
  case when k % 37 = 0 then 'вход по Face ID, лечение у врача' end,
  case when k % 39 = 0 then 'карта 4111 1111 1111 1111 и 4111-1111-1111-1112' end
) end as text
from (
  select k, snils, tail, (
    cast(substr(snils, 1, 1) as int) * 9 + cast(substr(snils, 2, 1) as int) * 8 + cast(substr(snils, 3, 1) as int) * 7 +
    cast(substr(snils, 5, 1) as int) * 6 + cast(substr(snils, 6, 1) as int) * 5 + cast(substr(snils, 7, 1) as int) * 4 +
    cast(substr(snils, 9, 1) as int) * 3 + cast(substr(snils, 10, 1) as int) * 2 + cast(substr(snils, 11, 1) as int)
  ) % 101 % 100 as control
  from (
    select c_custkey as k, lpad(cast(c_custkey % 1000000 as string), 6, '0') as tail,
           substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7, 3) as snils
    from (select c_custkey, lpad(cast((112233000 + c_custkey) % 1000000000 as string), 9, '0') as n from customer) a
  ) b
) c
"""

# JSON documents of which some lack their closing brace.
JSON_DOCS = """
select event_id, case when event_id % 50 = 0 then substr(props, 1, length(props) - 1) else props end as body
from events
"""

# JSON documents with what a re-serialisation changes, and how they then read; null where they are broken.
JSON_RECORDS = """
select k, case when k % 11 = 0 then raw || ' x' when k % 7 = 0 then '{"z":1,"id" : 2 ,"z":' || k || '}' else raw end as body,
       case when k % 11 = 0 then null when k % 7 = 0 then '{"z": ' || k || ', "id": 2}' else clean end as text
from (
  select cast(c_custkey as string) as k_text, c_custkey as k,
    '{ "id" :' || cast(c_custkey as string) || ' ,' || chr(9) || '"name":"' || c_name || chr(92) || 'u0041' || chr(92) || '/' || chr(92) || 'u000a' ||
    chr(92) || '"' || chr(92) || 'u0418","tags" : [ "' || c_mktsegment || ', a: b",[ ],{ } ,null , true],' || chr(10) || '"n":[1.50,' ||
    cast(c_custkey as string) || 'e2, -0,0.10,1E-7] }' as raw,
    '{"id": ' || cast(c_custkey as string) || ', "name": "' || c_name || 'A/' || chr(92) || 'n' || chr(92) || '"И", "tags": ["' ||
    c_mktsegment || ', a: b", [], {}, null, true], "n": [1.5, ' || cast(c_custkey as string) || '00.0, 0, 0.1, 1e-07]}' as clean
  from customer
) c
"""

# Stored files: path, the text of their bytes, the text that is to come out of them, and whether one does. CSV files hold
# a table of records each, with line breaks in quotes.
STORED_PLAIN = {
    "documents": "select 'documents/' || cast(doc_id as string) || case when doc_id % 3 = 0 then '.pdf' else '.bak' end as path, "
    "coalesce(text, '') as body from documents",
    "pages": "select 'pages/' || cast(page_id as string) || '.html' as path, html as body from pages",
    "events": f"select 'events/' || cast(event_id as string) || '.json' as path, body from ({JSON_DOCS}) e",
    "customer": f"select 'records/' || cast(doc_id as string) || '.html' as path, text as body from ({PII_DOCS}) r",
}
CSV_ROW = "'\"' || replace(text, '\"', '\"\"') || '\",' || cast(doc_id as string)"

NAMES = (
    ("Иванова", "last"), ("Сидоров", "last"), ("Кузнецова", "last"), ("Петров", "last"),
    ("Мария", "first"), ("Пётр", "first"), ("Анна", "first"), ("Иван", "first"),
)
PLACES = ("Москва", "Нижний Новгород", "Новгород")

_TABLE_OF = {DOCS: "documents", PII_DOCS: "customer", JSON_DOCS: "events", JSON_RECORDS: "customer"}
_TABLE_OF |= {sql: name for name, sql in STORED_PLAIN.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Evaluate a fixture's SELECT over its table."""
    name = _TABLE_OF[sql]
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(plain.replace(f"from {name}", "from {source}"), source=table(spark, sf_dir, name))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, DOCS)


def pii_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, PII_DOCS)


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, JSON_DOCS)


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, JSON_RECORDS)


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, content) of files that were made of the given tables."""
    parts = [fixture(spark, sf_dir, sql) for sql in STORED_PLAIN.values()]
    rows = pii_docs(spark, sf_dir).select((F.col("doc_id") % 25).alias("g"), "doc_id", F.expr(CSV_ROW).alias("row"))
    lines = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "row"))).alias("rows"))
    body = F.concat(F.lit("text,k\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"))
    files = lines.select(F.concat(F.lit("tables/"), F.col("g").cast("string"), F.lit(".csv")).alias("path"), body.alias("body"))
    for part in parts:
        files = files.unionByName(part)
    return files.select("path", F.octet_length("body").cast("bigint").alias("length"), F.encode("body", "UTF-8").alias("content"))


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAMES), "token string, kind string")


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PLACES], "token string")
