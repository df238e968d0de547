"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import (
    alignment, exact, language, licences, neardup, neighbours, packing, quality, secret_scan, sharding, spelling, tokens, toxicity,
)
from veilscan.llm.common import remainder, table, whole_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _labels(spark: SparkSession, sf: str, label: str, held_out: Column) -> DataFrame:
    return (
        table(spark, sf, "labels")
        .where(F.col("doc_id").isNotNull() & ~held_out)
        .select(F.col("doc_id").alias("id"), F.col(label).alias("label"))
    )


def _judged(scored: DataFrame, held_out: Column, least: float) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query("op1_quality")
def op1_quality(spark, sf):
    docs = _documents(spark, sf)
    model = quality.fit(docs, _labels(spark, sf, "quality", remainder("doc_id", 5) == 0))
    return _judged(quality.score(docs, model), remainder("id", 5) == 0, 0.3)


@query("op2_language")
def op2_language(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    model = language.fit(docs.where(remainder("id", 4) != 2))
    return language.identify(docs, model).select(
        F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def tokenizer_of(spark: SparkSession):
    import public_tokenizers

    return tokens.tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_bpe")
def op3_bpe(spark, sf):
    vocabulary = tokenizer_of(spark)
    return tokens.digests(tokens.encode(_documents(spark, sf), vocabulary), vocabulary).withColumnRenamed("id", "doc_id")


@query("op4_near_dedup")
def op4_near_dedup(spark, sf):
    return neardup.near_groups(_documents(spark, sf)).withColumnRenamed("id", "doc_id")


@query("op5_licences")
def op5_licences(spark, sf):
    found = licences.scan(_documents(spark, sf))
    base, more = F.transform("places", lambda p: p.label), F.transform("spans", lambda s: s.label)

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p.start)).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p.start)).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)))
        .alias("score"),
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_exact_dedup",
    f"""
    with lowered as (select doc_id, {_LOWERED} as text from documents),
    grouped as (
        select doc_id, text, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size
        from lowered
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256 from grouped
    """,
)
def op6_exact_dedup(spark, sf):
    return exact.exact_groups(_documents(spark, sf)).withColumnRenamed("id", "doc_id")


@query("op7_packing")
def op7_packing(spark, sf):
    cut_up = packing.pieces(_documents(spark, sf), tokenizer_of(spark), end_id=2, with_ids=False)
    return packing.pack(cut_up).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op8_toxicity")
def op8_toxicity(spark, sf):
    docs = _documents(spark, sf)
    model = toxicity.fit(docs, _labels(spark, sf, "toxic", remainder("doc_id", 3) == 1))
    return _judged(toxicity.score(docs, model), remainder("id", 3) == 1, 0.7)


@query("op9_sharding")
def op9_sharding(spark, sf):
    text = whole_text().cast("binary")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.sha2(text, 256).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return sharding.shards(docs).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_neighbours")
def op10_neighbours(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(vectors, "id % 100 = 0").withColumnRenamed("id", "vec_id")


@query("op11_secrets")
def op11_secrets(spark, sf):
    found = secret_scan.scan(_documents(spark, sf))
    base = F.filter("spans", lambda s: s.base)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *map(number, ("assign", "access", "hex")), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


@query("op12_alignment")
def op12_alignment(spark, sf):
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.measured(_documents(spark, sf), alignment.tokenizers(spark, *paths)).withColumnRenamed("id", "doc_id")


@query("op13_spelling")
def op13_spelling(spark, sf):
    words = spelling.word_counts(_documents(spark, sf))
    usual = (F.col("n") >= spelling.LEAST_TIMES) & (F.length("word") >= spelling.LEAST_LETTERS)
    return spelling.variants(words.where(usual))
