"""A corpus pipeline over ``documents``: language, toxicity, copies, near copies, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept; all but the last return rows and columns of ``documents`` as they came. A null
text has no language, so it leaves in the first stage. Rows need a ``doc_id`` to be
kept by the stages that compare documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import exact, language, neardup, packing, toxicity
from veilscan.llm.common import cut, kept_rows, table, with_row
from veilscan.llm.queries import tokenizer_of
from veilscan.session import work_dir

#: A text further from every language than this is in none of them, where nothing was learned of its length.
LEAST_COSINE = 0.05
#: The chance of toxicity from which a document goes.
TOXIC = 0.7


def _used(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names; where it names none, all stay.

    A document is in a language if its cosine is one that held-out documents
    of that language and of its length have.
    """
    labelled = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    model = language.fit(labelled.where(~language.held_out()))
    if not model[0]:
        model = language.fit(labelled)
    if not model[0]:
        return docs
    limits = cut(language.limits(labelled.where(language.held_out()), model))
    rows = with_row(docs, ("text",), id="doc_id", text="text").withColumn("letters", language.letter_class(F.col("text")))
    found = language.identify(rows, model, carry=("row", "text", "letters")).join(F.broadcast(limits), ["lang_pred", "letters"], "left")
    near = F.col("score") >= F.coalesce("limit", F.lit(LEAST_COSINE))
    return kept_rows(found, (F.col("lang_pred") != language.UNKNOWN) & near, docs.columns, ("text",))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the limit, by a model of those that have a label."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(_used(docs), labels)
    scored = toxicity.score(with_row(docs, ("text",), id="doc_id", text="text"), model, carry=("row", "text"))
    return kept_rows(scored, F.col("score") < TOXIC, docs.columns, ("text",))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z in lower case, the document with the largest id."""
    kept = exact.exact_groups(_used(docs)).where("kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(kept, "doc_id", "left_semi")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more, the document with the smallest id."""
    kept = neardup.near_groups(_used(docs)).where("kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(kept, "doc_id", "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024."""
    cut_up = packing.pieces(_used(docs), tokenizer_of(spark), end_id=2, with_ids=False)
    return packing.pack(cut_up).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: Trained models and hashing decide: SQL can't say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{work_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
