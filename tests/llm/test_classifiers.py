"""Language, toxicity and quality: held-out results and awkward rows."""

import pytest
from pyspark.sql import functions as F

from veilscan.llm import language, quality, toxicity
from veilscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = QUERIES["op2_language"](spark, SF).where("held_out")
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right, total = rows.join(lang, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.98
    assert QUERIES["op2_language"](spark, SF).count() == 1000


@pytest.mark.parametrize("name, label", [("op1_quality", "quality"), ("op8_toxicity", "toxic")])
def test_labels_held_out(spark, name, label):
    rows = QUERIES[name](spark, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = rows.where("held_out").join(labels, "doc_id")
    right = judged.where(F.col(label) == F.col("predicted")).count() / judged.count()
    assert right > 0.9
    assert rows.count() == 1000 and rows.where("score < 0 or score > 1 or score is null").count() == 0


def test_hyperdimensional_vectors_by_hand():
    import numpy as np
    import pyarrow as pa

    text = "ab C"
    letters = [language._letter_vector(ord(c), 64) for c in " ab c "]
    hand = sum(np.roll(letters[i], 2) * np.roll(letters[i + 1], 1) * letters[i + 2] for i in range(4))
    assert np.array_equal(language.bundles(pa.array([None, text, "?", "a--b  c!"]), 64)[1], hand)


def test_awkward_texts(spark, frame, nothing):
    docs, texts = frame
    learned = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "id long, text string, lang string")
    model = language.fit(learned)
    found = {r.id: r for r in language.identify(docs, model).collect()}
    assert len(found) == len(texts)
    assert [found[i].lang_pred for i in range(4)] == ["und"] * 4 and found[10].lang_pred in ("en", "de")
    assert language.identify(nothing, model).count() == 0
    none = language.fit(learned.where("false"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 1), (10, 0), (11, 1), (11, 0), (99, 1), (None, 1)], "id long, label int")
    for kind in (toxicity, quality):
        for given in (labels, labels.where("label = 1"), labels.where("false")):
            rows = kind.score(docs, kind.fit(docs, given)).collect()
            assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
        assert kind.score(nothing, kind.fit(docs, labels)).count() == 0
        twice = kind.score(docs.union(docs), kind.fit(docs, labels))
        assert twice.count() == 2 * len(texts) and twice.distinct().count() == len(texts)


def test_models_and_limits_of_all_texts(spark):
    """4,000 texts of a language: the prototype is the sum of them all, and the limit a quantile of them all."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(8)) for _ in range(4000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "id long, text string, lang string")
    model = language.fit(docs)
    whole = language.bundles(pa.array(texts), language.DIMENSIONS).sum(axis=0, dtype=np.float64)
    assert np.allclose(model[1][0], whole / np.linalg.norm(whole), atol=1e-6)
    found = {r.letters: r.limit for r in language.limits(docs, model).collect()}
    scores = language.identify(docs.withColumn("letters", language.letter_class(F.col("text"))), model, carry=("letters",)).toPandas()
    for letters, own in scores.groupby("letters").score:
        if len(own) >= 50:
            assert 0 <= own.quantile(0.005) - found[letters] <= 1 / language.STEPS + 1e-9


def test_bundles_need_little_memory(spark):
    """A chunk of many kinds of trigrams: the vectors and counts at a time are bounded, the sums are those of text by text."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x4E00 + 400, (400, 100))]
    language.bundles(pa.array(texts[:2]), 1024)
    tracemalloc.start()
    found = language.bundles(pa.array(texts), 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(language.trigrams(pa.array(texts))[2]) > 16384 and peak < 60e6
    alone = np.concatenate([language.bundles(pa.array([t]), 1024) for t in texts])
    assert np.array_equal(found, alone)


def test_many_short_texts_come_in_slices():
    import pyarrow as pa

    from veilscan.llm.common import chunks

    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 10_000)], ["text"])
    sizes = [c.num_rows for c in chunks(iter([batch]), rows=language.TEXTS)]
    assert sum(sizes) == 10_000 and max(sizes) == language.TEXTS


def test_workers_keep_one_operators_state():
    from veilscan.llm.common import worker_state

    made = []
    for operator in ("tokens", "tokens", "language", "tokens"):
        worker_state(operator, "words", lambda operator=operator: made.append(operator))
    assert made == ["tokens", "language", "tokens"]
    worker_state("none", "nothing", object)


@pytest.mark.parametrize("name", ["known_language", "not_toxic"])
def test_texts_go_to_python_once(spark, monkeypatch, name):
    import corpus_pipeline

    sent = []
    for module, function in ((language, "identify"), (toxicity, "score")):
        whole = getattr(module, function)
        monkeypatch.setattr(module, function, lambda docs, *a, whole=whole, **b: sent.append(docs.schema) or whole(docs, *a, **b))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = getattr(corpus_pipeline, name)(spark, docs, SF)
    assert after.schema.names == docs.columns and after.exceptAll(docs).isEmpty() and after.count() > 800
    assert "text" not in sent[-1]["row"].dataType.names
