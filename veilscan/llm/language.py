"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is its letters' vectors,
rotated by their place and multiplied (bound); a text is the sum (bundle) of its
trigrams; a language prototype is the sum of its texts. A text gets the language
whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import chunks, code_points, worker_state

DIMENSIONS = 1024
UNKNOWN = "und"
LONGEST = 8
#: Steps of a cosine, as far as limits tell them apart.
STEPS = 1 << 16
#: Trigrams whose vectors, and numbers in a table of texts by trigrams, that are worked on at a time.
BLOCK, CELLS = 2048, 1 << 20
#: Texts that get their vectors at a time, however short they are.
TEXTS = 2048
_SPACE = 32


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    vectors = worker_state("language", f"letters_{dimensions}", dict)
    if code not in vectors:
        bits = np.random.default_rng([0x5EED, code]).integers(0, 2, dimensions)
        vectors[code] = (2 * bits - 1).astype(np.float32)
    return vectors[code]


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (all below ``size``), and the place of each value among them."""
    if size > 1 << 23:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[values] = True
    kinds = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[values]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram) of every place, as numbers, and the letters of each trigram number.

    Letters are lower-cased; whatever lies between them, or at an end, is one space.
    """
    codes, starts = code_points(texts, lower=True)
    letters = worker_state("language", "letter_table", _letter_table)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    inside = letters[codes]
    fresh = np.diff(text, prepend=-1) != 0
    keep = inside | np.concatenate([[True], inside[:-1]])[: len(codes)] | fresh
    codes, text = np.where(inside, codes, np.uint32(_SPACE))[keep], text[keep]
    # A space before each text's first letter and after its last one.
    heads = np.flatnonzero((np.diff(text, prepend=-1) != 0) & (codes != _SPACE))
    codes, text = np.insert(codes, heads, _SPACE), np.insert(text, heads, text[heads])
    tails = np.flatnonzero((np.diff(text, append=-1) != 0) & (codes != _SPACE)) + 1
    codes, text = np.insert(codes, tails, _SPACE), np.insert(text, tails, text[tails - 1])
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.uint32)
    alphabet, symbol = _numbered(codes, 0x110000)
    size = len(alphabet)
    gram = (symbol[:-2] * size + symbol[1:-1]) * size + symbol[2:]
    whole = text[:-2] == text[2:]
    kinds, gram = _numbered(gram[whole], size**3)
    shape = np.stack([alphabet[kinds // size**2], alphabet[kinds // size % size], alphabet[kinds % size]], axis=1)
    return text[:-2][whole], gram, shape.reshape(-1, 3)


def bundles(texts: pa.Array, dimensions: int) -> np.ndarray:
    """One vector for each text."""
    text, gram, shape = trigrams(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(gram):
        return out
    used, place = np.unique(shape, return_inverse=True)
    base = np.stack([_letter_vector(int(c), dimensions) for c in used])
    second, third = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    place = place.reshape(shape.shape)
    block = (gram // BLOCK).astype(np.min_scalar_type(len(shape) // BLOCK))
    order = np.argsort(block, kind="stable")  # the places of a block's trigrams, text by text
    ends = np.cumsum(np.bincount(block, minlength=-(-len(shape) // BLOCK)))
    for number, (low, high) in enumerate(zip([0, *ends], ends)):
        rows, columns = text[order[low:high]], gram[order[low:high]] - number * BLOCK
        part = place[number * BLOCK : (number + 1) * BLOCK]
        bound = third[part[:, 0]]
        bound *= second[part[:, 1]]
        bound *= base[part[:, 2]]
        step = max(1, CELLS // len(part))
        for first in range(0, len(texts), step):
            a, b = np.searchsorted(rows, [first, first + step])
            n = min(step, len(texts) - first)
            counts = np.bincount((rows[a:b] - first) * len(part) + columns[a:b], minlength=n * len(part))
            out[first : first + n] += counts.reshape(n, -1).astype(np.float32) @ bound
    return out


def fit(labelled: DataFrame, max_languages: int = 1000, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language prototypes from ``(id, text, lang)``.

    Every text of the ``max_languages`` most frequent languages counts. The
    sums are made where the texts are; the driver gets one vector per language.
    Rows without a language are left out; without any labelled text there are
    no prototypes.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    frequent = sizes.orderBy(F.desc("_n"), "lang").limit(max_languages).select("lang")
    used = labelled.join(F.broadcast(frequent), "lang").select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in chunks(batches, rows=TEXTS):
            languages = np.array(batch.column("lang").to_pylist(), object)
            vectors = bundles(batch.column("text"), dimensions)
            for language in set(languages):
                add = vectors[languages == language].sum(axis=0, dtype=np.float64)
                total[language] = total.get(language, 0) + add
        if total:
            vectors = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), vectors], ["lang", "vector"])

    rows = (
        used.mapInArrow(sums, "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("at", "value"))
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    languages = sorted({r.lang for r in rows})
    prototypes = np.zeros((len(languages), dimensions))
    for r in rows:
        prototypes[languages.index(r.lang), r.at] = r.value
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return languages, (prototypes / np.maximum(norms, 1e-12)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text)`` with the nearest language and its cosine.

    ``und`` with 0 where the text is null, has no letter, or no language was
    learned. Ties go to the first language in alphabetical order; the cosine
    is cut off at 0. Rows come back as often as they came in, with the
    columns named in ``carry``.
    """
    languages, prototypes = model
    dimensions = prototypes.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, rows=TEXTS):
            vectors = bundles(batch.column("text"), dimensions)
            norms = np.linalg.norm(vectors, axis=1)
            known = (norms > 0) & bool(languages)
            best, score = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
            if languages:
                cosines = vectors @ prototypes.T / np.maximum(norms, 1e-12)[:, None]
                best = cosines.argmax(axis=1)
                score = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0)
            names = [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ["id", *carry]), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["id", *carry, "lang_pred", "score"],
            )

    names = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("id", *carry))
    return docs.select(*dict.fromkeys(["id", *carry, "text"])).mapInArrow(nearest, f"{names}, lang_pred string, score double")


def letter_class(text: Column) -> Column:
    """Texts of 2^k to 2^(k+1) letters are class k; from 2^``LONGEST`` letters on all are of one class."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.least(F.floor(F.log2(F.greatest(letters, F.lit(1)))), F.lit(LONGEST)).cast("int")


def held_out() -> Column:
    """A fifth of the rows, by a hash of ``id``, for limits: ``fit`` must not see them."""
    return F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(5)) == 0


def limits(held: DataFrame, model: tuple[list[str], np.ndarray], lost: float = 0.005, least: int = 50) -> DataFrame:
    """``(lang_pred, letters, limit)``: the cosine that all but ``lost`` of a language's texts of that length reach.

    ``held`` is ``(id, text, lang)`` that the model has not seen; every text
    counts whose language is recognised. Lengths of fewer than ``least`` texts
    are measured by longer texts cut to them, and have no limit if these are as
    few. Cosines are rounded down to multiples of 1 / ``STEPS`` and counted, so
    that a limit is found among so many values, however many texts there are.
    """
    held = held.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ends = F.filter(F.array(*(F.lit(3 << k) for k in range(LONGEST))), lambda n: n < F.length("text"))
    texts = F.transform(F.concat(F.array(F.lit(0)), ends), lambda n: F.struct((n == 0).alias("whole"), F.when(n == 0, F.col("text")).otherwise(F.substring("text", F.lit(1), n)).alias("text")))
    pieces = held.select("id", "lang", F.explode(texts).alias("_p")).select("id", "lang", "_p.*")
    pieces = pieces.withColumn("letters", letter_class(F.col("text")))
    right = identify(pieces, model, carry=("lang", "letters", "whole")).where("lang = lang_pred")
    counted = right.groupBy("lang_pred", "letters", (F.floor(F.col("score") * STEPS) / STEPS).alias("score")).agg(
        F.count_if("whole").alias("n"), F.count(F.lit(1)).alias("m")
    )
    found = counted.groupBy("lang_pred", "letters").agg(
        F.percentile("score", lost, F.col("n")).alias("own"),
        F.percentile("score", lost, F.col("m")).alias("any"),
        F.sum("n").alias("n"),
        F.sum("m").alias("m"),
    )
    limit = F.when(F.col("n") >= least, F.col("own")).when(F.col("m") >= least, F.col("any"))
    return found.select("lang_pred", "letters", limit.alias("limit"))
