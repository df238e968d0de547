"""Full names and places from gazetteers supplied by the caller.

Words (and short phrases) of the cleaned text are equi-joined to the
gazetteers. A gazetteer is broadcast only after a check of its size; a larger
one is shuffled, with the text's words salted so that a very common word does
not land in one task. Names and places share one pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.matching import find_all
from veilscan.functions.text import clean_for_names, prefix_for_names

# How a name is accepted.
MAX_WORDS, MIN_WORD_CHARS = 3, 4
PATRONYMIC = "(?:ович|евич|ьич|овна|евна|ична)$"

TOKEN = r"\p{L}[\p{L}\p{N}-]*|\S"

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20
SALTS = 16


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven to fit a broadcast; reads ``rows`` + 1 rows at most."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def gazetteer(names: DataFrame | None, places: DataFrame | None) -> DataFrame:
    """(phrase, normal, place): one row per lower-cased entry of either list.

    ``names`` has ``token`` and may have ``normal``, the form to report.
    """
    none = F.lit(None).cast("string")
    parts = []
    if names is not None:
        normal = F.coalesce("normal", "token") if "normal" in names.columns else F.col("token")
        parts.append(names.select(F.lower("token").alias("phrase"), normal.alias("normal"), none.alias("place")))
    if places is not None:
        parts.append(places.select(F.lower("token").alias("phrase"), none.alias("normal"), F.col("token").alias("place")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("phrase").agg(F.min("normal").alias("normal"), F.min("place").alias("place"))


def longest_place(table: DataFrame) -> int:
    """The words of the gazetteer's longest place, as many as a text's phrases need."""
    return table.agg(F.max(F.size(find_all(F.coalesce("place", F.lit("")), TOKEN)))).first()[0] or 1


def token_count(text: Column) -> Column:
    """How many positions a text takes: words and punctuation marks."""
    return F.size(find_all(clean_for_names(F.coalesce(text, F.lit(""))), TOKEN))


def phrases_of(
    df: DataFrame, text: str, key: str, longest: int = 1, max_chars: int | None = None, own: str | None = None, before: str | None = None
) -> DataFrame:
    """(key, pos, n, word, phrase): every word, and phrases of up to ``longest`` words.

    Punctuation takes a position of its own, so it breaks a run of words. For
    texts that are parts of a longer one, ``own`` names a column with the
    positions of a part without what follows it, ``before`` one with those
    before the part.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    if max_chars is not None:
        source = prefix_for_names(source, max_chars)
    limit, first = (F.col(c) if c else F.lit(None) for c in (own, before))
    tokens = df.select(key, limit.alias("_own"), first.alias("_first"), find_all(clean_for_names(source), TOKEN).alias("_tokens"))

    def entry(n: int):
        return lambda word, i: F.struct(
            i.alias("pos"),
            F.lit(n).alias("n"),
            word.alias("word"),
            (F.lower(word) if n == 1 else F.lower(F.array_join(F.slice("_tokens", i + 1, n), " "))).alias("phrase"),
        )

    entries = F.concat(*(F.transform("_tokens", entry(n)) for n in range(1, longest + 1)))
    if own is not None:
        entries = F.filter(entries, lambda e: e["pos"] < F.col("_own"))
    rows = tokens.select(key, "_first", F.explode_outer(entries).alias("_e")).select(key, "_first", "_e.*")
    if before is not None:
        rows = rows.withColumn("pos", F.col("pos") + F.col("_first"))
    return rows.drop("_first").where(F.col("word").rlike(r"^\p{L}"))


def name_hits(
    df: DataFrame,
    names: DataFrame | None = None,
    places: DataFrame | None = None,
    text: str = "text",
    key: str = "doc_id",
    max_chars: int | None = None,
    small: bool | None = None,
    own: str | None = None,
    before: str | None = None,
) -> DataFrame:
    """(key, pos, name_word, place, n): what the gazetteers know at a position.

    ``place`` is the longest place that starts there and ``n`` its words. A
    word with a patronymic ending is a name word without an entry. The rows
    are partitioned by ``key``, so the steps after this one do not shuffle.
    """
    table = gazetteer(names, places)
    phrases = phrases_of(df, text, key, 1 if places is None else longest_place(table), max_chars, own, before)
    patronymic = (F.col("n") == 1) & F.col("phrase").rlike(PATRONYMIC) & F.lit(names is not None)
    if is_small(table) if small is None else small:
        found = phrases.join(F.broadcast(table), "phrase", "left").where(
            F.col("normal").isNotNull() | F.col("place").isNotNull() | patronymic
        )
    else:
        salted = phrases.withColumn("_salt", F.pmod(F.xxhash64(key, "pos"), F.lit(SALTS)).cast("int"))
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = salted.join(copies, ["phrase", "_salt"]).drop("_salt")
        found = found.unionByName(phrases.where(patronymic), allowMissingColumns=True)
    hits = found.select(
        key,
        "pos",
        F.when(F.col("n") == 1, F.col("normal")).alias("normal"),
        F.when(patronymic, F.col("word")).alias("ruled"),
        "place",
        F.when(F.col("place").isNotNull(), F.col("n")).alias("n"),
    )
    return (
        hits.where("normal is not null or ruled is not null or place is not null")
        .repartition(F.col(key))
        .groupBy(key, "pos")
        .agg(
            F.coalesce(F.max("normal"), F.max("ruled")).alias("name_word"),
            F.max_by("place", "n").alias("place"),
            F.max("n").alias("n"),
        )
    )


def found_in(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, name, place): the full names and the places of a text, by where they start.

    A name is a run of 2-3 name words, each of 4 characters or more. A place
    that starts inside the last one that counted is not counted. One text's
    hits are one array, in the partitioning by ``key``.
    """
    hit = F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("n").cast("int").alias("n"), "name_word", "place")
    texts = hits.groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("_hits"))

    def word(at: Column, pos: Column) -> Column:
        """The name word of a hit, if it stands at ``pos``."""
        near = F.get("_hits", at)
        return F.when(near["pos"] == pos, near["name_word"])

    def name(h: Column, i: Column) -> Column:
        before = F.when(i > 0, word(i - 1, h["pos"] - 1))
        words = [h["name_word"], *(word(i + k, h["pos"] + k) for k in range(1, MAX_WORDS))]
        accepted = before.isNull() & words[0].isNotNull() & words[1].isNotNull()
        for w in words:
            accepted = accepted & (F.coalesce(F.length(w), F.lit(MIN_WORD_CHARS)) >= MIN_WORD_CHARS)
        # Words after a gap do not belong to the run.
        words[2] = F.when(words[1].isNotNull(), words[2])
        return F.struct(h["pos"].alias("pos"), F.when(accepted, F.concat_ws(" ", *words)).alias("name"), F.lit(None).cast("string").alias("place"))

    entry = "array<struct<pos:bigint,name:string,place:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast(entry).alias("taken"))

    def step(state: Column, h: Column) -> Column:
        free = h["pos"] >= state["end"]
        found = F.struct(h["pos"].alias("pos"), F.lit(None).cast("string").alias("name"), h["place"].alias("place"))
        return F.struct(
            F.when(free, h["pos"] + h["n"]).otherwise(state["end"]).alias("end"),
            F.when(free, F.concat(state["taken"], F.array(found))).otherwise(state["taken"]).alias("taken"),
        )

    names = F.filter(F.transform("_hits", name), lambda f: f["name"].isNotNull())
    places = F.aggregate(F.filter("_hits", lambda h: h["place"].isNotNull()), start, step)["taken"]
    return texts.select(key, F.explode_outer(F.concat(names.cast(entry), places)).alias("_f")).where("_f is not null").select(key, "_f.*")


def found_in_parts(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, name, place) like ``found_in``, for documents whose hits are too many for one array.

    Hits that neither touch nor overlap have nothing to do with each other, so
    a document's hits fall into runs, and each run is an array.
    """
    order = Window.partitionBy(key).orderBy("pos")
    reach = F.max(F.col("pos") + F.coalesce("n", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int")
    runs = hits.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order))
    each = runs.select(F.struct(F.col(key).alias("key"), "_run").alias("_k"), "pos", "n", "name_word", "place")
    return found_in(each, "_k").select(F.col("_k.key").alias(key), "pos", "name", "place")


def name_candidates(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, name): every full name in the text."""
    return found_in(hits, key).where(F.col("name").isNotNull()).select(key, "pos", "name")


def locations(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, place): every place in the text."""
    return found_in(hits, key).where(F.col("place").isNotNull()).select(key, "pos", "place")


def name_longest(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """The longest name per document and first word; the earliest wins ties."""
    return (
        candidates.groupBy(key, F.lower(F.substring_index("name", " ", 1)).alias("first_word"))
        .agg(F.max_by("name", F.struct(F.length("name"), -F.col("pos"))).alias("name"), F.min("pos").alias("pos"))
    )


def name_matches(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    names: DataFrame | None = None,
    places: DataFrame | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """(key, name_matches): places as addresses, then full names, per document."""
    found = found_in(name_hits(df, names, places, text, key, max_chars), key)

    def entry(rank: int, group: Column, category: str, detector: str, value: str) -> Column:
        match = F.struct(
            F.lit(category).alias("category"),
            F.lit(detector).alias("detector"),
            F.col(value).alias("value"),
            F.lit(None).cast("int").alias("line"),
        )
        return F.when(
            F.col(value).isNotNull(), F.struct(F.lit(rank).alias("rank"), group.alias("group"), match.alias("match"))
        )

    # Places count one by one, names once per first word (the longest, then the
    # earliest). All of it stays in the partitioning by key.
    first_word = F.lower(F.substring_index("name", " ", 1))
    entries = F.array(
        entry(0, F.col("pos").cast("string"), "address", "location", "place"),
        entry(1, first_word, "full_name", "full_name", "name"),
    )
    best = (
        found.select(key, "pos", F.explode_outer(F.array_compact(entries)).alias("e"))
        .where(F.col("e").isNotNull())
        .groupBy(key, "e.rank", "e.group")
        .agg(
            F.max_by("e.match", F.struct(F.length("e.match.value"), -F.col("pos"))).alias("match"),
            F.min("pos").alias("pos"),
        )
    )
    # A group is what one text holds, so its size is bounded by that text.
    grouped = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "match"))).alias("ms"))
    return grouped.select(key, F.transform("ms", lambda m: m["match"]).alias("name_matches"))
