"""Encoding, decoding and packing against the tokenizers library and by their rules."""

import hashlib
import itertools
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veilscan.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_random_texts(reference):
    rng, signs = random.Random(2), "ab c'stmdrevl \n\t.1½é日_ 😀ſ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    memory = tokens.Memory(tokens.parse_vocabulary(tokens.load_vocabulary(PATH)))
    ids, counts = tokens.encode_batch(memory, pa.array(texts))
    ends = np.cumsum(counts)
    wanted = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)] == wanted


def test_prefixes_are_shared_in_the_trie(reference):
    encoder = tokens.TrieEncoder(tokens.parse_vocabulary(tokens.load_vocabulary(PATH)))
    words = [b"internationalisation", b"internationally", b"inter", b"in", b"", b"zebra"]
    assert encoder.encode(words) == {w: encoder.merged(w) for w in words}


def test_short_words_side_by_side(reference):
    """Nodes of a depth at once give what one walk gives, at the edge of ``SHORT`` and with zero bytes too."""
    encoder = tokens.TrieEncoder(tokens.parse_vocabulary(tokens.load_vocabulary(PATH)))
    rng = random.Random(4)
    parts = [b"the", b"ing", b" in", b"tern", b"\x00", b"ab", b"\xc3\xa9", b"1", b"  ", b"zq"]
    words = {b"".join(rng.choice(parts) for _ in range(rng.randint(0, 18))) for _ in range(2000)}
    words |= {w[: tokens.SHORT + k] for w in words for k in (-1, 0, 1)}
    short = [w for w in words if len(w) <= tokens.SHORT]
    found = encoder.encode_short(short)
    assert found == encoder.encode_long(short) and len(found) == len(short)
    assert encoder.encode(list(words)) == {w: encoder.merged(w) for w in words}


def test_pairs_are_judged_side_by_side(monkeypatch):
    """What may follow what is as plain merging has it, and takes no merging of single pairs."""
    encoder = tokens.TrieEncoder(tokens.parse_vocabulary(tokens.load_vocabulary(PATH)))
    rng, width = random.Random(6), encoder.width
    by_size = sorted(encoder.contents, key=lambda i: len(encoder.contents[i]))
    by_size = [i for i in by_size if encoder.contents[i] in encoder.ids]
    ids = [*by_size[:700], *rng.sample(by_size, 1500)]
    pairs = np.unique([rng.choice(ids) * width + rng.choice(ids) for _ in range(20_000)])
    pairs = np.concatenate([pairs, -1 - np.array(ids)])
    contents = encoder.contents
    wanted = [
        encoder.merged(contents[-1 - p]) == [-1 - p] if p < 0
        else encoder.merged(contents[p // width] + contents[p % width]) == [*divmod(p, width)]
        for p in pairs.tolist()
    ]
    words = [b"".join(contents[rng.choice(ids)] for _ in range(3)) for _ in range(2000)]
    words = [w for w in words if len(w) <= tokens.SHORT]
    plain = {w: encoder.merged(w) for w in words}
    calls = []
    monkeypatch.setattr(encoder, "merged", lambda content, merged=encoder.merged: calls.append(content) or merged(content))
    for _ in range(2):
        assert encoder.allowed(pairs).tolist() == wanted
    assert 0 < sum(wanted) < len(wanted)
    assert encoder.encode_short(words) == plain
    assert not calls


@pytest.mark.parametrize(
    "merges",
    [["a b", "b c", "ab c", "a bc"], ["ab c", "a b", "b c"], ["a b", "bc a"], ["a a", "aa a", "aa aa", "b a", "a b", "ba b"], []],
)
def test_unusual_vocabularies(merges):
    """A token with two merges, one whose parts come later, one that no merge makes, equal letters, no merges."""
    made = dict.fromkeys(["a", "b", "c", *("".join(m.split()) for m in merges), *(p for m in merges for p in m.split())])
    text = json.dumps({"model": {"vocab": {t: i for i, t in enumerate(made)}, "merges": merges}})
    encoder = tokens.TrieEncoder(tokens.parse_vocabulary(text))
    words = [bytes(w) for n in range(7) for w in itertools.product(b"abc", repeat=n)]
    pairs = np.arange(len(made) ** 2)
    contents = encoder.contents
    wanted = [encoder.merged(contents[p // len(made)] + contents[p % len(made)]) == [*divmod(p, len(made))] for p in pairs.tolist()]
    assert encoder.allowed(pairs).tolist() == wanted
    assert encoder.neighbours.plain == (merges not in (["a b", "b c", "ab c", "a bc"], ["ab c", "a b", "b c"]))
    if encoder.neighbours.plain:
        assert encoder.encode_short(words) == {w: encoder.merged(w) for w in words}


def test_words_that_come_again_stay(monkeypatch, reference):
    """Where a worker remembers too many words, only those that did not come again are forgotten."""
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    learned, learn = Counter(), tokens.Memory.learn
    monkeypatch.setattr(tokens.Memory, "learn", lambda self, keys, *more: learned.update(keys.tolist()) or learn(self, keys, *more))
    memory = tokens.Memory(tokens.parse_vocabulary(tokens.load_vocabulary(PATH)))
    common = " ".join(f"k{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(200))
    long = "ab" * tokens.SHORT
    for k in range(8):
        rare = " ".join("".join(chr(97 + int(d)) for d in str(1000 * k + i)) + "x" for i in range(200))
        texts = [f"{common} {long}", rare]
        ids, counts = tokens.encode_batch(memory, pa.array(texts))
        wanted = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == wanted
        assert len(memory.keys) <= 500 and len(memory.ids) == memory.sizes.sum()
    assert sum(n == 1 for n in learned.values()) == len(learned) == 201 + 8 * 200
    # More words at once than are remembered.
    texts = [" ".join(f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(676))]
    assert tokens.encode_batch(memory, pa.array(texts))[0].tolist() == reference.encode(texts[0], add_special_tokens=False).ids


def test_encode_and_decode(spark, frame, nothing, reference):
    docs, texts = frame
    vocabulary = tokens.tokenizer(spark, PATH)
    encoded = tokens.encode(docs, vocabulary)
    found = {r.id: r for r in tokens.decode(encoded, vocabulary).collect()}
    digests = {r.id: r for r in tokens.digests(encoded, vocabulary).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert found[i].ids == ids and found[i].text == (text or "") and digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert tokens.encode(nothing, vocabulary).count() == 0
    named = spark.createDataFrame([(1, [170], "old", 5)], "id long, ids array<int>, text string, `a.b` int")
    assert [tuple(r) for r in tokens.decode(named, vocabulary).collect()] == [(1, [170], 5, "�")]
    broken = spark.createDataFrame([(1, [170]), (2, None)], "id long, ids array<int>")
    assert [r.text for r in tokens.decode(broken, vocabulary).orderBy("id").collect()] == ["�", ""]


def test_packing(spark, frame, nothing, reference):
    docs, texts = frame
    docs = docs.union(docs.where("id = 4"))
    rows = packing.pack(packing.pieces(docs, tokens.tokenizer(spark, PATH), end_id=2)).collect()
    for i, text in enumerate(texts):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r.id == i), key=lambda r: (r.piece, r.sequence_id, r.offset))
        own = own[::2] if i == 4 else own
        assert [t for r in own for t in r.ids] == ids
        assert all(r.length == 1024 for r in own[1:]) and own[0].length == (len(ids) - 1) % 1024 + 1
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert [r.start for r in own] == [sum(len(x.ids) for x in own[:k]) for k in range(len(own))]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(nothing, tokens.tokenizer(spark, PATH), end_id=2)).count() == 0


def least_sequences(histogram):
    """A lower bound: by volume, and by the number of lengths that are over one part in k + 1 (k fit at most), for every k."""
    by_volume = -(-sum(k * n for k, n in histogram.items()) // 1024)
    by_number = [-(-sum(n for length, n in histogram.items() if length * (k + 1) > 1024) // k) for k in range(1, 9)]
    return max(by_volume, *by_number)


@pytest.mark.parametrize(
    "histogram",
    [{}, {1024: 3}, {5: 1}, {513: 9, 511: 9}, {600: 50, 424: 50}, {400: 1000, 300: 500, 250: 333}, {1: 5000},
     Counter(random.Random(1).choices(range(1, 1025), k=4000)), {276: 4000}],
)
def test_plans(histogram):
    runs, placed = packing.plan(dict(histogram)), Counter()
    for often, content in runs:
        assert often > 0 and sum(k * n for k, n in content.items()) <= 1024
        for length, n in content.items():
            placed[length] += n * often
    assert placed == Counter(histogram)
    used = sum(often for often, _ in runs)
    assert used <= least_sequences(histogram) * 1.02 or histogram == {400: 1000, 300: 500, 250: 333} and used <= 943 * 1.16


def test_packing_plan_needs_no_python_workers(spark, monkeypatch):
    """The plan goes to Spark as columns; from a list of rows it would be converted by Python workers."""
    given, whole = [], type(spark).createDataFrame
    cut_up = whole(spark, [(1, 0, 5), (2, 0, 7)], "id long, piece int, length long")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(data) or whole(self, data, *a, **b))
    placed = packing.pack(cut_up).collect()
    assert sorted((r.id, r.length) for r in placed) == [(1, 5), (2, 7)] and {r.sequence_id for r in placed} == {0}
    assert not any(isinstance(data, list) for data in given)
    assert packing.pack(cut_up.where("false")).count() == 0
