"""Alignment of tokens against a plain walk over both tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from veilscan.llm import alignment
from veilscan.llm.queries import QUERIES
from veilscan.llm.tokens import _byte_alphabet

SF = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def both(spark):
    return alignment.tokenizers(spark, *PATHS)


@pytest.fixture(scope="module")
def groups():
    one, two = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    one.encode_special_tokens = True
    letters = _byte_alphabet()

    def bytes_two(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    def by_hand(text):
        if not text:
            return []
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes_two(i)) for i in two.encode(text)]
        whole = (" " + text).encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            return []
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (a, b)]
        cuts, out, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for cut in cuts:
            stop = [e.index(cut) + 1 for e in ends]
            out.append(([i for i, _ in a[at[0] : stop[0]]], [i for i, _ in b[at[1] : stop[1]]], cut))
            at = stop
        return out

    return by_hand


def measures(rows, by_hand):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row."""
    found = [(i, by_hand(t)) for i, t in rows]
    held = Counter()
    for _, g in found:
        held.update({(a, b) for x, y, _ in g for a in x for b in y})
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for i, g in found:
        links = [(a, b) for x, y, _ in g for a in x for b in y]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in g)
        digest = hashlib.sha256(written.encode()).hexdigest() if g else ""
        sizes = [sum(len(x) for x, _, _ in g), sum(len(y) for _, y, _ in g), len(g), len(links)]
        out.append((i, *sizes, sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


TEXTS = [
    "<|endoftext|> a <|endoftext|>", "▁x", "a▁b", "  two   spaces  ", "don't we'll", "日本語のテキスト😀😀", "a\x00b", "\n\n\tx\r\n",
    "ééé naïve ﬁ ½ 1234567 12.50", "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "<s>hi</s> <unk> <0x41>", "ȺȾ₿ 𝔘𝔫𝔦", " ", "x",
]


def test_align(spark, both, groups, frame, nothing):
    rows = [*enumerate([*frame[1], *TEXTS]), (4, frame[1][4]), (None, "some text")]
    given = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, text string, groups string, pairs int")
    found = {r.id: [(g.a, g.b, g.end) for g in r.groups] for r in alignment.align(given, both).collect()}
    for i, text in rows:
        assert found[i] == groups(text), text
    assert alignment.align(nothing, both).count() == 0


def test_measures_against_a_plain_walk(spark, both, groups, frame, nothing, monkeypatch):
    rng = random.Random(6)
    rows = [*enumerate([*frame[1], *TEXTS]), (4, frame[1][4]), (None, "some text")]
    signs = "ab the tion日é😀 \n.,12"
    rows += [(100 + k, "".join(rng.choice(signs) for _ in range(rng.randint(1, 400)))) for k in range(150)]
    given = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, text string, n_a string, chunk int").repartition(5)
    wanted = sorted(map(repr, measures(rows, groups)))
    assert sorted(repr(tuple(r)) for r in alignment.measured(given, both).collect()) == wanted
    assert alignment.measured(nothing, both).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert [tuple(r)[1:] for r in alignment.measured(only, both).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_linked_ids(spark, both, groups):
    rows = [(1, "the cat sat"), (2, "the cat sat"), (3, "a naïve cat"), (4, None)]
    found = {(r.a, r.b): (r.n, r.best) for r in alignment.linked_ids(spark.createDataFrame(rows, "id long, text string"), both).collect()}
    held = Counter()
    for _, text in rows:
        held.update({(a, b) for x, y, _ in groups(text) for a in x for b in y})
    most = {a: max(n for (c, _), n in held.items() if c == a) for a, _ in held}
    assert found == {p: (n, n == most[p[0]]) for p, n in held.items()}


def test_shared_cuts_of_random_ends():
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = rng.integers(0, 60, 4)
        one, two, bounds, base = [], [], [0], 0
        for n in sizes:
            length = int(n) * 3
            a = set(rng.choice(length, n, replace=False).tolist()) | {length} if n else set()
            b = set(rng.choice(length, rng.integers(0, n + 1), replace=False).tolist()) | {length} if n else set()
            one += sorted(base + x for x in a)
            two += sorted(base + x for x in b)
            bounds.append(len(one))
            base += length + 1
        one, two = np.array(one, np.int64), np.array(two, np.int64)
        assert (alignment.shared_cuts(one, two, np.array(bounds)) == np.isin(one, two)).all()


def test_pairs_of_a_group_beyond_the_limit(both, monkeypatch):
    """A group is put together from its distinct ids where its links are many; the answer is the same."""
    aligner = alignment._aligner(both.value)
    texts = pa.array(["aaaa" * 300 + " the cat", None, "日本語" * 20 + "😀"])
    found = alignment.Alignment(aligner, texts)
    whole = found.pairs()
    monkeypatch.setattr(alignment, "PAIRS", 2)
    for a, b in zip(whole, found.pairs(), strict=True):
        assert (a == b).all()


def test_query_against_a_plain_walk(spark, groups):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op12_alignment"](spark, SF)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in found.select(names).collect()) == sorted(measures(rows, groups))
