"""Byte-level BPE encoding by a trie, and decoding.

A text falls into the tokenizer's words. The distinct words of a chunk that were not
met before form a trie; each node keeps the last token of its prefix's encoding, so
that words with a common beginning share that work. A token may end a prefix if it may
follow the last token of what stands before it. All nodes of one depth are worked on
side by side; what is left of long words is walked depth first.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import _BYTE_VALUE, _STEP, chunks, code_points, mix, span_hashes, utf8, worker_state

#: Distinct words whose encodings a worker remembers; then it forgets those that did not come again.
REMEMBERED = 500_000
#: Words of up to so many bytes are taken side by side.
SHORT = 32
#: Pairs of tokens that a worker remembers.
REMEMBERED_PAIRS = 250_000

# Kinds of characters that the word pattern tells apart.
_OTHER, _LETTER, _NUMBER, _BLANK = range(4)


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tokens as bytes with their ids, the merges in order, and the special tokens."""

    token_ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    contents: dict[int, bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.contents = {i: t for t, i in self.token_ids.items()}
        self.contents |= {i: s.encode() for s, i in self.special.items()}

    @property
    def longest(self) -> int:
        return max(map(len, self.token_ids))


def parse_vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a byte-level BPE tokenizer file (JSON, as the tokenizers library writes it)."""
    described = json.loads(text)
    alphabet = _byte_alphabet()

    def as_bytes(token: str) -> bytes:
        return bytes(alphabet[c] for c in token)

    special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
    vocab = described["model"]["vocab"]
    token_ids = {as_bytes(t): i for t, i in vocab.items() if t not in special}
    merges = {}
    for rank, merge in enumerate(described["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    return Vocabulary(token_ids, merges, special)


def load_vocabulary(path: str) -> str:
    """The tokenizer file's text, read where the driver runs."""
    with open(path, encoding="utf-8") as file:
        return file.read()


class KeyTable:
    """Numbers from 0 by 64-bit hashes, looked up for many at once. What finds its slot taken goes to the next table."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        while len(keys):
            size = 8 << len(keys).bit_length()
            slots, kept = np.unique(self.slots(keys, len(self.tables), size), return_index=True)
            table, known = np.full(size, -1, np.int32), np.zeros(size, np.uint64)
            table[slots], known[slots] = numbers[kept], keys[kept]
            self.tables.append((table, known))
            left = np.ones(len(keys), bool)
            left[kept] = False
            keys, numbers = keys[left], numbers[left]

    @staticmethod
    def slots(keys: np.ndarray, number: int, size: int) -> np.ndarray:
        return (keys >> np.uint64(11 * number)) & np.uint64(size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for none."""
        out, open_ = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for number, (table, known) in enumerate(self.tables):
            slots = self.slots(keys[open_], number, len(table))
            token = table[slots]
            taken = token >= 0
            open_, slots, token = open_[taken], slots[taken], token[taken]
            same = known[slots] == keys[open_]
            out[open_[same]] = token[same]
            open_ = open_[~same]
        return out


class TokenTable(KeyTable):
    """Ids of tokens by a hash of their bytes: a polynomial, so that of a stretch comes from those of two prefixes."""

    def __init__(self, ids: dict[bytes, int]) -> None:
        words, numbers = list(ids), np.fromiter(ids.values(), np.int32, len(ids))
        sums = np.zeros(len(words), np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for at in range(int(sizes.max(initial=0))):
            here = np.flatnonzero(sizes > at)
            sums[here] = sums[here] * _STEP + _BYTE_VALUE[[words[i][at] for i in here.tolist()]]
        super().__init__(self.keys(sums, sizes), numbers)

    @staticmethod
    def keys(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mix(sums + sizes.astype(np.uint64) * _BYTE_VALUE[7])


class Neighbours:
    """Which tokens may follow which, for many pairs at once.

    The last merges of two tokens are taken back, the later one first. The pair
    stands if on that way no merge across its border comes before the one that
    was taken back. ``plain`` says whether the vocabulary is such that this
    holds: one merge for each token, of tokens made earlier.
    """

    SLOTS = 18

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.width = width = max(vocabulary.contents) + 1
        self.rank, self.first, self.second = (np.full(width, -1, np.int64) for _ in range(3))
        pairs = np.array(list(vocabulary.merges), np.int64).reshape(-1, 2)
        ranks, made = np.array(list(vocabulary.merges.values()), np.int64).reshape(-1, 2).T
        self.rank[made], self.first[made], self.second[made] = ranks, pairs[:, 0], pairs[:, 1]
        earlier = (self.rank[pairs] < ranks[:, None]).all()
        self.plain = bool(earlier) and len(np.unique(made)) == len(made)
        self.ranks = KeyTable(mix((pairs[:, 0] * width + pairs[:, 1]).astype(np.uint64)), ranks.astype(np.int32))
        #: Whether a token's bytes are encoded as that token.
        self.whole = np.zeros(width, bool)
        self.whole[[i for t, i in vocabulary.token_ids.items() if len(t) == 1]] = True
        stands = made[self.stand(pairs[:, 0], pairs[:, 1], ranks)] if self.plain else made[:0]
        for token in stands[np.argsort(self.rank[stands])].tolist():
            self.whole[token] = self.whole[self.first[token]] and self.whole[self.second[token]]
        self.known = np.full(1 << self.SLOTS, -1, np.int64)

    def stand(self, one: np.ndarray, two: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge below ``limit`` joins anything across the border of two tokens, which are encoded as themselves."""
        out, left = np.ones(len(one), bool), np.arange(len(one))
        while len(left):
            rank = self.ranks.find(mix((one * self.width + two).astype(np.uint64)))
            joined = (rank >= 0) & (rank < limit)
            out[left[joined]] = False
            before, after = self.rank[one], self.rank[two]
            go = ~joined & ((before >= 0) | (after >= 0))
            left, one, two, before, after = left[go], one[go], two[go], before[go], after[go]
            later = before > after
            # Of equal ranks the leftmost merge is the earlier one.
            limit = np.where(later, before, after + 1)
            one, two = np.where(later, self.second[one], one), np.where(later, two, self.first[two])
        return out

    def allowed(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the bytes of each pair (``first * width + second``) are encoded as just these two."""
        slots = (mix(pairs.astype(np.uint64)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        known = self.known[slots]
        out, missed = (known & 1).astype(bool), np.flatnonzero(known >> 1 != pairs)
        if len(missed):
            kinds, at, place = np.unique(pairs[missed], return_index=True, return_inverse=True)
            one, two = kinds // self.width, kinds % self.width
            found = self.whole[one] & self.whole[two]
            sure = np.flatnonzero(found)
            found[sure] = self.stand(one[sure], two[sure], np.full(len(sure), np.iinfo(np.int64).max))
            self.known[slots[missed[at]]] = 2 * kinds + found
            out[missed] = found[place]
        return out


class TrieEncoder:
    """Encodes words; what it learned about pairs of tokens is kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ids = vocabulary.token_ids
        self.contents = vocabulary.contents
        self.merges = vocabulary.merges
        self.longest = vocabulary.longest
        self.width = max(self.contents) + 1
        self.follows: dict[int, bool] = {}
        self.neighbours = Neighbours(vocabulary)
        self.table = TokenTable({t: i for t, i in self.ids.items() if len(t) <= SHORT})
        self.token_sizes = np.zeros(self.width, np.int64)
        self.token_sizes[list(self.contents)] = [len(t) for t in self.contents.values()]
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            for n in range(2, min(len(token), 4) + 1):
                ends.setdefault(token[-n:], set()).add(len(token))
        #: Lengths that tokens with these last bytes (up to four) have, longest first; one byte is always a token.
        self.lengths = {}
        for end in sorted(ends, key=len):
            shorter = [n for n in self.lengths.get(end[1:], (1,)) if n < len(end)]
            longer = ends[end] if len(end) == 4 else {n for n in ends[end] if n == len(end)}
            self.lengths[end] = (*sorted(longer, reverse=True), *shorter)

    def merged(self, content: bytes) -> list[int]:
        """The plain encoding: the merge of the lowest rank first, leftmost first."""
        parts = [self.ids[bytes([b])] for b in content]
        while len(parts) > 1:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges]
            if not ranked:
                break
            _, at = min(ranked)
            parts[at : at + 2] = [self.merges[parts[at], parts[at + 1]][1]]
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the two tokens' bytes on end are encoded as just these two."""
        pair = before * self.width + token
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) >= REMEMBERED_PAIRS:
                self.follows.clear()
            known = self.merged(self.contents[before] + self.contents[token]) == [before, token]
            self.follows[pair] = known
        return known

    def allowed(self, pairs: np.ndarray) -> np.ndarray:
        """``may_follow`` for numbers of pairs; -1 - token asks whether a token's bytes are encoded as that token."""
        if self.neighbours.plain:
            alone = pairs < 0
            out = np.empty(len(pairs), bool)
            out[alone] = self.neighbours.whole[-1 - pairs[alone]]
            out[~alone] = self.neighbours.allowed(pairs[~alone])
            return out
        kinds, place = np.unique(pairs, return_inverse=True)
        found = []
        for pair in kinds.tolist():
            ok = self.follows.get(pair)
            if ok is None:
                if pair >= 0:
                    ok = self.may_follow(*divmod(pair, self.width))
                else:
                    ok = self.follows[pair] = self.merged(self.contents[-1 - pair]) == [-1 - pair]
            found.append(ok)
        return np.array(found, bool)[place]

    def encode_short(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Each word's ids, for words of at most ``SHORT`` bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, starts, counts = self.short_ids(np.frombuffer(b"".join(words), np.uint8), sizes)
        return {w: flat[a : a + n].tolist() for w, a, n in zip(words, starts.tolist(), counts.tolist(), strict=True)}

    def short_ids(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of at most ``SHORT`` bytes that stand on end: the trie's nodes depth by depth.

        Returns all ids, where each word's begin, and how many it has.
        """
        count, width = len(sizes), int(sizes.max(initial=0))
        if not width:
            return np.zeros(0, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        eights = -(-width // 8)
        letters = np.zeros((count, 8 * eights), np.uint8)
        letters[np.arange(8 * eights) < sizes[:, None]] = data
        order = np.lexsort(letters.view(">u8").astype(np.uint64).T[::-1])
        letters, sizes = letters[order, :width], sizes[order]
        same = np.zeros((count, width + 1), bool)
        same[1:, :width] = letters[1:] == letters[:-1]
        shared = same.argmin(axis=1)
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
        prefix = np.zeros((count, width + 1), np.uint64)
        for at in range(width):
            prefix[:, at + 1] = prefix[:, at] * _STEP + _BYTE_VALUE[letters[:, at]]
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width, _STEP)]), dtype=np.uint64)
        last = np.full((count, width + 1), -1, np.int64)
        for depth in range(1, width + 1):
            node = np.flatnonzero((sizes >= depth) & (shared < depth))
            # Tokens that end here, by where they begin: the first found is the longest.
            sums = prefix[node, depth, None] - prefix[node, :depth] * powers[depth:0:-1]
            keys = self.table.keys(sums, np.arange(depth, 0, -1))
            tokens = self.table.find(keys.ravel()).reshape(keys.shape)
            value, left = np.full(len(node), -1, np.int64), np.arange(len(node))
            while len(left):
                begin = (tokens[left] >= 0).argmax(axis=1)
                token = tokens[left, begin].astype(np.int64)
                if (token < 0).any():
                    raise ValueError(f"no token ends {letters[node[left[token.argmin()]], :depth].tobytes()!r}")
                prior = last[node[left], begin]
                ok = self.allowed(np.where(begin == 0, -1 - token, prior * self.width + token))
                value[left[ok]] = token[ok]
                tokens[left[~ok], begin[~ok]] = -1
                left = left[~ok]
            owner = np.zeros(count, np.int64)
            owner[node] = np.arange(len(node))
            owner = np.maximum.accumulate(owner)
            here = np.flatnonzero(sizes >= depth)
            last[here, depth] = value[owner[here]]
        at, row, steps, rows = sizes.copy(), np.flatnonzero(sizes), [], []
        while len(row):
            token = last[row, at[row]]
            steps.append(token)
            rows.append(row)
            at[row] -= self.token_sizes[token]
            row = row[at[row] > 0]
        owner = np.concatenate(rows[::-1])
        flat = np.concatenate(steps[::-1])[np.argsort(owner, kind="stable")]  # the last step is the first token
        counts = np.zeros((2, count), np.int64)
        counts[0, order] = found = np.bincount(owner, minlength=count)
        counts[1, order] = np.cumsum(found) - found
        return flat, counts[1], counts[0]

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Each word's ids."""
        return self.encode_short([w for w in words if len(w) <= SHORT]) | self.encode_long([w for w in words if len(w) > SHORT])

    def encode_long(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Each word's ids. Sorted words are a trie in depth-first order.

        ``last[d]`` is the last token of the encoding of the first ``d`` bytes
        of the path; a word takes over what it shares with the word before it.
        """
        ids, lengths, follows, may_follow, width = self.ids, self.lengths, self.follows, self.may_follow, self.width
        last: list[int] = [-1]
        sizes: list[int] = [0]
        out, before = {}, b""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], sizes[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                sized = lengths.get(word[depth - 4 : depth] if depth > 4 else word[:depth])
                if sized is None:
                    sized = lengths.get(word[max(depth - 3, 0) : depth]) or lengths.get(word[max(depth - 2, 0) : depth], (1,))
                for size in sized:
                    if size > depth:
                        continue
                    token = ids.get(word[depth - size : depth])
                    if token is None:
                        continue
                    if size == depth:
                        # A token that is a whole prefix is its encoding, if merges lead there.
                        pair = -1 - token
                        ok = follows.get(pair)
                        if ok is None:
                            ok = follows[pair] = self.merged(word[:depth]) == [token]
                    else:
                        prior = last[depth - size]
                        ok = follows.get(prior * width + token)
                        if ok is None:
                            ok = may_follow(prior, token)
                    if ok:
                        last.append(token)
                        sizes.append(size)
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
            found, depth = [], len(word)
            while depth:
                found.append(last[depth])
                depth -= sizes[depth]
            out[word] = found[::-1]
            before = word
        return out


def _kinds() -> np.ndarray:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for found in regex.finditer(pattern, every):
            low, high = ord(found[0][0]), ord(found[0][-1])
            table[low : high + 1] = kind
    return table


_CONTRACTIONS = {"s": ("",), "t": ("",), "m": ("",), "d": ("",), "r": ("e",), "v": ("e",), "l": ("l",)}


def word_starts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the tokenizer's words begin, of texts on end (``texts``: where each begins, and the end).

    The pattern: a contraction ('s 't 're 've 'm 'll 'd), or letters, numbers or
    other signs with at most one space before them, or white space but for the
    last one before something else.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = worker_state("tokens", "character_kinds", _kinds)[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[texts] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= fresh[:n]
    begins = np.flatnonzero(change)
    ends = np.append(begins[1:], n)
    start = change.copy()
    # The last of some white space, unless the text ends there: a word of its own, or the beginning of the next.
    blank = (kind[begins] == _BLANK) & ~fresh[ends]
    tail = ends[blank] - 1
    start[tail] = True
    spaced = tail[codes[tail] == 32]
    start[spaced + 1] = False
    # A sign that is one apostrophe and has no space before it takes the letters of a contraction.
    single = begins[(kind[begins] == _OTHER) & (ends - begins == 1)]
    single = single[(codes[single] == 39) & start[single]]
    single = single[(single + 1 < n)]
    single = single[~fresh[single + 1]]
    for at in single.tolist():
        first = chr(codes[at + 1])
        for rest in _CONTRACTIONS.get(first, ()):
            stop = at + 2 + len(rest)
            inside = stop <= n and not fresh[at + 2 : stop].any()
            if inside and "".join(map(chr, codes[at + 2 : stop])) == rest:
                start[at + 1] = False
                if stop < n:
                    start[stop] = True
    return np.flatnonzero(start)


class Memory:
    """What a worker remembers of a vocabulary: words by hash, with their ids on end."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.encoder = TrieEncoder(vocabulary)
        self.special = vocabulary.special
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)

    def keep(self, kept: np.ndarray) -> None:
        """Only some of the words; they have to come again before the next time."""
        sizes = self.sizes[kept]
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        self.ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[kept] - starts, sizes)]
        self.keys, self.starts, self.sizes, self.again = self.keys[kept], starts, sizes, np.zeros(len(sizes), bool)

    def learn(self, keys: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        """Words by their hashes, which ascend; ``codes`` has their code points on end."""
        data = np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)
        edges = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))[np.concatenate([[0], np.cumsum(lengths)])]
        bytes_of = np.diff(edges)
        short = bytes_of <= SHORT
        ids, begins, counts = self.encoder.short_ids(data[np.repeat(short, bytes_of)], bytes_of[short])
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        starts[short], sizes[short] = begins, counts
        lists, at = [ids], len(ids)
        if not short.all():
            long = {i: data[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~short).tolist()}
            encoded = self.encoder.encode_long(list(long.values()))
            for i, word in long.items():
                lists.append(np.array(encoded[word]))
                starts[i], sizes[i] = at, len(lists[-1])
                at += len(lists[-1])
        starts += len(self.ids)
        self.ids = np.concatenate([self.ids, *(x.astype(np.int32) for x in lists)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.again = np.insert(self.again, at, False)

    def unknown(self, kinds: np.ndarray) -> np.ndarray:
        """Which words, by their hashes, are not remembered; the others have come again."""
        if not len(self.keys):
            return np.ones(len(kinds), bool)
        at = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
        met = self.keys[at] == kinds
        self.again[at[met]] = True
        return ~met

    def encode(self, codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each text has."""
        starts = word_starts(codes, texts)
        ends = np.append(starts[1:], len(codes)) if len(starts) else starts
        hashes = span_hashes(mix(codes.astype(np.uint64) + np.uint64(7)), starts, ends)
        kinds, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        fresh = self.unknown(kinds)
        if len(self.keys) + int(fresh.sum()) > REMEMBERED:
            self.keep(self.again)
            fresh = self.unknown(kinds)
            if len(self.keys) + int(fresh.sum()) > REMEMBERED:
                self.forget()
                fresh = self.unknown(kinds)
        if fresh.any():
            begins = starts[first[fresh]]
            lengths = ends[first[fresh]] - begins
            index = np.arange(lengths.sum()) + np.repeat(begins - np.cumsum(lengths) + lengths, lengths)
            self.learn(kinds[fresh], codes[index], lengths)
        at = np.searchsorted(self.keys, kinds)[word]
        sizes = self.sizes[at].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(before[-1]) + np.repeat(self.starts[at] - before[:-1], sizes)
        bounds = before[np.searchsorted(starts, texts)]
        return self.ids[index], np.diff(bounds)


def _memory(name: str, text: str) -> Memory:
    return worker_state("tokens", f"tokens_{name}", lambda: Memory(parse_vocabulary(text)))


def encode_batch(memory: Memory, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids on end and their number per text; special tokens written out in a text are found first."""
    marked = [s for s in memory.special if s]
    codes, bounds = code_points(texts)
    data, _ = utf8(texts)
    raw = data.tobytes()
    if not any(s.encode() in raw for s in marked):
        return memory.encode(codes, bounds)
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(marked, key=len, reverse=True))) + ")")
    ids, counts = [], []
    for text in texts.to_pylist():
        own = []
        for part in pattern.split(text or ""):
            if part in memory.special:
                own.append(np.array([memory.special[part]], np.int32))
            elif part:
                own.append(memory.encode(*code_points(pa.array([part])))[0])
        ids += own
        counts.append(sum(map(len, own)))
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.array(counts, np.int64)


def lists_of(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def tokenizer(spark: SparkSession, path: str):
    """The tokenizer file, sent to every executor once (a few MB, whatever the data)."""
    return spark.sparkContext.broadcast((fingerprint(text := load_vocabulary(path)), text))


def fingerprint(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


def encode(docs: DataFrame, vocabulary) -> DataFrame:
    """``(id, text)`` to ``(id, ids)``; null counts as the empty text, which has no ids.

    Special tokens written out in a text become their ids. Rows come back as often as they came in.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(*vocabulary.value)
        for batch in chunks(batches):
            ids, counts = encode_batch(memory, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists_of(ids, counts)], ["id", "ids"])

    return docs.select("id", "text").mapInArrow(encoded, f"id {kind}, ids array<int>")


class Strings:
    """Byte strings by number, gathered for many numbers at once."""

    def __init__(self, items: dict[int, bytes]) -> None:
        count = max(items, default=-1) + 1
        ordered = [items.get(i, b"") for i in range(count)]
        self.sizes = np.fromiter(map(len, ordered), np.int64, count)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(ordered), np.uint8)

    def joined(self, numbers: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The strings of each stretch of numbers, on end."""
        sizes = self.sizes[numbers]
        before = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(before[-1]) + np.repeat(self.starts[numbers] - before[:-1], sizes)
        view, edges = memoryview(self.data[index].tobytes()), before[bounds].tolist()
        return [view[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def id_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids on end, and where each list begins; null counts as empty."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """``(id, ids, ...)`` with the ``text`` they stand for; bytes that are no UTF-8 become replacement characters.

    A column ``text`` of the input is replaced.
    """
    kept = [c for c in encoded.columns if c.lower() != "text"]
    safe = encoded.select(*(F.col(f"`{c}`").alias("ids" if c == "ids" else f"kept{i}") for i, c in enumerate(kept)))
    schema = safe.withColumn("text", F.lit("")).schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, text = vocabulary.value
        strings = worker_state("tokens", f"contents_{name}", lambda: Strings(parse_vocabulary(text).contents))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [bytes(t).decode("utf-8", "replace") for t in strings.joined(*id_lists(batch.column("ids")))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    back = (F.col("ids" if c == "ids" else f"kept{i}").alias(c) for i, c in enumerate(kept))
    return safe.mapInArrow(decoded, schema).select(*back, "text")


def digests(encoded: DataFrame, vocabulary) -> DataFrame:
    """``(id, ids)`` to the number of ids and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    kind = encoded.schema["id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, text = vocabulary.value
        contents = worker_state("tokens", f"contents_{name}", lambda: Strings(parse_vocabulary(text).contents))
        decimals = worker_state("tokens", f"decimals_{name}", lambda: Strings({i: b"%d," % i for i in parse_vocabulary(text).contents}))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, bounds = id_lists(batch.column("ids"))
                joined = [hashlib.sha256(t[:-1]).hexdigest() for t in decimals.joined(ids, bounds)]
                texts = [hashlib.sha256(bytes(t).decode("utf-8", "replace").encode()) for t in contents.joined(ids, bounds)]
                columns = [batch.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(joined, pa.string())]
                columns.append(pa.array([t.hexdigest() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded.select("id", "ids").mapInArrow(digested, schema)
