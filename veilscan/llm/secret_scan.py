"""Secrets in texts: keywords by Aho-Corasick, anchored patterns at the hits, embedded checksums.

An automaton of all keywords reads every text once. A pattern is tried only at a place
where one of its keywords was found, anchored there. Kinds whose tokens carry a checksum
count only where it is right. Runs of hexadecimal digits have no keyword of their own:
in a copy of the text that shows every such digit as the same sign, 32 of that sign are one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from veilscan.llm.common import chunks

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base62_crc32(token: str) -> bool:
    """Whether the last six signs are the CRC-32 of those between prefix and them, in base 62."""
    body = token[token.index("_") + 1 :]
    number = 0
    for sign in body[-6:]:
        number = number * 62 + _BASE62.index(sign)
    return number == zlib.crc32(body[:-6].encode())


def base58_check(token: str) -> bool:
    """Whether the last four bytes are the beginning of the double SHA-256 of those before."""
    number = 0
    for sign in token:
        number = number * 58 + _BASE58.index(sign)
    data = number.to_bytes(max(82, (number.bit_length() + 7) // 8), "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_check(token: str) -> bool:
    """Whether the checksum of a Bech32 string (its part before the last 1, and the values after) is right."""
    prefix, _, data = token.lower().rpartition("1")
    check = 1
    for value in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(_BECH32.index, data)]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ value
        for bit, term in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            if top >> bit & 1:
                check ^= term
    return check == 1


@dataclass(frozen=True)
class Kind:
    """A kind of secret: where a keyword stands in lower case, ``pattern`` is tried in the text itself.

    ``least`` is the length that ``group`` must have (the whole match by
    default), ``holds`` a check of the whole match. A match that fails is
    dropped, but what it covers is not searched again for the kind.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    least: int = 1
    group: int = 0
    holds: Callable[[str], bool] | None = None
    base: bool = False


#: The sign that stands for a hexadecimal digit in lower case.
_DIGIT = "\x01"

# The patterns and lengths of the base kinds.
BASE_KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
        least=8,
        group=2,
        base=True,
    ),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), least=16, base=True),
    Kind("hex", (_DIGIT * 32,), re.compile("[0-9a-f]+"), least=32, base=True),
)
# Prefixes and shapes of tokens with a checksum. Neither a letter nor a digit stands before or after them.
CHECKED_KINDS = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), holds=base62_crc32),
    Kind("npm", ("npm_",), re.compile(r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), holds=base62_crc32),
    Kind("xprv", ("xprv",), re.compile(rf"(?<![A-Za-z0-9])xprv[{_BASE58}]{{107}}(?![A-Za-z0-9])"), holds=base58_check),
    Kind("age", ("age-secret-key-1",), re.compile(rf"(?<![A-Za-z0-9])AGE-SECRET-KEY-1[{_BECH32.upper()}]{{58}}(?![A-Za-z0-9])"), holds=bech32_check),
    Kind("nsec", ("nsec1",), re.compile(rf"(?<![A-Za-z0-9])nsec1[{_BECH32}]{{58}}(?![A-Za-z0-9])"), holds=bech32_check),
)
KINDS = BASE_KINDS + CHECKED_KINDS

# One byte for each character: those beyond Latin-1 become "?", which is in no keyword.
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DIGITS = bytes(ord(_DIGIT) if chr(b) in "0123456789abcdef" else 0 for b in range(256))


class Scanner:
    """The automata of some kinds."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS) -> None:
        self.kinds = kinds
        self.plain, self.digits = self._automaton(digits=False), self._automaton(digits=True)

    def _automaton(self, digits: bool):
        owners: dict[str, list[int]] = {}
        for number, kind in enumerate(self.kinds):
            for word in kind.keywords:
                if word.startswith(_DIGIT) == digits:
                    owners.setdefault(word, []).append(number)
        if not owners:
            return None
        automaton = ahocorasick.Automaton()
        for word, numbers in owners.items():
            automaton.add_word(word, (len(word), tuple(numbers)))
        automaton.make_automaton()
        return automaton

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of all secrets, in code points, by start and then kind."""
        narrow = text.encode("latin-1", "replace")
        starts: list[tuple[int, int]] = []
        for automaton, table in ((self.plain, _LOWERED), (self.digits, _DIGITS)):
            if automaton is not None:
                found = automaton.iter(narrow.translate(table).decode("latin-1"))
                starts += [(last + 1 - size, number) for last, (size, numbers) in found for number in numbers]
        out, done = [], [0] * len(self.kinds)
        for start, number in sorted(starts):
            if start < done[number]:
                continue
            kind = self.kinds[number]
            match = kind.pattern.match(text, start)
            if match is None:
                continue
            done[number] = match.end()
            if match.end(kind.group) - match.start(kind.group) >= kind.least and (kind.holds is None or kind.holds(match[0])):
                out.append((start, number, match.end()))
        return sorted(out)


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``(id, text)`` to ``(id, spans)``: (kind, start, end, base) of each secret, in code points, end exclusive.

    Spans come by start, then in the order of ``kinds``; those of one kind do
    not overlap. ``base`` tells the kinds without a checksum from the others.
    A null text counts as empty, which has none. Texts are read whole, rows come
    back as often as they came in, other columns are left out.
    """
    kind = docs.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        for batch in chunks(batches):
            found = [
                [{"kind": kinds[n].name, "start": a, "end": b, "base": kinds[n].base} for a, n, b in scanner.spans(text or "")]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, span)], ["id", "spans"])

    schema = f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return docs.select("id", "text").mapInArrow(scanned, schema)
