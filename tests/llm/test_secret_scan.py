"""Secrets against the plain patterns, and checksums made by hand."""

import hashlib
import random
import re
import zlib

import pytest

from veilscan.llm import secret_scan
from veilscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def by_hand(text):
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(((m.start(), order.index(k), m.end()) for k, m in found))


def github(body, prefix="ghp_"):
    number, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, k = divmod(number, 62)
        out = secret_scan._BASE62[k] + out
    return prefix + body + out


def base58(data):
    number, out = int.from_bytes(data, "big"), ""
    while number:
        number, k = divmod(number, 58)
        out = secret_scan._BASE58[k] + out
    return out


def bech32(prefix, values):
    signs = secret_scan._BECH32
    head = [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *values, *[0] * 6]
    check = 1
    for value in head:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ value
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    check ^= 1
    return prefix + "1" + "".join(signs[v] for v in [*values, *(check >> 5 * (5 - i) & 31 for i in range(6))])


def test_base_kinds_are_the_plain_patterns():
    rng = random.Random(3)
    parts = [
        "password", "PassWD", "passwd", "secret", "toKen", "api_key", "APIKEY", "api__key", "=", ":", " ", '"', "'", "==", "é", "日", "😀",
        "AKIA", "akia", "ABCDEFGH0123", "0123456789abcdef", "deadbeef" * 4, "x", "zz.zz/zz+zz", "\n", "\x01", "ſecret", "toKen", "İ",
    ]
    scanner = secret_scan.Scanner(secret_scan.BASE_KINDS)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert scanner.spans(text) == by_hand(text), text


def test_a_published_bech32_string_holds():
    # From the public description of the format.
    assert secret_scan.bech32_check("abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxw")
    assert not secret_scan.bech32_check("abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxq")


def test_checksums_decide():
    rng = random.Random(8)
    body = "".join(rng.choice(secret_scan._BASE62) for _ in range(30))
    extended = bytes.fromhex("0488ade4") + bytes(rng.randrange(256) for _ in range(74))
    xprv = base58(extended + hashlib.sha256(hashlib.sha256(extended).digest()).digest()[:4])
    values = [rng.randrange(32) for _ in range(52)]
    good = {
        "github": github(body),
        "npm": github(body, "npm_"),
        "xprv": xprv,
        "age": bech32("age-secret-key-", values).upper(),
        "nsec": bech32("nsec", values),
    }
    scanner = secret_scan.Scanner(secret_scan.CHECKED_KINDS)
    for kind, token in good.items():
        (found,) = scanner.spans(f"é <{token}> and more")
        assert (scanner.kinds[found[1]].name, found[0], found[2]) == (kind, 3, 3 + len(token))
        assert scanner.spans("x" + token) == [] and scanner.spans(token + "x") == []
        at = len(token) - 3
        other = "Q" if token[at] != "Q" else "P"
        broken = token[:at] + (other if kind == "age" else "q" if token[at] != "q" else "p") + token[at + 1 :]
        assert scanner.spans(broken) == [], kind


def test_scan(spark, frame, nothing):
    docs, texts = frame
    more = [github("a" * 30), "token=" + github("B" * 30), "a" * 200_000, "password" + " " * 100_000 + "=", "password=short password=longenough"]
    rows = [*enumerate([*texts, *more]), (4, texts[4]), (None, "secret: abcdefgh")]
    given = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, text string, spans string, kind int")
    found = secret_scan.scan(given).collect()
    assert len(found) == len(rows)
    by_id = {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in found}
    names = [k.name for k in secret_scan.KINDS]
    for i, text in rows:
        base = [(names[k], a, b) for a, k, b in by_hand(text or "")]
        assert [s for s in by_id[i] if s[0] in names[:3]] == base
    n = len(texts)
    assert by_id[n] == [("github", 0, 40)] and by_id[n + 1] == [("assign", 0, 46), ("github", 6, 46)]
    assert by_id[n + 2] == [("hex", 0, 200_000)] and by_id[n + 4] == [("assign", 15, 34)]
    assert secret_scan.scan(nothing).count() == 0


def test_query_against_the_plain_patterns(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = ["assign", "access", "hex"]
    found = QUERIES["op11_secrets"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        base = by_hand(docs[r.doc_id])
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert sum(r.n_assign + r.n_access + r.n_hex for r in found) > 0


@pytest.mark.parametrize("text", ["", "no secret here", "pass word = 12345678"])
def test_none(text):
    assert secret_scan.Scanner().spans(text) == []
