"""Secrets in nested layers of every kind, with the work they take."""

import base64
import gzip
import hashlib
import os
import re
import time
import urllib.parse
import zlib

import pytest

from citeloom.llm import secretscan

SECRET = b"password=hunter22"
BLOCK = 'text " ' * 40


def coded(data):
    return base64.b64encode(data).decode()


CASES = {
    "utf-16": coded("a password=hunter22".encode("utf-16")),
    "utf-32": coded("a password=hunter22".encode("utf-32-be")),
    "control characters": coded(b"abc\0\x0c\xa0\x1b " + SECRET),
    "latin-1": coded("é password=hunter22".encode("latin-1")),
    "wrapped": "see " + base64.encodebytes(b"x" * 50 + SECRET + b"y" * 200).decode(),
    "wrapped, compressed": "see\n" + base64.encodebytes(zlib.compress(bytes(range(256)) * 2 + SECRET)).decode() + "\nend",
    "quoted lines": "> " + "> ".join(base64.encodebytes(b"x" * 100 + SECRET).decode().splitlines(True)),
    "behind a slash": "a/" + coded(SECRET),
    "behind a word": "key_" + coded(SECRET),
    "compressed, behind a word": "abc/" + coded(zlib.compress(SECRET * 3)),
    "url, compressed": "q=" + urllib.parse.quote_from_bytes(zlib.compress(b"some text " * 5 + SECRET)),
    "bytes, compressed": "".join(f"\\x{c:02x}" for c in gzip.compress(SECRET)),
    "url in unicode in url": "pass%5Cu002577ord%3Dhunter22",
    "base64 twelve times": None,
}
for _ in range(12):
    CASES["base64 twelve times"] = coded((CASES["base64 twelve times"] or SECRET.decode()).encode())


@pytest.mark.parametrize("name", sorted(CASES))
def test_layers(name):
    text = f"{BLOCK}\n{CASES[name]}\n{BLOCK}"
    found = secretscan.scan(text)
    assert found.spans and not found.base and not found.torn
    assert all(len(BLOCK) < s and e <= len(text) - len(BLOCK) for _, s, e in found.spans)
    assert not secretscan.scan(secretscan.redact(text, found.spans)).spans


def test_deep_nesting_takes_one_pass():
    for text in ("pass%" + "25" * 50_000 + "77ord%3Dhunter22", "pass\\u005c" + "u005c" * 20_000 + "u0077ord=hunter22"):
        began = time.time()
        assert ("assign", 0, len(text)) in secretscan.scan(text).spans
        assert time.time() - began < 10


@pytest.mark.parametrize("layers", [63, 64, 65, 200, 400])
def test_compressed_any_number_of_times(layers):
    data = SECRET
    for i in range(layers):
        data = (gzip.compress, zlib.compress)[i % 3 == 2](data)
    found = secretscan.scan(f"a {coded(data)} b")
    assert [k for k, _, _ in found.spans] == ["assign"] and not found.torn


def test_cycles_end():
    """Data whose contents begin as a layer before them, one or two compressions away."""
    seen = []

    def members(head, pieces):
        seen.append(head)
        yield {b"\x1f\x8b\x08one": b"BZh9two", b"BZh9two": b"\x1f\x8b\x08one"}[head]

    whole, secretscan._members = secretscan._members, members
    try:
        assert [x for x, _ in secretscan.inflate(b"\x1f\x8b\x08one")] == ["\x1f\x8b\x08one"] and len(seen) == 2
    finally:
        secretscan._members = whole


def test_long_lines_of_compressed_layers():
    parted, whole = (coded(zlib.compress(x * 6_000_000 + SECRET, 9)) for x in (b"x, ", b"x "))
    found = secretscan.scan(parted)
    assert [k for k, _, _ in found.spans] == ["assign"] and not found.torn
    assert secretscan.scan(whole).torn == [(0, len(whole))]


def test_what_is_not_compressed():
    """Random bytes often begin like zlib; a gzip of itself would never end."""
    assert not secretscan.scan(coded(os.urandom(200_000))).torn
    assert [x for x, _ in secretscan.inflate(b"\x78\x9cnot compressed at all")] == ["\x78\x9cnot compressed at all"]


def test_carried_columns_and_cut(docs):
    torn = coded(zlib.compress(b"x " * 6_000_000, 9))
    rows = secretscan.scan_secrets(docs([(1, f"a {torn} b"), (1, "secret=abcdef"), (None, "token: abcdef"), (2, None)], extra=True), carry=("rank", "source")).collect()
    assert sorted((str(r["doc_id"]), r["redacted"], r["cut"], r["rank"]) for r in rows) == [("1", "[REDACTED]", False, "x"), ("1", "a [REDACTED] b", True, "x"), ("2", None, False, "x"), ("None", "[REDACTED]", False, "x")]


def test_base_findings_of_documents(spark):
    """Base columns over a whole table against plain regular expressions."""
    kinds = {"assign": (r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    some = 0
    for r in secretscan.scan_secrets(frame).collect():
        want = sorted((m.start(), list(kinds).index(k), k, m.end()) for k, (p, g, n) in kinds.items() for m in re.finditer(p, texts[r["doc_id"]], re.ASCII) if len(m[g]) >= n)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        some += len(want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[2] == k for w in want) for k in kinds]
        assert set(joined.split(",")) <= set(r["spans"].split(",")) or not want
    assert some > 20
