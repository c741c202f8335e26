"""Secret scans by a recursive decoding worklist.

Each layer of text is scanned with the same patterns; then its URL and Unicode escapes (nested
ones at once), base64 tokens and compressed contents are unwrapped to further layers, until no
new layer appears. Every layer carries, for each of its characters, the span of the document it came
from, so that findings are reported in code points of the document.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.runtime import spread

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
_ESCAPES, _HEX_DIGITS = (("%", 2), ("\\x", 2), ("\\u", 4), ("\\U", 8)), frozenset("0123456789abcdefABCDEF")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAP = re.compile(r"[\x20\t]*\r?\n[\x20\t>]*")
_BLOCK = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}(?:{_WRAP.pattern}[A-Za-z0-9+/_-]{{16,}})*{_WRAP.pattern}[A-Za-z0-9+/_-]+={{0,2}}")
#: How compressed streams begin: gzip, bzip2, xz and zlib.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
_MAGIC_TEXT = re.compile(_MAGIC.pattern.decode("latin-1"))
#: What a layer of bytes must hold to be scanned: the shortest finding has as many printable characters.
_PLAIN = re.compile(rb"[\t\x20-\x7e]{11}")
#: Bytes that no finding and no token holds, and the end of a line that a wrapped token may go on from.
_BREAKS, _WRAPPED = [bytes([x]) for x in b",;(){}<>&|!?*#~`"], re.compile(rb"[A-Za-z0-9+/_-]{16}[\x20\t]*\r?\n")
#: Compressed layers are inflated to their end in pieces of this many bytes and scanned line by line.
PIECE = 1 << 20
#: Longer lines of one are parted at a byte that no finding holds; one without any is scanned in parts that overlap, and counts as cut.
LONGEST_LINE, OVERLAP = 8 << 20, 4096
#: Compressions within each other that are inflated as one stream; what they hold is then read whole, and followed further.
STREAMED = 64
#: Bytes that tell what data is, and whether two begin alike.
HEAD = 256


class Layer(NamedTuple):
    text: str  # of bytes, one character each, but for the document itself
    starts: list[int] | range | None  # of each character, in the document; None: one span for all
    ends: list[int] | range | None
    span: tuple[int, int]

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return self.span
        return self.starts[start], max(self.ends[start:end])


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns in a text, leftmost and non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if "passw" in lowered or "secret" in lowered or "token" in lowered or "api" in lowered:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _tool(data: bytes):
    """A decompressor for data that begins like gzip, zlib, bzip2 or xz; None for anything else."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _head(pieces: Iterator[bytes], data: bytes = b"") -> bytes:
    """Data with as many further pieces as tell what it is."""
    while len(data) < HEAD and (more := next(pieces, None)) is not None:
        data += more
    return data


def _members(data: bytes, pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of all members of compressed data, up to a damaged place; what follows the last comes as it is, on a line of its own."""
    tool, given = _tool(data), False
    while data is not None:
        try:
            out = tool.decompress(data, PIECE)
        except (zlib.error, lzma.LZMAError, OSError, ValueError):
            if not given:
                yield from chain([data], pieces)
            return
        if out:
            given = True
            yield out
        if tool.eof:
            data = _head(pieces, tool.unused_data.lstrip(b"\0"))
            tool = _tool(data)
            if tool is None:
                if data:
                    yield from chain([b"\n", data], pieces)
                return
        elif isinstance(tool, bz2.BZ2Decompressor | lzma.LZMADecompressor):
            data = next(pieces, None) if tool.needs_input else b""
        else:
            data = tool.unconsumed_tail
            if not data and len(out) < PIECE:
                data = next(pieces, None)


def _parted(held: bytes) -> int:
    """Where inflated data can be parted so that no finding or token lies across; 0 if nowhere."""
    stop = held.rfind(b"\n")
    while stop >= 0 and _WRAPPED.search(held, max(0, stop - 20), stop + 1):  # a token may go on in the next line
        stop = held.rfind(b"\n", 0, stop)
    if stop < 0 and len(held) > LONGEST_LINE:
        stop = max(held.rfind(x) for x in _BREAKS)
    return stop + 1


def inflate(data: bytes) -> Iterator[tuple[str, bool]]:
    """(text, cut): the contents of compressed data, compressed again or not, however often, in pieces that no finding or token lies across.

    Contents that begin as any layer before (a cycle, or no compressed data after all) are not
    followed. cut tells that a line was parted where no byte allowed it.
    """
    pieces, head, seen, depth = iter(()), data, set(), 0
    while _tool(head) is not None and head[:HEAD] not in seen:
        seen.add(head[:HEAD])
        pieces, depth = _members(head, pieces), depth + 1
        head = _head(pieces)
        if depth % STREAMED == 0:
            head, pieces = b"".join(chain([head], pieces)), iter(())
    held = b""
    for piece in chain([head], pieces):
        held += piece
        if len(held) < PIECE:
            continue
        if stop := _parted(held):
            yield held[:stop].decode("latin-1"), False
            held = held[stop:]
        elif len(held) > LONGEST_LINE:
            yield held.decode("latin-1"), True
            held = held[-OVERLAP:]
    yield held.decode("latin-1"), False


def _line(text: str, start: int, end: int) -> tuple[int, int]:
    stop = text.find("\n", end)
    return text.rfind("\n", 0, start) + 1, len(text) if stop < 0 else stop


def unescaped(text: str) -> list[tuple[str, int, int]]:
    """(character, start, end): the text without URL and Unicode escapes, those that unescaping makes included.

    Characters go on a stack; where the top completes an escape, its character takes the
    escape's place and may complete another. So nested escapes of any depth take one pass.
    Bytes stay characters of their own.
    """
    out: list[tuple[str, int, int]] = []
    for i, char in enumerate(text):
        item = (char, i, i + 1)
        while True:
            out.append(item)
            if item[0] not in _HEX_DIGITS:
                break
            for opening, digits in _ESCAPES:
                n = len(opening) + digits
                if len(out) >= n and all(out[k - n][0] == opening[k] for k in range(len(opening))) and all(x[0] in _HEX_DIGITS for x in out[len(out) - digits :]):
                    point = int("".join(x[0] for x in out[len(out) - digits :]), 16)
                    item = (chr(point) if point < 0x110000 else "\ufffd", out[-n][1], max(x[2] for x in out[-n:]))
                    del out[-n:]
                    break
            else:
                break
    return out


def _unescaped(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """Per line with escapes, the line without them; and what is compressed in its words."""
    at = 0
    while (found := _ESCAPED.search(layer.text, at)) is not None:
        begin, at = _line(layer.text, *found.span())
        chars = unescaped(layer.text[begin:at])
        places = [layer.place(begin + s, begin + e) for _, s, e in chars]
        line = "".join(c for c, _, _ in chars)
        inner = Layer(line, None if layer.starts is None else [s for s, _ in places], None if layer.starts is None else [e for _, e in places], layer.span)
        yield inner, False
        for m in _MAGIC_TEXT.finditer(line):  # bytes of a compressed stream, up to the next white space that was not escaped
            stop = next((k for k in range(m.start(), len(chars)) if chars[k][0] in " \t" and chars[k][2] - chars[k][1] == 1), len(chars))
            data = line[m.start() : stop].encode("latin-1", "replace")
            span = inner.place(m.start(), stop)
            yield from ((Layer(text, None, None, span), cut) for text, cut in inflate(data))


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(body, start, end) of runs of base64 characters, and of runs wrapped over lines as one."""
    for m in _RUN.finditer(text):
        yield m[0], *m.span()
    for m in _BLOCK.finditer(text):
        runs = _WRAP.split(m[0])
        if len(runs) > 2 or len(runs[0]) >= 16:
            yield "".join(runs), *m.span()


def _unwrapped(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """Contents of base64 tokens at each of the four alignments, inflated where they are compressed."""
    for token, start, end in _tokens(layer.text):
        body = token.rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(min(4, len(body) - 11)):
            whole = len(body) - (len(body) - skip) % 4 if (len(body) - skip) % 4 == 1 else len(body)
            data = base64.b64decode(body[skip:whole] + "=" * (-(whole - skip) % 4))
            if layer.starts is None or end - start != len(token):
                span = layer.place(start, end)  # wrapped, or of one span
            else:
                span = layer.place(start + skip, end)
            at = 0
            while (m := _MAGIC.search(data, at)) is not None:
                inflated = False
                for text, cut in inflate(data[m.start() :]):
                    inflated |= text.encode("latin-1") != data[m.start() : m.start() + len(text)]
                    yield Layer(text, None, None, span), cut
                at = len(data) if inflated else m.start() + 1
            plain = data.replace(b"\0", b"")  # of UTF-16 and UTF-32, too
            if _PLAIN.search(plain):
                yield Layer(plain.decode("latin-1"), None, None, span), False


class Scan(NamedTuple):
    base: list[tuple[str, int, int]]
    spans: list[tuple[str, int, int]]
    layers: int
    torn: list[tuple[int, int]]  # spans of layers that were not scanned whole


def _order(found) -> list[tuple[str, int, int]]:
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(text: str) -> Scan:
    """All findings of a text: base ones, and those of every layer mapped back."""
    base = base_findings(text)
    found, seen, torn, layers = set(base), set(), set(), 0

    def nested(layer: Layer) -> Iterator[tuple[Layer, bool]]:
        return chain(_unescaped(layer), _unwrapped(layer))

    work = [nested(Layer(text, range(len(text)), range(1, len(text) + 1), (0, len(text))))]
    while work:  # one layer of each depth at a time
        inner, over = next(work[-1], (None, False))
        if inner is None:
            work.pop()
            continue
        if over:
            torn.add(inner.span)
        mark = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), inner.span, inner.starts[0] if inner.starts else None)
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        found.update((kind, *inner.place(s, e)) for kind, s, e in base_findings(inner.text))
        work.append(nested(inner))
    return Scan(_order(base), _order(found), layers, sorted(torn))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every found span, overlapping ones as one, replaced by a mark."""
    out, at, end = [], 0, -1
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= max(end, at) or end < 0:
            out += [text[max(at, end, 0) : s], mark]
        end = max(end, e)
    return "".join(out) + text[max(end, 0) :]


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan_secrets(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, cut, redacted, the carried columns of `docs`), one per row of `docs` (doc_id, text).

    Counts and base_sha256 hold the base findings; spans all findings, those of decoded
    layers at the span of the document that encodes them; redacted is the text without
    them. A null text counts as empty (its redacted text is null). Repeated rows get equal
    answers; doc_id may be null. cut tells of a compressed layer with a line over LONGEST_LINE that
    has no byte to part it at, and was scanned in parts that overlap;
    redacted lacks its whole token then.
    """
    out = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("cut", pa.bool_()), ("redacted", pa.string())]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*out, *(batch.schema.field(2 + i) for i in range(len(carry)))])
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                scans = [scan(t or "") for t in texts]
                counts = [[sum(x[0] == k for x in s.base) for s in scans] for k in KINDS]
                digests = [hashlib.sha256(_joined(s.base).encode()).hexdigest() for s in scans]
                clean = [redact(t, [*s.spans, *(("cut", *x) for x in s.torn)]) if t and (s.spans or s.torn) else t for t, s in zip(texts, scans)]
                columns = [*counts, digests, [_joined(s.spans) for s in scans], [s.layers for s in scans], [bool(s.torn) for s in scans], clean]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns)), *part.columns[2:]], schema=schema)

    carried = "".join(f", `{c}` {given.schema[c].dataType.simpleString()}" for c in carry)
    return spread(given).mapInArrow(run, ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string, n_layers long, cut boolean, redacted string"]) + carried)
