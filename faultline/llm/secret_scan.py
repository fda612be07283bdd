"""Secret scan with a recursive worklist over encoded layers.

A text is scanned as it stands, then every layer that can be unwrapped from it: percent escapes, backslash escapes, base64
runs (on one line or several, from each of four characters on), text in two bytes a character and compressed bytes inside
them, wherever they start. Decoded bytes that are no text stay on the worklist. Each layer is scanned again and unwrapped further until nothing new appears; a
layer seen before is not taken up again. Spans found in a layer are mapped back, through every layer above it, to the
characters of the document that carry them.
"""
from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.llm import common

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
#: Escapes of one byte each, as in the printed form of bytes.
RAW_ESCAPE = re.compile(r"(?:\\u00[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"])+")
SIMPLE = dict(zip("abfnrtv0\\'\"", "\a\b\f\n\r\t\v\0\\'\"", strict=True))
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, also indented or with line ends written as escapes; it starts only where a run starts.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
ALPHABET = re.compile(r"\\[rn]|[A-Za-z0-9+/_-]+")
#: Plain characters in two bytes each, in either byte order.
WIDE = re.compile(r"\x00?(?:[\t\n\r -~]\x00){11,}[\t\n\r -~]\x00?")
#: The shortest match has 12 characters, all of them ASCII, and so has all that escapes or base64 can hold one in.
WORTH = re.compile(rb"[\t\n\r -~]{12}|(?:[\t\n\r -~]\x00){11}[\t\n\r -~]")
#: An inflated layer above this many bytes is put into a file and read as mapped memory, which bounds a task's memory;
#: it is scanned as a whole, and ``oversize`` counts such layers.
MOST_BYTES = 8 << 20
STEP = 1 << 18
ZLIB = b"|".join(re.escape(bytes([c])) + b"[" + b"".join(re.escape(bytes([f])) for f in range(256) if not (c * 256 + f) % 31 and not f & 32) + b"]" for c in range(8, 128, 16))
OPENER = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|" + ZLIB, re.S)
#: The same patterns for inflated bytes, whose matches all have one place; there it counts only whether there are some.
KIND_BYTES = [re.compile(x) for x in (rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""", rb"AKIA[A-Z0-9]{16}", rb"[0-9a-f]{24}")]
BASE64_BYTES, WRAPPED_BYTES, WIDE_BYTES = (re.compile(x.pattern.encode()) for x in (BASE64, WRAPPED, WIDE))
PERCENT_BYTE, ESCAPE_BYTE = re.compile(rb"%[0-9A-Fa-f]{2}"), re.compile(rb"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
RAW_BYTE = re.compile(ESCAPE_BYTE.pattern + rb"|\\[abfnrtv0\\'\"]")


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches: leftmost and not overlapping for each kind, failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # runs are maximal, so looking for long runs finds the same matches
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def readable(data: bytes) -> str | None:
    """Text of decoded bytes, or nothing if they are not text as a whole."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(map(data.count, ODD))
    return text if text and odd * 20 <= len(text) else None


ODD = [bytes([c]) for c in range(32) if c not in b"\t\n\r"]


def is_text(data: bytes | mmap.mmap) -> bool:
    """Whether ``readable`` takes the bytes for text, read in stretches whatever their length."""
    decoder, odd, chars = codecs.getincrementaldecoder("utf-8")(), 0, 0
    try:
        for x in pieces(data, 0, len(data)):
            chars += len(decoder.decode(x))
            odd += sum(map(x.count, ODD))
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return chars > 0 and odd * 20 <= chars


class Inflated:
    """Output of the compressed members that follow each other from ``at`` on; ``end``: where they end."""

    def __init__(self, data: bytes | mmap.mmap, at: int):
        self.data, self.at, self.end, self.whole = data, at, at, False

    def __iter__(self) -> Iterator[bytes]:
        at = self.at
        while m := OPENER.match(self.data, at):
            kind = m[0][:2]
            d = bz2.BZ2Decompressor() if kind == b"BZ" else lzma.LZMADecompressor() if kind == b"\xfd7" else zlib.decompressobj(31 if kind == b"\x1f\x8b" else 15)
            rest = b""
            try:
                while not d.eof:
                    if not rest and getattr(d, "needs_input", True):
                        rest = self.data[at:at + STEP]
                        at += len(rest)
                    out = d.decompress(rest, STEP)
                    more = bool(rest)
                    rest = getattr(d, "unconsumed_tail", b"")
                    if out:
                        yield out
                    elif not more and not d.eof:
                        break
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            at -= len(d.unused_data) + len(rest)
            self.end = at
            if not d.eof:
                return
            self.whole = True
            while self.data[at:at + 1] == b"\0":                     # padding between members
                at += 1


def inflations(data: bytes | mmap.mmap) -> Iterator[tuple[int, int, bytes | mmap.mmap, bool, bool]]:
    """``(start, end, bytes, ended properly, large)`` of everything compressed in ``data``, wherever it starts."""
    at = 0
    while m := OPENER.search(data, at):
        members = Inflated(data, m.start())
        out, large = kept(members)
        if len(out):
            yield m.start(), max(members.end, m.end()) if members.whole else len(data), out, members.whole, large
        at = members.end if members.whole else m.start() + 1


def kept(chunks: Iterable[bytes]) -> tuple[bytes | mmap.mmap, bool]:
    """The bytes of ``chunks``, and whether they are above ``MOST_BYTES`` and so in a file (gone with the last use)."""
    out, file = bytearray(), None
    for x in chunks:
        out += x
        if len(out) > MOST_BYTES:
            file = file or tempfile.TemporaryFile()
            file.write(out)
            out = bytearray()
    if file is None:
        return bytes(out), False
    with file:
        file.write(out)
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), True


def pieces(data: bytes | mmap.mmap, a: int, b: int) -> Iterator[bytes]:
    for at in range(a, b, STEP):
        yield data[at:min(b, at + STEP)]


def substituted(data: bytes | mmap.mmap, pattern: re.Pattern, decode) -> Iterator[bytes]:
    at = 0
    for m in pattern.finditer(data):
        yield from pieces(data, at, m.start())
        yield decode(m[0])
        at = m.end()
    yield from pieces(data, at, len(data))


def byte_of(escaped: bytes) -> bytes:
    """One escape: a byte where it stands for one, else the character in UTF-8."""
    if escaped[1:2] not in (b"u", b"x"):
        return SIMPLE[escaped[1:].decode()].encode()
    if len(escaped) == 12:
        return (escaped[:6] + escaped[6:]).decode("unicode_escape").encode("utf-16-be", "surrogatepass").decode("utf-16-be").encode()
    code = int(escaped[2:], 16)
    return bytes([code]) if code < 256 else chr(code).encode("utf-8", "replace")


def base64_bytes(data: bytes | mmap.mmap, a: int, b: int, phase: int) -> Iterator[bytes]:
    """Bytes of the run [a, b) without its first ``phase`` characters."""
    held, cut = b"", phase
    for x in pieces(data, a, b):
        x = held + x
        split = len(x) - (x.endswith(b"\\") or 2 * x.endswith(b"\\r"))
        tail, x = x[split:], x[:split]
        x = x.replace(b"\\r", b"").replace(b"\\n", b"").translate(URLSAFE, b" \t\r\n=")
        drop = min(cut, len(x))
        cut -= drop
        x = x[drop:]
        full = len(x) // 4 * 4
        yield base64.b64decode(x[:full])
        held = x[full:] + tail
    held = held[:-1] if len(held) % 4 == 1 else held
    yield base64.b64decode(held + b"=" * (-len(held) % 4))


URLSAFE = bytes.maketrans(b"-_", b"+/")


def within(data: bytes | mmap.mmap) -> Iterator[tuple[bytes | mmap.mmap, bool, bool]]:
    """``(bytes, large, properly a layer)``: what can be unwrapped from inflated bytes."""
    if PERCENT_BYTE.search(data):
        yield *(x := kept(substituted(data, PERCENT_BYTE, lambda e: bytes([int(e[1:], 16)])))), True
        if b"+" in x[0] and OPENER.search(x[0]):
            yield *kept(substituted(data, re.compile(rb"%[0-9A-Fa-f]{2}|\+"), lambda e: b" " if e == b"+" else bytes([int(e[1:], 16)]))), False
    if ESCAPE_BYTE.search(data):
        yield *(x := kept(substituted(data, ESCAPE_BYTE, byte_of))), True
        if b"\\" in x[0]:
            yield *kept(substituted(data, RAW_BYTE, byte_of)), False
    for pattern in (BASE64_BYTES, WRAPPED_BYTES):
        for m in pattern.finditer(data):
            for phase in range(4):
                x, large = kept(base64_bytes(data, *m.span(), phase))
                if WORTH.search(x) or OPENER.search(x):
                    yield x, large, is_text(x)
    for m in WIDE_BYTES.finditer(data):
        yield *kept(x.replace(b"\0", b"") for x in pieces(data, *m.span())), True
    for _, _, x, whole, large in inflations(data):
        yield x, large, whole


class Layer:
    """A text and, for each of its characters, the stretch of the document that carries it (none: the document itself).

    ``binary``: the characters are bytes, which may hold something compressed; ``sure``: the layer is text as a whole.
    """

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, binary: bool = False, sure: bool = True):
        self.text, self.start, self.end, self.binary, self.sure = text, start, end, binary, sure

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def child(self, text: str, a: np.ndarray, b: np.ndarray, binary: bool = False, sure: bool = True) -> Layer:
        """``text`` whose characters come from stretches [a, b) of this layer."""
        return Layer(text, a, b, binary, sure) if self.start is None else Layer(text, self.start[a], self.end[b - 1], binary, sure)


class Deep:
    """Inflated bytes: no character of them has a place of its own, all have that of the compressed run."""

    def __init__(self, data: bytes | mmap.mmap, lo: int, hi: int, large: bool, sure: bool):
        self.data, self.lo, self.hi, self.large, self.sure = data, lo, hi, large, sure

    def inner(self) -> Iterator[Deep]:
        for data, large, sure in within(self.data):
            yield Deep(data, self.lo, self.hi, large, sure)


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every escape run of ``pattern`` decoded in place."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        text, width = got
        plain = np.arange(at, m.start())
        place = m.start() + np.concatenate([[0], np.cumsum(width)])
        parts += [layer.text[at:m.start()], text]
        starts += [plain, place[:-1]]
        ends += [plain + 1, place[1:]]
        at = m.end()
    if not parts:
        return None
    plain = np.arange(at, len(layer.text))
    return layer.child("".join(parts) + layer.text[at:], np.concatenate([*starts, plain]).astype(np.int64), np.concatenate([*ends, plain + 1]).astype(np.int64))


def percent(run: str) -> tuple[str, list[int]] | None:
    data = binascii.unhexlify(run.replace("%", ""))
    text = data.decode("utf-8", "replace")
    if "�" in text:                                             # not UTF-8: one character a byte
        return data.decode("latin-1"), [3] * len(data)
    return text, [3 * len(c.encode()) for c in text]


def escape(run: str) -> tuple[str, list[int]] | None:
    text, width, high = [], [], None
    for m in re.finditer(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", run):
        code, n = int(m[1] or m[2], 16), m.end() - m.start()
        if high is not None and 0xDC00 <= code < 0xE000:
            text[-1], width[-1], high = chr(0x10000 + (high - 0xD800) * 1024 + code - 0xDC00), width[-1] + n, None
            continue
        high = code if 0xD800 <= code < 0xDC00 else None
        text.append(chr(code) if not 0xD800 <= code < 0xE000 else "�")
        width.append(n)
    return "".join(text), width


def raw_percent(run: str) -> tuple[str, list[int]]:
    data = binascii.unhexlify(run.replace("%", ""))
    return data.decode("latin-1"), [3] * len(data)


def raw_escape(run: str) -> tuple[str, list[int]]:
    found = list(re.finditer(r"\\(?:u00(..)|x(..)|(.))", run))
    return "".join(SIMPLE[m[3]] if m[3] else chr(int(m[1] or m[2], 16)) for m in found), [m.end() - m.start() for m in found]


def latin(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def from_base64(layer: Layer, a: int, b: int) -> Iterator[Layer]:
    """Layers of the base64 run [a, b), decoded from each of its first four characters on."""
    parts = [m.span() for m in ALPHABET.finditer(layer.text, a, b) if m[0][0] != "\\"]
    run = "".join(layer.text[x:y] for x, y in parts)
    place = None
    if len(run) < 16:
        return
    for phase in range(4):
        coded = run[phase:]
        coded = (coded[:-1] if len(coded) % 4 == 1 else coded).replace("-", "+").replace("_", "/")
        data = base64.b64decode(coded + "=" * (-len(coded) % 4))
        plain = readable(data)
        if plain is None and not WORTH.search(data) and not OPENER.search(data):
            continue
        if place is None:
            place = np.concatenate([np.arange(x, y) for x, y in parts])
        text = data.decode("latin-1") if plain is None else plain
        last = np.arange(1, len(text) + 1) if plain is None or len(plain) == len(data) else np.cumsum([len(c.encode()) for c in plain])
        first = np.concatenate([[0], last[:-1]])
        yield layer.child(text, place[phase + first * 4 // 3], place[phase - 1 - (-last * 4 // 3)] + 1, plain is None or bool(OPENER.match(data)), plain is not None)


def unwrapped(layer: Layer) -> Iterator[Layer | Deep]:
    """Layers directly inside a layer."""
    text = layer.text
    if "%" in text and (x := replaced(layer, PERCENT, percent)):
        yield x
        raw = replaced(layer, PERCENT, raw_percent)
        for y in (raw.text, raw.text.replace("+", " ") if "+" in text else None):
            if y is not None and OPENER.search(latin(y)):
                yield Layer(y, raw.start, raw.end, True, False)
    if "\\" in text and (x := replaced(layer, ESCAPE, escape)):
        yield x
        raw = replaced(layer, RAW_ESCAPE, raw_escape)
        if raw and OPENER.search(latin(raw.text)):
            yield Layer(raw.text, raw.start, raw.end, True, False)
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(text):
            yield from from_base64(layer, *m.span())
    if "\0" in text:
        for m in WIDE.finditer(text):
            at = m.start() + np.flatnonzero([c != "\0" for c in m[0]])
            yield layer.child(m[0].replace("\0", ""), at, at + 1)
    if layer.binary:
        for a, b, data, whole, large in inflations(latin(text)):
            yield Deep(data, *layer.origin(a, b), large, whole)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans (each ``(start, kind, end)``, ascending), layers unwrapped, layers above ``MOST_BYTES``."""
    base = spans_of(text)
    every, seen, layers, oversize = set(base), {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}, 0, 0
    work = [unwrapped(Layer(text))]                                  # depth first: one layer of each depth is held
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        deep = isinstance(x, Deep)
        name = hashlib.sha256(x.data if deep else x.text.encode("utf-8", "surrogatepass"))
        if deep or len(x.text):                                      # the same content elsewhere is another layer
            lo, hi = (x.lo, x.hi) if deep else x.origin(0, len(x.text))
            name.update(lo.to_bytes(8, "little") + hi.to_bytes(8, "little") + bytes([deep, not deep and x.binary]))
        if name.digest() in seen:
            continue
        seen.add(name.digest())
        if deep:
            found = {(x.lo, k, x.hi) for k, pattern in enumerate(KIND_BYTES) if pattern.search(x.data)}
            oversize += x.large
            work.append(x.inner())
        else:
            found = {(lo, kind, hi) for a, kind, b in spans_of(x.text) for lo, hi in (x.origin(a, b),)}
            work.append(unwrapped(x))
        layers += x.sure or bool(found)                              # bytes in which nothing is found are no layer
        every |= found
    return base, sorted(every), layers, oversize


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, layers, oversize, secrets``.

    The first four describe the matches in the text as it stands; ``spans`` holds them and what nested layers add, mapped
    to the text, and ``secrets`` the stretches of the text under all spans. Null and empty texts have none (the hash is
    that of nothing). Equal spans from several layers count once, repeated rows are scanned each, a null doc_id is kept,
    other columns are not read. Surrogates that no character uses are decoded as U+FFFD.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, oversize long, secrets array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                base, every, layers, oversize = scan(text)
                n = np.bincount([k for _, k, _ in base], minlength=3)
                rows.append((*map(int, n), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), layers, oversize, [text[a:z] for a, _, z in every]))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "oversize", "secrets"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)
