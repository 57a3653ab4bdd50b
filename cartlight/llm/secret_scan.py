"""Secrets in texts and in what their encodings hide."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.scratch import Scratch

# What is looked for, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_VALUE = 12
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")

# Encodings: runs of %41; A, \U00000041, \u{41}, \x41, &#65; and &#x41;; base64 in either alphabet, also over
# several lines. The shortest secret has 16 bytes, so 22 characters of base64.
_PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n)*[A-Za-z0-9+/_-]{22,}={0,2}|(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]{1,21}={0,2}")
_UNPRINTED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_DECODED = (_PERCENT, _ESCAPE, _BASE64)

# A text without a match of it has neither secrets nor encodings.
_MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#|[A-Za-z0-9+/_-]{22}"

# Bytes that come out of a compressed layer at a time, and how many of them are looked at again with the next ones.
_PIECE, _AGAIN = 1 << 22, 1 << 12

Span = tuple[str, int, int]


def secrets(text: str) -> list[Span]:
    """(kind, start, end) of the secrets that stand in the text itself, leftmost and non-overlapping per kind."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _VALUE]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return spans


def _ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@dataclass
class _Layer:
    """A decoded text: how it came about, and what part of the text above it a part of it stands for."""

    text: str
    steps: tuple[str, ...]
    above: _Layer | None
    place: Callable[[int, int], tuple[int, int]]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The part of the original text."""
        layer = self
        while layer.above is not None:
            start, end = layer.place(start, end)
            layer = layer.above
        return start, end

    def below(self, text: str, step: str, place: Callable[[int, int], tuple[int, int]]) -> _Layer:
        return _Layer(text, (*self.steps, step), self, place)


def _replaced(layer: _Layer, step: str, found: list[tuple[int, int, str]]) -> _Layer | None:
    """The whole text with the given parts (start, end, character) replaced."""
    if not found:
        return None
    text, parts, places, at, now = layer.text, [], [], 0, 0
    for start, end, char in found:
        parts += [text[at:start], char]
        now += start - at
        places.append(now)
        now, at = now + 1, end
    parts.append(text[at:])

    def one(k: int) -> tuple[int, int]:
        before = bisect_right(places, k) - 1
        if before < 0:
            return k, k + 1
        if places[before] == k:
            return found[before][:2]
        literal = found[before][1] + k - places[before] - 1
        return literal, literal + 1

    return layer.below("".join(parts), step, lambda start, end: (one(start)[0], one(end - 1)[1]))


def _percent(layer: _Layer) -> Iterator[_Layer]:
    """%41 as UTF-8; bytes that are none stay escaped. A run of bytes may also be compressed."""
    found = []
    for m in _PERCENT.finditer(layer.text):
        data, at = bytes.fromhex(m.group().replace("%", "")), m.start()
        for char in data.decode(errors="surrogateescape"):
            valid = not "\udc80" <= char <= "\udcff"
            width = 3 * len(char.encode()) if valid else 3
            if valid:
                found.append((at, at + width, char))
            at += width
        yield from _unpacked(layer, data, "url", *m.span())
    whole = _replaced(layer, "url", found)
    if whole:
        yield whole


def _escapes(layer: _Layer) -> Iterator[_Layer]:
    """Escaped code points as characters; two halves of a pair are one, a half alone stays as it is."""
    found: list[tuple[int, int, str]] = []
    half = None
    for m in _ESCAPE.finditer(layer.text):
        number = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        if half and half[1] == m.start() and 0xDC00 <= number < 0xE000:
            found.append((half[0], m.end(), chr(0x10000 + (half[2] - 0xD800 << 10) + number - 0xDC00)))
        elif number < 0x110000 and not 0xD800 <= number < 0xE000:
            found.append((*m.span(), chr(number)))
        half = (*m.span(), number) if 0xD800 <= number < 0xDC00 else None
    whole = _replaced(layer, "unicode", found)
    if whole:
        yield whole


def _base64(layer: _Layer) -> Iterator[_Layer]:
    """Runs that decode to printed text or to a compressed stream."""
    for m in _BASE64.finditer(layer.text):
        run = m.group().rstrip("=")
        places = None
        if "\n" in run:
            places = [k for k, c in enumerate(run) if c not in "\r\n"]
            run = run.translate({10: None, 13: None})
        run = run[: len(run) - (len(run) % 4 == 1)]
        data = base64.b64decode(run.translate({45: "+", 95: "/"}) + "=" * (-len(run) % 4))
        yield from _unpacked(layer, data, "base64", *m.span())
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if _UNPRINTED.search(text):
            continue

        def place(start: int, end: int, text=text, first=m.start(), places=places) -> tuple[int, int]:
            low = len(text[:start].encode()) * 8 // 6
            high = -(-len(text[:end].encode()) * 8 // 6) - 1
            if places:
                low, high = places[low], places[high]
            return first + low, first + high + 1

        yield layer.below(text, "base64", place)


def _opener(data: bytes):
    """What undoes the compression that the bytes begin with, by their fixed first bytes, and its name."""
    if len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib", zlib.decompressobj()
    if data[:3] == b"\x1f\x8b\x08":
        return "gzip", zlib.decompressobj(31)
    if data[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", zstandard.ZstdDecompressor().decompressobj()
    return None


def _inflated(name: str, opener, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The stream opened, at most ``_PIECE`` bytes at a time; a broken one as far as it goes."""
    try:
        for chunk in chunks:
            if name in ("zlib", "gzip"):
                while chunk and not opener.eof:
                    yield opener.decompress(chunk, _PIECE)
                    chunk = opener.unconsumed_tail
            elif name == "zstd":
                for at in range(0, len(chunk), 1 << 10):  # takes no bound, so it is fed in small parts
                    yield opener.decompress(chunk[at : at + (1 << 10)])
            else:
                while not opener.eof:
                    yield opener.decompress(chunk, _PIECE)
                    chunk = b""
                    if opener.needs_input:
                        break
            if getattr(opener, "eof", False):
                return
        if name in ("zlib", "gzip"):
            yield opener.flush()
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError):
        return


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes in pieces of ``_PIECE`` or a little more, each but the first begun with the end of the one before."""
    held, fresh = b"", False
    for chunk in chunks:
        held, fresh = held + chunk, fresh or bool(chunk)
        if len(held) >= _PIECE + _AGAIN:
            yield held
            held, fresh = held[-_AGAIN:], False
    if fresh:
        yield held


def _unpacked(layer: _Layer, data: bytes, step: str, start: int, end: int) -> Iterator[_Layer]:
    """The text of compressed bytes, also of several compressions in one another; all of it stands for the whole part."""
    chunks, steps, seen = iter([data]), [step], set()
    first = data
    while (opened := _opener(first)) and (mark := hashlib.md5(first).digest()) not in seen:
        seen.add(mark)  # a stream that unpacks to itself would go on for ever
        steps.append(opened[0])
        chunks = _inflated(*opened, chunks)
        first = next((c for c in chunks if c), b"")
        chunks = _chained(first, chunks)
    if len(steps) > 1:
        for piece in _pieces(chunks):
            yield layer.below(piece.decode(errors="replace"), ">".join(steps), lambda a, b: (start, end))


def _chained(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    for unwrap in (_percent, _escapes, _base64):
        yield from unwrap(layer)


def scan(text: str) -> tuple[list[Span], list[tuple[str, int, int, str]]]:
    """The text's own secrets, and all (kind, start, end, layers), hidden ones at the place of what hides them.

    Works off a list of layers: each is searched and then unwrapped, until nothing new comes out. A layer that has come
    up before at its place, by another order of unwrapping, is not taken again.
    """
    base = _ordered(secrets(text))
    found = {span: "" for span in base}
    if any(p.search(text) for p in _DECODED):
        start = _Layer(text, (), None, lambda a, b: (a, b))
        seen, work = set(), [iter([start])]
        while work:
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
                continue
            if not layer.text:
                continue
            mark = (hashlib.md5(layer.text.encode()).digest(), layer.origin(0, len(layer.text)))
            if mark in seen:
                continue
            seen.add(mark)
            if layer.above is not None:
                for kind, low, high in secrets(layer.text):
                    found.setdefault((kind, *layer.origin(low, high)), ">".join(layer.steps))
            work.append(_unwrapped(layer))
    return base, [(*span, found[span]) for span in _ordered(found)]


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]))
_SCHEMA = (
    "doc_id bigint, base array<struct<kind:string, start:bigint, end:bigint>>, "
    "spans array<struct<kind:string, start:bigint, end:bigint, layers:string>>"
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_pylist()
        made = [scan(texts[k].as_py()) if m else ([], []) for k, m in enumerate(maybe)]
        base = [[dict(zip(("kind", "start", "end"), s)) for s in b] for b, _ in made]
        spans = [[dict(zip(("kind", "start", "end", "layers"), s)) for s in f] for _, f in made]
        yield pa.RecordBatch.from_arrays([ids, pa.array(base, _BASE), pa.array(spans, _FOUND)], ["doc_id", "base", "spans"])


def secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row: the secrets that stand in a whole text, and with them those in its encodings.

    Spans are (kind, start, end) in code points of the text, the end exclusive, ordered by start, then kind as in
    ``KINDS``, then end. Kinds: ``assign`` is a word such as password or api_key with = or : and a value of 12
    characters or more; ``access`` an AKIA key of 18 or more; ``hex`` 16 or more lower-case hexadecimal digits.
    ``base`` is found in the text itself, ``spans`` has those and what is found in its layers, with ``layers``, the
    steps of one way that leads there ("" for base ones): percent escapes, escaped code points, base64, and streams of zlib, gzip,
    bzip2, xz or zstd within base64 or percent escapes, in one another in any order and to any depth. A hidden secret has
    the span of the characters that encode it, or of the whole encoded part where that is compressed. A secret that is longer than
    4096 bytes may be found in parts where a compressed stream gives more than four megabytes.

    A null or empty text has no spans. doc_id may be null or repeated; other columns are ignored. Each row is worked
    on alone, with its text, the chain of layers above the present one and one piece of a compressed stream in memory;
    nothing is shuffled.
    """
    Scratch(documents.sparkSession, "secrets")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scanned, _SCHEMA)
