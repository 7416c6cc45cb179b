"""Secrets in texts, also inside nested encodings.

A worklist starts with the text. Every layer is scanned; URL escapes, Unicode escapes,
base64 and compressed data in it become further layers until nothing new appears. Each
layer knows, for every character, the span of the text it came from, so what is found in
a layer is reported as a place in the text. Bytes are read as UTF-8, bytes that are none as replacement characters, and NULs between
ASCII characters (UTF-16, UTF-32) are dropped. Base64 is read in each line and over line ends,
in all four alignments, as other characters may stand before it; compressed data may begin at
any byte, and members that follow one another are one text. A layer that was seen at the same
place before is not entered again, which ends cycles.
"""

from __future__ import annotations

import binascii
import bz2
import functools
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex")
#: What counts as a secret of each kind, and its least length.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
_NAMES = ("passw", "secret", "token", "api")

_ESCAPED_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPED_UNITS = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ONE_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Runs over line ends, also written as escapes, with indents or quote marks.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>]*+[A-Za-z0-9+/_-]++)++")
_LINE_END = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*")
_STANDARD = str.maketrans("-_", "+/")
#: How compressed data may begin. zlib has just these second bytes without a preset dictionary.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
#: No secret, and no encoding of one, has fewer than 16 ASCII characters in a row, so bytes without such
#: a row, also with NULs between as in UTF-16 and UTF-32, hold nothing in sight.
_PROMISING = re.compile(rb"[\t\n\r\x20-~](?:\x00{0,3}[\t\n\r\x20-~]){15}")
_WIDE = re.compile(r"[\t\n\r\x20-~](?:\x00{1,3}[\t\n\r\x20-~]){15,}")
_NO_BYTE = re.compile(r"[\udc80-\udcff]")
#: Bytes of one decompressed layer. More are scanned in overlapping windows of this length.
WINDOW = 1 << 22
OVERLAP = 1 << 16
#: Bytes that meet a decompressor at a time.
PIECE = 1 << 12


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets in plain sight, by start and kind."""
    found = []
    if (":" in text or "=" in text) and any(word in folded for folded in [text.lower()] for word in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the span of the original that each of its characters came from."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def whole(cls, text: str) -> "Layer":
        at = np.arange(len(text))
        return cls(text, at, at + 1)

    def span(self, first: int, last: int) -> tuple[int, int]:
        return int(self.starts[first:last].min()), int(self.ends[first:last].max())


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None


def _inflated(parts, whole: list[int] | None = None):
    """Decompressed data in parts, or nothing if the bytes are in no known format.

    Members and streams that follow one another are one text. ``whole`` gets the place after
    each one that is complete.
    """
    tool, data, fed, begun = None, b"", 0, False
    for part in parts:
        for at in range(0, len(part), PIECE):  # what comes before an error in the data is kept
            piece = part[at:at + PIECE]
            data += piece
            fed += len(piece)
            while True:
                if tool is None:
                    data = data.lstrip(b"\0") if begun else data  # padding
                    if len(data) < 7:
                        break
                    tool, begun = _decompressor(data), True
                    if tool is None:
                        return
                try:
                    plain = tool.decompress(data, WINDOW)
                except (zlib.error, OSError, lzma.LZMAError, EOFError):
                    return
                data = getattr(tool, "unconsumed_tail", b"")
                if plain:
                    yield plain
                if tool.eof:
                    data, tool = tool.unused_data, None
                    if whole is not None:
                        whole.append(fed - len(data))
                elif not data and len(plain) < WINDOW:
                    break


def _windows(parts):
    """The parts joined to overlapping windows."""
    kept, held, size = b"", [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= WINDOW:
            whole = b"".join([kept, *held])
            yield whole
            kept, held, size = whole[-OVERLAP:], [], 0
    if held:
        yield b"".join([kept, *held])


def _unpacked(data: bytes):
    """Windows of what the bytes decompress to from any place, and of what that decompresses to, and so on."""
    at = 0
    while found := _MAGIC.search(data, at):
        rest, whole, seen = data[found.start():], [], set()
        parts = functools.partial(_inflated, [rest], whole)
        while True:
            mark = None
            for window in _windows(parts()):
                mark = mark or hashlib.sha256(window).digest()
                yield window
            if mark is None or mark in seen:
                break
            seen.add(mark)
            parts = functools.partial(lambda outer: _inflated(outer()), parts)
        at = found.start() + max(whole, default=1)


def _decoded(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Layer:
    """The bytes as UTF-8; each byte that is none becomes a replacement character of its own."""
    if data.isascii():
        return Layer(data.decode(), starts, ends)
    text = data.decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    sizes[(points >= 0xDC80) & (points < 0xDD00)] = 1
    last = np.cumsum(sizes)
    return Layer(_NO_BYTE.sub("\ufffd", text), starts[last - sizes], ends[last - 1])


def _packed(data: bytes, starts: np.ndarray, ends: np.ndarray):
    """Layers of what bytes decompress to."""
    for window in _unpacked(data):
        size = len(window)
        yield _decoded(window, np.broadcast_to(starts[0], size), np.broadcast_to(ends[-1], size))


def _of_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray):
    """Layers of decoded bytes: their text, and what they decompress to."""
    if _PROMISING.search(data):
        yield _decoded(data, starts, ends)
    yield from _packed(data, starts, ends)


def _replaced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with (start, end, new text, its starts, its ends) put in place."""
    text, starts, ends, at = [], [], [], 0
    for first, last, new, new_starts, new_ends in parts:
        text += [layer.text[at:first], new]
        starts += [layer.starts[at:first], new_starts]
        ends += [layer.ends[at:first], new_ends]
        at = last
    return Layer("".join(text) + layer.text[at:], np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]))


def _unescaped_bytes(layer: Layer):
    parts = []
    for m in _ESCAPED_BYTES.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        at = np.arange(m.start(), m.end(), 3)
        starts, ends = layer.starts[at], layer.ends[at + 2]
        plain = _decoded(data, starts, ends)
        parts.append((m.start(), m.end(), plain.text, plain.starts, plain.ends))
        yield from _packed(data, starts, ends)
    if parts:
        yield _replaced(layer, parts)


def _narrowed(layer: Layer):
    """UTF-16 and UTF-32 read as bytes: the NULs between ASCII characters go."""
    parts = []
    for m in _WIDE.finditer(layer.text) if "\0" in layer.text else ():
        at = np.array([n for n in range(m.start(), m.end()) if layer.text[n] != "\0"])
        parts.append((m.start(), m.end(), m[0].replace("\0", ""), layer.starts[at], layer.ends[at]))
    if parts:
        yield _replaced(layer, parts)


def _unescaped_units(layer: Layer):
    parts = []
    for m in _ESCAPED_UNITS.finditer(layer.text):
        units = [(u.start() + m.start(), u.end() + m.start(), int(u[1] or u[2] or u[3], 16)) for u in _ONE_UNIT.finditer(m[0])]
        out: list[tuple[int, int, str]] = []
        n = 0
        while n < len(units):
            first, last, code = units[n]
            if 0xD800 <= code < 0xDC00 and n + 1 < len(units) and 0xDC00 <= units[n + 1][2] < 0xE000:
                code = 0x10000 + ((code - 0xD800) << 10) + units[n + 1][2] - 0xDC00
                last = units[n + 1][1]
                n += 1
            n += 1
            bad = code > 0x10FFFF or 0xD800 <= code < 0xE000
            out += [(p, p + 1, layer.text[p]) for p in range(first, last)] if bad else [(first, last, chr(code))]
        text = "".join(c for _, _, c in out)
        if text != m[0]:
            parts.append((m.start(), m.end(), text, layer.starts[[p for p, _, _ in out]], layer.ends[[q - 1 for _, q, _ in out]]))
    if parts:
        yield _replaced(layer, parts)


def _base64_runs(text: str):
    """Runs of base64 characters in a line, and over lines: the characters and their places."""
    for m in _BASE64.finditer(text):
        yield m[0], np.arange(m.start(), m.end())
    for m in _WRAPPED.finditer(text):
        if len(m[0]) < 16:
            continue
        kept, at = [], 0
        for gap in _LINE_END.finditer(m[0]):
            kept.append((at, gap.start()))
            at = gap.end()
        kept.append((at, len(m[0])))
        body = "".join(m[0][a:b] for a, b in kept)
        if len(body) >= 16:
            yield body, np.concatenate([np.arange(a, b) for a, b in kept]) + m.start()


def _from_base64(layer: Layer):
    """Runs may begin with other characters than those of the code, so all four alignments are read."""
    for run, at in _base64_runs(layer.text):
        run = run.translate(_STANDARD)
        for skipped in range(4):
            body = run[skipped:len(run) - ((len(run) - skipped) % 4 == 1)]
            data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            if not _PROMISING.search(data) and not _MAGIC.search(data):
                continue
            bits = np.arange(len(data)) * 8
            yield from _of_bytes(data, layer.starts[at[skipped + bits // 6]], layer.ends[at[skipped + (bits + 7) // 6]])


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what is in plain sight and in every nested layer, sorted."""
    found = set(scan(text))
    if "%" not in text and "\\" not in text and "\0" not in text and "\n" not in text and not _BASE64.search(text):
        return sorted(found)
    # Decoders make a layer only when it is asked for, and each is dropped before the next: what is held is one layer a depth.
    work, seen = [_decoded_layers(Layer.whole(text))], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass") + b"%d:%d" % (layer.starts[0], layer.ends[-1])).digest()[:16]
        if mark in seen:
            continue
        seen.add(mark)
        for start, kind, end in scan(layer.text):
            first, last = layer.span(start, end)
            found.add((first, kind, last))
        work.append(_decoded_layers(layer))
        del layer
    return sorted(found)


def _decoded_layers(layer: Layer):
    """The layers that lie in one, one at a time."""
    for decode in (_unescaped_bytes, _unescaped_units, _narrowed, _from_base64):
        yield from decode(layer)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FIELDS = {"doc_id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(),
          "base_spans": pa.string(), "spans": pa.string(), "n_nested": pa.int64()}


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, counts by kind in plain sight, base_spans, spans and n_nested.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start, then kind, then
    end. ``n_nested`` counts spans found in decoded layers alone. Null and empty texts hold
    none. Each row is scanned alone, whole; repeated rows get equal rows and other columns
    are ignored. Decompressed data is scanned in overlapping windows, each dropped before the
    next is made, so memory is bounded by the depth of nesting whatever the data unpacks to.
    """
    def scanned(rows):
        for batch in rows:
            out = {name: [] for name in FIELDS}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = scan(text or ""), all_spans(text or "")
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                for name, value in zip(FIELDS, (doc_id, *counts, written(base), written(spans), len(spans) - len(set(base)))):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in FIELDS.items()], list(FIELDS))

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_nested long")
