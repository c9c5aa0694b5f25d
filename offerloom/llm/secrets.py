"""Secrets in texts, also under layers of encoding.

A worklist starts with the text itself. Each layer is scanned, and every way to unwrap it gives new
layers: percent escapes (%NN, %uNNNN), Unicode escapes (\\uNNNN, \\u{N}, \\UNNNNNNNN, \\xNN) and numeric
entities (&#NN;, &#xNN;) are replaced in place, base64 runs become layers of their
own, and bytes in base64 or percent escapes that are compressed (gzip, zlib, bz2, xz, also several times
over or one after the other, cut off, or raw deflate from the first byte of a run) are inflated, wherever in the bytes
they start. Bytes are read as UTF-8, and their ASCII stretches as UTF-16 too. Base64 is decoded from each
of the first four characters of its run, so that it need not start the run, and also across single line
breaks; what is found is reported as the range from there to the end of the run.
Unwrapping goes on until no new layer appears; a layer that has been seen at the same place of the
text is not taken again, so cycles end. Each stretch of a layer knows the range of the layer below
that it came from, and a hit is reported as the range of the original text, in code points.
Escapes nested more than ``ROUNDS`` times are unwrapped to their end in one pass, which takes time in proportion
to the text. No layer in between is needed: a secret holds no character that an escape is made of at its
start, so it stays, or becomes longer, when what is around it is unwrapped.

Kinds, in order: ``assign`` (a name such as password or api_key, a colon or equals sign, 12 or more
characters), ``access`` (AKIA and 14 or more capitals or digits), ``hex`` (16 or more digits a-f, 0-9).

Defined results: null is the empty text without spans; a range found in several layers is listed once;
single escapes that are no UTF-8 or half a pair stay as they are, those around them are decoded; bytes are
decoded with replacement and scanned if they hold ``LEAST_ASCII`` ASCII characters in a row.
Compressed data that inflate to more than ``MOST_INFLATED`` bytes are searched in windows of that size, which share
``SHARED`` bytes; compressed data inside of those that go on beyond a window are searched up to its end, and the row
counts them in ``n_unopened``; ``redact`` replaces their range. Rows are independent of each other; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import map_texts, text_column

MOST_INFLATED = 1 << 26
SHARED = 1 << 16
ROUNDS = 4
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_UNITS = r"(?:[%\\]u[0-9A-Fa-f]{4})+"
_POINT = r"\\u\{[0-9A-Fa-f]{1,8}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,8};|&#[xX][0-9A-Fa-f]{1,8};"
_ESCAPES = re.compile(rf"(?:%[0-9A-Fa-f]{{2}})+|(?:\\x[0-9A-Fa-f]{{2}})+|{_UNITS}|{_POINT}")
# one escape at the end of a text that ends in one of _ENDS
_LAST = re.compile(rf"(?:%[0-9A-Fa-f]{{2}}|\\x[0-9A-Fa-f]{{2}}|[%\\]u[0-9A-Fa-f]{{4}}|{_POINT})\Z")
_ENDS = frozenset("0123456789abcdefABCDEF};")
_LONGEST = 12
# 16 bytes are the least that can hold a secret
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
# the shortest secret has 16 characters
LEAST_ASCII = 16
_ASCII = re.compile(rb"[\t\n\r\x20-\x7e]{%d}" % LEAST_ASCII)
_UTF16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){%d,}|(?:\0[\t\n\r\x20-\x7e]){%d,}" % (LEAST_ASCII, LEAST_ASCII))
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAKS = re.compile(r"\s+")
# bytes in percent escapes, with the characters that need none between them
_ESCAPED = re.compile(r"[!-~]+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|[\x08\x18\x28\x38\x48\x58\x68\x78][\0-\xff]")
_STANDARD = str.maketrans("-_", "+/")

Span = tuple[int, int, int]  # start, end, number of the kind


def scan(text: str) -> list[Span]:
    """Base spans of one layer, leftmost and without overlap per kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


@dataclass
class Layer:
    """A text and where it comes from: itself, one range of the original text, or stretches of the layer below.

    A stretch begins at ``begins[i]`` here and at ``froms[i]`` below; it is a copy, or one character decoded
    from what ends at ``ends[i]`` (None for a copy).
    """

    text: str
    whole: tuple[int, int] | None = None
    below: Layer | None = None
    begins: list[int] | None = None
    froms: list[int] | None = None
    ends: list[int | None] | None = None
    depth: int = 0

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.below is None:
            return start, end
        i, j = bisect_right(self.begins, start) - 1, bisect_right(self.begins, end - 1) - 1
        first = self.froms[i] + (start - self.begins[i] if self.ends[i] is None else 0)
        last = self.froms[j] + end - self.begins[j] if self.ends[j] is None else self.ends[j]
        return self.below.origin(first, last)

    def key(self) -> tuple:
        place = self.origin(0, len(self.text)) if self.text else (0, 0)
        return place, hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()


Piece = list[tuple[str, int, int]]  # characters with their ranges in what was decoded


def _bytes_piece(escaped: str, width: int) -> Piece | None:
    """A run of escapes of one byte each, as UTF-8; bytes that are none stay."""
    data = bytes(int(escaped[i + width - 2 : i + width], 16) for i in range(0, len(escaped), width))
    out, at, changed = [], 0, False
    for c in data.decode("utf-8", "surrogateescape"):
        if 0xDC80 <= ord(c) <= 0xDCFF:
            out += [(escaped[i], i, i + 1) for i in range(at, at + width)]
            at += width
            continue
        end = at + width * len(c.encode())
        out.append((c, at, end))
        at, changed = end, True
    return out if changed else None


def _unicode_piece(escaped: str) -> Piece | None:
    """Characters of a run of 16-bit escapes; surrogates that pair up are one character."""
    units = [int(escaped[i + 2 : i + 6], 16) for i in range(0, len(escaped), 6)]
    out, i, changed = [], 0, False
    while i < len(units):
        pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
        if pair:
            code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00
        elif 0xD800 <= units[i] < 0xE000:
            out += [(escaped[k], k, k + 1) for k in range(6 * i, 6 * i + 6)]
            i += 1
            continue
        else:
            code = units[i]
        changed = True
        out.append((chr(code), 6 * i, 6 * (i + 1 + pair)))
        i += 1 + pair
    return out if changed else None


def _code_point(escaped: str) -> int:
    """The number of one escape."""
    if escaped[0] == "&":
        return int(escaped[3:-1], 16) if escaped[2] in "xX" else int(escaped[2:-1])
    if escaped[1] in "xuU":
        return int(escaped[2:].strip("{}"), 16)
    return int(escaped[1:], 16)


def _escape_piece(escaped: str) -> Piece | None:
    if escaped[0] == "%" and escaped[1] != "u":
        return _bytes_piece(escaped, 3)
    if escaped[:2] == "\\x":
        return _bytes_piece(escaped, 4)
    if escaped[1] == "u" and escaped[2] != "{":
        return _unicode_piece(escaped)
    code = _code_point(escaped)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(escaped))]


def _unnested_piece(run: str) -> Piece | None:
    """A run with all escapes of ASCII characters decoded, however deeply nested, from left to right.

    A character that ends an escape is put in its place at once, so that it can end another.
    """
    out: Piece = []
    for i, c in enumerate(run):
        out.append((c, i, i + 1))
        while out[-1][0] in _ENDS:
            tail = "".join(x for x, _, _ in out[-_LONGEST:])
            found = _LAST.search(tail)
            if found is None or (code := _code_point(found.group())) >= 128:
                break
            begin = len(out) - len(found.group())
            out[begin:] = [(chr(code), out[begin][1], out[-1][2])]
    return out if len(out) < len(run) else None


def _replaced(layer: Layer, pattern: re.Pattern, piece) -> Layer | None:
    """The layer with every match of ``pattern`` decoded in place, or None if nothing was decoded."""
    parts: list[str] = []
    begins: list[int] = []
    froms: list[int] = []
    ends: list[int | None] = []
    at = done = 0
    for match in pattern.finditer(layer.text):
        decoded = piece(match.group())
        if decoded is None:
            continue
        copied = layer.text[done : match.start()]
        if copied:
            parts.append(copied)
            begins.append(at)
            froms.append(done)
            ends.append(None)
            at += len(copied)
        for c, begin, end in decoded:
            parts.append(c)
            begins.append(at)
            froms.append(match.start() + begin)
            ends.append(match.start() + end)
            at += 1
        done = match.end()
    if not done:
        return None
    if done < len(layer.text):
        parts.append(layer.text[done:])
        begins.append(at)
        froms.append(done)
        ends.append(None)
    text = "".join(parts)
    if layer.whole is not None:
        return Layer(text, whole=layer.whole, depth=layer.depth + 1)
    return Layer(text, below=layer, begins=begins, froms=froms, ends=ends, depth=layer.depth + 1)


def _unescaped(layer: Layer) -> Layer | None:
    if "%" not in layer.text and "\\" not in layer.text and "&#" not in layer.text:
        return None
    if layer.depth == ROUNDS and (found := _replaced(layer, _ESCAPED, _unnested_piece)):
        return found
    return _replaced(layer, _ESCAPES, _escape_piece)


def _tool(data: memoryview):
    """What inflates the compressed stream that starts the data; None for anything else."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\0" else None


_FAULTS = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)


def _stream(tool, data: memoryview, size: int) -> Iterator[bytes]:
    """What the tool makes of the data, up to ``size`` bytes at a time, as far as it is without fault."""
    while not tool.eof:
        try:
            out = tool.decompress(data, size)
        except _FAULTS:
            return
        if not out:
            return
        yield out
        data = getattr(tool, "unconsumed_tail", b"")


@dataclass
class Opened:
    """What was under compressed layers: texts to unwrap further, kinds found in windows, streams cut by a window."""

    texts: list[str]
    kinds: set[int]
    n_cut: int = 0


def _search_windows(parts: Iterator[bytes], opened: Opened) -> None:
    """Search a long stream window by window; only one of them is held at a time."""
    tail = b""
    for part in parts:
        window = tail + part
        inner = _opened(window, True, True)
        opened.kinds |= inner.kinds
        opened.n_cut += inner.n_cut
        for text in inner.texts:
            _, spans, places = _search(text)
            opened.kinds |= {kind for _, _, kind in spans}
            opened.n_cut += len(places)
        tail = window[-SHARED:]


def _inflated(data: bytes, opened: Opened, windowed: bool) -> list[bytes]:
    """What is compressed in the data, streams that follow each other as one; long ones are searched at once."""
    found: list[bytes] = []
    view, at = memoryview(data), 0
    while match := _MAGIC.search(data, at):
        at, parts, room = match.start(), [], MOST_INFLATED
        while (tool := _tool(view[at:])) is not None:
            stream = _stream(tool, view[at:], MOST_INFLATED)
            part = next(stream, b"")
            after = next(stream, None) if part and not tool.eof else None
            if after is not None or len(part) > room:
                _search_windows(chain([*parts, part], [] if after is None else [after], stream), opened)
                parts, room = [], MOST_INFLATED
            elif tool.eof or len(part) >= LEAST_ASCII:
                parts.append(part)
                room -= len(part)
            if not tool.eof:
                # the rest of a window's last stream is beyond it
                opened.n_cut += windowed and len(part) >= SHARED
                break
            at = len(data) - len(tool.unused_data)
            while at < len(data) and not data[at]:  # padding between members
                at += 1
        if parts:
            found.append(b"".join(parts))
        at = max(at, match.start() + 1)
    return found


def _raw_deflate(data: bytes) -> list[bytes]:
    """The data inflated as deflate without a header, if that is readable to its end."""
    tool = zlib.decompressobj(-15)
    parts = list(islice(_stream(tool, memoryview(data), MOST_INFLATED), 1))
    return parts if tool.eof and parts and _readable(parts[0]) else []


def _readable(data: bytes) -> list[str]:
    texts = [data.decode("utf-8", "replace")] if _ASCII.search(data) else []
    if b"\0" in data:
        texts += [m.group().replace(b"\0", b"").decode() for m in _UTF16.finditer(data)]
    return texts


def _opened(data: bytes, itself: bool, windowed: bool = False) -> Opened:
    """Readable texts under any number of compressed layers, of the bytes ``itself`` too."""
    opened, waiting, seen = Opened([], set()), [data], set()
    while waiting:
        data = waiting.pop()
        mark = hashlib.sha256(data).digest()
        if mark in seen:  # data that inflate to themselves
            continue
        seen.add(mark)
        if itself or len(seen) > 1:
            opened.texts += _readable(data)
        waiting += _inflated(data, opened, windowed)
        if not windowed:
            waiting += _raw_deflate(data)
    return opened


def _from_base64(run: str) -> Iterator[tuple[int, bytes]]:
    """The bytes of a run decoded from each of its first four characters."""
    body = run.rstrip("=").translate(_STANDARD)
    for begin in range(4):
        part = body[begin:]
        part = part[: len(part) - (len(part) % 4 == 1)]  # one character is no byte
        if len(part) >= 22:
            yield begin, base64.b64decode(part + "=" * (-len(part) % 4))


def _encoded(text: str) -> Iterator[tuple[int, int, bytes, bool]]:
    """Start, end and bytes of all that may be base64, or of percent escapes, which are read in place unless compressed."""
    for match in _BASE64.finditer(text):
        for begin, data in _from_base64(match.group()):
            yield match.start() + begin, match.end(), data, True
    for match in _WRAPPED.finditer(text):
        for begin, data in _from_base64(_BREAKS.sub("", match.group())):
            begin = 0 if _BREAKS.search(match.group()[: begin + 1]) else begin
            yield match.start() + begin, match.end(), data, True
    if "%" in text:
        for match in _ESCAPED.finditer(text):
            if _PERCENT.search(match.group()):
                data = unquote_to_bytes(match.group())
                yield match.start(), match.end(), data, False
                if "+" in match.group():  # a space in forms
                    yield match.start(), match.end(), unquote_to_bytes(match.group().replace("+", " ")), False


def layers(text: str) -> Iterator[Layer | tuple[tuple[int, int], Opened]]:
    """The text and everything that can be unwrapped from it; also ranges that hold long compressed data, already searched."""
    queue, seen = deque([Layer(text)]), set()
    while queue:
        layer = queue.popleft()
        yield layer
        fresh = [_unescaped(layer)]
        for start, end, data, itself in _encoded(layer.text):
            opened = _opened(data, itself)
            place = layer.origin(start, end)
            if opened.kinds or opened.n_cut:
                yield place, opened
            fresh += [Layer(inner, whole=place) for inner in opened.texts]
        for new in fresh:
            if new is not None and new.text and (key := new.key()) not in seen:
                seen.add(key)
                queue.append(new)


def _search(text: str) -> tuple[list[Span], set[Span], set[tuple[int, int]]]:
    """Base spans, all spans, and ranges with data that could not be opened to their end."""
    base: list[Span] = []
    spans: set[Span] = set()
    unopened: set[tuple[int, int]] = set()
    for number, layer in enumerate(layers(text)):
        if not isinstance(layer, Layer):
            place, opened = layer
            spans.update((*place, kind) for kind in opened.kinds)
            if opened.n_cut:
                unopened.add(place)
            continue
        found = scan(layer.text)
        if number == 0:
            base = found
        spans.update((*layer.origin(start, end), kind) for start, end, kind in found)
    return base, spans, unopened


def find(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans (both by start, then kind), and how many ranges could not be opened to their end."""
    base, spans, unopened = _search(text)
    return base, sorted(spans, key=lambda s: (s[0], s[2], s[1])), len(unopened)


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every range replaced that holds a secret or could not be opened."""
    _, spans, unopened = _search(text)
    hidden = {(start, end) for start, end, _ in spans} | unopened
    parts, done = [], 0
    for start, end in sorted(hidden):
        if end <= done:
            continue
        parts += [text[done:start], mark] if start >= done else []
        done = end
    return "".join(parts) + text[done:] if hidden else text


def _columns(texts: list[str]) -> dict:
    made = [find(t) for t in texts]
    per_kind = [[sum(k == kind for _, _, k in base) for base, _, _ in made] for kind in range(3)]
    return {
        "n_assign": per_kind[0],
        "n_access": per_kind[1],
        "n_hex": per_kind[2],
        "base_sha256": [hashlib.sha256(as_text(base).encode()).hexdigest() for base, _, _ in made],
        "spans": [as_text(spans) for _, spans, _ in made],
        "n_unopened": [unopened for _, _, unopened in made],
    }


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    rows = documents.select("doc_id", text_column().alias("text"))
    added = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_unopened bigint"
    return map_texts(rows, _columns, added)


def without_secrets(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; secrets are replaced in the text, and ``n_chars``, if there, follows it."""
    rows = documents.withColumn("__null", F.col("text").isNull()).withColumn("text", text_column())
    made = map_texts(rows, lambda texts: {"__text": [redact(t, mark) for t in texts]}, "__text string")
    made = made.withColumn("text", F.when(~F.col("__null"), F.col("__text")))
    if "n_chars" in documents.columns:
        kind = dict(documents.dtypes)["n_chars"]
        changed = F.col("text").isNotNull() & F.col("__text").contains(mark)
        made = made.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return made.select(*documents.columns)
