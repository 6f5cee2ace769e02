"""Secret scan with a recursive decoding worklist.

A text is layer 0. Percent escapes (with a plus for a blank too), ``\\u`` escapes, base64 runs (wrapped or glued to other
letters too) and compressed bytes inside base64 or escapes each open a new layer that is scanned like the first and unwrapped in turn, until no new layer appears;
compressed bytes are unpacked until they are compressed no more. A layer whose content was seen
before in the same text is not opened again, so cycles end. Every layer keeps, for each of its characters, the range of
the original text that it came from; a find in a layer is reported at that range.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing

KINDS = ("assign", "access", "hex")

# Fixed patterns of the three kinds, and the least lengths that count.
_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\u\{[0-9A-Fa-f]{1,6}\})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})+")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_QUOTED = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)(?:%01|%5[eE]|\^|%9[cC]|%[dD][aA])|(?:B|%42)(?:Z|%5[aA])(?:h|%68)|%[fF][dD](?:7|%37)(?:z|%7[aA]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])*")
_LITERAL = re.compile(r"""(?:\\x1[fF]\\x8[bB]|(?:x|\\x78)(?:\\x01|\\x5[eE]|\^|\\x9[cC]|\\x[dD][aA])|(?:B|\\x42)(?:Z|\\x5[aA])(?:h|\\x68)|\\x[fF][dD](?:7|\\x37)(?:z|\\x7[aA]))(?:\\x[0-9A-Fa-f]{2}|\\[nrt'"\\0]|[\x20-\x21\x23-\x26\x28-\x5b\x5d-\x7e])*""")
_CONTROL = bytes(c for c in (*range(32), 127) if c not in (9, 10, 13))
_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ")
#: A compressed layer that unpacks to more bytes than this is counted in ``oversized`` and scanned as a stream of chunks
#: (bytes, each with the last OVERLAP bytes of the one before it); every chunk is a layer.
MAX_UNPACKED, PIECE, CHUNK, OVERLAP = 64 << 20, 1 << 20, 8 << 20, 1 << 20

#: How base64 of compressed bytes begins: where it is glued to other letters, it is tried from there.
_HEADS = re.compile("H4sI|Qlpo|/Td6WF|eAE|eF4|eJ[w-z]|eN[o-r]")

Span = tuple[int, int, int]


def find(text: str) -> list[Span]:
    """(start, kind index, end) of the three kinds, leftmost and non-overlapping in each, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _unescape(run: str) -> str:
    if run[0] == "%":
        return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")
    if run[1] == "x":
        return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
    character = lambda code: chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    if run[1] == "U":
        return character(int(run[2:], 16))
    if run[2] == "{":
        return "".join(character(int(x, 16)) for x in re.findall(r"\{(\w+)", run))
    units = b"".join(int(x, 16).to_bytes(2, "big") for x in run.split("\\u")[1:])
    return units.decode("utf-16-be", "replace")


def _opener(data: bytes):
    """What makes a decompressor for gzip, zlib, bzip2 or xz bytes; None where the data is none of these."""
    makers = [lambda: zlib.decompressobj(31)] + [zlib.decompressobj] * 4 + [bz2.BZ2Decompressor, lzma.LZMADecompressor]
    for magic, make in zip(_MAGIC, makers, strict=True):
        if data.startswith(magic):
            try:
                make().decompress(data, 1)
            except _BROKEN:
                return None
            return make
    return None


def _inflated(chunks: Iterator[bytes], make) -> Iterator[bytes]:
    """Pieces of the content of all members; ends where the data does not go on as such."""
    box = make()
    for data in chunks:
        while data or not box.eof:
            try:
                out = box.decompress(data, PIECE)
            except _BROKEN:
                return
            if out:
                yield out
            if box.eof:
                data, box = box.unused_data.lstrip(b"\0"), make()
                if not data:
                    break
                continue
            data = getattr(box, "unconsumed_tail", b"")
            if not (data or len(out) == PIECE if hasattr(box, "unconsumed_tail") else not box.needs_input):
                break


def _readable(data: bytes, whole: bool = True) -> str | None:
    """Decoded bytes as a text, if they are UTF-8 with hardly any control characters; a cut piece may begin or end inside a character."""
    if not whole:
        data = data[next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0) :]
    try:
        text = data.decode("utf-8") if whole else codecs.getincrementaldecoder("utf-8")().decode(data)
    except UnicodeDecodeError:
        return None
    odd = len(data) - len(data.translate(None, _CONTROL))
    return text if data and odd * 20 <= len(data) else None


def _readable_otherwise(data: bytes) -> str | None:
    """Bytes as UTF-16 or Latin-1 text: with a mark or zero bytes in every other place, or printable and nearly all ASCII."""
    zeros = [data[k::2].count(0) * 10 >= len(data) * 3 for k in (0, 1)]
    kind = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-be" if zeros[0] and not zeros[1] else "utf-16-le" if zeros[1] and not zeros[0] else None
    if kind and len(data) % 2 == 0:
        try:
            text = data.decode(kind)
        except UnicodeDecodeError:
            return None
        return text if text and sum(c < " " and c not in "\t\r\n" for c in text) * 20 <= len(text) else None
    plain = len(data.translate(None, _CONTROL)) == len(data) and not any(0x80 <= b < 0xA0 for b in data)
    return data.decode("latin-1") if len(data) >= 16 and plain and sum(b < 0x80 for b in data) * 10 >= 9 * len(data) else None


def _deflated(data: bytes) -> str | None:
    """The readable content of a raw deflate stream that the bytes are, whole and without rest; of more than MAX_UNPACKED bytes it stays closed."""
    box = zlib.decompressobj(-15)
    try:
        out = box.decompress(data, MAX_UNPACKED)
    except zlib.error:
        return None
    return _readable(out) if box.eof and not box.unused_data and len(out) >= 8 else None


def _streamed(pieces: Iterator[bytes]) -> Iterator[str]:
    """Readable overlapping chunks of a stream of bytes, unpacked for as long as it is compressed."""
    while True:
        head = next(pieces, b"")
        pieces = itertools.chain([head], pieces)
        make = _opener(head)
        if make is None:
            break
        pieces = _inflated(pieces, make)
    kept, new = b"", False
    for piece in pieces:
        kept, new = kept + piece, True
        if len(kept) >= CHUNK:
            if text := _readable(kept, False):
                yield text
            kept, new = kept[-OVERLAP:], False
    if new and (text := _readable(kept, False)):
        yield text


def _texts(data: bytes, most: int) -> tuple[Iterator[str], bool, bool]:
    """The readable text that bytes unwrap to, in chunks if it is large; if they were compressed, and if it is large."""
    seen: set[bytes] = set()
    packed = False
    while make := _opener(data):
        key = hashlib.sha1(data).digest()
        if key in seen:
            return iter(()), True, False
        seen.add(key)
        out, size, pieces = [], 0, _inflated(iter([data]), make)
        for piece in pieces:
            out.append(piece)
            size += len(piece)
            if size > most:
                return _streamed(itertools.chain(out, pieces)), True, True
        if not size:
            break
        data, packed = b"".join(out), True
    text = _readable(data)
    if text is None:  # its characters have no fixed places in the run, as those of compressed bytes
        text, packed = _deflated(data) or _readable_otherwise(data), True
    return iter([text] if text else []), packed, False


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs with the places of their characters: those of one line, and lines of one width with the shorter one that ends them."""
    for m in _BASE64.finditer(text):
        yield m.group(), np.arange(m.start(), m.end())
    for m in _WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m.group())]
        i = 0
        while i < len(lines):
            width, j = lines[i][1] - lines[i][0], i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            ends = [k for k in (j + 1, j) if i + 1 < k <= len(lines) and (k == j or lines[j][1] - lines[j][0] < width)]
            for k in ends:
                at = np.concatenate([np.arange(a, b) for a, b in lines[i:k]])
                yield "".join(text[a:b] for a, b in lines[i:k]), at
            i = j


def _base64_parts(run: str, most: int) -> Iterator[tuple[int, int, Iterator[str], bool, bool]]:
    """Each part of a base64 run, first the whole, that decodes to a readable text or to compressed bytes, and lies in none before it."""
    tried = [(0, len(run))]
    if re.search("[+/_-]", run):
        tried += [m.span() for m in re.finditer(r"[A-Za-z0-9]{16,}={0,2}", run)]
        tried += [m.span() for m in re.finditer(r"(?<=[/_-])[A-Za-z0-9+]{16,}={0,2}", run)]
    tried += [(m.start(), len(run)) for m in _HEADS.finditer(run)] + [(k, len(run)) for k in (1, 2, 3) if len(run) - k >= 16]
    done: list[tuple[int, int]] = []
    for a, b in dict.fromkeys(tried):
        body = run[a:b].rstrip("=").translate(str.maketrans("-_", "+/"))
        if len(body) % 4 == 1 or any(x <= a and b <= y for x, y in done):
            continue
        try:
            data = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        texts, packed, large = _texts(data, most)
        first = next(texts, None)
        if first is not None or large:
            done.append((a, b))
            yield a, b, itertools.chain([first] if first is not None else [], texts), packed, large


def _bytes_runs(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Runs with escapes that stand for compressed bytes, whether all or only some of their bytes are escaped."""
    for m in _QUOTED.finditer(text) if "%" in text else ():
        yield m.start(), m.end(), unquote_to_bytes(m.group())
    for m in _LITERAL.finditer(text) if "\\x" in text else ():
        try:
            yield m.start(), m.end(), codecs.escape_decode(m.group().encode("latin-1"))[0]
        except ValueError:
            continue


class _Layer:
    """A text and, for each of its characters, the range of the original it stands for (None: itself)."""

    __slots__ = ("text", "first", "last")

    def __init__(self, text: str, first: np.ndarray | None, last: np.ndarray | None):
        self.text, self.first, self.last = text, first, last

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.first is None else (int(self.first[start:end].min()), int(self.last[start:end].max()))

    def replaced(self, cuts: list[tuple[int, int, str]]) -> _Layer:
        """The layer with each cut [a, b) replaced by a text whose characters all stand for the cut."""
        n = len(self.text)
        first = np.arange(n) if self.first is None else self.first
        last = np.arange(1, n + 1) if self.last is None else self.last
        texts, firsts, lasts, at = [], [], [], 0
        for a, b, new in [*cuts, (n, n, "")]:
            texts += [self.text[at:a], new]
            firsts += [first[at:a], np.full(len(new), first[a:b].min() if b > a else 0)]
            lasts += [last[at:a], np.full(len(new), last[a:b].max() if b > a else 0)]
            at = b
        return _Layer("".join(texts), np.concatenate(firsts), np.concatenate(lasts))


def _grouped(text: str, first: np.ndarray, last: np.ndarray) -> _Layer:
    """The layer of a base64 part's text: each character stands for the groups of four that hold its bytes."""
    size = np.fromiter((1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) for c in map(ord, text)), np.int64, len(text))
    end = np.cumsum(size)
    a, b = (end - size) // 3 * 4, np.minimum((end - 1) // 3 * 4 + 3, len(last) - 1)
    return _Layer(text, first[a], last[b])


def scan(text: str | None, max_unpacked: int = MAX_UNPACKED) -> tuple[list[Span], list[Span], int, int]:
    """Base spans of the text, spans that only decoded layers show, number of layers opened, number of oversized ones."""
    text = text or ""
    base = find(text)
    if "%" not in text and "\\" not in text and not _BASE64.search(text):
        return base, [], 0, 0
    seen, more, opened, large = {hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest()}, set(), 0, 0

    def children(layer: _Layer) -> Iterator[_Layer]:
        nonlocal large
        escapes = [(m.start(), m.end(), _unescape(m.group())) for m in _ESCAPE.finditer(layer.text)]
        if escapes:
            yield layer.replaced(escapes)
            if "+" in layer.text and "%" in layer.text:
                blanks = [(m.start(), m.end(), " ") for m in re.finditer(r"\+", layer.text)]
                yield layer.replaced(sorted(escapes + blanks))
        for a, b, data in _bytes_runs(layer.text):
            texts, packed, over = _texts(data, max_unpacked)
            large += over
            a, b = layer.origin(a, b)
            for inner in texts if packed else ():
                yield _Layer(inner, np.full(len(inner), a), np.full(len(inner), b))
        for run, at in _runs(layer.text):
            first = at if layer.first is None else layer.first[at]
            last = at + 1 if layer.last is None else layer.last[at]
            for a, b, texts, packed, over in _base64_parts(run, max_unpacked):
                large += over
                for inner in texts:
                    if packed:
                        yield _Layer(inner, np.full(len(inner), first[a:b].min()), np.full(len(inner), last[a:b].max()))
                    else:
                        yield _grouped(inner, first[a:b], last[a:b])

    work = [children(_Layer(text, None, None))]
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
            continue
        key = hashlib.sha1(child.text.encode("utf-8", "surrogatepass")).digest()
        if key in seen:
            continue
        seen.add(key)
        opened += 1
        for start, kind, end in find(child.text):
            a, b = child.origin(start, end)
            more.add((a, kind, b))
        work.append(children(child))
    return base, sorted(more - set(base)), opened, large


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """One row for each row of ``docs``: key, base and added (arrays of start, kind, end), layers, oversized.

    Positions are code points, end exclusive. ``base`` holds what the patterns find in the text itself, ``added`` what
    they find in decoded layers, at the range of the original that was decoded; a range that ``base`` has already is
    not repeated. A null or empty text gives empty arrays. Repeated rows are scanned each. Other columns are not read.
    No shuffle: every text is scanned where it was read. A compressed layer of more than ``max_unpacked`` bytes is
    counted in ``oversized`` and scanned chunk by chunk, so that one row cannot fill a worker's memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]
        for rows in batches:
            for i in range(0, len(rows), 1000):
                part = rows.iloc[i : i + 1000]
                found = [scan(t, max_unpacked) for t in part.text_]
                yield pd.DataFrame({"key_": part.key_.array, "base": [as_rows(x[0]) for x in found], "added": [as_rows(x[1]) for x in found], "layers": [x[2] for x in found], "oversized": [x[3] for x in found]})

    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<start:bigint,kind:string,end:bigint>>"
    out = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    out = out.mapInPandas(freeing(run), f"key_ {kind}, base {spans}, added {spans}, layers bigint, oversized bigint")
    return out.withColumnRenamed("key_", key)


def listed(spans: str | list, kinds: tuple[str, ...] = KINDS):
    """The spans of an array column as ``kind:start:end``, by start, then kind as listed, comma-joined."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    rank = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
