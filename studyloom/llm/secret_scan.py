"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands, and then its encoded regions are unwrapped: URL escapes, Unicode and character-reference
escapes, base64 (standard and URL alphabet, at any of the four phases of a run, in one line or wrapped over lines) and what
any of them holds compressed (gzip, zlib, bzip2, xz, zstandard, all members; of a damaged stream what comes before the
fault). Decoded bytes stand for themselves, whatever they are: the rules know ASCII only. Every decoded layer goes on the worklist, is scanned by the same rules and unwrapped in turn, until nothing new appears; layers
seen before are not scanned again (cycle detection). Each character of a layer knows the stretch of the original text it
comes from, so a secret found in a layer is reported as the stretch of the original that encodes it: exact for escapes and
base64, the whole region where it was compressed.

Base rules, on the text itself: assignments (name, separator, value of 8 or more), access keys (16 or more) and hexadecimal
runs (32 or more). The layers add spans to these and take none away.

Defined results: a null text is empty (no spans); rows of a null doc_id and repeated rows give rows of their own; an empty
table gives an empty result; other columns are ignored or carried along. A compressed stream is inflated and scanned in
overlapping chunks, and a chunk like one seen before is not scanned again. Only a bomb, a stream that grows beyond
``MOST_BYTES`` and more than ``BOMB`` times, is left as it is.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import recounted, schema

KINDS = ("assign", "access", "hex")
MOST_BYTES, BOMB = 64 << 20, 500
#: Bytes of a stream that are scanned at once, and those that two chunks share; bytes fed to a codec at once.
CHUNK, OVERLAP, STEP = MOST_BYTES // 16, 64 << 10, 64
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_NAMES = re.compile(r"(?i:passw|secret|token|api_?key)", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_TOKEN = re.compile(r"[^\s\"'<>]+")
_ESCAPE = re.compile(r"((?:\\u[0-9A-Fa-f]{4})+)|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|(&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
#: A run of escaped bytes, or a percent sign that was escaped four times or more, which is unwrapped in one step.
_PERCENT = re.compile(r"%((?:25){4,}+)|(?:%(?!(?:25){4})[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = r"[\x20\t]*+(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+)+"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)++", re.A)
_RUN = re.compile(r"(?<!\\)[A-Za-z0-9+/_-]+|(?<=\\n)[A-Za-z0-9+/_-]+")
_STREAM = re.compile("\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\\(\xb5/\xfd")
_BYTES = re.compile("[\0-\xff]*")
_LITERAL = re.compile(r"(?:\\x1[fF]\\x8[bB]|x(?:\\x01|\^|\\x9[cC]|\\x[dD][aA])|BZh[1-9]|\\x[fF][dD]7zXZ\\x00|\(\\x[bB]5/\\x[fF][dD])(?:\\.|[^\\\n])*")
_LITERALS = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'\"])|([^\\])|\\")
_LETTERS = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules on one text."""
    out = []
    if _NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- layers ------------------------------------------------------------------------------------------------------------


class Layer:
    """A text and the stretch of the original that a stretch of it comes from (None: it is the original)."""

    def __init__(self, text: str, where: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.where = text, where

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.where is None else self.where(start, end)


def _pieces(layer: Layer, at: int, pieces: list[tuple[str, int, int]]) -> Layer:
    """A layer of pieces (text, start, end within the parent's region that begins at ``at``); a piece as long as its
    stretch is mapped letter by letter."""
    text, starts, ends = [], [], []
    for piece, a, b in pieces:
        text.append(piece)
        one = len(piece) == b - a
        for i in range(len(piece)):
            s, e = layer.origin(at + a + i, at + a + i + 1) if one else layer.origin(at + a, at + b)
            starts.append(s)
            ends.append(e)
    return Layer("".join(text), lambda start, end: (starts[start], max(ends[start:end])))


def _url(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    for m in _TOKEN.finditer(layer.text):
        region, at, pieces = m[0], 0, []
        if not _PERCENT.search(region):
            continue
        for p in _PERCENT.finditer(region):
            pieces.append((region[at : p.start()], at, p.start()))
            raw = b"" if p[1] else bytes.fromhex(p[0].replace("%", ""))
            if p[1]:
                pieces.append(("%", p.start(), p.end()))
            pieces += [(chr(c), p.start() + 3 * i, p.start() + 3 * i + 3) for i, c in enumerate(raw)]
            at = p.end()
        pieces.append((region[at:], at, len(region)))
        yield _pieces(layer, m.start(), pieces)


def _escapes(layer: Layer) -> Iterator[Layer]:
    if "\\u" not in layer.text and "\\x" not in layer.text and "&#" not in layer.text:
        return
    for m in _TOKEN.finditer(layer.text):
        region, at, pieces = m[0], 0, []
        if not _ESCAPE.search(region):
            continue
        for p in _ESCAPE.finditer(region):
            pieces.append((region[at : p.start()], at, p.start()))
            if p[1]:
                units = b"".join(int(x, 16).to_bytes(2, "big") for x in p[1].split("\\u")[1:])
                decoded = units.decode("utf-16-be", "replace")
                place = p.start()
                for c in decoded:
                    width = 12 if ord(c) > 0xFFFF else 6
                    pieces.append((c, place, min(place + width, p.end())))
                    place += width
            else:
                number = int(p[2] or p[3], 16) if p[2] or p[3] else int(p[4][3:-1], 16) if p[4][2] in "xX" else int(p[4][2:-1])
                c = chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else "�"
                pieces.append((c, p.start(), p.end()))
            at = p.end()
        pieces.append((region[at:], at, len(region)))
        yield _pieces(layer, m.start(), pieces)


def _decompressor(raw: memoryview):
    """What inflates a stream that begins with these bytes, None if it is none."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _inflated(raw: memoryview) -> Iterator[tuple[bytes, int]]:
    """The content of a compressed stream and of the members behind it in pieces, each with the number of bytes used up;
    of a damaged or cut stream what comes before the fault."""
    at = 0
    while (d := _decompressor(raw[at : at + 8])) is not None:
        bounded = hasattr(d, "needs_input")
        while not d.eof and at < len(raw):
            piece = raw[at : at + STEP]
            at += len(piece)
            while True:
                try:
                    part = d.decompress(piece, CHUNK) if bounded else d.decompress(piece)
                except Exception:  # noqa: BLE001  whatever a codec says of bytes that only look compressed
                    return
                used = at - len(d.unused_data) if d.eof else at
                if part or d.eof:
                    yield part, used
                if d.eof or not bounded or d.needs_input:
                    break
                piece = b""
        if not d.eof:
            return
        at -= len(d.unused_data)


def _chunks(raw: memoryview) -> Iterator[str]:
    """The content of a stream in overlapping chunks."""
    held, size = [], 0
    for part, _ in _inflated(raw):
        held.append(part)
        size += len(part)
        if size >= CHUNK:
            whole = b"".join(held)
            yield whole.decode("latin-1")
            held, size = [whole[-OVERLAP:]], OVERLAP
    yield b"".join(held).decode("latin-1")


def _streams(layer: Layer) -> Iterator[Layer]:
    """What the layer holds compressed, from wherever a stream may begin."""
    first = end = 0
    run = memoryview(b"")
    for m in _STREAM.finditer(layer.text):
        if m.start() >= end:
            held = _BYTES.match(layer.text, m.start())
            first, end, run = m.start(), held.end(), memoryview(held[0].encode("latin-1"))
        raw = run[m.start() - first :]
        size = used = 0
        for part, used in _inflated(raw):  # noqa: B007  only its end counts
            size += len(part)
        if size and not (size > MOST_BYTES and size > BOMB * used):
            whole = layer.origin(m.start(), m.start() + used)
            for text in _chunks(raw):
                yield Layer(text, lambda start, end, whole=whole: whole)


def _literals(layer: Layer) -> Iterator[Layer]:
    """Compressed bytes as a literal spells them, some escaped and some as letters."""
    if "\\x" not in layer.text:
        return
    for m in _LITERAL.finditer(layer.text):
        pieces = [(chr(int(p[1], 16)) if p[1] else _LETTERS.get(p[2], p[2]) if p[2] else p[0], p.start(), p.end()) for p in _LITERALS.finditer(m[0])]
        yield _pieces(layer, m.start(), pieces)


def _bases(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        yield from _phases(layer, [(m.start(), m[0].rstrip("="))])
    if "\n" in layer.text or "\\n" in layer.text:
        for m in _WRAPPED.finditer(layer.text):
            runs = [(m.start() + r.start(), r[0]) for r in _RUN.finditer(re.sub(r"\\[rn]", "\n\n", m[0]))]
            if sum(len(r) for _, r in runs) >= 16:
                yield from _phases(layer, runs)


def _phases(layer: Layer, runs: list[tuple[int, str]]) -> Iterator[Layer]:
    """The bytes of the runs (place, letters) joined, begun at each of four letters."""
    word = "".join(r for _, r in runs).replace("-", "+").replace("_", "/")
    firsts = [0]
    for _, r in runs[:-1]:
        firsts.append(firsts[-1] + len(r))

    def place(letter: int) -> int:
        k = bisect.bisect_right(firsts, letter) - 1
        return runs[k][0] + letter - firsts[k]

    for phase in range(4):
        part = word[phase:]
        if len(part) % 4 == 1:
            part = part[:-1]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))

        def where(start: int, end: int, phase: int = phase) -> tuple[int, int]:
            return layer.origin(place(phase + start * 4 // 3), place(min(phase - (-end * 4 // 3), len(word)) - 1) + 1)

        yield Layer(raw.decode("latin-1"), where)


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    for unwrap in (_url, _escapes, _literals, _bases, _streams):
        yield from unwrap(layer)


def all_spans(text: str, base: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    """The spans of the text and of all its layers, in places of the text."""
    found = list(base_spans(text) if base is None else base)
    work, seen = [(text, _unwrapped(Layer(text)))], set()
    while work:
        outer, layers = work[-1]
        inner = next(layers, None)
        if inner is None:
            work.pop()
            continue
        if not inner.text or inner.text == outer:
            continue
        key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), inner.origin(0, len(inner.text)))
        if key in seen:
            continue
        seen.add(key)
        for s, e, kind in base_spans(inner.text):
            found.append((*inner.origin(s, e), kind))
        work.append((inner.text, _unwrapped(inner)))
    return ordered(found)


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# ---- tables ------------------------------------------------------------------------------------------------------------


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            kinds = [s[2] for s in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(_said(base).encode()).hexdigest(), _said(all_spans(text or "", base))))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_digest, schema("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def masked(text: str) -> str:
    """The text with every secret, encoded ones included, replaced by a mark."""
    out, at = [], 0
    for s, e, _ in all_spans(text):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else masked(t) for t in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with their secrets masked; n_chars follows the text."""
    columns = docs.columns
    return recounted(docs.mapInArrow(_masks, docs.schema)).select(*columns)
