"""Terms of texts: maximal runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII, as 64-bit hashes.

All bytes of a character beyond ASCII are term bytes, so UTF-8 is read byte by byte. Two terms count as equal if their
hashes are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import _BYTE, BASES, SLICE_BYTES, Rolling, mix, powers

_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x30:0x3A] = _IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_VALUE = _BYTE.copy()
_VALUE[0x41:0x5B] = _BYTE[0x61:0x7B]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset at which each text begins, and the end; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def _long(word: np.ndarray) -> np.uint64:
    """The hash of one word of any length, in bounded memory; the same as Rolling's."""
    total = np.zeros(1, np.uint64)
    up, _ = powers(BASES[0]).get(SLICE_BYTES)
    for at in range(0, len(word), SLICE_BYTES):
        part = word[at : at + SLICE_BYTES]
        total += (_VALUE[part] * up[: len(part)]).sum(keepdims=True) * np.uint64(pow(BASES[0], at, 2**64))
    return mix(total + np.uint64(len(word)))[0]


class Terms:
    """The terms of several texts: hashes in ``hash``, those of text i at ``first[i]:first[i + 1]``."""

    def __init__(self, held: np.ndarray, bounds: np.ndarray):
        n = len(held)
        inside = _IN_TERM[held]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        cuts = bounds[(bounds > 0) & (bounds < n)]
        begin[cuts] = inside[cuts]
        stop[cuts - 1] = inside[cuts - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.hash = np.empty(len(s), np.uint64)
        i = 0
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE_BYTES, "right")))
            low, high = s[i], e[j - 1]
            if high - low > SLICE_BYTES:
                self.hash[i] = _long(held[low:high])
            else:
                self.hash[i:j] = Rolling(_VALUE[held[low:high]]).of(s[i:j] - low, e[i:j] - low)
            i = j
        self.first = np.searchsorted(s, bounds)


def sliced(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 15) -> Iterator[tuple[int, int, Terms]]:
    """The terms of a string column in slices of about ``most`` bytes (a longer text is a slice of its own) and at most
    ``rows`` texts: first row, end row, terms."""
    held, bounds = utf8(column)
    at, n = 0, len(column)
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1), at + rows, n)
        yield at, end, Terms(held[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end
