"""Token counts by prefix dynamic programming over byte-level BPE.

For each position of a pre-token the last token of the exact encoding of the prefix that ends there is found: it is the
one vocabulary item that ends there and may follow the last token of the prefix before it (two tokens may stand side by
side when merging their joined bytes gives just these two). The count at a position is one more than the count where that
token begins. So every prefix has its exact count, and questions of truncation and budget are looked up, not encoded.

Defined results: a null text is empty (0 bytes, 0 tokens); special strings inside texts are single tokens, as the
tokenizers library has it; null ids and repeated rows give rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema
from .tokens import BYTE_PATTERN, BYTE_SPECIAL, WS, Bpe, Memo, bpe, byte_letters, byte_units, fine_units, special_parts

LIMIT, MEMO_UNITS = 1024, 600_000
#: The white space of the pattern, as characters.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if regex.fullmatch(f"[{WS}]", c))


class PrefixCounter:
    """Exact counts at every prefix, for a byte-level vocabulary without word ends."""

    def __init__(self, model: Bpe, most: int = MEMO_UNITS):
        self.model = model
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.ids = {bytes(byte_of[c] for c in token): i for token, i in model.vocab.items() if token not in model.special}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units = Memo(self._count, most)
        self.words = Memo(lambda w: self.prefixes(w)[-1], most)

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.model.encode(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def prefixes(self, piece: bytes) -> list[int]:
        """Counts of the prefixes of one pre-token, from the empty one on; one value a byte."""
        counts, last = [0], [-1]
        get, known, longest = self.ids.get, self.pairs.get, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(piece[start:end])
                if token is None:
                    continue
                fits = known((last[start], token))
                if fits is None:
                    fits = self.fits(last[start], token) if start else self._alone(token)
                if fits:
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def _alone(self, token: int) -> bool:
        """Whether the bytes of a token are merged into it when they stand alone."""
        key = (-1, token)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.model.encode(self.bytes[token]) == [token]
        return known

    def _count(self, unit: str) -> int:
        return sum(self.words[w.encode()] for w in BYTE_PATTERN.findall(unit))

    def plain(self, text: str) -> int:
        """Tokens of a text whose special strings are ordinary text."""
        return sum(map(self.units.__getitem__, byte_units(text)))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        parts = special_parts(text, BYTE_SPECIAL)
        return len(parts) // 2 + sum(map(self.plain, parts[::2]))

    def table(self, text: str) -> np.ndarray:
        """Token count of every prefix of the text by code points, the empty one first."""
        out, tail, before = [0], "", 0  # tail: the last unit so far, before: tokens ahead of it
        for k, part in enumerate(special_parts(text, BYTE_SPECIAL)):
            if k % 2:  # short of its last letter, a special string is ordinary text
                out += [before + self.plain(tail + part[:i]) for i in range(1, len(part))] + [out[-1] + 1]
                tail, before = "", out[-1]
                continue
            run, ahead, base = "", 0, out[-1]  # run: white space at the end so far, ahead: tokens before it
            for unit in fine_units(part):
                tail, before, lead = unit, base, len(unit) - len(unit.lstrip(_BLANKS))
                body = unit.rstrip(_BLANKS) if lead < len(unit) else ""
                if not body:  # white space only: the beginning of a text
                    out += [base + c for c in self._word(unit)]
                    run, ahead, base = unit, base, out[-1]
                    continue
                own, total = [], 0
                for word in BYTE_PATTERN.findall(body):
                    own += [base + total + c for c in self._word(word)]
                    total = own[-1] - base
                if lead:  # alone, the blank in front joins the white space before it
                    own[0] = ahead + self.words[(run + unit[0]).encode()] if run else base + self.words[unit[0].encode()]
                out += own
                run, ahead = unit[len(body) :], base + total
                out += [ahead + c for c in self._word(run)] if run else []
                base = out[-1]
        return np.asarray(out, np.int64)

    def _word(self, word: str) -> list[int]:
        """Counts of the prefixes of a pre-token by code points, without the empty one."""
        if word[0] == "'" and len(word) > 1 and word[1:].isalpha():  # a contraction that is cut is no contraction
            return [*(self.plain(word[:i]) for i in range(1, len(word))), self.words[word.encode()]]
        counts, at, out = self.prefixes(word.encode()), 0, []
        for c in word:
            at += len(c.encode())
            out.append(counts[at])
        return out


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(bpe(path))


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count_digest(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, counts = [len(t.encode()) for t in texts], [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return _base(docs).mapInArrow(run, schema("doc_id long, n_bytes long, n_tokens long, over_limit boolean"))


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, counts binary: the table of each document as little-endian 32-bit integers, one a code-point prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            tables = [own.table(t or "").astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tables, pa.binary())], ["doc_id", "counts"])

    return _base(docs).mapInArrow(run, schema("doc_id long, counts binary"))


def longest_prefix(counts: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens, from a stored table."""
    return int(np.flatnonzero(np.frombuffer(counts, "<u4") <= budget)[-1])
