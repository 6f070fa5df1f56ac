"""BPE encoding and decoding with a transducer lexicon.

The frequent pre-tokens of the corpus are compiled into a minimal acyclic transducer: states with equal right-hand sides
are shared, each arc carries the number of words that sort before it, and the sum along a word's path is its ordinal, which
leads to its ids. The automaton is one flat byte string; its size is bounded by ``lexicon_words``, so it is broadcast, and
each Python worker maps it into memory from an unlinked file. Words outside it are merged exactly by the ranks of the
vocabulary. Distinct units of text are remembered within a worker (a bounded memo), so neither is run twice for a word
that recurs. Decoding looks up each id's token and joins them.

Defined results: a null text is empty (no ids, empty decoding); special strings inside a text are single ids, as the
tokenizers library has it; null ids and repeated rows give rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, slices
from .tokens import WORD_SPECIAL, Memo, UnitIds, bpe, special_parts, word_pretokens, word_units

LEXICON_WORDS, MEMO_UNITS, COUNTED, TEXT_BYTES = 50_000, 300_000, 400_000, 8 << 20


# ---- the transducer ----------------------------------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words, built from sorted words by freezing each finished suffix."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final, ((label, target), ...)
    counts: list[int] = []  # words accepted from a state

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(int(key[0]) + sum(counts[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        for depth in range(len(last), common, -1):
            done = freeze(path.pop())
            path[-1][1].append((last[depth - 1], done))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        done = freeze(path.pop())
        path[-1][1].append((last[depth - 1], done))
    root = freeze(path[0])
    first, arcs = [0], []
    for final, out in states:
        skipped = int(final)
        for label, target in out:
            arcs += (label, target, skipped)
            skipped += counts[target]
        first.append(len(arcs) // 3)
    ids, at = [], [0]
    for word in words:
        ids += entries[word]
        at.append(len(ids))
    numbers = [*first, *(int(s[0]) for s in states), *arcs, *at, *ids]
    return struct.pack("<5I", root, len(states), len(arcs) // 3, len(words), len(ids)) + struct.pack(f"<{len(numbers)}I", *numbers)


class Lexicon:
    """The compiled automaton, mapped into memory."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = memoryview(self._map).cast("I")
        self.root, states, arcs, self.words, ids = numbers[:5]
        at = 5
        self.first = numbers[at : (at := at + states + 1)]
        self.final = numbers[at : (at := at + states)]
        self.arcs = numbers[at : (at := at + 3 * arcs)]
        self.starts = numbers[at : (at := at + self.words + 1)]
        self.ids = numbers[at : at + ids]

    def get(self, word: bytes) -> list[int] | None:
        state, ordinal, arcs, first = self.root, 0, self.arcs, self.first
        for label in word:
            low, high = first[state], first[state + 1]
            while low < high:
                mid = (low + high) >> 1
                if arcs[3 * mid] < label:
                    low = mid + 1
                else:
                    high = mid
            if low == first[state + 1] or arcs[3 * low] != label:
                return None
            state, ordinal = arcs[3 * low + 1], ordinal + arcs[3 * low + 2]
        if not word or not self.final[state]:
            return None
        return list(self.ids[self.starts[ordinal] : self.starts[ordinal + 1]])


@lru_cache(maxsize=1)
def _lexicon(blob: bytes) -> Lexicon:
    return Lexicon(blob)


# ---- corpus side -------------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, share: float = 2e-6) -> list[bytes]:
    """The most frequent pre-tokens of all texts, at most ``most``. A task counts all its words and reports those that may
    make up ``share`` of them: where it holds over ``COUNTED`` distinct words it forgets the rarest half and adds the
    greatest count that was forgotten to ``lost``, so a word's true count is at most its count plus ``lost``, and no word with
    that share of the corpus is missed (it has the share in some task)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = lost = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                units = (text or "").split()
                total += len(units)
                seen.update(units)
            if len(seen) > COUNTED:
                kept = seen.most_common()
                lost += kept[COUNTED // 2][1]
                seen = Counter(dict(kept[: COUNTED // 2]))
        words: Counter[bytes] = Counter()
        for unit, n in seen.items():
            if n + lost >= max(2, share * total):
                for word in word_pretokens(unit):
                    words[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, schema("word binary, n long"))
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [bytes(r.word) for r in top.collect()]


def lexicon_for(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> bytes:
    model = bpe(path)
    return compile_lexicon({w: model.encode(w) for w in frequent_words(docs, most)})


class Codec:
    """Encoder of whole texts into ids, and decoder of ids."""

    def __init__(self, path: str, lexicon: Lexicon | None, most: int = MEMO_UNITS):
        self.model, self.lexicon = bpe(path), lexicon
        self.words = Memo(self._word, most)
        self.units = UnitIds(self._make, self._whole, True, 2 * most)
        size = max(self.model.tokens) + 1
        self.numbers = pa.array(map(str, range(size)), pa.string())
        self.tokens = pa.array([self.model.tokens.get(i, "") for i in range(size)], pa.string())

    def _word(self, word: bytes) -> list[int]:
        found = self.lexicon.get(word) if self.lexicon else None
        return self.model.encode(word) if found is None else found

    def ids(self, unit: str) -> list[int]:
        return [i for word in word_pretokens(unit) for i in self.words[word]]

    def _make(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self.ids(u) for u in units]
        return np.asarray([i for x in made for i in x], np.uint32), np.asarray([len(x) for x in made], np.int64)

    def _whole(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for i, part in enumerate(special_parts(text, WORD_SPECIAL)):
            ids += [self.model.special[part]] if i % 2 else [x for unit in word_units(part) for x in self.ids(unit)]
        return np.asarray(ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        return self.units.encode(texts)

    def _joined(self, names: pa.Array, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), names.take(pa.array(ids))), " ")

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts that the ids stand for: their tokens, special ones included, with a space between them."""
        return self._joined(self.tokens, ids, first)

    def decimal(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        return self._joined(self.numbers, ids, first)


def _digests(texts: pa.Array) -> pa.Array:
    """SHA-256 of each text's bytes, in lowercase hex."""
    at, held = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist(), memoryview(texts.buffers()[2] or b"")
    return pa.array([hashlib.sha256(held[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, blob: bytes) -> Codec:
    key = (path, hash(blob))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(path, _lexicon(blob))
    return _codecs[key]


def _encoded(docs: DataFrame, path: str, lexicon_words: int, out: str, row) -> DataFrame:
    """``row(codec, ids, first)`` gives the columns behind doc_id of each slice of the texts."""
    lexicon = docs.sparkSession.sparkContext.broadcast(lexicon_for(docs, path, lexicon_words))
    names = [x.split(" ")[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, lexicon.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts], TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *row(own, *own.encode(texts[a:b]))], names)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, schema(out))


def encode_digest(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; the decoded text is made from the ids alone."""

    def row(own: Codec, ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.diff(first), pa.int64()), _digests(own.decimal(ids, first)), _digests(own.decode(ids, first))]

    return _encoded(docs, path, lexicon_words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def encode_documents(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids array<int> of every document."""

    def row(own: Codec, ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))]

    return _encoded(docs, path, lexicon_words, "doc_id long, ids array<int>", row)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded string of documents of ids (doc_id, ids array<int>); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, compile_lexicon({}))
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own.decode(np.asarray([i for x in lists for i in x], np.uint32), first)], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema("doc_id long, decoded string"))
