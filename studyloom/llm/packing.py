"""Lexical retrieval packing.

Documents are tokenized once, then ordered by an affinity, the smallest hash of their token trigrams, so that texts with
common passages come to lie near each other; ties, such as a large group of copies, are broken by text and id and may
spread over partitions. Consecutive runs of ``SHARD`` documents (fewer where they hold ``SHARD_IDS`` ids) are shards, each
with its own BM25 inverted index over token ids; document frequencies and mean length are those of all documents. A seed
document fills its window first; then the index returns the seed's unused neighbours in its shard by falling score, a score
being over all terms that both share, and they fill the window in turn; where the index has no more, the next unused
document in order follows. The document that crosses the end of a window is cut there, and its rest is the seed of the next
window, so every window is full. What a partition has left in the end becomes windows of power-of-two lengths, which need no
padding. A seed asks the shard it lies in and no other: to ask all shards would take work with the square of the corpus.

Defined results: a null text is empty and packs its end id alone; rows of a null doc_id are packed as well; repeated rows
are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_only, durable, given_back, schema, slices
from .tokens import library_units, spread

WINDOW, SHARD, SHARD_IDS, END_ID, TEXT_BYTES = 2048, 1024, 2 << 20, 1, 2 << 20
K1, B, DENSE = 1.2, 0.75, 24
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 over the token ids of a shard's documents, by all terms, with the document frequencies and the mean length of
    the whole corpus. Terms that many documents of the shard hold are scored by one matrix product for all seeds, the others
    by their postings."""

    def __init__(self, documents: list[np.ndarray], corpus: "Corpus"):
        n = len(documents)
        sizes = np.asarray([len(d) for d in documents], np.int64)
        doc = np.repeat(np.arange(n), sizes)
        pairs, tf = np.unique((np.concatenate(documents).astype(np.int64) << 32) | doc, return_counts=True)
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        terms, df = np.unique(term, return_counts=True)
        which = np.repeat(np.arange(len(terms)), df)
        weight = (corpus.idf(terms)[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / corpus.mean))).astype(np.float32)
        common = df > max(16, n // DENSE)
        at = np.flatnonzero(common[which])
        column = np.cumsum(common) - 1
        dense = np.zeros((n, int(common.sum())), np.float32)
        dense[doc[at], column[which[at]]] = weight[at]
        self.dense, self.held = dense, dense > 0
        some = np.flatnonzero(~common[which] & (df[which] > 1))
        self.doc, self.weight = doc[some], weight[some]
        own = which[some]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        self.first, self.count = starts, np.diff(np.append(starts, len(own)))
        order = np.argsort(self.doc, kind="stable")
        self.query = np.repeat(np.arange(len(starts)), self.count)[order]
        self.at = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties in order."""
        score = self.dense @ self.held[seed].astype(np.float32)
        terms = self.query[self.at[seed] : self.at[seed + 1]]
        if len(terms):
            places = spread(self.first[terms], self.count[terms])
            score += np.bincount(self.doc[places], self.weight[places], minlength=self.n).astype(np.float32)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


class Corpus:
    """What BM25 needs to know of all documents: in how many each term is, how many there are and their mean length."""

    def __init__(self, frequency: np.ndarray, documents: int, ids: int):
        self.frequency, self.documents, self.mean = frequency, documents, max(ids / max(documents, 1), 1.0)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.frequency[terms]
        return np.log1p((self.documents - df + 0.5) / (df + 0.5))


def corpus_of(tokens: DataFrame) -> Corpus:
    """One pass over the stored ids; what comes back is one row for each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        documents = ids = 0
        for batch in batches:
            lists = [_ids(x) for x in batch.column("ids").to_pylist()]
            documents, ids = documents + len(lists), ids + sum(map(len, lists))
            for x in lists:
                width = int(x.max()) + 1
                if width > len(total):
                    total, last = (np.concatenate([t, np.zeros(width - len(t), np.int64)]) for t in (total, last))
                places = np.arange(len(x))
                last[x] = places  # of equal ids the last one stays
                total[x[last[x] == places]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(total[some], [documents, ids]))], ["term", "n"])

    held = tokens.select("ids").mapInArrow(count, schema("term long, n long")).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    known = dict(zip(held.column("term").to_pylist(), held.column("n").to_pylist(), strict=True))
    documents, ids = known.pop(-1, 0), known.pop(-2, 0)
    frequency = np.zeros(max(known, default=0) + 1, np.int64)
    frequency[list(known)] = list(known.values())
    return Corpus(frequency, documents, ids)


class Packer:
    """Fills windows; the open window is carried from shard to shard."""

    def __init__(self, first_sequence: int, corpus: Corpus):
        self.sequence, self.room, self.corpus = first_sequence, WINDOW, corpus
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []  # document, start, ids, tokens of the document
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for name, start, ids, tokens in pieces:
            self.done.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _add(self, name: int | None, start: int, ids: np.ndarray, tokens: int) -> int:
        """Put what fits into the open window; returns the number of ids taken."""
        take = min(self.room, len(ids))
        self.open.append((name, start, ids[:take], tokens))
        self.room -= take
        if not self.room:
            self._emit(self.open)
            self.open, self.room = [], WINDOW
        return take

    def shard(self, names: list, documents: list[np.ndarray]) -> None:
        index, unused, at = Index(documents, self.corpus), np.ones(len(documents), bool), 0
        seed: tuple[int, int] | None = None  # document, ids of it that are placed
        around: Iterator[int] = iter(())
        while True:
            if seed is None:
                nxt = next((j for j in around if unused[j]), None)
                if nxt is None:
                    while at < len(documents) and not unused[at]:
                        at += 1
                    if at == len(documents):
                        return
                    nxt = at
                unused[nxt] = False
                doc, placed = nxt, 0
                if not self.open or nxt == at:
                    around = iter(index.neighbours(doc, unused).tolist())
            else:
                doc, placed = seed
                around = iter(index.neighbours(doc, unused).tolist())
                seed = None
            ids = documents[doc]
            placed += self._add(names[doc], placed, ids[placed:], len(ids))
            if placed < len(ids):
                seed = doc, placed

    def finish(self) -> None:
        """The last window, in power-of-two parts."""
        left, pieces = sum(len(p[2]) for p in self.open), list(self.open)
        while left:
            room, part = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                name, start, ids, tokens = pieces.pop(0)
                part.append((name, start, ids[:room], tokens))
                if len(ids) > room:
                    pieces.insert(0, (name, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
            self._emit(part)
        self.open, self.room = [], WINDOW


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _grams(flat: np.ndarray) -> np.ndarray:
    """A hash for each id and the two behind it (zeros behind the last)."""
    ids = np.zeros(len(flat) + 2, np.uint64)
    ids[:-2] = flat
    ids += np.uint64(7)
    out = ids[:-2] * _MIX[0]
    out ^= out >> np.uint64(29)
    for step in (1, 2):
        out += ids[step : len(flat) + step]
        out *= _MIX[step]
        out ^= out >> np.uint64(32)
    out *= _MIX[3]
    return out


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = library_units(path, False)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts], TEXT_BYTES):
                ids, first = library.encode(texts[a:b])
                n = b - a
                flat = np.insert(ids, first[1:], END_ID)
                first = first + np.arange(n + 1)
                # trigrams that begin in a document and end in it; a short one has one gram of what there is
                grams = _grams(flat)
                last = first[1:, None] - (1, 2)
                grams[last[last > first[:-1, None]]] = _NONE  # all but the first gram of a short one
                few = np.flatnonzero(np.diff(first) < 3)
                grams[first[:-1][few]] = flat[first[:-1][few]].astype(np.uint64) * _MIX[3]
                affinity = (np.minimum.reduceat(grams, first[:-1]) >> np.uint64(1)).astype(np.int64)
                wide = np.maximum.reduceat(flat, first[:-1]) > 65535
                small, large, at = flat.astype("<u2"), flat.astype("<u4"), first.tolist()
                held = [large[at[i] : at[i + 1]].tobytes() if wide[i] else b"\0" + small[at[i] : at[i + 1]].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("row_hash").slice(a, n), pa.array(affinity), pa.array(held, pa.binary())],
                    ["doc_id", "row_hash", "affinity", "ids"],
                )

    return run


def _ids(raw: bytes) -> np.ndarray:
    """Ids stored as 16-bit integers behind a zero byte, or as 32-bit ones."""
    return np.frombuffer(raw, "<u2", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u4")


def _packer(corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        library_units.cache_clear()  # texts are done with; a worker holds either units or shards
        given_back()
        packer = Packer(TaskContext.get().partitionId() << 36, corpus.value)
        names: list = []
        documents: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.done, strict=True)) or [()] * 7
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split(" ")[0] for x in _PIECE.split(", ")])

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names.append(name)
                documents.append(_ids(raw))
                held += len(documents[-1])
                if len(documents) == SHARD or held >= SHARD_IDS:
                    packer.shard(names, documents)
                    names, documents, held = [], [], 0
                    yield out()
        if documents:
            packer.shard(names, documents)
        packer.finish()
        yield out()
        del packer, names, documents
        given_back()

    return run


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = durable(documents_only(docs).mapInArrow(_tokenize(path), schema("doc_id long, row_hash long, affinity long, ids binary")))
    corpus = tokens.sparkSession.sparkContext.broadcast(corpus_of(tokens))
    ordered = tokens.repartitionByRange("affinity", "row_hash", "doc_id").sortWithinPartitions("affinity", "row_hash", "doc_id")
    return ordered.select("doc_id", "ids").mapInArrow(_packer(corpus), schema(_PIECE))
