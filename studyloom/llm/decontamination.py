"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WIDTH`` words (an item of fewer is one window), and a window is the set of its ``GRAM``-word
shingles. The shingles of all items are counted over all documents, and those of a window are ordered by rarity: to hold
``share`` of a window's k shingles, a document window of the same size must hold one of its k - ceil(share * k) + 1 rarest,
its prefix. A document shingle that equals one of a prefix is a candidate at the places where the window can lie around it
(by position) inside that document (by length), and there it is verified: word by word for a share of 1, otherwise by
counting the shingles that both windows hold.

Items are cut into blocks of about ``BLOCK`` (item, window) rows, whatever their number; a block is broadcast, and all documents
pass by it, so documents are never shuffled and a passage in any share of them is no hot key. Counts of shingles meet in a
fixed number of slots: a slot that two shingles share makes a prefix a little worse, never a result.

Defined results: a null or empty text has no words; an item without words has no windows; the windows of a null item_id
are hit as any, but there is no id to name; repeated rows of documents are documents of their own, repeated ids of items
count once; an empty table of either kind gives documents without hits, or no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_only, dropped, durable, fresh, mix, schema
from .terms import sliced
from .tokens import spread

WIDTH, GRAM, SHARE, BLOCK = 10, 3, 1.0, 1 << 18
#: Slots of the counts of shingles, and pairs of a window and a place that are verified at a time.
SLOTS, PAIRS = 1 << 20, 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_FOUND = "doc_id long, row_hash long, n_words long, ranges array<struct<start:int,end:int>>, items array<long>"


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words."""
    n = max(len(words) - size + 1, 0)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += words[j : j + n] * _ODD[j % 4] ** np.uint64(1 + j // 4)
    return mix(total)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(SLOTS - 1)).astype(np.int64)


def _item_windows(words: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and shingles of each window of an item."""
    wide = min(width, len(words))
    size = min(gram, wide)
    grams = shingles(words, size)
    for at in range(len(words) - wide + 1 if wide else 0):
        yield words[at : at + wide], grams[at : at + wide - size + 1]


def _marked(width: int, gram: int):
    """Slots and lengths of the items' shingles, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {size: np.zeros(SLOTS, bool) for size in range(1, gram + 1)}
        for batch in batches:
            for at, end, terms in sliced(batch.column("text")):
                for i in range(end - at):
                    words = terms.hash[terms.first[i] : terms.first[i + 1]]
                    if len(words):
                        size = min(gram, width, len(words))
                        marks[size][_slot(shingles(words, size))] = True
        for size, marked in marks.items():
            slots = np.flatnonzero(marked)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), size, np.int32)), pa.array(slots)], ["size", "slot"])

    return run


def _counted(marks):
    """How often the documents hold shingles of the marked slots, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, terms in sliced(batch.column("text")):
                for size, marked in marks.value.items():
                    slots = _slot(shingles(terms.hash, size))
                    np.add.at(total, slots[marked[slots]], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    return run


def _cut(counts, width: int, gram: int, share: float):
    """A row for each window of an item: its words, the shingles of its prefix and where in the window they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item_id")
            for at, end, terms in sliced(batch.column("text"), 1 << 18):
                rows = []
                for i in range(end - at):
                    words = terms.hash[terms.first[i] : terms.first[i + 1]]
                    for held, grams in _item_windows(words, width, gram):
                        distinct, first = np.unique(grams, return_index=True)
                        keep = len(distinct) - math.ceil(share * len(distinct)) + 1
                        rare = np.lexsort((distinct, counts.value[_slot(distinct)]))[:keep]
                        rows.append((i, held.tobytes(), distinct[rare].tobytes(), first[rare].astype("<i4").tobytes()))
                which, held, prefix, offset = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [names.slice(at, end - at).take(pa.array(which, pa.int64())), *(pa.array(x, pa.binary()) for x in (held, prefix, offset))],
                    ["item_id", "words", "prefix", "offset"],
                )

    return run


class Windows:
    """One block of windows: distinct windows, the items of each, and for each prefix shingle its windows and offsets."""

    def __init__(self, rows: pa.Table, width: int, gram: int):
        held, which = np.unique(np.asarray(rows.column("words").to_pylist(), object), return_inverse=True)
        self.n, self.gram = len(held), gram
        self.width = np.array([len(w) // 8 for w in held], np.int64)
        self.words = np.zeros((self.n, width), np.uint64)
        for i, w in enumerate(held):
            self.words[i, : self.width[i]] = np.frombuffer(w, np.uint64)
        named = rows.column("item_id").combine_chunks()
        some = np.flatnonzero(~np.asarray(named.is_null()))
        order = np.argsort(which[some], kind="stable")
        self.item = named.take(pa.array(some)).to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.owners = np.searchsorted(which[some][order], np.arange(self.n + 1))
        one = np.unique(which, return_index=True)[1]
        prefix = [np.frombuffer(x, np.uint64) for x in rows.column("prefix").take(pa.array(one)).to_pylist()]
        window = np.repeat(np.arange(self.n), [len(p) for p in prefix])
        offset = np.frombuffer(b"".join(rows.column("offset").take(pa.array(one)).to_pylist()), "<i4").astype(np.int64)
        size = np.minimum(self.width, gram)[window]
        #: by length of shingle: marks of slots, keys, and windows and offsets from first[i] to first[i + 1] of each key
        self.by_size = {}
        flat = np.concatenate([*prefix, np.zeros(0, np.uint64)])
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            at = at[np.argsort(flat[at], kind="stable")]
            keys, first = np.unique(flat[at], return_index=True)
            marks = np.zeros(SLOTS, bool)
            marks[_slot(keys)] = True
            self.by_size[int(length)] = marks, keys, np.append(first, len(at)), window[at], offset[at]

    def candidates(self, words: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and starts in ``words`` where a shingle of the window's prefix stands, some at a time."""
        for length, (marks, keys, first, window, offset) in self.by_size.items():
            grams = shingles(words, length)
            at = np.flatnonzero(marks[_slot(grams)])
            key = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            same = keys[key] == grams[at]
            at, key = at[same], key[same]
            sizes = first[key + 1] - first[key]
            ends = np.cumsum(sizes)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                held = spread(first[key[i:j]], sizes[i:j])
                w, start = window[held], np.repeat(at[i:j], sizes[i:j])
                if share == 1:
                    yield w, start - offset[held]
                else:  # the shingle may lie anywhere in the document's window
                    back = self.width[w] - length + 1
                    yield np.repeat(w, back), np.repeat(start, back) - spread(np.zeros(len(w), np.int64), back)
                i = j

    def verified(self, words: np.ndarray, w: np.ndarray, start: np.ndarray, share: float) -> np.ndarray:
        """Which of the candidates, all inside a document, hold ``share`` of the window."""
        columns = np.arange(self.words.shape[1])
        outside = columns >= self.width[w][:, None]
        there = words[np.minimum(start[:, None] + columns, len(words) - 1)]
        if share == 1:
            return ((there == self.words[w]) | outside).all(axis=1)
        good = np.zeros(len(w), bool)
        for i in range(len(w)):
            wide = self.width[w[i]]
            size = min(self.gram, wide)
            own = np.unique(shingles(self.words[w[i], :wide], size))
            both = np.intersect1d(own, shingles(there[i, :wide], size))
            good[i] = len(both) >= math.ceil(share * len(own))
        return good

    def hits(self, words: np.ndarray, first: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct documents and windows that occur in them, and which words lie in an occurrence."""
        n = len(words)
        change = np.zeros(n + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        if n:
            for w, start in self.candidates(words, share):
                doc = np.searchsorted(first, np.maximum(start, 0), "right") - 1
                inside = (start >= 0) & (start + self.width[w] <= first[np.minimum(doc + 1, len(first) - 1)])
                w, start, doc = w[inside], start[inside], doc[inside]
                good = self.verified(words, w, start, share)
                w, start, doc = w[good], start[good], doc[good]
                np.add.at(change, start, 1)
                np.add.at(change, start + self.width[w], -1)
                pairs.append(np.unique(doc * self.n + w))
        both = np.unique(np.concatenate(pairs))
        return both // self.n, both % self.n, np.cumsum(change[:-1]) > 0


def _scan(block, share: float, every: bool):
    """A row for each document (or, unless ``every``, for each that is hit): hit ranges of words, items that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = block.value
        for batch in batches:
            for at, end, terms in sliced(batch.column("text")):
                n = end - at
                doc, window, covered = windows.hits(terms.hash, terms.first, share)
                owned = windows.owners[window + 1] - windows.owners[window]
                items = windows.item[spread(windows.owners[window], owned)]
                named = np.repeat(doc, owned)
                order = np.lexsort((items, named))
                named, items = named[order], items[order]
                fresh = np.append(True, (named[1:] != named[:-1]) | (items[1:] != items[:-1]))[: len(named)]
                named, items = named[fresh], items[fresh]
                # ranges of covered words, which end with their document
                begin, stop = covered.copy(), covered.copy()
                begin[1:] &= ~covered[:-1]
                stop[:-1] &= ~covered[1:]
                cuts = terms.first[(terms.first > 0) & (terms.first < len(covered))]
                begin[cuts], stop[cuts - 1] = covered[cuts], covered[cuts - 1]
                start, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
                home = np.searchsorted(terms.first, start, "right") - 1
                base = terms.first[home]
                spans = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["start", "end"])
                rows = np.arange(n + 1)
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n),
                        batch.column("row_hash").slice(at, n),
                        pa.array(np.diff(terms.first)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(home, rows).astype(np.int32)), spans),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(named, rows).astype(np.int32)), pa.array(items)),
                    ],
                    ["doc_id", "row_hash", "n_words", "ranges", "items"],
                )
                yield out if every else out.filter(pa.array(np.isin(np.arange(n), home)))

    return run


def windows_of(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM, share: float = SHARE) -> DataFrame:
    """A row for each distinct pair of an item and a window, with the window's prefix by what all documents hold."""
    sc = docs.sparkSession.sparkContext
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = texts.select("text").mapInArrow(_marked(width, gram), schema("size int, slot long")).distinct().toArrow()  # gram * SLOTS rows at most
    marks = {}
    sizes, slots = found.column("size").to_numpy(), found.column("slot").to_numpy()
    for size in np.unique(sizes):
        marks[int(size)] = np.isin(np.arange(SLOTS), slots[sizes == size])
    held = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(sc.broadcast(marks)), schema("slot long, n long"))
    total = held.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[total.column("slot").to_numpy()] = total.column("n").to_numpy()
    rows = texts.mapInArrow(_cut(sc.broadcast(counts), width, gram, share), schema("item_id long, words binary, prefix binary, offset binary"))
    return durable(rows.distinct())


def _merged(ranges: Column) -> Column:
    """Sorted ranges without overlaps."""
    step = lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1).end >= r.start),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1).start.alias("start"), F.greatest(F.element_at(done, -1).end, r.end).alias("end")))),
    ).otherwise(F.concat(done, F.array(r)))
    return F.aggregate(F.sort_array(ranges), F.array().cast("array<struct<start:int,end:int>>"), step)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, row_hash, n_words, the ranges of its words that lie in an occurrence, and the
    item_ids that occur in it, ascending."""
    sc, base = docs.sparkSession.sparkContext, documents_only(docs)
    windows = windows_of(docs, items, width, gram, share)
    parts = max(1, -(-windows.count() // block))
    number = F.pmod(F.xxhash64("words", "item_id"), F.lit(parts))

    def passed(part: int) -> tuple[DataFrame, object]:
        held = sc.broadcast(Windows(windows.where(number == part).toArrow(), width, gram))
        return base.mapInArrow(_scan(held, share, part == 0), schema(_FOUND)), held

    out, _ = passed(0)
    more = []
    for part in range(1, parts):
        found, held = passed(part)
        more.append(durable(found))
        held.destroy()
    dropped(windows)
    if not more:
        return out
    key = [F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("row_hash").alias("k3")]
    every = more[0]
    for one in more[1:]:
        every = every.unionByName(one)
    late = every.distinct().groupBy(*key).agg(F.flatten(F.collect_list("ranges")).alias("late_ranges"), F.flatten(F.collect_list("items")).alias("late_items"))
    both = out.select("*", *key).join(late, ["k1", "k2", "k3"], "left").drop("k1", "k2", "k3")
    none = lambda c, like: F.coalesce(c, F.slice(like, 1, 0))
    ranges, items = F.concat("ranges", none("late_ranges", "ranges")), F.concat("items", none("late_items", "items"))
    return both.select("doc_id", "row_hash", "n_words", _merged(ranges).alias("ranges"), F.sort_array(F.array_distinct(items)).alias("items"))


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contaminated(docs, items)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, r: total + r.end - r.start)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """The documents of which no word is hit, all columns."""
    bad = contaminated(docs, items, width, share=share).where(F.size("ranges") > 0).select(F.col("doc_id").alias("bad_id"), F.col("row_hash").alias("bad_row")).distinct()
    marked = docs.withColumn(name := fresh("row_hash", docs.columns), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    same = marked["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (marked[name] == bad["bad_row"])
    return marked.join(bad, same, "left_anti").select(*docs.columns)
