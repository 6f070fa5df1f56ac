"""Ranked lexical search as a blocked sparse matrix product.

The left matrix holds how often each item has each term, the right one the impact of each term on each document, both in
int64; their product holds the scores. Documents are tokenized once into blocks of columns of the right matrix: a row for
each slice of documents with the terms that any item has, by term (compressed rows). From these follow the document
frequencies, the number of documents and their terms, then the impacts. A task multiplies its blocks one after another in
Gustavson's way, merging the rows of an item's terms into one accumulator, and keeps of every item only the best ``limit``
so far; the tasks' best are ranked in two steps, so no task sees more of an item than ``limit`` rows from each of its inputs.

Items are taken in blocks of about ``BLOCK`` terms, whatever their number, and only one block is broadcast at a time. The
scores of documents that an item has no term of are zero and never made.

Weight of a term: floor(1000 ln((2 N + 2) / (2 df + 1))); impact: weight * ((10**9 tf) div (1000 tf + 20 m)) with
m = 100 - 50 + (50 n N) div L, where N documents have terms, L in all, and this one n.

Defined results: a null or empty text has no terms, so it is never returned, and an item of that kind returns nothing;
rows of a null doc_id come last among equals; repeated rows of documents are ranked each; rows of items are ranked each,
also under one item_id or none; an empty table of either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, durable, schema
from .terms import sliced
from .tokens import spread

LIMIT, BLOCK, SALTS = 50, 1 << 18, 16
_LAST = np.iinfo(np.int64).max


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item and how often it has them."""
    for batch in batches:
        for at, end, terms in sliced(batch.column("text")):
            held = [np.unique(terms.hash[terms.first[i] : terms.first[i + 1]], return_counts=True) for i in range(end - at)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").slice(at, end - at), pa.array([len(t) for t, _ in held]), pa.array([t.tobytes() for t, _ in held], pa.binary()), pa.array([c.tobytes() for _, c in held], pa.binary())],
                ["item_id", "n", "terms", "times"],
            )


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each; the first byte tells how many."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _matrix(vocabulary):
    """A row for each slice of documents: their ids and sizes; the terms of the vocabulary that they hold, ascending, the number
    of documents of each, and these documents (by place in the slice) with the frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = vocabulary.value
        marks = np.zeros(1 << 22, bool)
        marks[(known & np.uint64(len(marks) - 1)).astype(np.int64)] = True
        for batch in batches:
            for at, end, terms in sliced(batch.column("text")):
                n = np.diff(terms.first)
                some = np.flatnonzero(marks[(terms.hash & np.uint64(len(marks) - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(known, terms.hash[some]), len(known) - 1)
                same = known[place] == terms.hash[some]
                doc = np.searchsorted(terms.first, some[same], "right") - 1
                both, tf = np.unique(place[same] * (end - at) + doc, return_counts=True)
                term, doc = both // (end - at), both % (end - at)
                rows, df = np.unique(term, return_counts=True)
                ids = pa.array([batch.column("doc_id").slice(at, end - at).to_pylist()], pa.list_(pa.int64()))
                cells = [pa.array([_small(x)], pa.binary()) for x in (n, rows, df, doc, tf)]
                yield pa.RecordBatch.from_arrays([ids, *cells], ["ids", "sizes", "terms", "df", "doc", "tf"])

    return run


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Once a task: documents of each term; under -1 the documents that have terms, under -2 their terms."""
    total, documents, length = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        for sizes, terms, df in zip(*(batch.column(c).to_pylist() for c in ("sizes", "terms", "df")), strict=True):
            n, terms = _large(sizes), _large(terms)
            documents, length = documents + int((n > 0).sum()), length + int(n.sum())
            if len(terms):
                total = np.concatenate([total, np.zeros(max(0, int(terms[-1]) + 1 - len(total)), np.int64)])
                total[terms] += _large(df)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(total[some], [documents, length]))], ["term", "n"])


class _Best:
    """The best documents of one item so far."""

    def __init__(self, limit: int):
        self.limit, self.score, self.id = limit, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` with _LAST for null."""
        at = np.flatnonzero(score >= self.least)
        if not len(at):
            return
        if len(at) > self.limit:
            kth = np.partition(score[at], len(at) - self.limit)[len(at) - self.limit]
            at = at[score[at] >= kth]
        score, ids = np.concatenate([self.score, score[at]]), np.concatenate([self.id, ids[at]])
        order = np.lexsort((ids, -score))[: self.limit]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.limit:
            self.least = int(self.score[-1])


def _product(held, limit: int):
    """Once a task: the best documents of each item among those of the task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, documents, length, items = held.value
        best = [_Best(limit) for _ in items]
        where = np.full(len(weight), -1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                n, rows, df, doc, tf = (_large(row[c]) for c in ("sizes", "terms", "df", "doc", "tf"))
                if not len(rows):
                    continue
                ids = np.fromiter((_LAST if x is None else x for x in row["ids"]), np.int64, len(n))
                m = 50 + 50 * n * documents // length
                impact = np.repeat(weight[rows], df) * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                first = np.cumsum(df) - df
                where[rows] = np.arange(len(rows))
                for (terms, times), kept in zip(items, best, strict=True):
                    own = where[terms]
                    there = own >= 0
                    own = own[there]
                    cells = spread(first[own], df[own])
                    score = np.zeros(len(n), np.int64)
                    np.add.at(score, doc[cells], impact[cells] * np.repeat(times[there], df[own]))
                    kept.add(score, ids)
                where[rows] = -1
        item = np.repeat(np.arange(len(items)), [len(b.id) for b in best])
        score, ids = (np.concatenate([*(getattr(b, x) for b in best), np.zeros(0, np.int64)]) for x in ("score", "id"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _LAST), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _ranked(df: DataFrame, limit: int, *more: str) -> DataFrame:
    order = Window.partitionBy("item", *more).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _top_of_block(rows: pa.Table, docs: DataFrame, limit: int, multiplicity: bool) -> DataFrame:
    """The best documents for the items of one block."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    terms = [np.frombuffer(x, np.uint64) for x in rows.column("terms").to_pylist()]
    times = [np.frombuffer(x, np.int64) if multiplicity else np.ones(len(x) // 8, np.int64) for x in rows.column("times").to_pylist()]
    vocabulary = np.unique(np.concatenate(terms))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    matrix = durable(texts.mapInArrow(_matrix(sc.broadcast(vocabulary)), schema("ids array<long>, sizes binary, terms binary, df binary, doc binary, tf binary")))
    counted = matrix.select("sizes", "terms", "df").mapInArrow(_statistics, schema("term long, n long"))
    counted = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block's items at most
    known = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    documents, length = known.pop(-1, 0), known.pop(-2, 0)
    df = np.zeros(len(vocabulary), np.int64)
    df[np.fromiter(known, np.int64, len(known))] = np.fromiter(known.values(), np.int64, len(known))
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    items = [(np.searchsorted(vocabulary, t), k) for t, k in zip(terms, times, strict=True)]
    held = sc.broadcast((weight, documents, max(length, 1), items))
    found = matrix.mapInArrow(_product(held, limit), schema("item long, doc_id long, score long"))
    few = _ranked(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), limit, "salt").drop("rank", "salt")
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int64()), "item_id": rows.column("item_id")}))
    out = durable(_ranked(few, limit).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    dropped(matrix)
    held.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT, multiplicity: bool = False, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``limit`` best documents of each item; with ``multiplicity`` a term counts as often as
    the item has it."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = durable(texts.mapInArrow(_items, schema("item_id long, n long, terms binary, times binary")).where("n > 0"))
    total = held.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // block)
    number = F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(parts, 1)))
    found = []
    for part in range(parts):
        rows = held.where(number == part).drop("n").toArrow()
        if rows.num_rows:
            found.append(_top_of_block(rows, docs, limit, multiplicity))
    dropped(held)
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
