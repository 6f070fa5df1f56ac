"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every window of ``length`` words the leftmost smallest hash of its ``seed`` -word grams is
kept, so two equal windows always keep the same gram at the same place. An anchor stands for the run of windows that
chose it. Documents are joined on anchors; anchors are extended both ways over their whole run: equal runs are maximal
repeats at once, and of unequal runs that share an anchor the single windows are compared, so that a repeat is found up to
its last word on either side. No pairs are formed: each group keeps its smallest doc_id, so a passage that a third of all
documents share costs rows in proportion to its occurrences. Hashes of runs and windows have 128 bits.

Defined results: a null text has no words; a null doc_id is after all others and never the smaller one; repeated rows are
judged alike (a row is not a smaller document for its equals); an empty table gives an empty result; other columns are
ignored by the digest and carried along by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, Words, documents_only, durable, fresh, leftmost_minimum, mix, recounted, schema, slices

LENGTH, SEED = 50, 20
_RUN = "anchor long, run long, doc_id long, row_hash long, place long"
_WINDOW = "h1 long, h2 long, doc_id long, row_hash long, place long"
_BITS = 24


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def runs_of(texts: list[bytes], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, first window within it, windows, anchor hash, run hash) of each run of windows with one anchor."""
    words = Words(texts)
    n = len(words.hash)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = np.arange(n - seed + 1)
    rolled = Rolling(words.hash)
    gram = rolled.of(grams, grams + seed)
    owner = leftmost_minimum(gram, length - seed + 1)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    inside = doc_of[: n - length + 1] == doc_of[length - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    own = owner[at]
    # a run ends where the anchor changes, and is cut so that its length fits the packed place
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, count = at[new], np.diff(np.concatenate([new, [len(at)]]))
    anchor = gram[own[new]]
    run = rolled.of(first, first + count - 1 + length) * np.uint64(BASES[1]) + (own[new] - first).astype(np.uint64)
    doc = doc_of[first]
    return doc, first - words.first[doc], count, anchor, mix(run)


def _emit_runs(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, rows = _texts(batch), batch.column("doc_id"), batch.column("row_hash")
            for a, b in slices([len(t) for t in texts]):
                doc, first, count, anchor, whole = runs_of(texts[a:b], length, seed)
                take = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(anchor)), pa.array(_signed(whole)), ids.take(take), rows.take(take), pa.array((first << _BITS) | count)],
                    ["anchor", "run", "doc_id", "row_hash", "place"],
                )

    return run


def _emit_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, rows = _texts(batch), batch.column("doc_id"), batch.column("row_hash")
            places = batch.column("places").to_pylist()
            for a, b in slices([len(t) for t in texts]):
                words = Words(texts[a:b])
                one, two = Rolling(words.hash), Rolling(words.hash, BASES[1])
                for i in range(a, b):
                    packed = np.asarray(places[i], np.int64)
                    first, count = packed >> _BITS, packed & ((1 << _BITS) - 1)
                    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                    s = at + words.first[i - a]
                    take = pa.array(np.full(len(at), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(one.of(s, s + length))), pa.array(_signed(two.of(s, s + length))), ids.take(take), rows.take(take), pa.array((at << _BITS) | 1)],
                        ["h1", "h2", "doc_id", "row_hash", "place"],
                    )

    return run


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, row_hash, places: for each document with repeated text, runs of windows to remove, packed
    ``first << 24 | windows``."""
    base = documents_only(docs)
    found = durable(base.mapInArrow(_emit_runs(length, seed), schema(_RUN)))
    groups = found.groupBy("anchor", "run").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    mixed = groups.groupBy("anchor").agg(F.count("*").alias("n"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    mixed = mixed.where("n > 1 and least < most").select("anchor", F.lit(True).alias("mixed"))
    wanted = groups.join(mixed, "anchor", "left").where("mixed or lo < hi").select("anchor", "run", "lo", "mixed")
    held = found.join(wanted, ["anchor", "run"]).select("doc_id", "row_hash", "place", (F.col("doc_id") > F.col("lo")).alias("whole"), "mixed")
    held = durable(held.where("doc_id is not null and (whole or mixed)"))
    open_ = held.where("not whole").groupBy("doc_id", "row_hash").agg(F.collect_list("place").alias("places"))
    single = base.join(open_, ["doc_id", "row_hash"]).select("doc_id", "row_hash", "text", "places")
    windows = durable(single.mapInArrow(_emit_windows(length), schema(_WINDOW)))
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    later = windows.join(least, ["h1", "h2"]).where("doc_id > lo").select("doc_id", "row_hash", "place")
    every = held.where("whole").select("doc_id", "row_hash", "place").unionByName(later)
    return every.groupBy("doc_id", "row_hash").agg(F.collect_list("place").alias("places"))


def _kept(text: bytes, places: list[int] | None, length: int) -> tuple[int, np.ndarray | None, list[bytes]]:
    """Number of words, mask of removed words (None: none), words."""
    words = text.split()
    if not places:
        return len(words), None, words
    packed = np.asarray(places, np.int64)
    first, count = packed >> _BITS, packed & ((1 << _BITS) - 1)
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + count - 1 + length, -1)
    return len(words), np.cumsum(delta[:-1]) > 0, words


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(_texts(batch), batch.column("places").to_pylist(), strict=True):
                n, gone, words = _kept(text, places, length)
                left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            n, removed, digest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def substring_digest(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    joined = documents_only(docs).join(repeats(docs, length, seed), ["doc_id", "row_hash"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_digest(length), schema("doc_id long, n_words long, n_removed long, kept_sha256 string"))


def _without(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The kept stretches of words as they stood, joined by line feeds."""
    stretches, at, begun = [], 0, None
    for word, drop in zip(words, gone.tolist(), strict=True):
        start = text.index(word, at)
        if drop and begun is not None:
            stretches.append(text[begun:at])
            begun = None
        elif not drop and begun is None:
            begun = start
        at = start + len(word)
    if begun is not None:
        stretches.append(text[begun:at])
    return b"\n".join(stretches)


def _cut(length: int, places: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column(places).to_pylist(), strict=True):
                if marks:
                    _, gone, words = _kept(text.encode(), marks, length)
                    text = _without(text.encode(), words, gone).decode()
                out.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string())).drop_columns([places])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents, all columns, without the passages that a document with a smaller doc_id has; n_chars follows the
    text where the table has it. Documents that lose everything stay, with an empty text."""
    columns = docs.columns
    places, row, ident = (fresh(x, columns) for x in ("places", "row_hash", "ident"))
    held = docs.withColumn(row, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(ident, F.col("doc_id").cast("long"))
    marks = repeats(docs, length, seed).select(F.col("doc_id").alias(ident), F.col("row_hash").alias(row), F.col("places").alias(places))
    cut = held.join(marks, [ident, row], "left").select(*columns, places).mapInArrow(_cut(length, places), docs.schema)
    return recounted(cut)
