"""Embedding near-duplicates by sorted projection passes.

Equal vectors form one class that goes through once, with its size as weight. A pass gives each class a key of
concatenated random hashes (cross-polytope hashes: the signed axis nearest to the randomly rotated vector) and a finer
projection behind them, orders all classes by it and compares neighbours: the order is cut into chunks of ``chunk`` rows
and each chunk is compared with itself and the next. Where more rows than that share a whole key, all pairs of the key's
chunks are compared as well, in blocks, so no cap drops a candidate. A pair that several passes meet counts in the first
of them only, which each side's list of chunks and keys tells, so pairs are neither stored nor distinct-ed: a block
yields link counts and a spanning forest of its links. The number of passes follows from the number of classes n: a
pass finds a pair at the threshold with a chance of ``hit`` to the power of the hashes it takes to get down to a chunk,
and passes are added until the chance to miss such a pair in all is below ``miss``.

Defined results: null, zero, or non-finite vectors, and vectors with null components, link with nothing and are their own
component; vectors of different lengths never link; rows of a null vec_id have no links, a null component and are not
kept; repeated rows are vectors of their own that link with each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, schema
from .components import components

THRESHOLD, CHUNK, HASHES, HIT, MISS = 0.9, 512, 3, 0.4, 1e-4
_INT = "<i8"


def passes_for(n: int, chunk: int = CHUNK, hit: float = HIT, miss: float = MISS, buckets: int = 128) -> int:
    depth = max(1.0, math.log(max(n, 2) / chunk, buckets)) if n > chunk else 1.0
    return math.ceil(math.log(miss) / math.log(1 - hit**depth))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, v: the vector as little-endian doubles, null where it is not usable."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = None if not v or None in v else np.asarray(v, "<f8")
            out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])


def _matrix(vectors: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


@lru_cache(maxsize=256)
def _rotation(d: int, number: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64([d, number])).standard_normal((d, d)))
    return q


def _keys(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            lengths = np.asarray([len(v) // 8 for v in vectors], np.int64)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    m = _matrix([vectors[i] for i in part])
                    ids = batch.column("ckey").take(pa.array(part))
                    for p in range(passes):
                        key = np.full(len(part), int(d), np.int64)
                        for h in range(HASHES):
                            turned = m @ _rotation(int(d), p * HASHES + h)
                            axis = np.abs(turned).argmax(axis=1)
                            sign = turned[np.arange(len(part)), axis] < 0
                            key = key * 8191 + 2 * axis + sign
                        fine = np.abs(turned).max(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, np.int32)), pa.array(key), pa.array(fine), ids], ["pass", "key", "fine", "ckey"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
        at += n
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pass", "key", "ckey")), *extra], ["pass", "key", "ckey", "part", "idx"])


def _compare(threshold: float):
    def links(g: pa.Table) -> pa.RecordBatch:
        """One block: rows of the left chunk (role 0) and of the right one (role 1)."""
        names = g.column("ckey").to_pylist()
        p = g.column("pass")[0].as_py()
        inner = g.column("i")[0].as_py() + 1 == g.column("j")[0].as_py()
        role = g.column("role").to_numpy()
        reps, weight = g.column("rep_id").to_numpy(), g.column("weight").to_numpy()
        vectors = g.column("v").to_pylist()
        chunks = np.frombuffer(b"".join(g.column("chunks").to_pylist()), _INT).reshape(len(names), -1)
        keys = np.frombuffer(b"".join(g.column("keys").to_pylist()), _INT).reshape(len(names), -1)
        lengths = np.asarray([len(v) for v in vectors])
        counts, edges = np.zeros(len(names), np.int64), []
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            left, right = rows[role[rows] == 0], rows[role[rows] == 1]
            blocks = [(left, right, False)] + ([(left, left, True)] if inner else [])
            for x, y, own in blocks:
                if not len(x) or not len(y):
                    continue
                if not inner and p and (keys[x, 0] == keys[x[0], 0]).all() and (keys[y, 0] == keys[x[0], 0]).all():
                    continue  # one key in the first pass: compared there
                close = _matrix([vectors[k] for k in x]) @ _matrix([vectors[k] for k in y]).T >= threshold
                a, b = np.nonzero(np.triu(close, 1) if own else close)
                a, b = x[a], y[b]
                if not inner:
                    same = keys[a, p] == keys[b, p]
                    a, b = a[same], b[same]
                if p and len(a):
                    earlier = ((np.abs(chunks[a, :p] - chunks[b, :p]) <= 1) | (keys[a, :p] == keys[b, :p])).any(axis=1)
                    a, b = a[~earlier], b[~earlier]
                np.add.at(counts, a, weight[b])
                np.add.at(counts, b, weight[a])
                edges.append(np.stack([reps[a], reps[b]], 1))
        pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        kept = _forest(pairs)
        some = np.flatnonzero(counts)
        n, m = len(some), len(kept)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([names[k] for k in some] + [None] * m, pa.binary()),
                pa.array(np.concatenate([counts[some], np.zeros(m, np.int64)])),
                pa.array([None] * n + kept[:, 0].tolist(), pa.int64()),
                pa.array([None] * n + kept[:, 1].tolist(), pa.int64()),
            ],
            ["ckey", "links", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("pass", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and tuple(ids[s]) != name:
                    yield links(pa.Table.from_batches(held))
                    held = []
                name = tuple(ids[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Of the links, enough to keep their components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in np.unique(pairs, axis=0).tolist() if len(pairs) else []:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.asarray(kept, np.int64).reshape(-1, 2)


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = durable(rows.mapInArrow(_unit, schema("vec_id long, v binary")).withColumn("ckey", F.unhex(F.md5("v"))))
    usable = rows.where("v is not null and vec_id is not null")
    classes = durable(usable.groupBy("ckey").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("weight"), F.min("v").alias("v")))
    passes = passes_for(classes.count(), chunk)
    ranked = classes.select("v", "ckey").mapInArrow(_keys(passes), schema("pass int, key long, fine double, ckey binary"))
    ranked = ranked.repartitionByRange("pass", "key", "fine", "ckey").sortWithinPartitions("pass", "key", "fine", "ckey")
    ranked = durable(ranked.select("pass", "key", "ckey").mapInArrow(_numbered, schema("pass int, key long, ckey binary, part int, idx long")))
    sizes = {r.part: r.n for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number a partition
    first, at = [], 0
    for part in range(max(sizes, default=-1) + 1):
        first.append(at)
        at += sizes.get(part, 0)
    start = F.get(F.lit(first).cast("array<bigint>"), F.col("part")) if first else F.lit(0)
    placed = ranked.select("pass", "key", "ckey", F.floor((start + F.col("idx")) / chunk).cast("long").alias("chunk"))
    packed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pass", c))), lambda x: x[c])
    places = placed.groupBy("ckey").agg(packed("chunk").alias("chunks"), packed("key").alias("keys"))
    whole = durable(classes.join(places, "ckey").mapInArrow(_flat, schema("ckey binary, rep_id long, weight long, v binary, chunks binary, keys binary")))
    runs = placed.groupBy("pass", "key").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("hi - lo >= 2")
    near = placed.select("pass", "ckey", F.explode(F.array(F.struct(F.col("chunk").alias("i"), (F.col("chunk") + 1).alias("j"), F.lit(0).alias("role")), F.struct((F.col("chunk") - 1).alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("role")))).alias("x"))
    others = F.filter(F.sequence("lo", "hi"), lambda j: F.abs(j - F.col("chunk")) >= 2)
    far = placed.join(runs, ["pass", "key"]).select("pass", "ckey", F.explode(F.transform(others, lambda j: F.struct(F.least(j, "chunk").alias("i"), F.greatest(j, "chunk").alias("j"), (j < F.col("chunk")).cast("int").alias("role")))).alias("x"))
    blocks = near.unionByName(far).select("pass", "ckey", "x.i", "x.j", "x.role").join(whole, "ckey")
    blocks = blocks.repartition("pass", "i", "j").sortWithinPartitions("pass", "i", "j")
    found = durable(blocks.mapInArrow(_compare(threshold), schema("ckey binary, links long, a long, b long")))
    linked = found.where("ckey is not null").groupBy("ckey").agg(F.sum("links").alias("links"))
    label = components(found.where("a is not null").select("a", "b"))
    per = classes.select("ckey", "rep_id", "weight").join(linked, "ckey", "left").join(label, F.col("rep_id") == F.col("node"), "left")
    per = per.select("ckey", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep_id").alias("component"))
    out = rows.withColumn("ckey", F.when(F.col("vec_id").isNotNull(), F.col("ckey"))).join(per, "ckey", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of chunks and keys as bytes."""
    for batch in batches:
        flat = [pa.array([np.asarray(x, _INT).tobytes() for x in batch.column(c).to_pylist()], pa.binary()) for c in ("chunks", "keys")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ckey", "rep_id", "weight", "v")), *flat], ["ckey", "rep_id", "weight", "v", "chunks", "keys"])
