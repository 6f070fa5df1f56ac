"""Helpers shared by the corpus operators: durable intermediates, batch slicing, vectorised rolling hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass looks at; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="studyloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing. The files are
    removed by :func:`dropped` or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/studyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._studyloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove the files of durable tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._studyloom_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: A key is heavy if it has more than this share of a table's rows, so at most a thousand keys are, and more than so many.
HEAVY, HEAVY_ROWS = 1000, 100


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``n`` the number of rows that ``left``, of ``total`` rows in
    all, has for it. The rows of heavy keys, of which there are fewer than ``HEAVY``, stay where they are and meet a broadcast;
    the others are shuffled, by the same join at every size."""
    most = max(total // HEAVY, HEAVY_ROWS)
    heavy = [row[0] for row in right.where(F.col("n") > most).select(key).collect()]
    if not heavy:
        return left.join(right.drop("n").hint("merge"), key, how)
    named = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    few = left.where(named).join(F.broadcast(right.where(F.col("n") > most).drop("n")), key)
    return few.unionByName(left.where(~named).join(right.where(F.col("n") <= most).drop("n").hint("merge"), key, how))


def given_back() -> None:
    """Return a Python worker's free memory to the system: workers outlive their tasks, and stages without Python share an
    executor with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def documents_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and a row identity; extra columns, whatever their names, do not reach the operators."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return picked.withColumn("row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, brought up to the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``most`` (always at least one item)."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


# ---- rolling hashes modulo 2**64 -------------------------------------------------------------------------------------

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**64, 256, dtype=np.uint64)
#: \x20 and \x09-\x0D, the white space of the word contract.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """base**i and base**-i for i < n, grown by doubling."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=4)
def powers(base: int) -> _Powers:
    return _Powers(base)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of ``values`` (uint64), by prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        up, self.down = powers(base).get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buffer: np.ndarray, step: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 buffer, in bounded steps."""
    starts, hashes, at, n = [], [], 0, len(buffer)
    while at < n:
        end = min(n, at + step)
        while end < n and not _SPACE[buffer[end]]:
            nxt = np.flatnonzero(_SPACE[buffer[end : end + step]])
            end = end + int(nxt[0]) if len(nxt) else min(n, end + step)
        part = buffer[at:end]
        edge = np.diff(np.concatenate([[1], _SPACE[part].view(np.int8), [1]]))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        starts.append(s + at)
        hashes.append(Rolling(_BYTE[part]).of(s, e))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


class Words:
    """The words of several documents: hashes in ``hash``, the words of document i at ``first[i]:first[i + 1]``."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts, self.hash = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
        self.first = np.searchsorted(starts, offsets)
        self.first[-1] = len(starts)


def sliding(values: np.ndarray, width: int, smaller: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` consecutive values, by doubling."""
    pick, out, have = (np.minimum if smaller else np.maximum), values, 1
    while have < width:
        by = min(have, width - have)
        out = pick(out[: len(out) - by], out[by:])
        have += by
    return out


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each ``width`` consecutive values."""
    val, idx, have = values, np.arange(len(values)), 1
    while have < width:
        by = min(have, width - have)
        left, right = val[: len(val) - by], val[by:]
        first = left <= right
        val, idx, have = np.where(first, left, right), np.where(first, idx[: len(idx) - by], idx[by:]), have + by
    return idx
