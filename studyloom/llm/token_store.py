"""Token ids in a compact binary file format, by an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK`` ids; each block carries a CRC-32 of its ids, so damage is found. ``LANES`` blocks are
coded side by side, one numpy lane each, and share one model, which starts anew for every such group. The model predicts the
next id by order 2 (what followed the last two ids), by order 1 (what followed the last one) and by order 0 (counts). The
three are mixed into one distribution, an id's probability being the sum of its shares; the weights depend on how often both
guesses held. At the steps ``REFRESH`` guesses, counts and weights take up every id that the lanes have coded since, so that
between them a step is a few array operations and the encoder computes many steps at once. An id is one step of the range coder, which is carryless, with a 64-bit state and 32-bit output words. Memory
is bounded by the lanes and by a segment's ids, whatever the size of a document.

File format (little endian), one segment: magic ``SLTS``, version, number of documents, blocks and ids, ids of a block and
bytes of the alphabet (u32 each); the alphabet, which is the distances between the ids in use, ascending (u32), by zlib; the
id count of each document (u32); for each block its ids, words and CRC-32 (u32 each); then the blocks' words (u32). Segments
are rows (part, seq, before, payload) of a table in a folder, in ascending doc_id order by (part, seq), ``before`` being the
ids before it in its part, written by Spark's committer, so lost tasks are redone safely and any file system that Spark reads
will do.

Defined results: a null text is empty and has only the end id; null doc_ids come first; repeated rows are documents of
their own, next to each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_only, durable, given_back, schema, slices
from .tokens import library_units

BLOCK, LANES, SEGMENT_IDS, END_ID = 1024, 3072, 3 << 20, 1
TEXT_BYTES = 4 << 20
#: Steps of a group at which its model learns.
REFRESH = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)
_MAGIC, _VERSION = b"SLTS", 4
_PAIRS = 1 << 16  # slots of order 2
_STEPS = 8  # that the encoder computes at once
_U = np.uint64
_32, _LOW = _U(32), _U((1 << 32) - 1)


class _Model:
    """What a group of lanes predicts, over the numbers 0 to n - 1. ``tables`` hold, for each context, a guess times 16 and the
    class of how often it held; ``m0``, ``m1`` and ``m2`` the shares of the orders by both classes."""

    def __init__(self, n: int):
        self.bits = max(12, n.bit_length() + 3)  # of counts
        self.weigh = min(11, 31 - self.bits)  # of weights
        self.scale = self.bits + self.weigh  # the coder divides its range into 2**scale parts
        self.tables = [np.zeros(k, np.int64) for k in (n, _PAIRS)]
        self.tries, self.held = ([np.zeros(k, np.int64) for k in (n, _PAIRS)] for _ in range(2))
        self.cells = np.zeros((3, 512), np.int64)
        self.counts = np.zeros(n, np.int64)
        self._counted((1 << 30) // (np.arange(n) + 256))
        self._weighed()

    def _counted(self, counts: np.ndarray) -> None:
        room = (1 << self.bits) - len(counts)
        self.size = 1 + counts * room // int(counts.sum())
        self.size[np.argmax(counts)] += (1 << self.bits) - int(self.size.sum())
        self.low = np.cumsum(self.size) - self.size
        self.holder = np.repeat(np.arange(len(counts)), self.size)

    def _weighed(self) -> None:
        full, (n, h1, h2) = (1 << self.weigh) - (1 << self.weigh >> 5), self.cells
        m1, m2 = (full * (8 * h + 1) // (8 * n + 16) for h in (h1, h2))
        self.m0, self.m1, self.m2 = (1 << self.weigh) - m1 - m2, m1 << self.bits, m2 << self.bits

    @staticmethod
    def pair(before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return ((before * 48271 + last * 40503) >> 4) & (_PAIRS - 1)

    def _cell(self, last: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e1, e2 = self.tables[0].take(last), self.tables[1].take(pair)
        g1, g2 = e1 >> 4, e2 >> 4
        return g1, g2, ((e2 & 15) << 4) + (e1 & 15) + ((g1 == g2) << 8)

    def predict(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both guesses and the shares of the three orders."""
        g1, g2, cell = self._cell(last, self.pair(before, last))
        return g1, g2, self.m0.take(cell), self.m1.take(cell), self.m2.take(cell)

    def interval(self, k: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(low end, size) of the numbers k; the share of a guess lies before its share by counts."""
        g1, g2, m0, m1, m2 = found
        low = m0 * self.low.take(k) + m1 * (g1 < k) + m2 * (g2 < k)
        return low, m0 * self.size.take(k) + m1 * (g1 == k) + m2 * (g2 == k)

    def number(self, v: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """The numbers in whose intervals v lies: the shares of the lower and of the higher guess are taken out of v."""
        g1, g2, m0, m1, m2 = found
        a, b = np.minimum(g1, g2), np.maximum(g1, g2)
        of_a = m2 + (m1 - m2) * (g1 <= g2)
        v = v - np.minimum(np.maximum(v - m0 * self.low.take(a), 0), of_a)
        v -= np.minimum(np.maximum(v - m0 * self.low.take(b), 0), m1 + m2 - of_a)
        return self.holder.take((v / m0).astype(np.int64))

    def learn(self, done: np.ndarray, start: int, end: int, short: int) -> None:
        """Take up the steps start to end of all lanes, of the last one those below ``short``; ``done`` has two rows of zeros and a
        row for each step."""
        part = done[start : end + 2]
        before, last, k = part[:-2].ravel(), part[1:-1].ravel(), part[2:].ravel()
        if short < end:
            coded = np.ones((end - start, done.shape[1]), bool)
            coded[max(0, short - start) :, -1] = False
            before, last, k = (x[coded.ravel()] for x in (before, last, k))
        pair = self.pair(before, last)
        g1, g2, cell = self._cell(last, pair)
        hit2 = g2 == k
        self.cells >>= 1
        for row, some in zip(self.cells, (cell, cell[(g1 == k) & ~hit2], cell[hit2]), strict=True):
            row += np.bincount(some, minlength=512)
        for i, at in enumerate((last, pair)):
            table, guess = self.tables[i], self.tables[i] >> 4
            good, size = guess.take(at) == k, len(guess)
            n, now = np.bincount(at, minlength=size), np.bincount(at[good], minlength=size)
            at, other = at[~good], k[~good]
            guess[at] = other  # of several the last one stays
            new = np.bincount(at[guess.take(at) == other], minlength=size)
            tries, held = self.tries[i] + n, self.held[i] + now
            swap = new * tries > held * n
            self.tries[i], self.held[i] = tries, held = np.where(swap, n, tries), np.where(swap, new, held)
            rank = np.where(tries > 0, 1 + 14 * (2 * held + 1) // (2 * tries + 2), 0)
            table[:] = (np.where(swap, guess, table >> 4) << 4) + rank
        self.counts += np.bincount(k, minlength=len(self.counts))
        self._counted(self.counts)
        self._weighed()


class _Coder:
    """State of the range coder of all lanes; ``words`` receives or holds the output of each lane from ``at`` on."""

    def __init__(self, words: np.ndarray, at: np.ndarray, scale: int):
        lanes = len(at)
        self.words, self.at, self.scale, self.most = words, at, _U(scale), _U((1 << scale) - 1)
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)

    def read(self) -> None:
        """Start decoding: ``ahead`` is the code read so far less ``low``."""
        self.ahead = (self.words[self.at].astype(_U) << _32) | self.words[self.at + 1].astype(_U)
        self.at = self.at + 2

    def value(self, lanes) -> np.ndarray:
        self.part = self.range[lanes] >> self.scale
        return np.minimum(self.ahead[lanes] // self.part, self.most).view(np.int64)

    def narrow(self, lanes, low: np.ndarray, size: np.ndarray, decode: bool = False) -> None:
        part = self.part if decode else self.range[lanes] >> self.scale
        by = part * low.view(_U)
        self.low[lanes] += by
        self.range[lanes] = part * size.view(_U)
        if decode:
            self.ahead[lanes] -= by
        small = np.flatnonzero(self.range <= _LOW)
        if len(small):
            lo, rg = self.low[small], self.range[small]
            rg = np.where((lo ^ (lo + rg)) > _LOW, (~lo + _U(1)) & _LOW, rg)  # up to the end of the word, if it crosses it
            at = self.at[small]
            if decode:
                self.ahead[small] = (self.ahead[small] << _32) | self.words[at].astype(_U)
            else:
                self.words[at] = lo >> _32
            self.at[small] = at + 1
            self.low[small], self.range[small] = lo << _32, rg << _32

    def close(self) -> None:
        """The two words that the decoder holds in the end."""
        for word in (self.low >> _32, self.low & _LOW):
            self.words[self.at] = word
            self.at += 1


def _encode(grid: np.ndarray, sizes: np.ndarray, n: int) -> list[bytes]:
    """The words of each block (row of grid) of numbers below n; all blocks but the last are full."""
    count, block = grid.shape
    steps, room = int(sizes[0]), 2 * block + 8
    done = np.zeros((steps + 2, count), np.int64)
    done[2:] = grid.T[:steps]
    model = _Model(n)
    coder = _Coder(np.zeros(count * room, np.uint32), np.arange(count) * room, model.scale)
    ends = sorted({*(x for x in REFRESH if x < steps), *range(_STEPS, steps, _STEPS), steps})
    start = learnt = 0
    for end in ends:
        k = done[start + 2 : end + 2]
        low, size = model.interval(k, model.predict(done[start:end], done[start + 1 : end + 1]))
        for i in range(end - start):
            m = count if start + i < sizes[-1] else count - 1
            coder.narrow(slice(0, m), low[i, :m], size[i, :m])
        if end in REFRESH and end < steps:
            model.learn(done, learnt, end, int(sizes[-1]))
            learnt = end
        start = end
    coder.close()
    return [coder.words[i * room : coder.at[i]].tobytes() for i in range(count)]


def _decode(sizes: np.ndarray, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The grid of numbers of blocks whose words begin at ``starts``."""
    count, steps, learnt = len(sizes), int(sizes[0]), 0
    done = np.zeros((steps + 2, count), np.int64)
    model = _Model(n)
    coder = _Coder(words, starts.copy(), model.scale)
    coder.read()
    for step in range(steps):
        m = count if step < sizes[-1] else count - 1
        found = model.predict(done[step, :m], done[step + 1, :m])
        done[step + 2, :m] = k = model.number(coder.value(slice(0, m)), found)
        coder.narrow(slice(0, m), *model.interval(k, found), True)
        if step + 1 in REFRESH and step + 1 < steps:
            model.learn(done, learnt, step + 1, int(sizes[-1]))
            learnt = step + 1
    return done[2:].T


def write_segment(documents: list[np.ndarray], block: int = BLOCK, lanes: int = LANES) -> bytes:
    """Documents, each an array of ids, as one segment."""
    stream = np.concatenate(documents).astype("<u4") if documents else np.zeros(0, "<u4")
    used = np.flatnonzero(np.bincount(stream, minlength=1)) if len(stream) and int(stream.max()) < 1 << 24 else stream[:0]
    if len(used) == 0 < len(stream):
        raise ValueError("ids must be below 2**24")
    number = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.int64)
    number[used] = np.arange(len(used))
    alphabet = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes())
    coded, table = [], []
    for a in range(0, len(stream), block * lanes):
        part = stream[a : a + block * lanes]
        count = -(-len(part) // block)
        sizes = np.full(count, block)
        sizes[-1] = len(part) - block * (count - 1)
        grid = np.zeros(count * block, np.int64)
        grid[: len(part)] = number[part]
        coded += (words := _encode(grid.reshape(count, block), sizes, len(used)))
        for i, (n, w) in enumerate(zip(sizes.tolist(), words, strict=True)):
            table += (n, len(w) // 4, zlib.crc32(part[i * block : i * block + n].tobytes()))
    head = struct.pack("<4s6I", _MAGIC, _VERSION, len(documents), len(coded), len(stream), block, len(alphabet))
    sizes = np.asarray([len(d) for d in documents], "<u4").tobytes()
    return b"".join([head, alphabet, sizes, np.asarray(table, "<u4").tobytes(), *coded])


def read_segment(payload: bytes, lanes: int = LANES) -> list[np.ndarray]:
    """The documents of a segment; raises ValueError if a block's ids do not have its checksum."""
    magic, version, documents, blocks, ids, block, wide = struct.unpack_from("<4s6I", payload)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a token segment")
    at = 28 + wide
    try:
        used = np.cumsum(np.frombuffer(zlib.decompress(payload[28:at]), "<u4").astype(np.int64)).astype("<u4")
    except zlib.error as e:
        raise ValueError("the alphabet is damaged") from e
    sizes = np.frombuffer(payload, "<u4", documents, at).astype(np.int64)
    at += 4 * documents
    table = np.frombuffer(payload, "<u4", 3 * blocks, at).reshape(blocks, 3).astype(np.int64)
    at += 12 * blocks
    words = np.concatenate([np.frombuffer(payload, "<u4", int(table[:, 1].sum()), at), np.zeros(8, np.uint32)])
    starts = np.cumsum(table[:, 1]) - table[:, 1]
    # damage may make a lane read on past its own words; it stays within the segment's
    padded = np.concatenate([words, np.zeros(2 * block + 8, np.uint32)])
    stream = []
    for a in range(0, blocks, lanes):
        part = table[a : a + lanes]
        grid = used[_decode(part[:, 0], padded, starts[a : a + lanes], len(used))]
        for i, (n, _, crc) in enumerate(part.tolist()):
            one = grid[i, :n]
            if zlib.crc32(one.tobytes()) != crc:
                raise ValueError(f"block {a + i} is damaged")
            stream.append(one)
    whole = np.concatenate(stream) if stream else np.zeros(0, "<u4")
    if len(whole) != ids:
        raise ValueError("a segment has other ids than it says")
    return np.split(whole, np.cumsum(sizes)[:-1]) if documents else []


# ---- tables ------------------------------------------------------------------------------------------------------------

_FILE = "part int, seq int, before long, n_ids long, doc_ids array<bigint>, payload binary"


def _writer(path: str, words: bool) -> Callable:
    from pyspark import TaskContext

    end = np.asarray([END_ID], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, seq, before = library_units(path, words), TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        total = 0

        def segment() -> pa.RecordBatch:
            row = {"part": [part], "seq": [seq], "before": [before], "n_ids": [total], "doc_ids": [names], "payload": [write_segment(held)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in slices([len(t) for t in texts], TEXT_BYTES):
                ids, first = library.encode(texts[a:b])
                for i, name in enumerate(doc_ids[a:b]):
                    one = np.concatenate([ids[first[i] : first[i + 1]], end])
                    names.append(name)
                    held.append(one)
                    total += len(one)
                    if total >= SEGMENT_IDS:
                        yield segment()
                        names, held, before, total, seq = [], [], before + total, 0, seq + 1
        if held:
            yield segment()
        names, held = [], []
        given_back()

    return run


def write_tokens(docs: DataFrame, path: str, words: bool = True) -> DataFrame:
    """Encode all documents in ascending doc_id order, write the segments to the shared folder, return the stored table."""
    ordered = documents_only(docs).repartitionByRange("doc_id", "row_hash").sortWithinPartitions("doc_id", "row_hash")
    return durable(ordered.select("doc_id", "text").mapInArrow(_writer(path, words), schema(_FILE)))


def read_tokens(stored: DataFrame) -> DataFrame:
    """doc_id, start, ids binary (little-endian 32-bit) of every stored document."""
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a task that wrote
    base, starts = 0, {}
    for r in sums:
        starts[r.part], base = base, base + r.n
    known = stored.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_units.cache_clear()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("part", "before", "doc_ids", "payload")}
                documents = read_segment(row["payload"])
                sizes = np.asarray([len(d) for d in documents], np.int64)
                begin = known.value[row["part"]] + row["before"] + np.cumsum(sizes) - sizes
                for a, b in slices((4 * sizes).tolist(), TEXT_BYTES):
                    held = pa.array([d.tobytes() for d in documents[a:b]], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(begin[a:b]), held], ["doc_id", "start", "ids"])

    return stored.select("part", "before", "doc_ids", "payload").mapInArrow(run, schema("doc_id long, start long, ids binary"))


def token_digest(docs: DataFrame, path: str, words: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored files."""
    found = read_tokens(write_tokens(docs, path, words))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
