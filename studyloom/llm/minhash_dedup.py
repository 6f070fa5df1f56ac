"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words ``[^\\x20\\x09-\\x0D]+`` (all words of a shorter document). A shingle weighs its count
in the document times the mean inverse document frequency of its words; frequencies are counted over all documents in
``DF_SLOTS`` hashed slots, so what is broadcast is bounded. (Frequencies of whole shingles would make the text of a large
group of copies nearly weightless against its few edits, and hide the group.) Each document gets ``BANDS * ROWS`` improved
consistent weighted samples; documents whose samples agree in a band are candidates, and a link needs a weighted Jaccard
similarity of ``THRESHOLD`` or more, computed from the texts.

Copies of one text are a class that goes through once. Within a band's bucket the samples of two classes tell roughly how
similar they are; pairs far below the threshold are no candidates. Each bucket has a hub, its class with most company in all
bands, and the candidates (hub, member) are verified first, which joins a group of copies at a cost linear in its size.
Members of a bucket that do not hang together by then are compared with those of the other labels by samples, in blocks; the
candidates that are left make groups, and each group's texts are compared in blocks of bounded bytes and rows, by matrix
products over (shingle, occurrence) features that give the weighted intersection exactly. So every candidate pair is
verified or lies within one component, and a block yields no more links than keep its components. Keys
with many rows (buckets, hubs, copies of a text) are joined by broadcast, as there are few of them, or cut into blocks.

Defined results: null or empty texts have no shingles and are their own group; rows of a null doc_id have a null group and
are not kept by the digest (the stage keeps them); repeated rows are copies; an empty table gives an empty result; other
columns are ignored by the digest and carried along by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, documents_only, dropped, durable, fresh, mix, schema, slices, spread_join
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
DF_SLOTS = 1 << 18
CANDIDATE, BUCKET_BLOCK, BLOCK, GROUP_ROWS, GROUP_BYTES = 0.55, 512, 128, 1024, 2 << 20
_SHIFT = np.uint64(64 - 18)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


# ---- weights -----------------------------------------------------------------------------------------------------------


def word_frequencies(base: DataFrame) -> np.ndarray:
    """Documents that hold a word of each hashed slot, and as last value the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DF_SLOTS + 1, np.int64)
        for batch in batches:
            texts = _texts(batch)
            total[-1] += len(texts)
            for a, b in slices([len(t) for t in texts]):
                words = Words(texts[a:b])
                doc = np.repeat(np.arange(b - a), np.diff(words.first))
                pair = np.unique(doc * DF_SLOTS + (words.hash >> _SHIFT).astype(np.int64))
                total[:-1] += np.bincount(pair % DF_SLOTS, minlength=DF_SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    rows = base.select("text").mapInArrow(count, schema("slot long, n long")).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most DF_SLOTS + 1 rows
    out = np.zeros(DF_SLOTS + 1, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def inverse(frequencies: np.ndarray) -> np.ndarray:
    return (1.0 + np.log((1.0 + frequencies[-1]) / (1.0 + frequencies[:-1]))).astype(np.float32)


def shingles(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle of each document and the end, shingle hashes in ascending order, counts, inverse frequencies)."""
    words = Words(texts)
    n = np.diff(words.first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + words.first[:-1][doc]
    end = np.minimum(start + SHINGLE, words.first[1:][doc])
    hashed = Rolling(words.hash).of(start, end)
    sums = np.concatenate([[0.0], np.cumsum(idf[(words.hash >> _SHIFT).astype(np.int64)], dtype=np.float64)])
    mean = (sums[end] - sums[start]) / np.maximum(end - start, 1)
    order = np.lexsort((hashed, doc))
    hashed, doc, mean = hashed[order], doc[order], mean[order]
    new = np.flatnonzero(np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(doc)]]))
    return np.searchsorted(doc[new], np.arange(len(texts) + 1)), hashed[new], count, np.round(mean[new], 4)


# ---- samples -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) (as such, inverse and logarithm) and of the uniform distribution, 4096 each."""
    u = (np.arange(4096) + 0.5) / 4096
    low, high = np.zeros(4096), np.full(4096, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    g = ((low + high) / 2).astype(np.float32)
    return g, (1 / g).astype(np.float32), np.log(g).astype(np.float32), u.astype(np.float32)


def samples(first: np.ndarray, hashed: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row of SAMPLES consistent weighted samples (64-bit) for each document that has shingles, zeros for others.

    For shingle weight S with r, c ~ Gamma(2, 1) and b ~ U(0, 1): t = floor(ln S / r + b); the sample is the (shingle, t)
    of least ln c - r * (t - b + 1)."""
    gamma, inverse_gamma, log_gamma, uniform = _tables()
    out = np.zeros((len(first) - 1, SAMPLES), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    starts, counts = first[full], np.diff(first)[full]
    log_s = np.log(weight).astype(np.float32)
    seeds = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, (SAMPLES, 2), dtype=np.uint64)
    row = np.arange(len(full))
    of = np.repeat(row, counts)
    for k in range(SAMPLES):
        x = (hashed ^ seeds[k, 1]) * (seeds[k, 0] | np.uint64(1))
        r, c, b = (x >> np.uint64(52)).astype(np.int32), ((x >> np.uint64(40)) & np.uint64(4095)).astype(np.int32), ((x >> np.uint64(28)) & np.uint64(4095)).astype(np.int32)
        beta = uniform[b]
        t = np.floor(log_s * inverse_gamma[r] + beta)
        a = log_gamma[c] - gamma[r] * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[of])
        at = at[np.searchsorted(of[at], row)]
        out[full, k] = mix(hashed[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


_SKETCH = "doc_id long, row_hash long, ckey binary, bands array<bigint>, sketch binary"


def _sketches(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in slices([len(t) for t in texts], 1 << 20):
                first, hashed, count, rare = shingles(texts[a:b], idf.value)
                got = samples(first, hashed, count * rare)
                bands = got.reshape(len(got), BANDS, ROWS)
                keys = np.zeros((len(got), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for i in range(ROWS):
                    keys = mix(keys * np.uint64(31) + bands[:, :, i])
                has = np.diff(first) > 0
                flat = pa.array(keys.view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, BANDS, dtype=np.int32)), flat, mask=pa.array(~has))
                short = (got & np.uint64(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "row_hash", "ckey")), lists, pa.array([x.tobytes() for x in short], pa.binary())],
                    ["doc_id", "row_hash", "ckey", "bands", "sketch"],
                )

    return run


# ---- candidates --------------------------------------------------------------------------------------------------------


def _node(doc_id, ckey):
    """Binary name of a class: its doc_id, so that names sort by it, and the hash of its text."""
    signed = F.hex(doc_id.bitwiseXOR(F.lit(-(2**63))))
    return F.concat(F.unhex(F.lpad(signed, 16, "0")), ckey)


def _doc_of(node):
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(c[s].as_py() for c in columns)
            if held and here != name:
                yield pa.Table.from_batches(held)
                held = []
            name = here
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _forest(names: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Of the pairs of places a, b in ``names``, enough to keep their components."""
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            left.append(names[i])
            right.append(names[j])
    return _pairs(left, right)


def _blocks(left: DataFrame, right: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of both sides (role 0 and 1) sent to every pair (i, j) of their blocks within each key, next to each other."""
    size = [side.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias(name)) for side, name in ((left, "ls"), (right, "rs"))]
    sizes = size[0].join(size[1], key).withColumn("n", F.lit(0))
    rows = []
    for side, own, other, role in ((left, "ls", "rs", 0), (right, "rs", "ls", 1)):
        held = side.join(sizes.drop("n"), key)
        placed = held.withColumns({"own": F.pmod(F.xxhash64("node"), F.col(own)).cast("int"), "t": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        i, j = ("own", "t") if role == 0 else ("t", "own")
        rows.append(placed.select(key, F.col(i).alias("i"), F.col(j).alias("j"), F.lit(role).alias("role"), *[c for c in side.columns if c != key]))
    return rows[0].unionByName(rows[1]).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the two sides of a bucket's blocks that have different labels and whose samples agree enough; as many as keep
    their components."""
    for g in _groups(batches, ["bucket", "i", "j"]):
        names, labels = g.column("node").to_pylist(), np.unique(np.asarray(g.column("label").to_pylist(), object), return_inverse=True)[1]
        role = g.column("role").to_numpy()
        marks = np.frombuffer(b"".join(g.column("sketch").to_pylist()), "<u2").reshape(len(names), SAMPLES)
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        near = [right[((marks[right] == marks[k]).sum(axis=1) >= CANDIDATE * SAMPLES) & (labels[right] != labels[k])] for k in left.tolist()]
        yield _forest(names, np.repeat(left, [len(x) for x in near]), np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64))


# ---- verification ------------------------------------------------------------------------------------------------------


class Shingled:
    """The (shingle, occurrence) features of some documents: the n-th occurrence of a shingle is a feature of its own, so that
    common features make up the smaller count."""

    def __init__(self, texts: list[bytes], idf: np.ndarray):
        doc, feature, rare = [], [], []
        for s, e in slices([len(t) for t in texts], 1 << 20):
            first, hashed, count, weight = shingles(texts[s:e], idf)
            of = np.repeat(np.arange(s, e), np.diff(first))
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            doc.append(np.repeat(of, count))
            feature.append(mix(np.repeat(hashed, count) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            rare.append(np.repeat(weight, count))
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self.feature = np.concatenate(feature) if feature else np.zeros(0, np.uint64)
        self.rare = np.concatenate(rare) if rare else np.zeros(0)
        self.total = np.bincount(self.doc, self.rare, minlength=len(texts))


def similarities(texts: Shingled, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of each left document with each right one, by a matrix product over the features that both
    sides have, ``width`` of them at a time."""
    row = np.full(len(texts.total), -1)
    row[left] = np.arange(len(left))
    column = np.full(len(texts.total), -1)
    column[right] = np.arange(len(right))
    of_left, of_right = row[texts.doc] >= 0, column[texts.doc] >= 0
    common = np.intersect1d(texts.feature[of_left], texts.feature[of_right])
    both = np.zeros((len(left), len(right)))
    at = np.minimum(np.searchsorted(common, texts.feature), max(len(common) - 1, 0))
    has = common[at] == texts.feature if len(common) else np.zeros(len(at), bool)
    for s in range(0, len(common), width):
        some = has & (at >= s) & (at < s + width)
        a, b = np.zeros((len(left), width)), np.zeros((len(right), width))
        x, y = some & of_left, some & of_right
        a[row[texts.doc[x]], at[x] - s] = texts.rare[x]
        b[column[texts.doc[y]], at[y] - s] = 1.0
        both += a @ b.T
    union = texts.total[left][:, None] + texts.total[right][None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def _linked(idf):
    """Links of role 0, a single text, with role 1 in each block. The texts that link with it hang on the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["a", "block"]):
            role, names = g.column("role").to_numpy(), g.column("b").to_pylist()
            left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(left) or not len(right):
                continue
            texts = Shingled([t or b"" for t in g.column("text").cast(pa.binary()).to_pylist()], idf.value)
            close = right[similarities(texts, left[:1], right)[0] >= THRESHOLD - 1e-12].tolist()
            if close:
                yield _pairs([g.column("a")[0].as_py()] + [names[close[0]]] * (len(close) - 1), [names[k] for k in close])

    return run


def _verified(pairs: DataFrame, base: DataFrame, idf) -> DataFrame:
    """a, b: links that connect what the pairs (a, b) of a similarity of ``THRESHOLD`` or more connect. A text is sent once for
    each pair as b, and once for each block of pairs as a."""
    each = pairs.select("a", "b")
    size = each.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    each = durable(spread_join(each, size, "a", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")))
    need = each.select(F.col("b").alias("node")).unionByName(each.select(F.col("a").alias("node"))).distinct()
    texts = durable(base.join(need.hint("merge"), "node", "left_semi").dropDuplicates(["node"]).select("node", "text"))
    ones = each.select("a", "block").distinct().select("a", "block", F.lit(0).alias("role"), F.col("a").alias("b"))
    sent = ones.unionByName(each.select("a", "block", F.lit(1).alias("role"), "b")).join(texts.hint("merge"), F.col("b") == F.col("node"))
    sent = sent.select("a", "block", "role", "b", "text").repartition("a", "block").sortWithinPartitions("a", "block")
    found = durable(sent.mapInArrow(_linked(idf), schema("a binary, b binary")))
    dropped(each, texts)
    return found


def _compared(idf):
    """Links between the texts of two blocks of a group, or of one block with itself, that have different labels; as many as
    keep their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["cand", "i", "j"]):
            role, names = g.column("role").to_numpy(), g.column("node").to_pylist()
            labels = np.unique(np.asarray(g.column("label").to_pylist(), object), return_inverse=True)[1]
            same = g.column("i")[0].as_py() == g.column("j")[0].as_py()
            left = np.arange(len(names)) if same else np.flatnonzero(role == 0)
            right = left if same else np.flatnonzero(role == 1)
            if not len(left) or not len(right) or (labels == labels[0]).all():
                continue
            texts = Shingled([t or b"" for t in g.column("text").cast(pa.binary()).to_pylist()], idf.value)
            close = similarities(texts, left, right) >= THRESHOLD - 1e-12
            a, b = np.nonzero(close & (labels[left][:, None] != labels[right][None, :]))
            yield _forest(names, left[a], right[b])

    return run


def _in_groups(pairs: DataFrame, label: DataFrame, base: DataFrame, idf) -> DataFrame:
    """a, b: links within each group that the candidate pairs make, by matrix products of its blocks of bounded bytes and rows."""
    group = durable(components(pairs).select("node", F.col("component").alias("cand")))
    texts = base.join(group.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]).select("node", "text")
    members = group.join(label, "node", "left").select("cand", "node", F.coalesce("component", "node").alias("label")).join(texts.hint("merge"), "node")
    members = durable(members)
    blocks = F.ceil(F.greatest(F.sum(F.octet_length("text")) / GROUP_BYTES, F.count("*") / GROUP_ROWS)).cast("int")
    sizes = members.groupBy("cand").agg(blocks.alias("blocks"), F.count("*").alias("n"))
    placed = spread_join(members, sizes, "cand", members.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("cand", F.least("block", "t").alias("i"), F.greatest("block", "t").alias("j"), (F.col("t") < F.col("block")).cast("int").alias("role"), "node", "label", "text")
    found = durable(sent.repartition("cand", "i", "j").sortWithinPartitions("cand", "i", "j").mapInArrow(_compared(idf), schema("a binary, b binary")))
    dropped(group, members)
    return found


def linked(classes: DataFrame, base: DataFrame, idf) -> DataFrame:
    """node, component of all classes that have links."""
    total = classes.count() * BANDS
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    full = durable(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    held = spread_join(entries, full.withColumn("size", F.col("n")), "bucket", total)
    popular = held.groupBy("node").agg(F.sum("size").alias("popular"))
    held = durable(held.join(popular, "node").join(classes.select("node", "sketch").hint("merge"), "node"))
    # the hub of a bucket is its member with most company in all bands
    hubs = held.groupBy("bucket").agg(F.max(F.struct("popular", "node", "sketch")).alias("h"), F.count("*").alias("n"))
    hubs = durable(hubs.select("bucket", "n", F.col("h.node").alias("a"), F.col("h.sketch").alias("hub_sketch")))
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: F.substring("sketch", 2 * k + 1, 2) == F.substring("hub_sketch", 2 * k + 1, 2)))
    near = spread_join(held.select("bucket", "node", "sketch"), hubs, "bucket", held.count()).where("node <> a")
    first = durable(near.where(agree >= CANDIDATE * SAMPLES).select("a", F.col("node").alias("b")).distinct())
    found = _verified(first, base, idf)
    label = durable(components(found))
    # what is left of a bucket: members that do not hang together, compared with those of other labels
    now = held.select("bucket", "node", "sketch").join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    now = durable(now)
    sizes = now.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels"), F.sum("k").alias("n"))
    main = durable(main.where("labels > 1").select("bucket", F.col("m.label").alias("main"), "n"))
    open_ = durable(spread_join(now, main, "bucket", now.count()))
    if open_.isEmpty():
        dropped(full, held, hubs, first, found, now, main, open_)
        return label
    minor = open_.where("label <> main").drop("main")
    pairs = durable(_blocks(minor, open_.drop("main"), "bucket", BUCKET_BLOCK).mapInArrow(_alike, schema("a binary, b binary")))
    if not pairs.isEmpty():
        more = _in_groups(pairs, label, base, idf)
        label = durable(components(more.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    dropped(full, held, hubs, first, found, now, main, open_, pairs)
    return label


def _of_one_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes that hold texts of one doc_id, each with the first of that id; nothing where ids have one text each."""
    held = named.where("ckey is not null").select("doc_id", "ckey").distinct()
    several = held.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ckey").alias("lead")).where("n > 1")
    several = durable(several)
    if several.isEmpty():
        return several.select(F.col("lead").alias("a"), F.col("lead").alias("b"))
    edges = spread_join(held, several, "doc_id", held.count()).where("ckey <> lead").select("lead", "ckey").distinct()
    name = lambda key, as_: classes.select(F.col("ckey").alias(key), F.col("node").alias(as_))
    sizes = edges.groupBy("lead").agg(F.count("*").alias("n")).join(name("lead", "a"), "lead")
    return spread_join(edges, sizes, "lead", edges.count()).join(name("ckey", "b").hint("merge"), "ckey").select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, class_id (smallest doc_id of the same text), group_id (smallest doc_id reachable by links) of every
    row."""
    spark = docs.sparkSession
    base = documents_only(docs).withColumn("ckey", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    idf = spark.sparkContext.broadcast(inverse(word_frequencies(base)))
    rows = durable(base.mapInArrow(_sketches(idf), schema(_SKETCH)))
    key = F.when(F.col("doc_id").isNotNull() & F.col("bands").isNotNull(), F.col("ckey"))
    named = rows.select("doc_id", "row_hash", key.alias("ckey"), "bands", "sketch")
    first = F.min(F.struct("doc_id", "bands", "sketch")).alias("x")
    classes = named.where("ckey is not null").groupBy("ckey").agg(first, F.count("*").alias("n"))
    classes = durable(classes.select("ckey", "n", F.col("x.doc_id").alias("rep_id"), _node(F.col("x.doc_id"), F.col("ckey")).alias("node"), "x.bands", "x.sketch"))
    label = linked(classes, base.withColumn("node", _node(F.col("doc_id"), F.col("ckey"))), idf)
    # an id with several texts: whatever one of them reaches, the id reaches
    more = _of_one_id(named, classes)
    if not more.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    per = classes.select("ckey", "n", "rep_id", "node").join(label, "node", "left")
    per = durable(per.select("ckey", "n", "rep_id", _doc_of(F.coalesce("component", "node")).alias("component")))
    out = spread_join(named.select("doc_id", "row_hash", "ckey"), per, "ckey", rows.count(), "left")
    return out.select("doc_id", "row_hash", F.coalesce("rep_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("group_id"))


def near_digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, group_id, kept (the document of its group with the smallest doc_id)."""
    out = groups(docs).select("doc_id", "class_id", "group_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(False)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one row of each group: of the smallest doc_id, and of its rows the one of the
    smallest text hash. Rows of a null doc_id stay."""
    columns = docs.columns
    row, ident, keep = (fresh(x, columns) for x in ("row_hash", "ident", "keep"))
    good = groups(docs).where("doc_id = group_id").groupBy("doc_id").agg(F.min("row_hash").alias(keep)).withColumnRenamed("doc_id", ident)
    keyed = docs.withColumns({ident: F.col("doc_id").cast("long"), row: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = keyed.join(good, ident).where(F.col(row) == F.col(keep)).dropDuplicates([ident])
    return kept.select(*columns).unionByName(docs.where("doc_id is null"))
