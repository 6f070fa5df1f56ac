"""Trie of conversation prefixes, totals by leaf-peeling message passing.

A node is a distinct sequence of first turns; its key is a rolling hash (128 bits) of the turns' hashes, so that all nodes
come out of one grouping and no text is compared along a path. The running hashes along a conversation are made over range
partitions, whose totals are carried on to the next (:func:`running`), so a conversation may have any share of all turns.

Totals go up from the leaves. Every node belongs to the path of one of its members, its owner: the member with the least hash
of its id. Owners do not change but where they end or leave, so the nodes of an owner are a path downwards, and as their
order is random, a way from the root to a leaf meets about as many paths as the logarithm of the members, however deep it
is. A path holds a counter of the nodes below it that are not complete; in each round the paths whose counter is zero
complete, node by node from the end to the top, and send the totals of the top to the parent, which lies on another path;
messages to a path are added up first and lower its counter. Rounds end when only the root's path is left and complete. What
each node got is then added up along the paths.

Defined results: rows of a null conv_id are no conversation; a null role or text is empty; turns of equal number are ordered
by role and text; repeated rows are turns of their own; a conversation without turns of its own in the table does not
exist; an empty table gives no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASES, dropped, durable, powers, schema, spread_join

GROUP, HEADS, ENDS = 20, 4, 12


def _along(values: np.ndarray, start: np.ndarray, base: int) -> np.ndarray:
    """For each place the sum of base**(i - j) * values[j] over the j from the start of its run to i, modulo 2**64."""
    if base == 1:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        return sums[1:] - sums[start]
    up, down = powers(base).get(len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down)])
    return (sums[1:] - sums[start]) * up


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**exponents modulo 2**64, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * np.uint64(square), out)
        square, left = square * square % 2**64, left >> 1
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _replaced(batch: pa.RecordBatch, new: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = list(batch.schema.names) + [n for n in new if n not in batch.schema.names]
    made = {n: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for n, v in new.items()}
    return pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, int], place: str = "at") -> DataFrame:
    """``df`` with ``place``, the place of a row among those of its key in the given order, and each column of ``values`` (name:
    base; non-null longs) replaced by its running sum modulo 2**64, in which what came before is multiplied by the base once
    a row. A key may span many tasks: each task makes its own sums and hands its last key's on through the driver, one row
    a task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count, state = TaskContext.get().partitionId(), None, 0, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = _column(batch, key)
            new = np.append(True, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            at = np.arange(n) - start
            carried = (start == 0) & (keys[0] == last)
            made = {}
            for name, base in values.items():
                out = _along(_column(batch, name).view(np.uint64), start, base)
                if carried.any():
                    out = np.where(carried, out + state[name] * _power(base, at + 1), out)
                made[name], state[name] = out, out[-1]
            at = np.where(carried, at + count, at)
            last, count = keys[-1], int(at[-1]) + 1
            yield _replaced(batch, made | {place: at, "part": np.full(n, part, np.int64)})

    more = T.StructType([*df.schema.fields, *schema(f"{place} long, part long").fields])
    sorted_ = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    once = durable(sorted_.mapInArrow(local, more))
    last = F.max_by(F.struct(place, *values), F.struct(key, place))
    ends = once.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), last.alias("tail")).orderBy("part").collect()  # a row a task
    carry: dict[int, tuple] = {}
    held: tuple | None = None  # key, rows, sums of the key that the tasks so far ended in
    for row in ends:
        n, sums = row.tail[place] + 1, {v: row.tail[v] % 2**64 for v in values}
        same = held is not None and held[0] == row["first"]
        if same:
            carry[row.part] = held
        if same and row["first"] == row["last"]:
            sums = {v: (sums[v] + held[2][v] * pow(base, n, 2**64)) % 2**64 for v, base in values.items()}
            n += held[1]
        held = row["last"], n, sums

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, at = (_column(batch, c) for c in (key, "part", place))
            made = {v: _column(batch, v).view(np.uint64).copy() for v in values}
            moved = at.copy()
            for part in np.unique(parts).tolist():
                if part in carry:
                    name, n, sums = carry[part]
                    rows = np.flatnonzero((parts == part) & (keys == name))
                    for v, base in values.items():
                        made[v][rows] += np.uint64(sums[v]) * _power(base, at[rows] + 1)
                    moved[rows] += n
            yield _replaced(batch, made | {place: moved})

    return once.mapInArrow(joined, more).drop("part") if carry else once.drop("part")


def _turns(talks: DataFrame) -> DataFrame:
    """conv_id, at, two hashes of role and text, words: each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    hashes = [F.xxhash64("role", "text").alias("v1"), F.xxhash64("text", F.lit("turn"), "role").alias("v2")]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    return durable(running(rows, "conv_id", order, {}).select("conv_id", "at", *hashes, words))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, place, v1, v2, words: the first h turns of the group's first conversation, then the own ones after h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    convs = turns.where("at = 0").select("conv_id", base.alias("base"), h.alias("h"))
    lead = turns.where((F.col("at") < heads - 1) & (F.pmod("conv_id", F.lit(group)) == 0)).select(F.col("conv_id").alias("base"), "at", "v1", "v2", "words")
    shared = convs.join(lead, "base").where("at < h").select("conv_id", F.lit(0).alias("own"), "at", "v1", "v2", "words")
    return shared.unionByName(turns.where(F.col("at") >= h).select("conv_id", F.lit(1).alias("own"), "at", "v1", "v2", "words"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 of rows (key, ids) that come key by key in order; one hash is open at a time."""
    name, open_ = None, None
    for batch in batches:
        out: list[tuple] = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != name:
                if open_ is not None:
                    out.append((name, open_.hexdigest()))
                name, open_ = key, hashlib.sha256(ids.encode())
            else:
                open_.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["key", "ends_sha256"])
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([open_.hexdigest()])], ["key", "ends_sha256"])


def _key(depth: Column, one: Column, two: Column) -> Column:
    return F.concat_ws(":", depth, one, two)


def _ends(convs: DataFrame, last: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes that conversations end at. Ids are joined within ranges of 2**ENDS ids first."""
    key = _key(F.coalesce("depth", F.lit(0)), F.coalesce("p1", F.lit(0)), F.coalesce("p2", F.lit(0)))
    at = convs.join(last, "conv_id", "left").select(key.alias("key"), "conv_id", F.shiftright("conv_id", ENDS).alias("range"))
    some = at.groupBy("key", "range").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = some.repartition("key").sortWithinPartitions("key", "range")
    return ordered.select("key", "ids").mapInArrow(_digests, schema("key string, ends_sha256 string"))


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q1, q2: the running hashes p1, p2 as they were before the row's own v1, v2."""
    for batch in batches:
        made = {}
        for name, base in zip("12", BASES, strict=True):
            p, v = (_column(batch, c + name).view(np.uint64) for c in "pv")
            made["q" + name] = (p - v) * np.uint64(pow(base, -1, 2**64))
        yield _replaced(batch, made)


def _nodes(talks: DataFrame, group: int, heads: int) -> DataFrame:
    """All nodes: key, parent_key (null at the root), conv_id, owner, depth, n_convs, own (tokens saved at the node itself),
    ends_sha256."""
    turns = _turns(talks)
    placed = rebuilt(turns, group, heads).withColumns({"p1": F.col("v1"), "p2": F.col("v2")})
    chained = running(placed, "conv_id", [F.col("own"), F.col("at")], {"p1": BASES[0], "p2": BASES[1]}, "depth")
    chained = chained.select("conv_id", "v1", "v2", "p1", "p2", "words", (F.col("depth") + 1).alias("depth"))
    prefixes = durable(chained.mapInArrow(_before, T.StructType([*chained.schema.fields, *schema("q1 long, q2 long").fields])))
    convs = turns.where("at = 0").select("conv_id")
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("depth", "p1", "p2"), "depth").alias("x")).select("conv_id", "x.*")
    ends = _ends(convs, last)
    zero = [F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "q1", "q2", "words")]
    members = prefixes.select("conv_id", "depth", "p1", "p2", "q1", "q2", "words").unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *zero))
    owner = F.min(F.struct(F.xxhash64("conv_id").alias("h"), F.col("conv_id").alias("c"))).getField("c")
    held = members.groupBy("depth", "p1", "p2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), owner.alias("owner"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("words").alias("words")
    )
    parent = F.when(F.col("depth") > 0, _key(F.col("depth") - 1, F.col("q1"), F.col("q2")))
    nodes = held.select(
        _key(F.col("depth"), F.col("p1"), F.col("p2")).alias("key"), parent.alias("parent_key"), "conv_id", "owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own")
    )
    out = durable(nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    dropped(turns, prefixes)
    return out


def _rounds(paths: DataFrame) -> list[DataFrame]:
    """Peel paths (owner, above, depth, leaves, saved, left) from the leaves; what each node was sent: owner, depth, leaves,
    saved."""
    sent = []
    now = durable(paths)
    while True:
        done = now.where("left = 0 and above is not null")
        message = done.groupBy(F.col("above").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n"))
        message = durable(message)
        if message.isEmpty():
            dropped(now, message)
            return sent
        sent.append(message)
        got = message.groupBy("owner").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("n").alias("n"))
        none = lambda c: F.coalesce(c, F.lit(0))
        after = now.where("left > 0 or above is null").join(got, "owner", "left")
        after = durable(after.select("owner", "above", "depth", (F.col("leaves") + none("l")).alias("leaves"), (F.col("saved") + none("s")).alias("saved"), (F.col("left") - none("n")).alias("left")))
        dropped(now)
        now = after


def trie(talks: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = _nodes(talks, group, heads)
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = durable(nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")))
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("owner").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = spread_join(nodes.where("depth > 0"), above, "parent_key", nodes.count())
    root = nodes.where("depth = 0").withColumns({"above": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    linked = durable(below.unionByName(root).drop("key", "parent_key"))
    dropped(nodes)
    # tops of paths: where the parent has another owner
    tops = linked.where("above is null or above <> owner").select("owner", "above", "depth")
    totals = linked.groupBy("owner").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    left = tops.where("above is not null").groupBy(F.col("above").alias("owner")).agg(F.count("*").alias("left"))
    paths = tops.join(totals, "owner").join(left, "owner", "left").withColumn("left", F.coalesce("left", F.lit(0)))
    sent = _rounds(paths)
    about = ("conv_id", "parent_conv_id", "n_convs", "n_children", "ends_sha256")
    got = linked.select("owner", "depth", F.col("leaf").alias("leaves"), F.col("own").alias("saved"), *about)
    for message in sent:
        got = got.unionByName(message.select("owner", "depth", "leaves", "saved"), allowMissingColumns=True)
    met = got.groupBy("owner", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *(F.max(c).alias(c) for c in about))
    out = running(met, "owner", [F.desc("depth")], {"leaves": 1, "saved": 1}, "place")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
