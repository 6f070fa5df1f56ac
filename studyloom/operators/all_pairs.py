"""Queries whose result is a row for each pair, or what all pairs together say. Their SQL is that of the plans.

Where each pair is a row of the result, both sides are cut into tiles within their project; a pair of tiles meets in one group,
which scores all its pairs with arrays, so a task holds two tiles and their pairs and any number of tasks can share the work.
Rows still grow with the product of both sides. Where only counts, distinct pairs or the least value are asked for, no pairs are
made: keys are counted, sides are made distinct before they meet."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lists import pairs
from ..plans import dialect
from ..plans.adapters import RUN_VIEWS
from ..session import stored
from . import pair_scores
from .pair_scores import _runs, _words
from .ranks import ranked

Run = Callable[[SparkSession, str], DataFrame]
#: Rows of a tile of each side, rows summed at a time, pairs of words held at a time.
TILE, STEP, HELD = 2048, 16, 1 << 22
#: Rows of a list of tiles at most; lists that a table is cut into if it has rows enough, where it meets itself and where it is the
#: left one of two; ids that repeat.
PACK, PARTS, LEFT_PARTS, RUN = 1 << 14, 12, 64, 512
#: Where ids of equal keys are linked: chunks of a block, blocks cut out of one list, pairs of a task; the columns of a key.
BLOCK, CUTS, TASK_PAIRS, KEY = 512, 32, 1 << 25, ["project_id", "section"]


def _sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.runner(text, RUN_VIEWS)(spark, sf_dir)


def _nulls(column: pa.ChunkedArray) -> np.ndarray:
    """Which vectors hold a null."""
    return np.array([c is None or None in c for c in column.to_pylist()]) if sum(c.flatten().null_count for c in column.chunks) or column.null_count else np.zeros(len(column), bool)


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> the rows that have a vector of it without nulls, and these vectors as doubles."""
    lengths = np.where(_nulls(column), -1, pc.fill_null(pc.list_value_length(column), -1).to_numpy())
    out = {}
    for width in sorted({*lengths.tolist()} - {-1}):
        held = column.filter(pa.array(lengths == width))
        flat = [np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in held.chunks)]
        out[width] = np.flatnonzero(lengths == width), np.concatenate(flat, dtype=float).reshape(len(held), width)
    return out


def _components(a: pa.ChunkedArray, b: pa.ChunkedArray, distance: bool) -> tuple[np.ndarray, np.ndarray]:
    """Inner products or distances of all pairs, summed component by component, and which of them are null."""
    out, none = np.zeros((len(a), len(b))), np.ones((len(a), len(b)), bool)
    right = _vectors(b)
    for width, (i, x) in _vectors(a).items():
        if width in right:
            j, y = right[width]
            out[np.ix_(i, j)], none[np.ix_(i, j)] = _summed(x, y, distance), False
    return out, none


def _summed(x: np.ndarray, y: np.ndarray, distance: bool) -> np.ndarray:
    begins = np.append(True, (x[1:] != x[:-1]).any(axis=1))
    if len(x) > begins.sum():  # equal ones next to each other once
        return _summed(x[begins], y, distance)[np.cumsum(begins) - 1]
    out = np.zeros((len(x), len(y)))
    y_columns, held = np.ascontiguousarray(y.T), np.empty((STEP, len(y)))
    for at in range(0, len(x), STEP):  # few rows at a time, so that sums stay near the processor
        part, total = x[at : at + STEP], out[at : at + STEP]
        term = held[: len(part)]
        for k in range(x.shape[1]):
            if distance:
                np.subtract(part[:, k, None], y_columns[k], out=term)
                np.multiply(term, term, out=term)
            else:
                np.multiply(part[:, k, None], y_columns[k], out=term)
            total += term
    return np.sqrt(out) if distance else out


def _word_counts(texts: pa.ChunkedArray, topics: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """How many words of over four characters of each topic each text contains, and which of the counts are null."""
    automaton, uses = _words([t or "" for t in topics.to_pylist()])
    out = np.zeros((len(texts), len(topics)), np.int64)
    if automaton is not None:
        for i, text in enumerate(texts):
            found = {k for _, k in automaton.iter(text.as_py() or "")}
            if found:
                out[i] = np.bincount(np.concatenate([uses[k] for k in found]), minlength=len(topics))
    return out, np.array(topics.is_null())[None, :] | np.array(texts.is_null())[:, None]


def _common(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """How many words of their lists (without repeats) all pairs have in common: words of many pairs by a product of matrices,
    the others by counting the pairs they are in."""
    n, m = len(a), len(b)
    lists = [pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in (a, b)]
    words = pa.chunked_array([c.flatten() for x in (a, b) for c in x.chunks], a.type.value_type).combine_chunks().dictionary_encode()
    words = pa.chunked_array([words]) if not isinstance(words, pa.ChunkedArray) else words
    codes = np.concatenate([c.indices.to_numpy() for c in words.chunks] or [np.zeros(0, np.int64)])
    left, right = codes[: lists[0].sum()], codes[lists[0].sum() :]
    row, column = np.repeat(np.arange(n, dtype=np.int32), lists[0]), np.repeat(np.arange(m, dtype=np.int32), lists[1])
    most = int(codes.max()) + 1 if len(codes) else 0
    of_left, of_right = np.bincount(left, minlength=most), np.bincount(right, minlength=most)
    out = np.zeros((n, m), np.float32 if len(codes) < 1 << 24 else np.float64)  # whole numbers, exact
    hot = np.flatnonzero(of_left * of_right > n * m / 256)
    place = np.full(most, -1)
    for at in range(0, len(hot), 512):
        some = hot[at : at + 512]
        place[:] = -1
        place[some] = np.arange(len(some))
        x, y = np.zeros((n, len(some)), np.float32), np.zeros((m, len(some)), np.float32)
        for matrix, line, word in ((x, row, place[left]), (y, column, place[right])):
            matrix[line[word >= 0], word[word >= 0]] = 1
        out += x @ y.T
    held = column[np.argsort(right, kind="stable")]
    begin = np.append(0, np.cumsum(of_right))
    rare = of_right > 0
    rare[hot] = False
    left, row = left[rare[left]], row[rare[left]]
    count = of_right[left]
    upto = np.cumsum(count)
    at = 0
    while at < len(left):  # rows that lie next to each other at a time
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HELD, "right")))
        first, last, some = int(row[at]), int(row[end - 1]) + 1, count[at:end]
        pairs = np.repeat((row[at:end].astype(np.int64) - first) * m, some) + held[_runs(begin[left[at:end]], some)]
        out[first:last] += np.bincount(pairs, minlength=(last - first) * m).reshape(-1, m)
        at = end
    return out


def _met(score: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], names: tuple[str, str, str], kind: pa.DataType, both: bool):
    """Two tiles in order of their ids to the rows of their pairs; ``both``: parts of one table, pairs with the lesser id first. In
    files ids are runs, and lists of ``RUN`` that repeat, which take next to nothing."""
    fields = pa.schema([(names[0], pa.int64()), (names[1], pa.int64()), (names[2], kind)])

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        value, none = score(left, right)
        a, b = (x.column("id").to_numpy() for x in (left, right))
        if not both:  # topics, and all chunks of a run behind each: those of one text are next to each other
            a, b, value, none = b, a, value.T, none.T
        some, part = bool(none.any()), both and a[-1] >= b[0]
        for at in range(0, len(b), RUN):
            cut = slice(at, at + RUN)
            x, y = np.repeat(a, len(b[cut])), np.tile(b[cut], len(a))
            v, mask = value[:, cut].ravel(), none[:, cut].ravel() if some else None
            if part:
                keep = x < y
                x, y, v, mask = x[keep], y[keep], v[keep], mask[keep] if some else None
            x, y = (x, y) if both else (y, x)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(v, kind, mask=mask)], schema=fields)

    return run


def _packed(rows: DataFrame, own: list[str], parts: int) -> DataFrame:
    """The rows (id, ...) of each value of ``own`` in lists by ranges of ids, of ``PACK`` rows at most: own, at, held. There are
    ``parts`` ranges or more, but none of them is meant to have less than ``TILE`` rows."""
    n = rows.count()
    size = min(max(-(-n // parts), TILE), PACK)
    rest = [c for c in rows.columns if c not in ("id", *own)]
    placed = rows.repartitionByRange(max(-(-n // size), 1), *own, "id").withColumn("range", F.spark_partition_id())
    lists = placed.groupBy(*own, "range").agg(F.sort_array(F.collect_list(F.struct("id", *rest))).alias("all"))
    cut = lists.withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(PACK))))
    return stored(cut.select(*own, F.struct("range", "begin").alias("at"), F.slice("all", F.col("begin"), PACK).alias("held")))


def _meetings(left: DataFrame, right: DataFrame | None, own: list[str], score, names: tuple[str, str, str], kind: str) -> DataFrame:
    """All pairs of rows of two packed tables, or of one with itself: lists meet whole, pairs of them are dealt to tasks by their
    places, and a task scores pairs of tiles one after another, so it holds two lists and the rows of two tiles."""
    both = right is None
    a = left.select(*own, F.col("at").alias("left_at"), F.col("held").alias("left"))
    b = (left if both else right).select(*own, F.col("at").alias("right_at"), F.col("held").alias("right"))
    ends = a.select(*own, "left_at"), b.select(*own, "right_at")
    every = ends[0].join(ends[1], own) if own else ends[0].crossJoin(ends[1])  # lists of the lists' places
    every = stored(every.where("left_at <= right_at") if both else every)
    key = [*own, "left_at", "right_at"]
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, every.count())
    sides = (x.join(F.broadcast(every), [*own, at]).repartition(tasks, *key) for x, at in ((a, "left_at"), (b, "right_at")))
    tile = _met(score, names, pa.float64() if kind == "double" else pa.int64(), both)
    tile_rows = TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(c)[i].values)]) for c in ("left", "right"))
                same = both and batch.column("left_at")[i].as_py() == batch.column("right_at")[i].as_py()
                for p in range(0, len(x), tile_rows):
                    for q in range(p if same else 0, len(y), tile_rows):
                        yield from tile(x.slice(p, tile_rows), y.slice(q, tile_rows))

    met = next(sides).join(next(sides), key).select("left", "right", "left_at", "right_at")
    return met.mapInArrow(run, f"{names[0]} long, {names[1]} long, {names[2]} {kind}")


def _tiled(left: DataFrame, right: DataFrame, score, names: tuple[str, str, str], kind: str = "double") -> DataFrame:
    """All pairs of rows of ``left`` and ``right`` (id, project_id, ...) of one project."""
    a, b = (_packed(x.where("project_id is not null"), ["project_id"], parts) for x, parts in ((left, LEFT_PARTS), (right, 1)))
    return _meetings(a, b, ["project_id"], score, names, kind)


def _group(left: DataFrame, right: DataFrame, tile, schema: str, own: tuple[str, ...] = ("project_id",), size: int = TILE, other: int = TILE) -> DataFrame:
    count = lambda df, n, name: df.groupBy(*own).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    tiles = count(left, size, "of_left").join(count(right, other, "of_right"), list(own))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(tiles, list(own)).withColumn("left_at", place("of_left")).withColumn("right_at", every("of_right")).drop("of_left", "of_right")
    b = right.join(tiles, list(own)).withColumn("right_at", place("of_right")).withColumn("left_at", every("of_left")).drop("of_left", "of_right")
    key = [*own, "left_at", "right_at"]
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(tile, schema)


def _within(rows: DataFrame, score, names: tuple[str, str, str]) -> DataFrame:
    """All pairs of rows (id, ...) with different ids, the lesser first; of two lists only one order meets."""
    return _meetings(_packed(rows.where("id is not null"), [], PARTS), None, [], score, names, "double")


def _sides(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    chunk = {"embedding": "embedding", "section": "coalesce(section, '') as section", "words": "chunk_text as words"}
    topic = {"embedding": "embedding", "section": "coalesce(source_section, '') as section", "words": "topic as words"}
    return tuple(_sql(f"select id, project_id, {', '.join(of[m] for m in more)} from {table}", spark, sf_dir) for of, table in ((chunk, "vchunks"), (topic, "vtopics")))


def _distances(a: pa.Table, b: pa.Table):
    value, none = _components(a.column("embedding"), b.column("embedding"), False)
    return -value, none


def jon_chunk_topic_pairs(spark, sf_dir):
    return _tiled(*_sides(spark, sf_dir, "embedding"), _distances, ("chunk_id", "topic_id", "distance"))


def vec_final_score(spark, sf_dir):
    def score(a: pa.Table, b: pa.Table):
        value, none = _components(a.column("embedding"), b.column("embedding"), False)
        words, unknown = _word_counts(a.column("words"), b.column("words"))
        same = np.array(a.column("section").to_pylist(), object)[:, None] == np.array(b.column("section").to_pylist(), object)
        return value + np.where(same, 0.2, 0.0) + words * 5 / 100, none | unknown

    return _tiled(*_sides(spark, sf_dir, "embedding", "section", "words"), score, ("chunk_id", "topic_id", "score"))


def str_keyword_overlap(spark, sf_dir):
    def score(a: pa.Table, b: pa.Table):
        return _word_counts(a.column("words"), b.column("words"))

    return _tiled(*_sides(spark, sf_dir, "words"), score, ("chunk_id", "topic_id", "n"), "long").select("topic_id", "chunk_id", "n")


def _of_embeddings(distance: bool) -> Run:
    def score(a: pa.Table, b: pa.Table):
        value, none = _components(a.column("embedding"), b.column("embedding"), distance)
        return (value if distance else -value), none

    return lambda spark, sf_dir: _within(_sql("select vec_id as id, embedding from embeddings", spark, sf_dir), score, ("a", "b", "distance"))


def str_word_overlap(spark, sf_dir):
    def score(a: pa.Table, b: pa.Table):
        n, m = (pc.list_value_length(x.column("w")).to_numpy() for x in (a, b))
        least = np.minimum(n[:, None], m)
        return _common(a.column("w"), b.column("w")) / least, np.zeros(least.shape, bool)

    # letter by letter only where a text has one of the two letters; stored, else each filter and each side makes the words anew
    low = "case when contains(text, 'İ') or contains(text, 'Σ') then @LOWER(text) else lower(text) end"
    words = stored(_sql(f"select doc_id as id, @DISTINCT(@FILTER(@SPLIT({low}, ' '), x -> length(x) >= 5)) as w from documents where doc_id is not null", spark, sf_dir))
    return _within(_numbered(words.where(F.size("w") >= 6)), score, ("a", "b", "overlap"))


def _numbered(rows: DataFrame) -> DataFrame:
    """id, w: the words of each row as their places among all words, as numbers are less to move than words."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("w").alias("word"))
    places = ranked(each.select("word").distinct(), "word").select("word", F.col("rn").cast("int").alias("place"))
    lists = each.join(places, "word").groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("w"))
    return rows.select("row", "id").join(lists, "row").select("id", "w")


def set_token_jaccard(spark, sf_dir):
    def score(a: pa.Table, b: pa.Table):
        n, m = (pc.list_value_length(x.column("w")).fill_null(0).to_numpy() for x in (a, b))
        x, y = (np.array(t.column("w").is_null()) for t in (a, b))
        both = _common(a.column("w"), b.column("w"))
        every = n[:, None] + m - both
        return both / np.maximum(every, 1), (every == 0) | x[:, None] | y

    return _within(_sql("select id, @DISTINCT(@SPLIT(topic, ' ')) as w from vtopics", spark, sf_dir), score, ("a", "b", "jaccard"))


# ---- pairs of equal keys


def _keyed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Ids of chunks and of topics with their project and section, stored, as texts should be read once."""
    rows = (f"select id, project_id, {section} as section from {of}" for section, of in (("section", "vchunks"), ("source_section", "vtopics")))
    return tuple(stored(_sql(text, spark, sf_dir)) for text in rows)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """The rows (id, ..., project_id, section) of each key in lists of ``size``, which are cut out of larger ones, so that few have
    another length: only then do lists that repeat look alike to a writer that packs bits."""
    rest = [c for c in rows.columns if c not in KEY]
    held = F.col("id") if rest == ["id"] else F.struct(*rest)
    large = rows.groupBy(*KEY).agg(F.ceil(F.count("*") / (size * CUTS)).alias("of"))
    placed = rows.join(large, KEY).groupBy(*KEY, F.pmod(F.xxhash64("id"), "of").alias("at")).agg(F.sort_array(F.collect_list(held)).alias("all"))
    begun = placed.withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(size))))
    return begun.select(*KEY, F.struct("at", "begin").alias(f"{name}_at"), F.slice("all", F.col("begin"), size).alias(f"{name}s"))


def _linked(chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """Columns topic and chunk, a row for each pair of equal keys: blocks of both sides meet, and pairs of blocks are dealt to tasks
    of about ``TASK_PAIRS`` rows each, whatever few bytes their input has. Chunks follow in the same order behind each topic of a
    block, and a task has few ids of each side, so files hold them as runs and repeats."""
    chunks, topics = (x.where("project_id is not null and section is not null") for x in (chunks, topics))
    n, m = (x.groupBy(*KEY).agg(F.count("*").cast("double").alias("n")) for x in (chunks, topics))
    rows = n.join(m.withColumnRenamed("n", "m"), KEY).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, int(-(-rows // TASK_PAIRS)))
    dealt = _blocks(chunks, BLOCK, "chunk").join(_blocks(topics, TILE, "topic"), KEY).repartition(tasks, *KEY, "chunk_at", "topic_at")
    return pairs(dealt.select(*KEY, "topics", "chunks"), "topics", "chunks", "topic", "chunk")


def _distinct_pairs(spark, sf_dir) -> DataFrame:
    """Distinct pairs of topics and chunks of one project and section. Of ids with one key no pair comes twice; a pair of ids that
    both have several is taken at the least key they share."""
    one, several = [], []
    for rows in _keyed(spark, sf_dir):
        keys = rows.where("project_id is not null and section is not null").groupBy("id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))
        each = keys.select("id", F.when(F.size("keys") > 1, F.col("keys")).alias("keys"), F.explode("keys").alias("key")).select("id", "keys", "key.*")
        each = stored(each)
        one.append(each.where("keys is null").select("id", *KEY))
        several.append(each.where("keys is not null"))
    ids = [x.select("id", *KEY) for x in several]
    plain = [_linked(one[0], one[1]), _linked(one[0], ids[1]), _linked(ids[0], one[1])]
    twice = _linked(*several).where(F.array_min(F.array_intersect("topic.keys", "chunk.keys")) == F.struct(*KEY))
    found = [x.select(F.col("topic").alias("topic_id"), F.col("chunk").alias("chunk_id")) for x in plain]
    return reduce(DataFrame.unionByName, [*found, twice.select(F.col("topic.id").alias("topic_id"), F.col("chunk.id").alias("chunk_id"))])


def jon_global_scope(spark, sf_dir):
    """Chunks and the topics of their project and section, and chunks that have none."""
    chunks, topics = _keyed(spark, sf_dir)
    alone = chunks.join(topics.select(*KEY).distinct(), KEY, "left_anti")
    linked = _linked(chunks, topics).select(F.col("chunk").alias("chunk_id"), F.col("topic").alias("topic_id"))
    return linked.unionByName(alone.select(F.col("id").alias("chunk_id"), F.lit(None).cast("long").alias("topic_id")))


def agg_coverage_stats(spark, sf_dir):
    """By counts of the keys."""
    topics = _sql("select id as topic_id, project_id, source_section as section from vtopics where project_id is not null and source_section is not null", spark, sf_dir)
    chunks = _sql("select id as chunk_id, project_id, section from vchunks where project_id is not null and section is not null", spark, sf_dir)
    key = ["project_id", "section"]
    of_topics, of_chunks = topics.groupBy(*key).agg(F.count("*").alias("t")), chunks.groupBy(*key).agg(F.count("*").alias("c"))
    links = of_topics.join(of_chunks, key).agg(F.coalesce(F.sum(F.col("t") * F.col("c")), F.lit(0)).alias("links"))
    found = topics.join(of_chunks, key, "left_semi").agg(F.countDistinct("topic_id").alias("topics"))
    per = chunks.join(of_topics, key).groupBy("chunk_id").agg(F.sum("t").alias("n")).agg(F.count("chunk_id").alias("chunks"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return links.crossJoin(found).crossJoin(per)  # one row each


def flt_exists_flag(spark, sf_dir):
    return _sql("select p.id, exists (select 1 from (select distinct project_id from quizzes) q where q.project_id = p.id) and exists (select 1 from (select distinct project_id from reviews) r where r.project_id = p.id) as has_evidence from projects p", spark, sf_dir)


def _held(chunks: pa.Table, words: pa.Table) -> pa.Table:
    """The words of the tile that a text of the other one contains."""
    import ahocorasick

    out = pa.schema([("project_id", pa.int64()), ("section", pa.string()), ("word", pa.string())])
    if not chunks.num_rows or not words.num_rows:
        return out.empty_table()
    asked = words.column("id").to_pylist()
    automaton, found = ahocorasick.Automaton(), {""} & set(asked)
    for w in asked:
        if w:
            automaton.add_word(w, w)
    if len(automaton):
        automaton.make_automaton()
        for text in chunks.column("words"):
            found.update(w for _, w in automaton.iter(text.as_py()))
            if len(found) == len(asked):
                break
    n = len(found)
    return pa.table([pa.array([words.column("project_id")[0].as_py()] * n, pa.int64()), pa.array([words.column("section")[0].as_py()] * n, pa.string()), pa.array(sorted(found), pa.string())], schema=out)


def _orphans(spark, sf_dir, *more: str) -> DataFrame:
    """Topics whose first word no chunk of their project and section contains. Each word is looked for once a section."""
    topics = _sql(f"select {', '.join(('id', *more))}, project_id, source_section as section, split_part(topic, ' ', 1) as word from vtopics", spark, sf_dir)
    chunks = _sql("select id, project_id, section, chunk_text as words from vchunks where project_id is not null and section is not null and chunk_text is not null", spark, sf_dir)
    words = topics.where("project_id is not null and section is not null and word is not null").select("project_id", "section", F.col("word").alias("id")).distinct()
    key = ["project_id", "section"]
    held = _group(chunks, words, _held, "project_id long, section string, word string", tuple(key), 1 << 14, 1 << 17).distinct()
    return topics.join(held, [*key, "word"], "left_anti")


def jon_anti_orphans(spark, sf_dir):
    return _orphans(spark, sf_dir).select("id")


def jon_orphan_chunk_pairs(spark, sf_dir):
    left = stored(_orphans(spark, sf_dir, "embedding").select("id", "project_id", "embedding"))  # counted and cut, found once
    return _tiled(left, _sql("select id, project_id, embedding from vchunks where teaching", spark, sf_dir), _distances, ("topic_id", "chunk_id", "distance"))


def _parts(word: str) -> list[str]:
    """What LIKE '%word%' looks for, one after another."""
    return [p for p in word.split("%") if p]


def _in_order(parts: list[re.Pattern], text: str) -> bool:
    at = 0
    for part in parts:
        if not (m := part.search(text, at)):
            return False
        at = m.end()
    return True


def _like(chunks: pa.Table, topics: pa.Table) -> pa.Table:
    """Pairs of topics and the texts that are like their words. Each word is looked for once a text: by an automaton, or, of
    several parts or with signs for any letter, part by part; a word of no parts is in every text."""
    import ahocorasick

    out = pa.schema([("topic_id", pa.int64()), ("chunk_id", pa.int64())])
    if not chunks.num_rows or not topics.num_rows:
        return out.empty_table()
    uses: dict[str | tuple[str, ...], list[int]] = {}
    for i, w in enumerate(topics.column("word").to_pylist()):
        parts = _parts(w)
        uses.setdefault(parts[0] if len(parts) == 1 and "_" not in w else tuple(parts), []).append(i)
    rows = [np.array(x) for x in uses.values()]
    automaton, odd = ahocorasick.Automaton(), []
    for k, w in enumerate(uses):
        if isinstance(w, str):
            automaton.add_word(w, k)
        else:
            odd.append((k, [re.compile(".".join(map(re.escape, p.split("_"))), re.DOTALL) for p in w]))
    if len(automaton):
        automaton.make_automaton()
    held, counts = [np.zeros(0, np.int64)], []
    for text in chunks.column("words").to_pylist():
        found = {k for _, k in automaton.iter(text)} if len(automaton) else set()
        found.update(k for k, parts in odd if _in_order(parts, text))
        held += [rows[k] for k in found]
        counts.append(sum(len(rows[k]) for k in found))
    return pa.table([pa.array(topics.column("id").to_numpy()[np.concatenate(held)]), pa.array(np.repeat(chunks.column("id").to_numpy(), counts))], schema=out)


def flt_keyword_like(spark, sf_dir):
    topics = _sql("select id, project_id, split_part(topic, ' ', 1) as word, topic from vtopics where topic is not null and project_id is not null", spark, sf_dir)
    chunks = _sql("select id, project_id, lower(chunk_text) as words from vchunks where chunk_text is not null and project_id is not null", spark, sf_dir)
    own = F.expr(r"lower(topic) like '%' || replace(word, '\\', '\\\\') || '%'")
    return _group(chunks, topics.where(own).select("id", "project_id", "word"), _like, "topic_id long, chunk_id long", other=2 * TILE)


# ---- what all pairs of two categories say


def win_k_nearest(spark, sf_dir):
    """The mean of all inner products of two categories is the inner product of their means."""
    from . import consolidation
    from .queries import _raw

    known = consolidation.sums(_raw(spark, sf_dir).where("v is not null and category is not null")).select("category", F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    dot = "aggregate(zip_with(l.mean, r.mean, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    return spark.sql(f"select a, b from (select a, b, row_number() over (partition by a order by sim desc, b) as rn from (select l.category as a, r.category as b, {dot} as sim from {{known}} l join {{known}} r on l.category <> r.category) x) y where rn <= 2", known=known)


def vec_cohesion_spread(spark, sf_dir):
    """The least alike of a category: of each vector the farthest one, by the blocked product. Norms are stored: else Spark
    works out each vector's norm again for each of its components, on every reading."""
    normed = stored(_sql("select id, category, embedding, sqrt(@DOT(embedding, embedding)) as norm from ledger", spark, sf_dir))
    unit = normed.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double") / F.col("norm")))
    means = unit.select("category", F.posexplode("embedding").alias("pos", "m")).groupBy("category", "pos").agg(F.avg("m").alias("m"))
    cohesion = means.groupBy("category").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("cohesion"))
    units = unit.where("norm > 0 and category is not null").select("id", F.xxhash64("category").alias("project_id"), F.lit(None).cast("string").alias("section"), "embedding")
    far = units.select("id", "project_id", F.col("section").alias("source_section"), F.transform("embedding", lambda x: -x).alias("embedding"))
    best = pair_scores.best_pairs(units, far, pair_scores.Scoring(per_chunk=1, others=True)).groupBy("project_id").agg(F.max("score").alias("most"))
    return cohesion.withColumn("project_id", F.xxhash64("category")).join(best, "project_id", "left").select("category", "cohesion", F.coalesce(1 + F.col("most"), F.lit(0.0)).alias("spread"))


#: key of a plan or program -> the program that takes its place; the SQL stays
RUNS: dict[str, Run] = {
    "vec_l2": _of_embeddings(True),
    "vec_neg_inner_product": _of_embeddings(False),
    "snk_bulk_links": _distinct_pairs,
    "stm_dedup_chunks": _distinct_pairs,
} | {f.__name__: f for f in (jon_chunk_topic_pairs, vec_final_score, str_keyword_overlap, str_word_overlap, set_token_jaccard, agg_coverage_stats, flt_exists_flag, jon_global_scope, jon_anti_orphans, jon_orphan_chunk_pairs, flt_keyword_like, win_k_nearest, vec_cohesion_spread)}
