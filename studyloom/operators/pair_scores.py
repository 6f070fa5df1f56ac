"""Best topics of each chunk and best chunks of each topic of the same project, by a blocked matrix product.

Both sides are cut into tiles of bounded size within their project, so a project of any share of the rows is spread over
many tasks; each pair of tiles of a project meets in one group, which scores all its pairs in one product of matrices and
puts out only the best of each chunk and of each topic. The best of the tiles are ranked in the end, so what is shuffled
grows with the rows kept, not with the pairs.

Score of a chunk and a topic: the inner product of their vectors, ``section`` more if their sections are equal, ``keyword``
hundredths more for each word of the topic of over four characters that the chunk's text contains. The product picks the
candidates; those within ``NEAR`` of the last place are summed up again one component after another, so equal vectors
have equal scores wherever they lie. By ``distance`` it is the Euclidean distance instead, least first.

Pairs without a score (a null vector, or, where keywords count, a null text or topic) are left out; a null section equals
an empty one; rows without a project pair with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a tile of chunks and of topics at most; tiles of a project if it has LEAST rows for each; columns and rows whose best
#: is looked at first, scores held at a time, the margin within which scores are summed again, and pairs held for each one that
#: a topic keeps before they are.
CHUNK_TILE, TOPIC_TILE, LEAST, SPREAD = 1 << 16, 1 << 17, 4096, 8
BLOCK, GROUP, CELLS, NEAR, HELD = 64, 16, 1 << 22, 1e-9, 4
_PAIR = "by_topic boolean, project_id long, chunk_id long, topic_id long, score double"


@dataclass(frozen=True)
class Scoring:
    """How pairs are scored, how many are kept, and which of equal ones comes first."""

    per_chunk: int = 0
    per_topic: int = 0
    section: float = 0.0
    same_section: bool = False  # only pairs of equal sections
    keyword: int = 0  # hundredths
    distance: bool = False
    last_topic: bool = False  # of equal topics the last one by id as text, else the first
    others: bool = False  # no pairs of equal ids


def _words(topics: list[str]):
    """An automaton of the words of over four characters of the topics, and for each word the topics it is of (repeats included)."""
    import ahocorasick

    words: dict[str, int] = {}
    uses: list[list[int]] = []
    for j, topic in enumerate(topics):
        for w in topic.split(" "):
            if len(w) > 4:
                if (k := words.setdefault(w, len(uses))) == len(uses):
                    uses.append([])
                uses[k].append(j)
    if not words:
        return None, uses
    automaton = ahocorasick.Automaton()
    for w, i in words.items():
        automaton.add_word(w, i)
    automaton.make_automaton()
    return automaton, [np.array(u) for u in uses]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, distance: bool) -> np.ndarray:
    """Sums over the components in their order, of rows i of a and j of b."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 16):
        x, y, part = a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]], out[at : at + (1 << 16)]
        for k in range(a.shape[1]):
            part += (x[:, k] - y[:, k]) ** 2 if distance else x[:, k] * y[:, k]
    return np.sqrt(out) if distance else out


def _first(owner: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's ``k`` best, of equal scores the least ``tie``."""
    order = np.lexsort((tie, -score, owner))
    held = owner[order]
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))[: len(held)]
    rank = np.arange(len(held)) - np.repeat(starts, np.diff(np.append(starts, len(held))))
    return order[rank < k]


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of counts[i] places each, one run after another."""
    return np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())


def _rows(table: pa.Table, width: int) -> tuple[pa.Table, np.ndarray]:
    """The rows whose vectors have ``width`` finite components, and their matrix."""
    table = table.filter(pc.equal(pc.list_value_length(table.column("embedding")), width)).combine_chunks()
    column = table.column("embedding")
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)])
    matrix = flat.astype(np.float64).reshape(table.num_rows, width)
    good = np.isfinite(matrix).all(axis=1)
    return (table, matrix) if good.all() else (table.filter(pa.array(good)), matrix[good])


def _near(score: np.ndarray, most: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (rows, blocks, columns) with the most of each block: rows and columns of each row's ``k`` best and of all that are
    nearly as good, and a bound that the ``k`` best of each row reach."""
    last = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] if most.shape[1] >= k else np.full(len(most), -np.inf)
    i, block = np.nonzero(most >= last[:, None] - margin)
    held = score[i, block]
    x, y = np.nonzero((held >= last[i][:, None] - margin) & np.isfinite(held))
    return i[x], block[x] * score.shape[2] + y, last


def _tile(how: Scoring):
    """Rows of equal vectors and sections are one class: the product scores classes, and words add to the pairs they are in. As
    they only add, a chunk's best topics are among the best of its class and those it has words of; so for topics."""
    empty = pa.schema([("by_topic", pa.bool_()), ("project_id", pa.int64()), ("chunk_id", pa.int64()), ("topic_id", pa.int64()), ("score", pa.float64())])

    def run(chunks: pa.Table, topics: pa.Table) -> pa.Table:
        if not chunks.num_rows or not topics.num_rows:
            return empty.empty_table()
        project = chunks.column("project_id")[0].as_py()
        width = pc.max(pc.list_value_length(chunks.column("embedding"))).as_py()
        (chunks, a), (topics, b) = _rows(chunks, width), _rows(topics, width)
        if not len(a) or not len(b):
            return empty.empty_table()
        sections = pa.concat_arrays([*chunks.column("section").chunks, *topics.column("section").chunks]).dictionary_encode().indices.to_numpy()
        c_section, t_section = sections[: len(a)], sections[len(a) :]
        order = np.argsort(t_section, kind="stable")  # topics of a section next to each other
        topics, b, t_section = topics.take(pa.array(order)), b[order], t_section[order]
        c_id, t_id = (x.column("id").to_numpy() for x in (chunks, topics))
        if how.others:
            owner = first = np.arange(len(a))
        else:
            key = np.ascontiguousarray(np.column_stack([a, c_section]))
            _, first, owner = np.unique(key.view(np.dtype((np.void, key.itemsize * key.shape[1]))).ravel(), return_index=True, return_inverse=True)
        members = np.lexsort((c_id, owner))  # of each class, by id
        begin = np.searchsorted(owner[members], np.arange(len(first) + 1))
        v = a[first]
        if how.distance:  # the negative squared distance as one product
            square = lambda x: (x * x).sum(axis=1)[:, None]
            left, right = np.hstack([2 * v, np.ones((len(v), 1)), square(v)]), np.hstack([b, -square(b), np.full((len(b), 1), -1.0)])
        else:
            left, right = v, b
        margin = NEAR * max(1.0, float(np.sqrt((left * left).sum(axis=1).max() * (right * right).sum(axis=1).max())))
        #: topics in the order in which equal ones are taken
        tie = np.empty(len(t_id), np.int64)
        tie[np.argsort(t_id.astype(str), kind="stable")] = np.arange(len(t_id))
        tie = -tie if how.last_topic else tie
        texts, (automaton, uses) = chunks.column("words"), _words(topics.column("words").to_pylist()) if how.keyword else (None, [])
        across = -(-len(b) // BLOCK)
        right = np.ascontiguousarray(np.vstack([right, np.zeros((across * BLOCK - len(b), right.shape[1]))]).T)
        step = max(BLOCK, CELLS // right.shape[1] // BLOCK * BLOCK)
        low = np.full((how.per_topic, right.shape[1]), -np.inf)
        by_id = np.argsort(t_id, kind="stable")
        best, of_topics = [], []  # (chunks, topics, words)
        for at in range(0, len(v), step):
            n = min(step, len(v) - at)
            rows = -(-n // GROUP) * GROUP
            score = np.full((rows, right.shape[1]), -np.inf)
            np.matmul(left[at : at + n], right, out=score[:n])
            score[:, len(b) :] = -np.inf
            if how.section:
                for s in np.unique(c_section[first[at : at + n]]):
                    lo, hi = np.searchsorted(t_section, [s, s + 1])
                    score[np.flatnonzero(c_section[first[at : at + n]] == s), lo:hi] += how.section
            if how.others:
                lo, hi = (np.searchsorted(t_id[by_id], c_id[at : at + n], side) for side in ("left", "right"))
                score[np.repeat(np.arange(n), hi - lo), by_id[_runs(lo, hi - lo)]] = -np.inf
            cells = score.reshape(rows, across, BLOCK)
            most = cells.max(axis=2)
            if not (most < np.inf).all():  # sums beyond doubles
                score[~np.isfinite(score)] = -np.inf
                most = cells.max(axis=2)
            reach = None
            if how.per_chunk:
                i, j, reach = _near(cells[:n], most[:n], how.per_chunk, margin)
                if automaton is None:  # all members of a class are alike
                    exact = _exact(v, b, at + i, j, how.distance)
                    exact = (-exact if how.distance else exact) + np.where(c_section[first[at + i]] == t_section[j], how.section, 0.0)
                    keep = _first(i, exact, tie[j], how.per_chunk)
                    i, j = i[keep], j[keep]
                count = begin[at + i + 1] - begin[at + i]
                best.append((members[_runs(begin[at + i], count)], np.repeat(j, count), np.zeros(count.sum(), np.int64)))
            if how.per_topic:
                groups = score.reshape(rows // GROUP, GROUP, -1)
                most = groups.max(axis=1)
                both = np.concatenate([low, most])
                low = np.partition(both, len(both) - how.per_topic, axis=0)[-how.per_topic :]
                g, j = np.nonzero(most >= low[0] - margin)
                held = groups[g, :, j]
                x, y = np.nonzero((held >= low[0][j][:, None] - margin) & np.isfinite(held))
                i, j = at + g[x] * GROUP + y, j[x]
                count = np.minimum(begin[i + 1] - begin[i], how.per_topic)  # of equal ones the first by id
                of_topics.append((members[_runs(begin[i], count)], np.repeat(j, count), np.zeros(count.sum(), np.int64)))
            if automaton is not None:
                for m in members[begin[at] : begin[at + n]]:
                    found = {k for _, k in automaton.iter(texts[m].as_py())}
                    if found:
                        j, times = np.unique(np.concatenate([uses[k] for k in found]), return_counts=True)
                        held = score[owner[m] - at, j] + times * how.keyword / 100
                        for kept, bound in ((best, reach[owner[m] - at] if how.per_chunk else np.inf), (of_topics, low[0][j] if how.per_topic else np.inf)):
                            if len(x := np.flatnonzero(held >= bound - margin)):
                                kept.append((np.full(len(x), m), j[x], times[x]))
            if how.per_topic and sum(len(x[0]) for x in of_topics) > HELD * len(b) * how.per_topic:
                of_topics = [settled(of_topics, True, a, b, c_section, t_section, c_id, tie)[:3]]
        out = []
        for flag, found in ((False, best), (True, of_topics)):
            if found:
                i, j, _, score = settled(found, flag, a, b, c_section, t_section, c_id, tie)
                n = len(i)
                out.append(pa.table([pa.array(np.full(n, flag)), pa.array(np.full(n, project)), pa.array(c_id[i]), pa.array(t_id[j]), pa.array(-score if how.distance else score)], schema=empty))
        return pa.concat_tables(out)

    def settled(found, by_topic, a, b, c_section, t_section, c_id, tie):
        """The best by exact scores of what was found, each pair once, with all its words."""
        i, j, words = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-words, j, i))
        i, j, words = i[order], j[order], words[order]
        new = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(i)]
        i, j, words = i[new], j[new], words[new]
        score = _exact(a, b, i, j, how.distance)
        score = (-score if how.distance else score) + np.where(c_section[i] == t_section[j], how.section, 0.0)
        score = score + words * how.keyword / 100 if how.keyword else score
        keep = np.flatnonzero(np.isfinite(score))
        keep = keep[_first(j[keep], score[keep], c_id[i[keep]], how.per_topic) if by_topic else _first(i[keep], score[keep], tie[j[keep]], how.per_chunk)]
        return i[keep], j[keep], words[keep], score[keep]

    return run


def best_pairs(chunks: DataFrame, topics: DataFrame, how: Scoring, chunk_tile: int = CHUNK_TILE, topic_tile: int = TOPIC_TILE) -> DataFrame:
    """by_topic, project_id, chunk_id, topic_id, score, rn of ``chunks`` (id, project_id, section, embedding, chunk_text) and
    ``topics`` (id, project_id, source_section, embedding, topic): the ``per_chunk`` best of each chunk (by_topic false), and
    the ``per_topic`` best of each topic (true)."""
    none = F.lit("")
    side = lambda df, section, text: df.select(
        F.col("id").cast("long").alias("id"), F.col("project_id").cast("long").alias("project_id"), F.coalesce(section, none).alias("section"), F.col("embedding").alias("embedding"), (F.col(text) if how.keyword else none).alias("words")
    ).where("project_id is not null and embedding is not null and words is not null")
    left, right = side(chunks, "section", "chunk_text"), side(topics, "source_section", "topic")
    # equal vectors share a tile, up to LEAST rows of them; so the few vectors of more rows are dealt over several
    own = ["project_id", "section"] if how.same_section else ["project_id"]
    left = left.withColumn("like", F.xxhash64("embedding"))
    # stored, so that texts are read once, and Spark knows that tiles are few before it moves the texts to them
    sizes = stored(left.groupBy(*own, "like").agg(F.count("*").alias("n")))
    many = sizes.where(F.col("n") > LEAST).select(*own, "like", F.ceil(F.col("n") / LEAST).alias("parts"))  # less rows than all / LEAST
    tiles = sizes.groupBy(*own).agg(F.greatest(F.ceil(F.sum("n") / chunk_tile), F.least(F.ceil(F.sum("n") / LEAST), F.lit(SPREAD))).cast("int").alias("of_chunks"))
    # tiles of each project; Spark broadcasts this table only where it is small
    tiles = stored(tiles.join(right.groupBy(*own).agg(F.ceil(F.count("*") / topic_tile).cast("int").alias("of_topics")), own))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = [*own, "chunk_at", "topic_at"]
    a = left.join(F.broadcast(many), [*own, "like"], "left").join(tiles, own).withColumn("chunk_at", F.pmod(F.xxhash64("like", part), "of_chunks").cast("int"))
    a = a.withColumn("topic_at", every("of_topics")).drop("of_chunks", "of_topics", "like", "parts")
    b = right.join(tiles, own).withColumn("topic_at", F.pmod(F.xxhash64("id"), "of_topics").cast("int")).withColumn("chunk_at", every("of_chunks")).drop("of_chunks", "of_topics")
    met = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_tile(how), _PAIR)
    name = F.when(~F.col("by_topic"), F.col("topic_id").cast("string"))
    order = [F.col("score") if how.distance else -F.col("score"), name.desc() if how.last_topic else name, F.col("chunk_id")]
    owner = F.when(F.col("by_topic"), F.col("topic_id")).otherwise(F.col("chunk_id"))
    ranked = met.withColumn("rn", F.row_number().over(Window.partitionBy("project_id", "by_topic", owner).orderBy(*order)))
    return ranked.where(F.col("rn") <= F.when(F.col("by_topic"), how.per_topic).otherwise(how.per_chunk))
