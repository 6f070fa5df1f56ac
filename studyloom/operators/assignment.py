"""Registered queries on the best topics of chunks and the best chunks of topics. The blocked product makes them; the SQL of
each, for the independent engine, joins all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import dialect
from ..plans.adapters import RUN_VIEWS
from ..plans.domain import LINK_SCORE, LINKS, PAIRS, assigned, phase_a, rescue
from ..session import stored
from .pair_scores import Scoring, best_pairs

Run = Callable[[SparkSession, str], DataFrame]
_LINKS = Scoring(per_chunk=LINKS, per_topic=1, section=0.20, keyword=5)


def _view(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.runner(f"select * from {name}", RUN_VIEWS)(spark, sf_dir)


def _sides(spark: SparkSession, sf_dir: str, teaching: bool = True) -> tuple[DataFrame, DataFrame]:
    chunks = _view("vchunks", spark, sf_dir)
    return chunks.where("teaching") if teaching else chunks, _view("vtopics", spark, sf_dir)


def linked(pairs: DataFrame, least: float) -> DataFrame:
    """Phase A: the best topics of each chunk that reach the score."""
    return pairs.where(~F.col("by_topic") & (F.col("score") >= least)).select("chunk_id", "topic_id", "score")


def rescued(pairs: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Phase B: the best chunk of each topic without a link, where it reaches the lower score."""
    best = pairs.where(F.col("by_topic") & (F.col("score") >= least))
    return best.join(links.select("topic_id").distinct(), "topic_id", "left_anti").select("chunk_id", "topic_id", "score")


def _phase_a(least: float) -> Run:
    return lambda spark, sf_dir: linked(best_pairs(*_sides(spark, sf_dir), Scoring(per_chunk=LINKS, section=0.20, keyword=5)), least)


def _rescue(a: float, b: float) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = stored(best_pairs(*_sides(spark, sf_dir), _LINKS))  # read twice
        return rescued(pairs, linked(pairs, a), b)

    return run


def dom_assign_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, topics = _sides(spark, sf_dir)
    pairs = stored(best_pairs(chunks, topics, _LINKS))  # read three times
    links = linked(pairs, 0.30)
    both = links.unionByName(rescued(pairs, links, 0.20))
    found = both.agg(F.count("*").alias("links"), F.countDistinct("topic_id").alias("topics"), F.countDistinct("chunk_id").alias("chunks"))
    total = topics.agg(F.count("*").alias("total"))
    return found.join(F.broadcast(total)).select("links", "topics", "chunks", (100.0 * F.col("topics").cast("double") / F.col("total")).alias("coverage"))  # one row each


def dom_learning_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_pairs(*_sides(spark, sf_dir), Scoring(per_chunk=1, section=0.20, keyword=5, last_topic=True))
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), F.col("chunk_id").cast("string"))
    return best.withColumn("pos", F.row_number().over(order)).where("pos <= 80").select("project_id", "chunk_id", "topic_id", "score")


def dom_study_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _view("quiz_answers", spark, sf_dir)
    accuracy = answers.groupBy("topic").agg(F.avg(F.when(F.col("is_correct"), 1.0).otherwise(0.0)).alias("accuracy"))
    weak = accuracy.orderBy("accuracy", "topic").limit(5).withColumn("rn", F.row_number().over(Window.orderBy("accuracy", "topic")))  # five rows
    best = best_pairs(*_sides(spark, sf_dir), Scoring(per_chunk=1, section=0.20, keyword=5))
    top = best.orderBy(F.desc("score"), "chunk_id").limit(30).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # thirty rows
    return weak.join(top, (top.pos - 1) % 5 + 1 == weak.rn).select(weak.rn, "topic", "chunk_id")


def win_top3_topics_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_pairs(*_sides(spark, sf_dir, teaching=False), Scoring(per_chunk=3, section=0.20))
    return found.where("score >= 0.20").select("chunk_id", "topic_id", "score", "rn")


def win_best_chunk_per_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_pairs(*_sides(spark, sf_dir, teaching=False), Scoring(per_topic=1)).where("score >= 0.30").select("topic_id", "chunk_id", "score")


def win_best_topic_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, topics = _sides(spark, sf_dir, teaching=False)
    best = best_pairs(chunks, topics, Scoring(per_chunk=1, same_section=True, last_topic=True)).select("chunk_id", "topic_id")
    return chunks.select(F.col("id").alias("chunk_id")).join(best, "chunk_id", "left")


def srt_vector_topk_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_pairs(*_sides(spark, sf_dir, teaching=False), Scoring(per_topic=5, distance=True)).select("topic_id", "chunk_id")


#: key -> query, and its SQL in the common dialect
QUERIES: dict[str, tuple[Run, str]] = {
    "win_top3_topics_per_chunk": (
        win_top3_topics_per_chunk,
        "select chunk_id, topic_id, score, rn from (select c.id as chunk_id, t.id as topic_id, @DOT(c.embedding, t.embedding) + case when c.section = t.source_section then 0.20 else 0.0 end as score, row_number() over (partition by c.id order by @DOT(c.embedding, t.embedding) + case when c.section = t.source_section then 0.20 else 0.0 end desc, cast(t.id as varchar(20))) as rn from vchunks c join vtopics t on t.project_id = c.project_id) x where rn <= 3 and score >= 0.20",
    ),
    "win_best_chunk_per_orphan": (
        win_best_chunk_per_orphan,
        "select topic_id, chunk_id, score from (select t.id as topic_id, c.id as chunk_id, @DOT(c.embedding, t.embedding) as score, row_number() over (partition by t.id order by @DOT(c.embedding, t.embedding) desc, c.id) as rn from vtopics t join vchunks c on c.project_id = t.project_id) x where rn = 1 and score >= 0.30",
    ),
    "win_best_topic_per_chunk": (
        win_best_topic_per_chunk,
        "select chunk_id, topic_id from (select c.id as chunk_id, t.id as topic_id, row_number() over (partition by c.id order by coalesce(@DOT(c.embedding, t.embedding), -1e9) desc, coalesce(cast(t.id as varchar(20)), '') desc) as rn from vchunks c left join vtopics t on t.project_id = c.project_id and t.source_section = c.section) x where rn = 1",
    ),
    "srt_vector_topk_per_topic": (
        srt_vector_topk_per_topic,
        "select topic_id, chunk_id from (select t.id as topic_id, c.id as chunk_id, row_number() over (partition by t.id order by @L2(c.embedding, t.embedding), c.id) as rn from vtopics t join vchunks c on c.project_id = t.project_id) x where rn <= 5",
    ),
    "dom_assign_phase_a": (
        _phase_a(LINK_SCORE),
        f"select chunk_id, topic_id, score from {phase_a(LINK_SCORE)} x",
    ),
    "dom_assign_phase_a_low": (
        _phase_a(0.30),
        f"select chunk_id, topic_id, score from {phase_a(0.30)} x",
    ),
    "dom_assign_rescue": (
        _rescue(LINK_SCORE, 0.20),
        f"select chunk_id, topic_id, score from {rescue(LINK_SCORE, 0.20)} x",
    ),
    "dom_assign_final": (
        dom_assign_final,
        f"select count(*) as links, count(distinct topic_id) as topics, count(distinct chunk_id) as chunks, 100.0 * cast(count(distinct topic_id) as double) / (select count(*) from vtopics) as coverage from {assigned(0.30, 0.20)} x",
    ),
    "dom_learning_scope": (
        dom_learning_scope,
        f"select project_id, chunk_id, topic_id, score from (select *, row_number() over (partition by project_id order by score desc, cast(chunk_id as varchar(20))) as pos from (select p.*, row_number() over (partition by chunk_id order by score desc, cast(topic_id as varchar(20)) desc) as rn from {PAIRS} p) a where rn = 1) b where pos <= 80",
    ),
    "dom_study_session": (
        dom_study_session,
        f"select w.rn, w.topic, s.chunk_id from (select topic, row_number() over (order by accuracy, topic) as rn from (select topic, avg(case when is_correct then cast(1 as double) else cast(0 as double) end) as accuracy from quiz_answers group by topic) x) w join (select chunk_id, row_number() over (order by best desc, chunk_id) as pos from (select chunk_id, max(score) as best from {PAIRS} p group by chunk_id) y) s on (s.pos - 1) % 5 + 1 = w.rn where s.pos <= 30 and w.rn <= 5",
    ),
}
