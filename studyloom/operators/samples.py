"""Reproducible samples of groups: the rows with the smallest hashes. The smallest of parts are the smallest of the whole, so one
pass with partial aggregates makes them, and a run on the same rows picks the same ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import dialect
from ..plans.adapters import VIEWS

#: Accepted questions that a report shows.
ACCEPTED = 10


def bottom_k(df: DataFrame, group: list[str], key: str, k: int, seed: int = 7, salts: int = 16) -> DataFrame:
    """The ``k`` rows of each group with the smallest hashes of ``key``, in two steps, so a group of any share is spread over
    ``salts`` tasks; of equal hashes the smaller key comes first."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), key))
    first = Window.partitionBy(*group, "_salt").orderBy("_h", key)
    few = hashed.withColumn("_salt", F.pmod("_h", F.lit(salts))).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    last = Window.partitionBy(*group).orderBy("_h", key)
    return few.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= k).drop("_h", "_salt", "_n")


def dom_diag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected question, and ten accepted ones of each quiz's difficulty, with the category of their topic (of several
    of one name the first)."""
    read = lambda text: dialect.runner(text, VIEWS)(spark, sf_dir)
    answers = read("select a.quiz_id, a.question_order, a.title as topic, a.is_correct, q.difficulty from quiz_answers a join quizzes q on q.id = a.quiz_id")
    answers = answers.withColumn("id", F.col("quiz_id") * 100 + F.col("question_order"))
    rejected = answers.where("not is_correct").withColumn("outcome", F.lit("rejected"))
    accepted = bottom_k(answers.where("is_correct"), ["difficulty"], "id", ACCEPTED).withColumn("outcome", F.lit("accepted"))
    names = read("select lower(trim(topic)) as name, min(category) as category from topics group by lower(trim(topic))")
    rows = rejected.unionByName(accepted).withColumn("name", F.lower(F.trim("topic")))
    return rows.join(names, "name", "left").select("outcome", "id", "difficulty", "topic", "category")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"dom_diag_samples": dom_diag_samples}
