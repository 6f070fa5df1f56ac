"""Spaced repetition: each card's reviews, in order, turn into its next interval. As a batch fold with SQL functions and as
a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interval doubles up to here, which keeps it in 64 bits; and the days from which no date follows.
MOST, LAST = 1 << 61, 2_900_000


def step(days: Column, correct: Column, difficulty: Column) -> Column:
    """The interval in days after one review."""
    return (
        F.when(~correct, F.lit(1))
        .when(difficulty == 1, F.greatest(F.lit(1), F.shiftright(days, 1)))
        .when(difficulty == 2, days + 1)
        .when(difficulty == 3, days * 2)
        .otherwise(days + 3)
        .cast("long")
    )


def next_interval(days: int, correct: bool, difficulty: int) -> int:
    if not correct:
        return 1
    return {1: max(1, days // 2), 2: days + 1, 3: days * 2}.get(difficulty, days + 3)


def intervals(reviews: DataFrame) -> DataFrame:
    """flashcard_id, n_reviews, last_review, interval_days, next_review (null beyond ``LAST`` days, where dates end)."""
    review = F.struct("reviewed_at", "id", "is_correct", "difficulty")
    fold = F.aggregate("log", F.lit(1).cast("long"), lambda d, r: F.least(F.lit(MOST), step(d, r.is_correct, r.difficulty)))
    log = reviews.groupBy("flashcard_id").agg(F.array_sort(F.collect_list(review)).alias("log"), F.max("reviewed_at").alias("last_review"))
    out = log.select("flashcard_id", F.size("log").cast("long").alias("n_reviews"), "last_review", fold.alias("interval_days"))
    near = F.when(F.col("interval_days") <= LAST, F.col("interval_days").cast("int"))
    return out.withColumn("next_review", F.col("last_review") + F.make_dt_interval(near))


def stream_intervals(reviews: DataFrame) -> DataFrame:
    """The same over a stream of reviews (flashcard_id, reviewed_at, is_correct, difficulty): one row a card and batch. The
    reviews of a batch are ordered by time; a late one counts when it arrives."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        days, n = state.get if state.exists else (1, 0)
        rows = pd.concat(list(batches)).sort_values("reviewed_at")
        for correct, difficulty in zip(rows.is_correct, rows.difficulty, strict=True):
            days, n = min(MOST, next_interval(days, bool(correct), int(difficulty))), n + 1
        state.update((int(days), int(n)))
        yield pd.DataFrame({"flashcard_id": [key[0]], "interval_days": [days], "n_reviews": [n]})

    return reviews.groupBy("flashcard_id").applyInPandasWithState(update, "flashcard_id long, interval_days long, n_reviews long", "days long, n long", "update", "NoTimeout")


def windowed_activity(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events a window and kind; rows later than the watermark are left out when run as a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
