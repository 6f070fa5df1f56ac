"""A week of study for every project: categories by priority, their topics in slices, strategies, modules, activities.

Every step is a join, window or expression over all projects but one: filling modules depends on what the module before took, so
allocations come project by project in order through a fold that holds one open module and stops at the last module wanted.

``plans`` has project_id, week_id, week_start, budget_minutes, pace_seconds, sessions (0: any number of modules); ``analytics``
has project_id, category, ord (the place in the project), accuracy, quiz_accuracy, flashcard_accuracy, coverage,
days_since_review (nulls: no evidence) and weight (null: 1); ``topics`` has project_id, category, id, ord (may be null) and
seen (the place in which they were given)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: shares of the priority, limits of strategies, sizes of activities by depth, seconds of a card
PERFORMANCE, RECENCY, COVERAGE, MANUAL, MOST_DAYS = 40.0, 25.0, 25.0, 10.0, 30
LOW_PERFORMANCE, LOW_COVERAGE, STALE = 0.60, 0.50, 14
UNSTABLE, WEAK_QUIZ, WEAK_CARDS = 0.75, 0.60, 0.70
QUESTIONS, CARDS = {"LIGHT": 6, "NORMAL": 10, "DEEP": 15}, {"LIGHT": 8, "NORMAL": 12, "DEEP": 18}
CARD_SECONDS = 30

_PACKED = "project_id long, module_index int, place int, category string, segment long, kind string, questions int, cards int, minutes double, codes array<string>, topics array<long>"


def priority(accuracy: Column, coverage: Column, days: Column, weight: Column) -> Column:
    clamp = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))  # noqa: E731  greatest passes over nulls
    none = lambda x: F.coalesce(x, F.lit(0.0))
    recency = F.least(F.greatest(days, F.lit(0)), F.lit(MOST_DAYS)) / MOST_DAYS * RECENCY
    total = none((1 - clamp(accuracy)) * PERFORMANCE) + none(recency) + none((1 - clamp(coverage)) * COVERAGE) + (weight - 1.0) * MANUAL
    return F.bround(total, 4)


def ranked_categories(analytics: DataFrame) -> DataFrame:
    """``analytics`` with score and rank, from 1 in each project."""
    held = analytics.withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    held = held.withColumn("score", priority(F.col("accuracy"), F.col("coverage"), F.col("days_since_review"), F.col("weight")))
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), F.lower("category"), "category")
    return held.withColumn("rank", F.row_number().over(order))


def strategies(ranked: DataFrame, sizes: DataFrame) -> DataFrame:
    """``ranked`` with reason, strategy, depth, kind, questions, cards, codes; ``sizes``: project_id, category, n_topics."""
    acc, cov, days = F.col("accuracy"), F.col("coverage"), F.col("days_since_review")
    reason = (
        F.when(acc.isNull() & cov.isNull(), "INSUFFICIENT_EVIDENCE")
        .when(cov < LOW_COVERAGE, "LOW_COVERAGE")
        .when(acc < LOW_PERFORMANCE, "LOW_PERFORMANCE")
        .when(days >= STALE, "NOT_RECENTLY_REVIEWED")
        .when(F.col("weight") > 1, "HIGH_PRIORITY")
        .otherwise("STABLE_PERFORMANCE")
    )
    held = ranked.join(sizes, ["project_id", "category"], "left").withColumn("reason", reason)
    strategy = F.when(F.col("reason").isin("INSUFFICIENT_EVIDENCE", "LOW_COVERAGE"), "EXPLORE").when(F.col("reason") == "LOW_PERFORMANCE", "REINFORCE").when(F.col("reason") == "NOT_RECENTLY_REVIEWED", "REVIEW").otherwise("ASSESSMENT")
    depth = F.when(F.coalesce("n_topics", F.lit(0)) <= 1, "LIGHT").when(F.col("reason").isin("INSUFFICIENT_EVIDENCE", "LOW_COVERAGE", "LOW_PERFORMANCE"), "DEEP").when((acc >= 0.85) & (cov >= 0.85), "LIGHT").otherwise("NORMAL")
    return typed(held.withColumns({"strategy": strategy, "depth": depth}))


def typed(held: DataFrame) -> DataFrame:
    """Kind, sizes and reasons of the activities, by strategy, depth and evidence."""
    quiz, cards = F.coalesce(F.col("quiz_accuracy") < WEAK_QUIZ, F.lit(False)), F.coalesce(F.col("flashcard_accuracy") < WEAK_CARDS, F.lit(False))
    unstable = F.coalesce(F.col("accuracy") < UNSTABLE, F.lit(False))
    is_ = lambda x: F.col("strategy") == x
    kind = (
        F.when(is_("REINFORCE"), F.when(quiz & cards, "QUIZ_PLUS_FLASHCARDS").when(quiz, "QUIZ").otherwise("FLASHCARDS"))
        .when(is_("REVIEW"), F.when(unstable, "QUIZ").otherwise("FLASHCARDS"))
        .otherwise("QUIZ")
    )
    size = lambda table: F.coalesce(*(F.when(F.col("depth") == d, n) for d, n in table.items()))
    held = held.withColumn("kind", kind)
    codes = F.array_compact(
        F.array(
            F.when(is_("EXPLORE"), "EXPLORE_NEW_AREA").when(is_("ASSESSMENT"), "ASSESS_KNOWLEDGE").when(is_("REINFORCE"), "LOW_ACCURACY").otherwise("LONG_TIME_WITHOUT_REVIEW"),
            F.when(F.col("accuracy").isNull() & F.col("coverage").isNull(), "INSUFFICIENT_DATA"),
            F.when(F.col("weight") > 1, "HIGH_PRIORITY"),
            F.when(is_("REVIEW") & (F.col("kind") == "QUIZ"), "PERFORMANCE_UNSTABLE"),
        )
    )
    return held.withColumns({"questions": F.when(F.col("kind") != "FLASHCARDS", size(QUESTIONS)).otherwise(0), "cards": F.when(F.col("kind") != "QUIZ", size(CARDS)).otherwise(0), "codes": codes})


def slices(topics: DataFrame, plans: DataFrame) -> DataFrame:
    """project_id, category, segment, topics: runs of as many topics as fit a budget; an id counts where it is seen first, and
    the order given counts where every topic of the category has one."""
    first = Window.partitionBy("project_id", "category", "id").orderBy("seen")
    own = topics.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")
    whole = Window.partitionBy("project_id", "category")
    own = own.withColumn("by", F.when(F.count_if(F.col("ord").isNull()).over(whole) == 0, F.col("ord")))
    at = F.row_number().over(whole.orderBy("by", "seen")) - 1
    cap = F.floor(F.col("budget_minutes") * 60 / F.col("pace_seconds"))
    fit = plans.where("budget_minutes > 0 and pace_seconds > 0").select("project_id", cap.alias("cap")).where("cap > 0")
    placed = own.withColumn("at", at).join(fit, "project_id").withColumn("segment", F.floor(F.col("at") / F.col("cap")))
    run = placed.groupBy("project_id", "category", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("run"))  # cap topics at most
    return run.select("project_id", "category", "segment", F.transform("run", lambda x: x.id).alias("topics"))


def resized(kind: str, questions: int, cards: int, least: int, minutes: float, pace: float) -> tuple[int, int, float] | None:
    """Sizes that fit the minutes and still have an item for each topic, and what they take; None if there are none."""
    if minutes <= 0 or not least:
        return None
    seconds = 0.0
    if kind != "FLASHCARDS":
        questions = min(max(questions, least), math.floor(minutes * 60 / pace))
        seconds += questions * pace
    if kind != "QUIZ":
        cards = min(max(cards, least), math.floor(minutes * 60 / CARD_SECONDS))
        seconds += cards * CARD_SECONDS
    taken = round(seconds / 60, 4)
    if (kind != "FLASHCARDS" and questions < least) or (kind != "QUIZ" and cards < least) or taken > minutes:
        return None
    return questions, cards, taken


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Allocations in order, those of a project next to each other, into its modules."""
    project, module, held, used = None, 1, 0, 0.0
    names = [c.split(" ")[0] for c in _PACKED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["project_id"] != project:
                project, module, held, used = r["project_id"], 1, 0, 0.0
            last = r["sessions"]
            if last and module > last:
                continue
            ask = lambda minutes, r=r: resized(r["kind"], r["questions"], r["cards"], len(r["topics"]), minutes, r["pace_seconds"])
            found = ask(r["budget_minutes"] - used)
            if found is None and held:
                module, held, used = module + 1, 0, 0.0
                if last and module > last:
                    continue
                found = ask(r["budget_minutes"])
            if found is None:
                continue
            questions, cards, minutes = found
            used += minutes
            held += 1
            out.append((project, module, held, r["category"], r["segment"], r["kind"], questions, cards, minutes, r["codes"], r["topics"]))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def modules(categories: DataFrame, segments: DataFrame, plans: DataFrame) -> DataFrame:
    """Allocations in their modules: ``categories`` has rank, kind, questions, cards and codes."""
    of_plan = plans.select("project_id", F.col("budget_minutes").cast("double").alias("budget_minutes"), F.col("pace_seconds").cast("double").alias("pace_seconds"), F.col("sessions").cast("int").alias("sessions"))
    rows = segments.join(categories.select("project_id", "category", "rank", "kind", "questions", "cards", "codes"), ["project_id", "category"]).join(of_plan, "project_id")
    return rows.repartition("project_id").sortWithinPartitions("project_id", "rank", "segment").mapInArrow(_packed, _PACKED)


def goals(packed: DataFrame) -> DataFrame:
    """project_id, module_index, minutes, goal, summary of each module."""
    kinds, codes = F.collect_set("kind").alias("kinds"), F.flatten(F.collect_set("codes")).alias("codes")
    held = packed.groupBy("project_id", "module_index").agg(F.count("*").alias("n"), F.bround(F.sum("minutes"), 4).alias("minutes"), kinds, codes)
    has = lambda c: F.array_contains("codes", c)
    goal = F.when(F.size("kinds") > 1, "MIXED_OBJECTIVES").when(has("EXPLORE_NEW_AREA"), "EXPLORE_AND_MEASURE").when(has("LOW_ACCURACY"), "REINFORCE_LEARNING").when(has("LONG_TIME_WITHOUT_REVIEW"), "REVIEW_RETENTION").otherwise("ASSESS_KNOWLEDGE")
    summary = F.array_compact(
        F.array(F.when(F.col("n") > 1, "MULTI_CATEGORY_SESSION"), F.when(F.array_contains("kinds", "QUIZ"), "EVIDENCE_GATHERING"), F.when(F.array_contains("kinds", "FLASHCARDS"), "PRACTICE_FOCUSED"), F.when(has("LONG_TIME_WITHOUT_REVIEW"), "REVIEW_FOCUSED"))
    )
    return held.select("project_id", "module_index", "minutes", goal.alias("goal"), summary.alias("summary"))


def activities(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """One row an activity, cards ahead of the quiz of the same topics, with its day, goal and topics."""
    parts = F.filter(F.array(F.struct(F.lit("flashcards").alias("type"), F.col("cards").alias("size"), F.lit(0).alias("ord")), F.struct(F.lit("quiz").alias("type"), F.col("questions").alias("size"), F.lit(1).alias("ord"))), lambda p: p.size > 0)
    rows = packed.withColumn("part", F.explode(parts)).join(goals(packed).withColumnRenamed("minutes", "module_minutes"), ["project_id", "module_index"])
    rows = rows.join(plans.select("project_id", "week_id", "week_start"), "project_id")
    day = F.date_add(F.col("week_start").cast("date"), F.col("module_index") - 1)
    session = F.concat(F.col("week_id"), F.lit("-session-"), F.col("module_index"))
    return rows.select(
        "project_id", "module_index", session.alias("session_id"), day.alias("day"), F.date_format(day, "EEEE").alias("day_name"), "goal", F.array_join("summary", ",").alias("summary"), "module_minutes",
        F.concat(session, F.lit("-strategy-"), F.col("place"), F.lit("-"), F.col("part.type")).alias("activity_id"), F.col("part.type").alias("type"), "category", F.col("part.size").alias("size"), "minutes", F.array_join("codes", ",").alias("codes"), "topics",
    )


def generate_week(plans: DataFrame, analytics: DataFrame, topics: DataFrame) -> DataFrame:
    """The week of each project, by priority."""
    sizes = topics.groupBy("project_id", "category").agg(F.count("*").alias("n_topics"))
    packed = modules(strategies(ranked_categories(analytics), sizes), slices(topics, plans), plans)
    return activities(packed, plans)


def assessment_week(plans: DataFrame, analytics: DataFrame, topics: DataFrame) -> DataFrame:
    """Quizzes over all categories in the project's order, in as many modules as it takes."""
    held = analytics.withColumns({"rank": F.col("ord"), "strategy": F.lit("EXPLORE"), "depth": F.lit("DEEP"), "weight": F.coalesce(F.col("weight").cast("double"), F.lit(1.0))})
    unlimited = plans.withColumn("sessions", F.lit(0))
    return activities(modules(typed(held), slices(topics, plans), unlimited), plans)
