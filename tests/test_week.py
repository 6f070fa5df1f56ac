"""Weeks of study against a plain walk through the rules, project by project."""

import math
import random
from datetime import date, timedelta

import pytest

from studyloom.operators import week

PLANS = "project_id long, week_id string, week_start date, budget_minutes double, pace_seconds int, sessions int"
ANALYTICS = "project_id long, category string, ord int, accuracy double, quiz_accuracy double, flashcard_accuracy double, coverage double, days_since_review int, weight double"
TOPICS = "project_id long, category string, id long, ord int, seen long"


def made(seed: int = 3):
    rnd = random.Random(seed)
    maybe = lambda x: x if rnd.random() < 0.7 else None
    plans, analytics, topics = [], [], []
    for p in range(40):
        plans.append((p, f"w{p}", date(2024, 1, 29), rnd.choice([0.0, 5.0, 12.5, 30.0, 45.0]), rnd.choice([0, 45, 60, 100]) if p else 60, rnd.choice([0, 1, 2, 5])))
        for c in range(rnd.randint(0, 6)):
            name = rnd.choice(["b", "A"]) + f"cat{c}"
            analytics.append((p, name, c + 1, maybe(rnd.random()), maybe(rnd.random()), maybe(rnd.random()), maybe(rnd.random()), maybe(rnd.randint(-3, 40)), maybe(rnd.choice([1.0, 1.2]))))
            ordered = rnd.random() < 0.5
            ids = [p * 1000 + c * 100 + rnd.randint(0, 30) for _ in range(rnd.randint(0, 40))]
            topics += [(p, name, i, rnd.randint(0, 9) if ordered or rnd.random() < 0.9 else None, k) for k, i in enumerate(ids)]
    return plans, analytics, topics


def walked(plans, analytics, topics, assessment: bool):
    out = set()
    for p, week_id, start, budget, pace, sessions in plans:
        cats = [a for a in analytics if a[0] == p]

        def score(a):
            _, _, _, acc, _, _, cov, days, weight = a
            s = (1 - min(max(acc, 0), 1)) * 40 if acc is not None else 0
            s += min(max(days, 0), 30) / 30 * 25 if days is not None else 0
            s += (1 - min(max(cov, 0), 1)) * 25 if cov is not None else 0
            return round(s + ((weight or 1.0) - 1) * 10, 4)

        cats.sort(key=(lambda a: a[2]) if assessment else (lambda a: (-score(a), a[1].casefold())))
        queue = []
        for a in cats:
            own, seen = [], set()
            for t in sorted((t for t in topics if t[0] == p and t[1] == a[1]), key=lambda t: t[4]):
                if t[2] not in seen:
                    seen.add(t[2])
                    own.append(t)
            n = sum(t[0] == p and t[1] == a[1] for t in topics)
            if own and all(t[3] is not None for t in own):
                own.sort(key=lambda t: t[3])
            cap = int(budget * 60 // pace) if pace and budget > 0 else 0
            _, name, _, acc, quiz, card, cov, days, weight = a
            if assessment:
                plan, depth = "EXPLORE", "DEEP"
            else:
                why = "NONE" if acc is None and cov is None else "COVER" if cov is not None and cov < 0.5 else "WEAK" if acc is not None and acc < 0.6 else "STALE" if days is not None and days >= 14 else "OTHER"
                plan = {"NONE": "EXPLORE", "COVER": "EXPLORE", "WEAK": "REINFORCE", "STALE": "REVIEW"}.get(why, "ASSESSMENT")
                depth = "LIGHT" if n <= 1 else "DEEP" if why in ("NONE", "COVER", "WEAK") else "LIGHT" if acc is not None and cov is not None and acc >= 0.85 and cov >= 0.85 else "NORMAL"
            if plan == "REINFORCE":
                q, f = quiz is not None and quiz < 0.6, card is not None and card < 0.7
                kinds = ["flashcards", "quiz"] if q and f else ["quiz"] if q else ["flashcards"]
            elif plan == "REVIEW":
                kinds = ["quiz"] if acc is not None and acc < 0.75 else ["flashcards"]
            else:
                kinds = ["quiz"]
            for i in range(0, len(own) if cap else 0, max(cap, 1)):
                queue.append((name, kinds, depth, [t[2] for t in own[i : i + cap]]))
        limit = None if assessment or not sessions else sessions
        mods, open_, used = [], [], 0.0

        def fit(item, minutes):
            _, kinds, depth, ids = item
            sizes = {"quiz": {"LIGHT": 6, "NORMAL": 10, "DEEP": 15}[depth], "flashcards": {"LIGHT": 8, "NORMAL": 12, "DEEP": 18}[depth]}
            each, total = {"quiz": pace, "flashcards": 30}, 0
            got = {}
            for k in kinds:
                got[k] = min(max(sizes[k], len(ids)), math.floor(minutes * 60 / each[k]))
                if got[k] < len(ids):
                    return None
                total += got[k] * each[k]
            took = round(total / 60, 4)
            return (got, took) if minutes > 0 and took <= minutes else None

        for item in queue:
            if limit is not None and len(mods) >= limit:
                break
            found = fit(item, budget - used)
            if found is None and open_:
                mods.append(open_)
                open_, used = [], 0.0
                if limit is not None and len(mods) >= limit:
                    break
                found = fit(item, budget)
            if found is not None:
                open_.append((item, *found))
                used += found[1]
        if open_ and (limit is None or len(mods) < limit):
            mods.append(open_)
        for m, items in enumerate(mods, 1):
            day = start + timedelta(days=m - 1)
            for place, (item, got, took) in enumerate(items, 1):
                for kind in item[1]:
                    out.add((p, m, day, day.strftime("%A"), f"{week_id}-session-{m}-strategy-{place}-{kind}", kind, item[0], got[kind], took, tuple(item[3])))
    return out


@pytest.mark.parametrize("assessment", [False, True])
def test_weeks_equal_a_walk_through_the_rules(spark, assessment):
    plans, analytics, topics = made()
    frames = spark.createDataFrame(plans, PLANS), spark.createDataFrame(analytics, ANALYTICS).repartition(3), spark.createDataFrame(topics, TOPICS).repartition(3)
    rows = (week.assessment_week if assessment else week.generate_week)(*frames).collect()
    got = {(r.project_id, r.module_index, r.day, r.day_name, r.activity_id, r.type, r.category, r.size, r.minutes, tuple(r.topics)) for r in rows}
    want = walked(plans, analytics, topics, assessment)
    assert got == want and len(rows) == len(want) > 60
    if not assessment:
        assert len({r.goal for r in rows}) >= 3 and {r.type for r in rows} == {"quiz", "flashcards"}


def test_goals_and_summaries(spark):
    packed = [(1, 1, 1, "a", 0, "QUIZ", 5, 0, 5.0, ["LONG_TIME_WITHOUT_REVIEW", "PERFORMANCE_UNSTABLE"], [1]), (1, 1, 2, "b", 0, "QUIZ", 5, 0, 2.5, ["EXPLORE_NEW_AREA"], [2]), (1, 2, 1, "c", 0, "FLASHCARDS", 0, 8, 4.0, ["LOW_ACCURACY"], [3]), (2, 1, 1, "d", 0, "QUIZ", 5, 0, 5.0, ["ASSESS_KNOWLEDGE"], [1]), (2, 1, 2, "e", 0, "QUIZ_PLUS_FLASHCARDS", 5, 5, 5.0, ["LOW_ACCURACY"], [1])]
    got = {(r.project_id, r.module_index): (r.goal, r.summary, r.minutes) for r in week.goals(spark.createDataFrame(packed, week._PACKED)).collect()}
    assert got == {
        (1, 1): ("EXPLORE_AND_MEASURE", ["MULTI_CATEGORY_SESSION", "EVIDENCE_GATHERING", "REVIEW_FOCUSED"], 7.5),
        (1, 2): ("REINFORCE_LEARNING", ["PRACTICE_FOCUSED"], 4.0),
        (2, 1): ("MIXED_OBJECTIVES", ["MULTI_CATEGORY_SESSION", "EVIDENCE_GATHERING"], 10.0),
    }


def test_empty_tables(spark):
    none = spark.createDataFrame([], PLANS), spark.createDataFrame([], ANALYTICS), spark.createDataFrame([], TOPICS)
    assert week.generate_week(*none).collect() == [] == week.assessment_week(*none).collect()
