"""Checks of what the professor says: known cases and the automaton against plain search."""

import random

import pandas as pd
import pytest

from studyloom.operators import voice

PLAN = "plan_id long, quizzes int, flashcards int, mixed int, more_modules boolean, categories array<string>, modules array<struct<module_index:int,categories:array<string>,topics:array<string>,quizzes:int,flashcards:int>>"
MODULE = (1, ["Property", "Contracts"], ["Ownership", "Agreement"], 1, 0)
PLANS = {
    "quiz": (1, 2, 0, 0, False, ["Property", "Contracts"], [MODULE]),
    "both": (2, 2, 2, 0, True, ["Property", "Contracts"], [(1, ["Property"], ["Ownership"], 1, 1)]),
}
CASES = [
    ("plan_briefing", "quiz", "The Planner algorithm selected these categories.", "forbidden_term"),
    ("plan_briefing", "quiz", "This plan will use flashcards for practice.", "flashcards_not_planned"),
    ("plan_briefing", "quiz", "The choice of a mix of quizzes helps us vary the work.", "mix_not_planned"),
    ("plan_briefing", "both", "Combining assessment and consolidation helps separate what is stable from what needs reinforcement.", None),
    ("plan_briefing", "quiz", "The selected categories are Property and Contracts.", "names_categories"),
    ("plan_briefing", "quiz", "We begin with property law and contractsmanship.", "names_categories"),
    ("plan_briefing", "quiz", "This Study Plan contains 2 modules and 2 quizzes.", "statistics"),
    ("plan_briefing", "quiz", "The selected topics include Ownership and Agreement.", "topic_list"),
    ("plan_briefing", "quiz", "This Study Plan shows the categories and activities selected for your work.", "documentation"),
    ("plan_briefing", "both", "Everything is included here.", "everything_included"),
    ("plan_briefing", "quiz", "More modules will follow.", "no_more_modules"),
    ("plan_briefing", "both", "More   modules\nwill follow.", None),
    ("plan_briefing", "quiz", "  \n\t ", "empty"),
    ("plan_briefing", "quiz", None, "empty"),
    ("plan_briefing", "quiz", "Il piano di studio è strutturato in fasi.", "documentation"),
    ("daily_briefing", "quiz", "We will use flashcards to consolidate.", "flashcards_not_in_module"),
    ("daily_briefing", "quiz", "We are studying this module now to learn.", "repeated_opening"),
    ("daily_briefing", "quiz", "Now we are studying this module now.", None),
    ("daily_briefing", "quiz", "word " * 91, "too_long"),
    ("daily_briefing", "quiz", "word " * 90, None),
    ("module_objective", "quiz", "You will connect property and contracts.", "names_module_categories"),
    ("module_objective", "quiz", "You will connect ownership and agreement.", "names_module_topics"),
    ("module_objective", "quiz", "Students should explain how duties arise.", "institutional"),
    ("module_objective", "quiz", "Explain how duties arise.", "no_address"),
    ("module_objective", "quiz", "You will improve your knowledge.", "generic_objective"),
    ("module_objective", "quiz", "You will explain how duties arise.", None),
    ("module_objective", "quiz", "Saprai spiegare come nascono i doveri.", None),
    ("module_objective", "quiz", "Il saprà youth.", "no_address"),
    ("activity_debrief", "quiz", "Your accuracy was 80% today.", "repeats_score"),
    ("activity_debrief", "quiz", "In question 3 you hesitated.", "lists_questions"),
    ("activity_debrief", "quiz", "You explained the core well.", None),
    ("module_debrief", "quiz", "You have a stable line of reasoning.", None),
    ("plan_debrief", "quiz", "In module 2 you hesitated.", "lists_modules"),
    ("homework", "quiz", "Review your notes.", "generic_homework"),
    ("homework", "quiz", "Write your own example. In addition, draw a map.", "several_tasks"),
    ("homework", "quiz", "You could write one example that separates duties from rights.", None),
    ("question_answer", "quiz", "You can see property and contracts here.", None),
    ("question_answer", "quiz", "There are 3 reasons for you.", "statistics"),
]


@pytest.mark.parametrize("kind", sorted({c[0] for c in CASES}))
def test_known_cases(spark, kind):
    plans = spark.createDataFrame(list(PLANS.values()), PLAN)
    rows = [(i, PLANS[p][0], 1, text) for i, (k, p, text, _) in enumerate(CASES) if k == kind]
    got = {r.n: (r.valid, r.faults) for r in voice.checked(spark.createDataFrame(rows, "n int, plan_id long, module_index int, text string"), plans, kind).collect()}
    assert len(got) == len(rows)
    for n, *_ in rows:
        valid, faults = got[n]
        assert valid == (CASES[n][3] is None) and valid == (not faults), CASES[n]
        assert valid or CASES[n][3] in faults, CASES[n]


def test_homework_that_repeats_the_debrief(spark):
    debrief = "You already explained clearly where contractual duties begin and where promises remain informal"
    rows = [(1, 1, debrief + ".", debrief), (2, 1, "You could sketch another example about promises between friends without lawyers nearby", debrief), (3, 1, debrief, None)]
    texts = spark.createDataFrame([(*r[:2], 9, *r[2:]) for r in rows], "n int, plan_id long, module_index int, text string, debrief string")
    got = {r.n: r.faults for r in voice.checked(texts, spark.createDataFrame(list(PLANS.values()), PLAN), "homework").collect()}
    assert got == {1: ["repeats_debrief"], 2: [], 3: []}


def test_texts_without_a_plan_and_clashing_columns(spark):
    plans = spark.createDataFrame(list(PLANS.values()), PLAN)
    texts = spark.createDataFrame([(99, 1, "A quiz follows.", "a"), (None, None, "You will see.", "b")], "plan_id long, module_index int, text string, note string")
    out = voice.checked(texts, plans, "daily_briefing")
    assert out.columns == ["plan_id", "module_index", "text", "note", "valid", "faults"]
    assert {r.note: r.faults for r in out.collect()} == {"a": ["quiz_not_in_module"], "b": []}
    assert voice.checked(texts.limit(0), plans, "homework").collect() == []


def test_names_by_automaton_equal_plain_search():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 4)))
    texts = [rnd.choice([None, ""] + ["".join(rnd.choice("abé  ") for _ in range(40))] * 4) for _ in range(300)]
    names = [rnd.choice([None, [], [word() for _ in range(rnd.randint(1, 8))]]) for _ in range(300)]
    got = voice.contained(pd.Series(texts, dtype=object), pd.Series(names, dtype=object)).tolist()
    assert got == [sorted({n for n in held or [] if n and n in (t or "")}) for t, held in zip(texts, names, strict=True)]
