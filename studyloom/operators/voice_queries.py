"""Registered queries of the checks of what the professor says. Texts are the turns of all conversations, each with one of the
phrases; plans are made of the benchmark items: first words are categories, second words topics. The SQL of each query spells
the rules for an engine with other regular expressions and without automata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import voice

Run = Callable[[SparkSession, str], DataFrame]
PHRASES = (
    "You should be able to explain how ownership limits a contract.",
    "This module contains three parts.",
    "The planner picked this for you.",
    "You will answer 12 questions in the quiz.",
    "Flashcards help you keep the terms; a mix of activities follows.",
    "Your accuracy was 80% and question 3 was hard.",
    "Today we complete the module.",
    "Students should study the material; in addition, review the notes.",
    "Everything is included, and more modules follow in module 2.",
    "Dovresti capire meglio perché gli argomenti sono collegati.",
    "Saprai spiegare la differenza.",
    "The selected categories are connected.",
    "Potrai usare le carte e il quiz.",
    "",
)


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null")
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    rows = items.select((F.col("item_id") % 10).alias("plan_id"), (F.col("item_id") % 3).alias("module_index"), (F.col("item_id") % 4).alias("kind"), word(1).alias("category"), word(2).alias("topic"))
    count = lambda test: F.count_if(F.expr(test))
    modules = rows.groupBy("plan_id", "module_index").agg(F.collect_set("category").alias("categories"), F.collect_set("topic").alias("topics"), count("kind in (0, 2)").alias("quizzes"), count("kind in (1, 2)").alias("flashcards"))
    modules = modules.groupBy("plan_id").agg(F.collect_list(F.struct("module_index", "categories", "topics", "quizzes", "flashcards")).alias("modules"))
    whole = rows.groupBy("plan_id").agg(count("kind = 0 and plan_id % 2 = 0").alias("quizzes"), count("kind = 1").alias("flashcards"), count("kind = 2 and plan_id % 3 = 0").alias("mixed"), F.collect_set("category").alias("categories"))
    return whole.join(modules, "plan_id").withColumn("more_modules", F.col("plan_id") % 4 < 2)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = F.array(*map(F.lit, PHRASES))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.concat(F.element_at(phrases, ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES) + 1).cast("int")), F.lit(" \n"), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", (F.col("conv_id") % 11).alias("plan_id"), (F.col("turn") % 4).alias("module_index"), said.alias("text"), F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(F.col("role")).alias("debrief"))


def _checked(kind: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = voice.checked(_texts(spark, sf_dir), _plans(spark, sf_dir), kind)
        return found.select("conv_id", "turn", "valid", F.array_join("faults", ",").alias("faults"))

    return run


def vce_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = voice.cleaned(F.col("text"))
    names = [*voice.CONTAINS, *voice.PATTERNS]
    return _texts(spark, sf_dir).select("conv_id", "turn", *(voice.predicate(n, clean).alias(n) for n in names))


# ---- the same in SQL


def _says(name: str) -> str:
    if name in voice.CONTAINS:
        return "(" + " or ".join(f"contains(clean, '{t}')" for t in voice.CONTAINS[name]) + ")"
    edge = r"[^\pL\pN_]"

    def spelled(p: str) -> str:
        if p.startswith(r"\b"):
            p = rf"(?:^|{edge})" + p[2:]
        if p.endswith(r"\b"):
            p = p[:-2] + rf"(?:$|{edge})"
        return p.replace("'", "''")

    return "(" + " or ".join(f"regexp_matches(clean, '{spelled(p)}')" for p in voice.PATTERNS[name]) + ")"


_SAID = "len(list_filter({0}, lambda n: contains(clean, n)))"
_RULES = {
    "no_address": "not " + _says("addresses_learner"),
    "quiz_not_planned": "quizzes = 0 and " + _says("mentions_quiz"),
    "flashcards_not_planned": "flashcards = 0 and " + _says("mentions_flashcards"),
    "mix_not_planned": "not (quizzes > 0 and flashcards > 0 or mixed > 0) and " + _says("claims_mix"),
    "everything_included": "more_modules and " + _says("claims_everything"),
    "no_more_modules": "not more_modules and " + _says("claims_more_modules"),
    "names_categories": f"({_says('category_list')} or len(categories) >= 2 and {_SAID.format('categories')} >= least(3, len(categories)))",
    "quiz_not_in_module": "m_quizzes = 0 and " + _says("mentions_quiz"),
    "flashcards_not_in_module": "m_flashcards = 0 and " + _says("mentions_flashcards"),
    "names_module_categories": _SAID.format("m_categories") + " >= 2",
    "names_module_topics": _SAID.format("m_topics") + " >= 2",
    "repeats_debrief": f"len(own_words) >= 6 and len(other_words) >= 6 and len(list_intersect(own_words, other_words)) / len(own_words) >= {voice.REPEATED}",
}
_WORDS = r"list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[\pL\pN_''×÷]+'), lambda w: trim(w, '''')), lambda w: len(w) >= 5))"
_BASE = rf"""with items as (select item_id % 10 as plan_id, item_id % 3 as module_index, item_id % 4 as kind, lower(trim(split_part(text, ' ', 1))) as category, lower(trim(split_part(text, ' ', 2))) as topic from benchmark where text is not null),
modules as (select plan_id, module_index, list(distinct category) filter (where category <> '') as m_categories, list(distinct topic) filter (where topic <> '') as m_topics, count(*) filter (where kind in (0, 2)) as m_quizzes, count(*) filter (where kind in (1, 2)) as m_flashcards from items group by all),
plans as (select plan_id, count(*) filter (where kind = 0 and plan_id % 2 = 0) as quizzes, count(*) filter (where kind = 1) as flashcards, count(*) filter (where kind = 2 and plan_id % 3 = 0) as mixed, list(distinct category) filter (where category <> '') as categories, plan_id % 4 < 2 as more_modules from items group by plan_id),
said as (select conv_id, turn, conv_id % 11 as plan_id, turn % 4 as module_index, lower(trim(regexp_replace([{', '.join("'" + p.replace("'", "''") + "'" for p in PHRASES)}][(conv_id * 7 + turn) % {len(PHRASES)} + 1] || ' ' || coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g'))) as clean, lower(coalesce(case when conv_id % 3 = 0 then text else role end, '')) as other from conversations),
met as (select conv_id, turn, clean, coalesce(quizzes, 0) as quizzes, coalesce(flashcards, 0) as flashcards, coalesce(mixed, 0) as mixed, coalesce(categories, []) as categories, coalesce(more_modules, false) as more_modules, coalesce(m_categories, []) as m_categories, coalesce(m_topics, []) as m_topics, coalesce(m_quizzes, 0) as m_quizzes, coalesce(m_flashcards, 0) as m_flashcards, {_WORDS.format('clean')} as own_words, {_WORDS.format('other')} as other_words
        from said left join plans using (plan_id) left join modules using (plan_id, module_index)) """


def _sql(kind: str) -> str:
    rule = voice.KINDS[kind]
    cases = [f"case when {_RULES.get(n) or _says(n)} then '{n}' end" for n in rule.faults]
    if rule.words:
        cases.insert(0, f"case when len(string_split(clean, ' ')) > {rule.words} then 'too_long' end")
    faults = f"case when clean = '' then 'empty' else array_to_string(list_filter([{', '.join(cases)}], lambda f: f is not null), ',') end"
    return f"{_BASE} select conv_id, turn, faults = '' as valid, faults from (select conv_id, turn, {faults} as faults from met) x"


_NUMBERED = ("vce_plan_briefing", "vce_daily_briefing", "vce_module_objective", "vce_activity_debrief", "vce_module_debrief", "vce_plan_debrief", "vce_homework", "vce_question_answer")

#: key -> query, and its SQL for the independent engine
QUERIES: dict[str, tuple[Run, str]] = {key: (_checked(key[4:]), _sql(key[4:])) for key in _NUMBERED} | {
    "vce_predicates": (vce_predicates, _BASE + "select conv_id, turn, " + ", ".join(f"{_says(n)} as {n}" for n in (*voice.CONTAINS, *voice.PATTERNS)) + " from met")
}
