"""Checks of what the professor says: which of eight kinds of text may be shown for a study plan.

A text fails by any of its kind's faults; all faults of a text are put out. Predicates over patterns are SQL functions; which of a
plan's names a text contains (as they are, inside words too) comes from one pass of an automaton of the plan's names
over the text, kept by each Python worker for the plans it meets.

Texts have plan_id, module_index, text and, for homework, debrief. A plan has plan_id, quizzes, flashcards, mixed (how many
activities of each), more_modules, categories (array) and modules, an array of module_index, categories, topics, quizzes
and flashcards; a module that a plan does not have has no names and no activities.

Names are compared in lower case, and equal ones count once. A null or blank text has the fault empty and no other. A text without a plan is checked as one of a plan without anything."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that a text must not contain, phrases and patterns of each fault, in lower case
CONTAINS: dict[str, tuple[str, ...]] = {
    "forbidden_term": ("software", "system", "application", "gpt", "chatgpt", "openai", "planner", "algorithm", "implementation", "prompt", "generated plan", "generated study plan", "language model", "ai model"),
    "mentions_quiz": ("quiz", "questionari"),
    "mentions_flashcards": ("flashcard", "flashcards", "carte"),
    "claims_mix": ("activity mix", "mix of activities", "mix of quizzes", "mixed activities", "combination of activities", "combines assessment", "combines quizzes", "combines flashcards", "variety of activities", "alternating assessment", "alternating quizzes", "mix di attività", "mix di quiz", "combinazione di attività", "combina quiz", "combina flashcard", "varietà di attività", "alternanza tra"),
    "claims_everything": ("all material is included", "all the material is included", "everything is included", "tutto il materiale rientra", "tutti gli argomenti rientrano"),
    "claims_more_modules": ("additional modules", "more modules", "future study plans", "moduli aggiuntivi", "altri moduli", "piani successivi"),
}
PATTERNS: dict[str, tuple[str, ...]] = {
    "category_list": (r"\bselected categories (are|include)\b", r"\bcategories (are|include)\b", r"\bthe categories selected\b", r"\ble categorie selezionate\b", r"\ble categorie sono\b", r"\ble categorie includono\b"),
    "statistics": (
        r"\b(contains|has|includes|consists of)\s+\d+\s+(modules?|quizzes|flashcards|questions?)\b",
        r"\b\d+\s+(modules?|quizzes|flashcards|questions?)\b",
        r"\b(the\s+)?study plan (contains|has|includes|consists of|is divided into)\b",
        r"\bthere are\s+\d+\b",
        r"\b(contiene|ha|include|comprende)\s+\d+\s+(moduli|quiz|flashcard|domande)\b",
        r"\b\d+\s+(moduli|quiz|flashcard|domande)\b",
        r"\bil piano di studio (contiene|ha|include|comprende|è diviso in)\b",
        r"\bci sono\s+\d+\b",
    ),
    "topic_list": (r"\btopics (are|include)\b", r"\bselected topics\b", r"\btopic list\b", r"\bgli argomenti sono\b", r"\bgli argomenti includono\b", r"\belenco degli argomenti\b"),
    "documentation": (
        r"\bthis (study )?plan (shows|displays|presents|lists|summarizes|describes)\b",
        r"\bthe (study )?plan is (organized|structured|generated|created)\b",
        r"\bthis module (shows|displays|presents|lists|summarizes|describes|contains|includes)\b",
        r"\bthe module (shows|displays|presents|lists|summarizes|describes|contains|includes)\b",
        r"\bthis module includes? (one|two|three|\d+)\b",
        r"\bthis module contains? (one|two|three|\d+)\b",
        r"\byou can see\b",
        r"\bas shown\b",
        r"\bvisible on (the )?(screen|dashboard|page)\b",
        r"\bil piano (mostra|presenta|elenca|riassume|descrive)\b",
        r"\bil piano di studio è (organizzato|strutturato|generato|creato)\b",
        r"\bquesto modulo (mostra|presenta|elenca|riassume|descrive|contiene|include)\b",
        r"\bil modulo (mostra|presenta|elenca|riassume|descrive|contiene|include)\b",
        r"\bcome mostrato\b",
        r"\bvisibile (sullo schermo|nella dashboard|nella pagina)\b",
    ),
    "generic_objective": (
        r"\blearn more\b",
        r"\bimprove (your )?knowledge\b",
        r"\bdeepen (your )?understanding\b",
        r"\bunderstand better\b",
        r"\bstudy the material\b",
        r"\bcomplete (today'?s )?activities\b",
        r"\bcomplete the module\b",
        r"\bfinish the module\b",
        r"\bwe will study\b",
        r"\bwe will cover\b",
        r"\bimparare di più\b",
        r"\bmigliorare (la )?conoscenza\b",
        r"\bcapire meglio\b",
        r"\bstudiare il materiale\b",
        r"\bcompletare (le )?attività\b",
        r"\bcompletare il modulo\b",
        r"\bstudieremo\b",
        r"\btratteremo\b",
    ),
    "generic_homework": (r"\breview\b", r"\bstudy again\b", r"\bstudy the material\b", r"\blearn more\b", r"\bgo over\b", r"\bripassa\b", r"\brivedi\b", r"\bstudia di nuovo\b", r"\bstudia il materiale\b", r"\bapprofondisci\b"),
    "several_tasks": (r"\bin addition\b", r"\balso complete\b", r"\balso do\b", r"\bseparate task\b", r"\bsecond task\b", r"\bthen do another\b", r"\binoltre\b", r"\bfai anche\b", r"\bsecondo compito\b", r"\bun compito separato\b"),
    "institutional": (
        r"\bstudents? should\b",
        r"\bstudents? will\b",
        r"\blearners? should\b",
        r"\blearners? will\b",
        r"\bthe student should\b",
        r"\bthe student will\b",
        r"\bthe student is expected to\b",
        r"\ba successful student should\b",
        r"\bgli studenti dovrebbero\b",
        r"\bgli studenti sapranno\b",
        r"\blo studente dovrebbe\b",
        r"\blo studente saprà\b",
    ),
    "addresses_learner": (r"\byou\b", r"\byour\b", r"\byou'll\b", r"\byou will\b", r"\byou should\b", r"\bdovresti\b", r"\bsarai\b", r"\bsaprai\b", r"\bpotrai\b", r"\briuscirai\b", r"\bti\b"),
    "repeated_opening": (r"^we are studying this module now\b", r"^we're studying this module now\b", r"^today we are working to see\b", r"^oggi lavoriamo per capire quanto\b"),
    "repeats_score": (
        r"\b(score|scored|accuracy|result)\s+(is|was|of|:)?\s*\d+([.,]\d+)?\s*(%|/)",
        r"\b\d+([.,]\d+)?\s*(%|/)\s*(score|accuracy|correct|result)\b",
        r"\b(punteggio|accuratezza|risultato)\s+(è|era|di|:)?\s*\d+([.,]\d+)?\s*(%|/)",
    ),
    "lists_questions": (r"\bquestion\s+\d+\b", r"\bquestions?\s+\d+\s*(and|,)\s*\d+\b", r"\bdomanda\s+\d+\b", r"\bdomande\s+\d+\s*(e|,)\s*\d+\b"),
    "lists_modules": (r"\bmodule\s+\d+\b", r"\bmodules?\s+\d+\s*(and|,)\s*\d+\b", r"\bmodulo\s+\d+\b", r"\bmoduli\s+\d+\s*(e|,)\s*\d+\b"),
}
#: Share of a homework's longer words that its debrief has, from which it repeats it, and the words that both must have.
REPEATED, LEAST_WORDS = 0.65, 6


@dataclass(frozen=True)
class Kind:
    """Most words (0: any) and the faults that count."""

    words: int
    faults: tuple[str, ...]


_LISTS = ("forbidden_term", "names_categories", "statistics", "topic_list", "documentation")
_MODULE = ("names_module_categories", "names_module_topics")
KINDS: dict[str, Kind] = {
    "plan_briefing": Kind(0, ("forbidden_term", "quiz_not_planned", "flashcards_not_planned", "mix_not_planned", "everything_included", "no_more_modules", "names_categories", "statistics", "topic_list", "documentation")),
    "daily_briefing": Kind(90, (*_LISTS, "repeated_opening", "quiz_not_in_module", "flashcards_not_in_module")),
    "module_objective": Kind(90, (*_LISTS, *_MODULE, "generic_objective", "institutional", "no_address")),
    "activity_debrief": Kind(120, (*_LISTS, *_MODULE, "repeats_score", "lists_questions", "no_address")),
    "module_debrief": Kind(140, (*_LISTS, *_MODULE, "repeats_score", "lists_questions", "no_address")),
    "plan_debrief": Kind(180, (*_LISTS, "repeats_score", "lists_questions", "lists_modules", "no_address")),
    "homework": Kind(80, (*_LISTS, *_MODULE, "repeats_score", "no_address", "generic_homework", "several_tasks", "repeats_debrief")),
    "question_answer": Kind(180, ("forbidden_term", "statistics", "repeats_score", "no_address")),
}


@lru_cache(maxsize=512)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def contained(text: pd.Series, names: pd.Series) -> pd.Series:
    """The distinct ones of ``names`` that each text contains."""
    out = []
    for t, held in zip(text, names, strict=True):
        held = tuple(sorted({n for n in (held if held is not None else ()) if n}))
        out.append(sorted({name for _, name in _automaton(held).iter(t)}) if held and t else [])
    return pd.Series(out)


def cleaned(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")))


def predicate(name: str, text: Column) -> Column:
    if name in CONTAINS:
        test = F.lit(False)
        for term in CONTAINS[name]:
            test = test | F.contains(text, F.lit(term))
        return test
    return F.rlike(text, F.lit("(?U)" + "|".join(f"(?:{p})" for p in PATTERNS[name])))


def _long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b([\wÀ-ÿ']{5,})\b")))


def _repeats(text: Column, debrief: Column) -> Column:
    own, other = _long_words(text), _long_words(F.lower(F.coalesce(debrief, F.lit(""))))
    return (F.size(own) >= LEAST_WORDS) & (F.size(other) >= LEAST_WORDS) & (F.size(F.array_intersect(own, other)) / F.size(own) >= REPEATED)


def _fault(name: str, text: Column) -> Column:
    """Whether a text has a fault; columns of the plan and module stand beside it."""
    says = lambda p: predicate(p, text)
    named = lambda c: F.size(c)
    rules = {
        "no_address": lambda: ~says("addresses_learner"),
        "quiz_not_planned": lambda: (F.col("quizzes") == 0) & says("mentions_quiz"),
        "flashcards_not_planned": lambda: (F.col("flashcards") == 0) & says("mentions_flashcards"),
        "mix_not_planned": lambda: ~(((F.col("quizzes") > 0) & (F.col("flashcards") > 0)) | (F.col("mixed") > 0)) & says("claims_mix"),
        "everything_included": lambda: F.col("more_modules") & says("claims_everything"),
        "no_more_modules": lambda: ~F.col("more_modules") & says("claims_more_modules"),
        "names_categories": lambda: says("category_list") | ((F.col("n_categories") >= 2) & (named("said_categories") >= F.least(F.lit(3), F.col("n_categories")))),
        "quiz_not_in_module": lambda: (F.col("module.quizzes") == 0) & says("mentions_quiz"),
        "flashcards_not_in_module": lambda: (F.col("module.flashcards") == 0) & says("mentions_flashcards"),
        "names_module_categories": lambda: named("said_module_categories") >= 2,
        "names_module_topics": lambda: named("said_module_topics") >= 2,
        "repeats_debrief": lambda: _repeats(text, F.col("debrief")),
    }
    return rules[name]() if name in rules else says(name)


def checked(texts: DataFrame, plans: DataFrame, kind: str) -> DataFrame:
    """``texts`` with valid and faults (array of names, in the order of the kind)."""
    rule = KINDS[kind]
    said = F.pandas_udf(contained, "array<string>")
    carried = texts.columns
    if "debrief" not in carried:
        texts = texts.withColumn("debrief", F.lit(None).cast("string"))
    lower = lambda xs: F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    met = texts.join(plans, "plan_id", "left").withColumn("clean", cleaned(F.col("text")))
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quizzes", "flashcards", "mixed")} | {"more_modules": F.coalesce("more_modules", F.lit(False)), "own_categories": lower(F.col("categories"))})
    module = F.get(F.filter("modules", lambda m: m.module_index == F.col("module_index")), F.lit(0))
    none = F.array().cast("array<string>")
    module = F.struct(lower(module.categories).alias("categories"), lower(module.topics).alias("topics"), F.coalesce(module.quizzes, F.lit(0)).alias("quizzes"), F.coalesce(module.flashcards, F.lit(0)).alias("flashcards"))
    met = met.withColumn("module", module).withColumn("n_categories", F.size("own_categories"))
    names = F.array_distinct(F.concat("own_categories", F.coalesce("module.categories", none), F.coalesce("module.topics", none)))
    met = met.withColumn("said", said("clean", names))
    met = met.withColumns({"said_categories": F.array_intersect("said", "own_categories"), "said_module_categories": F.array_intersect("said", "module.categories"), "said_module_topics": F.array_intersect("said", "module.topics")})
    clean = F.col("clean")
    faults = [F.when(_fault(name, clean), F.lit(name)) for name in rule.faults]
    if rule.words:
        faults.insert(0, F.when(F.size(F.split(clean, " ")) > rule.words, F.lit("too_long")))
    found = F.when(clean == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*faults)))
    return met.withColumn("faults", found).withColumn("valid", F.size("faults") == 0).select(*carried, "valid", "faults")
