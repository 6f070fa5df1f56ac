"""Registry: key -> the DataFrame query and the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .operators import all_pairs, assignment, feeds, listing_queries, ranks, samples, voice_queries
from .operators import queries as programs
from .plans import dialect, domain, planner, relational, scalar
from .plans.adapters import RUN_VIEWS, VIEWS


@dataclass(frozen=True)
class Item:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


@lru_cache(maxsize=1)
def catalog() -> dict[str, Item]:
    found: dict[str, Item] = {}
    for module in (relational, scalar, domain, planner):
        for key, text in module.PLANS.items():
            found[key] = Item(dialect.runner(text, RUN_VIEWS), dialect.oracle(text, VIEWS))
    for function, text in programs.QUERIES.items():
        found[function.__name__] = Item(function, dialect.oracle(text, VIEWS) if text else None)
    for key, (run, text) in (assignment.QUERIES | feeds.QUERIES | ranks.QUERIES).items():
        found[key] = Item(run, dialect.oracle(text, VIEWS))
    for key, (run, text) in (voice_queries.QUERIES | listing_queries.QUERIES).items():  # plain SQL of the other engine
        found[key] = Item(run, text)
    found |= {key: Item(run) for key, run in samples.QUERIES.items()}
    for key, run in all_pairs.RUNS.items():
        found[key] = Item(run, found[key].oracle)
    return found
