"""Order-dependent packing of study work: the week scheduler and the module composer, per plan by ``applyInPandas``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

OPENING, FURTHER = 0.40, 0.30


def schedule(segments: list[tuple[str, float]], sessions: int, budget: float) -> list[list[int]]:
    """Segments (category, minutes) in order into sessions. A session takes the next segment while it fits; a category that
    is new to it also needs a share of the budget that grows with the categories it has. Nothing is skipped."""
    out: list[list[int]] = []
    at = 0
    for _ in range(sessions):
        taken: list[int] = []
        left, seen = budget, set()
        while at < len(segments):
            category, minutes = segments[at]
            fresh = category not in seen
            if taken and (minutes > left or fresh and left < budget * (OPENING + FURTHER * (len(seen) - 1))):
                break
            if not taken and minutes > left:
                break
            taken.append(at)
            left -= minutes
            seen.add(category)
            at += 1
        if not taken:
            break
        out.append(taken)
    return out


def compose(activities: list[tuple[str, int, int, float]], modules: int | None, budget: float) -> list[list[tuple[int, int]]]:
    """Activities (category, topics, default size, minutes an item) into modules of (activity, size). Sizes shrink to what is
    left of the budget, never below the number of topics; what does not fit opens the next module, what never fits goes."""
    out: list[list[tuple[int, int]]] = [[]]
    left = budget
    for i, (_, topics, default, each) in enumerate(activities):
        wanted = max(default, topics)
        for fresh in (False, True):
            size = min(wanted, math.floor((budget if fresh else left) / each + 1e-9))
            if size >= topics and size > 0:
                if fresh and out[-1]:
                    out.append([])
                    left = budget
                out[-1].append((i, size))
                left -= size * each
                break
    found = [m for m in out if m]
    return found if modules is None else found[:modules]


def schedule_projects(segments: DataFrame, sessions: int, budget: float) -> DataFrame:
    """segments (project_id, ord, category, minutes) -> project_id, session, ord."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        packed = schedule(list(zip(rows.category, rows.minutes, strict=True)), sessions, budget)
        found = [(rows.project_id.iloc[0], k, rows.ord.iloc[i]) for k, taken in enumerate(packed, 1) for i in taken]
        return pd.DataFrame(found, columns=["project_id", "session", "ord"])

    return segments.groupBy("project_id").applyInPandas(one, "project_id long, session long, ord long")


def compose_projects(activities: DataFrame, modules: int | None, budget: float) -> DataFrame:
    """activities (project_id, ord, category, topics, size, minutes) -> project_id, module, ord, size."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        packed = compose(list(zip(rows.category, rows.topics, rows["size"], rows.minutes, strict=True)), modules, budget)
        found = [(rows.project_id.iloc[0], k, rows.ord.iloc[i], n) for k, taken in enumerate(packed, 1) for i, n in taken]
        return pd.DataFrame(found, columns=["project_id", "module", "ord", "size"])

    return activities.groupBy("project_id").applyInPandas(one, "project_id long, module long, ord long, size long")
