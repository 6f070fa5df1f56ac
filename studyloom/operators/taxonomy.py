"""Names of taxonomy categories: their tokens, which of two names is better, and which are names of one category."""

from __future__ import annotations

from ..plans.scalar import GENERIC, NOISE, SUFFIXES
from .text_rules import fold, prefix_matches

# fixed values: the limits of the alias rules and of merging
STRICT = {"lexical": 0.60, "centroid": 0.82, "affinity": 0.65, "size_ratio": 1.5}
BALANCED = {"lexical": 0.40, "centroid": 0.72, "affinity": 0.62, "size_ratio": 1.5, "topics": 12}
SAME_NAME = {"centroid": 0.68, "affinity": 0.58, "size_ratio": 2.0, "topics": 12}
MERGE = {"neighbours": 2, "score": 0.78, "centroid": 0.75, "affinity": 0.60, "cohesion": 0.80, "loss": 0.06, "alias_loss": 0.065, "spread": 0.58, "fraction": 0.25, "most": 40}


def tokens(name: str) -> list[str]:
    """Tokens of a category name without their endings."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in fold(name)).split()
    return [next((w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) > len(s) + 3), w) for w in words]


def core(name: str) -> set[str]:
    return set(tokens(name)) - set(NOISE)


def quality(name: str) -> tuple:
    """Order of preference among names: less generic, less noise, fewer tokens, shorter, alphabetical."""
    found = tokens(name)
    distinct = set(found)
    return (int(bool(distinct & set(GENERIC))), len(distinct & set(NOISE)), len(distinct), len(" ".join(found)), name)


def alias_kind(a: str, b: str, count_a: int, count_b: int, lexical: float, centroid: float, affinity: float) -> str | None:
    """Which rule, if any, makes two categories one."""
    x, y = core(a), core(b)
    matches = prefix_matches(x, y)
    size_ratio, together = max(count_a, count_b) / min(count_a, count_b), count_a + count_b
    contained = bool(x) and bool(y) and (x < y or y < x)

    def reaches(limit: dict) -> bool:
        return lexical >= limit.get("lexical", 0) and centroid >= limit["centroid"] and affinity >= limit["affinity"] and size_ratio <= limit["size_ratio"] and together <= limit.get("topics", together)

    alike = not contained and matches >= 2
    if alike and reaches(STRICT):
        return "strict_lexical_semantic_alias"
    if x and (x == y or len(x) == len(y) == matches) and reaches(SAME_NAME):
        return "normalized_name_alias"
    return "balanced_lexical_semantic_alias" if alike and reaches(BALANCED) else None
