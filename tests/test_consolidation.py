"""Consolidation in rounds against the rule taken edge by edge, on many random projects at once."""

import itertools
import math

import numpy as np
import pytest

from studyloom.operators import consolidation, taxonomy, text_rules

WORDS = ["GENETIC", "SEQUENCING", "TECHNIQUES", "TECHNOLOGIES", "CELL", "MEMBRANES", "MEMBRANE", "CONTRACTS", "GENERAL", "TYPES OF", "PROPERTY", "OBBLIGAZIONI"]


def one_by_one(categories: dict[str, np.ndarray]):
    """category -> target, and (a, b) -> reason (None: merged)."""
    names = sorted(categories)
    v = {n: np.asarray(x, float) / np.linalg.norm(x, axis=1, keepdims=True) for n, x in categories.items()}
    middle = lambda x: x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))
    tight = lambda x: float(np.mean(x @ middle(x)))

    def metrics(a, b):
        s = v[a] @ v[b].T
        centroid, affinity = float(middle(v[a]) @ middle(v[b])), 0.5 * (s.max(1).mean() + s.max(0).mean())
        lexical = text_rules.lexical_similarity(" ".join(taxonomy.tokens(a)), " ".join(taxonomy.tokens(b)))
        both = np.concatenate([v[a], v[b]])
        loss = max(0.0, (tight(v[a]) * len(v[a]) + tight(v[b]) * len(v[b])) / len(both) - tight(both))
        score = 0.45 * centroid + 0.3 * affinity + 0.15 * lexical + 0.1 * max(0.0, min(1.0, 1 - loss / 0.06))
        return centroid, affinity, score, taxonomy.alias_kind(a, b, len(v[a]), len(v[b]), lexical, centroid, affinity)

    near = {a: sorted((m for m in names if m != a), key=lambda m, a=a: (-float(middle(v[a]) @ middle(v[m])), m))[:2] for a in names}
    pairs = {(a, b): metrics(a, b) for a, b in itertools.combinations(names, 2)}
    total = sum(map(len, v.values()))
    most = min(max(max(map(len, v.values())), math.ceil(total * 0.25)), 40)
    owner, said, edges = {n: {n} for n in names}, {}, []
    for (a, b), (_, _, score, alias) in pairs.items():
        if b in near[a] and a in near[b]:
            if alias or score >= 0.78:
                edges.append((-score, a, b, alias))
            else:
                said[a, b] = "merge_score_below_threshold"
    for _, a, b, alias in sorted(edges):
        if owner[a] is owner[b]:
            continue
        union = owner[a] | owner[b]
        every = np.concatenate([v[n] for n in sorted(union)])
        if len(every) > most:
            said[a, b] = "category_size_limit"
        elif any(not pairs[p][3] and (pairs[p][0] < 0.75 or pairs[p][1] < 0.60) for p in itertools.combinations(sorted(union), 2)):
            said[a, b] = "complete_group_pair_incompatible"
        elif tight(every) < 0.80:
            said[a, b] = "merged_cohesion_below_minimum"
        elif max(0.0, sum(tight(v[n]) * len(v[n]) for n in union) / len(every) - tight(every)) > (0.065 if alias else 0.06):
            said[a, b] = "cohesion_loss_above_maximum"
        elif 1 - min((float(x @ y) for x, y in itertools.combinations(every, 2)), default=1.0) > 0.58:
            said[a, b] = "semantic_spread_above_maximum"
        else:
            said[a, b] = None
            for n in union:
                owner[n] = union
    def name(group):
        if len(group) == 1:
            return min(group)
        central = {n: np.mean([middle(v[n]) @ middle(v[m]) for m in group if m != n]) for n in group}
        return min(group, key=lambda n: (taxonomy.quality(n), -central[n], -len(v[n]), n))
    return {n: name(owner[n]) for n in names}, said


def made(rng, number: int) -> dict[str, np.ndarray]:
    bases = rng.normal(size=(rng.integers(1, 4), 6))
    noise = rng.choice([0.15, 0.3, 0.5])
    # a large category lets groups grow
    out = {"UNRELATED": rng.normal(size=6) + rng.normal(scale=0.2, size=(rng.integers(12, 30), 6))} if number % 2 else {}
    for _ in range(rng.integers(1, 10)):
        name = " ".join(rng.choice(WORDS, rng.integers(1, 4), replace=False))
        base = bases[rng.integers(len(bases))] + rng.normal(scale=noise, size=6)
        out[name] = base + rng.normal(scale=noise, size=(rng.integers(1, 9), 6))
    return out


@pytest.fixture(scope="module")
def thousand():
    rng = np.random.default_rng(11)
    return {n: made(rng, n) for n in range(1000)}


def test_thousand_projects_equal_the_rule_one_by_one(spark, thousand):
    rows = [(n, c, [float(y) for y in x]) for n, cs in thousand.items() for c, v in cs.items() for x in v]
    mapping, audit = consolidation.consolidate(spark.createDataFrame(rows, "project_id long, category string, embedding array<double>").repartition(4))
    got = {(r.project_id, r.category): r.target for r in mapping.collect()}
    said = {(r.project_id, r.a, r.b): r.reason for r in audit.collect()}
    want, reasons = {}, {}
    for n, cs in thousand.items():
        target, why = one_by_one(cs)
        want |= {(n, c): t for c, t in target.items()}
        reasons |= {(n, *k): r for k, r in why.items()}
    assert got == want
    assert said == reasons
    assert sum(r is None for r in reasons.values()) > 300 and len(set(reasons.values())) >= 6


def test_names_of_one_meaning(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=32)
    near = lambda n: base + rng.normal(scale=0.05, size=(n, 32))
    groups = {"CELL MEMBRANES": near(3), "CELL MEMBRANE": near(3), "OTHER": rng.normal(size=(20, 32))}
    ledger = spark.createDataFrame([(1, c, x.tolist()) for c, v in groups.items() for x in v], "project_id long, category string, embedding array<double>")
    found = {r.category: r.target for r in consolidation.consolidate(ledger)[0].collect()}
    assert found["CELL MEMBRANES"] == found["CELL MEMBRANE"] != found["OTHER"] == "OTHER"


def test_no_categories_and_zero_vectors(spark):
    schema = "project_id long, category string, embedding array<double>"
    mapping, audit = consolidation.consolidate(spark.createDataFrame([], schema))
    assert mapping.collect() == [] == audit.collect()
    mapping, audit = consolidation.consolidate(spark.createDataFrame([(1, "A", [1.0, 0.0])], schema))
    assert [tuple(r) for r in mapping.collect()] == [(1, "A", "A")] and audit.collect() == []
    with pytest.raises(Exception, match="zero or missing embedding"):
        consolidation.consolidate(spark.createDataFrame([(1, "A", [0.0, 0.0])], schema))


def test_validation_counts_what_is_broken(spark):
    ledger = spark.createDataFrame([(1, i, "A" if i < 3 else "B") for i in range(5)] + [(1, 4, "B"), (2, 1, "C"), (2, 2, "D")], "project_id long, id long, category string")
    schema = "project_id long, category string, target string"
    broken = lambda rows: {(r.project_id, r.rule): r.violations for r in consolidation.validated(ledger, spark.createDataFrame(rows, schema)).collect() if r.violations}
    good = [(1, "A", "A"), (1, "B", "B"), (2, "C", "C"), (2, "D", "D")]
    assert broken(good) == {(1, "duplicate_topic_ids"): 1}
    assert broken([(1, "A", "A"), (2, "C", "C"), (2, "D", " "), (2, "X", "Y")]) == {
        (1, "duplicate_topic_ids"): 1,
        (1, "mapping_does_not_cover_every_category"): 1,
        (1, "topic_without_final_category"): 3,
        (2, "mapping_does_not_cover_every_category"): 1,
        (2, "topic_without_final_category"): 1,
        (2, "empty_category"): 1,
        (2, "name_is_none_of_its_categories"): 2,
    }
    assert broken([*good, (2, "D", "C")])[2, "topic_assigned_more_than_once"] == 1
    assert broken([(1, "A", "A"), (1, "B", "A"), (2, "C", "C"), (2, "D", "C")])[1, "category_size_limit_exceeded"] == 1
