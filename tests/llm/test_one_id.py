"""Near duplicates of ids that have several texts."""

import random

import pytest

from studyloom.llm import minhash_dedup


def text(seed: int, n: int = 120) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(n)]


def edited(words: list[str]) -> str:
    return " ".join([*words[:60], "edited", *words[61:]])


A, B, OTHER = text(1), text(2), text(3)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(6, A, 0), (6, B, 0), (3, A, 1), (21, B, 1), (30, OTHER, 0)], {3: 3, 6: 3, 21: 3, 30: 30}),
        ([(6, A, 0), (6, B, 0), (2, A, 0), (21, B, 1), (30, OTHER, 0)], {2: 2, 6: 2, 21: 2, 30: 30}),
        ([(6, A, 0), (6, B, 0), (6, B, 0), (30, OTHER, 0)], {6: 6, 30: 30}),
        ([(6, A, 0), (6, B, 0), (5, B, 0), (4, A, 0)], {4: 4, 5: 4, 6: 4}),
    ],
)
def test_texts_of_one_id_are_one_group(spark, rows, want):
    df = spark.createDataFrame([(i, edited(w) if e else " ".join(w)) for i, w, e in rows], "doc_id long, text string")
    got = minhash_dedup.groups(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.group_id) for r in got} == set(want.items())
    kept = minhash_dedup.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
