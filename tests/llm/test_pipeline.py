"""The corpus pipeline, stage by stage, against brute force on a small table with nulls, empty texts, repeated rows and extra
columns with clashing names."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studyloom.llm import minhash_dedup

tokenizers = pytest.importorskip("tokenizers")
vocab = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_hash int, keep string, ident long, sketch string"
SECRET = "AKIA" + "ABCDEFGHIJKLMNOP"


def made():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    rows = [(i, text(rnd.randint(60, 150)) + "\n" + text(70)) for i in range(30)]
    rows += [(30 + i, rows[i][1]) for i in range(3)]  # copies
    for i in range(3):  # near copies
        w = rows[3 + i][1].split(" ")
        w[40] = "edited"
        rows.append((40 + i, " ".join(w)))
    rows += [(50 + i, text(60) + " " + passage + " " + text(60)) for i in range(4)]
    rows += [(60, f"{text(80)} {SECRET} {text(5)}"), (61, f"{text(70)}\npassword = hunter2hunter2 {text(9)}")]
    rows += [(70, None), (71, ""), (72, "too short"), (73, "a b c " * 60), (None, text(90)), (5, rows[5][1])]
    return [(i, t, "en", rnd.choice(["a", "b", None]), len(t or ""), 1, "k", 2, "s") for i, t in rows]


def good(text) -> bool:
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def without_repeats(rows):
    first = {}
    for d, t in rows:
        w = WORD.findall(t)
        for i in range(len(w) - 49 if d is not None else 0):
            first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), d), d)
    out = Counter()
    for d, t in rows:
        w = WORD.findall(t)
        gone = set()
        for i in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        out[d, " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "substring dedup", "secret scans", "packing"]
    kept = {}
    held = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        held = spark.read.parquet(str(tmp_path / str(number)))
        kept[name] = [(r.doc_id, r.text) for r in held.collect()] if name != "packing" else held.collect()

    # quality: no line is frequent here, so the base rule decides
    assert Counter(kept["quality rules"]) == Counter((r[0], r[1]) for r in made() if good(r[1]))
    # near duplicates: one row of each group of a weighted similarity of 0.8
    rows = [r for r in kept["quality rules"] if r[0] is not None]
    df = spark.createDataFrame(kept["quality rules"], "doc_id long, text string")
    idf = minhash_dedup.inverse(minhash_dedup.word_frequencies(minhash_dedup.documents_only(df)))
    every = np.arange(len(rows))
    close = minhash_dedup.similarities(minhash_dedup.Shingled([t.encode() for _, t in rows], idf), every, every) >= 0.8
    label = every.copy()
    for _ in rows:
        label = np.where(close, label[None, :], len(rows)).min(axis=1)
    want = {min(rows[j][0] for j in np.flatnonzero(label == k)) for k in set(label.tolist())}
    ids = [d for d, _ in kept["near duplicates"]]
    assert sorted(d for d in ids if d is not None) == sorted(want) and ids.count(None) == 1
    assert {30, 31, 32, 40, 41, 42}.isdisjoint(ids)
    # substrings: words of what is left
    left = Counter((d, " ".join(WORD.findall(t or ""))) for d, t in kept["substring dedup"])
    assert left == without_repeats(kept["near duplicates"])
    # secrets: gone, and nothing else is changed
    before, after = dict(kept["substring dedup"]), dict(kept["secret scans"])
    assert set(before) == set(after) and SECRET in before[60] and "hunter2hunter2" in before[61]
    assert SECRET not in after[60] and "hunter2hunter2" not in after[61]
    assert all(before[d] == after[d] for d in before if d not in (60, 61))
    # packing: every id of every text in one piece, sequences gapless from 0
    tokenizer = tokenizers.Tokenizer.from_file(vocab.path(corpus_pipeline.VOCABULARY))
    sizes = Counter(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in after.values())
    pieces = kept["packing"]
    of_doc = {}
    for p in pieces:
        of_doc.setdefault(p.doc_id, []).append((p.start, p.length))
    assert Counter(max(s + n for s, n in x) for x in of_doc.values()) == sizes
    assert all(sum(n for _, n in x) == max(s + n for s, n in x) for x in of_doc.values())
    fill = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill[p.sequence_id]
        fill[p.sequence_id] += p.length
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in fill.values())
    # the run as a whole
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((p.doc_id, p.start + p.length == p.doc_tokens) for p in again if p.start + p.length == p.doc_tokens) == Counter((p.doc_id, True) for p in pieces if p.start + p.length == p.doc_tokens)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    none = spark.createDataFrame([(1, None, "en", "a", 0, 1, "k", 2, "s"), (2, "", "en", None, 0, 1, "k", 2, "s")], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).where(F.col("text") != "").count() == 0, name
