"""Queries against their SQL, on small tables made for a case that the given tables do not have."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from parity import compare, duck
from studyloom.catalog import catalog


def made(folder, texts, vectors=0, labels=3, width=8, copies=1, seed=1):
    """documents of ``texts`` and ``vectors`` embeddings, of which ``copies`` each are equal; tables as the given ones."""
    rng = np.random.default_rng(seed)
    n = len(texts)
    some = pa.array([None if t is None else len(t) for t in texts], pa.int32())
    pq.write_table(pa.table({"doc_id": np.arange(n), "text": pa.array(texts), "lang": ["en"] * n, "source": [f"src{i % 3}" for i in range(n)], "n_chars": some}), f"{folder}/documents.parquet")
    drawn = np.repeat(rng.normal(size=(-(-vectors // copies) if vectors else 0, width)), copies, axis=0)[:vectors].astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(vectors), pa.int64()), "embedding": pa.array(list(map(list, drawn)), pa.list_(pa.float32())), "label": pa.array(rng.integers(0, labels, vectors), pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


def same(spark, folder, *keys):
    for key in keys:
        assert compare(spark, duck(folder), folder, catalog()[key]) == "", key


def test_letters_of_several_capitals(spark, tmp_path):
    texts = ["UPPER LIMB straße\nx", "shoulder ﬁbres of ΐ and ŉ", "ABCDEF GHß ᾳ", "the HİP and the arm", "plain hand", None, ""]
    same(spark, made(tmp_path, texts, 2), "str_section_title")


def test_copies_of_vectors_and_ids(spark, tmp_path):
    """Several documents a vector: classes of equal chunks, and equal topics."""
    texts = [f"alpha{i % 4} bravo{i % 3} charlie delta " * 20 for i in range(60)]
    same(spark, made(tmp_path, texts, 12, copies=2), "win_top3_topics_per_chunk", "win_best_topic_per_chunk", "win_best_chunk_per_orphan", "srt_vector_topk_per_topic", "dom_assign_phase_a_low", "dom_learning_scope")


def test_a_side_is_not_copied_for_every_thousand_rows_of_the_other(spark):
    from studyloom.operators import pair_scores

    seen = spark.sparkContext.accumulator(0)
    tile = pair_scores._tile
    pair_scores._tile = lambda how: lambda chunks, topics: (seen.add(chunks.num_rows), tile(how)(chunks, topics))[1]
    try:
        a = spark.range(50).selectExpr("id", "1L as project_id", "'s' as section", "array(cast(id as float), 1f) as embedding", "'' as chunk_text")
        b = spark.range(5000).selectExpr("id", "1L as project_id", "'s' as source_section", "array(cast(id as float), 1f) as embedding", "'' as topic")
        assert pair_scores.best_pairs(a, b, pair_scores.Scoring(per_chunk=1)).count() == 50
    finally:
        pair_scores._tile = tile
    assert seen.value == 50


def test_pairs_of_rows_and_keys(spark, tmp_path, monkeypatch):
    from studyloom.operators import all_pairs

    monkeypatch.setattr(all_pairs, "TILE", 5)
    texts = [f"alpha{i % 4} bravo{i % 3} charlie delta{i % 7} echoes foxtrot{i % 5} golfs hotel " * (20 if i % 6 else 1) for i in range(40)]
    texts += [None, "", "% alpha bravos " * 20, "_x golfs " * 30, " lead " * 40, "a\\b bravo " * 20]
    folder = made(tmp_path, texts, 46, copies=2)
    same(spark, folder, *(key for key in all_pairs.RUNS if key not in ("flt_exists_flag", "jon_orphan_chunk_pairs")))
    assert compare(spark, duck(folder), folder, catalog()["jon_orphan_chunk_pairs"]) in ("", "empty")
