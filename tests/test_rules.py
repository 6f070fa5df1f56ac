"""Rules with known cases: text, taxonomy, packing, repetition, sinks."""

import numpy as np
import pytest

from studyloom.operators import packing, taxonomy, text_rules
from studyloom.plans import dialect
from studyloom.sources import writers
from studyloom.streaming import repetition


def test_alias_cases():
    assert taxonomy.alias_kind("DNA SEQUENCING TECHNIQUES", "GENETIC SEQUENCING TECHNOLOGIES", 2, 2, 0.42, 0.74, 0.66) == "balanced_lexical_semantic_alias"
    assert taxonomy.alias_kind("CONTRACTS", "CONTRACTS AND PROPERTY", 9, 5, 0.71, 0.90, 0.73) is None


def test_tokens_lose_one_ending():
    assert taxonomy.tokens("Tipologie di Obbligazioni") == ["tipologi", "di", "obbliga"]
    assert taxonomy.core("Tipi di contratto") == {"contratto"}


def test_paragraphs():
    assert text_rules.paragraph_chunks("a" * 1000) == ["a" * 1000]
    assert text_rules.paragraph_chunks("x" * 99) == []
    long = "b" * 1500
    assert text_rules.paragraph_chunks(long) == [long[:1000], long[800:]]
    two = "a" * 600 + "\n\n" + "b" * 600
    assert text_rules.paragraph_chunks(two) == ["a" * 600, "a" * 200 + "\n\n" + "b" * 600]
    assert text_rules.paragraph_chunks(None) == []


def test_ratio_of_empty_names():
    assert text_rules.lexical_similarity("", "") == pytest.approx(0.4)


def test_schedule_never_skips():
    assert packing.schedule([("a", 30), ("b", 30), ("a", 10)], 3, 45) == [[0], [1], [2]]
    assert packing.schedule([("a", 50)], 3, 45) == []
    assert packing.schedule([("a", 20), ("b", 20)], 1, 45) == [[0, 1]]
    assert packing.schedule([("a", 20), ("a", 20), ("b", 5)], 2, 45) == [[0, 1], [2]]


def test_compose_shrinks_and_drops():
    acts = [("a", 2, 10, 2.0), ("b", 5, 10, 2.0), ("c", 40, 40, 2.0)]
    assert packing.compose(acts, None, 30.0) == [[(0, 10), (1, 5)]]
    assert packing.compose(acts, 0, 30.0) == []


@pytest.mark.parametrize(("days", "correct", "difficulty", "want"), [(10, False, 3, 1), (10, True, 1, 5), (1, True, 1, 1), (10, True, 2, 11), (10, True, 3, 20), (10, True, 9, 13)])
def test_next_interval(spark, days, correct, difficulty, want):
    from pyspark.sql import functions as F

    assert repetition.next_interval(days, correct, difficulty) == want
    assert spark.range(1).select(repetition.step(F.lit(days), F.lit(correct), F.lit(difficulty))).first()[0] == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "2024-01-01", True, 3), (2, 1, "2024-01-02", True, 3), (3, 1, "2024-01-03", True, 2), (4, 2, "2024-01-01", False, 1)]
    df = spark.createDataFrame(rows, "id long, flashcard_id long, reviewed_at string, is_correct boolean, difficulty long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = repetition.stream_intervals(stream).writeStream.outputMode("update").format("memory").queryName("srs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.flashcard_id: (r.interval_days, r.n_reviews) for r in spark.table("srs").collect()}
    want = {r.flashcard_id: (r.interval_days, r.n_reviews) for r in repetition.intervals(df.withColumn("reviewed_at", df.reviewed_at.cast("timestamp"))).collect()}
    assert got == want == {1: (5, 3), 2: (1, 1)}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append(spark.range(5), path)
    writers.append(spark.range(5, 8), path)
    assert spark.read.parquet(path).count() == 8
    writers.replace(writers.delete_keys(spark.read.parquet(path), spark.range(3), ["id"]), path)
    assert sorted(r.id for r in writers.current(spark, path).collect()) == [3, 4, 5, 6, 7]
    scoped = str(tmp_path / "s")
    writers.append(spark.range(6).selectExpr("id", "id % 2 as p"), scoped, "p")
    writers.replace_scope(spark.range(100, 101).selectExpr("id", "1L as p"), scoped, "p")
    assert sorted(r.id for r in spark.read.parquet(scoped).collect()) == [0, 2, 4, 100]


def test_cascade_reaches_grandchildren(spark):
    t = {"p": spark.range(3), "c": spark.range(6).selectExpr("id", "id % 3 as p_id"), "g": spark.range(12).selectExpr("id", "id % 6 as c_id")}
    left = writers.delete_cascade(t, "p", spark.range(1), [("c", "p_id", "p"), ("g", "c_id", "c")])
    assert (left["p"].count(), left["c"].count(), left["g"].count()) == (2, 4, 8)


def test_macros_nest():
    assert dialect.render("@SIZE(@SPLIT(a, ','))", True) == "cast(len(string_split(a, ',')) as bigint)"
    assert dialect.render("@RX(a, '(x)', '$1')", True) == "regexp_replace(a, '(x)', '\\1', 'g')"


def test_question_openings(spark):
    from studyloom.catalog import catalog
    from studyloom.plans.scalar import OPENINGS

    got = {r.q: r.rewritten for r in catalog()["str_rewrite_opening"].run(spark, "/root/testdata/sf0.001").collect()}
    assert len(OPENINGS) == 23 and spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("text is not null").select("text").distinct().count() <= len(got)
    assert got["What is the role of x, What is the role of y"] == "During a system response, x, What is the role of y"
    assert got["What is x, What is y"] == "In this situation, x, What is y" and got["Which amino acid x, Which amino acid y"].startswith("In this context, x")
    assert got["Why What is it"] == "Why What is it" and got["what is a cell"] == "what is a cell"


def test_reference_queries_use_whole_tables(spark, tmp_path):
    from studyloom.catalog import catalog

    words = [f"word{i:04d}" for i in range(300)]
    docs = [(i, " ".join(words) + f" tail{i:04d}") for i in range(45)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(45)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda key, sf=str(tmp_path): catalog()[key].run(spark, sf)
    for key, col in (("str_normalize", "clean"), ("str_topic_key", "k"), ("str_clean_text", "clean"), ("str_role_normalize", "clean")):
        assert all("tail" in r[col] for r in run(key).collect()), key
    assert run("jon_lateral_unnest").count() == 45 * 301
    assert {round(r.overlap, 6) for r in run("str_word_overlap").collect()} == {round(300 / 301, 6)}
    assert all(run(key).count() == 45 * 44 // 2 for key in ("str_word_overlap", "vec_l2", "vec_neg_inner_product"))
    small = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert run("srt_question_order", small).count() == lines and run("set_union_all", small).where("kind = 'quiz'").count() == lines


def test_long_intervals_have_no_end_and_no_date(spark):
    rows = [(n, card, f"2024-01-{1 + n % 28:02d} 00:00:{n:02d}", True, 3) for card, times in ((1, 12), (2, 40), (3, 59)) for n in range(times)]
    df = spark.createDataFrame(rows, "id long, flashcard_id long, reviewed_at string, is_correct boolean, difficulty long").selectExpr("id", "flashcard_id", "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, id) as reviewed_at", "is_correct", "difficulty")
    got = {r.flashcard_id: (r.interval_days, r.next_review) for r in repetition.intervals(df).collect()}
    assert got[1][0] == 2**12 and got[1][1] is not None
    assert got[2] == (2**40, None) and got[3] == (2**59, None)
