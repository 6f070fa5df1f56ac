"""Places in an order, bottom-k samples and JSON ids against brute force."""

import hashlib
import json

from pyspark.sql import functions as F

from studyloom.operators import ranks, samples
from studyloom.sources import writers


def test_places_equal_sorting(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).selectExpr("case when id % 97 = 0 then null else (id * 7919) % 1009 end as a", "id as b").repartition(7)
        got = {r.b: r.rn for r in ranks.ranked(df, "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    rows = sorted(((-1 if i % 97 == 0 else (i * 7919) % 1009), i) for i in range(2000))
    assert got == {b: n + 1 for n, (_, b) in enumerate(rows)}
    assert ranks.ranked(df.limit(0), "a").collect() == []


def test_bottom_k_equals_brute_force(spark):
    df = spark.range(3000).selectExpr("case when id < 2500 then 'hot' when id < 2990 then 'some' when id < 2993 then 'few' else null end as g", "id").repartition(5)
    hashed = df.select("g", "id", F.xxhash64(F.lit(7), "id").alias("h")).collect()
    want = {g: [r.id for r in sorted((r for r in hashed if r.g == g), key=lambda r: (r.h, r.id))[:10]] for g in {r.g for r in hashed}}
    got = {}
    for r in samples.bottom_k(df, ["g"], "id", 10).collect():
        got.setdefault(r.g, []).append(r.id)
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x) for g, x in want.items()}
    again = samples.bottom_k(df.repartition(2), ["g"], "id", 10)
    assert {(r.g, r.id) for r in again.collect()} == {(g, i) for g, x in want.items() for i in x}


def test_ids_of_payloads(spark):
    cases = ['{"a": 1}', '  {"a": 1} ', "{}", '{"id": "x", "a": 1}', "[1, 2]", '"text"', "{broken", None, ""]
    got = [r.p for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "n int, c string").orderBy("n").select(writers.with_id(F.col("c")).alias("p")).collect()]
    sha = lambda c: hashlib.sha256(c.encode()).hexdigest()
    assert [json.loads(p) if p else None for p in got] == [{"id": sha(cases[0]), "a": 1}, {"id": sha(cases[1]), "a": 1}, {"id": sha("{}")}, {"id": "x", "a": 1}, None, None, None, None, None]


def test_replaced_table_is_whole_at_any_time(spark, tmp_path):
    path = str(tmp_path / "table")
    writers.replace(spark.range(5).toDF("id"), path)
    reading = writers.current(spark, path)
    writers.replace(spark.range(7).toDF("id"), path)
    assert reading.count() == 5 and writers.current(spark, path).count() == 7
    writers.replace(writers.current(spark, path).where("id > 1"), path)  # a table made of itself
    assert writers.current(spark, path).count() == 5
    assert writers.vacuum(spark, path) == 2 and writers.current(spark, path).count() == 5
