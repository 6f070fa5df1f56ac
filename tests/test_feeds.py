"""Feeds, typed SQL functions and blocked pair scores against brute force and known cases."""

import itertools
import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.functions import typed
from studyloom.operators import pair_scores
from studyloom.session import shared_dir
from studyloom.streaming import changes, progress

CELL = "array<struct<name:string,type:string,value:string>>"
CHANGE = f"change_id long, schema_name string, table_name string, action string, committed timestamp, columns {CELL}, identity {CELL}, pk array<string>, guarded boolean, size long"
SUBSCRIPTION = "subscription_id long, schema_name string, table_name string, action_filter string, claims_role string, claims string, filters array<struct<column_name:string,op:string,value:string>>"
RIGHTS = "schema_name string, table_name string, claims_role string, selectable array<string>"


def change(number, action, columns, identity=(), pk=("id",), guarded=False, size=10):
    from datetime import datetime

    return (number, "public", "notes", action, datetime(2024, 1, 2, 3, 4, 5, 678000), list(columns), list(identity), list(pk) if pk is not None else None, guarded, size)


def sub(number, action="*", role="reader", filters=(), claims="{}"):
    return (number, "public", "notes", action, role, claims, list(filters))


ROW = [("id", "int8", "1"), ("title", "text", 'a "b"'), ("n", "int4", "7")]


def sent(spark, rows, subs, rights=(("public", "notes", "reader", ["id", "title", "n"]),), **more):
    out = changes.fan_out(spark.createDataFrame(rows, CHANGE), spark.createDataFrame(subs, SUBSCRIPTION), spark.createDataFrame(list(rights), RIGHTS), **more)
    return {(r.change_id, r.subscription_id): (json.loads(r.payload), r.errors) for r in out.collect()}


def test_rows_of_a_change(spark):
    got = sent(spark, [change(1, "I", ROW), change(2, "U", ROW[:2], [("id", "int8", "1"), ("n", "int4", "6")]), change(3, "D", [], [("id", "int8", "1"), ("n", "int4", "6")]), change(4, "T", ROW)], [sub(1), sub(2, "UPDATE"), sub(3, "DELETE", role="nobody")])
    assert set(got) == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 3)}
    payload, errors = got[1, 1]
    assert errors == [] and payload["record"] == {"id": 1, "title": 'a "b"', "n": 7} and payload["commit_timestamp"] == "2024-01-02T03:04:05.678Z" and "old_record" not in payload
    assert got[2, 1][0]["record"] == {"id": 1, "title": 'a "b"', "n": 6} and got[2, 1][0]["old_record"] == {"id": 1, "n": 6}
    assert "record" not in got[3, 1][0] and got[3, 1][0]["old_record"] == {"id": 1, "n": 6}
    assert got[3, 3][0]["old_record"] is None  # no right to any column


def test_errors(spark):
    long = [("id", "int8", "1"), ("title", "text", "x" * 70), ("n", "int4", "7")]
    got = sent(spark, [change(1, "I", ROW, pk=None), change(2, "I", ROW, pk=[]), change(3, "I", long, size=101)], [sub(1), sub(2, role="half"), sub(3, filters=[("n", "eq", "8")])], [("public", "notes", "reader", ["id", "title", "n"]), ("public", "notes", "half", ["n"])], max_bytes=100)
    assert all(got[n, s][1] == [changes.NO_KEY] and "record" not in got[n, s][0] for n in (1, 2) for s in (1, 2, 3))
    assert got[3, 2][1] == [changes.NO_RIGHT] and "record" not in got[3, 2][0]
    assert got[3, 1] == ({**got[3, 1][0], "record": {"id": 1, "n": 7}}, [changes.TOO_LARGE])
    assert (3, 3) not in got


@pytest.mark.parametrize(
    ("filters", "seen"),
    [([], 1), ([("n", "eq", "7")], 1), ([("n", "lt", "10")], 1), ([("title", "lt", "b")], 1), ([("n", "gte", "8")], 0), ([("n", "in", "{5,7}")], 1), ([("n", "in", "{5,6}")], 0), ([("n", "eq", "seven")], 0), ([("none", "eq", "1")], 0), ([("none", "eq", "1"), ("n", "neq", "8")], 1), ([("n", "eq", "7"), ("title", "eq", "z")], 0), ([("n", "odd", "7")], 0)],
)
def test_filters(spark, filters, seen):
    assert len(sent(spark, [change(1, "I", ROW)], [sub(1, filters=filters)])) == seen


def test_guarded_rows(spark):
    old = [("id", "int8", "1"), ("n", "int4", "7")]
    mine = "get_json_object(claims, '$.sub') = filter(concat(columns, identity), c -> c.name = 'id')[0].value"
    got = sent(spark, [change(1, "I", ROW, guarded=True), change(2, "D", [], old, guarded=True)], [sub(1, claims='{"sub": "1"}'), sub(2, claims='{"sub": "2"}'), sub(3)], policy=mine)
    assert set(got) == {(1, 1), (2, 1), (2, 2), (2, 3)} and got[2, 2][0]["old_record"] == {"id": 1}
    assert sent(spark, [change(1, "I", ROW)], [], policy=mine) == {} == sent(spark, [], [sub(1)])


def test_polls_lose_and_double_nothing(spark):
    rnd = random.Random(2)
    rows = [(i * rnd.randint(1, 3) + i * 5000, rnd.randint(0, 40)) for i in range(300)]
    rows = list(dict(rows).items())
    feed = spark.createDataFrame(rows, "change_id long, size long").repartition(4)
    for most, budget in ((40, None), (1000, 300), (7, 60), (3, 1)):
        slot, taken, left = changes.Slot(spark, f"{shared_dir(spark)}/slot-{uuid.uuid4().hex}"), [], sorted(rows)
        while len(taken) < (301 if most > 7 else 30):
            got = sorted(map(tuple, changes.polled(feed, slot, most, budget).collect()))
            want = []
            for r in left:
                if len(want) == most or (want and budget is not None and sum(x[1] for x in want) + r[1] > budget):
                    break
                want.append(r)
            assert got == want
            if not got:
                break
            assert sorted(map(tuple, changes.polled(feed, slot, most, budget).collect())) == got  # not confirmed: the same again
            slot.confirm(got[-1][0])
            taken, left = taken + got, left[len(got) :]
        assert taken == sorted(rows)[: len(taken)]
        if most > 7:
            assert not left


def test_sentinel_and_replay(spark):
    feed = spark.createDataFrame([change(1, "I", ROW), change(2, "X", ROW)], CHANGE)
    subs, rights = spark.createDataFrame([sub(1)], SUBSCRIPTION), spark.createDataFrame([("public", "notes", "reader", ["id"])], RIGHTS)
    slot = changes.Slot(spark, f"{shared_dir(spark)}/slot-{uuid.uuid4().hex}")
    polls = [[(r.change_id, r.slot_changes_count) for r in changes.listed(feed, slot, subs, rights, 1).collect()] for _ in range(3)]
    assert polls == [[(1, 1)], [(None, 1)], [(None, 0)]]
    folder = f"{shared_dir(spark)}/deliver-{uuid.uuid4().hex}"
    feed.where("change_id = 1").write.parquet(f"{folder}/in")
    for checkpoint in ("a", "b"):  # b begins anew, as if the first had been lost before it was confirmed
        changes.deliver(spark.readStream.schema(feed.schema).parquet(f"{folder}/in"), subs, rights, f"{folder}/out", f"{folder}/{checkpoint}")
    assert spark.read.parquet(f"{folder}/out").count() == 1


def test_progress_over_batches(spark):
    folder = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    lines = spark.sql("select id % 2 as run_id, if(id % 3 = 0, 'pages', 'chunks') as phase, id as amount, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts from range(60)")
    late = spark.sql("select 9L as run_id, 'pages' as phase, 1L as amount, timestamp '2024-01-01 09:00:00' as ts")
    schema = lines.schema
    for number, part in enumerate((lines.where("amount < 30"), lines.where("amount >= 30"), late, late.withColumn("run_id", F.lit(8).cast("long")).withColumn("ts", F.expr("ts + interval 1 minute")))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        progress.fed(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
        assert number < 4
    out = spark.read.parquet(f"{folder}/out")
    got = {(r.run_id, r.phase): (r.n, r.amount, r.lines) for r in out.where("kind = 'progress' and run_id < 2").groupBy("run_id", "phase").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.max("lines").alias("lines")).collect()}
    want = {(r.run_id, r.phase): (r.n, r.amount, 30) for r in lines.groupBy("run_id", "phase").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).collect()}
    assert got == want
    kinds = {(r.run_id, r.kind) for r in out.collect()}
    assert {(0, "waiting"), (1, "waiting"), (0, "ended"), (1, "ended"), (9, "progress"), (8, "progress")} <= kinds and (9, "ended") not in kinds


def test_session_functions(spark):
    typed.register(spark)
    typed.bind(spark)
    row = spark.sql("select jwt() a, email() b, uid() c, topic() d, allow_only_operation('x') e").first()
    assert tuple(row) == (None, None, None, None, False)
    typed.bind(spark, request_jwt_claims='{"sub": "u1", "role": "r"}', request_jwt_claim_sub="", request_jwt_claim_role="own", realtime_topic="t", storage_operation="object.get")
    row = spark.sql("select uid() a, role() b, topic() c, allow_only_operation('storage.object.get') d, allow_only_operation('storage.') e, allow_any_operation(array(null, '', 'object.get')) f, allow_any_operation(array('object.put')) g").first()
    assert tuple(row) == ("u1", "own", "t", True, False, True, False)
    row = spark.sql("select cast_json('5', 'int8') a, cast_json('x', 'int8') b, cast_json(null, 'text') c, cast_json('a\"b', 'text') d, cast_json('t', 'bool') e, holds('lt', 'int8', '9', '10') f, holds('lt', 'text', '9', '10') g, holds('in', 'int8', '9', '{8,9}') h, holds('eq', 'int8', 'x', '1') i").first()
    assert tuple(row) == ("5", None, "null", '"a\\"b"', "true", True, False, True, None)
    with pytest.raises(ValueError):
        typed.bind(spark, other="1")


@pytest.mark.parametrize("how", [pair_scores.Scoring(3, 2, 0.2, keyword=5), pair_scores.Scoring(2, 0, same_section=True, last_topic=True), pair_scores.Scoring(0, 4, distance=True)])
def test_pairs_equal_all_pairs(spark, how):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in rng.integers(-2, 3, 4)]  # noqa: E731  many equal scores
    said = ["alpha bravo charlie", "bravo delta", "", "short words", "alphabravo"]
    chunks = [(i, [1, 1, 1, 2, None][i % 5], [None, "", "s1", "s2"][i % 4], vector() if i % 11 else None, said[i % 5]) for i in range(90)]
    topics = [(i, [1, 2, 1, 3][i % 4], ["s1", None, "s2"][i % 3], vector(), ["alpha alpha", "bravo", "delta charlie words", "tiny"][i % 4]) for i in range(40)]
    a = spark.createDataFrame(chunks, "id long, project_id long, section string, embedding array<float>, chunk_text string")
    b = spark.createDataFrame(topics, "id long, project_id long, source_section string, embedding array<float>, topic string")
    scored = []
    for c, t in itertools.product(chunks, topics):
        if c[1] != t[1] or c[3] is None or (how.same_section and (c[2] or "") != (t[2] or "")):
            continue
        score = float(np.sqrt(sum((x - y) ** 2 for x, y in zip(c[3], t[3], strict=True)))) if how.distance else sum(x * y for x, y in zip(c[3], t[3], strict=True))
        score += how.section if (c[2] or "") == (t[2] or "") else 0.0
        score += sum(len(w) > 4 and w in c[4] for w in t[4].split(" ")) * how.keyword / 100 if how.keyword else 0
        scored.append((c[0], t[0], score))
    sign = 1 if how.distance else -1
    want = set()
    for c in {x[0] for x in scored}:
        own = sorted((x for x in scored if x[0] == c), key=lambda x: str(x[1]), reverse=how.last_topic)
        want |= {(False, *x, n + 1) for n, x in enumerate(sorted(own, key=lambda x: sign * x[2])[: how.per_chunk])}
    for t in {x[1] for x in scored}:
        want |= {(True, *x, n + 1) for n, x in enumerate(sorted((x for x in scored if x[1] == t), key=lambda x: (sign * x[2], x[0]))[: how.per_topic])}
    for tiles in ((4096, 1024), (7, 5)):
        got = {(r.by_topic, r.chunk_id, r.topic_id, r.score, r.rn) for r in pair_scores.best_pairs(a, b, how, *tiles).collect()}
        assert got == want
    assert pair_scores.best_pairs(a.limit(0), b, how).collect() == []


def test_all_that_is_due_comes_in_one_batch(spark):
    """A run that was silent for long is shown as waiting and ended by the batch whose watermark says so, with few questions to its state."""
    asked = []

    class Held:
        def __init__(self):
            self.value = None

        def get(self):
            asked.append("get")
            return self.value

        def update(self, value):
            asked.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers, self.state = set(), Held()

        def getValueState(self, *_):
            return self.state

        def registerTimer(self, at):
            asked.append("timer")
            self.timers.add(at)

        def deleteTimer(self, at):
            asked.append("timer")
            self.timers.remove(at)

    class Now:
        def __init__(self, at):
            self.at = at

        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: self.at

    from pyspark.sql import Row

    run, handle = progress.Progress(15, 60), Handle()
    run.init(handle)
    lines = [Row(phase=p, amount=a, at=at) for p, a, at in (("x", 2, 1000), (None, 3, 5000), ("x", None, 2000))]
    assert [tuple(r) for r in run.handleInputRows((7,), iter(lines), None)] == [(7, "progress", "x", 2, 2, 3, 5000), (7, "progress", None, 1, 3, 3, 5000)]
    assert handle.timers == {20_000} and len(asked) <= 3
    assert list(run.handleInputRows((7,), iter(lines[:1]), None)) == [(7, "progress", "x", 1, 2, 4, 5000)] and handle.timers == {20_000}
    handle.timers.clear()  # as an expired one goes
    assert [(r.kind, r.at) for r in run.handleExpiredTimer((7,), Now(40_000), Now(20_000))] == [("waiting", 20_000), ("waiting", 35_000)] and handle.timers == {50_000}
    handle.timers.clear()
    assert [(r.kind, r.at) for r in run.handleExpiredTimer((7,), Now(90_000), Now(50_000))] == [("waiting", 50_000), ("ended", 65_000)] and not handle.timers and handle.state.value is None
