"""Listing and search against brute force: any sequence of pages makes up the whole listing, in both directions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from studyloom.sources import listing

SCHEMA = "bucket int, name string, id long, created_at timestamp, updated_at timestamp, key string"
START = datetime(2024, 1, 1)


def made():
    rnd = random.Random(9)
    part = lambda: "".join(rnd.choice("aAb-.é") for _ in range(rnd.randint(1, 3)))
    names = {"/".join(part() for _ in range(rnd.choice([1, 1, 2, 3]))) for _ in range(150)}
    names |= {"a", "a/", "a/b", "a-b", "a.b/c", "a0", "é", "é/é", "\U0010ffff", "b/"}
    rows = [(1, n, i, START + timedelta(minutes=(i * 37) % 50), START + timedelta(days=i % 3), "x") for i, n in enumerate(sorted(names))]
    return rows + [(2, "a/other", 900, START, START, "x"), (1, None, 901, START, START, "x")]


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


def entries(prefix, descending=False):
    out = {}
    for bucket, name, i, *_ in made():
        if bucket == 1 and name is not None and name.startswith(prefix):
            rest = name[len(prefix) :]
            token = prefix + rest.partition("/")[0] + "/" if "/" in rest else name
            out[token] = i if token == name and not (token.endswith("/") and len(token) > len(prefix)) else None
    return [(t.rstrip("/") if i is None else t, i) for t, i in sorted(out.items(), key=lambda x: x[0].encode(), reverse=descending)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("prefix", ["", "a", "a/", "é", "none"])
def test_pages_make_up_the_listing(objects, prefix, descending):
    rnd, got, token = random.Random(len(prefix)), [], ""
    want = entries(prefix, descending)
    for _ in range(9):
        page = listing.list_objects(objects, 1, prefix, max_keys=rnd.choice([1, 7, 40]), next_token=token, descending=descending).collect()
        if not page:
            break
        got += [(r.name, r.id) for r in page]
        token = page[-1].token
    assert got == want[: len(got)] and (len(got) == len(want) or page)
    rest = listing.list_objects(objects, 1, prefix, max_keys=1000, next_token=token, descending=descending).collect() if token else []
    assert got + [(r.name, r.id) for r in rest] == want
    assert listing.list_objects(objects, 1, prefix, max_keys=0).collect() == []


def test_names_as_cursors(objects):
    names = [r.name for r in listing.list_objects(objects, 1, start_after="a-b", max_keys=3).collect()]
    want = [n for n, _ in entries("")]
    assert names == want[want.index("a-b") + 1 :][:3]
    behind_folder = [r.name for r in listing.list_objects(objects, 1, start_after="a.b", max_keys=500).collect()]
    assert behind_folder == [n for (n, i), t in zip(entries(""), sorted({(n + "/" if i is None else n) for n, i in entries("")}, key=str.encode), strict=True) if t.encode() > b"a.b/"]


def test_ranges_reach_the_scan(spark, objects, tmp_path):
    objects.write.parquet(str(tmp_path / "objects"))
    page = listing.list_objects(spark.read.parquet(str(tmp_path / "objects")), 1, "a/", next_token="a/b")
    plan = page._sc._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    assert "GreaterThan(name,a/b)" in plan and "LessThan(name,a0)" in plan and "EqualTo(bucket,1)" in plan


def test_search_by_time(objects):
    rows, folders = [], {}
    for bucket, name, i, created, updated, _ in made():
        if bucket == 1 and name is not None:
            if "/" in name:
                top = name.partition("/")[0]
                folders[top] = min(folders.get(top, created), created)
            else:
                rows.append((created, name, i))
    rows = sorted([*rows, *((c, n, None) for n, c in folders.items())], key=lambda x: (x[0], x[1].encode()))
    got, name, at = [], "", None
    for _ in range(30):
        page = listing.search_by_timestamp(objects, 1, limit=23, start_after=name, column_after=at).collect()
        got += [(r.created_at, r.name, r.id) for r in page]
        if len(page) < 23:
            break
        name, at = page[-1].name, str(page[-1].created_at)
    assert sorted(got, key=str) == sorted(rows, key=str) and [x[:2] for x in got] == [x[:2] for x in rows]
    back = listing.search_v2(objects, 1, limit=9, sort_order="DESC", sort_column="created_at").collect()
    assert [(r.created_at, r.name) for r in back] == [x[:2] for x in rows[::-1][:9]]


def test_search_in_any_case(objects):
    held = [(n, i) for b, n, i, *_ in made() if b == 1 and n is not None and n.lower().startswith("a")]
    tokens = {}
    for n, i in held:
        token = n.lower().partition("/")[0] + "/" if "/" in n else n.lower()
        deep = token.endswith("/")
        tokens.setdefault((token, None if deep else i), []).append(n)
    want = sorted(tokens, key=lambda x: (x[0].encode(), x[1] or 0))
    got = listing.search(objects, 1, "A", 1000).collect()
    assert [(r.id, r.name.lower()) for r in got] == [(i, t.rstrip("/")) for t, i in want]
    assert [(r.id, r.name) for r in listing.search(objects, 1, "A", 5, offset=4).collect()] == [(r.id, r.name) for r in got[4:9]]
    times = listing.search(objects, 1, "", 1000, column="created_at").collect()
    kinds = [r.id is None for r in times]
    assert kinds == sorted(kinds, reverse=True) and len({r.name for r in times if r.id is None}) == sum(kinds)
    assert listing.search(objects.limit(0), 1).collect() == [] == listing.search(objects, 1, limit=0).collect()
