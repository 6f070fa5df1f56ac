"""Steps that must not be done anew for every pair, component or reading."""

import time

from studyloom.catalog import catalog
from studyloom.operators import all_pairs
from test_odd_tables import made, same


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_norms_are_not_made_for_each_component(spark, tmp_path):
    folder = made(tmp_path, ["some text"], 30, copies=2)
    same(spark, folder, "vec_cohesion_spread")
    assert "zip_with" not in plan(catalog()["vec_cohesion_spread"].run(spark, folder))


def test_words_are_looked_for_once_a_text(spark, tmp_path, monkeypatch):
    """A word that a text holds often, of many topics; and words that LIKE reads in several ways."""
    monkeypatch.setattr(all_pairs, "TILE", 7)
    heads = ["ab", "a_b", "a%b", "%", "_", "a%%", "b_%a", "__", "%_%", "a\\b", "a\\_b", "", "éa_", "b.", "[a]"]
    texts = [f"{heads[i % len(heads)]} ab ba axb a\\b a\\zb éaß\n b. [a] " * (20 if i % 3 else 1) + "x" * (i % 5) for i in range(60)] + [f"{'quite other words ' * 20}{w}" for w in heads]
    same(spark, made(tmp_path, texts, 75), "flt_keyword_like")
    import pyarrow as pa

    chunks = pa.table({"id": range(2000), "project_id": [1] * 2000, "words": ["a" * 1000] * 2000})
    topics = pa.table({"id": range(500), "project_id": [1] * 500, "word": ["a"] * 500})
    begun = time.time()
    assert all_pairs._like(chunks, topics).num_rows == 1_000_000
    assert time.time() - begun < 10  # 2,000,000 places, 500 topics each


def test_filters_meet_a_change_once_for_all_their_subscriptions(spark):
    from studyloom.streaming import changes

    cell = "named_struct('name', '{}', 'type', 'int8', 'value', cast({} as string))".format
    rows = spark.range(2000).selectExpr("id as change_id", "'public' as schema_name", "'notes' as table_name", "'I' as action", "timestamp '2024-01-01 00:00:00' as committed", f"array({cell('id', 'id')}, {cell('n', 'id % 1000')}) as columns", "cast(null as array<struct<name:string,type:string,value:string>>) as identity", "array('id') as pk", "true as guarded", "id % 2 as owner", "10L as size")
    subs = spark.range(4000).selectExpr("id as subscription_id", "'public' as schema_name", "'notes' as table_name", "'*' as action_filter", "'reader' as claims_role", "cast(id as string) as claims", "array(named_struct('column_name', 'n', 'op', 'eq', 'value', cast((id + 1) % 2 + 7 as string))) as filters")
    rights = spark.createDataFrame([("public", "notes", "reader", ["id", "n"])], "schema_name string, table_name string, claims_role string, selectable array<string>")
    begun = time.time()
    out = changes.fan_out(rows, subs, rights, "owner = cast(claims as bigint) % 4").select("change_id", "subscription_id").collect()
    assert time.time() - begun < 30  # 8,000,000 pairs, of which filters let 8,000 through
    assert {(r.change_id, r.subscription_id) for r in out} == {(c, s) for c in (7, 8, 1007, 1008) for s in range(4000) if (s + 1) % 2 + 7 == c % 1000 and c % 2 == s % 4} and len(out) == 4000


def test_pairs_of_lists_are_made_a_piece_at_a_time(spark, monkeypatch):
    from studyloom import lists

    monkeypatch.setattr(lists, "INNER", 7)
    monkeypatch.setattr(lists, "OUTER", 3)
    held = [(i, [None, *range(n)] if i % 2 else list(range(n)), list(range(m))) for i, (n, m) in enumerate(((0, 5), (5, 0), (1, 1), (20, 8), (7, 3), (22, 40)))]
    made = lists.pairs(spark.createDataFrame(held, "k long, a array<long>, b array<long>"), "a", "b", "x", "y")
    want = sorted((repr((k, x, y)) for k, a, b in held for x in a for y in b))
    assert made.columns == ["k", "x", "y"] and sorted(repr(tuple(r)) for r in made.collect()) == want
    order = [line.strip(" +-:*0123456789()").split(" ")[0] for line in made._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert order.index("Sort") < [i for i, x in enumerate(order) if x == "Generate"][2]  # rows of a piece only are held at once


def test_refused_changes_stay_lists_until_they_are_rows(spark):
    """Few lists stand for all pairs of changes and subscriptions, nulls and repeated ids too; their rows are dealt out."""
    from studyloom.streaming import changes

    cell = "array<struct<name:string,type:string,value:string>>"
    rows = spark.range(3000).selectExpr("nullif(id, 5) as change_id", "'public' as schema_name", "'notes' as table_name", "if(id % 2 = 0, 'I', 'U') as action", "timestamp '2024-01-01 00:00:00' as committed", f"cast(null as {cell}) as columns", f"cast(null as {cell}) as identity", "cast(array() as array<string>) as pk", "false as guarded", "10L as size")
    subs = spark.range(600).selectExpr("nullif(id div 2, 7) as subscription_id", "'public' as schema_name", "'notes' as table_name", "case id % 3 when 0 then '*' when 1 then 'INSERT' else 'DELETE' end as action_filter", "if(id < 300, 'reader', null) as claims_role", "'{}' as claims", "cast(null as array<struct<column_name:string,op:string,value:string>>) as filters")
    rights = spark.createDataFrame([("public", "notes", "reader", ["id"])], "schema_name string, table_name string, claims_role string, selectable array<string>")
    found = changes.packed(rows, subs, rights).cache()
    assert found.count() <= 20
    out = changes.spread(found)
    assert out.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    got = out.groupBy("subscription_id", "claims_role").count().collect()
    want = {}
    for i in range(600):
        key = (None if i // 2 == 7 else i // 2, "reader" if i < 300 else None)
        want[key] = want.get(key, 0) + (3000, 1500, 0)[i % 3]
    assert {(r[0], r[1]): r[2] for r in got} == {k: n for k, n in want.items() if n}
    assert out.where("change_id is null").count() == 200 and {r[0] for r in out.select("payload").distinct().collect()} == {f'{{"schema": "public", "table": "notes", "type": "{x}"}}' for x in ("INSERT", "UPDATE")}


def test_texts_are_taken_few_at_a_time():
    import pyarrow as pa

    from studyloom.operators import text_rules

    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [f"text {i}" if i % 9 else None for i in range(1000)]})
    parts = list(text_rules._slices([rows]))
    assert max(len(texts) for _, texts in parts) <= text_rules.ROWS
    assert [(i, t) for ids, texts in parts for i, t in zip(ids.to_pylist(), texts)] == [(i, f"text {i}" if i % 9 else None) for i in range(1000)]


def test_folds_and_chunks_are_those_of_each_row(spark, tmp_path):
    from studyloom.operators import text_rules

    texts = [None, "", "ÀÉ ’x’  y", *("\n".join(f"line {j} " * (i + j) for j in range(i)) for i in range(30))] * 20
    folder = made(tmp_path, texts)
    assert {r.doc_id: r.folded for r in catalog()["str_role_fold"].run(spark, folder).collect()} == dict(enumerate(map(text_rules.fold, texts)))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(text_rules.paragraph_chunks(t))]
    assert sorted(map(tuple, text_rules.chunked(docs).collect())) == want


def test_whole_texts_are_not_moved_for_the_names_of_topics(spark, tmp_path):
    from studyloom.operators import assignment

    lines = plan(assignment._view("vtopics", spark, made(tmp_path, ["Some text"] * 5, 5))).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("substring(text" in line for line in lines[join:])


LINKS = ("snk_bulk_links", "stm_dedup_chunks", "jon_global_scope")


def test_links_are_dealt_out_and_written_in_few_bytes(spark, tmp_path):
    """Pairs of few ids go to all cores, and lists that repeat take next to nothing in files."""
    folder = made(tmp_path, ["words of a text " * 700] * 700, 700, labels=1)
    for key in LINKS:
        df = catalog()[key].run(spark, folder)
        df.write.parquet(out := f"{tmp_path}/{key}")
        rows, parts = spark.read.parquet(out), list(tmp_path.glob(f"{key}/part-*"))
        assert rows.count() == 700 * 14 * 140 and len(parts) >= 4
        assert sum(p.stat().st_size for p in parts) < rows.count()  # of two ids each


def test_links_of_ids_with_several_keys_and_with_none(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, value in (("BLOCK", 3), ("CUTS", 2), ("TILE", 2), ("TASK_PAIRS", 50)):
        monkeypatch.setattr(all_pairs, name, value)
    folder = made(tmp_path, [f"text {i} " * (20 + 90 * (i % 3)) for i in range(60)], 30)
    held = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    held += [x | {"label": label} for x in held[:12] for label in (0, 1, 1, 7)] + [x | {"label": None} for x in held[20:24]]
    for x in held[13:16]:
        x["label"] = None
    pq.write_table(pa.Table.from_pylist(held, pq.read_schema(f"{folder}/embeddings.parquet")), f"{folder}/embeddings.parquet")
    same(spark, folder, *LINKS)


def test_words_of_a_text_are_made_once_and_pairs_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(all_pairs, "TILE", 8)
    texts = [" ".join(f"wordnumber{(i * j) % 37}" for j in range(9 + i % 20)) + (" İSTANBULΣ" if i % 7 == 0 else "") for i in range(120)]
    folder = made(tmp_path, texts)
    same(spark, folder, "str_word_overlap")
    df = catalog()["str_word_overlap"].run(spark, folder)
    assert "split(" not in plan(df)  # once, before the sides are read
    assert df.rdd.getNumPartitions() >= 30  # 120 pairs of tiles


def test_pairs_of_rows_take_few_bytes(spark, tmp_path):
    """Ids are runs and lists that repeat, chunks of one text have one distance; words move as numbers."""
    folder = made(tmp_path, [f"{'quite a number of words in texts ' * 150}and word{i}" for i in range(700)], 700, labels=40)
    for key, most in (("jon_chunk_topic_pairs", 4), ("vec_final_score", 4), ("str_keyword_overlap", 0.5), ("set_token_jaccard", 0.8), ("vec_l2", 9.2)):
        catalog()[key].run(spark, folder).write.parquet(out := f"{tmp_path}/{key}")
        rows = spark.read.parquet(out).count()
        assert rows == (700 * 699 // 2 if key in ("set_token_jaccard", "vec_l2") else 700 * 7 * 140)
        assert sum(p.stat().st_size for p in tmp_path.glob(f"{key}/part-*")) < most * rows + 400_000, key
    words = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "b"]), (2, ["c"]), (3, ["z"])], "id long, w array<string>")
    found = all_pairs._numbered(words)
    assert dict(found.dtypes)["w"] == "array<int>" and sorted(map(tuple, found.collect())) == [(1, [1, 2]), (2, [2, 3]), (2, [3]), (3, [4])]


def test_ids_that_several_rows_have_make_no_pair(spark, tmp_path, monkeypatch):
    """Rows of one id in two tiles, vectors of several lengths and with nulls next to equal ones."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(all_pairs, "TILE", 3)
    monkeypatch.setattr(all_pairs, "RUN", 2)
    held = [(i // 4, [1.0, float(i // 8)] if i % 5 else [[], None, [1.0], [None, 2.0]][i % 4]) for i in range(60)]
    folder = made(tmp_path, ["some text"] * 3, 3)
    pq.write_table(pa.table({"vec_id": pa.array([i for i, _ in held], pa.int64()), "embedding": pa.array([v for _, v in held], pa.list_(pa.float32())), "label": pa.array([1] * 60, pa.int32())}), f"{folder}/embeddings.parquet")
    for key, of in (("vec_neg_inner_product", lambda x, y: -sum(p * q for p, q in zip(x, y))), ("vec_l2", lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5)):
        got = sorted((r.a, r.b, r.distance) for r in catalog()[key].run(spark, folder).collect() if r.distance is not None)
        want = sorted((i, j, of(x, y)) for i, x in held for j, y in held if i < j and x is not None and y is not None and len(x) == len(y) and None not in x + y)
        assert len(got) == len(want) and all(p[:2] == q[:2] and abs(p[2] - q[2]) < 1e-9 for p, q in zip(got, want))
