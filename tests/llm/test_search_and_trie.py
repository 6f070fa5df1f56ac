"""Benchmark decontamination, ranked search and the prefix trie against brute force and against their SQL, on small tables
with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parity import compare, duck  # noqa: E402
from studyloom.catalog import Item  # noqa: E402
from studyloom.llm import common, decontamination, prefix_trie, queries, ranked_search, terms  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, items string, row_hash int, ranges long, n_words int, term string, rank int"
ITEMS = "item_id long, text string, doc_id long, words string, prefix int"


def words_of(text):
    return TERM.findall((text or "").translate(LOWER))


def made(seed: int = 5):
    """Documents that hold items whole, in part, twice, overlapping, in other case; items short, repeated, empty, null."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcDEéß9") for _ in range(rnd.randint(1, 4)))
    text = lambda n: rnd.choice([" ", "\n", ", "]).join(word() for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(14)]
    items += [(14, items[3][1]), (14, text(12)), (3, items[5][1]), (20, None), (21, ""), (22, "!?"), (None, text(12)), (23, "a b a b a b a b a b a b")]
    docs = []
    for i in range(60):
        t = text(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(items)[1] or ""
            t += " " + rnd.choice([own, own.upper() if own.isascii() else own, " ".join(own.split()[2:]), own + " " + own]) + "; " + text(rnd.randint(0, 8))
        docs.append((i, t))
    docs += [(60, None), (61, ""), (62, "\n \t"), (63, text(30000)), (None, items[7][1]), (5, docs[5][1]), (5, docs[5][1]), (6, items[8][1]), (64, "a b " * 40), (65, "x" * 100)]
    return [(i, t, "en", "x", 1, 2, 3, "y", 4) for i, t in docs], [(i, t, 1, "w", 2) for i, t in items]


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = made()
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2)


def windows_in(docs, items, width=10):
    held = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        k = min(width, len(w))
        for at in range(len(w) - k + 1 if k else 0):
            held[tuple(w[at : at + k])].add(i)
    out = Counter()
    for d, t in docs:
        w, found = words_of(t), set()
        hit = [False] * len(w)
        for k in {len(x) for x in held}:
            for at in range(len(w) - k + 1):
                if (own := held.get(tuple(w[at : at + k]))) is not None:
                    found |= own
                    hit[at : at + k] = [True] * k
        names = sorted(str(i) for i in found if i is not None)
        out[d, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)] += 1
    return out


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_terms_are_those_of_the_pattern():
    import numpy as np
    import pyarrow as pa

    texts = ["Ab-c9\x00É ß", None, "", "x", "y", "\x7f[`{", "Zé" * 40]
    held = terms.Terms(*terms.utf8(pa.array(["skipped", *texts]).slice(1)))
    known = {}
    for i, t in enumerate(texts):
        for h, w in zip(held.hash[held.first[i] : held.first[i + 1]].tolist(), words_of(t), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 5
    long = np.frombuffer(b"q" * 5000, np.uint8)
    old, terms.SLICE_BYTES = terms.SLICE_BYTES, 512
    try:
        cut = terms.Terms(long, np.array([0, 5000]))
    finally:
        terms.SLICE_BYTES = old
    assert cut.hash.tolist() == terms.Terms(long, np.array([0, 5000])).hash.tolist()


def test_decontamination_equals_brute_force(tables):
    docs, items = tables
    want = windows_in(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    got = decontamination.contamination_digest(docs, items)
    assert Counter(map(tuple, got.collect())) == want and sum(n for k, n in want.items() if k[5]) > 20
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}


@pytest.mark.parametrize(("width", "gram", "block"), [(10, 3, 7), (4, 2, 40), (3, 5, 1000), (1, 1, 11)])
def test_decontamination_in_blocks_and_other_sizes(tables, width, gram, block):
    docs, items = tables
    found = decontamination.contaminated(docs, items, width, gram, block=block)
    hit = F.aggregate("ranges", F.lit(0), lambda a, r: a + r.end - r.start)
    got = Counter((r.doc_id, r.n_words, r.hit, tuple(sorted(map(str, r["items"])))) for r in found.select("*", hit.alias("hit")).collect())
    want = Counter()
    for (d, n, h, _, sha, _), times in windows_in(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), width).items():
        want[d, n, h, sha] += times
    assert Counter({}) == want - Counter(dict(((d, n, h, hashlib.sha256(",".join(i).encode()).hexdigest()), k) for (d, n, h, i), k in got.items()))


def test_decontamination_by_share(spark):
    base = [f"w{i}" for i in range(12)]
    near = [*base[:5], "other", *base[6:]]
    docs = spark.createDataFrame([(1, "x y " + " ".join(base) + " z"), (2, " ".join(near)), (3, " ".join(reversed(base)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(base))], "item_id long, text string")
    for share in (1.0, 0.7, 0.5, 0.2):
        want = {}
        for d, w in ((1, ["x", "y", *base, "z"]), (2, near), (3, base[::-1])):
            hit = set()
            for i in range(3):
                own = {tuple(base[i + k : i + k + 3]) for k in range(8)}
                for s in range(len(w) - 9):
                    if len(own & {tuple(w[s + k : s + k + 3]) for k in range(8)}) >= math.ceil(share * 8):
                        hit |= set(range(s, s + 10))
            want[d] = len(hit)
        got = {r.doc_id: sum(x.end - x.start for x in r.ranges) for r in decontamination.contaminated(docs, items, share=share).collect()}
        assert got == want, share
    assert {r.doc_id for r in decontamination.keep_clean(docs, items).collect()} == {2, 3}


def test_decontamination_of_empty_tables(spark, tables):
    docs, items = tables
    none = decontamination.contamination_digest(docs, items.limit(0))
    assert none.count() == docs.count() and none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert decontamination.contamination_digest(docs.limit(0), items).collect() == []
    kept = decontamination.keep_clean(docs, items)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def ranks(docs, items, limit=50, multiplicity=False):
    held = [(d, Counter(words_of(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for i, text in items:
        asked, scored = Counter(words_of(text)), []
        for d, c in held:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // total
            score = sum((k if multiplicity else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:limit]):
            out[i, rank + 1, d, -score] += 1
    return out


@pytest.mark.parametrize(("limit", "multiplicity", "block"), [(50, False, 1 << 18), (3, True, 20), (1000, False, 100)])
def test_search_equals_brute_force(tables, limit, multiplicity, block):
    docs, items = tables
    got = ranked_search.search(docs, items, limit, multiplicity, block)
    assert Counter(map(tuple, got.collect())) == ranks(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), limit, multiplicity)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_over_slices_and_empty_tables(spark, tables, monkeypatch):
    docs, items = tables
    assert ranked_search.search(docs.limit(0), items).collect() == [] == ranked_search.search(docs, items.limit(0)).collect()
    assert ranked_search.search(docs.where("doc_id in (60, 61, 62)"), items).collect() == []
    many = spark.range(5000).selectExpr("id as doc_id", "concat('Same words ', id % 7) as text")
    one = spark.createDataFrame([(1, "words 3 same"), (2, "nothing here")], "item_id long, text string")
    assert Counter(map(tuple, ranked_search.search(many, one).collect())) == ranks(pairs(many, "doc_id", "text"), pairs(one, "item_id", "text"))


TALKS = "conv_id long, turn long, role string, text string, own int, at string, depth long, key string, part int"


def talks(seed: int = 4):
    """Conversations of groups of 20 with shared heads, copies, one long one, ties, nulls and repeated turns."""
    rnd = random.Random(seed)
    say = lambda: " ".join(rnd.choice(["a", "bb", "c", "", "d\te"]) for _ in range(rnd.randint(0, 4)))
    out = []
    for c in [*range(0, 70), 85, 99, 100, 4000, 4100, 8000]:
        if c % 7 == 3 and out:
            first = out[0][0]
            out += [(c, *t[1:]) for t in out if t[0] == first]
            continue
        out += [(c, t if t or c % 3 else None, rnd.choice(["user", "assistant", None]), rnd.choice([say(), None]) if t else "hello there") for t in range(rnd.randint(1, 6))]
    out += [(60, t, "user", f"long {t % 5}") for t in range(10, 700)]
    out += [(61, t, "user", f"long {t % 5}") for t in range(10, 400)]
    out += [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (None, 0, "user", "no conversation"), (3, None, None, None)]
    rnd.shuffle(out)
    return [(*x, 1, "a", 2, "k", 3) for x in out]


def nodes_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    again = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members, below = defaultdict(list), defaultdict(list)
    for c in sorted(again):
        for k in range(len(again[c]) + 1):
            members[tuple(again[c][:k])].append(c)
    for n in members:
        if n:
            below[n[:-1]].append(n)
    out, leaves, saved = Counter(), {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in below[n]) or 1
        saved[n] = sum(saved[k] for k in below[n]) + (len(members[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0)
        ends = ",".join(str(c) for c in members[n] if len(again[c]) == len(n))
        out[members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(below[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def test_trie_equals_brute_force(spark):
    df = spark.createDataFrame(talks(), TALKS).repartition(5)
    got = prefix_trie.trie(df)
    assert Counter(map(tuple, got.collect())) == nodes_of(pairs(df, "conv_id", "turn", "role", "text"))
    assert set(t for _, t in got.dtypes[:-1]) == {"bigint"} and got.columns[-1] == "ends_sha256"
    assert prefix_trie.trie(df.limit(0)).collect() == []


def test_trie_of_one_huge_node_and_deep_chains(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    deep = [(1000 + 20 * k, t, "user", "x y") for k in range(12) for t in range(40 - 3 * k)]
    df = spark.createDataFrame([(*x, 1, "a", 2, "k", 3) for x in same + deep], TALKS)
    assert Counter(map(tuple, prefix_trie.trie(df).collect())) == nodes_of(pairs(df, "conv_id", "turn", "role", "text"))


def test_running_over_split_keys(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).selectExpr("case when id < 2500 then 7 else id % 5 end as k", "id as o", "id * 31 as v", "id * 17 as w").repartition(6)
        out = prefix_trie.running(rows, "k", [F.col("o")], {"v": 1, "w": common.BASES[0]}, "at").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    sums = defaultdict(lambda: [0, 0, 0])
    for o in range(3000):
        k = 7 if o < 2500 else o % 5
        at, v, w = sums[k]
        sums[k] = [at + 1, v + o * 31, (w * common.BASES[0] + o * 17) % 2**64]
        r = next(x for x in out if x.o == o) if o % 97 == 0 or o > 2990 else None
        if r is not None:
            assert (r.at, r.v, r.w % 2**64) == (at, sums[k][1], sums[k][2])
    assert len(out) == 3000


@pytest.mark.parametrize("most", [1, 10**9])
def test_spread_join_on_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(common, "HEAVY_ROWS", most)
    left = spark.range(1000).selectExpr("case when id < 400 then 0 else id % 90 end as k", "id as v").union(spark.sql("select cast(null as bigint), 5L"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = sorted(map(tuple, common.spread_join(left, right, "k", 1001).collect()))
    assert got == sorted(map(tuple, left.join(right.drop("n"), "k").collect())) and len(got) == 1000


@pytest.mark.parametrize("key", ["op11_decontamination", "op12_ranked_search", "op13_prefix_trie"])
def test_sql_gives_the_same(spark, key):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), sf, Item(queries.queries()[key], queries.oracle_sql()[key])) == ""
