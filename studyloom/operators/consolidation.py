"""Consolidation of the categories of each project, as rounds over all projects at once.

Categories are profiled by sums of their topics' unit vectors: for the sum S of n vectors the centroid is S / |S| and the
cohesion |S| / n, so no group of topics has to meet. Each category's two nearest others, and the affinity of two categories
(the mean of each topic's best match on the other side, both ways), come from the blocked product. Two categories that
are among each other's nearest are a candidate edge if their score or an alias rule says so.

The rule then takes the edges from the best score down and merges the groups of both ends if all gates let it. What becomes of
an edge depends on its two groups only; so in each round every edge that is the best undecided one of both its groups is
decided, all over all projects, which gives what the one-by-one order gives. A group holds at most the limit of topics
(40), so what a decision looks at is bounded; edges of categories beyond it are refused before the rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forgotten, stored
from .pair_scores import Scoring, best_pairs
from .taxonomy import MERGE, alias_kind, quality, tokens
from .text_rules import lexical_similarity

SCORED = "merge_score_above_threshold"
_EDGE = ("project_id", "a", "b", "score", "kind")
_AUDIT = "project_id long, a string, b string, score double, kind string, reason string, topics long, cohesion double, spread double, loss double"


def unit_topics(ledger: DataFrame) -> DataFrame:
    """project_id, category, v: unit vectors as doubles; a zero or missing vector is an error."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    held = ledger.select(F.col("project_id").cast("long").alias("project_id"), F.col("category").cast("string").alias("category"), v.alias("v"), norm.alias("norm"))
    return held.select("project_id", "category", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.raise_error(F.lit("zero or missing embedding")).cast("array<double>")).alias("v"))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = [(p, c, len(g), np.sum(np.stack(g.to_numpy()), axis=0)) for (p, c), g in rows.groupby(["project_id", "category"])["v"]]
        yield pd.DataFrame(out, columns=["project_id", "category", "n", "total"])


def sums(topics: DataFrame) -> DataFrame:
    """project_id, category, n, total: how many vectors and their sum."""
    some = topics.mapInPandas(_partial, "project_id long, category string, n long, total array<double>")
    cells = some.select("project_id", "category", "n", F.posexplode("total").alias("at", "x")).groupBy("project_id", "category", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return cells.groupBy("project_id", "category").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c.x).alias("total"))


def profiles(topics: DataFrame) -> DataFrame:
    """project_id, category, n, total (sum of unit vectors), cohesion, centroid."""
    return sums(topics).withColumn("size", F.sqrt(F.aggregate("total", F.lit(0.0), lambda a, x: a + x * x))).select(
        "project_id", "category", "n", "total", (F.col("size") / F.col("n")).alias("cohesion"), F.transform("total", lambda x: x / F.col("size")).alias("centroid")
    )


@F.pandas_udf(T.StructType([T.StructField("lexical", T.DoubleType()), T.StructField("alias", T.StringType())]))
def _names(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series, centroid: pd.Series, affinity: pd.Series) -> pd.DataFrame:
    lexical = [lexical_similarity(" ".join(tokens(x)), " ".join(tokens(y))) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"lexical": lexical, "alias": [alias_kind(*row) for row in zip(a, b, n_a, n_b, lexical, centroid, affinity, strict=True)]})


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def affinities(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """edge, affinity of ``edges`` (edge, project_id, a, b): the mean of each topic's best match on the other side, both ways."""
    none = F.lit(None).cast("string")
    ends = [
        edges.select("edge", "project_id", F.col(side).alias("category")).join(topics, ["project_id", "category"]).select(F.monotonically_increasing_id().alias("id"), F.col("edge").alias("project_id"), none.alias(section), F.col("v").alias("embedding"))
        for side, section in (("a", "section"), ("b", "source_section"))
    ]
    best = best_pairs(*map(stored, ends), Scoring(per_chunk=1, per_topic=1))
    return best.groupBy(F.col("project_id").alias("edge")).agg((0.5 * (F.avg(F.when(F.col("by_topic"), F.col("score"))) + F.avg(F.when(~F.col("by_topic"), F.col("score"))))).alias("affinity"))


def pair_metrics(pairs: DataFrame, topics: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` (project_id, a, b with a < b) with n_a, n_b, centroid, affinity, lexical, alias, cohesion, loss, retention, score."""
    for side in "ab":
        pairs = pairs.join(known.select("project_id", F.col("category").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "total", "cohesion", "centroid"))), ["project_id", side])
    edges = stored(pairs.withColumn("edge", F.monotonically_increasing_id()))
    affinity = affinities(edges, topics)
    both = F.sqrt(F.aggregate(F.zip_with("total_a", "total_b", lambda x, y: x + y), F.lit(0.0), lambda s, x: s + x * x))
    n = F.col("n_a") + F.col("n_b")
    met = edges.join(affinity, "edge").withColumns({"centroid": _dot("centroid_a", "centroid_b"), "cohesion": both / n})
    apart = (F.col("cohesion_a") * F.col("n_a") + F.col("cohesion_b") * F.col("n_b")) / n
    met = met.withColumn("loss", F.greatest(F.lit(0.0), apart - F.col("cohesion"))).withColumn("names", _names("a", "b", "n_a", "n_b", "centroid", "affinity"))
    met = met.withColumns({"retention": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("loss") / MERGE["loss"])), "lexical": F.col("names.lexical"), "alias": F.col("names.alias")})
    score = 0.45 * F.col("centroid") + 0.30 * F.col("affinity") + 0.15 * F.col("lexical") + 0.10 * F.col("retention")
    return met.select("project_id", "a", "b", "n_a", "n_b", "centroid", "affinity", "lexical", "alias", "cohesion", "loss", "retention", score.alias("score"))


def nearest(known: DataFrame, k: int = MERGE["neighbours"]) -> DataFrame:
    """project_id, a, b: pairs of categories that are among each other's ``k`` nearest by centroid, of equals the first by name."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("category"))
    named = stored(known.select("project_id", "category", "centroid", (F.lit(10**9) + place).alias("id")))
    side = named.select("id", "project_id", F.lit(None).cast("string").alias("section"), F.col("centroid").alias("embedding"))
    near = best_pairs(side, side.withColumnRenamed("section", "source_section"), Scoring(per_chunk=k, others=True))
    pairs = near.groupBy("project_id", F.least("chunk_id", "topic_id").alias("low"), F.greatest("chunk_id", "topic_id").alias("high")).agg(F.count("*").alias("ways")).where("ways = 2")
    name = lambda at, as_: named.select("project_id", F.col("id").alias(at), F.col("category").alias(as_))
    return pairs.join(name("low", "a"), ["project_id", "low"]).join(name("high", "b"), ["project_id", "high"]).select("project_id", "a", "b")


def _affinity(x: np.ndarray, y: np.ndarray) -> float:
    s = x @ y.T
    return float(0.5 * (s.max(axis=1).mean() + s.max(axis=0).mean()))


def decide(a: list[dict], b: list[dict], kind: str, most: int) -> dict:
    """What becomes of the union of two groups (lists of categories with their vectors)."""
    group = sorted([*a, *b], key=lambda m: m["name"])
    vectors = [np.asarray(m["vectors"], float) for m in group]
    n = sum(map(len, vectors))
    out = {"reason": None, "topics": n, "cohesion": None, "spread": None, "loss": None}
    if n > most:
        return out | {"reason": "category_size_limit"}
    totals = [v.sum(axis=0) for v in vectors]
    sizes = [float(np.linalg.norm(t)) for t in totals]
    for i, x in enumerate(group):
        for j in range(i + 1, len(group)):
            y = group[j]
            centroid, affinity = float(totals[i] @ totals[j]) / (sizes[i] * sizes[j]), _affinity(vectors[i], vectors[j])
            if centroid >= MERGE["centroid"] and affinity >= MERGE["affinity"]:
                continue
            lexical = lexical_similarity(" ".join(tokens(x["name"])), " ".join(tokens(y["name"])))
            if not alias_kind(x["name"], y["name"], len(vectors[i]), len(vectors[j]), lexical, centroid, affinity):
                return out | {"reason": "complete_group_pair_incompatible"}
    every = np.concatenate(vectors)
    out["cohesion"] = float(np.linalg.norm(every.sum(axis=0))) / n
    out["loss"] = max(0.0, sum(sizes) / n - out["cohesion"])  # a category's cohesion times its topics is the length of its sum
    out["spread"] = 1 - float((every @ every.T)[np.triu_indices(n, 1)].min())
    if out["cohesion"] < MERGE["cohesion"]:
        return out | {"reason": "merged_cohesion_below_minimum"}
    if out["loss"] > (MERGE["loss"] if kind == SCORED else MERGE["alias_loss"]):
        return out | {"reason": "cohesion_loss_above_maximum"}
    if out["spread"] > MERGE["spread"]:
        return out | {"reason": "semantic_spread_above_maximum"}
    return out


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = [field.split(" ")[0] for field in _AUDIT.split(", ")]
    for batch in batches:
        rows = [{**{c: r[c] for c in _EDGE}, **decide(r["members_a"], r["members_b"], r["kind"], r["most"]), "owner_a": r["owner_a"], "owner_b": r["owner_b"]} for r in batch.to_pylist()]
        types = dict.fromkeys(("score", "cohesion", "spread", "loss"), pa.float64()) | dict.fromkeys(("project_id", "topics"), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in (*kept, "owner_a", "owner_b")], [*kept, "owner_a", "owner_b"])


def merged(edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (project_id, owner, members) after all ``edges`` (project_id, a, b, score, kind, most), and what became of each edge."""
    edges = stored(edges.withColumns({"owner_a": F.col("a"), "owner_b": F.col("b")}))
    groups, audit = stored(groups), []
    order = F.struct((-F.col("score")).alias("s"), F.col("a"), F.col("b"))
    while not edges.isEmpty():
        ends = edges.select("project_id", F.explode(F.array("owner_a", "owner_b")).alias("owner"), order.alias("first"))
        best = ends.groupBy("project_id", "owner").agg(F.min("first").alias("first"))
        of = lambda side, table, value: table.select("project_id", F.col("owner").alias(f"owner_{side}"), F.col(value).alias(f"{value}_{side}"))
        now = edges.join(of("a", best, "first"), ["project_id", "owner_a"]).join(of("b", best, "first"), ["project_id", "owner_b"])
        now = now.where((F.col("first_a") == order) & (F.col("first_b") == order)).drop("first_a", "first_b")
        now = now.join(of("a", groups, "members"), ["project_id", "owner_a"]).join(of("b", groups, "members"), ["project_id", "owner_b"])
        done = stored(now.mapInArrow(_decided, _AUDIT + ", owner_a string, owner_b string"))
        audit.append(done)
        taken = done.where("reason is null").select("project_id", "owner_a", "owner_b", F.least("owner_a", "owner_b").alias("into"))
        moves = taken.select("project_id", F.explode(F.array("owner_a", "owner_b")).alias("owner"), "into")
        after = groups.join(moves, ["project_id", "owner"], "left").withColumn("owner", F.coalesce("into", "owner"))
        after = stored(after.groupBy("project_id", "owner").agg(F.flatten(F.collect_list("members")).alias("members")))  # two groups at most
        left = edges.join(done.select("project_id", "a", "b"), ["project_id", "a", "b"], "left_anti")
        for side in "ab":
            left = left.join(moves.select("project_id", F.col("owner").alias(f"owner_{side}"), F.col("into").alias(f"into_{side}")), ["project_id", f"owner_{side}"], "left")
            left = left.withColumn(f"owner_{side}", F.coalesce(f"into_{side}", f"owner_{side}")).drop(f"into_{side}")
        left = stored(left.where("owner_a <> owner_b"))
        forgotten(edges, groups)
        edges, groups = left, after
    out = groups.sparkSession.createDataFrame([], _AUDIT)
    for done in audit:
        out = out.unionByName(done.drop("owner_a", "owner_b"))
    return groups, out


def canonical(members: list[dict]) -> str:
    """The name of a group: by quality, then how central its category is, its topics, the alphabet."""
    if len(members) == 1:
        return members[0]["name"]
    totals = [np.asarray(m["vectors"], float).sum(axis=0) for m in members]
    centroids = np.stack([t / np.linalg.norm(t) for t in totals])
    central = (centroids @ centroids.T - np.eye(len(members))).sum(axis=1) / (len(members) - 1)
    return min((quality(m["name"]), -float(central[i]), -len(m["vectors"]), m["name"]) for i, m in enumerate(members))[3]


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["project_id"], m["name"], target) for r in batch.to_pylist() for target in [canonical(r["members"])] for m in r["members"]]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["project_id", "category", "target"])


def consolidate(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``ledger`` (project_id, category, embedding): project_id, category, target; and the audit of all pairs of mutual
    nearest categories: project_id, a, b, score, kind, reason (null: merged), and what the merged group would be."""
    topics = stored(unit_topics(ledger))
    known = stored(profiles(topics))
    limits = known.groupBy("project_id").agg(F.least(F.greatest(F.max("n"), F.ceil(F.sum("n") * MERGE["fraction"])), F.lit(MERGE["most"])).cast("long").alias("most"))
    met = pair_metrics(nearest(known), topics, known).withColumn("kind", F.coalesce("alias", F.when(F.col("score") >= MERGE["score"], SCORED)))
    met = stored(met.join(limits, "project_id").withColumn("fits", F.col("n_a") + F.col("n_b") <= F.col("most")))
    refused = met.where("kind is null or not fits").select(*_EDGE, F.when(F.col("kind").isNull(), "merge_score_below_threshold").otherwise("category_size_limit").alias("reason"), (F.col("n_a") + F.col("n_b")).alias("topics"))
    edges = met.where("kind is not null and fits").select(*_EDGE, "most")
    ends = edges.select("project_id", F.explode(F.array("a", "b")).alias("category")).distinct()
    groups = topics.join(ends, ["project_id", "category"]).groupBy("project_id", "category").agg(F.collect_list("v").alias("vectors"))  # of 40 topics at most
    groups = groups.select("project_id", F.col("category").alias("owner"), F.array(F.struct(F.col("category").alias("name"), "vectors")).alias("members"))
    groups, audit = merged(edges, groups)
    named = groups.mapInArrow(_targets, "project_id long, category string, target string")
    mapping = known.select("project_id", "category").join(named, ["project_id", "category"], "left").withColumn("target", F.coalesce("target", "category"))
    return mapping, audit.unionByName(refused, allowMissingColumns=True)


def validated(ledger: DataFrame, mapping: DataFrame) -> DataFrame:
    """project_id, rule, violations of ``mapping`` (project_id, category, target) over ``ledger`` (project_id, id, category): one row for
    each of the eight rules and project; all are zero for a mapping that may be used."""
    own = ledger.groupBy("project_id", "category").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("id")).alias("twice"))
    mapped = mapping.groupBy("project_id", "category").agg(F.count("*").alias("copies"), F.max("target").alias("target"))
    both = own.join(mapped, ["project_id", "category"], "full")
    blank = F.col("n").isNotNull() & (F.coalesce(F.trim("target"), F.lit("")) == "")
    per = both.groupBy("project_id").agg(
        F.count_if(F.col("copies").isNull() | F.col("n").isNull()).alias("mapping_does_not_cover_every_category"),
        F.coalesce(F.sum("twice"), F.lit(0)).alias("duplicate_topic_ids"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("topic_without_final_category"),
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("n"))), F.lit(0)).alias("topic_assigned_more_than_once"),
        F.greatest(F.countDistinct(F.when(F.col("n").isNotNull() & ~blank, F.col("target"))) - F.countDistinct(F.when(F.col("n").isNotNull(), F.col("category"))), F.lit(0)).alias("category_count_increased"),
    )
    total = own.groupBy("project_id").agg(F.least(F.greatest(F.max("n"), F.ceil(F.sum("n") * MERGE["fraction"])), F.lit(MERGE["most"])).alias("most"))
    final = both.where(F.col("target").isNotNull()).groupBy("project_id", "target").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("category") == F.col("target")).alias("own_name"))
    ends = final.join(total, "project_id", "left").groupBy("project_id").agg(
        F.count_if(F.col("n") == 0).alias("empty_category"), F.count_if(F.col("n") > F.col("most")).alias("category_size_limit_exceeded"), F.count_if(F.col("own_name") == 0).alias("name_is_none_of_its_categories")
    )
    rows = per.join(ends, "project_id", "left")
    rules = [c for c in rows.columns if c != "project_id"]
    return rows.select("project_id", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(r, F.lit(0)).cast("long").alias("violations")) for r in rules))).alias("x")).select("project_id", "x.rule", "x.violations")
