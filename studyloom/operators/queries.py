"""Registered queries of the operators that are DataFrame programs rather than one SELECT. Each has, where SQL can state it,
the SQL for the independent engine (in the common dialect, over the same adapter views)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import dialect, relational
from ..plans.adapters import VIEWS
from ..sources import writers
from ..streaming import repetition
from ..session import stored
from . import consolidation, packing, pair_scores, taxonomy, text_rules, week

Run = Callable[[SparkSession, str], DataFrame]


def view(name: str, more: str = "") -> Run:
    return dialect.runner(f"select * from {name} {more}", VIEWS)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view("topics")(spark, sf_dir).selectExpr("concat(category, ' ', topic) as name").distinct()
    cases = spark.createDataFrame([("DNA SEQUENCING TECHNIQUES",), ("GENETIC SEQUENCING TECHNOLOGIES",), ("Tipi di contratto",)], "name string")
    return names.unionByName(cases)


def str_lexical_similarity(spark, sf_dir):
    a = _names(spark, sf_dir)
    pairs = a.select(F.col("name").alias("a")).join(a.select(F.col("name").alias("b")), F.col("a") < F.col("b"))
    return pairs.withColumn("similarity", text_rules.lexical_similarity_udf(F.lower("a"), F.lower("b")))


def str_prefix_token_match(spark, sf_dir):
    a = _names(spark, sf_dir)

    @F.pandas_udf("long")
    def matches(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([text_rules.prefix_matches(taxonomy.core(p), taxonomy.core(q)) for p, q in zip(x, y, strict=True)])

    return a.select(F.col("name").alias("a")).join(a.select(F.col("name").alias("b")), F.col("a") < F.col("b")).withColumn("matches", matches("a", "b"))


def str_role_fold(spark, sf_dir):
    return text_rules.folded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dom_chunk_paragraph(spark, sf_dir):
    # the texts have line feeds but no blank lines: every second one stands for a paragraph's end
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace("text", "\n([^\n]*\n)?", "\n\n$1").alias("text"))
    return text_rules.chunked(docs)


def _named_ledger(spark, sf_dir) -> DataFrame:
    """Topics under names of several words, in four projects."""
    text = "select e.vec_id % 4 as project_id, upper(concat('field ', e.label, ' ', split_part(p.p_type, ' ', 2))) as category, e.vec_id as id, e.embedding from embeddings e join part p on p.p_partkey = e.vec_id"
    return dialect.runner(text, {})(spark, sf_dir)


def dom_consolidate(spark, sf_dir):
    return consolidation.consolidate(_named_ledger(spark, sf_dir))[0]


def dom_consolidation_audit(spark, sf_dir):
    return consolidation.consolidate(_named_ledger(spark, sf_dir))[1]


def dom_canonical_name(spark, sf_dir):
    """Each category with the name its group goes by and the group's categories."""
    mapping = dom_consolidate(spark, sf_dir)
    groups = mapping.groupBy("project_id", "target").agg(F.count("*").alias("members"))
    return mapping.join(groups, ["project_id", "target"]).select("project_id", "target", "category", "members")


def dom_validate_consolidation(spark, sf_dir):
    ledger = _named_ledger(spark, sf_dir)
    mapping = stored(consolidation.consolidate(ledger)[0])
    return consolidation.validated(ledger.select("project_id", "id", "category"), mapping)


def _raw(spark, sf_dir) -> DataFrame:
    return view("ledger")(spark, sf_dir).select(F.lit(0).cast("long").alias("project_id"), "category", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def jon_reciprocal_knn(spark, sf_dir):
    # the mean of all inner products of two categories is the inner product of their means
    known = stored(consolidation.sums(_raw(spark, sf_dir)).select("project_id", "category", F.transform("total", lambda x: x / F.col("n")).alias("centroid")))
    pairs = consolidation.nearest(known)
    for side in "ab":
        pairs = pairs.join(known.select(F.col("category").alias(side), F.col("centroid").alias(f"m_{side}")), side)
    return pairs.select("a", "b", F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("sim"))


def vec_affinity(spark, sf_dir):
    topics = stored(_raw(spark, sf_dir))
    names = topics.select("project_id", "category").distinct()
    pairs = names.select("project_id", F.col("category").alias("a")).join(names.select("project_id", F.col("category").alias("b")), "project_id").where("a < b")  # the feature is all pairs of categories
    edges = stored(pairs.withColumn("edge", F.monotonically_increasing_id()))
    return edges.join(consolidation.affinities(edges, topics), "edge").select(F.col("a").alias("ca"), F.col("b").alias("cb"), "affinity")


def _profiled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    topics = stored(consolidation.unit_topics(view("ledger")(spark, sf_dir).withColumn("project_id", F.lit(0))))
    return topics, stored(consolidation.profiles(topics))


def dom_category_profiles(spark, sf_dir):
    topics, known = _profiled(spark, sf_dir)
    # the two least alike: of each topic the farthest one of its category, by the blocked product
    ids = stored(topics.select(F.monotonically_increasing_id().alias("id"), "category", "v"))
    place = F.abs(F.xxhash64("category"))
    side = ids.select("id", place.alias("project_id"), F.lit(None).cast("string").alias("section"), F.col("v").alias("embedding"))
    far = side.select("id", "project_id", F.col("section").alias("source_section"), F.transform("embedding", lambda x: -x).alias("embedding"))
    least = pair_scores.best_pairs(side, far, pair_scores.Scoring(per_chunk=1, others=True)).groupBy("project_id").agg(F.max("score").alias("most"))
    out = known.withColumn("project_id", place).join(least, "project_id", "left")
    return out.select("category", F.col("n").alias("topics"), F.bround("cohesion", 9).alias("cohesion"), F.bround(F.coalesce(1 + F.col("most"), F.lit(0.0)), 9).alias("spread"), F.bround(F.col("centroid")[0], 9).alias("first"), F.bround(F.col("centroid")[63], 9).alias("last"))


def dom_pair_metrics(spark, sf_dir):
    topics, known = _profiled(spark, sf_dir)
    names = known.select("project_id", "category")
    pairs = names.select("project_id", F.col("category").alias("a")).join(names.select("project_id", F.col("category").alias("b")), "project_id").where("a < b")  # the feature is all pairs of categories
    found = consolidation.pair_metrics(pairs, topics, known)
    rounded = [F.bround(c, 9).alias(c) for c in ("centroid", "affinity", "lexical", "cohesion", "loss", "retention", "score")]
    return found.select("a", "b", F.col("n_a").alias("topics_a"), F.col("n_b").alias("topics_b"), *rounded)


def dom_alias_rule(spark, sf_dir):
    """Which rule, if any, makes one of two categories that are among each other's nearest."""
    topics = stored(consolidation.unit_topics(_named_ledger(spark, sf_dir)))
    known = stored(consolidation.profiles(topics))
    return consolidation.pair_metrics(consolidation.nearest(known), topics, known).select("project_id", "a", "b", "n_a", "n_b", "alias")


def _segments(spark, sf_dir) -> DataFrame:
    topics = view("topics")(spark, sf_dir)
    return topics.groupBy("project_id", "category").agg((F.count("*") % 7 * 3 + 5).cast("double").alias("minutes")).withColumn("ord", F.expr("row_number() over (partition by project_id order by category)").cast("long"))


def pln_week_schedule(spark, sf_dir):
    return packing.schedule_projects(_segments(spark, sf_dir), 5, 45.0)


def pln_compose_modules(spark, sf_dir):
    acts = _segments(spark, sf_dir).selectExpr("project_id", "ord", "category", "cast(minutes as int) % 5 + 1 as topics", "cast(10 as int) as size", "2.0D as minutes")
    return packing.compose_projects(acts, None, 45.0)


def _week_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans of all projects, the analytics of their categories and their topics, from what users answered and reviewed."""
    evidence = dialect.runner(relational.PLANS["agg_category_analytics"], VIEWS)(spark, sf_dir)
    topics = view("topics")(spark, sf_dir).where("is_display_topic").select("project_id", "category", "id", F.when(F.col("project_id") % 2 == 0, F.col("id") * 7 % 1000).alias("ord"), F.col("id").alias("seen"))
    names = topics.select("project_id", "category").distinct()
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("category"))
    weight = F.when(F.xxhash64("project_id", "category") % 4 == 0, 1.2)
    analytics = names.join(evidence, "category", "left").withColumns({"ord": place, "weight": weight})
    plans = view("projects")(spark, sf_dir).select(
        F.col("id").alias("project_id"), F.concat(F.lit("week-"), "id").alias("week_id"), F.lit("2024-02-05").cast("date").alias("week_start"),
        (20 + F.col("id") % 4 * 15).alias("budget_minutes"), (60 + F.col("id") % 3 * 30).alias("pace_seconds"), (F.col("id") % 6).alias("sessions"),
    )
    return plans, analytics, topics


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("topics", F.array_join("topics", ","))


def pln_generate_week(spark, sf_dir):
    return _shown(week.generate_week(*_week_inputs(spark, sf_dir)))


def pln_assessment_week(spark, sf_dir):
    return _shown(week.assessment_week(*_week_inputs(spark, sf_dir)))


def stm_spaced_repetition(spark, sf_dir):
    return repetition.intervals(view("reviews")(spark, sf_dir))


def stm_windowed_activity(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return repetition.windowed_activity(events).select(F.col("window.start").alias("begins"), "event_type", "n", "total")


# ---- sinks: the table each leaves behind


def snk_delete_project(spark, sf_dir):
    tables = {"projects": view("projects")(spark, sf_dir), "topics": view("topics")(spark, sf_dir).select("id", "project_id")}
    left = writers.delete_cascade(tables, "projects", spark.range(3, 8).toDF("id"), [("topics", "project_id", "projects")])
    return left["topics"]


def snk_delete_document(spark, sf_dir):
    chunks = view("chunks")(spark, sf_dir).select("id", "project_id", "doc_title")
    return writers.delete_keys(chunks, spark.createDataFrame([(3, "doc 3.pdf"), (5, "doc 5.pdf")], "project_id long, doc_title string"), ["project_id", "doc_title"])


def snk_update_coalesce(spark, sf_dir):
    table = view("topics")(spark, sf_dir).select("id", "topic", "description")
    changes = table.where("id % 10 = 0").select("id", F.lit("changed").alias("description"), F.lit(None).cast("string").alias("topic"))
    return writers.update_coalesce(table, changes, "id")


def snk_insert_if_absent(spark, sf_dir):
    table = view("projects")(spark, sf_dir).where("id < 12").select("id", "name")
    return writers.insert_if_absent(table, view("projects")(spark, sf_dir).where("id >= 8").select("id", F.upper("name").alias("name")), ["id"])


def snk_update_role_backfill(spark, sf_dir):
    chunks = view("chunks")(spark, sf_dir).selectExpr("id", "case when id % 2 = 0 then 'teaching' end as role", "'teaching' as computed")
    return writers.changed_roles(chunks, "role", "computed")


def snk_insert_returning(spark, sf_dir):
    return writers.with_keys(view("topics")(spark, sf_dir).select("project_id", "topic").distinct(), "project_id", "topic")


def snk_upsert_document(spark, sf_dir):
    chunks = view("chunks")(spark, sf_dir)
    pages = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_text"))).alias("p"))
    return pages.select("doc_id", F.array_join(F.transform("p", lambda x: x.chunk_text), "\n\n").alias("text"))


def snk_status_update(spark, sf_dir):
    return view("projects")(spark, sf_dir).select("id", F.when(F.col("topic_status") == "processing", "completed").otherwise(F.col("topic_status")).alias("topic_status"))


def snk_plan_tree(spark, sf_dir):
    topics = view("topics")(spark, sf_dir)
    acts = topics.groupBy("project_id", "category").agg(F.array_sort(F.collect_list("topic")).alias("activities"))
    days = F.transform(F.array_sort(F.collect_list(F.struct("category", "activities"))), lambda x: F.struct(x.category.alias("objective"), x.activities.alias("activities")))
    plans = acts.groupBy(F.col("project_id").alias("plan_id")).agg(days.alias("days"))
    back = writers.plan_tree(*writers.plan_rows(plans))
    return back.select("plan_id", F.explode("days").alias("day")).select("plan_id", "day.objective", F.array_join("day.activities", ",").alias("activities"))


def snk_replace_scope(spark, sf_dir):
    topics = view("topics")(spark, sf_dir).select("id", "project_id", "topic")
    fresh = topics.where("project_id in (1, 2)").withColumn("topic", F.upper("topic"))
    return topics.join(fresh.select("project_id").distinct(), "project_id", "left_anti").select("id", "project_id", "topic").unionByName(fresh)


def snk_append_chunks(spark, sf_dir):
    chunks = view("vchunks")(spark, sf_dir)
    written = chunks.select("id", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]")).alias("text"))
    return written.select("id", F.size(F.from_json("text", "array<float>")).cast("long").alias("width"))


def snk_bulk_links(spark, sf_dir):
    return dialect.runner("select t.id as topic_id, c.id as chunk_id from vtopics t join vchunks c on c.project_id = t.project_id and c.section = t.source_section", VIEWS)(spark, sf_dir).dropDuplicates(["topic_id", "chunk_id"])


def snk_broadcast(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("payload"))
    return events.select("event_id", writers.with_id(F.col("payload")).alias("payload"))


def src_llm_shape_variants(spark, sf_dir):
    """Answers in five shapes, made of the turns of all conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.concat_ws(" ", F.lit("Why"), "role", "conv_id", "turn").alias("q"))
    shapes = ('[{"stem": "%s?"}, {"question": "other %s"}]', '{"questions": [{"question": "%s"}]}', '{"question": "%s"}', '{"question": {"stem": "%s"}}', "no JSON, %s")
    number = (F.col("conv_id") + F.col("turn")) % len(shapes)
    body = F.coalesce(*(F.when(number == i, F.replace(F.lit(shape), F.lit("%s"), F.col("q"))) for i, shape in enumerate(shapes)))
    rows = turns.select("conv_id", "turn", body.alias("body"))
    item = "array<struct<stem:string,question:string>>"
    many = F.coalesce(F.when(F.col("body").startswith("["), F.from_json("body", item)), F.from_json(F.get_json_object("body", "$.questions"), item))
    nested = F.get_json_object("body", "$.question")
    one = F.array(F.struct(F.get_json_object(nested, "$.stem").alias("stem"), F.coalesce(F.get_json_object(nested, "$.question"), F.when(~nested.startswith("{"), nested)).alias("question")))
    found = rows.select("conv_id", "turn", F.explode(F.coalesce(many, F.when(nested.isNotNull(), one))).alias("q"))
    return found.select("conv_id", "turn", F.coalesce("q.question", "q.stem").alias("question"))


def srt_random(spark, sf_dir):
    return view("topics")(spark, sf_dir).select("id", "topic").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(30)


_PROFILES = """with units as (select id, category, list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as v from ledger),
cells as (select category, i, sum(v[i]) as x from (select category, v, unnest(range(1, 65)) as i from units) c group by category, i),
sums as (select category, list(x order by i) as s from cells group by category), sizes as (select category, count(*) as n from units group by category),
known as (select category, n, s, sqrt(list_inner_product(s, s)) as size from sums join sizes using (category)) """

#: function -> SQL in the common dialect, or None where SQL cannot state it
QUERIES: dict[Callable, str | None] = {
    str_lexical_similarity: None,
    str_prefix_token_match: None,
    str_role_fold: None,
    dom_chunk_paragraph: None,
    dom_consolidate: None,
    dom_canonical_name: None,
    dom_validate_consolidation: "select p.project_id, r.rule, cast(0 as bigint) as violations from (select distinct vec_id % 4 as project_id from embeddings e join part on p_partkey = vec_id) p cross join (select unnest(['mapping_does_not_cover_every_category', 'duplicate_topic_ids', 'topic_without_final_category', 'topic_assigned_more_than_once', 'category_count_increased', 'empty_category', 'category_size_limit_exceeded', 'name_is_none_of_its_categories']) as rule) r",
    jon_reciprocal_knn: "with s as (select l.category as a, r.category as b, avg(@DOT(l.embedding, r.embedding)) as sim from ledger l join ledger r on l.category <> r.category group by l.category, r.category), k as (select a, b, sim from (select *, row_number() over (partition by a order by sim desc, b) as rn from s) x where rn <= 2) select x.a, x.b, x.sim from k x join k y on y.a = x.b and y.b = x.a where x.a < x.b",
    vec_affinity: "with p as (select a.category as ca, b.category as cb, a.id as ia, b.id as ib, @DOT(a.embedding, b.embedding) as s from ledger a join ledger b on a.category < b.category) select x.ca, x.cb, (x.m + y.m) / 2 as affinity from (select ca, cb, avg(m) as m from (select ca, cb, ia, max(s) as m from p group by ca, cb, ia) u group by ca, cb) x join (select ca, cb, avg(m) as m from (select ca, cb, ib, max(s) as m from p group by ca, cb, ib) v group by ca, cb) y on x.ca = y.ca and x.cb = y.cb",
    dom_consolidation_audit: None,
    dom_category_profiles: _PROFILES
    + "select category, n as topics, round_even(size / n, 9) as cohesion, round_even(coalesce(1 - least_alike, 0), 9) as spread, round_even(s[1] / size, 9) as first, round_even(s[64] / size, 9) as last from known left join (select a.category, min(list_inner_product(a.v, b.v)) as least_alike from units a join units b on a.category = b.category and a.id < b.id group by a.category) using (category)",
    # names are one letter and one digit, so two of them have half their characters in common and no token
    dom_pair_metrics: _PROFILES
    + ", cross_ as (select a.category as a, b.category as b, a.id as x, b.id as y, list_inner_product(a.v, b.v) as s from units a join units b on a.category < b.category), there as (select a, b, avg(m) as f from (select a, b, x, max(s) as m from cross_ group by a, b, x) group by a, b), back as (select a, b, avg(m) as f from (select a, b, y, max(s) as m from cross_ group by a, b, y) group by a, b), met as (select p.category as a, q.category as b, p.n as topics_a, q.n as topics_b, list_inner_product(p.s, q.s) / (p.size * q.size) as centroid, (there.f + back.f) / 2 as affinity, 0.2::double as lexical, sqrt(p.size * p.size + q.size * q.size + 2 * list_inner_product(p.s, q.s)) / (p.n + q.n) as cohesion, (p.size + q.size) / (p.n + q.n) as apart from known p join known q on p.category < q.category join there on there.a = p.category and there.b = q.category join back on back.a = p.category and back.b = q.category), lost as (select *, greatest(0, apart - cohesion) as loss from met), held as (select *, greatest(0, least(1, 1 - loss / 0.06)) as retention from lost) select a, b, topics_a, topics_b, round_even(centroid, 9) as centroid, round_even(affinity, 9) as affinity, lexical, round_even(cohesion, 9) as cohesion, round_even(loss, 9) as loss, round_even(retention, 9) as retention, round_even(0.45::double * centroid + 0.3::double * affinity + 0.15::double * lexical + 0.1::double * retention, 9) as score from held",
    dom_alias_rule: None,
    pln_week_schedule: None,
    pln_compose_modules: None,
    pln_assessment_week: None,
    pln_generate_week: None,
    stm_spaced_repetition: "with recursive r as (select flashcard_id, reviewed_at, is_correct, difficulty, row_number() over (partition by flashcard_id order by reviewed_at, id) as rn, count(*) over (partition by flashcard_id) as n, max(reviewed_at) over (partition by flashcard_id) as last_review from reviews), f as (select flashcard_id, rn, n, last_review, case when not is_correct then 1 when difficulty = 1 then 1 when difficulty = 2 then 2 when difficulty = 3 then 2 else 4 end::bigint as d from r where rn = 1 union all select r.flashcard_id, r.rn, r.n, r.last_review, least(2305843009213693952, case when not r.is_correct then 1 when r.difficulty = 1 then greatest(1, f.d // 2) when r.difficulty = 2 then f.d + 1 when r.difficulty = 3 then f.d * 2 else f.d + 3 end) from r join f on f.flashcard_id = r.flashcard_id and r.rn = f.rn + 1) select flashcard_id, n as n_reviews, last_review, d as interval_days, case when d <= 2900000 then last_review + to_days(cast(d as integer)) end as next_review from f where rn = n",
    stm_windowed_activity: "select date_trunc('hour', ts) as begins, event_type, count(*) as n, sum(value) as total from events group by date_trunc('hour', ts), event_type",
    snk_delete_project: "select id, project_id from topics where project_id not between 3 and 7",
    snk_delete_document: "select id, project_id, doc_title from chunks where not ((project_id = 3 and doc_title = 'doc 3.pdf') or (project_id = 5 and doc_title = 'doc 5.pdf'))",
    snk_update_coalesce: "select id, topic, case when id % 10 = 0 then 'changed' else description end as description from topics",
    snk_insert_if_absent: "select id, case when id < 12 then name else upper(name) end as name from projects",
    snk_update_role_backfill: "select id, 'teaching' as role from chunks where id % 2 <> 0",
    snk_insert_returning: None,
    snk_upsert_document: "select doc_id, string_agg(chunk_text, chr(10) || chr(10) order by pos) as text from chunks group by doc_id",
    snk_status_update: "select id, case when topic_status = 'processing' then 'completed' else topic_status end as topic_status from projects",
    snk_plan_tree: "select project_id as plan_id, category as objective, string_agg(topic, ',' order by topic) as activities from topics group by project_id, category",
    snk_replace_scope: "select id, project_id, case when project_id in (1, 2) then upper(topic) else topic end as topic from topics",
    snk_append_chunks: "select id, cast(len(embedding) as bigint) as width from vchunks",
    snk_bulk_links: "select distinct t.id as topic_id, c.id as chunk_id from vtopics t join vchunks c on c.project_id = t.project_id and c.section = t.source_section",
    snk_broadcast: "select event_id, '{\"id\":\"' || sha256(props) || '\"' || case when trim(substring(props, 2)) = '}' then '' else ',' end || substring(props, 2) as payload from events",
    src_llm_shape_variants: "with t as (select conv_id, turn, (conv_id + turn) % 5 as shape, 'Why ' || role || ' ' || conv_id || ' ' || turn as q from conversations) select conv_id, turn, q || '?' as question from t where shape = 0 union all select conv_id, turn, 'other ' || q from t where shape = 0 union all select conv_id, turn, q from t where shape in (1, 2, 3)",
    srt_random: None,
}
