"""Scopes, predicates, projections, joins, aggregations, sets and orderings over the study tables."""

from __future__ import annotations

from .adapters import AS_OF

#: key -> SELECT in the common dialect.
def _tenths(total: str, n: str) -> str:
    """The mean, with one decimal (half to even), of ``n`` values whose sum in thousand millionths is ``total``: in integers, so
    that no order of summation moves it over a rounding edge."""
    unit = f"({n} * 100000000)"
    whole, rest = f"@INTDIV({total}, {unit})", f"(2 * ({total} % {unit}))"
    up = f"case when {rest} > {unit} or ({rest} = {unit} and {whole} % 2 = 1) then 1 else 0 end"
    return f"cast({whole} + {up} as double) / 10"


# fixed values: titles that hold one of these are hidden
HIDDEN = ("deep muscles", "superficial muscles", "compartments of", "muscles of the posterior compartment", "muscles of the anterior compartment", "pronators and supinators", "muscle origins and insertions", "actions and innervation")

PLANS: dict[str, str] = {
    # ---- scans, filters, projections
    "src_table_scan": "select o_orderkey as order_id, o_custkey as user_id, o_totalprice as total from orders",
    "snk_row_to_json": "select id, @OBJECT('generated', generated, 'rejected', rejected) as doc from runs",
    "flt_project_scope": "select id, topic, category from topics where project_id = 7",
    "flt_owner_guard": "select id, name from projects where id = 7 and user_id = (select user_id from projects where id = 7)",
    "flt_optional_scope": "select id, page from chunks where project_id = 3 and doc_id = 28",
    "flt_display_topics": "select id, coalesce(nullif(category, ''), 'General') as category, topic, coalesce(description, '') as description from topics where topic is not null and is_display_topic",
    "flt_teaching_only": "select id, project_id from (select id, project_id, row_number() over (partition by project_id order by id) as rn from vchunks where teaching) x where rn <= 400",
    "flt_min_length": "select id, cast(length(chunk_text) as bigint) as n from chunks where chunk_text is not null and length(chunk_text) > 100",
    "flt_keyword_like": "select t.id as topic_id, c.id as chunk_id from vtopics t join vchunks c on c.project_id = t.project_id where lower(t.topic) like '%' || split_part(t.topic, ' ', 1) || '%' and lower(c.chunk_text) like '%' || split_part(t.topic, ' ', 1) || '%'",
    "flt_ilike_or": "select id, topic from topics where topic ilike '%ring%' or category ilike '%#2%' or coalesce(description, '') ilike '%eco%'",
    "flt_in_list": "select id, topic from topics where id in (1, 5, 8, 13, 21, 34, 55, 89)",
    "flt_due": f"select id, topic, last_review + interval '20' day as next_review from flashcards where last_review is not null and last_review + interval '20' day <= {AS_OF}",
    "flt_not_general": "select quiz_id, topic from quiz_answers where topic is not null and lower(trim(topic)) <> 'economy'",
    "flt_exists_flag": "select p.id, exists (select 1 from quizzes q where q.project_id = p.id) and exists (select 1 from reviews r where r.project_id = p.id) as has_evidence from projects p",
    "flt_having": "select topic, count(*) as n from reviews group by topic having count(*) >= 2",
    "flt_keyset_page": "select id, topic from topics where id > 100 order by id limit 50",
    "flt_distinct_titles": "select distinct doc_title from chunks",
    "flt_user_filters": "select e.event_id, bool_and(coalesce(case f.col when 'event_type' then e.event_type = f.val when 'user' then cast(e.user_id as varchar(20)) <> f.val end, false)) as visible from events e left join (select 'event_type' as col, 'click' as val union all select 'user', '5' union all select 'missing', 'x') f on f.col in ('event_type', 'user') group by e.event_id",
    "flt_validate_filters": "select id, col, op, val, known, known and castable and values_ <= 3 as valid, row_number() over (partition by id order by col, op, val) as place from (select *, col in ('event_id', 'event_type', 'value') as known, case when col = 'event_id' then @SIZE(@FILTER(@SPLIT(val, ','), v -> @TRYINT(v) is null)) = 0 else true end as castable, @SIZE(@SPLIT(val, ',')) as values_ from (select s_suppkey as id, case s_suppkey % 3 when 0 then 'event_id' when 1 then 'event_type' else 'other' end as col, case s_nationkey % 2 when 0 then 'eq' else 'in' end as op, case s_nationkey % 4 when 0 then s_name when 1 then cast(s_nationkey as varchar(10)) when 2 then '1,2,' || cast(s_suppkey as varchar(10)) else '1,2,3,' || cast(s_suppkey as varchar(10)) end as val from supplier union all select s_suppkey, 'event_id', 'lt', cast(s_suppkey as varchar(10)) from supplier union all select s_suppkey, 'value', 'gte', cast(s_nationkey as varchar(10)) from supplier) f) x",
    "flt_planner_config": "select c_custkey as id, c_custkey % 4 * 15 in (30, 45, 60) and c_custkey % 5 * 30 in (30, 60, 90, 120) and c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE') as valid from customer",
    "flt_topic_hide": "select id, title, " + " or ".join(f"contains(lower(trim(title)), '{p}')" for p in HIDDEN) + " as hidden from (select id, case id % 12 when 0 then 'The Deep Muscles of ' || topic when 1 then topic || ': actions and innervation ' when 2 then 'Compartments of ' || topic else topic end as title from topics) x",
    "flt_operation_match": "select event_id, coalesce(case when substring(op, 1, 8) = 'storage.' then substring(op, 9, 100) else op end in ('object.click', 'object.view'), false) as any_of_two, case when expected = '' then false else coalesce(case when substring(op, 1, 8) = 'storage.' then substring(op, 9, 100) else op end = expected, false) end as only_one from (select event_id, case event_id % 4 when 0 then 'storage.object.' || event_type when 1 then 'object.' || event_type when 2 then '' end as op, case event_id % 3 when 0 then 'object.' || event_type when 1 then 'object.view' else '' end as expected from events) x",
    "prj_coalesce_default": "select id, coalesce(nullif(study_mode, ''), 'building') as study_mode from projects",
    "prj_correct_answer": "select o_orderkey as id, coalesce(case when o_orderstatus = 'P' then null else o_orderstatus end, o_orderpriority) as answer from orders",
    "prj_topic_from_title": "select id, case when section is null or trim(section) = '' or lower(doc_title) like '%.pdf' then replace(@RX(doc_title, '\\.pdf$', ''), '_', ' ') else section end as topic from chunks",
    "prj_answer_index": "select id, coalesce((select min(i) from (select 0 as i, 'ECONOMY' as o union all select 1, 'STANDARD' union all select 2, 'PROMO' union all select 3, 'SMALL') opts where opts.o = t.source_section or opts.o like t.source_section || '%' or t.source_section like opts.o || '%'), 0) as answer_index from topics t",
    "prj_explanation_fallback": "select c_custkey as id, coalesce(nullif(trim(case when c_custkey % 3 = 0 then ' ' else c_mktsegment end), ''), nullif(trim(c_name), ''), 'none') as explanation from customer",
    # ---- joins
    "jon_chunk_topic_pairs": "select c.id as chunk_id, t.id as topic_id, -@DOT(c.embedding, t.embedding) as distance from vchunks c join vtopics t on t.project_id = c.project_id",
    "jon_topic_scope": "select c.id as chunk_id, t.id as topic_id, c.section from vchunks c join vtopics t on t.project_id = c.project_id and t.source_section = c.section where t.id in (1, 2, 3, 5, 8, 13, 21, 34)",
    "jon_global_scope": "select c.id as chunk_id, t.id as topic_id from vchunks c left join vtopics t on t.project_id = c.project_id and t.source_section = c.section",
    "jon_answers_questions_quizzes": "select a.quiz_id, a.topic, a.is_correct, q.user_id, q.project_id from quiz_answers a join quizzes q on q.id = a.quiz_id where q.project_id = 4",
    "jon_attempts_quizzes": "select t.quiz_id, t.score, t.total_questions, q.difficulty, q.created_at from attempts t join quizzes q on q.id = t.quiz_id",
    "jon_fanout_question_attempts": "select a.topic, avg(cast(t.score as double) / t.total_questions * 100) as pct, count(*) as n from quiz_answers a join quizzes q on q.id = a.quiz_id join attempts t on t.quiz_id = q.id group by a.topic",
    "jon_cards_left_reviews": "select f.id, count(r.id) as n from flashcards f left join (select * from reviews where is_correct) r on r.flashcard_id = f.id group by f.id",
    "jon_reviews_cards": "select r.topic, count(distinct f.id) as n from reviews r join flashcards f on f.id = r.flashcard_id group by r.topic",
    "jon_semi_in": "select quiz_id, score from attempts where quiz_id in (select id from quizzes where project_id = 9)",
    "jon_semi_delete": "select t.id, t.topic from topics t where not exists (select 1 from projects p where p.id = t.project_id and p.topic_status = 'error')",
    "jon_anti_orphans": "select t.id from vtopics t where not exists (select 1 from vchunks c where c.project_id = t.project_id and c.section = t.source_section and contains(c.chunk_text, split_part(t.topic, ' ', 1)))",
    "jon_orphan_chunk_pairs": "select t.id as topic_id, c.id as chunk_id, -@DOT(t.embedding, c.embedding) as distance from vtopics t join vchunks c on c.project_id = t.project_id where c.teaching and not exists (select 1 from vchunks x where x.project_id = t.project_id and x.section = t.source_section and contains(x.chunk_text, split_part(t.topic, ' ', 1)))",
    "jon_semi_exists": "select count(*) as n from vtopics t where exists (select 1 from vchunks c where c.project_id = t.project_id and c.section = t.source_section)",
    "jon_exists_order_key": "select id, name, case when exists (select 1 from topics t where t.project_id = p.id and t.category = 'Brand#2') then 0 else 1 end as rank_key from projects p",
    "jon_cross_scalar": "select r.reason, cast(sum(r.n) as bigint) as n, max(t.total) as total from reasons r cross join (select cast(sum(n) as bigint) as total from reasons) t group by r.reason",
    "jon_full_outer_columns": "select coalesce(n.k, o.k) as col, n.v as new_value, o.v as old_value from (select p_name as k, max(p_size) as v from part where p_size > 25 group by p_name) n full outer join (select p_name as k, max(p_size) as v from part where p_size < 10 group by p_name) o on o.k = n.k",
    "jon_name_lookup": "select e.quiz_id, d.category from quiz_answers e join (select k, category from (select lower(trim(topic)) as k, category, row_number() over (partition by lower(trim(topic)) order by category, topic) as rn from topics) x where rn = 1) d on d.k = lower(trim(e.title))",
    "jon_topic_category": "select a.quiz_id, a.question_order, m.category from quiz_answers a left join (select lower(topic) as k, max_by(category, id) as category from topics group by lower(topic)) m on m.k = lower(a.title)",
    "jon_pair_self": "select a.category as category_a, b.category as category_b from (select distinct category from ledger) a join (select distinct category from ledger) b on a.category < b.category",
    "jon_comma_cross": "select s.n as slots, r.topic, r.n from (select count(*) as n from reviews) s, (select topic, count(*) as n from reviews group by topic) r",
    # ---- aggregations
    "agg_count": "select project_id, count(*) as n from quizzes group by project_id",
    "agg_count_filter": "select count(*) filter (where teaching) as eligible, count(*) filter (where not teaching) as excluded from vchunks",
    "agg_count_distinct": "select project_id, count(distinct topic) as topics, count(distinct flashcard_id) as cards from reviews group by project_id",
    "agg_coverage_stats": "with links as (select t.id as topic_id, c.id as chunk_id from vtopics t join vchunks c on c.project_id = t.project_id and c.section = t.source_section) select count(*) as links, count(distinct topic_id) as topics, count(distinct chunk_id) as chunks, (select coalesce(max(n), 0) from (select count(*) as n from links group by chunk_id) x) as most from links",
    "agg_max_of_count": "select coalesce(max(n), 0) as most from (select quiz_id, count(*) as n from quiz_answers group by quiz_id) x",
    "agg_quiz_summary": "select q.project_id, count(*) as n, avg(cast(t.score as double) / nullif(t.total_questions, 0) * 100) as average from attempts t join quizzes q on q.id = t.quiz_id where t.total_questions > 0 group by q.project_id",
    "agg_avg_score": f"select user_id, {_tenths('total', 'n')} as average from (select q.user_id, cast(sum(@INTDIV(t.score * 100000000000, t.total_questions)) as bigint) as total, count(*) as n from attempts t join quizzes q on q.id = t.quiz_id where t.total_questions > 0 group by q.user_id) x",
    "agg_hybrid_topic_score": f"select topic, n, {_tenths('total', 'n')} as score from (select coalesce(topic, 'General') as topic, count(*) as n, cast(sum(score) as bigint) as total from (select a.topic, @INTDIV(t.score * 100000000000, t.total_questions) as score from quiz_answers a join attempts t on t.quiz_id = a.quiz_id union all select topic, case when is_correct then 100000000000 else 0 end from reviews) x group by coalesce(topic, 'General')) y",
    "agg_card_stats_topic": "select topic, total, wrong, hard, good, easy, case when total = 0 then 0.0 else cast(good + easy as double) / total end as accuracy from (select f.topic, count(r.id) as total, count(*) filter (where not r.is_correct) as wrong, count(*) filter (where r.is_correct and r.difficulty = 1) as hard, count(*) filter (where r.is_correct and r.difficulty = 2) as good, count(*) filter (where r.is_correct and r.difficulty = 3) as easy from flashcards f left join reviews r on r.flashcard_id = f.id group by f.topic) x",
    "agg_review_stats_topic": "select topic, count(*) as total, count(*) filter (where not is_correct) as wrong, count(*) filter (where is_correct and difficulty = 1) as hard, count(*) filter (where is_correct and difficulty = 2) as good, count(*) filter (where is_correct and difficulty = 3) as easy from reviews group by topic",
    "agg_card_difficulty_counts": "select topic, cast(sum(n) as bigint) as total from (select lower(trim(coalesce(topic, 'General'))) as topic, difficulty, count(*) as n from flashcards group by coalesce(topic, 'General'), difficulty) x group by topic",
    "agg_topic_mastery_json": "select coalesce(topic, 'general') as topic, count(*) as total, cast(sum(case when is_correct then 1 else 0 end) as bigint) as correct, @BROUND(100.0 * cast(sum(case when is_correct then 1 else 0 end) as double) / count(*), 1) as accuracy from quiz_answers group by coalesce(topic, 'general')",
    "agg_global_quiz_metrics": "select cast(sum(correct) as bigint) as correct, cast(sum(total - correct) as bigint) as wrong, avg(accuracy) as average from (select topic, count(*) as total, count(*) filter (where is_correct) as correct, 100.0 * cast(count(*) filter (where is_correct) as double) / count(*) as accuracy from quiz_answers group by topic) x",
    "agg_flashcard_metrics": "select project_id, count(*) as total, count(*) filter (where is_correct) as correct, case when count(*) = 0 then 0.0 else @BROUND(100.0 * cast(count(*) filter (where is_correct) as double) / count(*), 1) end as accuracy from reviews group by project_id",
    "agg_flashcard_results": "select project_id, count(*) as total, count(*) filter (where is_correct) as correct, @BROUND(avg(elapsed_seconds), 1) as average_seconds from reviews group by project_id",
    "agg_forgotten_topics": "select topic, accuracy, n from (select topic, count(*) as n, cast(count(*) filter (where is_correct) as double) / count(*) as accuracy from reviews group by topic having count(*) >= 2) x order by accuracy asc, topic limit 3",
    "agg_weak_areas": "select title, accuracy from (select title, 100.0 * cast(count(*) filter (where is_correct) as double) / count(*) as accuracy from quiz_answers group by title) x order by accuracy, title limit 3",
    "agg_weak_topics": "select title, accuracy from (select title, avg(case when is_correct then 1.0D else 0.0D end) as accuracy from quiz_answers group by title) x order by accuracy asc, title limit 5".replace("1.0D", "cast(1 as double)").replace("0.0D", "cast(0 as double)"),
    "agg_adaptive_quiz_size": "select user_id, case when a < 0.5 then 15 when a < 0.8 then 20 else 25 end as questions from (select q.user_id, coalesce(nullif(avg(case when a.is_correct then cast(1 as double) else cast(0 as double) end), 0), 0.5) as a from quizzes q join quiz_answers a on a.quiz_id = q.id group by q.user_id) x",
    "agg_topic_stats_union": "select topic, cast(sum(correct) as bigint) as correct, cast(sum(total) as bigint) as total from (select a.topic, count(*) filter (where a.is_correct) as correct, count(*) as total from quiz_answers a join quizzes q on q.id = a.quiz_id where a.topic is not null and lower(trim(a.topic)) <> 'general' group by a.topic union all select topic, count(*) filter (where is_correct) as correct, count(*) as total from reviews where topic is not null and lower(trim(topic)) <> 'general' group by topic) x group by topic",
    "agg_attempts_by_quiz": "select t.quiz_id, count(*) as attempts, max(t.score) as best, avg(t.score) as average, max_by(t.score, t.created_at) as last_score from attempts t join quizzes q on q.id = t.quiz_id group by t.quiz_id",
    "agg_attempts_summary": "select q.user_id, count(*) as attempts, max(t.score) as best, max_by(t.score, t.quiz_id * 100000 + @DAYS(t.created_at, timestamp '1990-01-01 00:00:00')) as last_score from attempts t join quizzes q on q.id = t.quiz_id group by q.user_id",
    "agg_hard_summary": "select count(*) as runs, avg(rejected) as average, percentile_cont(0.5) within group (order by rejected) as median, min(rejected) as least, max(rejected) as most, avg(cast(generated - rejected as double) / generated) as acceptance from runs",
    "agg_rejection_breakdown": "select reason, n, case when total = 0 then 0.0 else 100.0 * cast(n as double) / total end as pct from (select reason, cast(sum(n) as bigint) as n from reasons group by reason) r cross join (select cast(sum(n) as bigint) as total from reasons) t",
    "agg_hard_metrics": "select id, generated, least(greatest(rejected, 0), generated) as rejected, generated - least(greatest(rejected, 0), generated) as accepted, case when generated = 0 then 0.0 else @BROUND(cast(generated - least(greatest(rejected, 0), generated) as double) / generated, 4) end as rate from runs",
    "agg_role_histogram": "select d.v as role, count(c.id) as n from @LITERALS('cover', 'outline', 'bibliography', 'administrative', 'intro', 'teaching') d left join (select id, case when teaching then 'teaching' else 'intro' end as role from vchunks) c on c.role = d.v group by d.v",
    "agg_category_analytics": f"with ev as (select category, title as k, is_correct, created_at as ts, 1 as quiz from quiz_answers union all select 'Brand#' || cast(1 + user_id % 20 as varchar(10)), topic, is_correct, reviewed_at, 0 from reviews), cats as (select category, count(distinct topic) as topics from topics group by category) select c.category, avg(case when e.is_correct then cast(1 as double) when not e.is_correct then cast(0 as double) end) as accuracy, avg(case when quiz = 1 then case when e.is_correct then cast(1 as double) else cast(0 as double) end end) as quiz_accuracy, avg(case when quiz = 0 then case when e.is_correct then cast(1 as double) else cast(0 as double) end end) as flashcard_accuracy, cast(count(distinct e.k) as double) / nullif(max(c.topics), 0) as coverage, @DAYS({AS_OF}, max(e.ts)) as days_since_review from cats c left join ev e on e.category = c.category group by c.category",
    "agg_learning_coverage": "select t.project_id, cast(count(distinct e.k) as double) / count(distinct lower(trim(t.topic))) as coverage from topics t left join (select distinct lower(trim(title)) as k from quiz_answers) e on e.k = lower(trim(t.topic)) group by t.project_id",
    "agg_taxonomy_snapshot": "select project_id, count(*) as n, @JOIN(@SORTED(@COLLECTSET(trim(topic))), '|') as topics, @JOIN(@SORTED(@COLLECTSET(trim(category))), '|') as categories from topics group by project_id",
    "agg_before_after_category": "select coalesce(m.target, t.category) as category, count(*) as topics, count(distinct t.category) as sources from topics t left join (select distinct category, case when category like '%1%' then 'Brand#1' end as target from topics) m on m.category = t.category group by coalesce(m.target, t.category)",
    "agg_merge_matrix": "select source, target, n, count(*) over (partition by target) as sources from (select category as source, substring(category, 1, 7) as target, count(*) as n from topics group by category, substring(category, 1, 7)) x",
    "agg_topic_distribution": "select topic, count(*) as n from topics group by topic order by n desc, topic limit 20",
    "agg_runtime_statistics": "select project_id, count(*) filter (where is_correct is not null) as reviewed, cast(sum(coalesce(nullif(cast(case when is_correct then 1 else 0 end as bigint), 0), 0)) as bigint) as correct, sum(elapsed_seconds) / 60 as minutes from (select * from reviews where user_id % 2 = 0) r group by project_id",
    "agg_activity_mix": "select project_id, count(*) filter (where kind = 'quiz') as quiz, count(*) filter (where kind = 'cards') as cards, count(*) filter (where kind = 'mixed') as mixed from (select project_id, case id % 3 when 0 then 'quiz' when 1 then 'cards' else 'mixed' end as kind from topics) x group by project_id",
    "agg_bucket_size": "select bucket, cast(sum(size) as bigint) as size from objects group by bucket",
    "agg_string_agg": "select category, @LISTAGG(topic, ',', 'topic') as topics, concat_ws('/', case when bool_or(is_display_topic) then 'shown' end, case when bool_or(not is_display_topic) then 'hidden' end) as flags from topics group by category".replace("'topic'", "topic"),
    "agg_json_build": "select category, @TOJSON(@SORTED(@COLLECTSET(topic))) as doc from topics group by category",
    "agg_phase_totals": "select event_type as phase, sum(value) as seconds, max_by(value, ts) as last_value, count(*) as n from events group by event_type",
    "agg_prefix_min": "select split_part(name, '/', 1) as folder, min(id) as first_id, count(*) as n from objects group by split_part(name, '/', 1)",
    "agg_study_flag_counts": "select project_id, count(*) filter (where last_review is not null) as studied from flashcards group by project_id",
    # ---- window-like operators
    "win_last_attempt": "select user_id, quiz_id, score from (select q.user_id, t.quiz_id, t.score, row_number() over (partition by q.user_id order by q.created_at desc, t.quiz_id desc, t.created_at desc) as rn from attempts t join quizzes q on q.id = t.quiz_id) x where rn = 1",
    "win_topic_order": "select id, category, cast(row_number() over (partition by category order by topic, id) as bigint) as ord from topics",
    "win_section_ffill": "select doc_title, page, pos, coalesce(@LASTSET(det) over (partition by doc_id order by pos rows between unbounded preceding and current row), upper(doc_title)) as section from (select *, case when id % 3 = 0 then substring(chunk_text, 1, 12) end as det from chunks) x",
    "win_first_wins_dedup": "select topic, id from (select topic, id, row_number() over (partition by lower(topic) order by id) as rn from topics) x where rn = 1",
    "win_last_wins_dedup": "select topic, first_id, last_category from (select topic, min(id) as first_id, max_by(category, id) as last_category from topics group by topic) x",
    "win_mini_groups": "select project_id, grp, count(*) as n, min(id) as first_id from (select project_id, id, cast(floor((row_number() over (partition by project_id order by id) - 1) / 20) as bigint) as grp from vchunks) x group by project_id, grp",
    "win_k_nearest": "select a, b from (select x.a, x.b, row_number() over (partition by x.a order by x.sim desc, x.b) as rn from (select l.category as a, r.category as b, avg(@DOT(l.embedding, r.embedding)) as sim from ledger l join ledger r on l.category <> r.category group by l.category, r.category) x) y where rn <= 2",
    "win_lead_priority": "select category, case when rn <= 3 then 'priority' else 'secondary' end as role from (select category, row_number() over (order by count(*) desc, category) as rn from topics group by category) x",
    "win_module_position": "select category, topic, case when rn = 1 then 'first' when rn = n then 'last' else 'middle' end as place from (select category, topic, row_number() over (partition by category order by topic) as rn, count(*) over (partition by category) as n from (select distinct category, topic from topics) d) x",
    "win_topic_cap": "select category, topic, id from (select category, topic, id, row_number() over (partition by category order by id) as rn from topics) x where rn <= 40",
    # ---- orderings
    "srt_vector_topk_l2": "select c.id, @L2(c.embedding, t.embedding) as distance from vchunks c cross join (select embedding from vtopics where id = 7) t order by distance, id limit 20",
    "srt_recent_history": "select id, project_id, created_at from quizzes order by created_at desc, id limit 20",
    "srt_multi_key": "select category, score from (select category, avg(p) as score from (select category, cast(id % 97 as double) as p from topics) x group by category) y order by score desc, lower(category) limit 15",
    "srt_id_desc_limit": "select id, topic from flashcards order by id desc limit 25",
    "srt_offset": "select name, id from objects order by name, id limit 30 offset 20",
    "srt_row_cursor": "select id, topic from topics where topic > 'red' or (topic = 'red widget' and id > 50)",
    "srt_distinct_on": "select folder, id from (select split_part(name, '/', 1) as folder, id, row_number() over (partition by split_part(name, '/', 1) order by id) as rn from objects) x where rn = 1",
    "srt_question_order": "select quiz_id, question_order, topic_id from quiz_answers",
    "srt_rotate": "select id, @AT(@ARRAY('alpha', 'beta', 'gamma'), cast(id % 3 + 1 as int)) as focus from projects",
    # ---- sets
    "set_union_all": "select topic, 'quiz' as kind from quiz_answers union all select topic, 'card' as kind from reviews where project_id = 2",
    "set_taxonomy_evolution": "select 'created' as change, topic from (select topic from topics where project_id = 3 except select topic from topics where project_id = 4) a union all select 'preserved', topic from (select topic from topics where project_id = 3 intersect select topic from topics where project_id = 4) b union all select 'removed', topic from (select topic from topics where project_id = 4 except select topic from topics where project_id = 3) c",
    "set_union_evidence": "select lower(trim(topic)) as k from quiz_answers union select lower(trim(topic)) from reviews",
    "set_remaining_topics": "select t.id, t.topic from topics t where not exists (select 1 from quiz_answers a join quizzes q on q.id = a.quiz_id where a.topic_id = t.id and q.project_id = t.project_id)",
    "set_coverage_check": "select coalesce(e.id, a.id) as id, a.id is null as missing, e.id is null as unknown, coalesce(a.n, 0) > 1 as duplicate from (select id from vtopics) e full outer join (select id % 60 as id, count(*) as n from vchunks where id % 2 = 0 group by id % 60) a on a.id = e.id",
    "set_sentinel_row": "select id, topic from topics where category = 'none' union all select cast(null as bigint), cast(null as varchar(10)) where not exists (select 1 from topics where category = 'none')",
    "set_token_jaccard": "select a.id as a, b.id as b, cast(@SIZE(@BOTH(a.w, b.w)) as double) / nullif(@SIZE(a.w) + @SIZE(b.w) - @SIZE(@BOTH(a.w, b.w)), 0) as jaccard from (select id, @DISTINCT(@SPLIT(topic, ' ')) as w from vtopics) a join (select id, @DISTINCT(@SPLIT(topic, ' ')) as w from vtopics) b on a.id < b.id",
}
