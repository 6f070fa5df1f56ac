"""Study planning: scores, reasons, states, strategies, slices and sizes."""

from __future__ import annotations

#: Category analytics with every kind of missing evidence.
_CATS = "(select category, case when n % 7 = 0 then null else cast(n % 101 as double) / 100 end as accuracy, case when n % 5 = 0 then null else n % 40 end as days, case when n % 6 = 0 then null else cast(n % 11 as double) / 10 end as coverage, case when n % 4 = 0 then 1.2 when n % 4 = 1 then 1.1 else 1.0 end as weight, case when n % 3 = 0 then null else cast(n % 89 as double) / 100 end as quiz_accuracy, case when n % 8 = 0 then null else cast(n % 97 as double) / 100 end as card_accuracy from (select category, count(*) * 13 + cast(substring(category, 7, 3) as bigint) * 17 as n from topics group by category) c)"
_SCORE = "@BROUND(coalesce(40 * (1 - accuracy), 0) + coalesce(25 * cast(least(greatest(days, 0), 30) as double) / 30, 0) + coalesce(25 * (1 - coverage), 0) + coalesce(10 * (weight - 1), 0), 4)"
_REASON = "case when accuracy is null and coverage is null then 'INSUFFICIENT_EVIDENCE' when coverage < 0.5 then 'LOW_COVERAGE' when accuracy < 0.6 then 'LOW_PERFORMANCE' when days >= 14 then 'NOT_RECENTLY_REVIEWED' when weight > 1 then 'HIGH_PRIORITY' else 'STABLE' end"
_ACTION = f"case {_REASON} when 'INSUFFICIENT_EVIDENCE' then 'EXPLORE' when 'LOW_COVERAGE' then 'EXPLORE' when 'LOW_PERFORMANCE' then 'REINFORCE' when 'NOT_RECENTLY_REVIEWED' then 'REVIEW' when 'HIGH_PRIORITY' then 'REVIEW' else 'ASSESSMENT' end"
_DEPTH = f"case when {_SCORE} >= 60 then 'DEEP' when {_SCORE} >= 30 then 'NORMAL' else 'LIGHT' end"

PLANS: dict[str, str] = {
    "pln_priority_score": f"select category, {_SCORE} as score from {_CATS} c",
    "pln_reasons": f"select category, concat_ws(',', case when accuracy < 0.7 then 'LOW_PERFORMANCE' end, case when days >= 14 then 'NOT_RECENTLY_REVIEWED' end, case when coverage < 0.7 then 'LOW_COVERAGE' end, case when weight > 1 then 'HIGH_PRIORITY' end) as reasons from {_CATS} c",
    "pln_rank_categories": f"select category, row_number() over (order by {_SCORE} desc, lower(category)) as rank_no from {_CATS} c",
    "pln_survey_bias": f"select category, case when accuracy is null and coverage is null then case length(category) % 3 when 0 then 0.95 when 1 then 1.10 else 1.20 end else weight end as weight from {_CATS} c",
    "pln_state": "select p.id as project_id, case when p.topic_status = 'processing' then 'ACTIVE_WEEK' when coalesce(c.coverage, 0) < 0.7 then 'NEW_PROJECT' else 'READY_FOR_FIRST_PLAN' end as state from projects p left join (select t.project_id, cast(count(distinct a.topic_id) as double) / count(distinct t.id) as coverage from topics t left join (select a.topic_id, q.project_id from quiz_answers a join quizzes q on q.id = a.quiz_id) a on a.topic_id = t.id and a.project_id = t.project_id group by t.project_id) c on c.project_id = p.id",
    "pln_topic_slice": "select category, id, cast(floor(cast(row_number() over (partition by category order by id) - 1 as double) / cap) as bigint) as segment, cast(ceil(cast(cap * 60 as double) / 60 * 100) as double) / 100 as minutes from (select category, id, cast(floor(cast(30 * 60 as double) / 60) as bigint) as cap from topics) t",
    "pln_strategy": f"select category, {_REASON} as reason, {_ACTION} as action, {_DEPTH} as depth from {_CATS} c",
    "pln_weekly_goal": f"select case when bool_or(a = 'EXPLORE') then 'CALIBRATE' when bool_or(a = 'REINFORCE') then 'IMPROVE' when bool_or(a = 'REVIEW') then 'REVIEW' else 'ASSESS' end as goal, count(*) as categories from (select {_ACTION} as a from {_CATS} c) x",
    "pln_activity_type": f"select category, case when {_ACTION} = 'EXPLORE' then 'QUIZ' when quiz_accuracy < 0.60 and card_accuracy < 0.70 then 'QUIZ_PLUS_FLASHCARDS' when quiz_accuracy < 0.60 then 'QUIZ' when card_accuracy < 0.70 then 'FLASHCARDS' when {_ACTION} = 'REVIEW' and accuracy < 0.75 then 'QUIZ_PLUS_FLASHCARDS' else 'QUIZ' end as kind from {_CATS} c",
    "pln_activity_size": f"select category, case {_DEPTH} when 'LIGHT' then 6 when 'NORMAL' then 10 else 15 end as questions, case {_DEPTH} when 'LIGHT' then 8 when 'NORMAL' then 12 else 18 end as cards from {_CATS} c",
    "pln_reason_codes": f"select action, @LISTAGG(reason, ',', reason) as codes, case when count(*) > 1 then 'MIXED' else max(reason) end as summary from (select distinct {_ACTION} as action, {_REASON} as reason from {_CATS} c) x group by action",
    "pln_activities": f"select category, part, ord from (select category, case when k = 0 then 'FLASHCARDS' else 'QUIZ' end as part, k as ord from (select category, @EXPLODE(@ARRAY('0', '1')) as kk from {_CATS} c where quiz_accuracy < 0.6 and card_accuracy < 0.7) y cross join (select 0 as z) o join (select 0 as k union all select 1) n on cast(n.k as varchar(3)) = y.kk) x",
    "pln_remaining": "select t.project_id, count(*) as remaining, count(*) > 0 as more_modules from topics t where not exists (select 1 from quiz_answers a join quizzes q on q.id = a.quiz_id where a.topic_id = t.id and q.project_id = t.project_id) group by t.project_id",
    "pln_complete_module": "select project_id, cast(sum(case when is_correct then 1 else 0 end) as bigint) as correct, count(*) as questions, greatest(cast(1 as bigint), cast(@BROUND(sum(elapsed_seconds) / 60, 0) as bigint)) as minutes from reviews group by project_id",
    "pln_knowledge": "select category, count(*) filter (where id % 3 = 0) as selected, count(*) filter (where id % 3 <> 0) as remaining, count(*) filter (where id % 3 = 0 and not is_display_topic) as warnings from topics group by category",
    "pln_next_week_guard": "select id, topic_status = 'completed' and coalesce(done, true) as allowed from projects p left join (select project_id, bool_and(is_correct or difficulty < 3) as done from reviews group by project_id) r on r.project_id = p.id",
    "pln_bridge": "select id, '' as review, coalesce(nullif(study_mode, ''), 'building') as study_mode from projects",
    "jon_lateral_json_each": "select event_id, cast(@JSON(props, '$.k') as bigint) as v from events where @JSON(props, '$.k') is not null",
    "jon_lateral_unnest": "select doc_id, w from (select doc_id, @EXPLODE(@SPLIT(text, ' ')) as w from documents) x where w <> ''",
    "jon_left_json_pk": "select x.event_id, x.col, p.pk is not null as is_pkey from (select event_id, @EXPLODE(@ARRAY('event_id', 'user_id', 'value')) as col from events) x left join (select event_id, case when event_type = 'signup' then 'user_id' else 'event_id' end as pk from events where event_type <> 'error') p on p.event_id = x.event_id and p.pk = x.col",
}
