"""Adapter views: the study-assistant tables as pure projections of the base tables, in the common dialect."""

from __future__ import annotations

#: The day that stands for today in every registered query.
AS_OF = "timestamp '2024-02-01 00:00:00'"

VIEWS: dict[str, str] = {
    "projects": "select cast(n_nationkey as bigint) as id, n_name as name, cast(n_regionkey as bigint) as user_id, case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then 'building' else 'learning' end as study_mode, case n_nationkey % 4 when 0 then 'completed' when 1 then 'processing' when 2 then 'idle' else 'error' end as topic_status from nation",
    "topics": "select p_partkey as id, p_partkey % 25 as project_id, p_name as topic, p_brand as category, p_type as source_section, p_size % 10 <> 0 as is_display_topic, case when p_size % 4 = 0 then null else p_type end as description from part",
    "quizzes": "select o_orderkey as id, o_custkey as user_id, cast(c_nationkey as bigint) as project_id, o_orderpriority as difficulty, o_orderdate as created_at, o_totalprice as price from orders join customer on c_custkey = o_custkey",
    "quiz_answers": "select l_orderkey as quiz_id, l_partkey as topic_id, p_type as topic, p_name as title, p_brand as category, l_returnflag = 'N' as is_correct, l_shipdate as created_at, cast(l_linenumber as bigint) as question_order from lineitem join part on p_partkey = l_partkey",
    "attempts": "select l_orderkey as quiz_id, cast(sum(case when l_returnflag = 'N' then 1 else 0 end) as bigint) as score, count(*) as total_questions, l_shipdate as created_at from lineitem group by l_orderkey, l_shipdate",
    "reviews": "select event_id as id, user_id * 100 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as flashcard_id, user_id % 25 as project_id, user_id, event_type in ('click', 'view', 'purchase') as is_correct, 1 + event_id % 3 as difficulty, value as elapsed_seconds, ts as reviewed_at, 'k' || regexp_extract(props, '([0-9]+)', 1) as topic from events",
    "flashcards": "select flashcard_id as id, min(project_id) as project_id, min(user_id) as user_id, min(topic) as topic, max(reviewed_at) as last_review, max(difficulty) as difficulty from reviews group by flashcard_id",
    "doc_text": "select doc_id, 'doc ' || cast(doc_id % 40 as varchar(10)) || '.pdf' as doc_title, source, lang, doc_id % 25 as project_id, 1 + doc_id % 12 as page, trim(@RX(text, '[\\t-\\r ]+', ' ')) as clean from documents where text is not null",
    "chunks": "select doc_id * 100000 + pos as id, doc_id, project_id, doc_title, source as section, page, pos, @SUBSTR(clean, cast(pos * 800 + 1 as int), 1000) as chunk_text from (select *, @EXPLODE(@RANGE(cast(0 as bigint), cast(@INTDIV(greatest(length(clean), 1) - 1, 800) as bigint), cast(1 as bigint))) as pos from doc_text) w where length(clean) > 100",
    "vchunks": "select c.id, c.project_id % 5 as project_id, 'src' || cast(e.label as varchar(10)) as section, e.embedding, @LOWER(c.chunk_text) as chunk_text, c.doc_id % 7 <> 0 as teaching from (select *, doc_id % (select count(*) from embeddings) as vector from chunks) c join embeddings e on e.vec_id = c.vector",
    "vtopics": "select e.vec_id as id, e.vec_id % 5 as project_id, 'src' || cast(e.label as varchar(10)) as source_section, e.embedding, @LOWER(substring(d.text, 1, 30)) as topic from embeddings e join documents d on d.doc_id = e.vec_id",
    "ledger": "select vec_id as id, 'C' || cast(label as varchar(10)) as category, embedding from embeddings",
    "runs": "select l_orderkey as id, count(*) as generated, cast(sum(case when l_returnflag = 'N' then 0 else 1 end) as bigint) as rejected from lineitem group by l_orderkey",
    "reasons": "select l_orderkey as run_id, l_returnflag || l_linestatus as reason, count(*) as n from lineitem where l_returnflag <> 'N' group by l_orderkey, l_returnflag || l_linestatus",
    "objects": "select page_id as id, @RX(url, '^[a-z]+://', '') as name, length(html) as size, page_id % 4 as bucket from pages",
}

#: The same as Spark runs them: of documents only the letters that topics take go into the join, not the whole texts.
RUN_VIEWS = VIEWS | {"vtopics": VIEWS["vtopics"].replace("join documents d on", "join (select doc_id, substring(text, 1, 30) as text from documents) d on")}
