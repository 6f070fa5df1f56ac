"""Scalar functions on text, dates, numbers, vectors, arrays, maps and JSON as plans over the study tables."""

from __future__ import annotations

from .adapters import AS_OF

# fixed values: word endings that category names lose (first match), names too general to count
SUFFIXES = ("zioni", "zione", "iche", "ici", "ale", "ali", "ica", "ico", "i", "e", "s")
NOISE = ("a", "an", "and", "case", "cases", "casi", "dei", "del", "della", "delle", "dell", "di", "e", "example", "examples", "general", "generale", "in", "of", "overview", "panoramica", "the", "tipi", "tipologie", "type", "types")
GENERIC = ("general", "generale", "overview", "panoramica", "case", "cases", "casi", "type", "types", "tipi", "tipologie")
ANATOMY = ("upper limb", "lower limb", "shoulder", "arm", "forearm", "hand", "hip", "thigh", "leg", "foot", "pelvis")
# fixed values: question openings and what replaces them, first match
OPENINGS = (
    ("What is the role of", "During a system response,"),
    ("What is the primary role of", "In the context of a changing system,"),
    ("What is the main role of", "During a regulatory process,"),
    ("What is the function of", "Within an adaptive process,"),
    ("What is the primary function of", "Within a dynamic system,"),
    ("What is the significance of", "In a situation where"),
    ("What is the primary consequence of", "A prolonged alteration results in"),
    ("What is the main consequence of", "A system disruption leads to"),
    ("What happens to", "During a changing condition,"),
    ("What occurs", "During this transition,"),
    ("What is", "In this situation,"),
    ("Which of the following", "Among the following scenarios,"),
    ("Which process", "During a changing situation,"),
    ("Which pathway", "Within this sequence of events,"),
    ("Which mechanism", "The explanation that BEST fits this situation"),
    ("Which component", "An important element in this context"),
    ("Which factor", "A key factor in this situation"),
    ("Which condition", "Under these circumstances"),
    ("Which statement", "The most accurate interpretation"),
    ("Which enzyme", "A required element in this process"),
    ("Which molecule", "An important component in this situation"),
    ("Which amino acid", "In this context,"),
    ("Which metabolic process", "During this system change,"),
)


def stem(word: str) -> str:
    """A category token without the first suffix that leaves more than three letters."""
    arms = " ".join(f"when length({word}) > {len(s) + 3} and {word} like '%{s}' then substring({word}, 1, cast(length({word}) - {len(s)} as int))" for s in SUFFIXES)
    return f"case {arms} else {word} end"


def any_of(text: str, patterns: tuple[str, ...]) -> str:
    return f"({hits(text, patterns)} > 0)"


def hits(text: str, patterns: tuple[str, ...]) -> str:
    """How many of the patterns the text contains; a loop over a literal, as a branch for each makes code too long to compile."""
    quoted = ", ".join("'" + p.replace("'", "''") + "'" for p in patterns)
    return f"@SIZE(@FILTER(@ARRAY({quoted}), needle -> contains({text}, needle)))"


def listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_NAMES = "(select distinct category as raw, lower(@RX(category, '[^A-Za-z0-9 ]+', ' ')) as name from (select category from topics union all select 'Tipi di contrazione generale' union all select 'Overview of the muscular systems' union all select 'DNA SEQUENCING TECHNIQUES' union all select 'Casi pratici e metodi') n)"
_TOKENS = f"(select raw, name, @DISTINCT(@MAP(@FILTER(@SPLIT(name, ' '), w -> w <> ''), w -> {stem('w')})) as tokens from {_NAMES} nm)"
_SQUASH = "trim(@RX(%s, '[\\t-\\r \\x{00A0}]+', ' '))"


def squash(x: str) -> str:
    return _SQUASH % x


# fixed values: how a text about the learner becomes one to the learner, in this order
TO_LEARNER = (
    ("the student should", "you should"),
    ("The student should", "You should"),
    ("a successful student should", "you should"),
    ("A successful student should", "You should"),
    ("the student will", "you will"),
    ("The student will", "You will"),
    ("students should", "you should"),
    ("Students should", "You should"),
    ("learners should", "you should"),
    ("Learners should", "You should"),
)
ABOUT = ("The student should see", "a successful student should see", "learners should see", "Students should know that the student will see", "You will see")


def to_learner(text: str) -> str:
    for source, target in TO_LEARNER:
        text = f"replace({text}, '{source}', '{target}')"
    return text


def one_of(texts: tuple[str, ...], number: str) -> str:
    """One of the texts by a number, as SQL."""
    quoted = [t.replace("'", "''") for t in texts]
    return "case " + f"({number}) % {len(texts)}" + " ".join(f" when {i} then '{t}'" for i, t in enumerate(quoted)) + " end"


PLANS: dict[str, str] = {
    "str_normalize": f"select doc_id, {squash('text')} as clean from documents",
    "str_topic_key": f"select doc_id, lower({squash('text')}) as k from documents",
    "str_clean_text": "select doc_id, trim(@RX(@RX(@RX(@RX(@RX(text, '([a-z])([A-Z])', '$1 $2'), '([A-Za-z])([0-9])', '$1 $2'), '([0-9])([A-Za-z])', '$1 $2'), '\\.([A-Za-z])', '. $1'), '[\\t-\\r ]+', ' ')) as clean from documents",
    "str_role_normalize": "select doc_id, trim(@RX(translate(lower(replace(replace(text, '’', ''''), '‘', '''')), 'àáâãäåèéêëìíîïòóôõöùúûüçñ', 'aaaaaaeeeeiiiiooooouuuucn'), '[\\t-\\r ]+', ' ')) as clean from documents",
    "str_count_matches": f"select doc_id, {hits('text', ('the ', 'and ', 'que ', 'der ', 'para '))} as n from documents",
    "str_category_normalize": f"select raw, @JOIN(@SORTED(tokens), ' ') as tokens from {_TOKENS} t",
    "str_core_tokens": f"select raw, @JOIN(@SORTED(@FILTER(tokens, w -> w not in ({listed(NOISE)}))), ' ') as core from {_TOKENS} t",
    "str_name_quality": f"select raw, case when @SIZE(@FILTER(tokens, w -> w in ({listed(GENERIC)}))) > 0 then 1 else 0 end as generic, @SIZE(@FILTER(tokens, w -> w in ({listed(NOISE)}))) as noise, @SIZE(tokens) as n_tokens from {_TOKENS} t",
    "str_keyword_overlap": "select t.id as topic_id, c.id as chunk_id, @SIZE(@FILTER(@SPLIT(t.topic, ' '), w -> length(w) > 4 and contains(c.chunk_text, w))) as n from vtopics t join vchunks c on c.project_id = t.project_id",
    "str_bcp47": "select doc_id, lower(split_part(tag, '-', 1)) || case when @SIZE(@SPLIT(tag, '-')) > 1 then '-' || @JOIN(@MAP(@SLICE(@SPLIT(tag, '-'), 2, 8), w -> case when @MATCH(w, '^[A-Za-z]{4}$') then upper(substring(w, 1, 1)) || lower(substring(w, 2, 3)) when @MATCH(w, '^([A-Za-z]{2}|[0-9]{3})$') then upper(w) else lower(w) end), '-') else '' end as canonical from (select doc_id, trim(both '-' from @RX(replace(case doc_id % 6 when 0 then upper(lang) when 1 then lang || '_' || lang when 2 then upper(lang) || '-lATN' when 3 then lang || '_LATN_us' when 4 then lang || '--419-x1b' else '_' || upper(lang) || '-POSIX_' end, '_', '-'), '-+', '-')) as tag from documents) x",
    "str_section_title": f"select doc_id, @UPPER(trim(line)) as section from (select doc_id, pos, line, row_number() over (partition by doc_id order by pos) as rn from (select doc_id, pos, @AT(@SPLIT(text, chr(10)), cast(pos as int)) as line from (select doc_id, text, @EXPLODE(@RANGE(1, 15, 1)) as pos from documents) a) b where trim(coalesce(line, '')) <> '' and ((cast(length(trim(line)) - length(@RX(trim(line), '[A-ZÀ-ÖØ-Þ]', '')) as double) / greatest(length(trim(line)), 1) > 0.7 and @SIZE(@SPLIT(trim(line), ' ')) between 2 and 8) or {any_of('@LOWER(line)', ANATOMY)})) c where rn = 1",
    "str_question_key": "select doc_id, @JOIN(@SLICE(@SPLIT(lower(trim(@RX(text, '[\\t-\\r ]+', ' '))), ' '), 1, 8), ' ') as k from documents",
    "str_rewrite_opening": f"select v as q, case {' '.join(f"when v like '{old}%' then '{new}' || substring(v, {len(old) + 1})" for old, new in OPENINGS)} else v end as rewritten from (select text as v from conversations union all select v from @LITERALS('Why What is it', 'what is a cell', {', '.join(f"'{old} x, {old} y'" for old, _ in OPENINGS)}) l) o",
    "str_split_csv": "select id, trim(part) as part from (select id, @EXPLODE(@SPLIT(csv, ',')) as part from (select id, category || ', ' || topic as csv from topics) a) b",
    "str_url_unquote": "select page_id, @URLDECODE(replace(url, '/', '%2F')) as url from pages",
    "str_context_concat": "select doc_id, @LISTAGG(chunk_text, ' --- ', pos) as context from chunks group by doc_id",
    "str_human_list": "select category, case when @SIZE(a) = 1 then @AT(a, 1) else @JOIN(@SLICE(a, 1, cast(@SIZE(a) - 1 as int)), ', ') || ' and ' || @AT(a, cast(@SIZE(a) as int)) end as listed from (select category, @SORTED(@COLLECT(distinct topic)) as a from topics where topic is not null group by category) x".replace("@COLLECT(distinct topic)", "@COLLECTSET(topic)"),
    "str_path_parts": "select name, @RX(name, '^.*/', '') as filename, split_part(name, '/', 1) as folder, case when name like '%.%' then @RX(name, '^.*\\.', '') else '' end as extension from objects",
    "str_common_prefix": "select name, case when strpos(substring(name, 5, 400), '/') > 0 then substring(name, 1, cast(4 + strpos(substring(name, 5, 400), '/') as int)) end as prefix from objects".replace("strpos(substring(name, 5, 400), '/')", "@FIND(substring(name, 5, 400), '/')"),
    "str_word_overlap": "select a.doc_id as a, b.doc_id as b, cast(@SIZE(@BOTH(a.w, b.w)) as double) / least(@SIZE(a.w), @SIZE(b.w)) as overlap from (select doc_id, @DISTINCT(@FILTER(@SPLIT(lower(text), ' '), x -> length(x) >= 5)) as w from documents) a join (select doc_id, @DISTINCT(@FILTER(@SPLIT(lower(text), ' '), x -> length(x) >= 5)) as w from documents) b on a.doc_id < b.doc_id where @SIZE(a.w) >= 6 and @SIZE(b.w) >= 6",
    "str_pronoun_rewrite": f"select conv_id, turn, {to_learner('said')} as said from (select conv_id, turn, trim({one_of(ABOUT, 'conv_id + turn')} || ' ' || coalesce(text, '')) as said from conversations) x",
    "str_fence_strip": "select conv_id, turn, trim(@RX(@RX(v, '```json', ''), '```', '')) as body from (select conv_id, turn, case turn % 3 when 0 then '```json ' || text || ' ```' when 1 then '``` ' || text || '```' else text end as v from conversations) x",
    "str_code_label": "select name, split_part(name, '/', 2) as level_two, trim(trailing '/' from name) as bare, concat_ws(':', split_part(name, '/', 1), cast(bucket as varchar(10))) as label from objects",
    "str_quote_ident": "select p_partkey as id, @RX(v, '^\"|\"$', '') as bare, '\"' || replace(@RX(v, '^\"|\"$', ''), '\"', '\"\"') || '\"' as quoted from (select p_partkey, case p_partkey % 3 when 0 then '\"' || p_name || '\"' when 1 then p_name else '\"' || p_brand || '\".\"' || p_type || '\"' end as v from part) x",
    "str_build_statement": "select id, 'id = ''' || cast(id as varchar(20)) || ''' and topic = ''' || topic || '''' as predicate from topics",
    # ---- dates and numbers
    "dat_week_start": "select o_orderkey as id, date_trunc('week', o_orderdate) as week from orders".replace("date_trunc('week', o_orderdate)", "cast(date_trunc('week', o_orderdate) as date)"),
    "dat_days_since": f"select o_orderkey as id, @DAYS({AS_OF}, o_orderdate) as days from orders",
    "dat_utc_naive": "select event_id, ts - interval '2' hour as utc from events",
    "dat_interval_add": "select event_id, ts + interval '3' day as due from events",
    "dat_interval_days": "select e.event_id, greatest(1, @INTDIV(@SECONDS(e.ts + interval '90' hour, e.ts), 86400)) as days from events e",
    "dat_day_name": "select o_orderkey as id, @FMT(o_orderdate, 'EEEE', '%A') as day_name from orders",
    "dat_duration_min": "select event_id, case when value = 0 then null else greatest(cast(1 as bigint), cast(@BROUND(value * 1000 / 60000, 0) as bigint)) end as minutes from events",
    "dat_ts_format": "select event_id, @FMT(ts, 'yyyy-MM-dd''T''HH:mm:ss', '%Y-%m-%dT%H:%M:%S') || 'Z' as said from events",
    "mth_pct_1dp": "select quiz_id, case when total_questions = 0 then 0.0 else @BROUND(100.0 * cast(score as double) / total_questions, 1) end as pct from attempts",
    "mth_ceil_cents": "select event_id, cast(ceil(value / 60 * 100) as double) / 100 as minutes from events",
    "mth_clamp": "select event_id, least(greatest(value / 50, cast(0 as double)), cast(1 as double)) as share from events where value is not null",
    "mth_floor_div": "select id, cast(floor(cast(id as double) / 7) as bigint) as batch, greatest(cast(3 as bigint), cast(floor(cast(20 as double) / (1 + id % 9)) as bigint)) as k from topics",
    "mth_norm_accuracy": "select id, case when raw > 1 then raw / 100 else raw end as accuracy from (select o_orderkey as id, case when o_orderkey % 2 = 0 then cast(o_orderkey % 101 as double) else cast(o_orderkey % 11 as double) / 10 end as raw from orders) x",
    "mth_level": "select quiz_id, case when total_questions = 0 then 'unknown' when cast(score as double) / total_questions >= 0.8 then 'high' when cast(score as double) / total_questions >= 0.5 then 'medium' else 'low' end as level from attempts",
    # ---- vectors
    "vec_neg_inner_product": "select a.vec_id as a, b.vec_id as b, -@DOT(a.embedding, b.embedding) as distance from embeddings a join embeddings b on a.vec_id < b.vec_id",
    "vec_l2": "select a.vec_id as a, b.vec_id as b, @L2(a.embedding, b.embedding) as distance from embeddings a join embeddings b on a.vec_id < b.vec_id",
    "vec_unit": "select vec_id, sqrt(@DOT(embedding, embedding)) as norm, cast(@AT(embedding, 1) as double) / sqrt(@DOT(embedding, embedding)) as first_unit from embeddings",
    "vec_centroid": "select label, i, avg(cast(@AT(embedding, cast(i as int)) as double)) as mean from (select label, embedding, @EXPLODE(@RANGE(1, 64, 1)) as i from embeddings) x group by label, i",
    # mean similarity to the unit centroid is the length of the mean of unit vectors
    "vec_cohesion_spread": "select c.category, c.cohesion, coalesce(1 - p.least, cast(0 as double)) as spread from (select category, sqrt(sum(m * m)) as cohesion from (select category, pos, avg(@AT(unit, cast(pos as int))) as m from (select category, unit, @EXPLODE(@RANGE(cast(1 as bigint), @SIZE(unit), cast(1 as bigint))) as pos from (select category, @MAP(embedding, v -> cast(v as double) / norm) as unit from (select category, embedding, sqrt(@DOT(embedding, embedding)) as norm from ledger) n) u) e group by category, pos) g group by category) c left join (select a.category, min(@DOT(a.embedding, b.embedding) / sqrt(@DOT(a.embedding, a.embedding) * @DOT(b.embedding, b.embedding))) as least from ledger a join ledger b on a.category = b.category and a.id < b.id group by a.category) p on p.category = c.category",
    "vec_final_score": "select c.id as chunk_id, t.id as topic_id, @DOT(c.embedding, t.embedding) + case when coalesce(c.section, '') = coalesce(t.source_section, '') then 0.20 else 0 end + 0.05 * @SIZE(@FILTER(@SPLIT(t.topic, ' '), w -> length(w) > 4 and contains(c.chunk_text, w))) as score from vchunks c join vtopics t on t.project_id = c.project_id",
    # ---- arrays, maps, JSON, casts
    "arr_slice_windows": "select doc_id, pos, @SUBSTR(clean, cast(pos * 1000 + 1 as int), 1200) as win from (select doc_id, clean, @EXPLODE(@RANGE(cast(0 as bigint), cast(@INTDIV(greatest(length(clean), 1) - 1, 1000) as bigint), cast(1 as bigint))) as pos from doc_text) x where length(clean) > 0",
    "arr_unique_sorted": "select category, @JOIN(@SORTED(@COLLECTSET(trim(topic))), ',') as topics from topics group by category",
    "arr_ordered_distinct": "select category, @LISTAGG(topic, ',', first_id) as topics from (select category, topic, min(id) as first_id from topics group by category, topic) x group by category",
    "arr_issubset": f"select a.raw as a, b.raw as b, @SIZE(@BOTH(a.tokens, b.tokens)) = @SIZE(a.tokens) as inside from {_TOKENS} a join {_TOKENS} b on a.raw < b.raw",
    "map_survey_weight": "select id, topic, case id % 4 when 0 then 0.95 when 1 then 1.10 when 2 then 1.20 else 1.0 end as weight from topics",
    "map_merge": "select coalesce(n.user_id, o.user_id) as user_id, coalesce(n.v, o.v) as v from (select user_id, max(value) as v from events where event_type = 'click' group by user_id) n full outer join (select user_id, min(value) as v from events where event_type = 'view' group by user_id) o on o.user_id = n.user_id",
    "jsn_extract": "select event_id, cast(@JSON(props, '$.k') as bigint) as k from events",
    "jsn_parse_or_passthrough": "select event_id, coalesce(@JSON(case when event_id % 5 = 0 then null else props end, '$.k'), 'none') as k from events",
    "jsn_build": "select event_id, @OBJECT('type', event_type, 'user', user_id) as doc from events",
    "cst_safe_int": "select event_id, coalesce(@TRYINT(v), 0) as n from (select event_id, case event_id % 6 when 0 then cast(user_id as varchar(20)) when 1 then '-' || cast(event_id as varchar(20)) when 2 then cast(user_id as varchar(20)) || '.5' when 3 then event_type when 4 then '' end as v from events) x",
}
