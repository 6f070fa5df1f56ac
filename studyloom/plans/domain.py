"""Composite operators: chunking, roles, topic assignment, retrieval, taxonomy and question rules."""

from __future__ import annotations

from .scalar import any_of, hits, listed, one_of, squash

# fixed values: what the roles of a chunk are told by
INSTITUTIONS = ("university", "universita", "universite", "universidad", "hochschule", "faculty", "facolta", "department", "dipartimento", "institut", "school of")
PERSONS = ("professor", "prof.", "prof ", "docente", "instructor", "lecturer", "teacher")
CONTACTS = ("e-mail", "email", "@", "tel.", "telefono", "phone", "office", "ufficio", "stanza", "website", "www.", "http://", "https://")
BIBLIOGRAPHY = ("bibliography", "bibliografia", "references", "riferimenti bibliografici", "recommended books", "recommended reading", "further reading", "textbooks", "testi consigliati", "libri consigliati", "letture consigliate", "ouvrages recommandes", "literaturverzeichnis", "empfohlene literatur", "referencias bibliograficas", "bibliografia recomendada")
PUBLISHING = ("oxford press", "cambridge press", "springer", "elsevier", "wiley", "zanichelli", "isbn", "edition", "edizione", "editore")
ADMINISTRATIVE = ("exam information", "exam format", "assessment method", "grading", "grade distribution", "modalita di esame", "modalita d'esame", "prova scritta", "prova orale", "office hours", "orario di ricevimento", "course credits", "crediti formativi", "ects", "attendance", "frequenza obbligatoria", "course schedule", "lesson schedule", "calendario del corso", "calendario delle lezioni")
OUTLINE = ("course objectives", "learning objectives", "learning outcomes", "course outline", "course syllabus", "syllabus", "course contents", "contents of the course", "topics covered", "course structure", "obiettivi formativi", "obiettivi del corso", "risultati di apprendimento", "programma del corso", "contenuti del corso", "struttura del corso", "programme du cours", "objectifs du cours", "lernziele", "kursinhalte", "programa del curso", "objetivos del curso")
INTRO = ("introduction", "introduzione", "overview", "panoramica", "background", "why study", "perche studiare", "is a discipline", "e una disciplina", "si definisce come", "can be defined as", "in this chapter", "in questo capitolo", "this chapter introduces", "questo capitolo introduce", "motivational example", "esempio motivazionale", "wikipedia")
MOTIVATION = ("why ", "perche ", "real-world application", "real world application", "applicazione", "applications", "one of the most", "uno dei", "is the key to", "is the secret", "e il segreto", "conversion of energy", "conversione dell'energia")
ROLES = ("teaching", "intro", "outline", "bibliography", "administrative", "cover")

ROLE_CASES = (
    ("University of X, Department of Law. Prof. Rossi, email: rossi@x.it, www.x.it", 1, "Law"),
    ("Course objectives: understand contracts and property", 2, "Law"),
    ("Recommended books: A. Smith. Exam information follows", 3, "Law"),
    ("Grading is based on attendance; office hours on Monday", 5, "Law"),
    ("Introduction: what this discipline studies", 8, "Law"),
    ("Why do bridges stand? One of the most asked questions", 6, "Statics"),
    ("Why do bridges stand? One of the most asked questions", 16, "Statics"),
    ("The cell membrane separates the inside from the outside", 12, "Biology"),
    ("Springer edition of the lecture notes, second edition, isbn 12", 2, "Notes"),
)


def role(text: str, page: str, title: str) -> str:
    early = f"({page} is not null and {page} <= 3)"
    cover = f"{hits(text, CONTACTS)} >= 2 or ({hits(text, INSTITUTIONS)} >= 1 and {hits(text, CONTACTS)} >= 1 and ({hits(text, PERSONS)} >= 1 or ({title} <> '' and contains({text}, {title}))))"
    return (
        f"case when {early} and ({cover}) then 'cover'"
        f" when {any_of(text, BIBLIOGRAPHY)} or ({early} and {hits(text, PUBLISHING)} >= 2) then 'bibliography'"
        f" when {any_of(text, ADMINISTRATIVE)} then 'administrative' when {any_of(text, OUTLINE)} then 'outline' when {any_of(text, INTRO)} then 'intro'"
        f" when {page} is not null and {page} <= 10 and length({text}) <= 400 and {any_of(text, MOTIVATION)} then 'intro' else 'teaching' end"
    )


def _literal(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _cases(rows: tuple[tuple, ...], names: tuple[str, ...]) -> str:
    return "(" + " union all ".join("select " + ", ".join(f"{_literal(v)} as {n}" for v, n in zip(r, names, strict=True)) for r in rows) + ")"


_ROLE_ROWS = "(select id, lower(chunk_text) as t, page, lower(doc_title) as title from chunks union all select -1 - row_number() over (order by body, page) as id, lower(body) as t, page, lower(title) as title from " + _cases(ROLE_CASES, ("body", "page", "title")) + " k)"

# fixed values: limits of the assignment and of the merging of categories
LINK_SCORE, RESCUE_SCORE, LINKS = 0.54, 0.46, 3
_SCORE = "@DOT(c.embedding, t.embedding) + case when coalesce(c.section, '') = coalesce(t.source_section, '') then 0.20 else 0 end + 0.05 * @SIZE(@FILTER(@SPLIT(t.topic, ' '), w -> length(w) > 4 and contains(c.chunk_text, w)))"
PAIRS = f"(select c.id as chunk_id, t.id as topic_id, c.project_id, {_SCORE} as score from vchunks c join vtopics t on t.project_id = c.project_id where c.teaching)"


def phase_a(least: float) -> str:
    return f"(select chunk_id, topic_id, score from (select *, row_number() over (partition by chunk_id order by score desc, cast(topic_id as varchar(20))) as rn from {PAIRS} p where score >= {least}) a where rn <= {LINKS})"


def rescue(least_a: float, least_b: float) -> str:
    return f"(select chunk_id, topic_id, score from (select p.*, row_number() over (partition by topic_id order by score desc, chunk_id) as rn from {PAIRS} p where not exists (select 1 from {phase_a(least_a)} l where l.topic_id = p.topic_id)) b where rn = 1 and score >= {least_b})"


def assigned(a: float, b: float) -> str:
    return f"(select chunk_id, topic_id, score from {phase_a(a)} x union all select chunk_id, topic_id, score from {rescue(a, b)} y)"


# fixed values: openings that ask for recall, words that relate two things, connectors, least lengths; signs of a scenario, of
# a plain question and of a cause
RECALL = ("what is ", "what does ", "which statement is true", "which statement is false", "which of the following is true", "which of the following is false", "which mutation ", "which mechanism causes", "which mechanism is", "which process ", "which enzyme ", "which molecule ", "che cos'è ", "che cosa è ", "quale affermazione è vera", "quale affermazione è falsa", "quale affermazione è corretta", "quale affermazione non è corretta", "quale mutazione ", "quale meccanismo causa", "quale meccanismo è", "quale processo ", "quale enzima ", "quale molecola ")
RELATIONAL = ("although", "both ", "by combining", "compare", "compared to", "compared with", "comparison", "considering", "contrast", "contrasted", "contrasting", "distinct", "distinction", "difference", "different", "differ ", "differ from", "differentiate", "distinguish", "except", "exception", "given that", "however", "if both", "in contrast", "integrate", "integrating", "integration", "relate", "relation between", "relationship", "relationship between", "synthesize", "synthesizes", "synthesized", "synthesizing", "synthesis", "unless", "unlike", "whereas", "while", "a differenza", "combinando", "comparando", "confrontando", "considerando", "contrasto", "distinto", "distinzione", "differire", "differisce", "differiscono", "differenza", "distinguere", "eccezione", "eccetto", "entrambi", "integrare", "integrando", "integrazione", "mentre", "mettendo in relazione", "rapporto tra", "relazionare", "relazione tra", "rispetto a", "se entrambi", "sintetizzare", "sintetizza", "sintetizzando", "sintesi", "salvo che", "a meno che", "tuttavia")
CONNECTORS = ("because", "since", "therefore", "thus", "consequently", "hence", "thereby", "whereas", "while", "which means", "which explains", "as a result", "in contrast", "unlike", "poiché", "perché", "dato che", "dal momento che", "quindi", "pertanto", "dunque", "di conseguenza", "ne consegue", "in tal modo", "mentre", "ciò significa", "ciò spiega", "a differenza", "invece")
STEM_WORDS, EXPLANATION_WORDS = 14, 16
SCENARIO = ("during", "after", "when", "following", "in response", "as a result", "because", "while", "despite", "under", "increased", "decreased", "reduced", "elevated", "shift", "adaptation", "response")
PLAIN = ("what is", "which enzyme", "which molecule", "what role", "what is the main", "what is the primary", "which process", "which pathway", "what function")
CAUSAL = ("because", "therefore", "leading to", "resulting in", "causing", "due to", "consequence")

OPENINGS = ("What is", "Which mechanism is", "Che cos'è", "Considering both", "After the shift,", "Why does", "Which enzyme", "What is the difference between")
ENDINGS = ("This holds because", "", "Ne consegue", "It follows")
_QUESTIONS = f"(select q.conv_id, q.turn, {squash(one_of(OPENINGS, 'q.conv_id + q.turn') + " || ' ' || coalesce(q.text, '')")} as question, {squash("coalesce(" + one_of(ENDINGS, 'q.conv_id') + " || ' ' || e.text, '')")} as explanation from conversations q left join conversations e on e.conv_id = q.conv_id and e.turn = q.turn + 1 where q.role = 'user')"


def says(text: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join("contains(" + text + ", '" + w.replace("'", "''") + "')" for w in words) + ")"


def starts(text: str, openings: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"left({text}, {len(o)}) = '" + o.replace("'", "''") + "'" for o in openings) + ")"


_WORDS = "@SIZE(@SPLIT(trim(%s), ' '))"

PLANS: dict[str, str] = {
    "dom_chunk_clean_window": "select doc_id, pos, trim(chunk_text) as chunk from chunks where length(chunk_text) > 100",
    "dom_chunk_fixed": "select doc_id, pos, @SUBSTR(clean, cast(pos * 1000 + 1 as int), 1200) as chunk from (select doc_id, clean, @EXPLODE(@RANGE(cast(0 as bigint), cast(@INTDIV(greatest(length(clean), 1) - 1, 1000) as bigint), cast(1 as bigint))) as pos from doc_text) x",
    "dom_chunk_role": f"select id, {role('t', 'page', 'title')} as role from {_ROLE_ROWS} r",
    "dom_role_resolve": f"select id, case when stored in ({listed(ROLES)}) then stored else {role('t', 'page', 'title')} end as role, case when stored in ({listed(ROLES)}) then stored else {role('t', 'page', 'title')} end = 'teaching' as eligible from (select *, case when id % 3 = 0 then 'outline' when id % 3 = 1 then 'odd' end as stored from {_ROLE_ROWS} r) x",
    "dom_vector_search": "select c.id as chunk_id, c.section, @L2(c.embedding, t.embedding) as distance from vchunks c cross join (select embedding from vtopics where id = 11) t order by distance, chunk_id limit 12",
    "dom_chat_query": "select conv_id, @LISTAGG(text, ' ', turn) as query from (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) as rn from conversations where role = 'user') x where rn <= 2 group by conv_id",
    "dom_rebalance_taxonomy": "select t.id, case when n.n >= 2 then t.category else s.strongest end as category from (select id, case when id % 40 = 7 then 'lone ' || cast(id as varchar(20)) else category end as category from topics) t join (select category, count(*) as n from (select case when id % 40 = 7 then 'lone ' || cast(id as varchar(20)) else category end as category from topics) u group by category) n on n.category = t.category cross join (select category as strongest from (select category, count(*) as n from (select case when id % 40 = 7 then 'lone ' || cast(id as varchar(20)) else category end as category from topics) v group by category) w order by n desc, category limit 1) s",
    "dom_audit_reorg": "select coalesce(e.id, a.id) as id, a.id is null as missing, e.id is null as unknown, coalesce(a.n, 0) > 1 as duplicate, a.targets from (select id from topics where project_id = 5) e full outer join (select id % 300 as id, count(*) as n, count(distinct category) as targets from topics where project_id in (5, 6) group by id % 300) a on a.id = e.id",
    "dom_hard_reasoning": f"select conv_id, turn, recall and not relational as direct_recall_opening, stem < {STEM_WORDS} as stem_too_short_for_hard_reasoning, explained < {EXPLANATION_WORDS} as explanation_does_not_show_two_step_reasoning, not (recall and not relational) and stem >= {STEM_WORDS} and explained >= {EXPLANATION_WORDS} as valid, relational, connector and explained > 0 as connector_present, explained as explanation_words from (select conv_id, turn, {starts('lower(question)', RECALL)} as recall, {says('lower(question)', RELATIONAL)} as relational, {says('lower(explanation)', CONNECTORS)} as connector, {_WORDS % 'question'} as stem, case when explanation = '' then 0 else {_WORDS % 'explanation'} end as explained from {_QUESTIONS} q) x",
    "dom_reasoning_score": f"select conv_id, turn, 3 * case when {says('lower(question)', SCENARIO)} then 1 else 0 end + 2 * case when {says('lower(question)', CAUSAL)} then 1 else 0 end + case when {_WORDS % 'question'} > 18 then 1 else 0 end - 5 * case when {says('lower(question)', PLAIN)} then 1 else 0 end as score from {_QUESTIONS} q",
    "dom_question_topic": "select quiz_id, case when n_topics = 1 then top_topic when 2 * top_n > total then top_topic else first_topic end as topic from (select quiz_id, count(*) as n_topics, cast(sum(n) as bigint) as total, max(n) as top_n, max_by(topic, n * 1000 - first_order) as top_topic, max_by(topic, -first_order) as first_topic from (select quiz_id, topic, count(*) as n, min(question_order) as first_order from quiz_answers group by quiz_id, topic) x group by quiz_id) y where 2 * top_n > total or n_topics = 1",
    "dom_quiz_assembly": "select project_id, id, rn from (select project_id, id, row_number() over (partition by project_id order by id) as rn from (select project_id, id, row_number() over (partition by project_id, category order by id) as dup from topics) x where dup = 1) y where rn <= 10",
    "dom_flashcard_filter": "select id, topic from (select f.id, f.topic, row_number() over (partition by lower(f.topic) order by f.id) as rn from flashcards f where f.id in (select flashcard_id from reviews where is_correct)) x where rn = 1 order by id limit 40",
    "dom_expand_topics": "select r.v as requested, coalesce(t.id, -1) as topic_id, coalesce(t.topic, r.v) as topic from @LITERALS('small ring', 'RED WIDGET', 'unknown topic') r left join (select lower(topic) as k, min(id) as id, min(topic) as topic from topics group by lower(topic)) t on t.k = replace(lower(r.v), 'actions', 'action')",
    "dom_recovery_context": "select id, substring(chunk_text, 1, 300) as context from (select id, chunk_text, row_number() over (order by (id * 7919) % 10007, id) as rn from vchunks where teaching and project_id = 2) x where rn <= 5",
    "dom_recall_context": "select id, rn, 'SOURCE: ' || section || ' TOPIC: ' || topic as block from (select c.id, c.section, t.topic, row_number() over (order by @L2(c.embedding, t.embedding), c.id) as rn from vchunks c join vtopics t on t.project_id = c.project_id where t.id = 12) x where rn <= 12",
    "dom_project_results": "select p.id as project_id, coalesce(q.n, 0) as quizzes, q.average, coalesce(r.n, 0) as reviews, r.accuracy, coalesce(f.n, 0) as studied from projects p left join (select q.project_id, count(*) as n, avg(cast(t.score as double) / t.total_questions * 100) as average from quizzes q join attempts t on t.quiz_id = q.id group by q.project_id) q on q.project_id = p.id left join (select project_id, count(*) as n, 100.0 * cast(count(*) filter (where is_correct) as double) / count(*) as accuracy from reviews group by project_id) r on r.project_id = p.id left join (select project_id, count(*) filter (where last_review is not null) as n from flashcards group by project_id) f on f.project_id = p.id",
    "dom_language_gate": "select lang, cast(n as double) / total as confidence, cast(n as double) / total >= 0.80 as enforced from (select source, lang, count(*) as n, sum(count(*)) over (partition by source) as total from documents group by source, lang) x where source = 'src3'",
    "stm_dedup_chunks": "select distinct topic_id, chunk_id from (select t.id as topic_id, c.id as chunk_id from vtopics t join vchunks c on c.project_id = t.project_id where c.section = t.source_section union all select t.id, c.id from vtopics t join vchunks c on c.project_id = t.project_id where c.section = t.source_section) x",
    "stm_row_trigger": "select id, @SUBSTR(name, 1, 100) as name, length(name) <= 100 as valid from objects",
    "src_llm_json": "select event_id, cast(@JSON(replace(replace(v, '```json', ''), '```', ''), '$.k') as bigint) as k from (select event_id, '```json ' || props || '```' as v from events) x",
    # ---- object listing
    "obj_list_multipart": "select folder, id, name from (select split_part(name, '/', 1) as folder, id, name, row_number() over (partition by split_part(name, '/', 1) order by name, id) as rn from objects where bucket = 1) x where rn = 1",
}
