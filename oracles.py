"""The registered queries as ANSI SQL for DuckDB, over the same tables."""

from __future__ import annotations

from gleaner.operators.prompts import REFUSAL
from gleaner.sources.pages import ENTITIES, MARKDOWN_RULES

DIM = 64
SIZE, OVERLAP = 1000, 200
BLANKS = r"[\s\x1c-\x1f]"
SEP = r"E'\n\n---\n\n'"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def tokens(x: str) -> str:
    return (
        f"regexp_extract_all(strip_accents(regexp_replace(lower({x}), '[·•]', '', 'g')), "
        r"'[\p{L}\p{N}_]{2,}')"
    )


def norm(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def bucket(term: str) -> str:
    return f"CAST((('0x' || substr(md5({term}), 1, 8))::BIGINT % {DIM}) AS INT)"


def coverage(question: str, text: str) -> str:
    asked = f"list_distinct({tokens(question)})"
    return (
        f"CASE WHEN len({asked}) = 0 THEN 0.0 ELSE round(len(list_intersect({asked}, {tokens(text)})) "
        f"/ len({asked}), 6) END"
    )


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def unique(rows: str, key: str) -> str:
    """Vectors of a token table ``rows(key, term)`` as sparse unit rows."""
    return (
        f"SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM "
        f"(SELECT {key}, {bucket('term')} AS bucket, count(*) AS n FROM {rows} GROUP BY ALL)"
    )


# Documents as chunks, their terms and BM25 statistics.
CHUNKS = f"chunks AS (SELECT doc_id AS chunk_id, source, text, {tokens('text')} AS tok FROM documents)"
STATS = """occ AS (SELECT chunk_id, unnest(tok) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM occ GROUP BY ALL),
dl AS (SELECT chunk_id, source, len(tok) AS dl FROM chunks),
total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, total),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
ASKED = f"""qocc AS (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qocc GROUP BY ALL)"""


def scored(where: str = "") -> str:
    return f"""scored AS (
SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id), total {where} GROUP BY ALL)"""


def ranked(name: str, rows: str, k: int) -> str:
    return (
        f"{name} AS (SELECT query_id, chunk_id, score, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {rows} QUALIFY rank <= {k})"
    )


BM25 = ",\n".join([CHUNKS, STATS, ASKED, scored()])
HASHED = f"""cv AS ({unique('occ', 'chunk_id')}),
qv AS ({unique('qocc', 'query_id')}),
alike AS (SELECT query_id, chunk_id, round(sum(qv.w * cv.w), 6) AS score FROM qv JOIN cv USING (bucket) GROUP BY ALL)"""


def retrieval(n: str, queries: str) -> str:
    """Hybrid retrieval of ``queries(query_id, question, sources)``; every table carries suffix ``n``."""
    return f"""qocc{n} AS (SELECT query_id, unnest({tokens('question')}) AS term FROM {queries}),
qt{n} AS (SELECT query_id, term, count(*) AS qtf FROM qocc{n} GROUP BY ALL),
scored{n} AS MATERIALIZED (
SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM qt{n} JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id) JOIN {queries} USING (query_id), total
WHERE sources IS NULL OR list_contains(sources, source) GROUP BY ALL),
qv{n} AS ({unique(f'qocc{n}', 'query_id')}),
near{n} AS (SELECT query_id, chunk_id, sum(q.w * c.w) AS sim FROM qv{n} q JOIN cv c USING (bucket) GROUP BY ALL),
alike{n} AS MATERIALIZED (SELECT q.query_id, c.chunk_id, round(coalesce(sim, 0), 6) AS score
  FROM {queries} q CROSS JOIN dl c LEFT JOIN near{n} s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id
  WHERE c.dl > 0 AND (q.sources IS NULL OR list_contains(q.sources, c.source))
    AND q.query_id IN (SELECT query_id FROM qv{n})),
{ranked(f'lexical{n}', f'scored{n}', 20)},
{ranked(f'semantic{n}', f'alike{n}', 20)},
both_lists{n} AS (SELECT *, 1 AS is_vector FROM semantic{n} UNION ALL SELECT *, 0 FROM lexical{n}),
told{n} AS (SELECT b.*, c.source, c.text FROM both_lists{n} b JOIN chunks c USING (chunk_id)),
fused{n} AS (
SELECT query_id, text, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS rrf,
  coalesce(arg_max(chunk_id, rank) FILTER (is_vector = 1), arg_min(chunk_id, rank) FILTER (is_vector = 0)) AS chunk_id,
  min(rank) FILTER (is_vector = 1) AS vr, min(rank) FILTER (is_vector = 0) AS lr
FROM told{n} GROUP BY query_id, text),
placed{n} AS MATERIALIZED (SELECT f.query_id, f.text, f.rrf, f.chunk_id, c.source,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vr NULLS LAST, lr) AS position
FROM fused{n} f JOIN chunks c USING (chunk_id)),
capped{n} AS (SELECT p.*, question, row_number() OVER (PARTITION BY query_id, source ORDER BY position) AS nth
  FROM placed{n} p JOIN {queries} USING (query_id) QUALIFY nth <= CASE WHEN len(sources) > 0 THEN 10 ELSE 3 END),
diverse{n} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY position) AS position)
FROM capped{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 10),
pairs{n} AS (SELECT *, {coverage('question', 'text')} AS pair_score FROM diverse{n}),
best{n} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, position) AS rank
FROM pairs{n} QUALIFY rank <= 5)"""


CORPUS = ",\n".join([CHUNKS, STATS, f"cv AS MATERIALIZED ({unique('occ', 'chunk_id')})"])
QUESTIONS = "asked AS (SELECT item_id AS query_id, text AS question, NULL::VARCHAR[] AS sources FROM benchmark)"
HYBRID = ",\n".join([CORPUS, QUESTIONS, retrieval("", "asked")])
PASSAGES = ",\n".join([
    BM25, ranked("lexical", "scored", 5),
    """hits AS (SELECT l.query_id, l.rank, l.chunk_id, c.source, c.text, b.text AS question
FROM lexical l JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = l.query_id)""",
])
JUDGED = ",\n".join([
    PASSAGES,
    f"""judged AS (SELECT query_id AS id, any_value(question) AS reference,
  string_agg(text, {SEP} ORDER BY rank) AS context, arg_min(text, rank) AS answer,
  string_agg(text, {SEP} ORDER BY rank) FILTER (rank > 1) AS others FROM hits GROUP BY query_id)""",
])


def one_round(n: int) -> str:
    """Round ``n`` of the loop over ``open{n}``: pool, grade, next query, still open questions."""
    queries = f"search{n} AS (SELECT query_id, current_query AS question, sources FROM open{n})"
    known = f"SELECT p.*, 0 AS is_new FROM pool{n - 1} p WHERE query_id IN (SELECT query_id FROM open{n})" if n > 1 else None
    fresh = f"SELECT query_id, rank, chunk_id, text, 1 AS is_new FROM best{n} b"
    if known:
        fresh = (f"{known} UNION ALL {fresh} WHERE NOT EXISTS (SELECT 1 FROM pool{n - 1} p "
                 "WHERE p.query_id = b.query_id AND p.text = b.text)")
    missing = (
        f"list_filter({tokens('question')}, lambda x, i: list_position({tokens('question')}, x) = i "
        f"AND NOT list_contains({tokens('passages')}, x))"
    )
    return f"""{queries},
{retrieval(str(n), f'search{n}')},
merged{n} AS (SELECT m.*, o.question, row_number() OVER (PARTITION BY query_id ORDER BY is_new, rank) AS position,
  count(*) OVER (PARTITION BY query_id) AS size FROM ({fresh}) m JOIN open{n} o USING (query_id)),
ordered{n} AS (SELECT query_id, CASE WHEN size > 5 THEN row_number() OVER (PARTITION BY query_id
  ORDER BY {coverage('question', 'text')} DESC, position) ELSE position END AS place, chunk_id, text FROM merged{n}),
pool{n} AS MATERIALIZED (SELECT query_id, place AS rank, chunk_id, text FROM ordered{n} WHERE place <= 5),
ctx{n} AS (SELECT query_id, string_agg(text, {SEP} ORDER BY rank) AS passages, arg_min(text, rank) AS best_passage, count(*) AS n_passages FROM pool{n} GROUP BY query_id),
graded{n} AS (SELECT o.*, passages, best_passage, coalesce(n_passages, 0) AS n_passages,
  coalesce(n_passages, 0) > 0 AND {coverage('question', 'passages')} >= 0.8 AS sufficient,
  {stripped(f"'NON — ' || array_to_string({missing}, ' ')")} AS lacking FROM open{n} o LEFT JOIN ctx{n} USING (query_id)),
state{n} AS MATERIALIZED (SELECT *, CASE WHEN n_passages = 0 THEN 'NON — aucun extrait récupéré'
  WHEN sufficient THEN 'OUI' ELSE lacking END AS verdict FROM graded{n}),
open{n + 1} AS MATERIALIZED (SELECT query_id, question, sources,
  {stripped(r"regexp_replace(verdict, '^NON\s*—\s*', '')")} AS current_query, {n + 1} AS attempts FROM state{n} WHERE NOT sufficient)"""


ROUNDS = ",\n".join([
    CORPUS,
    """names AS (SELECT DISTINCT source AS name, lower(source) AS needle FROM documents WHERE source IS NOT NULL),
named AS (SELECT item_id, list(name ORDER BY name) AS found FROM benchmark JOIN names ON contains(lower(text), needle) GROUP BY item_id),
open1 AS (SELECT b.item_id AS query_id, text AS question, found AS sources, text AS current_query, 1 AS attempts
  FROM benchmark b LEFT JOIN named n ON n.item_id = b.item_id)""",
    *[one_round(n) for n in (1, 2, 3)],
    "finished AS (" + " UNION ALL ".join(
        f"SELECT query_id, current_query, sources, attempts, sufficient, verdict, passages, best_passage, n_passages FROM state{n}"
        + ("" if n == 3 else " WHERE sufficient") for n in (1, 2, 3)) + ")",
])


def statements(name: str, text: str) -> str:
    runs = (
        f"list_filter(list_transform(regexp_extract_all({text}, '[^.!?\\n]+'), lambda s: {stripped('s')}), "
        "lambda s: s <> '')"
    )
    return f"""{name} AS (SELECT * FROM (SELECT id, unnest(r) AS statement, generate_subscripts(r, 1) - 1 AS statement_no,
  reference, context, answer, others FROM (SELECT *, {runs} AS r FROM judged)) WHERE len({tokens('statement')}) > 0)"""


def verdict(statement: str, evidence: str) -> str:
    asked = f"list_distinct({tokens(statement)})"
    return f"CAST(len(list_intersect({asked}, {tokens(evidence)})) / len({asked}) >= 0.8 AS INT)"


def markdown(html: str) -> str:
    sql = html
    for pattern, replacement in MARKDOWN_RULES:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    for entity, char in ENTITIES:
        sql = f"replace({sql}, {quoted(entity)}, {quoted(char)})"
    return f"regexp_replace({sql}, '^[ \\n]+|[ \\n]+$', '', 'g')"


MARKDOWN = f"""md AS (SELECT * FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS source,
  CAST(page_id AS INT) AS page, {markdown('html')} AS text FROM pages) WHERE regexp_matches(text, '[^\\s]'))"""
HEAD = r"^[ \t]*(#{1,3})(?:[ \t]+([^\n]*))?(?:\n|$)"
SECTIONS = MARKDOWN + rf""",
ml AS (SELECT source, page, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM
  (SELECT source, page, string_split(text, E'\n') AS l FROM md)),
marked AS (SELECT *, CASE WHEN regexp_matches(line, '^[ \t]*#{{1,3}}([ \t]|$)')
  THEN length(regexp_extract(line, '{HEAD}', 1)) ELSE 0 END AS level FROM ml),
numbered AS (SELECT *, sum(CAST(level > 0 AS INT)) OVER (PARTITION BY source, page ORDER BY no) AS sec FROM marked),
grouped AS (SELECT source, page, sec, max(level) AS level,
  regexp_replace(string_agg(line, E'\n' ORDER BY no), '\n+$', '') AS body,
  {stripped(f"regexp_extract(arg_min(line, no), '{HEAD}', 2)")} AS title FROM numbered GROUP BY ALL),
filled AS (SELECT * FROM grouped WHERE regexp_matches(body, '[^\s]')),
newest AS (SELECT *,
  max(CASE WHEN level = 1 THEN sec END) OVER w AS s1, max(CASE WHEN level = 2 THEN sec END) OVER w AS s2,
  max(CASE WHEN level = 3 THEN sec END) OVER w AS s3
  FROM filled WINDOW w AS (PARTITION BY source, page ORDER BY sec)),
sections AS (SELECT n.source, n.page, row_number() OVER (PARTITION BY n.source, n.page ORDER BY n.sec) - 1 AS section_no,
  n.body, a.title AS h1, b.title AS h2, c.title AS h3 FROM newest n
  LEFT JOIN filled a ON a.source = n.source AND a.page = n.page AND a.sec = n.s1
  LEFT JOIN filled b ON b.source = n.source AND b.page = n.page AND b.sec = n.s2 AND n.s2 > coalesce(n.s1, -1)
  LEFT JOIN filled c ON c.source = n.source AND c.page = n.page AND c.sec = n.s3
    AND n.s3 > greatest(coalesce(n.s1, -1), coalesce(n.s2, -1)))"""

WINDOWS = f"""SELECT doc_id, start, substr(text, start, {SIZE}) AS text FROM
(SELECT doc_id, text, unnest(range(1, greatest(1, length(text) - {OVERLAP}) + 1, {SIZE - OVERLAP})) AS start FROM documents)
WHERE length({stripped(f'substr(text, start, {SIZE})')}) >= 30"""

MERGED = r"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) AS no, len(l) AS n FROM
  (SELECT doc_id, string_split(text, E'\n') AS l FROM documents)),
walk AS (SELECT doc_id, no, n, body AS held, length(body) >= 400 AS done FROM lines WHERE no = 1
  UNION ALL
  SELECT l.doc_id, l.no, l.n, CASE WHEN w.done THEN l.body ELSE w.held || E'\n\n' || l.body END,
    length(CASE WHEN w.done THEN l.body ELSE w.held || E'\n\n' || l.body END) >= 400
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.no = w.no + 1),
ready AS (SELECT doc_id, held, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS part_no,
  count(*) OVER (PARTITION BY doc_id) AS parts FROM walk WHERE done),
rest AS (SELECT doc_id, held FROM walk WHERE no = n AND NOT done)
SELECT r.doc_id, r.part_no, r.held || coalesce(E'\n\n' || t.held, '') AS body
FROM ready r LEFT JOIN rest t ON t.doc_id = r.doc_id AND r.part_no = r.parts - 1
UNION ALL SELECT doc_id, 0, held FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM ready)"""

NAV = r"""regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1),
  '(?i)<li\b[^>]*>', E'\n', 'g'), '(?i)</li>', ' . . . . 1', 'g'), '<[^>]*>', '', 'g')"""
CONTENTS = f"""WITH w AS (SELECT page_id, list_filter(list_transform(string_split({NAV} || E'\\n' || {markdown('html')}, E'\\n'),
  lambda s: trim(s)), lambda s: s <> '') AS l FROM pages)
SELECT page_id, len(l) > 0 AND len(list_filter(l, lambda s: contains(s, '. . .') OR contains(s, '...'))) / len(l) > 0.3
  AS is_contents FROM w"""


def nearest(filtered: bool) -> str:
    where = "WHERE c.label = q.label" if filtered else ""
    dot = "list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(c.v, c.v))"
    return ctes(
        "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)",
        "q AS (SELECT item_id AS query_id, label, v FROM benchmark JOIN e ON vec_id = item_id)",
        f"s AS (SELECT query_id, c.vec_id AS chunk_id, round({dot}, 6) AS score FROM q, e c {where})",
        ranked("r", "s", 20),
    ) + " SELECT query_id, chunk_id, rank, score FROM r"


GOLD = f"""gold AS (SELECT b.item_id AS query_id, c.chunk_id FROM benchmark b, chunks c
WHERE contains(' ' || array_to_string(c.tok, ' ') || ' ', ' ' || {norm('b.text')} || ' ') AND {norm('b.text')} <> '')"""

LABELLED = """s AS (SELECT lang AS niveau, quality::DOUBLE AS faithfulness,
  CASE WHEN toxic = 1 THEN NULL ELSE quality * 0.5::DOUBLE + 0.25 END AS answer_correctness
  FROM documents JOIN labels USING (doc_id))"""


def last_message(where: str = "") -> str:
    return f"SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS question FROM conversations {where} GROUP BY conv_id"


GRADE = "CASE WHEN role = 'assistant' THEN '  Oui. ' ELSE 'NON — ' END || text"
NUMBER = r"""list_filter(list_transform(string_split_regex(replace('Score ' || event_type || ' : ' ||
  replace(CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), '.', ','), ',', '.'), '\s+'),
  lambda w: CASE WHEN regexp_full_match(w, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(w AS DOUBLE) END),
  lambda x: x IS NOT NULL)[1]"""

POOL = ",\n".join([
    BM25, HASHED, ranked("o", "scored", 5), ranked("n", "alike", 5),
    "ot AS (SELECT o.*, c.text, 0 AS is_new FROM o JOIN chunks c USING (chunk_id))",
    """nt AS (SELECT n.*, c.text, 1 AS is_new FROM n JOIN chunks c USING (chunk_id)
WHERE NOT EXISTS (SELECT 1 FROM ot WHERE ot.query_id = n.query_id AND ot.text = c.text))""",
    f"""pool AS (SELECT p.query_id, p.chunk_id, {coverage('b.text', 'p.text')} AS pair_score,
  row_number() OVER (PARTITION BY query_id ORDER BY is_new, rank) AS position, count(*) OVER (PARTITION BY query_id) AS size
  FROM (SELECT * FROM ot UNION ALL SELECT * FROM nt) p JOIN benchmark b ON b.item_id = p.query_id)""",
    """kept AS (SELECT query_id, chunk_id, CASE WHEN size > 5 THEN row_number() OVER
  (PARTITION BY query_id ORDER BY pair_score DESC, position) ELSE position END AS rank FROM pool)""",
])

RELEVANCY = f"""ref_tok AS (SELECT id, unnest({tokens('reference')}) AS term FROM judged),
st_tok AS (SELECT id || '/' || statement_no AS sid, unnest({tokens('statement')}) AS term FROM st),
rv AS ({unique('ref_tok', 'id')}),
sv AS (SELECT split_part(sid, '/', 1)::BIGINT AS id, sid, bucket, w FROM ({unique('st_tok', 'sid')})),
sims AS (SELECT a.id, a.sid, coalesce(sum(rv.w * a.w), 0) AS sim FROM sv a LEFT JOIN rv ON rv.id = a.id AND rv.bucket = a.bucket GROUP BY ALL)"""

CORRECT = ",\n".join([
    JUDGED, statements("sa", "answer"), statements("sr", "reference"),
    f"va AS (SELECT id, count(*) FILTER (v = 1) AS tp, count(*) FILTER (v = 0) AS fp FROM (SELECT id, {verdict('statement', 'reference')} AS v FROM sa) GROUP BY id)",
    f"vr AS (SELECT id, count(*) FILTER (v = 0) AS fn FROM (SELECT id, {verdict('statement', 'answer')} AS v FROM sr) GROUP BY id)",
    f"rt AS (SELECT id, unnest({tokens('reference')}) AS term FROM judged)",
    f"aw AS (SELECT id, unnest({tokens('answer')}) AS term FROM judged)",
    f"rv AS ({unique('rt', 'id')})", f"av AS ({unique('aw', 'id')})",
    "sim AS (SELECT id, sum(rv.w * av.w) AS sim FROM rv JOIN av USING (id, bucket) GROUP BY id)",
    """f AS (SELECT id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM va FULL JOIN vr USING (id))""",
])

# The five measures of a run; contexts carry their source line.
SCORES = ",\n".join([
    PASSAGES,
    f"""judged AS (SELECT query_id AS id, any_value(question) AS reference, arg_min(text, rank) AS answer,
  NULL AS others, string_agg('[Source : ' || source || E' — p.?]\\n' || text, {SEP} ORDER BY rank) AS context FROM hits GROUP BY query_id)""",
    statements("sa", "answer"), statements("sr", "reference"),
    f"""va AS MATERIALIZED (SELECT id, {verdict('statement', 'context')} AS c, {verdict('statement', 'reference')} AS r FROM sa)""",
    f"""vr AS MATERIALIZED (SELECT id, {verdict('statement', 'context')} AS c, {verdict('statement', 'answer')} AS a FROM sr)""",
    f"""vp AS (SELECT query_id AS id, rank, {verdict('question', "'[Source : ' || source || ' — p.?]' || chr(10) || text")} AS v FROM hits)""",
    "pp AS (SELECT *, sum(v) OVER (PARTITION BY id ORDER BY rank) / rank AS prec FROM vp)",
    "st AS (SELECT * FROM sa)",
    RELEVANCY,
    f"aw AS (SELECT id, unnest({tokens('answer')}) AS term FROM judged)", f"av AS ({unique('aw', 'id')})",
    "alike2 AS (SELECT id, sum(rv.w * av.w) AS sim FROM rv JOIN av USING (id, bucket) GROUP BY id)",
    """m1 AS (SELECT id, round(avg(c), 6) AS faithfulness, count(*) FILTER (r = 1) AS tp, count(*) FILTER (r = 0) AS fp FROM va GROUP BY id)""",
    "m2 AS (SELECT id, round(avg(c), 6) AS context_recall, count(*) FILTER (a = 0) AS fn FROM vr GROUP BY id)",
    "m3 AS (SELECT id, round(avg(sim), 6) AS answer_relevancy FROM sims GROUP BY id)",
    "m4 AS (SELECT id, CASE WHEN sum(v) = 0 THEN 0.0 ELSE round(sum(prec * v) / sum(v), 6) END AS context_precision FROM pp GROUP BY id)",
])

RESULTS = PASSAGES + r""",
built AS (SELECT query_id, rank, source, text, question, first_value(text) OVER (PARTITION BY query_id ORDER BY rank) AS reply FROM hits)"""


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
        "encoding_repair": "SELECT doc_id, strlen(text) <> length(text) AS was_broken, text AS repaired, text AS untouched FROM documents",
        "display_lines": r"SELECT doc_id, coalesce(source, '?') AS source, replace(substr(text, 1, 130), E'\n', ' ') AS line FROM documents",
        "page_markdown": ctes(MARKDOWN) + " SELECT source, page, text FROM md",
        "contents_pages": CONTENTS,
        "header_sections": ctes(SECTIONS) + " SELECT source, page, section_no, body, h1, h2, h3 FROM sections",
        "context_prefix": ctes(SECTIONS, """c AS (SELECT source, page, section_no, body,
  concat_ws(' > ', source, nullif(h1, ''), nullif(h2, ''), nullif(h3, '')) AS context_line FROM sections)""")
        + r" SELECT source, page, section_no, context_line, context_line || E'\n\n' || body AS text FROM c",
        "merge_small": MERGED,
        "chunk_windows": WINDOWS,
        "stream_windows": WINDOWS,
        "term_idf": ctes(CHUNKS, STATS) + " SELECT term, df, round(idf, 6) AS idf FROM idf",
        "bm25_top20": ctes(BM25, ranked("r", "scored", 20)) + " SELECT query_id, chunk_id, rank, score FROM r",
        "bm25_by_source": ctes(
            CHUNKS, STATS, ASKED, "own AS (SELECT doc_id AS query_id, source AS wanted FROM documents)",
            scored().replace("FROM qt JOIN", "FROM qt LEFT JOIN own USING (query_id) JOIN").replace(
                ", total  GROUP", ", total WHERE wanted IS NULL OR wanted = source GROUP"),
            """filled AS (SELECT b.item_id AS query_id, d.chunk_id, coalesce(s.score, 0) AS score FROM benchmark b
  LEFT JOIN own ON own.query_id = b.item_id JOIN dl d ON own.wanted IS NULL OR d.source = own.wanted
  LEFT JOIN scored s ON s.query_id = b.item_id AND s.chunk_id = d.chunk_id)""",
            ranked("r", "filled", 20),
        ) + " SELECT query_id, chunk_id, rank, score FROM r",
        "bm25_filled": ctes(CHUNKS, STATS, f"""asked AS (SELECT DISTINCT source AS query_id, source AS question, [source] AS sources FROM documents
  UNION ALL SELECT CAST(item_id AS VARCHAR), text, NULL FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('question')}) AS term FROM asked) GROUP BY ALL)""",
            scored().replace("FROM qt JOIN", "FROM qt JOIN asked USING (query_id) JOIN").replace(
                ", total  GROUP", ", total WHERE sources IS NULL OR list_contains(sources, source) GROUP"),
            """filled AS (SELECT a.query_id, d.chunk_id, coalesce(s.score, 0) AS score FROM asked a CROSS JOIN dl d
  LEFT JOIN scored s ON s.query_id = a.query_id AND s.chunk_id = d.chunk_id
  WHERE a.sources IS NULL OR list_contains(a.sources, d.source))""",
            ranked("r", "filled", 20)) + " SELECT query_id, chunk_id, rank, score FROM r",
        "bm25_bounded": ctes(BM25, ranked("r", "scored", 20)) + " SELECT query_id, chunk_id, rank, score FROM r",
        "corpus_grown": ctes(BM25, ranked("r", "scored", 20)) + " SELECT query_id, chunk_id, rank, score FROM r",
        "corpus_reopened": ctes(BM25, HASHED, ranked("r", "alike", 20)) + " SELECT query_id, chunk_id, rank, score FROM r",
        "vector_top20": nearest(False),
        "vector_pivoted": nearest(False),
        "vector_filtered": nearest(True),
        "hashed_vectors": ctes(CHUNKS, "occ AS (SELECT chunk_id, unnest(tok) AS term FROM chunks)")
        + f" SELECT chunk_id, bucket, round(w, 6) AS weight FROM ({unique('occ', 'chunk_id')})",
        "hashed_top20": ctes(BM25, HASHED, ranked("r", "alike", 20)) + " SELECT query_id, chunk_id, rank, score FROM r",
        "rrf_fusion": ctes(HYBRID) + " SELECT query_id, position, chunk_id, source, rrf, text FROM placed",
        "rrf_diverse_top10": ctes(HYBRID) + " SELECT query_id, position, chunk_id, source, rrf FROM diverse",
        "rerank_top5": ctes(HYBRID) + " SELECT query_id, rank, chunk_id, source, pair_score, text FROM best",
        "grounded_answers": ctes(HYBRID)
        + f" SELECT b.item_id AS query_id, coalesce(arg_min(x.text, x.rank), {quoted(REFUSAL)}) AS answer, count(x.rank) AS n_passages FROM benchmark b LEFT JOIN best x ON x.query_id = b.item_id GROUP BY b.item_id",
        "refused_answers": ctes(BM25, ranked("r", "scored", 5)) + f""" SELECT CAST(query_id AS VARCHAR) AS query_id,
  arg_min(text, rank) AS answer, count(*) AS n_passages FROM r JOIN chunks USING (chunk_id) GROUP BY query_id
UNION ALL SELECT DISTINCT source, {quoted(REFUSAL)}, 0 FROM documents""",
        "context_assembly": ctes(PASSAGES) + rf""" SELECT query_id,
  string_agg('Source : ' || coalesce(source, '?') || E'\n' || text, {SEP} ORDER BY rank) || E'\n\nQUESTION : ' || any_value(question) AS prompt,
  string_agg(text, {SEP} ORDER BY rank) AS passages, count(*) AS n_passages FROM hits GROUP BY query_id""",
        "chat_last_turn": last_message(),
        "chat_last_user": last_message("WHERE role = 'user'"),
        "chat_envelope": f"""SELECT conv_id, CAST(json_object('id', 'chatcmpl-gleaner', 'object', 'chat.completion', 'created', turn,
  'model', 'gleaner-agentic', 'choices', json_array(json_object('index', 0, 'message',
  json_object('role', 'assistant', 'content', question), 'finish_reason', 'stop'))) AS VARCHAR) AS body FROM ({last_message()})""",
        "source_replies": """WITH n AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL),
r AS (SELECT doc_id, lower('Voir ' || upper(source) || ' : ' || text) AS reply FROM documents)
SELECT doc_id, CASE WHEN NOT contains(any_value(reply), 'tous') THEN string_agg(name, ',' ORDER BY name) END AS sources
FROM r LEFT JOIN n ON contains(reply, lower(name)) GROUP BY doc_id""",
        "grade_replies": f"""SELECT conv_id, turn, turn <> 0 AND starts_with(lower({stripped(GRADE)}), 'oui') AS sufficient,
  CASE WHEN turn = 0 THEN 'NON — aucun extrait récupéré' ELSE {stripped(GRADE)} END AS verdict FROM conversations""",
        "judge_numbers": f"SELECT event_id, CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)) END AS score FROM (SELECT event_id, {NUMBER} AS x FROM events)",
        "pool_merge": ctes(POOL) + " SELECT query_id, rank, chunk_id, source FROM kept JOIN (SELECT chunk_id, source FROM chunks) USING (chunk_id) WHERE rank <= 5",
        "agent_rounds": ctes(ROUNDS)
        + f""" SELECT query_id, current_query, array_to_string(sources, ',') AS sources, attempts, sufficient, verdict,
  CASE WHEN n_passages = 0 THEN {quoted(REFUSAL)} ELSE best_passage END AS answer, n_passages FROM finished""",
        "pending_items": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "progress_counts": "SELECT count(*) AS total, count(*) FILTER (d) AS done, count(*) FILTER (NOT d) AS to_do FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS d FROM documents)",
        "ingest_resume": """SELECT doc_id, source, length(text) AS n_chars FROM documents d WHERE NOT EXISTS
(SELECT 1 FROM documents e JOIN labels l USING (doc_id) WHERE e.source = d.source AND e.text = d.text)""",
        "result_records": ctes(RESULTS) + """ SELECT CAST(query_id AS VARCHAR) AS id, question, reply AS reponse_llm, 1.3::DOUBLE AS duree_secondes,
  'sources=*; attempts=1; sufficient=true' AS logs, rank - 1 AS n, source, NULL::INT AS page, text AS content FROM built""",
        "store_scan": "SELECT doc_id AS chunk_id, source FROM documents",
        "source_listing": "SELECT DISTINCT source FROM documents",
        "planted_passages": ctes(CHUNKS, GOLD) + " SELECT query_id, chunk_id FROM gold",
        "recall_at_5": ctes(BM25, ranked("r", "scored", 5), GOLD)
        + " SELECT count(*) AS n_queries, round(avg(hit), 6) AS recall FROM (SELECT g.query_id, max(CAST(r.chunk_id IS NOT NULL AS INT)) AS hit FROM gold g LEFT JOIN r USING (query_id, chunk_id) GROUP BY g.query_id)",
        "eval_samples": ctes(PASSAGES) + r""" SELECT query_id AS id, question AS user_input, arg_min(text, rank) AS response,
  string_agg('[Source : ' || coalesce(source, '?') || E' — p.?]\n' || text, E'\n|\n' ORDER BY rank) AS contexts, question AS reference
  FROM hits WHERE regexp_matches(text, '[^\s]') GROUP BY query_id, question""",
        "claim_verdicts": ctes(JUDGED, statements("st", "answer"))
        + f" SELECT id, statement_no, statement, {verdict('statement', 'others')} AS verdict FROM st WHERE others IS NOT NULL",
        "faithfulness": ctes(JUDGED, statements("st", "answer"))
        + f" SELECT id, round(avg({verdict('statement', 'others')}), 6) AS faithfulness FROM st WHERE others IS NOT NULL GROUP BY id",
        "token_recall": ctes(JUDGED) + f" SELECT id, {coverage('reference', 'context')} AS token_recall FROM judged",
        "answer_relevancy": ctes(JUDGED, statements("st", "answer"), RELEVANCY)
        + " SELECT id, round(avg(sim), 6) AS answer_relevancy FROM sims GROUP BY id",
        "context_precision": ctes(BM25, ranked("r", "scored", 5), """v AS (SELECT query_id AS id, rank, coalesce(quality, 0) AS v FROM r LEFT JOIN labels ON doc_id = chunk_id),
p AS (SELECT *, sum(v) OVER (PARTITION BY id ORDER BY rank) / rank AS prec FROM v)""")
        + " SELECT id, CASE WHEN sum(v) = 0 THEN 0.0 ELSE round(sum(prec * v) / sum(v), 6) END AS context_precision FROM p GROUP BY id",
        "answer_correctness": ctes(CORRECT)
        + """ SELECT id, tp, fp, fn, round(0.75 * CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE tp / (tp + 0.5 * (fp + fn)) END
  + 0.25 * coalesce(sim, 0.0), 6) AS answer_correctness FROM f LEFT JOIN sim USING (id)""",
        "score_table": ctes(SCORES) + """ SELECT id, faithfulness, answer_relevancy, context_precision, context_recall,
  CASE WHEN tp IS NULL AND fn IS NULL THEN NULL ELSE round(0.75 * CASE WHEN coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0) = 0 THEN 0.0
    ELSE coalesce(tp, 0) / (coalesce(tp, 0) + 0.5 * (coalesce(fp, 0) + coalesce(fn, 0))) END + 0.25 * coalesce(sim, 0.0), 6) END AS answer_correctness
  FROM judged LEFT JOIN m1 USING (id) LEFT JOIN m2 USING (id) LEFT JOIN m3 USING (id) LEFT JOIN m4 USING (id) LEFT JOIN alike2 USING (id)""",
        "metric_report": ctes(LABELLED) + """ SELECT niveau, CAST(grouping(niveau) AS INT) AS is_total, count(*) AS n,
  round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_correctness), 6) AS answer_correctness,
  repeat('█', CAST(floor(round(avg(faithfulness), 6) * 20) AS INT)) AS bar FROM s GROUP BY ROLLUP (niveau)""",
        "score_metadata": """SELECT d.doc_id AS id, n_chars, coalesce(CAST(quality AS VARCHAR), '') AS niveau,
  coalesce('s' || toxic, '') AS source, '' AS difficulte_rag FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        "scores_csv": """SELECT d.doc_id AS id, n_chars, coalesce(CAST(quality AS VARCHAR), '') AS niveau,
  coalesce('s' || toxic, '') AS source, '' AS difficulte_rag FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        "gold_profile": """SELECT lang, source, quality, CAST(grouping(lang, source, quality) AS INT) AS grouping, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source, quality)""",
        "refusal_rate": rf"""SELECT count(*) AS n, round(avg(CAST({stripped('a')} = {quoted(REFUSAL)} AS INT)), 6) AS refusal_rate FROM
(SELECT CASE WHEN quality = 0 THEN ' ' || {quoted(REFUSAL)} || E'\n' ELSE text END AS a FROM documents LEFT JOIN labels USING (doc_id))""",
    }
