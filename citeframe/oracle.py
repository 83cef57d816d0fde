"""DuckDB SQL for the queries of the catalog, composed from common table expressions."""

from __future__ import annotations

from citeframe.functions import constants as K


#: Questions and answers that the tables have none of.
LITERAL_QUESTIONS = [
    "What is the monthly rent for the flat?",
    "rent rent deposit",
    "define bcnf",
    "Who must pay the maintenance charges?",
    "What does ACID mean?",
    "When is the notice period over?",
    "How much is the security deposit?",
    "Summarise this document",
    "What topics are covered?",
    "explain this pdf",
    "list the sections",
    "can the tenant terminate the lease",
    "   ",
]
LITERAL_ANSWERS = [
    "The rent is Rs. 48,500. [S2] It is due monthly [1, 3]. See [S9].",
    "No markers here. Only text.",
    "Deposit of 2,91,000 [S1; S2] is kept [S1/2]. Repaint costs 22,000 [s3].",
    "Nothing",
]


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def _words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '\\S+')) AS INTEGER)"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def _idf(n: str, df: str) -> str:
    return f"greatest(ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)), 1e-6)"


LINE_LIST = "list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda t: trim(regexp_replace(replace(t, chr(173), ''), '[ \\t\\r\\n\\x{{00A0}}]+', ' ', 'g'))), lambda t: t <> '')"

BODY = "trim(regexp_replace(trim(text), '^(?:[0-9]+(?:\\.[0-9]+)*|[IVXLC]+)[.)]?\\s+', ''))"
CAPS = "(CASE WHEN length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g'))::DOUBLE / length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) ELSE 0.0 END)"

LINES = f"""
line_lists AS (SELECT doc_id, {LINE_LIST.format(x="text")} AS a FROM documents),
line_rows AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS text FROM line_lists),
lines AS (SELECT doc_id, CAST((i - 1) // 40 + 1 AS INTEGER) AS page_no, CAST((i - 1) % 40 + 1 AS INTEGER) AS line_no, text FROM line_rows)"""

HEADED = f"""
bodies AS (SELECT *, {BODY} AS body FROM lines),
headed AS (SELECT doc_id, page_no, line_no, text, length(trim(text)) BETWEEN 3 AND 120 AND length(body) BETWEEN 1 AND 90
  AND NOT (regexp_matches(body, '[.;,:]$') AND NOT (NOT regexp_matches(body, '\\p{{Ll}}') AND regexp_matches(body, '\\p{{Lu}}')))
  AND (regexp_matches(body, '(?i)^(?:{"|".join(K.HEADING_WORDS)})') OR {CAPS.format(x="body")} >= 0.6) AS heading FROM bodies)"""

#: The chunk fold as a recursion over the lines of all pages at once: e1 closes before a line, e2 at it, e3 at the page's end.
CHUNKS = f"""{LINES}, {HEADED},
cl AS (SELECT doc_id, page_no, line_no, trim(text) AS text, heading, {_words("text")} AS w, max(line_no) OVER (PARTITION BY doc_id, page_no) AS last_line,
  sum({_words("text")}) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS upto FROM headed),
fold AS (
  SELECT doc_id, page_no, line_no, last_line, CAST(NULL AS INTEGER) AS e1_start, CAST(NULL AS INTEGER) AS e1_end, CAST(NULL AS VARCHAR) AS e1_section,
    CASE WHEN w >= {K.CHUNK_WORDS} THEN 1 END AS e2_start, CASE WHEN w >= {K.CHUNK_WORDS} THEN 1 END AS e2_end,
    1 AS first, w AS words, CASE WHEN w >= {K.CHUNK_WORDS} THEN 0 ELSE 1 END AS fresh, CASE WHEN heading THEN text ELSE '' END AS section
  FROM cl WHERE line_no = 1
  UNION ALL
  SELECT doc_id, page_no, line_no, last_line, CASE WHEN closes AND fresh > 0 THEN first END, CASE WHEN closes AND fresh > 0 THEN line_no - 1 END, CASE WHEN closes AND fresh > 0 THEN section END,
    CASE WHEN total >= {K.CHUNK_WORDS} THEN begin_ END, CASE WHEN total >= {K.CHUNK_WORDS} THEN line_no END,
    CAST(CASE WHEN total >= {K.CHUNK_WORDS} THEN greatest(begin_, line_no - {K.OVERLAP_LINES} + 1) ELSE begin_ END AS INTEGER),
    CAST(CASE WHEN total >= {K.CHUNK_WORDS} THEN CASE WHEN greatest(begin_, line_no - {K.OVERLAP_LINES} + 1) = line_no THEN w ELSE w + before_w END ELSE total END AS INTEGER),
    CASE WHEN total >= {K.CHUNK_WORDS} THEN 0 ELSE (CASE WHEN closes THEN 0 ELSE fresh END) + 1 END,
    CASE WHEN heading THEN text ELSE section END
  FROM (
    SELECT c.doc_id, c.page_no, c.line_no, c.last_line, c.heading, c.text, c.w, f.first, f.fresh, f.section, b.w AS before_w, c.heading AND f.words >= {K.MIN_CHUNK_WORDS} AS closes,
      CASE WHEN c.heading AND f.words >= {K.MIN_CHUNK_WORDS} THEN c.line_no ELSE f.first END AS begin_,
      CASE WHEN c.heading AND f.words >= {K.MIN_CHUNK_WORDS} THEN 0 ELSE f.words END + c.w AS total
    FROM fold f JOIN cl c ON c.doc_id = f.doc_id AND c.page_no = f.page_no AND c.line_no = f.line_no + 1
    JOIN cl b ON b.doc_id = f.doc_id AND b.page_no = f.page_no AND b.line_no = f.line_no
  )
),
closed AS (
  SELECT doc_id, page_no, e1_start AS line_start, e1_end AS line_end, e1_section AS section FROM fold WHERE e1_start IS NOT NULL
  UNION ALL SELECT doc_id, page_no, e2_start, e2_end, section FROM fold WHERE e2_start IS NOT NULL
),
lastly AS (SELECT doc_id, page_no, max(line_end) AS last_end FROM closed GROUP BY ALL),
rest AS (
  SELECT f.doc_id, f.page_no, f.first, f.last_line, f.section, f.words < {K.MIN_CHUNK_WORDS} AND l.last_end IS NOT NULL AND l.last_end >= f.first - 1 AS joins, l.last_end
  FROM fold f LEFT JOIN lastly l ON l.doc_id = f.doc_id AND l.page_no = f.page_no WHERE f.line_no = f.last_line AND f.fresh > 0
),
spans AS (
  SELECT c.doc_id, c.page_no, c.line_start, CASE WHEN r.joins AND c.line_end = r.last_end THEN r.last_line ELSE c.line_end END AS line_end,
    CASE WHEN r.joins AND c.line_end = r.last_end AND c.section = '' THEN r.section ELSE c.section END AS section
  FROM closed c LEFT JOIN rest r ON r.doc_id = c.doc_id AND r.page_no = c.page_no
  UNION ALL SELECT doc_id, page_no, first, last_line, section FROM rest WHERE NOT joins
),
chunks AS (
  SELECT substr(sha256(doc_id || '␟' || page_no || '␟' || line_start || '␟' || line_end), 1, 12) AS chunk_id, doc_id, page_no, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, section,
    'p.' || page_no || CASE WHEN line_start = line_end THEN ' L' || line_start ELSE ' L' || line_start || '-' || line_end END AS locator
  FROM spans
)"""
CHUNK_TEXTS = """
chunk_texts AS (SELECT c.chunk_id, any_value(c.doc_id) AS doc_id, any_value(c.page_no) AS page_no, any_value(c.line_start) AS line_start, any_value(c.line_end) AS line_end, any_value(c.section) AS section, any_value(c.locator) AS locator, string_agg(l.text, ' ' ORDER BY l.line_no) AS text
  FROM chunks c JOIN lines l ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND l.line_no BETWEEN c.line_start AND c.line_end GROUP BY c.chunk_id)"""

QUESTIONS = """
questions AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 12), ' ') AS question FROM benchmark)"""

BM25 = f"""
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tok("question")}) AS term FROM questions) GROUP BY ALL),
sized AS (SELECT unit_id, {_tok("text")} AS toks FROM units),
totals AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM sized),
met AS (SELECT unit_id, len, term, count(*) AS tf FROM (SELECT unit_id, len(toks) AS len, unnest(toks) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM met GROUP BY term),
bm25_scored AS (SELECT query_id, unit_id, round(sum(times * {_idf("n", "df")} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 4) AS score
  FROM met JOIN asked USING (term) JOIN dfs USING (term), totals GROUP BY query_id, unit_id),
bm25 AS (SELECT * FROM (SELECT query_id, unit_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM bm25_scored WHERE score > 0) WHERE rank <= 20)"""


def _features(x: str) -> str:
    t = _tok(x)
    pairs = f"list_transform(range(1, len({t})), lambda i: {t}[i] || '_' || {t}[i + 1])"
    grams = f"flatten(list_transform(list_filter({t}, lambda t: length(t) >= 6), lambda t: list_transform(range(1, length(t) - 2), lambda i: '#' || substr(t, CAST(i AS BIGINT), 4))))"
    return f"list_concat(list_concat({t}, {pairs}), {grams})"


def _hashed(name: str, key: str, source: str, x: str) -> str:
    return f"""
{name}_t AS (SELECT {key}, {_tok(x)} AS t FROM {source}),
{name}_l AS (SELECT {key}, list_concat(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])), flatten(list_transform(list_filter(t, lambda s: length(s) >= 6), lambda s: list_transform(range(1, length(s) - 2), lambda i: '#' || substr(s, i, 4))))) AS f FROM {name}_t),
{name}_f AS (SELECT {key}, generate_subscripts(f, 1) AS pos, unnest(f) AS feature FROM {name}_l),
{name} AS (SELECT {key}, CAST(('0x' || substr(md5(feature), 1, 15))::BIGINT % {K.HASH_DIM} AS INTEGER) AS bucket, count(*) AS tf,
  arg_max(CASE WHEN substr(md5(feature), 16, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END, pos) AS sign FROM {name}_f GROUP BY ALL)"""


COSINE = f"""{_hashed("uh", "unit_id", "units", "text")}, {_hashed("qh", "query_id", "questions", "question")},
hn AS (SELECT greatest(count(*), 1) AS n FROM units),
hdf AS (SELECT b.bucket, coalesce(d.df, 0) AS df FROM (SELECT CAST(unnest(range(0, {K.HASH_DIM})) AS INTEGER) AS bucket) b LEFT JOIN (SELECT bucket, count(*) AS df FROM uh GROUP BY bucket) d USING (bucket)),
hidf AS (SELECT bucket, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM hdf, hn),
uw AS (SELECT unit_id, bucket, (1 + ln(tf)) * idf * sign AS w FROM uh JOIN hidf USING (bucket)),
uv AS (SELECT unit_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY unit_id)) AS w FROM uw),
qw AS (SELECT query_id, bucket, (1 + ln(tf)) * idf * sign AS w FROM qh JOIN hidf USING (bucket)),
qv AS (SELECT query_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw),
cos_scored AS (SELECT query_id, unit_id, round(sum(uv.w * qv.w), 4) AS score FROM uv JOIN qv USING (bucket) GROUP BY query_id, unit_id),
cosine AS (SELECT * FROM (SELECT query_id, unit_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM cos_scored) WHERE rank <= 20)"""

UNITS = "units AS (SELECT doc_id AS unit_id, text FROM documents)"
FUSED = """
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST, unit_id) AS INTEGER) AS rank FROM (
  SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.unit_id, x.unit_id) AS unit_id, d.score AS dense_score, d.rank AS dense_rank, x.score AS lexical_score, x.rank AS lexical_rank,
    round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 8) AS fused
  FROM cosine d FULL OUTER JOIN bm25 x ON d.query_id = x.query_id AND d.unit_id = x.unit_id))"""
RETRIEVED = f"{QUESTIONS}, {UNITS}, {BM25}, {COSINE}, {FUSED}"

_NOSTOP = f"list_filter({_tok('q.question')}, lambda t: t NOT IN {_in(K.RERANK_STOP)})"
RERANKED = f"""{RETRIEVED},
pool AS (SELECT f.query_id, f.unit_id, f.rank, f.dense_score, q.question, d.text, {_NOSTOP} AS q_terms, {_tok("d.text")} AS t_all
  FROM fused f JOIN questions q USING (query_id) JOIN documents d ON d.doc_id = f.unit_id WHERE f.rank <= 30),
qsets AS (SELECT DISTINCT query_id, unnest(q_terms) AS term FROM pool),
posx AS (SELECT query_id, unit_id, generate_subscripts(t_all, 1) AS at, unnest(t_all) AS term FROM pool),
hits AS (SELECT p.query_id, p.unit_id, p.at, p.term FROM posx p JOIN qsets s ON s.query_id = p.query_id AND s.term = p.term),
hit_terms AS (SELECT query_id, unit_id, term, count(*) AS tf FROM hits GROUP BY ALL),
pn AS (SELECT query_id, count(*) AS n FROM pool GROUP BY query_id),
tw AS (SELECT query_id, term, {_idf("n", "df")} AS w FROM (SELECT query_id, term, count(*) AS df FROM hit_terms GROUP BY ALL) JOIN pn USING (query_id)),
most AS (SELECT query_id, max(w) AS most FROM tw GROUP BY query_id),
q_tot AS (SELECT s.query_id, count(*) AS n_q, sum(coalesce(tw.w, most.most, 0)) AS total FROM qsets s LEFT JOIN tw ON tw.query_id = s.query_id AND tw.term = s.term LEFT JOIN most ON most.query_id = s.query_id GROUP BY s.query_id),
per AS (SELECT h.query_id, h.unit_id, count(*) AS n_hit, sum(tw.w) AS hit_w, sum(least(tf - 1, 3)) AS extra FROM hit_terms h JOIN tw ON tw.query_id = h.query_id AND tw.term = h.term GROUP BY ALL),
lasts AS (SELECT e.query_id, e.unit_id, e.at AS r, t.term, max(CASE WHEN e.term = t.term THEN e.at END) OVER (PARTITION BY e.query_id, e.unit_id, t.term ORDER BY e.at) AS seen
  FROM hits e JOIN hit_terms t ON t.query_id = e.query_id AND t.unit_id = e.unit_id),
win AS (SELECT query_id, unit_id, CAST(min(r - lo + 1) AS INTEGER) AS win FROM (SELECT query_id, unit_id, r, min(seen) AS lo, count(*) AS n_all, count(seen) AS n_seen FROM lasts GROUP BY ALL) WHERE n_all = n_seen GROUP BY ALL),
signals AS (
  SELECT p.query_id, p.unit_id, p.rank, p.question, p.text, p.dense_score, len(p.q_terms) AS n_terms, len(p.t_all) AS n_tok, coalesce(t.n_q, 0) AS n_q, coalesce(per.n_hit, 0) AS n_hit, coalesce(win.win, 1073741824) AS win,
    CASE WHEN coalesce(t.total, 0) > 0 THEN coalesce(per.hit_w, 0) / t.total ELSE 0 END AS coverage,
    least(coalesce(per.extra, 0) / (2.0::DOUBLE * greatest(coalesce(t.n_q, 0), 1)), 1.0) AS repetition,
    CASE {" ".join(f"WHEN len(q_terms) >= {n} AND len(list_filter(range(1, len(q_terms) - {n} + 2), lambda i: contains(array_to_string(t_all, ' '), array_to_string(list_slice(q_terms, i, i + {n - 1}), ' ')))) > 0 THEN {0.35 * n / 4}::DOUBLE" for n in (4, 3, 2))} ELSE 0.0::DOUBLE END AS phrase,
    0.85 + 0.15 * least(len(t_all) / 60.0::DOUBLE, 1.0) AS sufficiency
  FROM pool p LEFT JOIN q_tot t ON t.query_id = p.query_id LEFT JOIN per ON per.query_id = p.query_id AND per.unit_id = p.unit_id LEFT JOIN win ON win.query_id = p.query_id AND win.unit_id = p.unit_id
),
proxed AS (SELECT *, CASE WHEN n_hit = 0 THEN 0.0::DOUBLE WHEN n_hit = 1 THEN 1.0::DOUBLE / n_q ELSE n_hit / win::DOUBLE * (n_hit / n_q::DOUBLE) END AS proximity FROM signals),
scored AS (SELECT *, round(0.85 * CASE WHEN n_q = 0 OR n_tok = 0 THEN 0 ELSE (0.55 * coverage + 0.2 * proximity + 0.12 * repetition + phrase) * sufficiency END + 0.15 * greatest(coalesce(dense_score, 0), 0), 6) AS score FROM proxed),
reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, unit_id) AS INTEGER) AS rerank FROM scored),
sources AS (SELECT query_id, question, rerank AS position, unit_id AS doc_id, text, score FROM reranked WHERE rerank <= 5)"""


def _sentences(x: str) -> str:
    """The sentence list of an SQL expression."""
    clean = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    pieces = f"string_split(regexp_replace({clean}, '([.!?])[\"''\\)\\]]*\\s+', '\\1' || chr(1), 'g'), chr(1))"
    held = "(CASE WHEN s.open = '' THEN p.open ELSE s.open || ' ' || p.open END)"
    word = f"regexp_replace(lower(regexp_extract({held}, '([^\\s(\\[]*)\\.$', 1)), '^[.,;:\"'']+|[.,;:\"'']+$', '', 'g')"
    more = f"(ends_with({held}, '.') AND {word} <> '' AND ({word} IN {_in(K.ABBREVIATIONS)} OR regexp_matches({word}, '^\\p{{L}}$') OR regexp_matches({word}, '^[0-9]+$')))"
    none = "CAST([] AS VARCHAR[])"
    start = f"{{'done': {none}, 'open': ''}}"
    fold = f"list_reduce(list_prepend({start}, list_transform({pieces}, lambda t: {{'done': {none}, 'open': t}})), lambda s, p: CASE WHEN {more} THEN {{'done': s.done, 'open': {held}}} ELSE {{'done': list_append(s.done, {held}), 'open': ''}} END)"
    bullets = "(?:^|\\s)[•·‣▪●⁃∙\\-]\\s+"
    whole = f"list_transform([{fold}], lambda r: CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END)[1]"
    return f"list_filter(list_transform(flatten(list_transform({whole}, lambda t: string_split_regex(t, '{bullets}'))), lambda t: trim(t)), lambda t: length(t) >= 3)"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


SENTENCES = f"""
sent_lists AS (SELECT doc_id, {_sentences("text")} AS a FROM documents),
sents AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS sentence_no, unnest(a) AS sentence FROM sent_lists)"""

SCORED = f"""{RERANKED},
src_lists AS (SELECT query_id, question, position, {_sentences("text")} AS a FROM sources),
src_sents AS (SELECT query_id, question, position, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS sentence_no, unnest(a) AS sentence FROM src_lists),
src_terms AS (SELECT *, list_distinct(list_filter({_tok("question")}, lambda t: t NOT IN {_in(K.ANSWER_STOP)} AND length(t) > 1)) AS asked_t, list_distinct({_tok("sentence")}) AS terms,
  trim(regexp_replace(sentence, '{_sql(K.LEADING_NOISE)}', '')) AS probe FROM src_sents),
src_share AS (SELECT *, len(list_intersect(asked_t, terms)) AS n_common, len(list_intersect(asked_t, terms))::DOUBLE / greatest(len(asked_t), 1) AS direct FROM src_terms WHERE len(terms) > 0),
sent_scored AS (SELECT query_id, position, sentence_no, sentence, round(
  (0.55 * direct + 0.28 * n_common / sqrt(len(terms)) + 0.1::DOUBLE / position
   + CASE WHEN regexp_matches(lower(question), '{_sql(K.WANTS_VALUE)}') AND regexp_matches(sentence, '[0-9]') THEN 0.16 ELSE 0 END
   + CASE WHEN regexp_matches(lower(question), '{_sql(K.WANTS_PERSON)}') AND regexp_matches(sentence, '{_sql(K.OBLIGATION)}') THEN 0.1 ELSE 0 END)
  * CASE WHEN regexp_matches(probe, '{_sql(K.INSTRUCTION)}') THEN 0.35 ELSE 1 END
  * CASE WHEN regexp_matches(probe, '{_sql(K.INTERROGATIVE)}') OR regexp_matches(probe, '\\?\\s*$') THEN 0.55 ELSE 1 END
  * CASE WHEN regexp_matches(probe, '{_sql(K.ISSUE_MARKER)}') THEN 0.7 ELSE 1 END
  * CASE WHEN regexp_matches(sentence, '{_sql(K.EXAM_MARKS)}') THEN 0.65 ELSE 1 END
  * CASE WHEN {CAPS.format(x="sentence")} > 0.6 THEN 0.7 ELSE 1 END
  * CASE WHEN len(terms) < 5 THEN 0.85 ELSE 1 END, 6) AS score FROM src_share WHERE direct > 0 OR position = 1)"""

COMPOSED = f"""{SCORED},
cut AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM sent_scored) WHERE score >= 0.55 * best OR score = best),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substr(lower(sentence), 1, 90) ORDER BY score DESC, position, sentence_no) AS same FROM cut) WHERE same = 1),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position, sentence_no) AS place FROM once) WHERE place <= 4),
used AS (SELECT query_id, position, min(place) AS place FROM picked GROUP BY ALL),
composed AS (SELECT query_id, string_agg(regexp_replace(sentence, '\\.+$', '') || '. [S' || position || ']', ' ' ORDER BY place) AS answer FROM picked GROUP BY query_id)"""

GATE = f"""{RERANKED},
tops AS (SELECT query_id, count(*) AS n_sources, max(score) AS best_score, arg_min(text, position) AS top FROM sources GROUP BY query_id),
gate AS (SELECT q.query_id, coalesce(n_sources, 0) AS n_sources, coalesce(best_score, 0) AS best_score,
  n_sources IS NULL OR coalesce(best_score, 0) < {K.MIN_SCORE} OR (len(terms) > 0 AND len(list_intersect(terms, {_tok("top")})) = 0) AS refused
  FROM (SELECT query_id, list_filter({_tok("question")}, lambda t: t NOT IN {_in(K.ANSWER_STOP)} AND length(t) > 2) AS terms FROM questions) q LEFT JOIN tops t ON t.query_id = q.query_id),
gated AS (SELECT query_id, n_sources, best_score, refused, NOT refused AND best_score < {K.LOW_SCORE} AS weak_evidence FROM gate)"""

GOLD = f"""
gold AS (SELECT item_id, trim(substr({_norm("text")}, 1, 60)) AS phrase FROM benchmark),
norm_docs AS (SELECT {_norm("text")} AS t FROM documents),
gold_units AS (SELECT g.item_id, count(t) AS n_units FROM gold g LEFT JOIN norm_docs d ON g.phrase <> '' AND contains(d.t, g.phrase) GROUP BY g.item_id)"""
CASES = f"""{GATE}, {GOLD},
hit_rows AS (SELECT s.query_id, s.position, s.score, g.phrase <> '' AND contains({_norm("s.text")}, g.phrase) AS hit FROM sources s JOIN gold g ON g.item_id = s.query_id),
cases AS (SELECT u.item_id AS query_id, CASE WHEN u.n_units > 0 THEN 'in_corpus' ELSE 'out_of_corpus' END AS category, coalesce(h.r, CAST([] AS BOOLEAN[])) AS relevance, coalesce(h.best, 0) AS best_score, w.refused, w.weak_evidence AS flagged
  FROM gold_units u LEFT JOIN (SELECT query_id, list(hit ORDER BY position) AS r, max(score) AS best FROM hit_rows GROUP BY query_id) h ON h.query_id = u.item_id JOIN gated w ON w.query_id = u.item_id)"""

MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
TITLE = "trim(regexp_replace(trim(coalesce(first, '')), '\\s+', ' ', 'g'))"
SESSIONS = f"""{MESSAGES},
firsts AS (SELECT session_id, arg_min(content, CASE WHEN role = 'user' THEN seq END) FILTER (WHERE role = 'user') AS first, count(*) AS n_messages, max(seq) AS last_seq FROM messages GROUP BY session_id),
sessions AS (SELECT session_id, CASE WHEN {TITLE} = '' THEN 'New conversation' WHEN length({TITLE}) > 60 THEN rtrim(substr({TITLE}, 1, 60)) || '…' ELSE {TITLE} END AS title, n_messages, last_seq FROM firsts)"""

FACT_CASES = " ".join(f"WHEN length(trim(regexp_extract(sentence, '{_sql(p)}'))) >= 2 THEN '{k}'" for k, p in K.FACTS)
FACT_VALUES = " ".join(f"WHEN length(trim(regexp_extract(sentence, '{_sql(p)}'))) >= 2 THEN trim(regexp_extract(sentence, '{_sql(p)}'))" for k, p in K.FACTS)
FACTS = f"""{SENTENCES},
facts AS (SELECT * FROM (SELECT doc_id, sentence_no, sentence, CASE {FACT_CASES} END AS kind, CASE {FACT_VALUES} END AS answer FROM sents WHERE {_words("sentence")} >= 8) WHERE kind IS NOT NULL)"""
POOL = f"""
found AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, doc_id, generate_subscripts(regexp_extract_all(text, '{_sql(p)}'), 1) AS pos, trim(unnest(regexp_extract_all(text, '{_sql(p)}'))) AS value FROM documents" for k, p in K.FACTS)}),
pool AS (SELECT kind, value, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY kind, lower(value) ORDER BY doc_id, pos) AS n FROM found) WHERE n = 1)"""
DISTRACTORS = f"""{FACTS}, {POOL},
distractors AS (SELECT kind, answer, rank, value FROM (SELECT a.kind, a.answer, p.value, CAST(row_number() OVER (PARTITION BY a.kind, a.answer ORDER BY abs(length(p.value) - length(a.answer)), p.doc_id, p.pos, p.value) AS INTEGER) AS rank
  FROM (SELECT DISTINCT kind, answer FROM facts) a JOIN pool p ON p.kind = a.kind AND lower(p.value) <> lower(a.answer)) WHERE rank <= 3)"""

_CLEAN = "trim(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^[ \\-–—:.]+|[ \\-–—:.]+$', '', 'g'))"
_SHORT = "trim(regexp_replace({c}, '(?i)^(?:(?:SECTION|CLAUSE|UNIT|MODULE|CHAPTER|PART|ARTICLE|SCHEDULE|ANNEXURE)\\s+)?[A-Z0-9]+(?:\\.[0-9]+)*\\s*[-–—.)]\\s*', ''))"

KEY_TERMS = f"""
kt AS (SELECT doc_id, list_filter({_tok("text")}, lambda t: t NOT IN {_in(K.TOPIC_STOP + K.TOPIC_GENERIC)} AND length(t) > 3) AS t FROM documents),
kp AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM kt),
ks AS (SELECT doc_id, term, round(count(*) * (1 + ln(length(term))), 6) AS score, min(pos) AS first FROM kp GROUP BY doc_id, term),
key_terms AS (SELECT doc_id, rank, term, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM ks) WHERE rank <= 8)"""

SHORT = f"""{SENTENCES},
defined AS (SELECT doc_id, sentence_no, sentence, CASE {" ".join(f"WHEN regexp_matches(sentence, '{_sql(p)}') THEN '{form.split('{}')[0]}' || regexp_replace(trim(regexp_extract(sentence, '{_sql(p)}', 1)), ',+$', '') || '{form.split('{}')[1]}'" for p, form in K.DEFINITIONS)} END AS question FROM sents WHERE {_words("sentence")} >= 8),
asked_short AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_no) AS n FROM defined WHERE question IS NOT NULL)"""

_MEAN = "round(coalesce(avg(CASE WHEN {w} THEN {v} END), 0), 4)"
_INSIDE = "category <> 'out_of_corpus' AND len(relevance) > 0"
_HIT = "(CASE WHEN list_contains(list_slice(relevance, 1, {k}), true) THEN 1.0 ELSE 0.0 END)::DOUBLE"


def _once(x: str) -> str:
    """The list of column ``x`` without repetitions, in order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _name(x: str) -> str:
    """The readable name of a heading column; a chain of CTE columns would be longer."""
    clean = _CLEAN.format(x=x)
    short = _SHORT.format(c=clean)
    name = f"(CASE WHEN {short} <> '' THEN {short} ELSE {clean} END)"
    title = f"array_to_string(list_transform(string_split(lower({name}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    return f"CASE WHEN NOT regexp_matches({name}, '\\p{{Ll}}') AND regexp_matches({name}, '\\p{{Lu}}') THEN {title} ELSE {name} END"


def _values(texts: list[str], sign: int = 1) -> str:
    return ", ".join(f"({i if sign > 0 else -1 - i}, '{_sql(t)}')" for i, t in enumerate(texts))


_DECLARED = " ".join(f"WHEN regexp_matches(lower(base), '{_sql(p)}') THEN trim('{to.split('{}')[0]}' || regexp_extract(lower(base), '{_sql(p)}', 1) || '{to.split('{}')[1]}')" for p, to in K.DECLARATIVE)
VARIANTS = f"""
v_clean AS (SELECT query_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS c FROM v_in),
v_base AS (SELECT query_id, CASE WHEN trim(regexp_replace(c, '[?!.,;: ]+$', '')) <> '' THEN trim(regexp_replace(c, '[?!.,;: ]+$', '')) ELSE c END AS base FROM v_clean),
v_tok AS (SELECT query_id, base, {_tok("base")} AS t, list_filter({_tok("base")}, lambda t: t NOT IN {_in(K.QUERY_STOP + K.QUESTION_WORDS)} AND length(t) > 1) AS k FROM v_base),
synonyms(term, nth, synonym) AS (VALUES {", ".join(f"('{k}', {i}, '{w}')" for k, v in K.SYNONYMS.items() for i, w in enumerate(v))}),
v_syn AS (SELECT query_id, string_agg(synonym, ' ' ORDER BY p, nth) AS syn FROM (SELECT query_id, synonym, p, nth, row_number() OVER (PARTITION BY query_id, synonym ORDER BY p, nth) AS n
  FROM (SELECT query_id, generate_subscripts(t, 1) AS p, unnest(t) AS term FROM v_tok) JOIN synonyms USING (term)) WHERE n = 1 GROUP BY query_id),
v_forms AS (SELECT query_id, list_filter([base, array_to_string({_once("k")}, ' '), CASE {_DECLARED} ELSE '' END, CASE WHEN syn IS NOT NULL THEN base || ' ' || syn ELSE '' END], lambda x: x <> '') AS f FROM v_tok LEFT JOIN v_syn USING (query_id) WHERE base <> ''),
v_once AS (SELECT query_id, list_slice({_once("f")}, 1, {K.MAX_VARIANTS}) AS f FROM v_forms),
variants AS (SELECT query_id, CAST(generate_subscripts(f, 1) AS INTEGER) AS variant_no, unnest(f) AS text FROM v_once)"""

MERGED = f"""{QUESTIONS.replace("questions AS", "v_in0 AS")}, v_in AS (SELECT query_id, question AS text FROM v_in0), {VARIANTS},
questions AS (SELECT query_id * 10 + variant_no AS query_id, text AS question FROM variants), {UNITS}, {BM25}, {COSINE}, {FUSED},
merged AS (SELECT query_id // 10 AS query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS fused, max(dense_score) AS dense_score, arg_max(dense_rank, {{'s': dense_score, 'v': -(query_id % 10)}}) FILTER (WHERE dense_score IS NOT NULL) AS dense_rank,
  max(lexical_score) AS lexical_score, arg_max(lexical_rank, {{'s': lexical_score, 'v': -(query_id % 10)}}) FILTER (WHERE lexical_score IS NOT NULL) AS lexical_rank, min(query_id % 10 * 1000 + rank) AS first FROM fused GROUP BY query_id // 10, unit_id)"""

TOPICS = f"""{CHUNKS}, {CHUNK_TEXTS},
t_rows AS (SELECT doc_id, page_no, section, {_words("text")} AS words, max(CASE WHEN section <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS sectioned FROM chunk_texts),
t_names AS (SELECT doc_id, page_no, words, CASE WHEN sectioned = 0 THEN 'Pages ' || page_no WHEN section = '' THEN 'Introduction' ELSE {_name("section")} END AS name FROM t_rows),
t_groups AS (SELECT doc_id, name, min(page_no) AS page_start, max(page_no) AS page_end, count(*) AS n_chunks, sum(words) AS word_count FROM t_names GROUP BY doc_id, name),
t_rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_start, name) AS rn FROM t_groups),
t_isl AS (SELECT *, sum(CASE WHEN rn = 1 OR word_count >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS island FROM t_rn),
t_merged AS (SELECT doc_id, island, arg_min(name, rn) AS name, min(page_start) AS page_start, max(page_end) AS page_end, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, CAST(sum(word_count) AS BIGINT) AS word_count FROM t_isl GROUP BY doc_id, island HAVING sum(word_count) >= 12),
topics AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) AS INTEGER) AS topic_no, name, page_start, page_end, n_chunks, word_count, 'p.' || page_start || CASE WHEN page_start = page_end THEN '' ELSE '-' || page_end END AS label FROM t_merged)"""

_M = r"\[\s*[Ss]?\s*(\d+(?:\s*[,;/]\s*[Ss]?\s*\d+)*)\s*\]"
_G = r"(?:\[\s*[Ss]?\s*\d+(?:\s*[,;/]\s*[Ss]?\s*\d+)*\s*\]\s*)+"
_KEPT = "array_to_string(list_transform(list_filter(regexp_extract_all(g, '[0-9]+'), lambda n: n::INTEGER BETWEEN 1 AND 3), lambda n: '[S' || n::INTEGER || ']'), '')"
MARKERS = f"""SELECT id, array_to_string({_once("nums")}, ',') AS numbers, trim(regexp_replace(regexp_replace(text, '{_M}', '', 'g'), '\\s{{2,}}', ' ', 'g')) AS plain,
  rtrim(regexp_replace(regexp_replace(text, '([.!?])\\s*({_G})', ' \\2\\1 ', 'g'), '\\]\\s+([.!?])', ']\\1', 'g')) AS attached,
  trim(regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(st) + 1), lambda i: st[i] || coalesce(gs[i], '')), ''), '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g')) AS clean,
  array_to_string(list_filter({_once("nums")}, lambda n: n BETWEEN 1 AND 3), ',') AS valid
  FROM (SELECT id, text, string_split_regex(text, '{_M.replace("(", "(?:", 1)}') AS st, list_transform(regexp_extract_all(text, '{_M}', 1), lambda g: {_KEPT}) AS gs,
    list_transform(flatten(list_transform(regexp_extract_all(text, '{_M}', 1), lambda g: regexp_extract_all(g, '[0-9]+'))), lambda n: n::INTEGER) AS nums FROM (VALUES {_values(LITERAL_ANSWERS)}) v(id, text))"""

SQL: dict[str, str] = {
    "doc_lines": f"WITH {LINES} SELECT *, {_words('text')} AS words FROM lines",
    "doc_registry": f"""WITH {LINES}, d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha256 FROM documents), n AS (SELECT doc_id, CAST(len(a) AS INTEGER) AS n_lines FROM line_lists),
      f AS (SELECT sha256, min(doc_id) AS first_doc, count(*) AS copies FROM d GROUP BY sha256)
      SELECT doc_id, substr(sha256(source || '␟' || sha256), 1, 12) AS stable_id, sha256, n_lines, CAST(ceil(n_lines / 40.0) AS INTEGER) AS n_pages, doc_id <> first_doc AS skipped, copies FROM d JOIN f USING (sha256) JOIN n USING (doc_id)""",
    "doc_rejected": f"WITH {LINES} SELECT doc_id, 'no extractable text' AS error FROM line_lists WHERE len(a) = 0",
    "headings": f"WITH {LINES}, {HEADED} SELECT doc_id, page_no, line_no, text FROM headed WHERE heading",
    "caps_ratios": f"WITH {LINES} SELECT doc_id, page_no, line_no, round({CAPS.format(x='text')}, 6) AS caps FROM lines",
    "chunks": f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks",
    "chunk_lines": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, count(*) AS n_lines, CAST(sum({_words('l.text')}) AS BIGINT) AS n_words FROM chunks c JOIN lines l ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND l.line_no BETWEEN c.line_start AND c.line_end GROUP BY chunk_id",
    "html_lines": f"""WITH broken AS (SELECT page_id, trim(regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS section,
        regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|table|article|nav|title|head|header|footer|section)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
      plain AS (SELECT page_id, section, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM broken),
      l AS (SELECT page_id, section, {LINE_LIST.format(x="t")} AS a FROM plain)
      SELECT page_id, section, CAST(generate_subscripts(a, 1) AS INTEGER) AS line_no, unnest(a) AS text FROM l""",
    "reading_order": f"""WITH {LINES}, p AS (SELECT doc_id, page_no, line_no AS ord, line_no % 3 * 100.0 AS x0, (line_no // 3) * 12.0 + line_no % 2 AS y0 FROM lines)
      SELECT doc_id, page_no, ord, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y0 / 2.5, 0), x0, ord) AS INTEGER) AS line_no, CAST(count(*) OVER (PARTITION BY doc_id, page_no, round_even((y0 + 10.0) / 4.0, 0)) AS INTEGER) AS row_span FROM p""",
    "highlight_boxes": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, page_no, count(*) AS n_spans, min(12.0::DOUBLE * line_start) AS top, max(12.0::DOUBLE * line_end + 11.0) AS bottom FROM chunks GROUP BY doc_id, page_no",
    "sentences": f"WITH {SENTENCES} SELECT * FROM sents",
    "number_tokens": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*'), lambda n: regexp_replace(replace(n, ',', ''), '\\.+$', '')))), ',') AS numbers FROM documents",
    "body_texts": f"WITH RECURSIVE {CHUNKS}, {CHUNK_TEXTS} SELECT chunk_id, CAST(length(CASE WHEN section <> '' AND starts_with(text, section) THEN regexp_replace(substr(text, length(section) + 1), '^[ \\-–—:.]+', '') ELSE text END) AS INTEGER) AS body_chars, locator FROM chunk_texts",
    "tokens_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL",
    "term_df_idf": f"WITH t AS (SELECT DISTINCT doc_id, unnest({_tok('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT term, df, round({_idf('n', 'df')}, 6) AS idf FROM d, n",
    "index_stats": f"WITH {LINES} SELECT count(*) AS documents, CAST(sum(len(a)) AS BIGINT) AS lines, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 4) AS avg_len FROM (SELECT doc_id, len({_tok('text')}) AS n FROM documents) JOIN line_lists USING (doc_id)",
    "vocabulary": f"SELECT DISTINCT word FROM (SELECT unnest({_tok('text')}) AS word FROM documents) WHERE length(word) >= 4",
    "bm25_topk": f"WITH {QUESTIONS}, {UNITS}, {BM25} SELECT query_id, unit_id AS doc_id, score, rank FROM bm25",
    "answer_metrics": "SELECT round(coalesce(avg(CASE WHEN doc_id % 5 <> 0 THEN (quality = 1)::DOUBLE END), 0), 4) AS answer_accuracy, round(coalesce(avg(CASE WHEN doc_id % 5 <> 0 THEN (toxic = 0)::DOUBLE END), 0), 4) AS citation_precision_1, round(coalesce(avg(CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN (doc_id % 10) / 10.0::DOUBLE END), 0), 4) AS mean_groundedness FROM labels",
    "sessions_with_empty": "SELECT conv_id AS session_id, count(*) FILTER (role = 'system') AS n_messages, coalesce(max(turn) FILTER (role = 'system'), 0) AS last_seq FROM conversations GROUP BY conv_id",
    "citation_paths": "SELECT l.doc_id, coalesce(d.path, 'files/' || l.doc_id) AS path FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS path FROM documents WHERE lang = 'en' GROUP BY doc_id) d USING (doc_id)",
    "hash_features": f"WITH {UNITS}, {_hashed('uh', 'unit_id', 'units', 'text')} SELECT unit_id AS doc_id, bucket, tf, sign FROM uh",
    "hash_idf": f"WITH {QUESTIONS}, {UNITS}, {COSINE} SELECT bucket, df, round(idf, 6) AS idf FROM hidf",
    "hash_cosine_topk": f"WITH {QUESTIONS}, {UNITS}, {COSINE} SELECT query_id, unit_id AS doc_id, score, rank FROM cosine",
    "dense_topk": """SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 20""",
    "dense_precision": """WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id, q.label = e.label AS same, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 20)
      SELECT query_id, count(*) AS n, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 4) AS label_precision FROM top GROUP BY query_id""",
    "rrf_fusion": f"WITH {RETRIEVED} SELECT query_id, unit_id AS doc_id, dense_score, dense_rank, lexical_score, lexical_rank, fused, rank FROM fused",
    "doc_filter_semi": f"WITH {RETRIEVED}, k AS (SELECT query_id, unit_id AS doc_id, fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM fused WHERE unit_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) SELECT * FROM k WHERE rank <= 30",
    "rerank_lexical": f"WITH {RERANKED} SELECT query_id, unit_id AS doc_id, round(coverage, 6) AS coverage, round(proximity, 6) AS proximity, round(repetition, 6) AS repetition, round(phrase, 6) AS phrase, round(sufficiency, 6) AS sufficiency, CAST(win AS INTEGER) AS \"window\", score, rerank FROM reranked",
    "refusal_gate": f"WITH {GATE} SELECT * FROM gated",
    "sentence_scoring": f"WITH {SCORED} SELECT * FROM sent_scored",
    "extractive_answer": f"WITH {COMPOSED} SELECT c.query_id, c.answer, u.used FROM composed c JOIN (SELECT query_id, string_agg(CAST(position AS VARCHAR), ',' ORDER BY place) AS used FROM used GROUP BY query_id) u USING (query_id)",
    "citations": f"WITH {COMPOSED} SELECT s.query_id, 'S' || s.position AS marker, s.doc_id, CAST(length(s.text) AS INTEGER) AS quote_chars, round(CAST(s.score AS DECIMAL(18, 6)), 5)::DOUBLE AS retrieval_score, u.position IS NOT NULL AS used_in_answer FROM sources s LEFT JOIN used u ON u.query_id = s.query_id AND u.position = s.position",
    "overview": f"""WITH {RERANKED}, sl AS (SELECT query_id, position, text, {_sentences("text")} AS a FROM sources),
      ss AS (SELECT query_id, position, generate_subscripts(a, 1) AS i, unnest(a) AS s FROM sl),
      best AS (SELECT query_id, position, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, position ORDER BY {_words("s")} DESC, i) AS n FROM ss WHERE {_words("s")} >= 5) WHERE n = 1),
      l AS (SELECT x.query_id, x.position, '- page 1: ' || regexp_replace(trim(substr(coalesce(b.s, trim(x.text)), 1, 260)), '\\.+$', '') || '. [S' || x.position || ']' AS line FROM sources x LEFT JOIN best b ON b.query_id = x.query_id AND b.position = x.position)
      SELECT query_id, CAST(count(*) AS INTEGER) AS n_sources, string_agg(line, chr(10) ORDER BY position) AS answer FROM l GROUP BY query_id""",
    "support_coverage": f"""WITH {RERANKED}, c AS (SELECT s.query_id, s.position, list_distinct(list_filter({_tok("b.text")}, lambda t: t NOT IN {_in(K.VERIFY_STOP)} AND length(t) > 1)) AS want, list_filter({_tok("s.text")}, lambda t: t NOT IN {_in(K.VERIFY_STOP)} AND length(t) > 1) AS have,
        list_distinct(regexp_extract_all(b.text, '[0-9]+')) AS nums FROM sources s JOIN benchmark b ON b.item_id = s.query_id),
      w AS (SELECT query_id, position, unnest(want) AS t, have FROM c),
      s AS (SELECT query_id, position, sum(CASE WHEN list_contains(have, t) THEN 1 + ln(1 + length(t)) ELSE 0 END) / sum(1 + ln(1 + length(t))) AS cov FROM w GROUP BY ALL)
      SELECT c.query_id, c.position, round(coalesce(s.cov, 0), 6) AS coverage, CAST(CASE WHEN len(nums) > 0 THEN 0 END AS DOUBLE) AS number_recall FROM c LEFT JOIN s ON s.query_id = c.query_id AND s.position = c.position""",
    "session_list": f"WITH {SESSIONS} SELECT * FROM sessions",
    "recent_sessions": f"WITH {SESSIONS} SELECT * FROM sessions ORDER BY last_seq DESC, session_id LIMIT 50",
    "history_pairs": f"""WITH {MESSAGES}, o AS (SELECT session_id, seq, role, content AS reply, lag(role) OVER w AS before, lag(content) OVER w AS "user" FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
      p AS (SELECT session_id, seq, "user", reply, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS INTEGER) AS n FROM o WHERE role <> 'user' AND before = 'user') SELECT * FROM p WHERE n <= 3""",
    "history_stats": f"WITH {MESSAGES} SELECT count(DISTINCT session_id) AS sessions, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS questions, count(*) FILTER (WHERE role = 'assistant') AS answers, count(*) FILTER (WHERE role = 'system') AS system_messages, round(avg(length(content)) FILTER (WHERE role = 'assistant'), 4) AS mean_answer_chars FROM messages",
    "history_search": f"WITH {QUESTIONS}, units AS (SELECT conv_id || '/' || turn AS unit_id, text FROM conversations), {BM25} SELECT query_id, unit_id AS message_id, score, rank FROM bm25",
    "history_contains": f"WITH {MESSAGES} SELECT session_id, seq, role FROM messages WHERE contains(lower(content), 'the')",
    "feedback_upsert": """WITH r AS (SELECT doc_id AS message_id, quality AS rating, 'quality' AS note, doc_id % 3 AS created_at, 0 AS age FROM labels UNION ALL SELECT doc_id, toxic, 'toxic', doc_id % 2, 1 FROM labels)
      SELECT message_id, rating, note, created_at FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, age DESC, rating, note) AS n FROM r) WHERE n = 1""",
    "cascade_delete": f"WITH {MESSAGES} SELECT session_id, seq, role FROM messages WHERE session_id NOT IN (SELECT session_id FROM messages WHERE role = 'system')",
    "history_export": f"WITH {MESSAGES} SELECT session_id, string_agg('**' || upper(substr(role, 1, 1)) || substr(role, 2) || ':** ' || content, chr(10) || chr(10) ORDER BY seq) AS markdown FROM messages GROUP BY session_id",
    "key_terms": f"WITH {KEY_TERMS} SELECT * FROM key_terms",
    "salient_facts": f"WITH {FACTS} SELECT * FROM facts",
    "distractors": f"WITH {DISTRACTORS} SELECT * FROM distractors",
    "cloze": f"""WITH {DISTRACTORS}, few AS (SELECT kind, answer, list(value ORDER BY rank) AS d FROM distractors GROUP BY kind, answer HAVING count(*) = 3),
      m AS (SELECT f.*, list_transform(list_sort(list_transform(list_prepend(f.answer, d), lambda o: md5('7|' || sentence || '|' || o) || o)), lambda x: substr(x, 33)) AS options FROM facts f JOIN few USING (kind, answer))
      SELECT doc_id, sentence_no, kind, 'Fill in the blank: ' || substr(sentence, 1, instr(sentence, answer) - 1) || '______' || substr(sentence, instr(sentence, answer) + length(answer)) AS question, answer, array_to_string(options, ' | ') AS options,
        CAST(list_position(options, answer) - 1 AS INTEGER) AS correct_index, CASE WHEN kind IN ('money', 'percent') THEN 'easy' ELSE 'medium' END AS difficulty FROM m WHERE len(list_distinct(list_transform(options, lambda o: lower(trim(o))))) = 4""",
    "short_answers": f"WITH {SHORT} SELECT doc_id, sentence_no, question, sentence AS answer, 2 AS marks FROM asked_short WHERE n <= 3",
    "flashcards": f"""WITH {SHORT}, {KEY_TERMS} SELECT doc_id, 0 AS card_no, 'Key terms' AS front, string_agg(term, ', ' ORDER BY rank) AS back FROM key_terms GROUP BY doc_id
      UNION ALL SELECT doc_id, CAST(n AS INTEGER), question, sentence FROM asked_short WHERE n <= 2""",
    "representative_chunks": f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT doc_id, chunk_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_start, line_end) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks),
      h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, section ORDER BY nth) = 1 THEN 0 WHEN (nth - 1) % greatest(n // 14, 1) = 0 THEN 1 ELSE 2 END AS prio FROM o),
      p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prio, nth) AS pick FROM h WHERE n <= 14 OR prio < 2) SELECT doc_id, chunk_id, CAST(nth AS INTEGER) AS "at" FROM p WHERE n <= 14 OR pick <= 14""",
    "gold_validation": f"WITH {GOLD} SELECT item_id, n_units FROM gold_units",
    "eval_cases": f"WITH {CASES} SELECT query_id, category, array_to_string(list_transform(relevance, lambda r: CAST(r AS VARCHAR)), ',') AS relevance, best_score, refused, flagged FROM cases",
    "ranking_metrics": f"""WITH {CASES} SELECT count(*) FILTER (WHERE {_INSIDE}) AS n, {", ".join(f"{_MEAN.format(w=_INSIDE, v=_HIT.format(k=k))} AS recall_{k}" for k in (1, 3, 5))},
      {_MEAN.format(w=_INSIDE, v="CASE WHEN list_contains(relevance, true) THEN 1.0::DOUBLE / list_position(relevance, true) ELSE 0 END")} AS mrr,
      {_MEAN.format(w=_INSIDE, v="least(1.0::DOUBLE, " + " + ".join(f"CASE WHEN len(relevance) >= {i} AND relevance[{i}] THEN 1.0::DOUBLE / log2({i} + 1) ELSE 0 END" for i in range(1, 6)) + ")")} AS ndcg_5,
      {_MEAN.format(w=_INSIDE, v="len(list_filter(list_slice(relevance, 1, 5), lambda r: r))::DOUBLE / greatest(least(len(relevance), 5), 1)")} AS precision_5 FROM cases""",
    "refusal_metrics": f"""WITH {CASES}, f AS (SELECT category = 'out_of_corpus' AS out_, refused, refused OR flagged AS fl FROM cases)
      SELECT {", ".join(f"round(coalesce(count(*) FILTER (WHERE {a})::DOUBLE / nullif(count(*) FILTER (WHERE {b}), 0), 0), 4) AS {n}" for n, a, b in (("refusal_recall", "out_ AND refused", "out_"), ("refusal_precision", "out_ AND refused", "refused"), ("false_refusal_rate", "NOT out_ AND refused", "NOT out_"), ("ood_flagged_rate", "out_ AND fl", "out_"), ("in_corpus_flagged_rate", "NOT out_ AND fl", "NOT out_")))} FROM f""",
    "latency_metrics": "WITH v AS (SELECT length(text) AS x FROM conversations), l AS (SELECT list(x ORDER BY x) AS a FROM v) SELECT quantile_cont(x, 0.5)::DOUBLE AS latency_p50, any_value(a[CAST(greatest(floor(0.95 * len(a)), 1) AS BIGINT)])::DOUBLE AS latency_p95, max(x)::DOUBLE AS latency_max FROM v, l",
    "threshold_calibration": f"""WITH {CASES}, r AS (SELECT coalesce(min(best_score) FILTER (WHERE category <> 'out_of_corpus'), 0) AS low, coalesce(quantile_cont(best_score, 0.5) FILTER (WHERE category <> 'out_of_corpus'), 0) AS mid, coalesce(max(best_score) FILTER (WHERE category = 'out_of_corpus'), 0) AS high FROM cases)
      SELECT round(low, 7) AS in_corpus_min, round(mid, 7) AS in_corpus_median, round(high, 7) AS out_of_corpus_max, round(low - high, 7) AS separation, round((low + high) / 2, 7) AS suggested_threshold FROM r""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "query_variants": f"WITH v_in AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 12), ' ') AS text FROM benchmark UNION ALL SELECT * FROM (VALUES {_values(LITERAL_QUESTIONS, -1)}) v(query_id, text)), {VARIANTS} SELECT * FROM variants",
    "multi_query_merge": f"WITH {MERGED} SELECT query_id, unit_id AS doc_id, fused, dense_score, dense_rank, lexical_score, lexical_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first, unit_id) AS INTEGER) AS rank FROM merged",
    "topics": f"WITH RECURSIVE {TOPICS} SELECT * FROM topics",
    "suggestions": f"""WITH RECURSIVE {TOPICS} SELECT DISTINCT doc_id, 0 AS n, 'Summarise document ' || doc_id AS prompt FROM topics
      UNION ALL SELECT doc_id, n, prompt FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY topic_no) AS INTEGER) AS n, 'What does the section on ' || regexp_replace(name, '\\.+$', '') || ' say?' AS prompt FROM topics WHERE length(name) >= 4) WHERE n < 5""",
    "markers": MARKERS,
}
SQL["page_topics"] = f"SELECT page_id, {_name('section')} AS topic, CAST(sum({_words('text')}) AS BIGINT) AS words FROM ({SQL['html_lines']}) GROUP BY page_id, section"
