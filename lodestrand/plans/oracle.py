"""DuckDB SQL for the library's queries, written apart from their Spark plans."""

from __future__ import annotations

from .standins import OPENINGS, PERSONS, QUESTIONS, TODAY, USER

TOK = r"[\p{L}\p{N}_]+"


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Chunks, queries and allowed meetings as the stand-ins have them.
BASE = """chunks AS (
  SELECT doc_id AS chunk_id, source AS meeting_id, text, lang AS level, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
qs AS (SELECT item_id AS query_id, text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
scope AS (
  SELECT query_id, unnest(CASE WHEN query_id % 7 = 6 THEN ['unknown'] ELSE ['src' || query_id % 4, 'src' || (query_id % 4 + 4)] END) AS meeting_id
  FROM qs WHERE query_id % 5 <> 4)"""


def allowed(name: str, chunks: str, scope: str, queries: str, fail_open: bool, key: str = "meeting_id") -> str:
    """CTE of (query_id, chunk_id): the chunks that each query may find."""
    inside = f"SELECT DISTINCT s.query_id, c.chunk_id FROM {scope} s JOIN {chunks} c ON c.{key} = s.{key} JOIN {queries} q ON q.query_id = s.query_id"
    if not fail_open:
        return f"{name} AS ({inside})"
    rest = f"SELECT q.query_id, c.chunk_id FROM {queries} q CROSS JOIN {chunks} c WHERE q.query_id NOT IN (SELECT query_id FROM {name}_in)"
    return f"{name}_in AS ({inside}),\n{name} AS (SELECT * FROM {name}_in UNION ALL {rest})"


def everything(name: str, chunks: str, queries: str) -> str:
    return f"{name} AS (SELECT q.query_id, c.chunk_id FROM {queries} q CROSS JOIN {chunks} c)"


def dense(p: str, chunks: str, queries: str, pairs: str, k: int) -> str:
    """CTEs ending in {p}_dense(query_id, chunk_id, score, rank)."""
    unit = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
    return f"""{p}_dscore AS (
  SELECT p.query_id, p.chunk_id, round({unit}, 6) AS score
  FROM {pairs} p JOIN {queries} a ON a.query_id = p.query_id JOIN {chunks} b ON b.chunk_id = p.chunk_id
  WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
{p}_dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {p}_dscore) WHERE rank <= {k})"""


def bm25(p: str, chunks: str, queries: str, pairs: str | None, k: int) -> str:
    """CTEs ending in {p}_bm25(query_id, chunk_id, score, rank); statistics over each query's pairs, or over all chunks."""
    corpus = f"SELECT 0 AS corpus, chunk_id, list FROM {p}_tok" if pairs is None else f"SELECT query_id AS corpus, chunk_id, list FROM {pairs} JOIN {p}_tok USING (chunk_id)"
    own = "0" if pairs is None else "query_id"
    return f"""{p}_tok AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') AS list FROM {chunks}),
{p}_corpus AS ({corpus}),
{p}_size AS (SELECT corpus, count(*) AS n, avg(len(list)) AS mean_length FROM {p}_corpus GROUP BY corpus),
{p}_term AS (SELECT corpus, chunk_id, len(list) AS length, unnest(list) AS term FROM {p}_corpus),
{p}_df AS (SELECT corpus, term, count(DISTINCT chunk_id) AS df FROM {p}_term GROUP BY corpus, term),
{p}_raw AS (SELECT corpus, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {p}_df JOIN {p}_size USING (corpus)),
{p}_floor AS (SELECT corpus, 0.25 * avg(raw) AS floor FROM {p}_raw GROUP BY corpus),
{p}_idf AS (SELECT corpus, term, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM {p}_raw JOIN {p}_floor USING (corpus)),
{p}_ask AS (SELECT query_id, {own} AS corpus, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM {queries}),
{p}_tf AS (SELECT corpus, chunk_id, length, term, count(*) AS tf FROM {p}_term SEMI JOIN {p}_ask USING (corpus, term) GROUP BY ALL),
{p}_part AS (
  SELECT corpus, chunk_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length)) AS part
  FROM {p}_tf JOIN {p}_idf USING (corpus, term) JOIN {p}_size USING (corpus)),
{p}_bscore AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM {p}_ask JOIN {p}_part USING (corpus, term) GROUP BY query_id, chunk_id),
{p}_bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {p}_bscore WHERE score > 0) WHERE rank <= {k})"""


def fuse(p: str, k: int, alpha: str = "0.6") -> str:
    """CTE {p}_hybrid from {p}_dense and {p}_bm25."""
    norm = "(score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS norm"
    return f"""{p}_dn AS (SELECT query_id, chunk_id, score, {norm} FROM {p}_dense WINDOW w AS (PARTITION BY query_id)),
{p}_bn AS (SELECT query_id, chunk_id, score, {norm} FROM {p}_bm25 WINDOW w AS (PARTITION BY query_id)),
{p}_both AS (
  SELECT query_id, chunk_id, d.score AS vector_score, b.score AS bm25_score, round({alpha} * coalesce(d.norm, 0) + (1 - {alpha}) * coalesce(b.norm, 0), 6) AS hybrid_score
  FROM {p}_dn d FULL JOIN {p}_bn b USING (query_id, chunk_id)),
{p}_hybrid AS (
  SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank, vector_score, bm25_score, hybrid_score FROM {p}_both)
  WHERE rank <= {k})"""


def hybrid(p: str, chunks: str, queries: str, pairs: str, k: int, whole: bool = False, candidates: int | None = None) -> str:
    n = candidates or k
    return ",\n".join([dense(p, chunks, queries, pairs, n), bm25(p, chunks, queries, None if whole else pairs, n), fuse(p, k)])


#: Text with white space runs folded, as the stand-ins fold it.
TURN = r"""turns AS (SELECT conv_id, turn::INTEGER AS turn, role, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS text FROM conversations)"""
SUMMARIES = rf"""{TURN},
heads AS (
  SELECT conv_id, turn, text, regexp_extract(text, '^(\S+)', 1) AS first,
    CASE WHEN role = 'assistant' THEN printf('- **[S%03d-A%02d] Action: %s to %s**', conv_id, turn + 1, regexp_extract(text, '^(\S+)', 1), substr(text, 1, 60))
    ELSE printf('- **[S%03d-T%02d] Topic: %s**', conv_id, turn + 1, substr(text, 1, 60)) END AS head FROM turns),
summaries AS (
  SELECT conv_id, string_agg(head || chr(10) || '  ' || text || chr(10) || printf('  Reference: M%03d-T%02d, M%03d-A%02d', conv_id, turn + 1, conv_id, turn + 2), chr(10) ORDER BY turn) AS summary_text,
    list_sort(list_distinct(list(first || ' Smith'))) AS participants
  FROM heads GROUP BY conv_id)"""
ENTRIES = rf"""{TURN},
entry_texts AS (
  SELECT conv_id, 'Preamble of the meeting' || chr(10) || string_agg(
    CASE WHEN turn % 4 = 0 THEN '## ' || role || chr(10) ELSE '' END
    || printf('- **Topic Title:** %s', substr(text, 1, 40)) || chr(10) || printf('  - Topic id: M%03d-T%02d', conv_id, turn + 1) || chr(10) || '  ' || text || chr(10)
    || printf('  - Reference: P%03d–P%03d, P%03d', turn + 3, turn + 1, turn + 2), chr(10) ORDER BY turn) AS text
  FROM turns GROUP BY conv_id)"""
MEETINGS = """by_order AS (
  SELECT l_orderkey, list_sort(list_distinct(list(s_name))) AS participants, list_sort(list_distinct(list(p_name))) AS topics,
    list_sort(list(printf('%02d %s %s', l_linenumber, l_returnflag, p_name))) AS action_tasks
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
meetings AS (
  SELECT o_orderkey AS meeting_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+08:00' END AS datetime, participants, topics, action_tasks
  FROM orders JOIN by_order ON l_orderkey = o_orderkey),
cat AS (
  SELECT *, coalesce(substr(datetime, 1, 10), '') AS date, substr(datetime, 1, 4)::INTEGER AS year, substr(datetime, 6, 2)::INTEGER AS month, substr(datetime, 9, 2)::INTEGER AS day,
    array_to_string(participants, ', ') AS participants_str, array_to_string(topics, '; ') AS topics_str, array_to_string(action_tasks, '; ') AS action_tasks_str
  FROM meetings)"""


def opened(openings: list[str]) -> str:
    """A benchmark item's words, without what rules look for, behind the opening of its turn."""
    opening = "[" + ", ".join(map(_str, openings)) + f"][(item_id % {len(openings)} + 1)::INTEGER]"
    return opening + rf" || ' ' || trim(regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '{PRONOUN}', 'x', 'gi'))"


PRONOUN = r"\b(i|me|my|mine|we|us|our|ours|he|she|they|him|her|them)\b"
ASKED = f"questions AS (SELECT item_id AS question_id, {opened(QUESTIONS)} AS text FROM benchmark)"

#: Numbered lines: the flag and the running count of paragraph starts.
PARAGRAPHS = r"""lines AS (
  SELECT key, pos - 1 AS line_no, all_lines[pos] AS line
  FROM (SELECT key, all_lines, unnest(generate_series(1, len(all_lines))) AS pos FROM (SELECT key, string_split(text, chr(10)) AS all_lines FROM docs WHERE text IS NOT NULL))),
flagged AS (
  SELECT *, coalesce(lag(trim(line, E' \n\r\t') = '') OVER (PARTITION BY key ORDER BY line_no), true) AND trim(line, E' \n\r\t') <> '' AND NOT starts_with(trim(line, E' \n\r\t'), '#') AND NOT contains(line, '[#P') AS is_start
  FROM lines),
numbered AS (SELECT *, (sum(is_start::INTEGER) OVER (PARTITION BY key ORDER BY line_no ROWS UNBOUNDED PRECEDING))::INTEGER AS paragraph FROM flagged)"""

#: Entries of the texts in entry_texts or in bodies.
ENTRY_SPLIT = r"""elines AS (
  SELECT key, pos - 1 AS line_no, all_lines[pos] AS line
  FROM (SELECT key, all_lines, unnest(generate_series(1, len(all_lines))) AS pos FROM (SELECT key, string_split(text, chr(10)) AS all_lines FROM parts))),
emarked AS (
  SELECT *, (sum((line_no = 0 OR regexp_matches(trim(line, E' \n\r\t'), '^-\s*\*\*(Topic Title|Responsible Person):\*\*'))::INTEGER) OVER (PARTITION BY key ORDER BY line_no ROWS UNBOUNDED PRECEDING))::INTEGER AS entry_no
  FROM elines),
entries AS (
  SELECT key, entry_no, string_agg(line, chr(10) ORDER BY line_no) AS entry FROM emarked GROUP BY key, entry_no),
keyed AS (
  SELECT *, nullif(trim(regexp_extract(entry, '-\s*(?:Topic id|Action id):\s*([^\n]+)', 1), E' \n\r\t'), '') AS entry_id,
    nullif(trim(regexp_extract(entry, '-\s*Reference:\s*([^\n]+)', 1), E' \n\r\t'), '') AS reference
  FROM entries)"""

SECTIONS = r"""slines AS (
  SELECT conv_id, line_no, line FROM (
    SELECT conv_id, pos AS line_no, trim(all_lines[pos], E' \n\r\t') AS line
    FROM (SELECT conv_id, all_lines, unnest(generate_series(1, len(all_lines))) AS pos FROM (SELECT conv_id, string_split(text, chr(10)) AS all_lines FROM entry_texts)))
  WHERE line <> ''),
smarked AS (
  SELECT *, (sum(starts_with(line, '## ')::INTEGER) OVER (PARTITION BY conv_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::INTEGER AS section_no FROM slines),
titled AS (SELECT *, coalesce(max(CASE WHEN starts_with(line, '## ') THEN trim(substr(line, 4)) END) OVER (PARTITION BY conv_id, section_no), 'Unknown') AS section FROM smarked),
sections AS (
  SELECT conv_id, section_no, section, string_agg(line, '  ' || chr(10) ORDER BY line_no) AS body
  FROM titled WHERE NOT starts_with(line, '## ') GROUP BY conv_id, section_no, section)"""


def packed(limit: int) -> str:
    """CTEs ending in chunk texts (key, chunk_no, chunk) of segs (key, i, seg, bullet)."""
    return f"""packed AS (
  SELECT key, i, 0 AS chunk_no, length(seg) AS size, CASE WHEN bullet THEN seg END AS carried, seg AS said FROM segs WHERE i = 1
  UNION ALL
  SELECT s.key, s.i,
    CASE WHEN p.size + length(s.seg) > {limit} THEN p.chunk_no + 1 ELSE p.chunk_no END,
    CASE WHEN p.size + length(s.seg) > {limit} THEN coalesce(length(p.carried), 0) + length(s.seg) ELSE p.size + length(s.seg) END,
    CASE WHEN s.bullet THEN s.seg ELSE p.carried END,
    CASE WHEN p.size + length(s.seg) > {limit} AND p.carried IS NOT NULL THEN p.carried || chr(10) || s.seg ELSE s.seg END
  FROM packed p JOIN segs s ON s.key = p.key AND s.i = p.i + 1),
packs AS (SELECT key, chunk_no, string_agg(said, chr(10) ORDER BY i) AS chunk FROM packed GROUP BY key, chunk_no)"""


#: Summaries cut into bullets, three lines each.
SUMMARY_SEGMENTS = "segs AS (SELECT conv_id AS key, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS i, head || chr(10) || '  ' || text || chr(10) || printf('  Reference: M%03d-T%02d, M%03d-A%02d', conv_id, turn + 1, conv_id, turn + 2) AS seg, true AS bullet FROM heads)"


def resolved() -> str:
    """The substitutions of q41, step by step."""
    text = rf"regexp_replace(text, '\b(?:i|me|my|mine|we|us|our|ours)\b', '{USER}', 'gi')"
    for phrase, day in (("the day before yesterday", f"DATE '{TODAY}' - 2"), ("5 June 2023", "DATE '2023-06-05'"), ("November 2025", "DATE '2025-11-15'"), ("March", "DATE '2024-03-15'"), ("2 weeks ago", f"DATE '{TODAY}' - 14"), ("3 days ago", f"DATE '{TODAY}' - 3"), ("last week", f"DATE '{TODAY}' - 7"), ("last month", f"DATE '{TODAY}' - INTERVAL 1 MONTH")):
        text = f"replace({text}, '{phrase}', strftime({day}, '%Y-%m-%d'))"
    days = {"yesterday": 1, "today": 0, "tomorrow": -1}
    for word, back in days.items():
        text = rf"regexp_replace({text}, '\b{word}\b', strftime(DATE '{TODAY}' - {back}, '%Y-%m-%d'), 'gi')"
    for person in PERSONS:
        if person in ("Speaker 1", "Host"):
            continue
        parts = person.split()
        named = " OR ".join(rf"regexp_matches(text, '\b{w}\b', 'i')" for w in parts if len(w) >= 4)
        pick = "CASE " + " ".join(rf"WHEN contains(lower({{t}}), '{w.lower()}') THEN regexp_replace({{t}}, '\b{w}\b', '{person}', 'gi')" for w in parts if len(w) >= 3) + " ELSE {t} END"
        text = f"(SELECT CASE WHEN ({named}) AND NOT contains(lower(t), '{person.lower()}') THEN {pick.format(t='t')} ELSE t END FROM (SELECT {text} AS t))"
    return text


NAMED = "list_filter([" + ", ".join(_str(p) for p in PERSONS if p not in ("Speaker 1", "Host")) + rf"], lambda p: len(list_filter(string_split(lower(p), ' '), lambda w: length(w) >= 4 AND list_contains(regexp_extract_all(lower(text), '{TOK}'), w))) > 0)"
_MONTH = "january|february|march|april|june|july|august|september|october|november|december"
TIME = (
    r"\b(today|(?:the\s+)?day\s+before\s+yesterday|yesterday|tomorrow|\d+\s+(?:day|week|month|year)s?\s+ago|(?:last|past|next)\s+(?:week|month|year)|\d{4}-\d{2}-\d{2}"
    rf"|\d{{1,2}}\s+(?:{_MONTH}|may)(?:\s+\d{{4}})?|(?:{_MONTH}|may)\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?|(?:{_MONTH}|may)\s+\d{{4}}|(?:{_MONTH}))\b"
)
LATEST = r"\b(?:last|recent|past|previous)\s+(?:(\d+)\s+)?meetings?\b"

def ask(chunks: str = "") -> str:
    """q52 and q58, step by step; chunks is a condition on documents."""
    listed = "[" + ", ".join(map(_str, PERSONS)) + "]"
    mine = r"regexp_matches(text, '(?i)\b(i|me|my|mine|we|us|our|ours)\b')"
    return rf"""WITH chunks AS (SELECT doc_id AS chunk_id, source AS meeting_id, text, lang AS level, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id{chunks}),
talks AS (
  SELECT meeting_id, printf('2024-05-%02d', no % 28 + 1) AS date, [{listed}[(no % 5 + 1)::INTEGER], {listed}[((no + 1) % 5 + 1)::INTEGER]] AS participants
  FROM (SELECT DISTINCT source AS meeting_id, coalesce(nullif(regexp_extract(source, '(\d+)$', 1), '')::INTEGER, 0) AS no FROM documents WHERE source IS NOT NULL)),
asked AS (SELECT item_id AS question_id, {opened(OPENINGS)} AS text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
planned AS (
  SELECT *, NOT (regexp_matches(text, '(?i)^\s*(?:what is an?|define|explain|write|translate|how do i)\b')
      AND NOT regexp_matches(text, '(?i)\b(meetings?|transcripts?|action items?|minutes|discuss\w*|said|mention\w*|decid\w*|agreed|agenda)\b')) AS need_rag,
    {mine} OR regexp_matches(text, '(?i)\b(last|past|recent|previous)\b|\byesterday\b|\btoday\b|\b\d+\s+(day|week|month)s?\s+ago\b') AS need_rewrite FROM asked),
stage AS (SELECT question_id, {resolved()} AS text, {NAMED}[1] AS who FROM planned WHERE need_rewrite),
counted AS (
  SELECT *, regexp_extract(text, '(?i){LATEST}', 0) AS said, regexp_extract(text, '(?i){LATEST}', 1) AS num FROM stage),
n AS (SELECT *, CASE WHEN said = '' THEN NULL WHEN num <> '' THEN num::INTEGER WHEN regexp_matches(lower(said), '^last\s+meeting$') THEN 1 ELSE 3 END AS n FROM counted),
places AS (
  SELECT question_id, meeting_id, n, row_number() OVER (PARTITION BY question_id ORDER BY date DESC, meeting_id) AS place
  FROM n JOIN talks ON n IS NOT NULL AND (who IS NULL OR list_contains(participants, who))),
ids AS (SELECT question_id, string_agg(meeting_id, ', ' ORDER BY place) AS meetings FROM places WHERE place <= n GROUP BY question_id),
ready AS (
  SELECT question_id AS query_id, need_rag, need_rewrite, embedding, coalesce(meetings, '') AS meetings,
    CASE WHEN meetings IS NOT NULL THEN regexp_replace(n.text, '(?i){LATEST}', 'meetings ' || meetings, 'g') ELSE coalesce(n.text, planned.text) END AS text
  FROM planned LEFT JOIN n USING (question_id) LEFT JOIN ids USING (question_id)),
qs AS (SELECT query_id, text, embedding FROM ready WHERE need_rag),
scope AS (SELECT query_id, unnest(string_split(meetings, ', ')) AS meeting_id FROM ready WHERE need_rag AND meetings <> ''),
{allowed("pairs", "chunks", "scope", "qs", True)},
{hybrid("a", "chunks", "qs", "pairs", 10, candidates=20)},
hits AS (
  SELECT query_id, chunk_id, rank, date, regexp_extract(text, '^\s*([^.!?\n]*[.!?]?)', 1) || ' [' || chunk_id || ']' AS said
  FROM a_hybrid JOIN chunks USING (chunk_id) LEFT JOIN talks USING (meeting_id)),
found AS (
  SELECT query_id, count(*)::INTEGER AS total_chunks, string_agg(chunk_id || '@' || coalesce(date, 'N/A'), ' ' ORDER BY rank) AS chunks,
    string_agg(said, chr(10) ORDER BY rank) FILTER (rank <= 3) AS best
  FROM hits GROUP BY query_id),
days AS (
  SELECT query_id, d, min(pos) AS pos FROM (
    SELECT query_id, unnest(l) AS d, unnest(generate_series(1, len(l))) AS pos FROM (SELECT query_id, regexp_extract_all(text, '\d{{4}}-\d{{2}}-\d{{2}}') AS l FROM ready)) GROUP BY query_id, d),
of_day AS (SELECT d.query_id, d.d, d.pos, h.said, row_number() OVER (PARTITION BY d.query_id, d.d ORDER BY h.rank) AS n FROM days d LEFT JOIN hits h ON h.query_id = d.query_id AND h.date = d.d),
sections AS (
  SELECT query_id, pos, CASE WHEN count(said) > 0 THEN d || ':' || chr(10) || string_agg(said, chr(10) ORDER BY n) ELSE 'No information is available for ' || d || '.' END AS section
  FROM of_day WHERE n <= 3 GROUP BY query_id, d, pos),
by_day AS (SELECT query_id, string_agg(section, chr(10) || chr(10) ORDER BY pos) AS dated FROM sections GROUP BY query_id)
SELECT query_id AS question_id, need_rag, need_rewrite, CASE WHEN need_rag THEN 'rag' ELSE 'direct' END AS answer_mode, text AS rewritten, meetings, NOT need_rag AS skipped,
  coalesce(total_chunks, 0) AS total_chunks, coalesce(chunks, '') AS chunks,
  CASE WHEN total_chunks IS NULL THEN 'No relevant information was found for your query.' ELSE coalesce(dated, best) END AS answer
FROM ready LEFT JOIN found USING (query_id) LEFT JOIN by_day USING (query_id)"""


def hierarchy(base: str, levels: tuple[str, str, str]) -> str:
    """Three levels of chunks, each searched in what the one above names."""
    return f"""WITH {base},
c1 AS (SELECT * FROM chunks WHERE level = '{levels[0]}'), c2 AS (SELECT * FROM chunks WHERE level = '{levels[1]}'),
c3 AS (SELECT *, printf('M%03d', chunk_id % 12) AS entry_id FROM chunks WHERE level = '{levels[2]}'),
{everything("p1", "c1", "qs")},
{hybrid("a", "c1", "qs", "p1", 5, True)},
m2 AS (SELECT DISTINCT query_id, meeting_id FROM a_hybrid JOIN c1 USING (chunk_id)),
q2 AS (SELECT * FROM qs SEMI JOIN m2 USING (query_id)),
{allowed("p2", "c2", "m2", "q2", True)},
{hybrid("b", "c2", "q2", "p2", 10)},
m3 AS (SELECT DISTINCT query_id, printf('M%03d', (chunk_id + unnest([0, 5])) % 12) AS entry_id FROM b_hybrid),
q3 AS (SELECT * FROM q2 SEMI JOIN m3 USING (query_id)),
{allowed("p3", "c3", "m3", "q3", False, "entry_id")},
{hybrid("c", "c3", "q3", "p3", 10)}
SELECT query_id, 'metadata' AS level, chunk_id, rank::INTEGER AS rank, hybrid_score FROM a_hybrid
UNION ALL SELECT query_id, 'summary', chunk_id, rank::INTEGER, hybrid_score FROM b_hybrid
UNION ALL SELECT query_id, 'meeting', chunk_id, rank::INTEGER, hybrid_score FROM c_hybrid"""


CATALOG = f"WITH {MEETINGS}\n"
#: What a saved index holds: chunks with a text, at the levels that q55 and q56 give them.
TEXTED = BASE.replace("ON vec_id = doc_id)", "ON vec_id = doc_id WHERE text IS NOT NULL)")
LEVELLED = BASE.replace("lang AS level", "CASE lang WHEN 'es' THEN 'metadata' WHEN 'fr' THEN 'summary' WHEN 'en' THEN 'meeting' WHEN 'de' THEN 'chunk' END AS level").replace("ON vec_id = doc_id)", "ON vec_id = doc_id WHERE text IS NOT NULL)")
GLOBAL = f"WITH {BASE},\n" + everything("pairs", "chunks", "qs")
SCOPED = f"WITH {BASE},\n" + allowed("pairs", "chunks", "scope", "qs", False)

ORACLE_SQL: dict[str, str] = {
    "q01_paragraph_index": f"WITH docs AS (SELECT doc_id AS key, text FROM documents), {PARAGRAPHS}\nSELECT key AS doc_id, line_no::INTEGER AS line_no, is_start, paragraph FROM numbered",
    "q02_paragraph_tag_transcript": f"""WITH docs AS (SELECT conv_id AS key, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {PARAGRAPHS}
SELECT key AS conv_id, string_agg(CASE WHEN is_start THEN repeat(' ', length(line) - length(regexp_replace(line, '^\\s+', ''))) || printf('[#P%03d] ', paragraph) || regexp_replace(line, '^\\s+', '') ELSE line END, chr(10) ORDER BY line_no) AS text FROM numbered GROUP BY key""",
    "q03_extract_topics": rf"""WITH {SUMMARIES},
found AS (SELECT conv_id, participants, list_filter(list_transform(regexp_extract_all(summary_text, '\[S\d+-T\d+\]\s*Topic:\s*([^\n]+)', 1), lambda x: trim(rtrim(trim(x, E' \n\r\t'), '*'), E' \n\r\t')), lambda x: x <> '') AS t FROM summaries),
chosen AS (SELECT conv_id, CASE WHEN len(t) > 0 THEN t ELSE participants END AS t FROM found)
SELECT conv_id, (unnest(generate_series(1, len(t))) - 1)::INTEGER AS topic_no, unnest(t) AS topic FROM chosen""",
    "q04_extract_actions_assignee": rf"""WITH {SUMMARIES},
found AS (SELECT conv_id, participants, list_filter(list_transform(regexp_extract_all(summary_text, '\[S\d+-A\d+\]\s*Action:\s*([^\n]+)', 1), lambda x: trim(rtrim(trim(x, E' \n\r\t'), '*'), E' \n\r\t')), lambda x: x <> '') AS t FROM summaries),
tasks AS (SELECT conv_id, participants, unnest(generate_series(1, len(t))) AS n, unnest(t) AS task FROM found),
who AS (SELECT *, lower(trim(string_split(task, ' to ')[1], E' \n\r\t')) AS who FROM tasks)
SELECT conv_id, printf('M%03d-A%02d', conv_id, n) AS action_id, task,
  CASE WHEN contains(task, ' to ') AND who <> '' THEN list_filter(participants, lambda p: contains(lower(p), who))[1] END AS assignee
FROM who""",
    "q05_participant_names": f"WITH {SUMMARIES}\nSELECT DISTINCT participant FROM (SELECT trim(unnest(participants), E' \\n\\r\\t') AS participant FROM summaries) WHERE participant <> ''",
    "q06_extract_summary_ids": rf"""WITH {SUMMARIES}, found AS (SELECT conv_id, regexp_extract_all(summary_text, '\[(S\d+-[TA]\d+)\]', 1) AS t FROM summaries)
SELECT conv_id, (unnest(generate_series(1, len(t))) - 1)::INTEGER AS place, unnest(t) AS summary_id FROM found""",
    "q07_extract_references": rf"""WITH {SUMMARIES},
found AS (SELECT conv_id, flatten(list_transform(list_filter(string_split(summary_text, chr(10)), lambda x: contains(x, 'Reference:')), lambda x: regexp_extract_all(regexp_extract(x, 'Reference:(.*)', 1), '(M\d+-[TA]\d+)', 1))) AS t FROM summaries)
SELECT conv_id, (unnest(generate_series(1, len(t))) - 1)::INTEGER AS place, unnest(t) AS reference FROM found""",
    "q08_expand_paragraph_ranges": """WITH keys AS (SELECT o_orderkey, o_orderkey::INTEGER AS k FROM orders),
spans AS (
  SELECT o_orderkey, 1 AS part, k % 1200 AS a, k % 1200 + 4 AS b FROM keys
  UNION ALL SELECT o_orderkey, 2, k % 7, k % 7 FROM keys
  UNION ALL SELECT o_orderkey, 3, k % 13, k % 13 + 2 FROM keys),
nums AS (SELECT o_orderkey, part, unnest(generate_series(a, b)) AS n FROM spans),
once AS (SELECT o_orderkey, n, min(part) AS part FROM nums GROUP BY o_orderkey, n)
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY part, n) - 1)::INTEGER AS place, printf('#P%03d', n) AS paragraph FROM once""",
    "q09_entry_split": f"WITH {ENTRIES}, parts AS (SELECT conv_id AS key, text FROM entry_texts), {ENTRY_SPLIT}\nSELECT key AS conv_id, entry_no, entry, entry_id, reference FROM keyed",
    "q10_metadata_chunk_text": f"""{CATALOG}SELECT meeting_id, meeting_id || '_metadata' AS chunk_id,
  concat_ws(chr(10), 'Brief Summary: ' || nullif(topics_str, ''), CASE WHEN len(kept) > 0 THEN array_to_string(kept, chr(10)) END) AS text
FROM (SELECT *, list_filter(action_tasks, lambda t: NOT contains(t, ' N ')) AS kept FROM cat)""",
    "q11_bullet_overlap_chunks": f"""WITH RECURSIVE segs AS (
  SELECT doc_id AS key, unnest(generate_series(1, len(l)))::INTEGER AS i, unnest(l) AS seg, unnest(generate_series(1, len(l))) > 1 AS bullet
  FROM (SELECT doc_id, list_prepend('Summary', list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: '- ' || x)) AS l FROM documents)),
{packed(1200)}
SELECT key AS doc_id, chunk_no, chunk FROM packs""",
    "q12_markdown_sections": f"WITH {ENTRIES}, {SECTIONS}\nSELECT conv_id, section_no, section, body FROM sections",
    "q13_meeting_level_chunks": rf"""WITH RECURSIVE {ENTRIES}, {SECTIONS},
parts AS (SELECT {{'c': conv_id, 's': section_no, 't': section}} AS key, body AS text FROM sections), {ENTRY_SPLIT},
long_lines AS (
  SELECT key, entry_no, pos, all_lines[pos] AS line, starts_with(trim(all_lines[pos], E' \n\r\t'), '- ') AS b
  FROM (SELECT key, entry_no, all_lines, unnest(generate_series(1, len(all_lines))) AS pos FROM (SELECT key, entry_no, string_split(entry, chr(10)) AS all_lines FROM keyed WHERE length(entry) > 1200))),
grouped AS (SELECT *, (sum((b OR pos = 1)::INTEGER) OVER (PARTITION BY key, entry_no ORDER BY pos ROWS UNBOUNDED PRECEDING))::INTEGER AS i FROM long_lines),
segs AS (SELECT {{'k': key, 'e': entry_no}} AS key, i, string_agg(line, chr(10) ORDER BY pos) AS seg, bool_or(b) AS bullet FROM grouped GROUP BY ALL),
{packed(1200)},
pieces AS (
  SELECT key.k AS key, key.e AS entry_no, chunk_no, chunk FROM packs
  UNION ALL SELECT key, entry_no, 0, entry FROM keyed WHERE length(entry) <= 1200 AND trim(entry, E' \n\r\t') <> ''),
placed AS (
  SELECT p.*, k.entry_id, k.reference, row_number() OVER (PARTITION BY p.key.c ORDER BY p.key.s, p.entry_no, p.chunk_no) - 1 AS n
  FROM pieces p JOIN keyed k ON k.key = p.key AND k.entry_no = p.entry_no),
paragraphs AS (
  SELECT key, entry_no, string_agg(printf('#P%03d', v), ',' ORDER BY v) AS paragraphs
  FROM (SELECT key, entry_no, unnest(generate_series(list_min(x), list_max(x))) AS v
        FROM (SELECT key, entry_no, list_transform(regexp_extract_all(reference, '(\d+)', 1), lambda x: x::INTEGER) AS x FROM keyed WHERE reference IS NOT NULL)) GROUP BY key, entry_no)
SELECT printf('data%03d', p.key.c) AS meeting_id, 'meeting' AS level, printf('data%03d', p.key.c) || '_meeting_' || n AS chunk_id,
  chunk || chr(10) || chr(10) || 'Meeting: Talk' || chr(10) || 'Date: None' AS text, p.key.t AS section, entry_id, reference, coalesce(paragraphs, '') AS paragraph_indices
FROM placed p LEFT JOIN paragraphs q ON q.key = p.key AND q.entry_no = p.entry_no""",
    "q15_tokenize_term_stats": f"""WITH tok AS (SELECT lang AS level, doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM documents)
SELECT level, term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS cf FROM tok GROUP BY level, term""",
    "q16_bm25_topk": f"WITH {BASE},\n{bm25('a', 'chunks', 'qs', None, 10)}\nSELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM a_bm25",
    "q17_dense_topk_exact": f"{GLOBAL},\n{dense('a', 'chunks', 'qs', 'pairs', 10)}\nSELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM a_dense",
    "q18_embedding_normalise": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, len(e)::INTEGER AS dims, round(n, 6) AS length, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total FROM v""",
    "q20_hybrid_topk": f"{GLOBAL},\n{hybrid('a', 'chunks', 'qs', 'pairs', 10, True, 20)}\nSELECT * REPLACE (rank::INTEGER AS rank) FROM a_hybrid",
    "q21_hybrid_alpha_sweep": f"{GLOBAL},\n{dense('a', 'chunks', 'qs', 'pairs', 10)},\n{bm25('a', 'chunks', 'qs', None, 10)}"
    + "".join(f",\n{fuse('a', 10, x).replace('a_dn', f'dn{i}').replace('a_bn', f'bn{i}').replace('a_both', f'both{i}').replace('a_hybrid', f'hybrid{i}')}" for i, x in enumerate(("0.0", "0.3", "0.6", "1.0")))
    + "\n"
    + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS alpha, query_id, chunk_id, rank::INTEGER AS rank, hybrid_score FROM hybrid{i}" for i, x in enumerate(("0.0", "0.3", "0.6", "1.0"))),
    "q22_dense_filtered": f"{SCOPED},\n{dense('a', 'chunks', 'qs', 'pairs', 10)}\nSELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM a_dense",
    "q23_bm25_filtered_local_stats": f"{SCOPED},\n{bm25('a', 'chunks', 'qs', 'pairs', 10)}\nSELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM a_bm25",
    "q24_hybrid_meeting_filter_failopen": f"WITH {BASE},\n{allowed('pairs', 'chunks', 'scope', 'qs', True)},\n{hybrid('a', 'chunks', 'qs', 'pairs', 10)}\nSELECT * REPLACE (rank::INTEGER AS rank) FROM a_hybrid",
    "q25_hybrid_entry_filter_failclosed": f"""WITH {BASE},
named AS (SELECT *, printf('M%03d', chunk_id % 12) AS entry_id FROM chunks),
wanted AS (SELECT DISTINCT query_id, printf('M%03d', query_id % 15) AS entry_id FROM scope),
{allowed("pairs", "named", "wanted", "qs", False, "entry_id")},
{hybrid("a", "named", "qs", "pairs", 10)}
SELECT * REPLACE (rank::INTEGER AS rank) FROM a_hybrid""",
    "q26_hierarchical_search": hierarchy(BASE, ("es", "fr", "en")),
    "q27_nested_filter_search": f"""WITH {BASE},
fit AS (
  SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderkey
  HAVING bool_or(list_has_any(string_split(p_name, ' '), ['red', 'widget'])) AND bool_or(l_returnflag IN ('A', 'R')) AND bool_or(l_linestatus = 'F' OR l_returnflag = 'F')),
found AS (SELECT vec_id AS chunk_id, embedding FROM embeddings JOIN fit ON o_orderkey = vec_id),
{everything("pairs", "found", "qs")},
{dense("a", "found", "qs", "pairs", 5)}
SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM a_dense""",
    "q28_context_render": f"""{GLOBAL},
{dense("a", "chunks", "qs", "pairs", 15)}
SELECT query_id, count(*) AS n_chunks, string_agg('[' || chunk_id || '] (Date: ' || coalesce(strftime(o_orderdate, '%Y-%m-%d'), 'None') || ')' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) AS context
FROM a_dense JOIN chunks USING (chunk_id) LEFT JOIN orders ON o_orderkey = chunk_id AND chunk_id % 3 <> 0 GROUP BY query_id""",
    "q29_outline_render": """WITH parts AS (
  SELECT conv_id, coalesce(role, '') AS role, '- ' || coalesce(role, '') || chr(10) || string_agg('  - ' || coalesce(text, ''), chr(10) ORDER BY turn) AS said
  FROM conversations GROUP BY conv_id, coalesce(role, ''))
SELECT conv_id, trim('Discussion on Conversation ' || conv_id || chr(10) || chr(10) || string_agg(said, chr(10) || chr(10) ORDER BY role), E' \\n\\r\\t') AS outline FROM parts GROUP BY conv_id""",
    "q30_catalog_flatten": f"{CATALOG}SELECT meeting_id, datetime, date, year, month, day, participants_str, topics_str, action_tasks_str FROM cat",
    "q31_last_n_meetings": f"{CATALOG}SELECT meeting_id, date, participants_str FROM cat ORDER BY date DESC, meeting_id LIMIT 10",
    "q32_last_n_for_person": f"{CATALOG}SELECT meeting_id, date, participants_str FROM cat WHERE list_contains(participants, 'Supplier#000000001') ORDER BY date DESC, meeting_id LIMIT 3",
    "q33_filter_by_person": f"{CATALOG}SELECT meeting_id, date, topics_str FROM cat WHERE list_contains(participants, 'Supplier#000000002')",
    "q34_filter_by_date_range": f"""{CATALOG}SELECT meeting_id, date, 'start' AS mode FROM cat WHERE date >= '2000-06-01'
UNION ALL SELECT meeting_id, date, 'end' FROM cat WHERE date <= '1996-02-29'
UNION ALL SELECT meeting_id, date, 'both' FROM cat WHERE date BETWEEN '1998-01-01' AND '1998-03-31'""",
    "q35_filter_by_year_month": f"""{CATALOG}SELECT meeting_id, year, month, day, '1997-3' AS asked FROM cat WHERE year = 1997 AND month = 3
UNION ALL SELECT meeting_id, year, month, day, '1996-0' FROM cat WHERE year = 1996
UNION ALL SELECT meeting_id, year, month, day, '0-12' FROM cat WHERE month = 12""",
    "q36_all_participants": f"{CATALOG}SELECT DISTINCT unnest(participants) AS participant FROM cat",
    "q37_person_meeting_counts": f"{CATALOG}SELECT participant, count(*) AS n_meetings, max(date) AS last_date FROM (SELECT unnest(participants) AS participant, date FROM cat) GROUP BY participant",
    "q40_detect_pronouns_persons": rf"""WITH {ASKED}
SELECT question_id, array_to_string({NAMED}, ', ') AS persons,
  array_to_string(list_transform(regexp_extract_all(text, '(?i){PRONOUN}', 1), lambda x: lower(x)), ', ') AS pronouns,
  array_to_string(regexp_extract_all(text, '(?i){TIME}', 1), ', ') AS time_terms
FROM questions""",
    "q41_resolve_entities": f"WITH {ASKED}\nSELECT question_id, {resolved()} AS resolved FROM questions",
    "q42_last_n_pattern_rewrite": rf"""{CATALOG.rstrip()},
{ASKED},
asked AS (SELECT question_id, text, regexp_extract(text, '(?i){LATEST}', 0) AS said, regexp_extract(text, '(?i){LATEST}', 1) AS num FROM questions),
counted AS (SELECT *, CASE WHEN said = '' THEN NULL WHEN num <> '' THEN num::INTEGER WHEN regexp_matches(lower(said), '^last\s+meeting$') THEN 1 ELSE 3 END AS n FROM asked),
ranked AS (SELECT meeting_id, row_number() OVER (ORDER BY date DESC, meeting_id) AS place FROM cat),
ids AS (SELECT question_id, string_agg(meeting_id::VARCHAR, ', ' ORDER BY place) AS ids FROM counted JOIN ranked ON place <= n GROUP BY question_id)
SELECT question_id, n, CASE WHEN ids IS NULL THEN text ELSE regexp_replace(text, '(?i){LATEST}', 'meetings ' || ids, 'g') END AS rewritten, coalesce(ids, '') AS relevant_meeting_ids
FROM counted LEFT JOIN ids USING (question_id)""",
    "q43_planner_flags": rf"""WITH {ASKED},
flags AS (
  SELECT question_id, regexp_matches(text, '(?i)^\s*(?:what is an?|define|explain|write|translate|how do i)\b')
      AND NOT regexp_matches(text, '(?i)\b(meetings?|transcripts?|action items?|minutes|discuss\w*|said|mention\w*|decid\w*|agreed|agenda)\b') AS general,
    regexp_matches(text, '(?i)\b(i|me|my|mine|we|us|our|ours)\b') OR regexp_matches(text, '(?i)\b(last|past|recent|previous)\b|\byesterday\b|\btoday\b|\b\d+\s+(day|week|month)s?\s+ago\b') AS need_rewrite
  FROM questions)
SELECT question_id, NOT general AS need_rag, need_rewrite, CASE WHEN general THEN 'direct' ELSE 'rag' END AS answer_mode FROM flags""",
    "q44_retrieval_metrics": f"""{GLOBAL},
{dense("a", "chunks", "qs", "pairs", 10)},
lab AS (SELECT a.query_id, a.rank, x.label = y.label AS hit FROM a_dense a JOIN embeddings x ON x.vec_id = a.query_id JOIN embeddings y ON y.vec_id = a.chunk_id),
per AS (
  SELECT q.query_id, round(coalesce(sum(hit::INTEGER), 0) / 10.0::DOUBLE, 6) AS precision,
    round(coalesce(sum(hit::INTEGER), 0) / any_value(n.n)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0), 6) AS reciprocal_rank
  FROM qs q LEFT JOIN lab USING (query_id)
  LEFT JOIN (SELECT x.vec_id AS query_id, count(*) AS n FROM embeddings x JOIN embeddings y ON x.label = y.label GROUP BY x.vec_id) n ON n.query_id = q.query_id
  GROUP BY q.query_id)
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, count(*) AS total_cases,
  count(*) FILTER (precision IS NOT NULL AND recall IS NOT NULL AND reciprocal_rank IS NOT NULL) AS successful_cases FROM per""",
    "q45_index_stats": f"""WITH {BASE}, levels AS (SELECT unnest(['en', 'fr', 'de', 'es', 'none']) AS level)
SELECT l.level, count(chunk_id) AS n_chunks, count(DISTINCT meeting_id) AS n_meetings, count(embedding) AS n_embedded, coalesce(bool_or(length(text) > 0), false) AS has_text
FROM levels l LEFT JOIN chunks c ON c.level = l.level GROUP BY l.level""",
    "q46_incremental_new_chunks": "SELECT source AS meeting_id, lang AS level, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source, lang",
    "q47_pair_files_join": """SELECT doc_id, 'both' AS side, lang, quality FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'left', NULL, NULL FROM documents ANTI JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'right', NULL, NULL FROM labels ANTI JOIN documents USING (doc_id)""",
    "q48_json_props_parse": "SELECT event_type, (props->>'$.k')::INTEGER AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "q49_summary_level_chunks": rf"""WITH RECURSIVE {SUMMARIES}, {SUMMARY_SEGMENTS},
{packed(1200)}
SELECT printf('data%03d', key) AS meeting_id, 'summary' AS level, printf('data%03d', key) || '_summary_' || chunk_no AS chunk_id,
  chunk || chr(10) || chr(10) || 'Meeting: Talk' || chr(10) || 'Date: None' AS text,
  array_to_string(regexp_extract_all(chunk, '\[(S\d+-[TA]\d+)\]', 1), ',') AS summary_ids,
  array_to_string(flatten(list_transform(list_filter(string_split(chunk, chr(10)), lambda x: contains(x, 'Reference:')), lambda x: regexp_extract_all(regexp_extract(x, 'Reference:(.*)', 1), '(M\d+-[TA]\d+)', 1))), ',') AS "references"
FROM packs""",
    "q50_reference_graph": r"""WITH cited AS (
  SELECT DISTINCT conv_id, unnest([printf('M%03d-T%02d', conv_id, turn + 1), printf('M%03d-A%02d', conv_id, turn + 2)]) AS entry_id FROM conversations),
listed AS (SELECT conv_id, printf('M%03d-T%02d', conv_id, turn + 1) AS entry_id, unnest(generate_series(turn + 1, turn + 3)) AS p FROM conversations)
SELECT conv_id, entry_id, printf('#P%03d', p) AS paragraph, length(text)::INTEGER AS n_chars
FROM cited JOIN listed USING (conv_id, entry_id) JOIN conversations c USING (conv_id) WHERE c.turn + 1 = p""",
    "q51_extractive_answers": f"""WITH {BASE},
{bm25("a", "chunks", "qs", None, 3)},
said AS (SELECT query_id, string_agg(regexp_extract(text, '^\\s*([^.!?\\n]*[.!?]?)', 1) || ' [' || chunk_id || ']', chr(10) ORDER BY rank) AS answer FROM a_bm25 JOIN chunks USING (chunk_id) GROUP BY query_id)
SELECT query_id, coalesce(answer, 'No relevant information was found for your query.') AS answer FROM qs LEFT JOIN said USING (query_id)""",
    "q52_ask": ask(),
    "q53_index_bm25": f"WITH {TEXTED},\n{bm25('a', 'chunks', 'qs', None, 10)}\nSELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM a_bm25",
    "q54_index_replaced_and_removed": f"WITH {TEXTED.replace('text IS NOT NULL', "text IS NOT NULL AND source IS DISTINCT FROM 'src3'")},\n{allowed('pairs', 'chunks', 'scope', 'qs', True)},\n{hybrid('a', 'chunks', 'qs', 'pairs', 10)}\nSELECT * REPLACE (rank::INTEGER AS rank) FROM a_hybrid",
    "q55_index_levels": f"""WITH {LEVELLED}, levels AS (SELECT unnest(['metadata', 'summary', 'meeting', 'chunk']) AS level)
SELECT l.level, count(chunk_id) AS n_chunks, coalesce(sum(len(regexp_extract_all(lower(text), '{TOK}'))), 0)::BIGINT AS n_tokens,
  count(DISTINCT CASE WHEN l.level = 'meeting' THEN printf('M%03d', chunk_id % 12) ELSE meeting_id END) AS n_scopes, count(embedding) AS n_embedded
FROM levels l LEFT JOIN chunks c ON c.level = l.level GROUP BY l.level""",
    "q56_index_hierarchical": hierarchy(LEVELLED, ("metadata", "summary", "meeting")),
    "q57_index_filtered_knn": f"""WITH {TEXTED},
fit AS (
  SELECT o_orderkey, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderkey, o_orderpriority
  HAVING bool_or(list_has_any(string_split(p_name, ' '), ['red', 'widget'])) AND bool_or(l_returnflag IN ('A', 'R'))),
found AS (SELECT chunks.*, o_orderpriority FROM chunks JOIN fit ON o_orderkey = chunk_id WHERE regexp_extract(meeting_id, '^src(\\d+)$', 1) IN ('0', '2', '4', '6', '8', '10', '12', '14', '16', '18')),
{everything("pairs", "found", "qs")},
{dense("a", "found", "qs", "pairs", 5)}
SELECT query_id, chunk_id, round((1 + score) / 2, 7) AS score, rank::INTEGER AS rank, meeting_id, o_orderpriority FROM a_dense JOIN found USING (chunk_id)""",
    "q58_index_ask": ask(" WHERE text IS NOT NULL"),
    "q59_catalog_tool_calls": f"""{CATALOG.rstrip()},
calls AS (
  SELECT item_id AS call_id, ['find_person', 'last_n_meetings', 'date_from_relative', 'filter_by_person', 'filter_by_date', 'filter_by_date_range', 'get_all_participants', 'find_topic'][(item_id % 8 + 1)::INTEGER] AS query_type,
    turn % 5 AS n, CASE WHEN turn % 2 = 1 THEN person END AS person_name, CASE WHEN turn % 4 <> 3 THEN person END AS fuzzy_name,
    ['yesterday', '2 weeks ago', 'November 2025', 'some day', ''][(turn % 5 + 1)::INTEGER] AS date_str, 1994 + turn % 7 AS y, turn % 13 AS m,
    CASE WHEN turn % 3 <> 2 THEN (1993 + turn % 6) || '-03-15' END AS since, CASE WHEN turn % 3 = 0 THEN (1993 + turn % 6) || '-06-10' WHEN turn % 6 = 2 THEN '1993-01-31' END AS until
  FROM (SELECT item_id, item_id // 8 AS turn, printf('Supplier#%09d', item_id % 5 + 1) AS person FROM benchmark)),
judged AS (
  SELECT *, CASE WHEN query_type = 'find_topic' THEN 'Unknown query_type: find_topic' WHEN query_type = 'filter_by_person' AND fuzzy_name IS NULL THEN 'fuzzy_name is required'
    WHEN query_type = 'date_from_relative' AND date_str = '' THEN 'date_str is required'
    WHEN query_type = 'filter_by_date_range' AND since IS NULL AND until IS NULL THEN 'At least one of start_date or end_date is required' END AS error FROM calls WHERE query_type <> 'find_person'),
met AS (
  SELECT call_id, query_type, row_number() OVER (PARTITION BY call_id ORDER BY date DESC, meeting_id) AS place, meeting_id, date, CASE WHEN query_type = 'last_n_meetings' THEN coalesce(nullif(n, 0), 3) END AS most
  FROM judged JOIN cat ON error IS NULL AND CASE query_type
    WHEN 'last_n_meetings' THEN person_name IS NULL OR list_contains(participants, person_name)
    WHEN 'filter_by_person' THEN list_contains(participants, fuzzy_name)
    WHEN 'filter_by_date' THEN (y = year) IS TRUE AND (m = 0 OR (m = month) IS TRUE)
    WHEN 'filter_by_date_range' THEN (since IS NULL OR date >= since) AND (until IS NULL OR date <= until) END)
SELECT call_id, query_type, place::INTEGER AS place, meeting_id, date, NULL::VARCHAR AS name, NULL::VARCHAR AS error FROM met WHERE most IS NULL OR place <= most
UNION ALL SELECT call_id, query_type, 1, NULL, CASE date_str WHEN 'yesterday' THEN '2024-05-14' WHEN '2 weeks ago' THEN '2024-05-01' WHEN 'November 2025' THEN '2025-11-15' END, NULL, NULL FROM judged WHERE query_type = 'date_from_relative' AND error IS NULL
UNION ALL SELECT call_id, query_type, (row_number() OVER (PARTITION BY call_id ORDER BY encode(name)))::INTEGER, NULL, NULL, name, NULL FROM judged, (SELECT DISTINCT unnest(participants) AS name FROM cat) WHERE query_type = 'get_all_participants'
UNION ALL SELECT call_id, query_type, NULL, NULL, NULL, NULL, error FROM judged WHERE error IS NOT NULL""",
}
