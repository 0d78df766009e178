"""The same results in plain SQL over the given tables, written independently of the operators.

Regular expressions and word lists are the shared fixed values; the logic is not shared.
"""

from __future__ import annotations

from colloquy.functions import vocab as V

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ql(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def qin(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def norm(c: str) -> str:
    return rf"coalesce(trim(regexp_replace({c}, '[ \t\n\r\f]+', ' ', 'g')), '')"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {q(V.WORD)})"


def letter_words(c: str) -> str:
    return f"list_filter({words(c)}, lambda w: regexp_matches(w, {q(V.LETTER_WORD)}))"


def content_words(c: str, stop=V.TOPIC_STOP) -> str:
    return f"list_filter({letter_words(c)}, lambda w: NOT list_contains({ql(stop)}, w))"


def sents(c: str) -> str:
    return (rf"list_filter(list_transform(string_split(regexp_replace(trim({c}), "
            rf"'([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), "
            rf"lambda s: trim(regexp_replace(s, '[ \t\n\r\f]+', ' ', 'g'))), lambda s: s <> '')")


def units(c: str) -> str:
    """Sentences that also end at line breaks."""
    return sents(rf"regexp_replace({c}, '\n+', ' ' || chr(1), 'g')")


def space_words(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda w: w <> '')"


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def cases(c: str, mapping: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + \
        f" ELSE {default} END"


def terms(c: str) -> str:
    folded = rf"regexp_replace(lower({norm(c)}), '\bdocs?\b', 'documentation', 'g')"
    renamed = (f"list_transform(regexp_extract_all({folded}, {q(V.WORD)}), "
               f"lambda w: {cases('w', V.TERM_ALIASES, 'w')})")
    return (f"list_sort(list_distinct(list_filter({renamed}, "
            f"lambda w: NOT list_contains({ql(V.TERM_DROP)}, w))))")


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {both}::DOUBLE / "
            f"(len({a}) + len({b}) - {both}) END")


def is_action(c: str) -> str:
    t = f"replace({c}, chr(8217), '''')"
    return (f"(NOT {rx(t, V.ACTION_HEDGE)} AND ({rx(t, V.ACTION_REQUEST)} OR "
            f"{rx(t, V.ACTION_PREFIX)} OR ({rx(t, V.ACTION_MATCH)} AND {rx(t, V.SUBJECT_GATE)} AND NOT contains({t}, '?'))))")


def is_decision(c: str) -> str:
    t = f"trim({c})"
    part = lambda n: f"regexp_extract({t}, {q(V.DECISION_SPLIT)}, {n})"
    near = f"({space_words(part(1))})[-5:]"
    return (f"({part(2)} <> '' AND NOT contains({t}, '?') AND NOT {rx(t, V.DECISION_HEDGE)} "
            f"AND len(list_filter({near}, lambda w: {rx('w', V.NEGATION)})) = 0 "
            f"AND NOT {rx(part(1), V.AFTER_ARTICLE)} "
            rf"AND ({rx(part(3), r'^\s+\w')} OR {rx(part(1), V.AFTER_PASSIVE)}))")


def is_question(c: str) -> str:
    t = f"lower(trim({c}))"
    skip = sorted(set(V.TOPIC_STOP) | set(V.NOT_A_SUBJECT))
    return (f"(NOT {rx(t, V.RHETORICAL)} AND len(list_filter({letter_words(t)}, "
            f"lambda w: NOT list_contains({ql(skip)}, w))) > 0 AND len({words(t)}) >= 4 "
            f"AND (contains({t}, '?') OR {rx(t, V.OPEN_ISSUE)}))")


def substantive(c: str) -> str:
    return (f"(len({space_words(c)}) >= 5 AND NOT {rx(c, V.FRAGMENT_OPENER)} "
            f"AND NOT {c} LIKE '%?')")


def owner(c: str, speaker: str = "NULL") -> str:
    t = norm(c)
    named = (f"coalesce(nullif(regexp_extract({t}, {q(V.OWNER)}, 1), ''), "
             f"nullif(regexp_extract({t}, {q(V.OWNER)}, 2), ''))")
    return (f"CASE WHEN {speaker} IS NOT NULL AND {speaker} <> '' AND {rx(t, V.FIRST_PERSON)} "
            f"THEN {speaker} WHEN lower({named}) NOT IN {qin(V.PRONOUNS)} THEN {named} END")


def deadline(c: str) -> str:
    return f"nullif(trim(regexp_extract({norm(c)}, {q(V.DEADLINE)}, 1)), '')"


def priority(c: str) -> str:
    t = norm(c)
    s = (f"lower(coalesce(nullif(regexp_extract({t}, {q(V.PRIORITY)}, 1), ''), "
         f"nullif(regexp_extract({t}, {q(V.PRIORITY)}, 2), '')))")
    return cases(s, V.PRIORITY_MAP, s)


def status(c: str) -> str:
    t = norm(c)
    return "CASE " + " ".join(f"WHEN {rx(t, p)} THEN {q(s)}" for p, s in V.STATUS_RULES) + \
        " ELSE 'Pending' END"


def has_word(ctx: str, value: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return (f"({value} <> '' AND regexp_matches(lower({norm(ctx)}), '(^|{edge})' || "
            f"regexp_escape(lower({value})) || '({edge}|$)'))")


def clock_parts(c: str) -> tuple[str, str, str]:
    n = f"floor({c})::BIGINT"
    return f"({n} // 3600)", f"({n} % 3600 // 60)", f"({n} % 60)"


DIGEST_NULL = "chr(2)"


def digest(*parts: str) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(parts) + "))"


SEGMENTS = """segments AS (
SELECT meeting_id, segment_id, CAST(segment_id * 7 AS DOUBLE) AS start_sec,
       CAST(segment_id * 7 + 6 AS DOUBLE) AS end_sec,
       CASE WHEN k % 11 = 0 THEN NULL ELSE concat('Speaker ', CAST(c % 4 AS STRING)) END AS speaker,
       CASE CAST(k % 16 AS INT)
         WHEN 0  THEN concat('Alice will send report ', CAST(k AS STRING), ' by Friday.')
         WHEN 1  THEN concat('Bob, can you prepare invoice ', CAST(k AS STRING), ' by end of week?')
         WHEN 2  THEN 'We agreed to keep PostgreSQL for the release.'
         WHEN 3  THEN concat('We have not approved budget ', CAST(k % 50 AS STRING), '.')
         WHEN 4  THEN 'We decided not to deploy on Monday.'
         WHEN 5  THEN concat('When will we launch phase ', CAST(k % 5 AS STRING), '?')
         WHEN 6  THEN concat('We still need to figure out who owns version ', CAST(k % 3 AS STRING), '.')
         WHEN 7  THEN concat('The API handles ', CAST(k AS STRING), ' requests per minute.')
         WHEN 8  THEN 'Um, you know, the   Docker build is  like slow.'
         WHEN 9  THEN concat('Carol must review ticket ', CAST(k % 97 AS STRING), ' before release; it is urgent priority.')
         WHEN 10 THEN 'Maybe we could redesign the machine learning dashboard.'
         WHEN 11 THEN 'Does that make sense?'
         WHEN 12 THEN concat('Dave is working on the slides urgently. They will share deck ', CAST(k % 7 AS STRING), ' tomorrow.')
         WHEN 13 THEN 'The migration is blocked and we are waiting on Kubernetes.'
         WHEN 14 THEN concat('I will update document ', CAST(k % 23 AS STRING), ' next week.')
         ELSE 'Yeah. Okay. Right.'
       END AS text
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 203 AS meeting_id,
             CAST(ROW_NUMBER() OVER (PARTITION BY o_orderkey % 203 ORDER BY o_orderkey) - 1 AS BIGINT)
               AS segment_id FROM orders) o)"""
CANDIDATES = SEGMENTS + """, candidates AS (
SELECT r.run_id, s.meeting_id, s.category, s.segment_id AS seg_from, s.segment_id AS seg_to,
       CASE WHEN r.run_id = 2 AND s.segment_id % 3 = 0
            THEN concat('To confirm, ', s.text) ELSE s.text END AS item_text,
       CASE WHEN r.run_id = 2 AND s.segment_id % 13 = 0 THEN 'Zed'
            WHEN s.text LIKE 'Alice %' THEN 'Alice' WHEN s.text LIKE 'Bob,%' THEN 'Bob'
            WHEN s.text LIKE 'Carol %' THEN 'unknown' ELSE NULL END AS owner,
       CASE WHEN s.text LIKE '% by Friday.' THEN 'Friday' ELSE NULL END AS deadline,
       CASE WHEN s.segment_id % 17 = 0 THEN 'Unsupported promise.' ELSE s.text END AS evidence,
       CASE WHEN r.run_id = 1 AND s.segment_id % 7 = 0 THEN 'User owner' ELSE NULL END AS edited_owner
FROM (SELECT meeting_id, segment_id, text,
         CASE WHEN text LIKE 'Alice will %' OR text LIKE 'Bob, can %' OR text LIKE 'Carol must %'
                OR text LIKE 'I will update %' THEN 'action_items'
              WHEN text LIKE 'We agreed %' OR text LIKE 'We decided %' THEN 'decisions'
              WHEN text LIKE 'When will %' OR text LIKE 'We still need %' THEN 'questions' END AS category
      FROM segments) s
CROSS JOIN (SELECT 1 AS run_id UNION ALL SELECT 2 AS run_id) r
WHERE s.category IS NOT NULL AND NOT (r.run_id = 2 AND s.segment_id % 5 = 4))"""
UNITS = """units AS (SELECT CAST(floor(vec_id / 50) AS BIGINT) AS meeting_id,
vec_id % 50 AS segment_id, embedding::DOUBLE[] AS v FROM embeddings)"""
SENTENCES = SEGMENTS + f""", sentences AS (
SELECT meeting_id, segment_id, speaker, i - 1 AS sentence_no, s AS sentence FROM (
SELECT meeting_id, segment_id, speaker, unnest(p) AS s, generate_subscripts(p, 1) AS i
FROM (SELECT *, {sents('text')} AS p FROM segments)))"""
MEETINGS = """meetings AS (SELECT o_orderkey AS id,
o_orderpriority || '-' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '.pdf'
 WHEN o_orderkey % 2 = 0 THEN '.mp4' ELSE '.WAV' END AS filename,
CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice) / 100 END AS duration_sec,
CASE WHEN o_orderkey % 3 = 0 THEN 'en' WHEN o_orderkey % 3 = 1 THEN 'pt_BR' END AS language,
o_orderdate AS uploaded_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing'
 ELSE 'uploaded' END AS status FROM orders)"""
DOC_SENTENCES = f"""docsents AS (SELECT doc_id, unnest(p) AS sentence,
generate_subscripts(p, 1) - 1 AS sentence_no FROM (SELECT doc_id, {sents('text')} AS p FROM documents))"""


def located(quotes: str) -> str:
    """CTEs ending in ``located``: distinct quotes of ``quotes`` found in their transcript."""
    return f""", rows_ AS (SELECT meeting_id, segment_id, start_sec, coalesce(speaker, '') AS sp,
 {norm('text')} AS t FROM segments),
 placed AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY meeting_id ORDER BY segment_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM rows_),
 full_ AS (SELECT meeting_id, string_agg(t, ' ' ORDER BY segment_id) AS full_text FROM rows_ GROUP BY 1),
 wanted AS (SELECT DISTINCT meeting_id, {norm('quote')} AS quote FROM ({quotes}) WHERE {norm('quote')} <> ''),
 hits AS (SELECT w.meeting_id, w.quote, strpos(f.full_text, w.quote) - 1 AS s,
  (length(f.full_text) - length(replace(f.full_text, w.quote, ''))) // length(w.quote) = 1 AS is_unique
  FROM wanted w JOIN full_ f USING (meeting_id) WHERE contains(f.full_text, w.quote)),
 cover AS (SELECT h.meeting_id, h.quote, min(p.segment_id) AS seg_from, max(p.segment_id) AS seg_to,
  arg_min(p.start_sec, p.segment_id) AS timestamp, count(DISTINCT p.sp) AS n, min(p.sp) AS sp
  FROM hits h JOIN placed p ON p.meeting_id = h.meeting_id AND p.at < h.s + length(h.quote)
   AND p.at + length(p.t) > h.s WHERE h.is_unique GROUP BY 1, 2),
 located AS (SELECT h.meeting_id, h.quote, h.is_unique, c.seg_from, c.seg_to, c.timestamp,
  CASE WHEN c.n = 1 THEN nullif(c.sp, '') END AS speaker
  FROM hits h LEFT JOIN cover c USING (meeting_id, quote))"""


GROUNDED = CANDIDATES + located("SELECT meeting_id, evidence AS quote FROM candidates") + f""",
 grounded AS (SELECT c.*, {norm('c.evidence')} AS qt, l.is_unique,
  coalesce(l.is_unique, FALSE) AS by_quote, r.t AS span,
  CASE WHEN coalesce(l.is_unique, FALSE) THEN {norm('c.evidence')}
   WHEN contains(r.t, {norm('c.evidence')}) THEN {norm('c.evidence')} ELSE r.t END AS src,
  CASE WHEN coalesce(l.is_unique, FALSE) THEN l.seg_from ELSE c.seg_from END AS src_from,
  CASE WHEN coalesce(l.is_unique, FALSE) THEN l.seg_to ELSE c.seg_to END AS src_to,
  CASE WHEN coalesce(l.is_unique, FALSE) THEN l.timestamp ELSE r.start_sec END AS src_time,
  CASE WHEN coalesce(l.is_unique, FALSE) THEN l.speaker ELSE nullif(r.sp, '') END AS src_speaker
  FROM candidates c LEFT JOIN located l ON l.meeting_id = c.meeting_id AND l.quote = {norm('c.evidence')}
  JOIN rows_ r ON r.meeting_id = c.meeting_id AND r.segment_id = c.seg_from)"""
_own = f"CASE WHEN lower({norm('owner')}) IN {qin(V.NULL_WORDS)} THEN '' ELSE {norm('owner')} END"
_due = f"CASE WHEN lower({norm('deadline')}) IN {qin(V.NULL_WORDS)} THEN '' ELSE {norm('deadline')} END"
VALIDATED = GROUNDED + f""", validated AS (SELECT run_id, meeting_id, category, {norm('item_text')} AS text,
 src_from AS seg_from, src_to AS seg_to, src AS evidence, src_time AS timestamp, src_speaker AS speaker,
 CASE WHEN category = 'action_items' THEN CASE WHEN {has_word('src', f'({_own})')}
   OR (({_own}) <> '' AND ({_own}) = coalesce(src_speaker, '')) THEN ({_own})
   ELSE {owner('src', 'src_speaker')} END END AS owner,
 CASE WHEN category = 'action_items' THEN CASE WHEN {has_word('src', f'({_due})')} THEN ({_due})
   ELSE {deadline('src')} END END AS deadline,
 CASE WHEN category = 'action_items' THEN {priority('src')} END AS priority,
 CASE WHEN category = 'action_items' THEN {status('src')}
  WHEN category = 'questions' THEN 'Not assessed' END AS status,
 edited_owner, NULL::VARCHAR AS reason FROM grounded)"""


def simple(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- sources ------------------------------------------------------------------------------------
simple("s1_scan_meetings", f"""SELECT doc_id AS meeting_id, i - 1 AS segment_id, (i - 1) * 2.0::DOUBLE AS start_sec,
(i - 1) * 2.0::DOUBLE + 1 AS end_sec, 'S' || ((i - 1) % 3) AS speaker, md5(s) AS text_md5 FROM (
SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {sents('text')} AS p FROM documents))""")
simple("s2_snapshot", "SELECT doc_id, lang, n_chars FROM documents")
simple("s3_meeting_list", f"WITH {MEETINGS} SELECT id, filename, duration_sec AS duration, language, uploaded_at, status FROM meetings")
simple("s4_segments_of_meeting", f"WITH {SEGMENTS} SELECT * FROM segments WHERE meeting_id = 7")
simple("s5_append_meetings", f"SELECT doc_id AS meeting_id, source AS filename, len({sents('text')}) AS segments FROM documents")
simple("s6_upsert", f"""WITH {MEETINGS} SELECT id, CASE WHEN id % 4 = 0 OR id % 10 = 3 THEN 'reanalysed'
ELSE status END AS status, uploaded_at FROM meetings""")
simple("s7_labelled_csv", f"""WITH {SENTENCES} SELECT sentence, CASE segment_id % 4 WHEN 0 THEN 'DECISION'
ELSE 'QUESTION' END AS label, count(*) AS n FROM sentences WHERE segment_id % 4 < 2 GROUP BY 1, 2""")
simple("s8_merge_sources", """SELECT doc_id AS meeting_id,
CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'cached' END AS filename,
CASE WHEN doc_id % 3 <> 0 THEN n_chars / 10 END AS duration_sec, md5(text) AS full_text,
CASE WHEN doc_id % 2 = 0 AND n_chars % 5 > 0 THEN n_chars % 5 WHEN doc_id % 3 <> 0 THEN n_chars
 ELSE 0 END AS n_segments, CASE WHEN doc_id % 3 <> 0 THEN 'stored' ELSE 'cached' END AS origin
FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
simple("s9_normalise_types", f"""WITH {SEGMENTS} SELECT meeting_id, segment_id,
CASE WHEN segment_id % 5 = 2 THEN '' ELSE text END AS text,
CASE WHEN segment_id % 5 <> 3 THEN start_sec END AS start_sec,
CASE WHEN segment_id % 5 <> 4 THEN end_sec END AS end_sec,
CASE WHEN segment_id % 5 <> 0 THEN coalesce(speaker, 'S9') ELSE 'S9' END AS speaker FROM segments""")
simple("s10_parse_responses", f"""WITH {CANDIDATES} SELECT run_id, meeting_id, category, seg_from,
seg_from % 4 = 2 AS salvaged, seg_from % 4 = 3 AS rejected,
CASE WHEN seg_from % 4 <> 3 THEN item_text END AS item_text FROM candidates""")
simple("s11_response_schema", f"""WITH {CANDIDATES} SELECT run_id, CASE WHEN category = 'action_items' AND seg_from % 3 = 0
THEN 'follow_ups' ELSE category END AS category, count(*) AS n, sum(seg_from)::BIGINT AS seg_sum FROM candidates
WHERE seg_from % 4 <> 3 GROUP BY 1, 2""")
_h, _m, _s = clock_parts("d")
simple("s12_report_dataset", f"""WITH {VALIDATED}, heads AS (SELECT meeting_id, max(end_sec) AS d FROM segments GROUP BY 1),
c AS (SELECT meeting_id, count(*) FILTER (category = 'action_items') AS action_items,
 count(*) FILTER (category = 'decisions') AS decisions, count(*) FILTER (category = 'questions') AS questions
 FROM validated WHERE run_id = 1 GROUP BY 1)
SELECT meeting_id, 'meeting-' || meeting_id AS filename, CASE WHEN {_h} > 0 THEN {_h} || 'h ' ||
 lpad({_m}::VARCHAR, 2, '0') || 'm ' || lpad({_s}::VARCHAR, 2, '0') || 's' ELSE {_m} || 'm ' ||
 lpad({_s}::VARCHAR, 2, '0') || 's' END AS duration,
 CASE WHEN meeting_id % 2 = 0 THEN 'en' ELSE '—' END AS language, coalesce(action_items, 0) AS action_items,
 coalesce(decisions, 0) AS decisions, coalesce(questions, 0) AS questions FROM heads LEFT JOIN c USING (meeting_id)""")
simple("s14_previous_run", f"""WITH {VALIDATED}, v AS (SELECT meeting_id, run_id FROM validated
 WHERE run_id = 1 OR meeting_id % 3 <> 0) SELECT meeting_id, run_id, count(*) AS n FROM v
 WHERE run_id = (SELECT max(run_id) FROM v b WHERE b.meeting_id = v.meeting_id) GROUP BY 1, 2""")

# --- text ----------------------------------------------------------------------------------------
simple("p1_norm", f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM documents")
simple("p2_without_fillers", f"""WITH {SEGMENTS} SELECT meeting_id, segment_id,
{norm(f"regexp_replace(text, {q(V.FILLER)}, '', 'g')")} AS clean FROM segments""")
simple("p3_units", f"""SELECT doc_id, i - 1 AS unit_no, md5(x) AS md5 FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i
FROM (SELECT doc_id, {units('text')} AS p FROM documents))""")
simple("p3_sentences", f"WITH {DOC_SENTENCES} SELECT doc_id, sentence_no, md5(sentence) AS md5 FROM docsents")
simple("p4_tokens", f"""SELECT doc_id, len({words('text')}) AS words, len({letter_words('text')}) AS letter_words,
md5(array_to_string({letter_words('text')}, ' ')) AS md5 FROM documents""")
simple("p5_content_tokens", f"""WITH {SEGMENTS} SELECT meeting_id, segment_id,
array_to_string({content_words('text')}, ' ') AS topic_words,
array_to_string({content_words('text', V.LABEL_STOP)}, ' ') AS label_words FROM segments""")
simple("p6_lemmas", f"""WITH {SEGMENTS}, t AS (SELECT meeting_id, segment_id, unnest(w) AS token,
generate_subscripts(w, 1) - 1 AS pos FROM (SELECT *, {content_words('text')} AS w FROM segments))
SELECT meeting_id, segment_id, pos, token, {cases('token', V.LEMMAS, 'token')} AS lemma FROM t""")
simple("p7_terms", f"WITH {SEGMENTS} SELECT meeting_id, segment_id, array_to_string({terms('text')}, ' ') AS terms FROM segments")
simple("p8_full_text", f"""WITH {SEGMENTS}, f AS (SELECT meeting_id, string_agg({norm('text')}, ' ' ORDER BY segment_id) AS t
FROM segments WHERE {norm('text')} <> '' GROUP BY 1) SELECT meeting_id, md5(t) AS text_md5, length(t) AS characters FROM f""")
_h, _m, _s = clock_parts("duration_sec")
simple("p9_clock", f"""WITH {MEETINGS} SELECT id, CASE WHEN duration_sec IS NULL THEN 'Time unavailable' ELSE
CASE WHEN {_h} > 0 THEN lpad({_h}::VARCHAR, 2, '0') || ':' ELSE '' END || lpad({_m}::VARCHAR, 2, '0') || ':' ||
lpad({_s}::VARCHAR, 2, '0') END AS clock, CASE WHEN coalesce(duration_sec, 0) = 0 THEN '—' WHEN {_h} > 0
THEN {_h} || 'h ' || lpad({_m}::VARCHAR, 2, '0') || 'm ' || lpad({_s}::VARCHAR, 2, '0') || 's'
ELSE {_m} || 'm ' || lpad({_s}::VARCHAR, 2, '0') || 's' END AS duration FROM meetings""")
simple("p10_dates", f"""WITH {MEETINGS} SELECT id, CASE WHEN id % 7 = 0 THEN 'last Tuesday' WHEN id % 7 = 1 THEN '—'
ELSE strftime(uploaded_at, '%d %b %Y, %H:%M') || ' UTC' END AS shown FROM meetings""")
simple("p11_rounding", "SELECT event_id, round(value / 7, 3) AS seconds FROM events")
simple("p12_language", f"""WITH {MEETINGS} SELECT id, CASE WHEN id % 5 = 0 OR id % 3 = 2 THEN '' WHEN id % 3 = 0 THEN 'en'
ELSE 'pt-br' END AS tag, CASE WHEN id % 5 = 0 OR id % 3 = 2 THEN '' WHEN id % 3 = 0 THEN 'en' ELSE 'pt' END
AS "primary" FROM meetings""")
simple("p13_word_counts", f"""SELECT conv_id AS meeting_id, sum(len({space_words('text')}))::BIGINT AS words,
count(*) AS segments FROM conversations GROUP BY 1""")
simple("p14_highlights", f"""WITH {SEGMENTS}, p AS (SELECT meeting_id, segment_id,
string_split(lower(text), 'on') AS parts FROM segments)
SELECT meeting_id, segment_id, len(parts) - 1 AS hits, array_to_string(list_transform(range(1, len(parts)),
 lambda i: (list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + 2 * (i - 1))::VARCHAR), ',') AS at FROM p""")
_blocks = """blocks AS (SELECT meeting_id, segment_id // 16384 AS b, sha256(string_agg(concat_ws(chr(31),
 segment_id::VARCHAR, coalesce(speaker, chr(2)), {t}), chr(30) ORDER BY segment_id)) AS h FROM segments GROUP BY 1, 2)""".format(t=norm("text"))
HASHES = f"{_blocks}, hashes AS (SELECT meeting_id, sha256(string_agg(h, chr(30) ORDER BY b)) AS input_hash FROM blocks GROUP BY 1)"
CONFIG_TEXT = "budget=16384;model=none;temperature=0"
simple("p15_digest", f"WITH {SEGMENTS}, {HASHES} SELECT * FROM hashes")
simple("p16_compact_evidence", f"""WITH {SEGMENTS} SELECT meeting_id, segment_id, '' AS evidence,
CASE segment_id % 3 WHEN 0 THEN segment_id::VARCHAR WHEN 1 THEN segment_id || ',' || (segment_id + 4)
ELSE segment_id || ',' || (segment_id + 2) || ',' || (segment_id + 3) END AS ids FROM segments""")
_shown = lambda c: f"CASE WHEN length({c}) % 2 = 0 THEN upper({c}) ELSE {c} END"
_item = _shown("item_text")
simple("p17_display_text", f"""WITH {CANDIDATES} SELECT run_id, meeting_id, category, seg_from,
CASE WHEN category = 'action_items' THEN {_item} END AS task, CASE WHEN category = 'decisions' THEN {_item} END AS decision,
CASE WHEN category = 'questions' THEN {_item} END AS question, {_shown('evidence')} AS evidence, owner,
{_shown('deadline')} AS deadline, 'SEG_1' AS label FROM candidates""")

# --- predicates ------------------------------------------------------------------------------------
for _name, _rule in (("f1_actions", is_action), ("f2_decisions", is_decision),
                     ("f3_open_issues", lambda c: rx(c, V.OPEN_ISSUE)),
                     ("f4_meaningful_questions", is_question)):
    simple(_name, f"""WITH {SENTENCES} SELECT meeting_id, segment_id, sentence_no, sentence FROM sentences
WHERE {_rule('sentence')}""")
simple("f5_substantive", f"""WITH {SENTENCES} SELECT meeting_id, arg_min(segment_id, (segment_id, sentence_no)) AS segment_id,
arg_min(sentence_no, (segment_id, sentence_no)) AS sentence_no, sentence FROM sentences
WHERE {substantive('sentence')} GROUP BY meeting_id, sentence""")
simple("f6_topic_labels", f"""WITH {SEGMENTS} SELECT meeting_id, segment_id, text AS label FROM segments
WHERE segment_id % 6 > 1 AND lower({norm('text')}) NOT IN {qin(V.GENERIC_TOPICS)}""")
simple("f7_whole_word", f"""WITH {CANDIDATES} SELECT run_id, meeting_id, seg_from, owner,
{has_word('item_text', 'owner')} AS named, {has_word('item_text', "'end of week'")} AS week,
{has_word('item_text', "'repo'")} AS part_of_word FROM candidates WHERE owner IS NOT NULL""")
simple("f8_search", f"""WITH {VALIDATED} SELECT DISTINCT s.meeting_id, s.segment_id, s.text FROM segments s
JOIN validated v ON v.meeting_id = s.meeting_id AND s.segment_id BETWEEN v.seg_from AND v.seg_to
AND v.category = 'decisions' WHERE contains(lower(s.text), 'release')""")
simple("f9_search_meetings", f"WITH {MEETINGS} SELECT id, filename FROM meetings WHERE lower(filename) LIKE '%urgent-1%'")
simple("f10_uploads", f"""WITH {MEETINGS}, u AS (SELECT *, lower(right(filename, 4)) AS ext FROM meetings)
SELECT id, CASE WHEN ext <> '.pdf' THEN ext WHEN id % 2 = 0 THEN '.mp3' END AS extension,
CASE WHEN ext = '.pdf' AND id % 2 = 1 THEN 415 WHEN (coalesce(duration_sec, 0) * 150000)::BIGINT > {V.MAX_UPLOAD_BYTES}
THEN 413 ELSE 200 END AS code FROM u""")
simple("f11_summary_points", f"""WITH {SEGMENTS}, p AS (SELECT meeting_id, segment_id AS point_no,
 {norm('text')} AS point FROM segments WHERE segment_id < 6 AND segment_id % 5 <> 4 AND segment_id <> 1)
SELECT meeting_id, min(point_no) AS point_no, point FROM p WHERE len({space_words('point')}) <= 32 GROUP BY 1, 3""")

# --- extraction --------------------------------------------------------------------------------------
simple("x1_owner", f"""WITH {SEGMENTS} SELECT * FROM (SELECT meeting_id, segment_id,
{owner('text', 'speaker')} AS owner FROM segments) WHERE owner IS NOT NULL""")
simple("x2_deadline", f"""WITH {SEGMENTS} SELECT * FROM (SELECT meeting_id, segment_id, {deadline('text')} AS deadline
FROM segments) WHERE deadline IS NOT NULL""")
simple("x3_priority", f"""WITH {SEGMENTS} SELECT * FROM (SELECT meeting_id, segment_id, {priority('text')} AS priority
FROM segments) WHERE priority IS NOT NULL""")
simple("x4_status", f"""WITH {SEGMENTS} SELECT meeting_id, segment_id, CASE WHEN segment_id % 9 = 0 THEN 'Blocked'
ELSE {status('text')} END AS status FROM segments""")
simple("x5_action_table", f"""WITH {SENTENCES}, a AS (SELECT *, trim(sentence) AS task, row_number() OVER (
 PARTITION BY meeting_id, lower(trim(sentence)) ORDER BY segment_id, sentence_no) AS rn FROM sentences
 WHERE {is_action('sentence')}) SELECT meeting_id, segment_id, sentence_no, task, {owner('task')} AS owner,
 {deadline('task')} AS deadline, {status('task')} AS status FROM a WHERE rn = 1""")
simple("x6_decision_table", f"""WITH {SENTENCES}, a AS (SELECT *, row_number() OVER (
 PARTITION BY meeting_id, lower(trim(sentence)) ORDER BY segment_id, sentence_no) AS rn FROM sentences
 WHERE {is_decision('sentence')}) SELECT meeting_id, segment_id, sentence_no, trim(sentence) AS statement
 FROM a WHERE rn = 1""")
simple("x7_question_table", f"""WITH {SENTENCES}, a AS (SELECT *, row_number() OVER (
 PARTITION BY meeting_id, lower(trim(sentence)) ORDER BY segment_id, sentence_no) AS rn FROM sentences
 WHERE {is_question('sentence')}) SELECT meeting_id, segment_id, sentence_no, trim(sentence) AS question,
 {rx('sentence', V.OPEN_ISSUE)} AS is_action_required, CASE WHEN {rx('sentence', V.OPEN_ISSUE)}
 THEN 'Marked open in this excerpt' ELSE 'Not assessed' END AS resolution_status FROM a WHERE rn = 1""")
simple("x8_tidy_questions", f"""WITH {SEGMENTS}, c AS (SELECT meeting_id, segment_id, trim(regexp_replace(
 CASE WHEN segment_id % 2 = 0 THEN 'okay, ' ELSE '' END || text, {q(V.OPENER)}, '')) AS t FROM segments)
SELECT meeting_id, segment_id, upper(t[1]) || t[2:] || CASE WHEN t LIKE '%?' THEN '' ELSE '?' END AS tidy FROM c""")
GAZETTEER = f""", grams AS (SELECT meeting_id, segment_id, i AS word_no, n, array_to_string(w[i:i + n - 1], ' ') AS entity
 FROM (SELECT meeting_id, segment_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *,
  regexp_extract_all(text, {q(V.WORD)}) AS w FROM segments)) CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)
 WHERE i + n - 1 <= len(w)),
 entities AS (SELECT meeting_id, segment_id, word_no, entity, CASE WHEN n = 1 AND entity IN {qin(V.TECH_WORDS)}
  OR n > 1 AND lower(entity) IN {qin(V.TECH_PHRASES)} THEN 'TECHNOLOGY'
  WHEN regexp_matches(lower(entity), '^(phase|sprint|version) [0-9]+$') THEN 'PROJECT' END AS label FROM grams)"""
simple("x9_gazetteer", f"WITH {SEGMENTS}{GAZETTEER} SELECT meeting_id, segment_id, word_no, entity, label FROM entities WHERE label IS NOT NULL")
simple("x10_entity_labels", f"""WITH {SEGMENTS}, e AS (SELECT meeting_id, segment_id,
 regexp_extract(text, '^(\\w+)', 1) AS entity, CASE WHEN segment_id % 4 = 0 THEN 'ORG' WHEN segment_id % 2 = 0
 THEN 'PERSON' ELSE 'PROJECT' END AS label FROM segments)
SELECT meeting_id, min(segment_id) AS segment_id, arg_min(entity, segment_id) AS entity, label FROM e
GROUP BY meeting_id, lower(entity), label""")
simple("x11_valid_entities", f"""WITH {SEGMENTS}, e AS (SELECT meeting_id, segment_id,
 regexp_extract(text, '^(\\w+)', 1) AS entity, CASE segment_id % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'PERSON'
 ELSE 'TECHNOLOGY' END AS label FROM segments)
SELECT * FROM e WHERE length(entity) >= 2 AND lower(entity) NOT IN {qin(V.TOPIC_STOP)}
AND (label <> 'DATE' OR {rx('entity', V.DATE_WORDS)})
AND (label <> 'PERSON' OR (regexp_matches(entity, '^\\p{{Lu}}') AND lower(entity) NOT IN {qin(V.NEVER_NAMES)}))""")
simple("x12_candidate_entities", f"""WITH {SEGMENTS}, f AS (SELECT meeting_id, lower(string_agg({norm('text')}, ' '
 ORDER BY segment_id)) AS t, bool_or(coalesce(lower(speaker) = 'speaker 1', FALSE)) AS sp1 FROM segments GROUP BY 1),
n AS (SELECT unnest([('people', 'Alice'), ('people', 'Speaker 1'), ('products', 'Docker'),
 ('products', 'machine learning'), ('dates', 'end of week'), ('dates', 'Sunday'), ('people', 'Ali')]) AS p)
SELECT meeting_id, p[1] AS group_name, p[2] AS name FROM f CROSS JOIN n
WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(lower(p[2])) || '([^\\p{{L}}\\p{{N}}_]|$)')
 OR (p[2] = 'Speaker 1' AND sp1)""")

# --- joins ---------------------------------------------------------------------------------------------
_quotes = """SELECT meeting_id, CASE segment_id % 5 WHEN 0 THEN text WHEN 1 THEN concat_ws(' ', text, nxt)
 WHEN 2 THEN substr(text, 3, 14) WHEN 3 THEN substr(text, 2, 5) ELSE 'Well, ' || text END AS quote FROM (
 SELECT *, lead(text) OVER (PARTITION BY meeting_id ORDER BY segment_id) AS nxt FROM segments)"""
simple("j1_locate_quotes", f"WITH {SEGMENTS}{located(_quotes)} SELECT * FROM located")
simple("j2_ground_by_ids", f"""WITH {SEGMENTS}{located("SELECT meeting_id, 'release' AS quote FROM segments")},
i AS (SELECT meeting_id, segment_id AS item_no, CASE WHEN segment_id % 2 = 0 THEN 'Not a quote' ELSE 'release' END
 AS quote, segment_id AS lo, segment_id + segment_id % 4 AS hi FROM segments),
s AS (SELECT i.meeting_id, i.item_no, string_agg(r.t, ' ' ORDER BY r.segment_id) AS span, count(*) AS n,
 arg_min(r.start_sec, r.segment_id) AS st, arg_min(r.sp, r.segment_id) AS sp FROM i JOIN rows_ r
 ON r.meeting_id = i.meeting_id AND r.segment_id BETWEEN i.lo AND i.hi GROUP BY 1, 2)
SELECT i.meeting_id, i.item_no,
 CASE WHEN l.is_unique THEN i.quote WHEN s.n = hi - lo + 1 THEN CASE WHEN contains(span, i.quote) THEN i.quote ELSE span END
  WHEN l.quote IS NOT NULL THEN i.quote END AS src_evidence,
 CASE WHEN l.is_unique THEN l.seg_from WHEN s.n = hi - lo + 1 THEN lo END AS src_from,
 CASE WHEN l.is_unique THEN l.seg_to WHEN s.n = hi - lo + 1 THEN hi END AS src_to,
 CASE WHEN l.is_unique THEN l.timestamp WHEN s.n = hi - lo + 1 THEN st END AS src_time,
 CASE WHEN l.is_unique THEN l.speaker WHEN s.n = hi - lo + 1 THEN nullif(s.sp, '') END AS src_speaker,
 CASE WHEN l.is_unique THEN 'quote' WHEN s.n = hi - lo + 1 THEN 'ids' WHEN l.quote IS NOT NULL THEN 'ambiguous' END AS src_kind
FROM i JOIN s USING (meeting_id, item_no) LEFT JOIN located l ON l.meeting_id = i.meeting_id AND l.quote = i.quote""")
simple("j3_valid_evidence", f"""WITH {CANDIDATES} SELECT run_id, meeting_id, category, greatest(seg_from - 1, 0) AS seg_from, seg_to
FROM candidates WHERE seg_from % 17 <> 0""")
simple("j4_fuzzy_evidence", f"""WITH {SEGMENTS}, f AS (SELECT meeting_id, string_agg({norm('text')}, ' ' ORDER BY segment_id) AS t
 FROM segments GROUP BY 1), qs AS (SELECT DISTINCT meeting_id, {norm("'So then ' || text || ' indeed'")} AS quote
 FROM segments), w AS (SELECT *, string_split(quote, ' ') AS ws FROM qs),
 d AS (SELECT w.*, l.x AS drop_left, r.x AS drop_right, array_to_string(ws[l.x + 1:len(ws) - r.x], ' ') AS matched
 FROM w CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS x) l CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS x) r
 WHERE len(ws) - l.x - r.x >= 1 AND len(ws) - l.x - r.x >= len(ws) * 0.6),
 ok AS (SELECT d.*, row_number() OVER (PARTITION BY d.meeting_id, quote ORDER BY drop_left, drop_right) AS rn
 FROM d JOIN f USING (meeting_id) WHERE length(matched) >= 15 AND contains(f.t, matched))
SELECT meeting_id, quote, drop_left, drop_right, matched FROM ok WHERE rn = 1""")
simple("j5_related_items", f"""WITH {VALIDATED} SELECT DISTINCT meeting_id, seg_from // 8 AS segment_index, category, text
FROM validated WHERE run_id = 1""")
simple("j6_segment_labels", f"""WITH {VALIDATED} SELECT DISTINCT meeting_id, seg_from AS segment_id,
CASE category WHEN 'action_items' THEN 'Actions' WHEN 'decisions' THEN 'Decisions' ELSE 'Questions' END AS label FROM validated""")
simple("j7_segment_at", f"""WITH {SEGMENTS}, p AS (SELECT user_id % 203 AS meeting_id, event_id AS point_id,
 (floor(epoch(ts)) % 700 - 20)::DOUBLE AS at_sec FROM events)
SELECT p.meeting_id, p.point_id, p.at_sec, coalesce(s.segment_id, 0) AS segment_id, coalesce(s.start_sec, 0) AS seconds
FROM p ASOF LEFT JOIN segments s ON p.meeting_id = s.meeting_id AND p.at_sec >= s.start_sec
WHERE p.meeting_id IN (SELECT meeting_id FROM segments)""")
simple("j8_jump_targets", f"""WITH {SEGMENTS}, e AS (SELECT meeting_id, segment_id AS evidence_id, start_sec, lower({norm('''CASE WHEN segment_id % 4 = 2
 THEN 'He said: ' || text || ' Right?' ELSE upper(substr(text, 1, 20)) END''')}) AS ev FROM segments),
x AS (SELECT e.meeting_id, e.evidence_id, min(s.segment_id) AS hit FROM e JOIN segments s USING (meeting_id)
 WHERE evidence_id % 4 > 1 AND (contains(lower({norm('s.text')}), ev) OR contains(ev, lower({norm('s.text')}))) GROUP BY 1, 2)
SELECT e.meeting_id, e.evidence_id, CASE WHEN e.evidence_id % 4 < 2 THEN e.evidence_id ELSE hit END AS segment_id,
CASE WHEN e.evidence_id % 4 < 2 THEN e.start_sec ELSE hit * 7.0 END::DOUBLE AS seconds,
CASE e.evidence_id % 4 WHEN 0 THEN 'segment-id' WHEN 1 THEN 'timestamp' ELSE CASE WHEN hit IS NOT NULL THEN 'text' END END AS reason
FROM e LEFT JOIN x USING (meeting_id, evidence_id)""")
simple("j9_citations", f"""WITH a AS (SELECT conv_id AS answer_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1)
SELECT answer_id, CASE WHEN answer_id % 3 = 0 AND answer_id % 6 <> 0 THEN 'Yes.' ELSE {q(V.NOT_FOUND)} END AS answer,
CASE WHEN answer_id % 3 = 0 AND answer_id % 6 <> 0 THEN CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || ',' || hi END ELSE '' END AS cited,
answer_id % 3 = 0 AND answer_id % 6 <> 0 AS grounded FROM a""")
simple("j10_translation_work", f"""WITH {CANDIDATES}, t AS (SELECT item_text AS source FROM candidates
 UNION SELECT evidence FROM candidates UNION SELECT deadline FROM candidates)
SELECT source, sha256('english-v1' || chr(31) || source) AS text_key FROM t WHERE length(source) % 2 = 1""")
simple("j11_to_analyse", f"WITH {SEGMENTS} SELECT DISTINCT meeting_id, sha256({q(CONFIG_TEXT)}) AS config_hash FROM segments WHERE meeting_id % 5 < 3")
simple("j13_similar_vectors", f"""WITH {UNITS}, d AS (SELECT meeting_id, v, min(segment_id) AS id FROM units GROUP BY 1, 2)
SELECT a.meeting_id, a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM d a JOIN d b
ON a.meeting_id = b.meeting_id AND a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.25 - 1e-9""")
_pair = f"""o.meeting_id = n.meeting_id AND o.category = n.category AND o.seg_from = n.seg_from AND o.seg_to = n.seg_to
 AND o.run_id = 1 AND n.run_id = 2 AND (contains(o.evidence, n.evidence) OR contains(n.evidence, o.evidence))
 AND {jaccard(terms('o.text'), terms('n.text'))} >= 0.5"""
simple("j14_conflicts", f"""WITH {VALIDATED} SELECT o.meeting_id, o.category, o.seg_from AS o_from, o.text AS o_text, n.seg_from AS n_from, n.text AS n_text FROM validated o
JOIN validated n ON {_pair} AND NOT (o.category = 'action_items' AND (coalesce(o.owner <> CASE WHEN n.seg_from % 2 = 0
 THEN 'Zed' ELSE n.owner END, FALSE) OR coalesce(o.deadline <> n.deadline, FALSE)))""")

# --- aggregations --------------------------------------------------------------------------------------
_model = "CASE WHEN length(sentence) % 3 = 0 THEN 'INFORMATION' ELSE 'ACTION ITEM' END"
RULED = SENTENCES + f""", ruled AS (SELECT *, {_model} AS model_label, CASE WHEN {is_decision('sentence')} THEN 'DECISION'
 WHEN {is_action('sentence')} THEN 'ACTION ITEM' WHEN contains(sentence, '?') OR {rx('sentence', V.OPEN_ISSUE)} THEN 'QUESTION'
 WHEN {_model} = 'ACTION ITEM' OR length(sentence) % 10 / 10.0 < 0.55 THEN 'DISCUSSION' ELSE {_model} END AS label FROM sentences)"""
simple("a1_class_counts", f"WITH {RULED} SELECT meeting_id, label, count(*) AS n FROM ruled GROUP BY 1, 2")
simple("m2b_rule_cascade", f"WITH {RULED} SELECT meeting_id, segment_id, sentence_no, model_label, label FROM ruled")
simple("a2_insight_counts", f"""WITH {VALIDATED}, r AS (SELECT meeting_id, category, coalesce(status, '-') AS status FROM validated WHERE run_id = 1)
SELECT meeting_id, coalesce(category, '(all)') AS category, coalesce(status, '(all)') AS status, count(*) AS n FROM r
GROUP BY GROUPING SETS ((meeting_id, category, status), (meeting_id, category), (meeting_id))""")
simple("a3_speaker_stats", f"""WITH {SEGMENTS}, t AS (SELECT *, end_sec - start_sec AS d, speaker IS NOT NULL AND speaker IS DISTINCT FROM
 lag(speaker) OVER (PARTITION BY meeting_id ORDER BY segment_id) AS starts FROM segments),
m AS (SELECT meeting_id, sum(d) AS total, sum(d) FILTER (speaker IS NOT NULL) AS covered FROM t GROUP BY 1)
SELECT meeting_id, speaker, sum(d) AS seconds, count(*) FILTER (starts) AS turns, round(sum(d) / any_value(total) * 100, 6) AS percentage,
round(any_value(covered) / any_value(total), 6) AS coverage FROM t JOIN m USING (meeting_id) WHERE speaker IS NOT NULL GROUP BY 1, 2""")
simple("a4_speaker_count", f"WITH {SEGMENTS} SELECT meeting_id, nullif(count(DISTINCT speaker), 0) AS speaker_count FROM segments GROUP BY 1")
simple("a5_history_totals", f"""WITH {MEETINGS} SELECT count(*) AS meetings, round(sum(coalesce(duration_sec, 0)), 2) AS total,
round(avg(coalesce(duration_sec, 0)), 6) AS average, count(*) FILTER (status = 'done') AS done,
count(*) FILTER (status <> 'done') AS pending FROM meetings""")
simple("a6_uploads_per_day", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
simple("a7_entities_by_label", f"""WITH {SEGMENTS}{GAZETTEER}, d AS (SELECT DISTINCT meeting_id, label, entity FROM entities WHERE label IS NOT NULL)
SELECT meeting_id, label, count(*) AS n, string_agg(entity, ', ' ORDER BY entity) AS names FROM d GROUP BY 1, 2""")
TOPICS = SEGMENTS + """, topic_segs AS (SELECT meeting_id, segment_id // 8 AS segment_index, (segment_id // 8) % 5 AS canonical_topic_id,
 min(start_sec) AS start_time, max(end_sec) AS end_time, count(*) AS sentence_count FROM segments GROUP BY 1, 2, 3)"""
_summary = """SELECT meeting_id, canonical_topic_id, count(*) AS occurrence_count, min(segment_index) AS first_segment_index,
 min(start_time) AS first_start_time, sum(sentence_count)::BIGINT AS total_sentences FROM topic_segs GROUP BY 1, 2"""
simple("a8_topic_summary", f"WITH {TOPICS} {_summary}")
simple("a9_topic_evolution", f"""WITH {VALIDATED}, rel AS (SELECT DISTINCT meeting_id, seg_from // 8 AS segment_index, category, text FROM validated WHERE run_id = 1),
 topic_segs AS (SELECT meeting_id, segment_id // 8 AS segment_index, (segment_id // 8) % 5 AS canonical_topic_id, min(start_sec) AS start_time,
 max(end_sec) AS end_time FROM segments GROUP BY 1, 2, 3)
SELECT t.meeting_id, canonical_topic_id, t.segment_index, start_time, end_time, count(*) FILTER (category = 'action_items') AS related_action_items,
count(*) FILTER (category = 'decisions') AS related_decisions, count(*) FILTER (category = 'questions') AS related_questions
FROM topic_segs t LEFT JOIN rel USING (meeting_id, segment_index) GROUP BY ALL""")
_clash = """(a.category = 'action_items' AND (coalesce(a.owner <> b.owner, FALSE) OR coalesce(a.deadline <> b.deadline, FALSE)))"""


def merged(group: str, pos: str, source: str = "validated") -> str:
    join = " AND ".join(f"a.{g} = b.{g}" for g in group.split(", "))
    keyed = f"(SELECT *, {pos} AS pos, {terms('text')} AS w FROM {source})"
    return f""", keepers AS (SELECT a.*, (SELECT min(b.pos) FROM {keyed} b WHERE {join} AND b.pos <= a.pos
 AND (contains(a.evidence, b.evidence) OR contains(b.evidence, a.evidence)) AND NOT {_clash}
 AND {jaccard('a.w', 'b.w')} >= 0.72) AS keeper FROM {keyed} a),
 merged AS (SELECT {group}, keeper AS pos, arg_min(text, pos) AS text, arg_min(evidence, (-length(evidence), pos)) AS evidence,
 arg_min(owner, pos) FILTER (owner IS NOT NULL) AS owner, arg_min(deadline, pos) FILTER (deadline IS NOT NULL) AS deadline,
 arg_min(priority, pos) FILTER (priority IS NOT NULL) AS priority, arg_min(status, pos) AS status, count(*) AS merged
 FROM keepers GROUP BY {group}, keeper)"""


_place = "row_number() OVER (PARTITION BY run_id, meeting_id, category ORDER BY seg_from NULLS LAST, seg_to NULLS LAST, text, evidence) - 1"
simple("a10_funnel", f"""WITH {VALIDATED}{merged('run_id, meeting_id, category', _place)},
 v AS (SELECT run_id, category, count(*) AS n FROM validated GROUP BY 1, 2),
 k AS (SELECT run_id, category, count(*) AS n FROM merged GROUP BY 1, 2)
SELECT run_id, category, v.n AS generated, v.n AS parsed, v.n AS evidence_matched, v.n AS validated, k.n AS deduplicated
FROM v JOIN k USING (run_id, category)""")
simple("a11_distribution", f"""WITH {TOPICS}, m AS (SELECT meeting_id, sum(sentence_count) AS total FROM topic_segs GROUP BY 1)
SELECT meeting_id, canonical_topic_id, sum(sentence_count)::BIGINT AS sentences, round(sum(sentence_count) / any_value(total), 6) AS share,
round(max(sentence_count / total), 6) AS widest FROM topic_segs JOIN m USING (meeting_id) GROUP BY 1, 2""")
simple("a12_overview", f"""WITH {TOPICS}, s AS ({_summary}) SELECT meeting_id, count(*) AS topics, sum(occurrence_count)::BIGINT AS segments,
arg_min(canonical_topic_id, (-total_sentences, canonical_topic_id)) AS most_discussed,
CASE WHEN max(occurrence_count) > 1 THEN arg_min(canonical_topic_id, (-occurrence_count, canonical_topic_id)) END AS most_revisited
FROM s GROUP BY 1""")
simple("a13_mean_vectors", f"""WITH {UNITS}, e AS (SELECT meeting_id, segment_id // 7 AS segment_index, segment_id, unnest(v) AS x,
 generate_subscripts(v, 1) AS d FROM units), m AS (SELECT meeting_id, segment_index, d, avg(x) AS x, count(*) AS units FROM e GROUP BY 1, 2, 3)
SELECT meeting_id, segment_index, max(units) AS units, string_agg((round(x / l * 10000))::BIGINT::VARCHAR, ',' ORDER BY d)
 AS vector FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY meeting_id, segment_index)) + 1e-9 AS l FROM m) GROUP BY 1, 2""")


def tfidf_sql(key: str, doc: str, source: str, limit: int) -> str:
    grams = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""tf AS (SELECT {key}, {doc}, term, count(*) AS tf FROM (SELECT {key}, {doc}, unnest({grams}) AS term FROM {source}) GROUP BY 1, 2, 3),
 sizes AS (SELECT {key}, count(*) AS n FROM {source} GROUP BY 1),
 voc AS (SELECT {key}, term, count(*) AS df, row_number() OVER (PARTITION BY {key} ORDER BY sum(tf) DESC, term) AS rn FROM tf GROUP BY 1, 2),
 raw AS (SELECT {key}, {doc}, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN voc USING ({key}, term)
  JOIN sizes USING ({key}) WHERE rn <= {limit}),
 weights AS (SELECT {key}, {doc}, term, x / sqrt(sum(x * x) OVER (PARTITION BY {key}, {doc})) AS w FROM raw)"""


simple("a14_keywords", f"""WITH {DOC_SENTENCES}, toks AS (SELECT doc_id, sentence_no, {content_words('sentence')} AS w FROM docsents),
{tfidf_sql('doc_id', 'sentence_no', 'toks', 5000)}, scored AS (SELECT doc_id, term, round(sum(w), 6) AS score FROM weights GROUP BY 1, 2)
SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM scored
QUALIFY rank <= 20""")
simple("a15_stability", f"""WITH {VALIDATED}, i AS (SELECT DISTINCT run_id, category, meeting_id, seg_from, seg_to FROM validated),
 b AS (SELECT * FROM i WHERE run_id = 1), s AS (SELECT category, count(*) AS n FROM b GROUP BY 1)
SELECT i.run_id, i.category, count(b.run_id) AS common, count(*) + any_value(s.n) - count(b.run_id) AS either,
round(count(b.run_id) / (count(*) + any_value(s.n) - count(b.run_id)), 6) AS jaccard FROM i LEFT JOIN b
ON (i.category, i.meeting_id, i.seg_from, i.seg_to) = (b.category, b.meeting_id, b.seg_from, b.seg_to)
JOIN s ON s.category = i.category GROUP BY 1, 2""")
simple("a16_classification_report", """WITH p AS (SELECT quality::VARCHAR AS label, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS predicted
 FROM labels JOIN documents USING (doc_id)), c AS (SELECT l.label, count(*) FILTER (p.label = l.label AND predicted = l.label) AS tp,
 count(*) FILTER (p.label = l.label) AS support, count(*) FILTER (predicted = l.label) AS given FROM p
 CROSS JOIN (SELECT DISTINCT label FROM p) l GROUP BY 1),
 m AS (SELECT label, coalesce(tp / nullif(given, 0), 0.0) AS pr, tp / support AS re, support FROM c),
 f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0.0) AS f1 FROM m)
SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
 round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""")
simple("a18_window_diff", """WITH u AS (SELECT vec_id // 50 AS meeting_id, vec_id % 50 AS s, label AS r, (vec_id % 50) // 6 AS h FROM embeddings),
 f AS (SELECT *, (r <> lag(r) OVER w)::INT AS br, (h <> lag(h) OVER w)::INT AS bh FROM u WINDOW w AS (PARTITION BY meeting_id ORDER BY s)),
 g AS (SELECT meeting_id, sum(br) OVER x AS sr, sum(bh) OVER x AS sh, lead(s, 3) OVER (PARTITION BY meeting_id ORDER BY s) AS far FROM f
 WINDOW x AS (PARTITION BY meeting_id ORDER BY s ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT meeting_id, round(avg((sr <> sh)::INT), 6) AS window_diff FROM g WHERE far IS NOT NULL GROUP BY 1""")
simple("a19_grounding_rate", f"""WITH {CANDIDATES}, f AS (SELECT meeting_id, string_agg({norm('text')}, ' ' ORDER BY segment_id) AS t FROM segments GROUP BY 1)
SELECT run_id, category, count(*) AS items, count(*) FILTER (contains(t, {norm('evidence')})) AS grounded,
round(count(*) FILTER (contains(t, {norm('evidence')})) / count(*), 6) AS rate FROM candidates JOIN f USING (meeting_id) GROUP BY 1, 2""")

# --- windows ---------------------------------------------------------------------------------------------
simple("w1_turn_starts", """SELECT conv_id AS meeting_id, turn AS segment_id, role AS speaker, role IS NOT NULL AND role IS DISTINCT FROM
lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS is_turn_start FROM conversations""")
simple("w2_context_windows", f"""SELECT conv_id AS meeting_id, turn AS segment_id, md5(string_agg({norm('text')}, ' ') OVER (PARTITION BY conv_id
ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS window_md5 FROM conversations""")
_mean = "list_transform(range(1, len({0}[1]) + 1), lambda i: ({0}[1][i] + {0}[2][i] + {0}[3][i]) / 3)"
NOVELTY = UNITS + f""", near AS (SELECT meeting_id, segment_id, list(v) OVER (PARTITION BY meeting_id ORDER BY segment_id
 ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, list(v) OVER (PARTITION BY meeting_id ORDER BY segment_id
 ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS r, lead(segment_id, 3) OVER (PARTITION BY meeting_id ORDER BY segment_id) AS far FROM units),
 means AS (SELECT meeting_id, segment_id, {_mean.format('l')} AS a, {_mean.format('r')} AS b FROM near WHERE len(l) = 3 AND far IS NOT NULL),
 novelty AS (SELECT u.meeting_id, u.segment_id, coalesce(round(1 - list_dot_product(a, b) / ((sqrt(list_dot_product(a, a)) + 1e-9)
 * (sqrt(list_dot_product(b, b)) + 1e-9)), 9), 0.0) AS x FROM units u LEFT JOIN means USING (meeting_id, segment_id))"""
SMOOTHED = NOVELTY + """, smoothed AS (SELECT meeting_id, segment_id, round((coalesce(lag(x, 2) OVER w, lag(x) OVER w, lead(x) OVER w)
 + coalesce(lag(x) OVER w, x) + x + coalesce(lead(x) OVER w, x) + coalesce(lead(x, 2) OVER w, lead(x) OVER w, lag(x) OVER w)) / 5, 9) AS y
 FROM novelty WINDOW w AS (PARTITION BY meeting_id ORDER BY segment_id)),
 limits AS (SELECT meeting_id, round(avg(y) + 0.08 * stddev_pop(y), 9) AS threshold, count(*) AS units FROM smoothed GROUP BY 1)"""
simple("w3_novelty", f"WITH {NOVELTY} SELECT meeting_id, segment_id, round(x, 4) AS novelty FROM novelty")
simple("w4_smooth", f"WITH {SMOOTHED} SELECT meeting_id, segment_id, round(y, 4) AS smoothed FROM smoothed")
simple("w5_thresholds", f"WITH {SMOOTHED} SELECT meeting_id, round(threshold, 4) AS threshold, units FROM limits")
simple("w6_peaks", f"""WITH {SMOOTHED}, c AS (SELECT *, sum(ch) OVER (PARTITION BY meeting_id ORDER BY segment_id) AS island FROM (
 SELECT *, (y IS DISTINCT FROM lag(y) OVER (PARTITION BY meeting_id ORDER BY segment_id))::INT AS ch FROM smoothed)),
 i AS (SELECT meeting_id, island, min(segment_id) AS a, max(segment_id) AS b, any_value(y) AS y FROM c GROUP BY 1, 2),
 n AS (SELECT *, lag(y) OVER w AS lo, lead(y) OVER w AS hi FROM i WINDOW w AS (PARTITION BY meeting_id ORDER BY island))
SELECT meeting_id, (a + b) // 2 AS segment_id FROM n JOIN limits USING (meeting_id) WHERE y > lo AND y > hi AND y >= threshold AND units >= 5""")
simple("w8_topic_segments", f"""WITH {SEGMENTS}, m AS (SELECT *, sum((segment_id % 9 = 0 OR segment_id % 5 = 3)::INT) OVER (PARTITION BY meeting_id
 ORDER BY segment_id) - 1 AS segment_index FROM segments)
SELECT meeting_id, segment_index::BIGINT AS segment_index, min(segment_id) AS unit_start, max(segment_id) + 1 AS unit_end,
min(start_sec) AS start_time, max(end_sec) AS end_time, count(*) AS sentence_count,
left(array_to_string((list({norm('text')} ORDER BY segment_id))[1:2], ' '), 300) AS excerpt FROM m GROUP BY 1, 2""")
simple("w9_history", """SELECT conv_id, turn, role, md5(right(text, 400)) AS text_md5 FROM conversations WHERE role IN ('user', 'assistant')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")
simple("w10_relabel", """WITH u AS (SELECT vec_id // 50 AS meeting_id, vec_id % 50 AS segment_index, label AS cluster FROM embeddings),
 f AS (SELECT meeting_id, cluster, row_number() OVER (PARTITION BY meeting_id ORDER BY min(segment_index)) - 1 AS canonical_topic_id
 FROM u GROUP BY 1, 2) SELECT meeting_id, segment_index, cluster, canonical_topic_id FROM u JOIN f USING (meeting_id, cluster)""")

# --- order, sets, chunks -----------------------------------------------------------------------------------
simple("k1_newest_first", ORACLES["s3_meeting_list"] + " ORDER BY uploaded_at DESC NULLS LAST, id")
_id = f"substr({digest('meeting_id', 'category', 'seg_from', 'seg_to', DIGEST_NULL)}, 1, 24)"
simple("k5_report_order", f"WITH {VALIDATED} SELECT meeting_id, category, seg_from, seg_to, {_id} AS id FROM validated WHERE run_id = 1 ORDER BY ALL")
simple("u1_open_questions", f"""WITH {VALIDATED} SELECT meeting_id, seg_from, text AS question, evidence, CASE WHEN category = 'questions'
THEN 'question' ELSE 'follow_up' END AS kind FROM validated WHERE run_id = 1 AND (category = 'questions' AND status <> 'Resolved'
OR category = 'action_items' AND seg_from % 2 = 0)""")
simple("u2_merge_entities", f"WITH {SEGMENTS}{GAZETTEER} SELECT DISTINCT meeting_id, label AS group_name, entity AS name FROM entities WHERE label IS NOT NULL")
simple("u2_merge_summaries", f"""WITH {SENTENCES} SELECT meeting_id, sentence AS point, min(segment_id) // 16 AS chunk_no, min(segment_id) AS point_no, 'turn ' || min(segment_id) AS evidence
FROM sentences GROUP BY 1, 2""")
simple("u3_id_overlap", f"""WITH {VALIDATED}, i AS (SELECT run_id, meeting_id, {_id} AS id FROM validated)
SELECT meeting_id, 'both' AS part, count(*) AS n FROM (SELECT meeting_id, id FROM i WHERE run_id = 1 INTERSECT SELECT meeting_id, id FROM i
 WHERE run_id = 2) GROUP BY 1 UNION ALL SELECT meeting_id, 'either', count(DISTINCT id) FROM i GROUP BY 1""")
simple("u4_stop_lists", f"""WITH {SEGMENTS} SELECT meeting_id, segment_id, array_to_string(list_sort(list_distinct(list_filter({words('text')},
lambda w: NOT list_contains({ql(V.TOPIC_STOP)}, w)))), ' ') AS rest FROM segments""")
simple("u5_legacy_view", f"""WITH {VALIDATED} SELECT meeting_id, category, seg_from, CASE WHEN category = 'action_items' THEN owner END AS person,
CASE WHEN category = 'action_items' THEN text END AS task, CASE WHEN category = 'decisions' THEN text END AS statement,
CASE WHEN category = 'questions' THEN text END AS question, CASE WHEN category = 'questions' THEN status END AS resolution_status,
evidence AS original FROM validated WHERE run_id = 1""")
simple("c1_character_chunks", """SELECT doc_id, i AS chunk_no, md5(substr(text, i * 400 + 1, 400)) AS chunk_md5 FROM (SELECT doc_id, text,
unnest(range(0, ceil(length(text) / 400)::INT)) AS i FROM documents)""")
simple("c2_token_windows", f"""SELECT doc_id, i AS window_no, md5(array_to_string(w[i * 128 + 1:i * 128 + 128], ' ')) AS window_md5 FROM (
SELECT doc_id, w, unnest(range(0, ceil(len(w) / 128)::INT)) AS i FROM (SELECT doc_id, {space_words('text')} AS w FROM documents))""")
simple("c6_choose_units", f"""WITH s AS (SELECT doc_id, {units("CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' One more. And more.' END")} AS p FROM documents)
SELECT doc_id AS meeting_id, i - 1 AS unit_no, md5(x) AS text_md5 FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM s)""")

# --- topics over meetings ------------------------------------------------------------------------------------
GROUPS = f"""RECURSIVE {SEGMENTS}{GAZETTEER}, t AS (SELECT meeting_id, min(segment_id) AS topic_id, entity AS label,
 CASE WHEN contains(entity, ' ') THEN 'plan release date' ELSE '' END AS kw FROM entities WHERE label IS NOT NULL GROUP BY meeting_id, entity),
 n AS (SELECT *, list_sort(list_distinct({words("label || ' ' || kw")})) AS w FROM t),
 d AS (SELECT DISTINCT w, array_to_string(w, ' ') AS node FROM n),
 e AS (SELECT a.node AS x, b.node AS y FROM d a JOIN d b ON len(list_intersect(a.w, b.w)) >= 0.68 * sqrt(len(a.w) * len(b.w)) - 1e-9),
 reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
 g AS (SELECT x AS node, min(y) AS topic_group FROM reach GROUP BY 1),
 o AS (SELECT n.*, topic_group FROM n JOIN g ON g.node = array_to_string(n.w, ' '))"""
simple("m7_cross_meeting", f"""WITH {GROUPS} SELECT topic_group, count(DISTINCT meeting_id) AS meeting_count, count(*) AS occurrences,
arg_min(label, (meeting_id, topic_id)) AS label, arg_min(kw, (meeting_id, topic_id)) AS keywords FROM o GROUP BY 1""")
simple("m7_occurrences", f"WITH {GROUPS} SELECT meeting_id, topic_id, label, kw AS keywords, topic_group FROM o")

# --- records ---------------------------------------------------------------------------------------------------
simple("r1_validate", f"""WITH {VALIDATED} SELECT run_id, meeting_id, category, text, seg_from, seg_to, evidence, timestamp, speaker, owner, deadline,
priority, status, reason FROM validated""")
_proven = "seg_from % 4 = 0 AND qt <> 'Unsupported promise.'"
simple("r2_question_status", f"""WITH {GROUNDED} SELECT run_id, meeting_id, category, src_from AS seg_from, CASE WHEN {_proven} THEN 'Resolved'
ELSE 'Not assessed' END AS status, CASE WHEN {_proven} THEN 'Next week.' END AS answer, CASE WHEN {_proven} THEN qt END AS answer_evidence,
seg_from % 4 <> 3 AND NOT ({_proven}) AS unproven_answer FROM grounded WHERE category = 'questions'""")
simple("r3_issues", f"""WITH {CANDIDATES}, b AS (SELECT run_id, meeting_id, CASE WHEN (meeting_id % 2 = 0 AND category = 'decisions')
 OR (meeting_id % 3 = 0 AND seg_from % 17 = 0) THEN category END AS issue FROM candidates)
SELECT run_id, meeting_id, coalesce(string_agg(DISTINCT issue, ',' ORDER BY issue), '') AS issues,
CASE WHEN count(issue) > 0 THEN 'partial' ELSE 'complete' END AS state FROM b GROUP BY 1, 2""")
CROWDED = VALIDATED + """, crowd AS (SELECT * FROM validated UNION ALL BY NAME SELECT * REPLACE ('Second point on violet harbour lanterns near quiet mills: ' || text AS text)
 FROM validated UNION ALL BY NAME SELECT * REPLACE ('Loose remark about seven amber kites over tall dunes: ' || text AS text, NULL::BIGINT AS seg_from, NULL::BIGINT AS seg_to,
 NULL::DOUBLE AS timestamp) FROM validated WHERE seg_from % 5 = 1)"""
simple("r4_deduplicate", f"""WITH {CROWDED}{merged('run_id, meeting_id, category', _place, 'crowd')}
SELECT run_id, meeting_id, category, pos, text, evidence, owner, deadline, priority, status, merged FROM merged""")
_chunk_place = "row_number() OVER (PARTITION BY meeting_id, category ORDER BY seg_from NULLS LAST, seg_to NULLS LAST, text, run_id, evidence) - 1"
simple("r5_merge_chunks", f"""WITH {CROWDED}{merged('meeting_id, category', _chunk_place, 'crowd')}
SELECT meeting_id, category, pos, text, evidence, owner, deadline, merged FROM merged""")
_tied = digest("meeting_id", "category", "s", "s", "CASE WHEN n > 1 THEN lower(text) ELSE chr(2) END")
simple("r6_stable_ids", f"""WITH {VALIDATED} SELECT meeting_id, category, s AS seg_from, text, substr({_tied}, 1, 24) AS id FROM (SELECT meeting_id, category,
seg_from - seg_from % 3 AS s, text, count(*) OVER (PARTITION BY meeting_id, category, seg_from - seg_from % 3) AS n
FROM validated WHERE run_id = 1)""")
simple("r7_manifest", f"""WITH {SEGMENTS}, {HASHES} SELECT meeting_id, {q(V.ANALYSIS_VERSION)} AS analysis_version, {q(V.PROMPT_VERSION)} AS prompt_version,
sha256({q(CONFIG_TEXT)}) AS config_hash, input_hash FROM hashes""")
_cur = "coalesce(edited_owner, owner)"
simple("r8_user_edits", f"""WITH {CANDIDATES}, e AS (SELECT meeting_id, category, seg_from,
 CASE WHEN seg_from % 4 = 0 THEN 'confirmed=true' END AS a,
 CASE WHEN {_cur} IS NULL THEN NULL WHEN seg_from % 5 <> 0 AND {_cur} IS DISTINCT FROM coalesce(owner, 'nobody') THEN 'owner=' || {_cur}
  WHEN seg_from % 5 = 0 AND (seg_from % 4 = 0 OR seg_from % 6 = 1) THEN 'owner=' || {_cur} END AS b, CASE WHEN seg_from % 3 = 0 THEN 'status=Done' END AS c,
 CASE WHEN seg_from % 5 = 0 AND (seg_from % 4 = 0 OR seg_from % 6 = 1) THEN 'task=' || item_text END AS d,
 CASE WHEN seg_from % 6 < 2 THEN 'user_edited=' || (seg_from % 6 = 1) END AS u FROM candidates WHERE run_id = 1)
SELECT meeting_id, category, seg_from, concat_ws(';', a, b, c, d, u) AS edits FROM e""")
_noclash = """NOT (o.category = 'action_items' AND (coalesce(o.owner <> n.owner, FALSE) OR coalesce(o.deadline <> n.deadline, FALSE)))"""
# A source holds several records in each run: only wordings that look like one event match, the first free one.
WORDED = CROWDED.replace("crowd AS (", "crowd AS MATERIALIZED (") + f""", worded AS MATERIALIZED (SELECT *, {terms('text')} AS tm FROM crowd)"""
_close = f"""o.meeting_id = n.meeting_id AND o.category = n.category AND o.seg_from = n.seg_from AND o.seg_to = n.seg_to
 AND o.run_id = 1 AND n.run_id = 2 AND (contains(o.evidence, n.evidence) OR contains(n.evidence, o.evidence))
 AND {jaccard('o.tm', 'n.tm')} >= 0.72"""
simple("r9_matches", f"""WITH {WORDED} SELECT o.meeting_id, o.category, o.seg_from AS o_from, o.text AS o_text, n.seg_from AS n_from, n.text AS n_text
FROM worded o JOIN worded n ON {_close} AND {_noclash}""")


def reconciled(source: str, match: str) -> str:
    return f""", reconciled AS (SELECT o.meeting_id, o.category, o.seg_from, o.seg_to, coalesce(n.text, o.text) AS text, o.text AS o_text,
 coalesce(o.edited_owner, CASE WHEN n.run_id IS NOT NULL THEN n.owner ELSE o.owner END) AS owner,
 CASE WHEN o.seg_from % 11 = 3 OR o.seg_from % 10 = 4 THEN 'Edited day' ELSE coalesce(n.deadline, o.deadline) END AS deadline,
 CASE WHEN o.seg_from % 13 = 5 THEN 'Done' ELSE coalesce(n.status, o.status) END AS status,
 o.edited_owner IS NOT NULL OR coalesce(o.seg_from % 11 = 3 OR o.seg_from % 10 = 4 OR o.seg_from % 13 = 5, FALSE) AS edited,
 CASE WHEN n.run_id IS NOT NULL THEN 'stable' WHEN o.meeting_id % 4 <> 0 AND o.seg_from IS NOT NULL THEN 'retained'
  ELSE 'removed' END AS reconciliation
 FROM (SELECT * FROM {source} WHERE run_id = 1) o LEFT JOIN (SELECT * FROM {source} WHERE run_id = 2) n ON {match} AND {_noclash})"""


RECONCILED = VALIDATED + reconciled("validated", _pair)
# Ids by wording where a source holds several records; new ones whose id is taken are named by their wording.
_known = lambda c: f"coalesce({c}::VARCHAR, {DIGEST_NULL})"
_one = digest("meeting_id", "category", _known("seg_from"), _known("seg_to"), f"CASE WHEN n > 1 THEN lower(text) ELSE {DIGEST_NULL} END")
simple("r10_reconcile", f"""WITH {WORDED}{reconciled('worded', _close)},
 ids AS (SELECT *, substr({_one}, 1, 24) AS id FROM (SELECT *, count(*) OVER (PARTITION BY run_id, meeting_id, category, seg_from, seg_to) AS n FROM worded)),
 fates AS (SELECT meeting_id, category, seg_from, text, o_text, owner, deadline, status, edited, reconciliation FROM reconciled),
 fresh AS (SELECT n.* FROM (SELECT * FROM ids WHERE run_id = 2) n LEFT JOIN (SELECT * FROM worded WHERE run_id = 1) o
  ON {_close} AND {_noclash} WHERE o.run_id IS NULL)
SELECT f.meeting_id, f.category, i.id, f.seg_from, f.text, f.owner, f.deadline, f.status, f.edited, f.reconciliation FROM fates f
 JOIN (SELECT DISTINCT meeting_id, category, seg_from, text, id FROM ids WHERE run_id = 1) i
 ON i.meeting_id = f.meeting_id AND i.category = f.category AND i.seg_from IS NOT DISTINCT FROM f.seg_from AND i.text = f.o_text
UNION ALL SELECT meeting_id, category, id, seg_from, text, owner, deadline, status, FALSE, 'new' FROM fresh""")
simple("r11_review_queue", f"""WITH {RECONCILED} SELECT meeting_id, category, {_id} AS id, owner, deadline, status, 'source_or_pipeline_changed' AS reason
FROM reconciled WHERE reconciliation = 'removed' AND edited""")
simple("r12_kept_answers", f"""WITH {VALIDATED}, q AS (SELECT o.meeting_id, o.category, o.seg_from, o.seg_to, n.run_id IS NOT NULL AS hit FROM
 (SELECT * FROM validated WHERE run_id = 1) o LEFT JOIN (SELECT * FROM validated WHERE run_id = 2) n ON {_pair} AND {_noclash}
 WHERE o.category = 'questions')
SELECT meeting_id, {_id} AS id, CASE WHEN hit AND seg_from % 4 = 1 THEN 'Unresolved' ELSE 'Resolved' END AS status,
'Soon.' AS answer, CASE WHEN hit THEN 'stable' ELSE 'retained' END AS reconciliation FROM q""")
_renamed = digest("meeting_id", "category", "seg_from", "seg_to", "'unrelated topic ' || seg_from")
simple("r13_renamed_ids", f"WITH {VALIDATED} SELECT meeting_id, category, seg_from, substr({_renamed}, 1, 24) AS id FROM validated WHERE run_id = 2 AND seg_from % 2 = 0")
simple("r14_migrate", f"""WITH {VALIDATED}, b AS (SELECT meeting_id, category, item_text AS text, arg_min(CASE WHEN seg_from % 4 = 0 THEN 'Done' END, seg_from)
 FILTER (TRUE) AS x, min(seg_from) % 4 = 0 AS done FROM candidates WHERE run_id = 1 GROUP BY 1, 2, 3)
SELECT v.meeting_id, v.category, seg_from, CASE WHEN done THEN 'Done' WHEN v.category = 'action_items' THEN CASE WHEN v.seg_from % 4 = 0 THEN 'Completed'
 ELSE 'Pending' END ELSE v.status END AS status, CASE WHEN done THEN 'Done' END AS edited_status FROM validated v
JOIN b USING (meeting_id, category, text) WHERE v.run_id = 1""")
simple("r15_reconcile_audit", f"""WITH {RECONCILED} SELECT meeting_id, category, count(*) FILTER (reconciliation = 'stable') AS stable,
count(*) FILTER (reconciliation = 'retained') AS retained, 0 AS new, count(*) FILTER (reconciliation = 'removed') AS removed,
count(*) FILTER (reconciliation <> 'removed') AS persisted FROM reconciled GROUP BY 1, 2""")
simple("r16_takeaway", f"""WITH {SEGMENTS}, a AS (SELECT * FROM segments WHERE segment_id = 0), b AS (SELECT * FROM segments WHERE segment_id = 1),
 k AS (SELECT b.meeting_id, a.text AS old, b.text AS new, b.meeting_id % 5 <> 0 AND b.meeting_id % 3 <> 0 AS kept FROM b JOIN a USING (meeting_id))
SELECT meeting_id, CASE WHEN kept THEN 'Old: ' || old ELSE 'New: ' || new END AS takeaway, CASE WHEN kept THEN old ELSE new END AS evidence, kept FROM k""")
simple("r17_apply_edits", f"""WITH {CANDIDATES} SELECT meeting_id, seg_from AS item_index, item_text AS task, 't1' AS analyzed_at,
CASE WHEN seg_from % 4 = 3 THEN 'Eve' ELSE owner END AS owner, CASE WHEN seg_from % 4 <> 3 THEN deadline END AS deadline,
seg_from % 4 = 3 AS manually_edited FROM candidates WHERE run_id = 1 AND category = 'action_items'""")
simple("r17_edit_outcomes", f"""WITH {CANDIDATES} SELECT meeting_id, seg_from + CASE WHEN seg_from % 4 = 0 THEN 100000000 ELSE 0 END AS item_index,
CASE WHEN seg_from % 4 = 1 THEN 'Other' ELSE item_text END AS task, 'Eve' AS owner, NULL::VARCHAR AS deadline,
CASE seg_from % 4 WHEN 0 THEN 'not_found' WHEN 3 THEN 'accepted' ELSE 'conflict' END AS outcome FROM candidates
WHERE run_id = 1 AND category = 'action_items'""")
simple("r18_carry_edits", f"""WITH {VALIDATED}, e AS (SELECT meeting_id, text, evidence, count(*) AS n, min(deadline) AS d FROM validated
 WHERE run_id = 1 AND category = 'action_items' AND seg_from % 7 = 0 GROUP BY 1, 2, 3)
SELECT v.meeting_id, v.seg_from, CASE WHEN e.n = 1 THEN 'User owner' ELSE v.owner END AS owner, CASE WHEN e.n = 1 THEN e.d ELSE v.deadline END AS deadline,
coalesce(e.n = 1, FALSE) AS manually_edited FROM validated v LEFT JOIN e USING (meeting_id, text, evidence) WHERE v.run_id = 2 AND v.category = 'action_items'""")
_note = digest("meeting_id", "text", "evidence", "seg_from", "seg_to")
simple("r19_notes", f"""WITH {VALIDATED} SELECT {_note} AS note_key, CASE WHEN seg_from % 3 = 0 THEN 'second' ELSE 'first' END AS note FROM validated
WHERE run_id = 1 AND (seg_from % 2 = 0 AND seg_from % 3 <> 0 OR seg_from % 3 = 0 AND seg_from % 6 <> 0)""")

# --- streaming twins -----------------------------------------------------------------------------------------------
simple("t1_stream_intake", "SELECT event_id, user_id, event_type FROM events")
simple("t2_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
simple("t3_sessions", """WITH s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, (lag(ts) OVER (
 PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE)::INT AS g
 FROM events)) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
simple("t3_live_turns", """SELECT conv_id AS meeting_id, count(*) FILTER (st) AS turns FROM (SELECT conv_id, role IS DISTINCT FROM lag(role) OVER (
 PARTITION BY conv_id ORDER BY turn) AS st FROM conversations) GROUP BY 1""")
ORACLES["t2_daily_counts_stream"] = ORACLES["t2_daily_counts"]
ORACLES["t3_sessions_stream"] = ORACLES["t3_sessions"]
simple("t3_stateful_turns", f"SELECT *, 0 AS late FROM ({ORACLES['t3_live_turns']})")

# --- walks as recursive SQL ----------------------------------------------------------------------------------------
simple("c3_sentence_chunks", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i
 FROM (SELECT doc_id, {sents('text')} AS p FROM documents)),
 packed AS (SELECT doc_id, i, 0 AS chunk_no, length(x) + 1 AS used FROM s WHERE i = 1
 UNION ALL SELECT s.doc_id, s.i, chunk_no + (used + length(x) > 3000)::INT,
  CASE WHEN used + length(x) > 3000 THEN length(x) ELSE used + length(x) + 1 END
  FROM packed p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
SELECT doc_id, chunk_no, string_agg(x, ' ' ORDER BY i) AS chunk FROM packed JOIN s USING (doc_id, i) GROUP BY 1, 2""")
_middle = "length(units[1]) // 2"
_window = f"substr(units[1], {_middle} // 2 + 1, {_middle} - {_middle} // 2)"
_cut = f"CASE WHEN instr(reverse({_window}), ' ') > 0 THEN {_middle} - instr(reverse({_window}), ' ') + 1 ELSE {_middle} END"
simple("c7_halve_failed", f"""WITH c AS (SELECT doc_id::VARCHAR AS parent, (doc_id % 5)::INT AS depth,
  CASE WHEN doc_id % 2 = 0 THEN {sents('text')} ELSE [{norm('text')}] END AS units FROM documents WHERE doc_id % 3 <> 0),
 d AS (SELECT *, depth >= 4 OR (len(units) <= 1 AND length(units[1]) < 200) AS done FROM c),
 halves AS (SELECT parent, depth + 1 AS depth, unnest([0, 1]) AS half, FALSE AS gave_up, CASE WHEN len(units) > 1
   THEN unnest([units[1:len(units) // 2], units[len(units) // 2 + 1:]])
   ELSE unnest([[substr(units[1], 1, {_cut})], [substr(units[1], {_cut} + 1)]]) END AS units FROM d WHERE NOT done
  UNION ALL SELECT parent, depth, 0, TRUE, units FROM d WHERE done)
SELECT parent, depth, half, gave_up, len(units) AS units, sha256(array_to_string(units, chr(30))) AS chunk_key FROM halves""")
PEAKS = ORACLES["w6_peaks"].removeprefix("WITH ")
_peaks_at = PEAKS.rindex("\nSELECT")
PEAKS = f"{PEAKS[:_peaks_at]}, peaks AS MATERIALIZED ({PEAKS[_peaks_at:]})"
simple("w7_boundaries", f"""WITH RECURSIVE {PEAKS}, line AS MATERIALIZED (SELECT meeting_id, segment_id,
  list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS d, row_number() OVER (PARTITION BY meeting_id ORDER BY segment_id) AS n
  FROM peaks JOIN units USING (meeting_id, segment_id)),
 kept AS (SELECT meeting_id, n, segment_id, TRUE AS is_new, d FROM line WHERE n = 1
  UNION ALL SELECT l.meeting_id, l.n, l.segment_id, list_dot_product(k.d, l.d) < 0.82,
   CASE WHEN list_dot_product(k.d, l.d) < 0.82 THEN l.d ELSE k.d END FROM kept k JOIN line l ON l.meeting_id = k.meeting_id AND l.n = k.n + 1)
SELECT meeting_id, segment_id FROM kept WHERE is_new UNION SELECT DISTINCT meeting_id, 0 FROM units""")
# References are ten units apart, so within two units a peak has one of them at most.
simple("a17_boundary_scores", f"""WITH {PEAKS}, truth AS (SELECT meeting_id, segment_id AS pos FROM units WHERE segment_id % 10 = 5),
 sizes AS (SELECT meeting_id, (SELECT count(*) FROM truth t WHERE t.meeting_id = u.meeting_id) AS n_ref,
  (SELECT count(*) FROM peaks p WHERE p.meeting_id = u.meeting_id AND segment_id > 0) AS n_found,
  (SELECT count(DISTINCT pos) FROM truth t JOIN peaks p ON p.meeting_id = t.meeting_id AND abs(p.segment_id - pos) <= 2
   WHERE t.meeting_id = u.meeting_id) AS hits FROM (SELECT DISTINCT meeting_id FROM units) u),
 shares AS (SELECT meeting_id, CASE WHEN n_found > 0 THEN hits / n_found ELSE 1.0 END AS precision,
  CASE WHEN n_ref > 0 THEN hits / n_ref ELSE 1.0 END AS recall FROM sizes)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM shares""")
# Gaps between topics are shorter than a topic segment, so every one has votes.
simple("m9_vote_labels", f"""WITH {UNITS}, ranged AS (SELECT meeting_id, segment_id // 9 AS gid, segment_id AS a FROM units WHERE segment_id % 9 = 4),
 named AS (SELECT meeting_id, segment_id, max(gid) AS gid FROM (SELECT meeting_id, gid, unnest(range(a, a + 6)) AS segment_id FROM ranged) r GROUP BY 1, 2),
 votes AS (SELECT meeting_id, segment_id // 7 AS segment_index, gid, count(*) AS votes, min(segment_id) AS first
  FROM units JOIN named USING (meeting_id, segment_id) GROUP BY 1, 2, 3)
SELECT meeting_id, segment_index, arg_max(gid, votes * 1000 - first) AS gid, max(votes) AS votes FROM votes GROUP BY 1, 2""")
# No turn of the fixture alone exceeds the budget: turns follow each other, and one is repeated where it fits.
PACKED = f"""{SEGMENTS}, turns AS MATERIALIZED (SELECT meeting_id, segment_id, {norm('text')} AS text,
  length('{{"text":"","speaker":' || coalesce('"' || speaker || '"', 'null') || ',"segment_id":' || segment_id || ',"start":' || (segment_id * 7) || '.0}}')
  + length({norm('text')}) AS cost FROM segments),
 walked AS (SELECT meeting_id, segment_id, 0 AS chunk_no, 0 AS part_no, 1 AS parts, 2 + cost + 1 AS size, cost, FALSE AS again FROM turns WHERE segment_id = 0
  UNION ALL SELECT t.meeting_id, t.segment_id, w.chunk_no + w.closes, CASE WHEN w.closes = 0 THEN w.parts ELSE w.repeats END,
   CASE WHEN w.closes = 0 THEN w.parts ELSE w.repeats END + 1,
   CASE WHEN w.closes = 0 THEN w.size ELSE 2 + w.repeats * (w.cost + 1) END + t.cost + 1, t.cost, w.closes * w.repeats = 1
  FROM turns t JOIN (SELECT w.*, (w.size + n.cost > 1500)::INT AS closes, (2 + w.cost + 1 + n.cost <= 1500)::INT AS repeats FROM walked w
   JOIN turns n ON n.meeting_id = w.meeting_id AND n.segment_id = w.segment_id + 1) w ON t.meeting_id = w.meeting_id AND t.segment_id = w.segment_id + 1),
 packed AS (SELECT meeting_id, chunk_no, part_no, segment_id, text FROM walked JOIN turns USING (meeting_id, segment_id)
  UNION ALL SELECT w.meeting_id, w.chunk_no, 0, t.segment_id, t.text FROM walked w JOIN turns t ON t.meeting_id = w.meeting_id
   AND t.segment_id = w.segment_id - 1 WHERE again)"""
simple("c4_pack_units", f"WITH RECURSIVE {PACKED} SELECT * FROM packed")
simple("j12_missing_chunks", f"""WITH RECURSIVE {PACKED}, k AS (SELECT meeting_id, chunk_no, count(*)::INT AS parts,
  sha256(string_agg(segment_id || chr(31) || text, chr(30) ORDER BY part_no)) AS chunk_key FROM packed GROUP BY 1, 2)
SELECT * FROM k WHERE chunk_key NOT IN (SELECT chunk_key FROM k WHERE meeting_id % 2 = 0)""")
_piece_window = "substr(text, pos + 1, 1501)"
_piece_space = f"(length({_piece_window}) - instr(reverse({_piece_window}), ' ') + 1)"
_piece_size = f"""CASE WHEN length(text) - pos <= 1500 THEN length(text) - pos WHEN instr(reverse({_piece_window}), ' ') > 0 AND {_piece_space} > 750
 THEN {_piece_space} ELSE 1500 END"""
simple("c5_display_batches", f"""WITH RECURSIVE cut AS (SELECT doc_id, text, 0 AS piece_no, 0::BIGINT AS pos, (SELECT {_piece_size} FROM (SELECT 0 AS pos) z) AS size
  FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, text, piece_no, pos, {_piece_size} FROM (SELECT doc_id, text, piece_no + 1 AS piece_no, pos + size AS pos FROM cut
   WHERE pos + size < length(text))),
 pieces AS MATERIALIZED (SELECT doc_id, piece_no, substr(text, pos + 1, size) AS piece, strlen(substr(text, pos + 1, size)) AS bytes FROM cut),
 dealt AS (SELECT doc_id, piece_no, 0 AS batch, 1 AS n, bytes AS filled FROM pieces WHERE piece_no = 0
  UNION ALL SELECT p.doc_id, p.piece_no, batch + fresh, CASE WHEN fresh = 1 THEN 1 ELSE n + 1 END, CASE WHEN fresh = 1 THEN 0 ELSE filled END + bytes
  FROM (SELECT d.*, (d.filled + p.bytes > 8000 OR d.n >= 64)::INT AS fresh FROM dealt d JOIN pieces p ON p.doc_id = d.doc_id AND p.piece_no = d.piece_no + 1) d
  JOIN pieces p ON p.doc_id = d.doc_id AND p.piece_no = d.piece_no + 1)
SELECT doc_id, piece_no, batch, length(piece) AS characters, md5(piece) AS md5 FROM pieces JOIN dealt USING (doc_id, piece_no)""")

# --- a model whose classes words tell apart says what it was taught ------------------------------------------------
_taught = f"""CASE WHEN {is_decision('sentence')} THEN 'DECISION' WHEN {is_action('sentence')} THEN 'ACTION ITEM'
 WHEN contains(sentence, '?') OR {rx('sentence', V.OPEN_ISSUE)} THEN 'QUESTION'
 WHEN regexp_matches(lower(sentence), '\\b(api|docker|slides|share)\\b') THEN 'INFORMATION' ELSE 'DISCUSSION' END"""
for _name in ("m1_train", "s13_saved_model"):
    simple(_name, f"WITH {SENTENCES} SELECT DISTINCT sentence, {_taught} AS model_label FROM sentences")
simple("r5_extraction_audit", f"""WITH {VALIDATED}{merged('meeting_id, category', _chunk_place, 'validated')},
 v AS (SELECT meeting_id, category, count(*) AS n FROM validated GROUP BY 1, 2),
 k AS (SELECT meeting_id, category, count(*) AS n FROM merged GROUP BY 1, 2)
SELECT meeting_id, category, v.n AS generated, v.n AS parsed, v.n AS evidence_matched, v.n AS validated, k.n AS deduplicated
FROM v JOIN k USING (meeting_id, category)""")
