"""Transcript, call-rule and evaluation queries (K4, W2, P6, X7, W3, A10,
C1, A11, C2, C4-C7, P7, J7, J8, X8, X9, K6) over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpline.functions.columns import ACCENTED, PAGE_SPAN, UNACCENTED
from helpline.operators import calls as C
from helpline.operators import evaluate as E
from helpline.operators import language as LG
from helpline.operators import outcomes as O
from helpline.plans.catalog import register
from helpline.plans.sqltext import lit, page
from helpline.session import scratch_path
from helpline.sinks.writers import write_transcripts
from helpline.sources import fixtures as fx
from helpline.sources.files import scan_transcripts
from helpline.sources.fixtures import with_fixtures as W
from helpline.sources.tables import read_table

ROLE = "CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END"
FOLD = f"lower(translate(text, '{ACCENTED}', '{UNACCENTED}'))"
WORDS = "len(string_split_regex(trim(text), '\\s+'))"


def _contains_any(expr: str, phrases: list[str], op: str = "OR") -> str:
    return "(" + f" {op} ".join(f"contains({expr}, '{p}')" for p in phrases) + ")"


OUTCOME_CASE = "CASE " + " ".join(f"WHEN contains(t, '{p}') THEN '{o}'" for p, o in O.OUTCOME_PHRASES) + " END"
SOURCE_CASE = (f"CASE WHEN {_contains_any('t', O.AI_SOLUTION_PHRASES)} THEN 'ai_generated' "
               f"WHEN contains(t, '{O.VERIFIED_SOLUTION_PHRASE}') THEN 'verified' ELSE 'none' END")

FORMAT_SQL = f"""SELECT call_id, {page('pos', PAGE_SPAN)} AS page_no, count(*) AS n_lines,
    string_agg({ROLE} || ': ' || text, chr(10) ORDER BY pos) AS transcript FROM turns WHERE text IS NOT NULL GROUP BY 1, 2"""

C1_SQL = f"""SELECT c.call_id, coalesce(h.outcome, 'open') AS outcome, h.outcome_pos
    FROM (SELECT DISTINCT call_id FROM turns_with_closings) c LEFT JOIN (
      SELECT call_id, arg_max(o, pos) AS outcome, max(pos) AS outcome_pos FROM (
        SELECT call_id, pos, {OUTCOME_CASE} AS o FROM (SELECT call_id, pos, {FOLD} AS t FROM turns_with_closings WHERE role = 'assistant') f
      ) x WHERE o IS NOT NULL GROUP BY 1) h ON h.call_id = c.call_id"""

C2_SQL = f"""SELECT call_id, pos, n_words FROM (SELECT call_id, pos, {WORDS} AS n_words, {FOLD} AS t FROM {{src}} WHERE role = 'assistant') a
    WHERE n_words > {O.WORD_LIMIT} AND NOT contains(t, '{O.SOLUTION_WORD}')"""

C5_SQL = f"""SELECT call_id, first_role, coalesce(first_role = 'assistant' AND
    {_contains_any(FOLD.replace('text', 'first_text'), O.GREETING_WORDS, 'AND')}, false) AS greeted
    FROM (SELECT call_id, arg_min(role, pos) AS first_role, arg_min(text, pos) AS first_text FROM {{src}} GROUP BY 1) f"""

C6_SQL = f"""SELECT call_id, first_user_pos, first_solution_pos,
    first_solution_pos IS NOT NULL AND (first_user_pos IS NULL OR first_solution_pos < first_user_pos) AS answered_before_identified
    FROM (SELECT call_id, min(CASE WHEN role = 'user' THEN pos END) AS first_user_pos,
      min(CASE WHEN role = 'assistant' AND src <> 'none' THEN pos END) AS first_solution_pos
      FROM (SELECT call_id, pos, role, {SOURCE_CASE} AS src FROM (SELECT *, {FOLD} AS t FROM {{src}}) y) x GROUP BY 1) g"""

_SW = ", ".join(f"('{w}', '{lang}', {O.LANG_PRIORITY[lang]})" for lang, ws in O.STOP_WORDS.items() for w in ws)
C7_SQL = f"""SELECT a.call_id, a.pos, coalesce(b.lang, 'unknown') AS detected_lang,
    coalesce(b.lang, 'unknown') NOT IN ('{O.POLICY_LANGUAGE}', 'unknown') AS violation
    FROM (SELECT call_id, pos, text FROM {{src}} WHERE role = 'assistant') a LEFT JOIN (
      SELECT call_id, pos, arg_max(lang, v * 10 + prio) AS lang FROM (
        SELECT call_id, pos, lang, prio, count(*) AS v FROM (
          SELECT call_id, pos, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS token
          FROM {{src}} WHERE role = 'assistant') t
        JOIN (VALUES {_SW}) sw(token, lang, prio) ON sw.token = t.token GROUP BY 1, 2, 3, 4) v
      GROUP BY 1, 2) b ON a.call_id = b.call_id AND a.pos = b.pos"""

REQUEST_ID = "md5(coalesce(CAST(call_id AS VARCHAR), '-') || '|' || coalesce('=' || evaluation_prompt, '-'))"
P7_SQL = f"""SELECT {REQUEST_ID} AS request_id, call_id, evaluation_prompt,
    CASE WHEN call_id IS NOT NULL AND evaluation_prompt IS NOT NULL THEN 'valid' ELSE 'invalid' END AS status,
    CASE WHEN call_id IS NOT NULL AND evaluation_prompt IS NOT NULL THEN NULL ELSE '{E.MISSING_FIELDS}' END AS reason
    FROM eval_requests"""
J7_SQL = f"""SELECT r.request_id, r.call_id, r.evaluation_prompt, c.transcript_path FROM ({P7_SQL}) r
    JOIN calls c ON c.call_id = r.call_id WHERE r.status = 'valid'"""
J8_SQL = f"""SELECT r.request_id, r.call_id, 'not_found' AS status,
    'Call with ID ' || CAST(r.call_id AS VARCHAR) || ' not found' AS message
    FROM ({P7_SQL}) r WHERE r.status = 'valid' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.call_id = r.call_id)"""
X8_SQL = f"""SELECT j.request_id, j.call_id, coalesce(t.page_no, 0) AS page_no, j.evaluation_prompt, {lit(E.SYSTEM_TEXT)} AS system_text,
    {lit(E.PROMPT_HEAD)} || j.evaluation_prompt || {lit(E.TRANSCRIPT_HEAD)} || coalesce(t.transcript, '') AS user_text
    FROM ({J7_SQL}) j LEFT JOIN ({FORMAT_SQL.replace('FROM turns', 'FROM {src}')}) t ON t.call_id = j.call_id"""

FACTS_SQL = f"""SELECT o.call_id, o.outcome, g.greeted, b.answered_before_identified,
    CAST(coalesce(w.n, 0) AS BIGINT) AS n_long_turns, CAST(coalesce(l.n, 0) AS BIGINT) AS n_language_violations
    FROM ({C1_SQL.replace('turns_with_closings', '{src}')}) o
    LEFT JOIN ({C5_SQL}) g ON g.call_id = o.call_id
    LEFT JOIN ({C6_SQL}) b ON b.call_id = o.call_id
    LEFT JOIN (SELECT call_id, count(*) AS n FROM ({C2_SQL}) x GROUP BY 1) w ON w.call_id = o.call_id
    LEFT JOIN (SELECT call_id, count(*) FILTER (WHERE violation) AS n FROM ({C7_SQL}) x GROUP BY 1) l ON l.call_id = o.call_id"""
_PASS = ("(CAST(outcome IN ('verified_resolved', 'ai_resolved') AS INTEGER) + CAST(greeted AS INTEGER) + "
         "CAST(NOT answered_before_identified AS INTEGER) + CAST(n_long_turns = 0 AS INTEGER) + "
         "CAST(n_language_violations = 0 AS INTEGER)) / 5.0")
SCORED_SQL = f"""SELECT request_id, round({_PASS}, 6) AS score, CASE WHEN {_PASS} >= 0.6 THEN 'pass' ELSE 'fail' END AS verdict,
    concat_ws(chr(10) || chr(10), 'Outcome: ' || outcome,
      'Greeting: ' || CASE WHEN greeted THEN 'ok' ELSE 'missing' END,
      'Identification before solution: ' || CASE WHEN answered_before_identified THEN 'violated' ELSE 'ok' END,
      'Word limit: ' || CAST(n_long_turns AS VARCHAR) || ' long turns without a solution',
      'Language: ' || CAST(n_language_violations AS VARCHAR) || ' assistant turns not in Spanish') AS result_text
    FROM (SELECT DISTINCT request_id, call_id FROM ({J7_SQL}) j) p JOIN ({FACTS_SQL}) f ON f.call_id = p.call_id"""
X9_SQL = f"""SELECT r.request_id, r.call_id, r.evaluation_prompt,
    CASE WHEN r.status = 'valid' AND c.call_id IS NOT NULL THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN r.status = 'invalid' THEN r.reason WHEN c.call_id IS NULL
      THEN 'Call with ID ' || CAST(r.call_id AS VARCHAR) || ' not found' END AS message, s.score, s.verdict, s.result_text
    FROM ({P7_SQL}) r LEFT JOIN calls c ON c.call_id = r.call_id LEFT JOIN ({SCORED_SQL}) s ON s.request_id = r.request_id"""
K6_SQL = f"""WITH res AS (SELECT * FROM ({X9_SQL}) x WHERE status = 'ok')
    SELECT request_id, call_id, 'title' AS section, 0 AS para_no, {lit(E.REPORT_TITLE)} AS text FROM res
    UNION ALL SELECT request_id, call_id, 'call', 0, '{E.CALL_LINE}' || CAST(call_id AS VARCHAR) FROM res
    UNION ALL SELECT request_id, call_id, 'criteria', 0, '{E.CRITERIA_HEADING}' FROM res
    UNION ALL SELECT request_id, call_id, 'criteria', 1, evaluation_prompt FROM res
    UNION ALL SELECT request_id, call_id, 'results', 0, '{E.RESULTS_HEADING}' FROM res
    UNION ALL SELECT request_id, call_id, 'results', CAST(i AS INTEGER), text FROM (
      SELECT request_id, call_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM (
        SELECT request_id, call_id, string_split(result_text, chr(10) || chr(10)) AS p FROM res) a) b"""

ITEM_JSON = ("{'id': 'item_' || CAST(call_id AS VARCHAR) || '_' || CAST(pos AS VARCHAR), 'type': 'message', 'role': role, "
             "'content': CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE [text] END, 'interrupted': false}")


def _src(sql: str, src: str) -> str:
    return sql.replace("{src}", src)


@register("format_transcript", W(FORMAT_SQL, "turns"))
def q_x7(spark, d):
    return C.format_transcripts(fx.turns(spark, d))


@register("write_transcript", W(f"""SELECT t.call_id, t.page_no,
    'transcript_' || strftime(c.started_at, '%Y-%m-%d_%H-%M-%S') || '_' || CAST(t.call_id AS VARCHAR) || '.json' AS file_name,
    t.n_items, to_json({{'items': t.items}}) AS transcript_json
    FROM (SELECT call_id, {page('pos', PAGE_SPAN)} AS page_no, count(*) AS n_items, list({ITEM_JSON} ORDER BY pos) AS items
      FROM turns GROUP BY 1, 2) t JOIN calls c ON c.call_id = t.call_id""", "turns", "calls"))
def q_k4(spark, d):
    t = C.build_transcripts(fx.turns(spark, d))
    c = fx.calls(spark, d).select("call_id", "started_at")
    return t.join(c, "call_id").select(
        "call_id", "page_no",
        F.concat(F.lit("transcript_"), F.date_format("started_at", "yyyy-MM-dd_HH-mm-ss"), F.lit("_"),
                 F.col("call_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.size("items").cast("bigint").alias("n_items"),
        F.to_json(F.struct("items"), {"ignoreNullFields": "false"}).alias("transcript_json"))


@register("turn_sequence", W("""SELECT call_id, pos, 'item_' || CAST(call_id AS VARCHAR) || '_' || CAST(pos AS VARCHAR) AS item_id,
    'message' AS item_type, role, CAST(CASE WHEN text IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_content, false AS interrupted
    FROM turns""", "turns"))
def q_w2(spark, d):
    s = C.turn_sequence(C.build_transcripts(fx.turns(spark, d)))
    return s.select("call_id", "pos", "item_id", "item_type", "role", F.size("content").cast("bigint").alias("n_content"),
                    "interrupted")


@register("nonempty_turns", W("""SELECT call_id, pos, role, text AS first_content FROM (
    SELECT call_id, role, text, row_number() OVER (PARTITION BY call_id ORDER BY pos) - 1 AS pos FROM call_turns) t
    WHERE text IS NOT NULL""", "turns_with_closings", "call_turns"))
def q_p6(spark, d):
    s = C.turn_sequence(C.build_transcripts(fx.call_turns(spark, d)))
    return s.filter(C.nonempty(F.col("content"))).select("call_id", "pos", "role", F.get("content", 0).alias("first_content"))


@register("reply_pairs", W("""SELECT call_id, pos AS user_pos, next_pos AS reply_pos, text AS user_text, next_text AS reply_text
    FROM (SELECT *, lead(role) OVER w AS next_role, lead(pos) OVER w AS next_pos, lead(text) OVER w AS next_text
      FROM turns WINDOW w AS (PARTITION BY call_id ORDER BY pos)) x WHERE role = 'user' AND next_role = 'assistant'""", "turns"))
def q_w3(spark, d):
    return C.reply_pairs(fx.turns(spark, d))


@register("call_metrics", W(f"""SELECT call_id, count(*) AS n_items, count(*) FILTER (WHERE role = 'user') AS n_user,
    count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n_other,
    count(*) FILTER (WHERE interrupted) AS n_interrupted, CAST(coalesce(sum({WORDS}), 0) AS BIGINT) AS n_words,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN {WORDS} END), 0) AS BIGINT) AS n_assistant_words,
    min(pos) AS first_pos, max(pos) AS last_pos, arg_min(role, pos) AS first_role, arg_max(role, pos) AS last_role
    FROM call_turns GROUP BY call_id""", "turns_with_closings", "call_turns"))
def q_a10(spark, d):
    return C.call_metrics(fx.call_turns(spark, d))


@register("call_outcome", W(C1_SQL, "turns_with_closings"))
def q_c1(spark, d):
    return O.call_outcome(fx.turns_with_closings(spark, d))


@register("outcome_summary", W(f"""SELECT outcome, count(*) AS n_calls, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM ({C1_SQL}) o GROUP BY outcome""", "turns_with_closings"))
def q_a11(spark, d):
    return O.outcome_summary(O.call_outcome(fx.turns_with_closings(spark, d)))


@register("word_limit_violations", W(_src(C2_SQL, "turns"), "turns"))
def q_c2(spark, d):
    return O.word_limit_violations(fx.turns(spark, d))


@register("solution_source", W(f"""SELECT call_id, pos, {SOURCE_CASE} AS solution_source
    FROM (SELECT call_id, pos, {FOLD} AS t FROM turns_with_closings WHERE role = 'assistant') f""", "turns_with_closings"))
def q_c4(spark, d):
    return O.solution_source(fx.turns_with_closings(spark, d))


@register("greeting_check", W(_src(C5_SQL, "call_turns"), "turns_with_closings", "call_turns"))
def q_c5(spark, d):
    return O.greeting_check(fx.call_turns(spark, d))


@register("answered_before_identified", W(_src(C6_SQL, "call_turns"), "turns_with_closings", "call_turns"))
def q_c6(spark, d):
    return O.answered_before_identified(fx.call_turns(spark, d))


@register("language_policy_words", W(_src(C7_SQL, "turns"), "turns"))
def q_c7_words(spark, d):
    """C7 by a short list of stop words, which needs no training."""
    return O.language_policy(fx.turns(spark, d))


def _trigrams_sql(rows: str) -> str:
    """``(id, bucket, n)`` of ``rows(id, t)``, padded texts."""
    return f"""SELECT id, ({LG.A} * unicode(a) + {LG.B} * unicode(b) + unicode(c)) % {LG.BUCKETS} AS bucket, count(*) AS n FROM (
      SELECT id, ch AS a, lead(ch) OVER w AS b, lead(ch, 2) OVER w AS c FROM (
        SELECT id, row, unnest(string_split(t, '')) AS ch, unnest(range(length(t))) AS p
        FROM (SELECT id, t, row_number() OVER () AS row FROM ({rows}) r) x) y WINDOW w AS (PARTITION BY row ORDER BY p)) z
      WHERE c IS NOT NULL GROUP BY 1, 2"""


_PADDED = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' '"


@register("language_policy", W(f"""WITH grams AS ({_trigrams_sql(f"SELECT lang AS id, {_PADDED} AS t FROM documents WHERE lang IS NOT NULL")}),
    langs AS (SELECT id AS lang, sum(n) + {LG.BUCKETS} AS total FROM grams GROUP BY 1),
    asked AS (SELECT row_number() OVER () AS id, call_id, pos, {_PADDED} AS t FROM turns WHERE role = 'assistant'),
    said AS ({_trigrams_sql("SELECT id, t FROM asked")}),
    sums AS (SELECT s.id, l.lang, sum(s.n * ln((coalesce(g.n, 0) + 1) / l.total)) AS score, sum(s.n) AS grams
      FROM said s CROSS JOIN langs l LEFT JOIN grams g ON g.id = l.lang AND g.bucket = s.bucket GROUP BY 1, 2),
    best AS (SELECT id, CASE WHEN any_value(grams) >= {LG.LEAST} THEN arg_max(lang, score) ELSE '{LG.UNKNOWN}' END AS lang FROM sums GROUP BY 1)
    SELECT a.call_id, a.pos, coalesce(b.lang, '{LG.UNKNOWN}') AS detected_lang,
      coalesce(b.lang, '{LG.UNKNOWN}') NOT IN ('{O.POLICY_LANGUAGE}', '{LG.UNKNOWN}') AS violation
    FROM asked a LEFT JOIN best b ON b.id = a.id""", "turns"))
def q_c7(spark, d):
    """C7 by a model trained on the languages of all documents."""
    model = LG.fit_languages(read_table(spark, d, "documents", ["text", "lang"]))
    return LG.language_policy(fx.turns(spark, d), model)


@register("valid_requests", W(P7_SQL, "eval_requests"))
def q_p7(spark, d):
    return E.valid_requests(fx.eval_requests(spark, d))


@register("requests_calls_join", W(J7_SQL, "eval_requests", "calls"))
def q_j7(spark, d):
    return E.requests_calls_join(fx.eval_requests(spark, d), fx.calls(spark, d))


@register("missing_calls", W(J8_SQL, "eval_requests", "calls"))
def q_j8(spark, d):
    return E.missing_calls(fx.eval_requests(spark, d), fx.calls(spark, d))


@register("eval_prompt", W(_src(X8_SQL, "call_turns"), "eval_requests", "calls", "turns_with_closings", "call_turns"))
def q_x8(spark, d):
    return E.eval_prompts(fx.eval_requests(spark, d), fx.calls(spark, d), fx.call_turns(spark, d))


def _evaluated(spark, d):
    """Requests evaluated from stored transcripts: written by the sink, read by
    the source and found by the path in the calls register."""
    path, calls = scratch_path(spark, "evaluated-calls"), fx.calls(spark, d)
    stored = C.build_transcripts(fx.call_turns(spark, d)).join(calls, "call_id")
    write_transcripts(stored.withColumn("file_name", C.transcript_file_name("call_id", "started_at")), path)
    return E.evaluate_calls(fx.eval_requests(spark, d), calls, scan_transcripts(spark, path, multi_line=False))


@register("evaluate_calls", W(_src(X9_SQL, "call_turns"), "eval_requests", "calls", "turns_with_closings", "call_turns"))
def q_x9(spark, d):
    return _evaluated(spark, d)


@register("evaluation_report", W(_src(K6_SQL, "call_turns"), "eval_requests", "calls", "turns_with_closings", "call_turns"))
def q_k6(spark, d):
    return E.evaluation_report(_evaluated(spark, d))


@register("interruption_rate", W("""SELECT call_id, count(*) AS n_assistant, round(avg(CAST(interrupted AS INTEGER)), 6) AS interruption_rate
    FROM call_turns WHERE role = 'assistant' GROUP BY 1""", "turns_with_closings", "call_turns"))
def q_c3(spark, d):
    return O.interruption_rate(fx.call_turns(spark, d))


@register("lookup_call", W("""SELECT call_id, transcript_path FROM calls WHERE call_id = (SELECT max(call_id) FROM calls)""", "calls"))
def q_s7(spark, d):
    """Point lookup of the latest call (the id is one scalar aggregate)."""
    c = fx.calls(spark, d)
    latest = c.agg(F.max("call_id")).first()[0]
    return C.lookup_call(c, latest)
