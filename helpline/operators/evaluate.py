"""Call evaluation as a table job: validate requests (P7), find their calls
(J7) or report them missing (J8), build the evaluator prompt (X8), score with a
pluggable scorer (X9) and lay out report rows (K6)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpline.functions.columns import request_key
from helpline.operators import calls as C
from helpline.operators import outcomes as O

# Evaluator system text, prompt template parts, report headings.
SYSTEM_TEXT = "You are an expert call evaluator. Analyze the conversation and provide detailed feedback."
REPORT_TITLE = "Reporte de Evaluacion de Llamadas"
CALL_LINE = "Id de Llamada: "
CRITERIA_HEADING = "Criterios de Evaluacion:"
RESULTS_HEADING = "Evaluation Results:"
PROMPT_HEAD = "Evaluation instructions: "
TRANSCRIPT_HEAD = "\n\nConversation transcript:\n"
MISSING_FIELDS = "Missing required fields: call_id and evaluation_prompt"


def with_request_ids(requests: DataFrame) -> DataFrame:
    """``(request_id, call_id, evaluation_prompt)``: the request's own id, or the
    hash of its body where it has none. Rows of equal id are one request sent
    again: it is scored once and answered on every row."""
    own = request_key("call_id", "evaluation_prompt")
    if "request_id" in requests.columns:
        own = F.coalesce(F.col("request_id").cast("string"), own)
    return requests.select(own.alias("request_id"), "call_id", "evaluation_prompt")


def valid_requests(requests: DataFrame) -> DataFrame:
    """Presence check only (an empty prompt is accepted)."""
    ok = F.col("call_id").isNotNull() & F.col("evaluation_prompt").isNotNull()
    return with_request_ids(requests).select(
        "request_id", "call_id", "evaluation_prompt",
        F.when(ok, F.lit("valid")).otherwise(F.lit("invalid")).alias("status"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(MISSING_FIELDS)).alias("reason"))


def requests_calls_join(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Valid requests joined to their call's transcript path."""
    v = valid_requests(requests).filter(F.col("status") == "valid")
    return v.join(calls.select("call_id", "transcript_path"), "call_id").select(
        "request_id", "call_id", "evaluation_prompt", "transcript_path")


def _not_found(call_id: str = "call_id") -> Column:
    return F.concat(F.lit("Call with ID "), F.col(call_id).cast("string"), F.lit(" not found"))


def missing_calls(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Valid requests whose call id is unknown -> one not-found row each."""
    v = valid_requests(requests).filter(F.col("status") == "valid")
    return (v.join(calls.select("call_id"), "call_id", "left_anti")
            .select("request_id", "call_id", F.lit("not_found").alias("status"), _not_found().alias("message")))


def stored_turns(transcripts: DataFrame, calls: DataFrame) -> DataFrame:
    """Flat turns of stored transcripts (``scan_transcripts``), given to the call
    whose ``transcript_path`` is their file's path or its end (whole folder names, so
    equal file names in two folders stay apart). Malformed files have no turns."""
    named = calls.select("call_id", "transcript_path", F.element_at(F.split("transcript_path", "/"), -1).alias("file_name"))
    t = transcripts.select("file_name", "file_path", "page_no", "items").join(named, "file_name").where(
        F.concat(F.lit("/"), F.col("file_path")).endswith(F.concat(F.lit("/"), F.col("transcript_path")))
        | ~F.contains("file_path", F.lit("/")))  # a line that knows only its file's name
    return C.turn_sequence(t).select("call_id", "pos", "role", F.get("content", 0).alias("text"), "interrupted")


def eval_prompts(requests: DataFrame, calls: DataFrame, turns: DataFrame) -> DataFrame:
    """One evaluator prompt per found request and transcript page. A call
    without text has one page with an empty transcript."""
    j = requests_calls_join(requests, calls).join(C.format_transcripts(turns), "call_id", "left")
    prompt = F.concat(F.lit(PROMPT_HEAD), F.col("evaluation_prompt"), F.lit(TRANSCRIPT_HEAD),
                      F.coalesce("transcript", F.lit("")))
    return j.select("request_id", "call_id", F.coalesce("page_no", F.lit(0)).alias("page_no"), "evaluation_prompt",
                    F.lit(SYSTEM_TEXT).alias("system_text"), prompt.alias("user_text"))


def call_facts(turns: DataFrame) -> DataFrame:
    """Per-call results of the rules: each rule is a column of the turn, and one
    grouping with partial aggregates (a long call is one row per task) combines
    them."""
    spoken = F.col("role") == "assistant"
    x = turns.select(
        "call_id", "pos", "role", "text",
        F.when(spoken, O.outcome_of("text")).alias("o"),
        F.when(spoken & (O.solution_source_of("text") != "none"), F.col("pos")).alias("solved_at"),
        (spoken & O.is_long_turn("text")).alias("long"),
        F.when(spoken, O.word_tokens("text")).alias("tokens"))
    x = x.withColumn("foreign", O.breaks_language_policy(O.language_of(F.col("tokens"))))
    g = x.groupBy("call_id").agg(
        F.max_by("o", F.when(F.col("o").isNotNull(), F.col("pos"))).alias("o"),
        F.min_by(F.struct("role", "text"), "pos").alias("f"),
        F.min(F.when(F.col("role") == "user", F.col("pos"))).alias("user_at"), F.min("solved_at").alias("solved_at"),
        F.count_if("long").alias("n_long_turns"), F.count_if("foreign").alias("n_language_violations"))
    early = F.col("solved_at").isNotNull() & (F.col("user_at").isNull() | (F.col("solved_at") < F.col("user_at")))
    return g.select("call_id", F.coalesce("o", F.lit(O.OPEN_OUTCOME)).alias("outcome"),
                    F.coalesce((F.col("f.role") == "assistant") & O.asks_identity(F.col("f.text")), F.lit(False)).alias("greeted"),
                    early.alias("answered_before_identified"), "n_long_turns", "n_language_violations")


def rule_scorer(prompts: DataFrame, turns: DataFrame) -> DataFrame:
    """Default deterministic scorer: five pass/fail criteria from the rules,
    written as paragraphs separated by a blank line. A call without turns is
    open, without greeting and without violations. Only the ids of ``prompts``
    are read, never the prompt texts."""
    f = prompts.select("request_id", "call_id").distinct().join(call_facts(turns), "call_id", "left").select(
        "request_id", F.coalesce("outcome", F.lit(O.OPEN_OUTCOME)).alias("outcome"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("greeted", "answered_before_identified")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_long_turns", "n_language_violations")])
    passes = [F.col("outcome").isin("verified_resolved", "ai_resolved"), F.col("greeted"),
              ~F.col("answered_before_identified"), F.col("n_long_turns") == 0, F.col("n_language_violations") == 0]
    score = reduce(lambda a, b: a + b, [p.cast("int") for p in passes]) / F.lit(float(len(passes)))
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Outcome: "), F.col("outcome")),
        F.concat(F.lit("Greeting: "), F.when(F.col("greeted"), F.lit("ok")).otherwise(F.lit("missing"))),
        F.concat(F.lit("Identification before solution: "),
                 F.when(F.col("answered_before_identified"), F.lit("violated")).otherwise(F.lit("ok"))),
        F.concat(F.lit("Word limit: "), F.col("n_long_turns").cast("string"), F.lit(" long turns without a solution")),
        F.concat(F.lit("Language: "), F.col("n_language_violations").cast("string"), F.lit(" assistant turns not in Spanish")))
    return f.select("request_id", F.lit(0).cast("bigint").alias("page_no"), F.round(score, 6).alias("score"),
                    F.when(score >= 0.6, F.lit("pass")).otherwise(F.lit("fail")).alias("verdict"),
                    text.alias("result_text"))


def pandas_scorer(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Wrap a model call as an Arrow-batched ``mapInPandas`` over the prompt rows:
    ``fn`` gets a batch of prompts and returns ``score``, ``verdict`` and
    ``result_text`` for each of its rows, in their order."""
    def run(batches):
        for p in batches:
            r = fn(p)
            if len(r) != len(p):
                raise ValueError(f"the scorer returned {len(r)} rows for {len(p)} prompts")
            yield pd.DataFrame({c: x[c].to_numpy() for x, names in (
                (p, ("request_id", "page_no")), (r, ("score", "verdict", "result_text"))) for c in names})

    def scorer(prompts: DataFrame, turns: DataFrame) -> DataFrame:  # noqa: ARG001
        return prompts.mapInPandas(run, "request_id string, page_no bigint, score double, verdict string, result_text string")
    return scorer


def evaluate_calls(requests: DataFrame, calls: DataFrame, turns: DataFrame,
                   scorer: Callable[[DataFrame, DataFrame], DataFrame] = rule_scorer) -> DataFrame:
    """One result row per request: invalid, not found, or evaluated.
    ``turns`` are flat turns or stored transcripts (with ``items``), which are
    found by the call's ``transcript_path``. Results of a transcript's pages are
    put together: mean score, passed if all pages pass, texts in page order."""
    if "items" in turns.columns:
        turns = stored_turns(turns, calls)
    v = valid_requests(requests)
    once = v.filter(F.col("status") == "valid").dropDuplicates(["request_id"])
    # the rules need the turns alone, so no transcript is laid out for them
    prompts = requests_calls_join(once, calls) if scorer is rule_scorer else eval_prompts(once, calls, turns)
    scored = scorer(prompts, turns).groupBy("request_id").agg(
        F.avg("score").alias("score"), F.min(F.col("verdict") == "pass").alias("passed"),
        F.array_sort(F.collect_list(F.struct("page_no", "result_text"))).alias("pages"))
    scored = scored.select("request_id", "score", F.when(F.col("passed"), F.lit("pass")).otherwise(F.lit("fail")).alias("verdict"),
                           F.array_join(F.transform("pages", lambda p: p["result_text"]), "\n\n").alias("result_text"))
    known = calls.select("call_id").distinct().withColumn("known", F.lit(True))
    ok = (F.col("status") == "valid") & F.col("known").isNotNull()
    message = F.when(F.col("status") == "invalid", F.col("reason")).when(F.col("known").isNull(), _not_found())
    return v.join(known, "call_id", "left").join(scored, "request_id", "left").select(
        "request_id", "call_id", "evaluation_prompt", F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        message.alias("message"), "score", "verdict", "result_text")


def evaluation_report(results: DataFrame) -> DataFrame:
    """K6: report rows ``(request_id, call_id, section, para_no, text)`` in reading
    order; results are split into paragraphs at blank lines."""
    ok = results.filter(F.col("status") == "ok")
    head = ok.select("request_id", "call_id", F.explode(F.array(
        F.struct(F.lit("title").alias("section"), F.lit(0).alias("para_no"), F.lit(REPORT_TITLE).alias("text")),
        F.struct(F.lit("call").alias("section"), F.lit(0).alias("para_no"),
                 F.concat(F.lit(CALL_LINE), F.col("call_id").cast("string")).alias("text")),
        F.struct(F.lit("criteria").alias("section"), F.lit(0).alias("para_no"), F.lit(CRITERIA_HEADING).alias("text")),
        F.struct(F.lit("criteria").alias("section"), F.lit(1).alias("para_no"), F.col("evaluation_prompt").alias("text")),
        F.struct(F.lit("results").alias("section"), F.lit(0).alias("para_no"), F.lit(RESULTS_HEADING).alias("text")),
    )).alias("r")).select("request_id", "call_id", "r.section", "r.para_no", "r.text")
    paras = ok.select("request_id", "call_id", F.posexplode(F.split("result_text", "\n\n")).alias("p", "text")).select(
        "request_id", "call_id", F.lit("results").alias("section"), (F.col("p") + 1).alias("para_no"), "text")
    return head.unionByName(paras).withColumn("para_no", F.col("para_no").cast("int"))
