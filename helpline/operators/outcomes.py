"""Checkable rules of the agent's instructions, applied to whole tables of
turns: outcome per call (C1), outcome shares (A11), word limit (C2),
interruption rate (C3), solution source (C4), greeting (C5), solution before
identification (C6), language policy (C7). Matching is on lower-case,
accent-folded text with built-in string functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpline.functions.columns import fold_accents, word_count

# Closing phrases (folded, lower case) and the outcome each one marks, in
# priority order. The instructions prescribe the wording of the first three; that of the
# fourth, and of the AI solutions below, is this library's Spanish for what they ask for in
# English, so another wording counts as open or none: give the phrases in use as argument.
OUTCOME_PHRASES = [
    ("que bueno haberle ayudado", "verified_resolved"),
    ("me alegra que haya podido resolver su problema", "ai_resolved"),
    ("desea ser transferido a una persona real", "transfer_offered"),
    ("no pudo ser identificado", "unidentified"),
]
OPEN_OUTCOME = "open"
# Wording that marks an AI-generated vs a verified solution.
AI_SOLUTION_PHRASES = ["generada por ia", "no se encontro una solucion verificada"]
VERIFIED_SOLUTION_PHRASE = "solucion verificada"
SOLUTION_WORD = "solucion"
GREETING_WORDS = ["nombre", "empresa"]
WORD_LIMIT = 40
POLICY_LANGUAGE = "es"
# A small stop-word list per language for the language vote,
# with the priority that breaks equal votes (higher wins).
STOP_WORDS = {
    "es": ["el", "la", "de", "que", "y", "en", "los", "las", "por", "una", "para", "con"],
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "with", "for", "was", "this"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "dans", "pour", "qui", "du", "en"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu", "mit", "den", "für", "auf"],
}
LANG_PRIORITY = {"es": 4, "en": 3, "fr": 2, "de": 1}


def folded(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.lower(fold_accents(t))


def outcome_of(text: Column | str, phrases: list[tuple[str, str]] | None = None) -> Column:
    f = folded(text)
    expr = F.lit(None).cast("string")
    for phrase, outcome in reversed(phrases or OUTCOME_PHRASES):
        expr = F.when(f.contains(phrase), F.lit(outcome)).otherwise(expr)
    return expr


def solution_source_of(text: Column | str, ai_phrases: list[str] | None = None, verified: str = VERIFIED_SOLUTION_PHRASE) -> Column:
    f = folded(text)
    ai = reduce(lambda a, b: a | b, [f.contains(p) for p in ai_phrases or AI_SOLUTION_PHRASES])
    return (F.when(ai, F.lit("ai_generated"))
            .when(f.contains(verified), F.lit("verified")).otherwise(F.lit("none")))


def is_long_turn(text: Column | str, limit: int = WORD_LIMIT) -> Column:
    """More than ``limit`` words and no solution presented."""
    return (word_count(text) > limit) & ~folded(text).contains(SOLUTION_WORD)


def language_of(tokens: Column) -> Column:
    """Language with most stop-word hits in a token array (ties to the higher
    priority), 'unknown' without a hit."""
    def score(lang: str) -> Column:
        n = F.size(F.filter(tokens, lambda t: t.isin(*STOP_WORDS[lang])))
        return F.struct((n * 10 + LANG_PRIORITY[lang]).alias("v"), F.lit(lang).alias("lang"))
    hits = F.array(*[score(lang) for lang in STOP_WORDS])
    best = F.array_max(F.filter(hits, lambda h: h["v"] >= 10))
    return F.coalesce(best["lang"], F.lit("unknown"))


def breaks_language_policy(lang: Column) -> Column:
    return (lang != POLICY_LANGUAGE) & (lang != "unknown")


def word_tokens(text: Column | str) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def asks_identity(text: Column | str) -> Column:
    """The greeting that asks for name and company."""
    f = folded(text)
    return reduce(lambda a, b: a & b, [f.contains(w) for w in GREETING_WORDS])


def call_outcome(turns: DataFrame, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """Outcome of the last assistant turn carrying a closing phrase (``phrases``: other
    wordings, folded and lower case); calls without one are 'open'. ``max_by`` is a
    partial aggregate."""
    hits = (turns.filter(F.col("role") == "assistant").select("call_id", "pos", outcome_of("text", phrases).alias("o"))
            .filter(F.col("o").isNotNull())
            .groupBy("call_id").agg(F.max_by("o", "pos").alias("outcome"), F.max("pos").alias("outcome_pos")))
    ids = turns.select("call_id").distinct()
    return (ids.join(hits, "call_id", "left")
            .select("call_id", F.coalesce("outcome", F.lit(OPEN_OUTCOME)).alias("outcome"), "outcome_pos"))


def outcome_of_items(items: Column) -> Column:
    """C1 on a stored transcript, row-local: the closing phrase of the last
    assistant item that has one, else 'open'."""
    said = F.transform(F.filter(F.coalesce(items, F.array()), lambda i: i["role"] == "assistant"),
                       lambda i: outcome_of(F.get(i["content"], 0)))
    return F.coalesce(F.get(F.reverse(F.filter(said, lambda o: o.isNotNull())), 0), F.lit(OPEN_OUTCOME))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Calls and share per outcome (share over an unpartitioned window of
    one row per outcome -- a handful of rows)."""
    from pyspark.sql import Window
    g = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_calls"))
    return g.withColumn("share", F.round(F.col("n_calls") / F.sum("n_calls").over(Window.partitionBy()), 6))


def word_limit_violations(turns: DataFrame, limit: int = WORD_LIMIT) -> DataFrame:
    """Assistant turns longer than ``limit`` words that present no solution."""
    return (turns.filter((F.col("role") == "assistant") & is_long_turn("text", limit))
            .select("call_id", "pos", word_count("text").alias("n_words")))


def interruption_rate(turns: DataFrame) -> DataFrame:
    """Share of interrupted assistant turns per call."""
    a = turns.filter(F.col("role") == "assistant")
    flag = F.col("interrupted") if "interrupted" in turns.columns else F.lit(False)  # flat turns carry none
    return a.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_assistant"),
                                    F.round(F.avg(F.coalesce(flag, F.lit(False)).cast("int")), 6).alias("interruption_rate"))


def solution_source(turns: DataFrame, ai_phrases: list[str] | None = None, verified: str = VERIFIED_SOLUTION_PHRASE) -> DataFrame:
    """C4: verified / ai_generated / none for every assistant turn."""
    return (turns.filter(F.col("role") == "assistant")
            .select("call_id", "pos", solution_source_of("text", ai_phrases, verified).alias("solution_source")))


def greeting_check(turns: DataFrame) -> DataFrame:
    """The call opens with the assistant asking for name and company."""
    first = turns.groupBy("call_id").agg(F.min_by(F.struct("role", "text"), "pos").alias("f"))
    return first.select("call_id", F.col("f.role").alias("first_role"),
                        F.coalesce((F.col("f.role") == "assistant") & asks_identity(F.col("f.text")), F.lit(False)).alias("greeted"))


def answered_before_identified(turns: DataFrame) -> DataFrame:
    """A solution was offered before the client answered (first user turn)."""
    sol = F.when((F.col("role") == "assistant") & (solution_source_of("text") != "none"), F.col("pos"))
    g = turns.groupBy("call_id").agg(F.min(F.when(F.col("role") == "user", F.col("pos"))).alias("first_user_pos"),
                                     F.min(sol).alias("first_solution_pos"))
    flag = F.col("first_solution_pos").isNotNull() & (
        F.col("first_user_pos").isNull() | (F.col("first_solution_pos") < F.col("first_user_pos")))
    return g.select("call_id", "first_user_pos", "first_solution_pos", flag.alias("answered_before_identified"))


def language_policy(turns: DataFrame) -> DataFrame:
    """Per assistant turn, the language with most stop-word hits (ties to the
    higher priority; no hit -> 'unknown') and whether it breaks the policy.
    Row-local: the hits of each language are counted in the turn's token array."""
    a = turns.filter(F.col("role") == "assistant").select(
        "call_id", "pos", word_tokens("text").alias("tokens"))
    lang = language_of(F.col("tokens"))
    return a.select("call_id", "pos", lang.alias("detected_lang"),
                    breaks_language_policy(lang).alias("violation"))
