import json
import os

from pyspark.sql import functions as F

from helpline.operators import calls as C
from helpline.operators import evaluate as E
from helpline.operators import outcomes as O
from helpline.sinks import writers
from helpline.sources.files import scan_requests, scan_transcripts


def _write(tmp, name, obj):
    with open(os.path.join(tmp, name), "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_scan_and_format_transcripts(spark, tmp):
    items = [
        {"id": "1", "type": "message", "role": "assistant", "content": ["Hola, ¿su nombre y empresa?"], "interrupted": False},
        {"id": "2", "type": "message", "role": "user", "content": ["Ana, Acme", "extra"], "interrupted": False},
        {"id": "3", "type": "message", "role": "assistant", "content": [""], "interrupted": True},
        {"id": "4", "type": "function_call", "role": "assistant"},
        {"id": "5", "type": "message", "role": "system", "content": ["rules"], "interrupted": False},
        {"id": "6", "type": "message", "role": "user", "content": [], "interrupted": False},
    ]
    _write(tmp, "transcript_2031-04-05_06-07-08_7.json", {"items": items})
    _write(tmp, "transcript_2031-04-05_09-10-11.json", {"other": 1})
    _write(tmp, "transcript_2031-04-06_12-13-14_9.json", "{not json")
    t = scan_transcripts(spark, tmp).withColumn("text", C.format_items(F.col("items")))
    rows = {r["file_name"]: r for r in t.collect()}
    r = rows["transcript_2031-04-05_06-07-08_7.json"]
    assert r["call_id"] == 7 and str(r["started_at"]) == "2031-04-05 06:07:08"
    assert r["text"] == "Assistant: Hola, ¿su nombre y empresa?\nUser: Ana, Acme\nAssistant: \nUser: rules"
    assert rows["transcript_2031-04-05_09-10-11.json"]["text"] == ""  # items missing -> empty
    no_sys = t.select("file_name", C.format_items(F.col("items"), keep_system=False).alias("x")).collect()
    assert {r["file_name"]: r["x"] for r in no_sys}["transcript_2031-04-05_06-07-08_7.json"] == \
        "Assistant: Hola, ¿su nombre y empresa?\nUser: Ana, Acme\nAssistant: "
    assert rows["transcript_2031-04-06_12-13-14_9.json"]["malformed"]
    seq = C.turn_sequence(t.select("call_id", "items")).filter(F.col("call_id") == 7)
    assert [x["pos"] for x in seq.orderBy("pos").collect()] == list(range(6))


def _turns(spark):
    rows = [(1, 0, "assistant", "Buenos días, ¿me dice su nombre y empresa?"), (1, 1, "user", "Ana de Acme"),
            (1, 2, "assistant", "He encontrado una solución verificada: reinicie el equipo."),
            (1, 3, "user", "funcionó"), (1, 4, "assistant", "Qué bueno haberle ayudado."),
            (2, 0, "user", "hello"), (2, 1, "assistant", "No se encontró una solución verificada, solución generada por IA."),
            (2, 2, "assistant", "the cat and the dog is in the house with the bird"),
            (3, 0, "system", "rules")]
    return spark.createDataFrame(rows, "call_id long, pos long, role string, text string")


def test_outcomes_and_rules(spark):
    t = _turns(spark)
    out = {r["call_id"]: r["outcome"] for r in O.call_outcome(t).collect()}
    assert out == {1: "verified_resolved", 2: "open", 3: "open"}
    src = {(r["call_id"], r["pos"]): r["solution_source"] for r in O.solution_source(t).collect()}
    assert src[(1, 2)] == "verified" and src[(2, 1)] == "ai_generated" and src[(1, 4)] == "none"
    g = {r["call_id"]: r["greeted"] for r in O.greeting_check(t).collect()}
    assert g == {1: True, 2: False, 3: False}
    a = {r["call_id"]: r["answered_before_identified"] for r in O.answered_before_identified(t).collect()}
    assert a == {1: False, 2: False, 3: False}
    lang = {(r["call_id"], r["pos"]): (r["detected_lang"], r["violation"]) for r in O.language_policy(t).collect()}
    assert lang[(2, 2)] == ("en", True) and lang[(1, 2)][1] is False
    pairs = C.reply_pairs(t).collect()
    assert {(p["call_id"], p["user_pos"], p["reply_pos"]) for p in pairs} == {(1, 1, 2), (1, 3, 4), (2, 0, 1)}
    m = {r["call_id"]: r for r in C.call_metrics(t).collect()}
    assert m[1]["n_assistant"] == 3 and m[3]["n_other"] == 1 and m[1]["first_role"] == "assistant"


def test_evaluate_requests(spark, tmp):
    _write(tmp, "r.json", '{"call_id": 1, "evaluation_prompt": "check"}\n{"call_id": 99, "evaluation_prompt": "x"}\n'
                          '{"call_id": 2}\n{"call_id": 3, "evaluation_prompt": ""}\n')
    req = scan_requests(spark, os.path.join(tmp, "r.json"))
    calls = spark.createDataFrame([(1, "room-1", "t1.json"), (3, "room-3", "t3.json")],
                                  "call_id long, room_name string, transcript_path string")
    turns = _turns(spark)
    res = {r["call_id"]: r for r in E.evaluate_calls(req, calls, turns).collect()}
    assert res[2]["status"] == "error" and res[2]["message"] == E.MISSING_FIELDS
    assert res[99]["status"] == "error" and "not found" in res[99]["message"]
    assert res[1]["status"] == "ok" and res[1]["verdict"] == "pass"
    assert res[3]["status"] == "ok"  # empty prompt accepted, call 3 has only a system turn
    rep = E.evaluation_report(E.evaluate_calls(req, calls, turns)).filter(F.col("call_id") == 1).orderBy("section", "para_no").collect()
    assert rep[0]["text"] == E.REPORT_TITLE if rep[0]["section"] == "title" else True
    assert sum(1 for r in rep if r["section"] == "results") == 6


def test_custom_scorer_runs_in_pandas(spark):
    import pandas as pd
    turns = _turns(spark)
    calls = spark.createDataFrame([(1, "room-1", "t1.json")], "call_id long, room_name string, transcript_path string")
    req = spark.createDataFrame([(1, "check")], "call_id long, evaluation_prompt string")

    def model(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": [1.0] * len(p), "verdict": "pass", "result_text": "fine"})
    r = E.evaluate_calls(req, calls, turns, scorer=E.pandas_scorer(model)).first()
    assert r["result_text"] == "fine"


CALL = "call_id long, started_at timestamp_ntz, transcript_path string"


def test_every_request_gets_its_own_answer(spark):
    import datetime as dt

    import pandas as pd
    at = dt.datetime(2031, 4, 5, 6, 7, 8)
    calls = spark.createDataFrame([(1, at, "x/a.json"), (3, at, "x/c.json"), (8, at, "x/h.json")], CALL)
    rows = [(1, "first"), (1, "second"), (1, "second"), (8, "no text"), (99, "m1"), (99, "m2"), (99, None), (None, "x"), (1, "")]
    req = spark.createDataFrame(rows, "call_id long, evaluation_prompt string")

    def model(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": [0.5] * len(p), "verdict": "fail", "result_text": "for " + p["user_text"].str.split("\n").str[0]})
    res = [r.asDict() for r in E.evaluate_calls(req, calls, _turns(spark), scorer=E.pandas_scorer(model)).collect()]
    assert sorted((r["call_id"] or 0, r["evaluation_prompt"] or "-") for r in res) == sorted((c or 0, p or "-") for c, p in rows)
    for r in res:
        if r["status"] == "ok":
            assert r["result_text"] == "for " + E.PROMPT_HEAD + r["evaluation_prompt"]
        else:
            assert r["score"] is None and r["call_id"] in (99, None)
    assert sorted(r["evaluation_prompt"] for r in res if r["message"] == "Call with ID 99 not found") == ["m1", "m2"]
    assert len({r["request_id"] for r in res}) == len(set(rows))
    rep = E.evaluation_report(E.evaluate_calls(req, calls, _turns(spark)))
    heads = rep.filter("section = 'criteria' AND para_no = 1 AND call_id = 1").select("request_id", "text").distinct().collect()
    assert {r["text"] for r in heads} == {"first", "second", ""} and len(heads) == 3


def test_evaluation_reads_the_transcript_that_the_register_names(spark, tmp):
    import datetime as dt
    t = C.build_transcripts(_turns(spark)).withColumn("file_name", F.concat(F.lit("kept-"), (F.col("call_id") + 100).cast("string")))
    writers.write_transcripts(t.drop("call_id"), os.path.join(tmp, "t"))
    stored = scan_transcripts(spark, os.path.join(tmp, "t"), multi_line=False)
    at = dt.datetime(2031, 4, 5, 6, 7, 8)
    # call 2's register row names the file of call 1, call 5's a file that is not there
    calls = spark.createDataFrame([(2, at, "x/kept-101"), (5, at, "x/none.json")], CALL)
    req = spark.createDataFrame([("r", 2, "check"), ("s", 5, "check")], "request_id string, call_id long, evaluation_prompt string")
    got = {r["request_id"]: r for r in E.evaluate_calls(req, calls, stored).collect()}
    flat = E.evaluate_calls(req.withColumn("call_id", F.lit(1)), calls.withColumn("call_id", F.lit(1)), _turns(spark)).first()
    assert got["r"]["result_text"] == flat["result_text"] and got["r"]["score"] == flat["score"]
    assert got["s"]["status"] == "ok" and got["s"]["result_text"].startswith("Outcome: open")


def test_one_grouping_gives_what_the_single_rules_give(spark):
    from helpline.operators import outcomes as O
    t = _turns(spark)
    facts = {r["call_id"]: r for r in E.call_facts(t).collect()}
    for rule, name in ((O.call_outcome, "outcome"), (O.greeting_check, "greeted"), (O.answered_before_identified, "answered_before_identified")):
        assert {r["call_id"]: r[name] for r in rule(t).collect()} == {k: f[name] for k, f in facts.items()}
    assert {r["call_id"]: r["n"] for r in O.language_policy(t).filter("violation").groupBy("call_id").agg(F.count("*").alias("n")).collect()} \
        == {k: f["n_language_violations"] for k, f in facts.items() if f["n_language_violations"]}


def test_format_transcripts_can_drop_system_turns(spark):
    t = _turns(spark)
    keep = {r["call_id"]: r["transcript"] for r in C.format_transcripts(t).collect()}
    drop = {r["call_id"]: r["transcript"] for r in C.format_transcripts(t, keep_system=False).collect()}
    assert keep[3] == "User: rules" and 3 not in drop
    assert keep[1] == drop[1]


def test_equal_file_names_in_two_folders_stay_apart(spark, tmp):
    import datetime as dt
    from helpline.operators.evaluate import stored_turns
    at = dt.datetime(2031, 4, 5)
    for folder, said in (("a/transcripts", "from a"), ("b/transcripts", "from b")):
        os.makedirs(os.path.join(tmp, folder))
        with open(os.path.join(tmp, folder, "t.json"), "w") as f:
            json.dump({"items": [{"id": "1", "type": "message", "role": "user", "content": [said], "interrupted": False}]}, f)
    stored = scan_transcripts(spark, f"{tmp}/*/transcripts")
    calls = spark.createDataFrame([(1, at, "a/transcripts/t.json"), (2, at, "b/transcripts/t.json"), (3, at, "c/t.json")], CALL)
    assert sorted((r["call_id"], r["text"]) for r in stored_turns(stored, calls).collect()) == [(1, "from a"), (2, "from b")]


def test_phrases_are_an_argument(spark):
    from helpline.operators import outcomes as O
    t = spark.createDataFrame([(1, 0, "assistant", "Asunto cerrado, gracias"), (1, 1, "assistant", "con la máquina")],
                              "call_id long, pos long, role string, text string")
    assert O.call_outcome(t).first()["outcome"] == "open"
    assert O.call_outcome(t, [("asunto cerrado", "verified_resolved")]).first()["outcome"] == "verified_resolved"
    assert [r["solution_source"] for r in O.solution_source(t, ["con la maquina"]).orderBy("pos").collect()] == ["none", "ai_generated"]
