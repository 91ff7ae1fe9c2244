"""Very long texts, large counts, and workers that cannot import the package."""

import itertools
import os
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from helpline.llm import bpe, chat, lm, mixing, pii, toxicity
from tests.conftest import ROOT, SF

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_chat_keeps_a_conversation_of_70_mb(spark):
    n = 14_000_000
    rows = spark.range(1).select(F.lit(1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"),
                                 F.expr(f"repeat('a \"<b', {n})").alias("text")).union(
        spark.createDataFrame([(1, 1, "assistant", "yes"), (2, 0, "user", "x"), (2, 1, "assistant", "y")],
                              "conv_id bigint, turn bigint, role string, text string"))
    out = {r.conv_id: r for r in chat.format_records(chat.records_of(rows), strict=True).select(
        "conv_id", "layout_hash", F.length("formatted").alias("n"), F.size("turns").alias("turns"),
        F.sha2(F.col("turns")[0]["text"], 256).alias("hash"), "loss_mask").collect()}
    assert out[1].turns == 2 and out[1].layout_hash == out[2].layout_hash
    assert out[1].n == 6 * n + 3 + 2 * len("<turn><text></turn>\n") + len("userassistant")
    want = spark.range(1).select(F.sha2(F.expr(f"repeat('a \"<b', {n})"), 256)).first()[0]
    assert out[1].hash == want and out[1].loss_mask[0].length == 3


def test_chat_skeleton_keeps_the_paths(spark):
    odd = ['{"a":"b\\"c:\\\\","d":["x","y",{"e":"f"}],"g":1}', '{"m":[{"r":"a","c":"b"},{"r":"c","c":"d"},{"r":"e","c":null}]}',
           '{"a": "b" "c"}', '{"a":"b', '{"a":"\\q"}', "[]", '"text"', '{":":"v","a":1,"":"w"}', '{"a":"\\u00e9\\n"}']
    df = spark.createDataFrame([(x,) for x in odd], "r string")
    own = F.md5(F.schema_of_variant(F.try_parse_json(F.col("r"))))
    for r in df.select("r", own.alias("own"), chat.fingerprint(F.col("r")).alias("cut"), chat.skeleton(F.col("r")).alias("s")).collect():
        assert r.own == r.cut, (r.r, r.s)
    many = '{"messages":[' + ",".join(['{"role":"u","content":"some text"}'] * 50) + "]}"
    assert spark.createDataFrame([(many,)], "r string").select(chat.skeleton(F.col("r"))).first()[0] == '{"messages":[{"role":"x","content":"x"}]}'
    with pytest.raises(Exception, match="undeclared layout"):
        chat.format_records(spark.createDataFrame([('{"other":1}',)], "record string"), strict=True).collect()


def test_bpe_survives_a_million_blanks(spark):
    rows = [(1, "a" + " " * 1_200_000 + "b"), (2, "\n" * 1_000_001), (3, "x " * 30 + " " * 20_000 + "y"), (4, "x" * 200_000)]
    c = bpe.Bpe(spark, RANKS, public_tokenizers.PATTERN)
    out = {r.doc_id: r for r in c.decode(c.encode(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert all(bytes(out[i].decoded).decode() == t for i, t in rows)
    plain = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    whole = np.array(plain.piece.encode_ordinary(rows[2][1]), "<u4").tobytes()  # short enough for the encoder's own split
    assert plain.encode(rows[2][1]) == whole == bytes(out[3].ids)


@pytest.mark.parametrize("text", ["1" * 10**6, "jo [at] " + "a" * 10**6, "a" * 10**6 + " [at] b", "1." * 500_000, " at " * 250_000,
                                  "+1(" * 300_000, "a@" * 500_000, "a [at] " + "b dot " * 160_000])
def test_pii_reads_long_runs_in_linear_time(text):
    t0 = time.time()
    pii.candidates(text)
    assert time.time() - t0 < 20  # quadratic: an hour


def test_pii_gazetteers():
    vote = lambda kind, s: pii.votes(s, kind, 0, len(s), False)[2]
    assert vote("phone", "+49 301 234 5678") == vote("phone", "00351 212 345 678") == 1
    assert vote("phone", "+210 301 2345") == vote("phone", "+999 301 2345") == -1
    assert vote("ip", "8[.]8[.]4[.]4") == 1 and vote("ip", "0[.]1[.]2[.]3") == vote("ip", "255[.]1[.]2[.]3") == vote("ip", "203[.]0[.]113[.]9") == -1
    assert vote("email", "jo at mail dot museum") == vote("email", "jo at mail dot pt") == 1 and vote("email", "jo at mail dot then") == -1


def test_lm_totals_pass_32_bits():
    big = np.array([2**32 + 5, 0, 2**40])
    assert lm.unpack(lm.pack(big, lm.TOTAL), lm.TOTAL).tolist() == big.tolist()


def test_mix_takes_blank_texts_at_most_twice(spark):
    rows = [(i, "a", "") for i in range(40)] + [(100 + i, "a", "one two") for i in range(3)] + [(200 + i, "b", "x " * 400) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    n = {r.doc_id: r["count"] for r in mixing.apply_mix(docs, weights=(3, 1)).groupBy("doc_id").count().collect()}
    assert all(n.get(100 + i) == 2 for i in range(3)) and max(n.values()) == 2  # source a is clamped at 2 epochs


def test_toxicity_kernel_equals_enumeration():
    """All subsequences of three characters within five places, each with its decay."""
    def vector(word):
        classes = [int(toxicity.CLASSES[ord(c)]) for c in word if ord(c) < 0x10000]
        marked = [toxicity.BEGIN, *(c for c in classes if c >= 0), toxicity.END]
        out, squares = {}, 0.0
        for at in itertools.combinations(range(len(marked)), 3):
            if at[2] - at[0] < toxicity.SPAN:
                w = toxicity.DECAY ** (at[2] - at[0])
                key = tuple(marked[i] for i in at)
                out[key] = out.get(key, 0.0) + w
                squares += w * w
        return out, squares ** 0.5
    words = ["zwoxel", "zwoaxel", "banana", "b.a.n.a", "x", "", "0range$", "\U0001f600zw", "mississippi"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            (x, nx), (y, ny) = vector(a), vector(b)
            want = sum(v * y.get(k, 0.0) for k, v in x.items()) / max(nx, 1e-6) / max(ny, 1e-6)
            assert abs(got[i, j] - want) < 1e-9, (a, b)


def test_toxicity_sample_holds_one_text_of_an_id(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(i, " ".join([word(), word(), "zwoxel" if i % 2 else word(), word(), word()])) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    once, seen = spark.createDataFrame(rows, "doc_id bigint, text string"), []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda s: seen.append(s) or train(s))
    a, b = toxicity.fit(once, labels), toxicity.fit(once.union(once.where("doc_id < 4")), labels)
    assert seen[0] == seen[1] and np.array_equal(a.table, b.table)
    many = once.union(spark.createDataFrame([(1, f"other text number {k}") for k in range(500)], "doc_id bigint, text string"))
    toxicity.fit(many, labels)
    assert len(seen[2]) <= len(seen[0])


SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
q = E.queries()
for k in q:
    if k == "pipeline" or k.startswith("op"):
        assert q[k](spark, {SF!r}).count() > 0, k
print("portable-ok")
"""


def test_every_query_runs_where_workers_cannot_import_the_package(tmp):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp, env=env, capture_output=True, text=True, timeout=1800)
    assert "portable-ok" in r.stdout, r.stderr[-3000:]
