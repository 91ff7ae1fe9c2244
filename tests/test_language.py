"""The trained language model: held-out accuracy, against the stop-word list, and by hand."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helpline.operators import language as LG
from helpline.operators import outcomes as O


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = docs.where("doc_id % 5 = 0")
    # whole texts, and ten words out of each
    model = LG.fit_languages(docs.where("doc_id % 5 <> 0"))
    short = held.withColumn("text", F.array_join(F.slice(F.split("text", r"\s+"), 3, 10), " "))
    words = O.language_of(O.word_tokens("text"))
    share = lambda df, c: df.select(F.avg((c == F.col("lang")).cast("int"))).first()[0]
    assert share(model.predict(held), F.col("detected_lang")) > 0.97
    trained, listed = share(model.predict(short), F.col("detected_lang")), share(short, words)
    assert trained > 0.85 and trained > listed


def test_equals_counting_by_hand(spark):
    rows = [("es", "la casa de la abuela"), ("es", "Él está aquí"), ("en", "the house of the queen"), (None, "left out"), ("en", None), ("de", "")]
    model = LG.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    pad = lambda t: " " + re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip() + " "
    grams = lambda t: [(LG.A * ord(a) + LG.B * ord(b) + ord(c)) % LG.BUCKETS for a, b, c in zip(pad(t), pad(t)[1:], pad(t)[2:])]
    assert model.languages == ["en", "es"]  # a language without a trigram is not learnt
    for name, w in zip(model.languages, model.weights):
        c = Counter(g for lang, t in rows if lang == name for g in grams(t))
        want = [math.log((c[b] + 1) / (sum(c.values()) + LG.BUCKETS)) for b in range(LG.BUCKETS)]
        assert np.allclose(w, want)
    asked = spark.createDataFrame([(1, 0, "assistant", "la abuela está"), (1, 1, "assistant", "the queen"), (1, 2, "assistant", ""),
                                   (1, 3, "assistant", None), (1, 4, "user", "the"), (1, 5, "assistant", "42 !")],
                                  "call_id long, pos long, role string, text string")
    got = {r["pos"]: (r["detected_lang"], r["violation"]) for r in LG.language_policy(asked, model).collect()}
    assert got == {0: ("es", False), 1: ("en", True), 2: ("unknown", False), 3: ("unknown", False), 5: ("unknown", False)}


def test_without_labels_everything_is_unknown(spark):
    none = LG.fit_languages(spark.createDataFrame([(None, "x y z")], "lang string, text string"))
    got = none.predict(spark.createDataFrame([("some text",)], "text string")).first()
    assert none.languages == [] and got["detected_lang"] == LG.UNKNOWN
