"""Language of a text by a trained model (C7): naive Bayes over hashed letter trigrams.

Trigrams of lower-case letters, with a blank at either side of a word, are counted per language
by partial aggregates; the model is one table of bounded size (languages x ``BUCKETS``
log probabilities), whatever the corpus. A text is given the language of the greatest
sum; a text with fewer than ``LEAST`` trigrams is 'unknown'."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.operators.outcomes import breaks_language_policy

BUCKETS = 1 << 14
LEAST = 3          # trigrams a text needs
MAX_LANGUAGES = 64  # the most frequent ones are learnt
A, B = 961, 31     # trigram hash: (A * first + B * second + third) modulo BUCKETS, of code points
UNKNOWN = "unknown"


def padded(column: str) -> F.Column:
    """Lower-case words with one blank before, between and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: str) -> np.ndarray:
    """Hash of every three neighbours of a padded text."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (A * c[:-2] + B * c[1:-1] + c[2:]) % BUCKETS if len(c) > 2 else np.zeros(0, np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # languages x BUCKETS, log probabilities

    def predict(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``detected_lang``."""
        sent = texts.sparkSession.sparkContext.broadcast((self.languages, self.weights))

        @F.pandas_udf("string")
        def best(s: pd.Series) -> pd.Series:
            names, weights = sent.value
            out = []
            for t in s:
                g = trigrams(t)
                out.append(names[int(np.argmax(weights[:, g].sum(axis=1)))] if names and len(g) >= LEAST else UNKNOWN)
            return pd.Series(out, dtype=object)
        return texts.withColumn("detected_lang", best(padded(text)))


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Labelled texts -> model (add-one smoothing). Rows without a label are left out; ties
    between languages go to the first in code-point order."""
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b["lang"], b["t"]):
                held[name] = held.get(name, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
        for name, c in held.items():
            own = np.flatnonzero(c)
            yield pd.DataFrame({"lang": name, "bucket": own, "n": c[own]})
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), padded(text).alias("t"))
    counts = known.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.col("docs").desc(), "lang").limit(MAX_LANGUAGES)
    rows = counts.join(F.broadcast(most.select("lang")), "lang").collect()  # at most MAX_LANGUAGES x BUCKETS
    names = sorted({r["lang"] for r in rows})
    table = np.ones((len(names), BUCKETS))
    for r in rows:
        table[names.index(r["lang"]), r["bucket"]] += r["n"]
    return LanguageModel(names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table)


def language_policy(turns: DataFrame, model: LanguageModel) -> DataFrame:
    """The language of every assistant turn and whether it breaks the policy."""
    a = model.predict(turns.where(F.col("role") == "assistant").select("call_id", "pos", "text"))
    return a.select("call_id", "pos", "detected_lang", breaks_language_policy(F.col("detected_lang")).alias("violation"))
