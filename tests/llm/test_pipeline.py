"""Every stage of the pipeline against a plain replay on its own input."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
import public_tokenizers
from helpline.llm import bpe, pii, toxicity
from helpline.llm.common import table
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = [n for n, _ in P.STAGES]


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest table, with a null and a blank text, repeated rows, null ids and sources, a very long text,
    texts with a long run, and an extra column whose name clashes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit("mine"))
    odd = [(9001, None, "en", "src0"), (9002, "", "en", None), (9003, " \t\n", "en", "src1"), (None, "no id but words here, six of them", None, None),
           (9004, "plain and harmless text of some words " * 9_000, "en", "src0"), (9005, "a" + " " * 60_000 + "b", "en", "src2"),
           (9006, "mail jo@example.org or +1 212 555 0199 twice", "en", "src0"), (9006, "mail jo@example.org or +1 212 555 0199 twice", "en", "src0"),
           (9007, "4" * 50_000, "en", "src0")]
    more = spark.createDataFrame([(i, t, la, s, len(t or ""), "mine") for i, t, la, s in odd],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    return docs.select(*more.columns).unionByName(more)


@pytest.fixture(scope="module")
def run(spark, documents):
    """Input and output rows of every stage; each is written and read again, as the pipeline does."""
    from helpline.session import materialize
    out, before = {}, materialize(documents, "test-documents")
    for name, stage in P.STAGES:
        after = materialize(stage(spark, before, SF), "test-stage")
        if name != NAMES[-1]:
            assert after.columns == before.columns, name
        out[name] = before, after
        before = after
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_keeps_what_the_kernel_scores_below_one_half(spark, run):
    before, after = run["toxicity"]
    model = toxicity.fit(before.select("doc_id", "text"), table(spark, SF, "labels"))
    scores = {}

    def margin(word):  # every subsequence of three within five places, through the folded table
        if word not in scores:
            classes = [int(toxicity.CLASSES[ord(c)]) for c in word if ord(c) < 0x10000]
            marked = [toxicity.BEGIN, *(c for c in classes if c >= 0), toxicity.END]
            total = norm = 0.0
            for at, b, c in itertools.combinations(range(len(marked)), 3):
                if c - at < toxicity.SPAN:
                    w = toxicity.DECAY ** (c - at)
                    total += w * model.table[(marked[at] << 12) | (marked[b] << 6) | marked[c]]
                    norm += w * w
            scores[word] = model.bias + total / math.sqrt(max(norm, 1e-12))
        return scores[word]
    want = Counter()
    for r in before.collect():
        worst = max((margin(w) for w in set(toxicity.words_of(r.text or ""))), default=toxicity.FLOOR)
        if 1 / (1 + math.exp(-max(-40, min(40, model.slope * worst + model.offset)))) < 0.5:
            want[tuple(r)] += 1
    assert rows(after) == want and 0 < sum(want.values()) < before.count()


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicates_keep_the_least_id_of_each_class(run):
    before, after = run["near duplicates"]
    rows_ = before.collect()
    bags, label = [shingles(r.text) for r in rows_], list(range(len(rows_)))
    size = [sum(b.values()) for b in bags]
    for i in range(len(rows_)):
        for j in range(i):
            if label[i] != label[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]):
                both = sum((bags[i] & bags[j]).values())
                if (both >= 0.8 * (size[i] + size[j] - both)) if both else (rows_[i].text or "") == (rows_[j].text or ""):
                    label = [label[j] if x == label[i] else x for x in label]
    classes = {}
    for r, x in zip(rows_, label):
        classes.setdefault(x, []).append(r)
    kept = [min(c, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for c in classes.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
    assert not rows(after) - rows(before)


LOCAL, PATTERNS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", {
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    yield from (("email", *m.span()) for m in regex.finditer(LOCAL, text))
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text if len(text) < 20_000 else re.sub("[0-9]{200,}", lambda x: "x" * len(x[0]), text)):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            if {"ip": all(int(x) <= 255 for x in m[0].split(".") if len(x) < 9) and all(len(x) < 9 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                yield (kind, *m.span())


def test_personal_data_is_blanked_span_by_span(run):
    before, after = run["personal data"]
    model = pii.fit(before.select("doc_id", "text"))
    want = Counter()
    for r in before.collect():
        text = r.text
        if text is not None:
            base = set(base_spans(text))
            # candidates beside the base spans: those that the classifier's own formula accepts
            wide = {(k, a, b) for k, a, b, st, v in pii.candidates(text) if st == 0 and k in model.weights
                    and 1 / (1 + math.exp(-float(model.weights[k] @ pii._one_hot(v)))) >= pii.KEEP_AT}
            out, at = "", 0
            for a, b, k in sorted((a, b, pii.KINDS.index(k)) for k, a, b in base | wide):
                if a >= at:
                    out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
                at = max(at, b)
            text = out + text[at:]
        want[tuple({**r.asDict(), "text": text, "n_chars": None if text is None else len(text)}.values())] += 1
    assert rows(after) == want
    assert any("[EMAIL]" in (r.text or "") for r in after.collect()) and not any("@mail" in (r.text or "") for r in after.collect())


def test_mixing_takes_every_row_as_often_as_the_water_level_says(run):
    import hashlib
    before, after = run["mixing"]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    docs = [(r, len(WORD.findall(r.text or ""))) for r in before.collect()]
    order = sorted({r.source for r, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for r, n in docs if r.source == s) for s in order}
    w, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s, x in share.items() if x > 2 * size[s]}
        if not over:
            break
        full |= over
    want = Counter()
    for s in order:
        target = 2.0 * size[s] if s in full else share[s]
        whole = math.floor(target / size[s]) if size[s] else 0
        rest, upto = target - whole * size[s], 0
        own = [(md5("|".join(("mix", "" if r.doc_id is None else str(r.doc_id), md5(r.text or "")))), n, r) for r, n in docs if r.source == s]
        for key, n, r in sorted(own, key=lambda x: x[:2]):
            upto += n
            want[tuple(r)] += whole + (rest > 0 and upto - n / 2 <= rest)
    assert max((+want).values()) <= 2
    # blank texts move no words: where exactly they fall around the cut is open
    some = lambda c: Counter({k: v for k, v in c.items() if WORD.search(k[before.columns.index("text")] or "")})
    assert some(rows(after)) == +some(want) and not rows(after) - Counter({tuple(r): 2 for r, _ in docs})


def test_encoding_equals_the_library(run):
    before, after = run["encoding"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before.collect():
        ids = own.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in after.collect()) == want


def test_empty_table_passes_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
