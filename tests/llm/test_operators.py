"""Brute-force, round-trip and edge-case tests of the training-data operators."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import public_tokenizers
from helpline.llm import bagminhash, bpe, chat, collisions, fingerprint, lengths, lm, mixing, pii, toxicity
from helpline.llm.common import connected_components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, "a rose is a rose is a rose and a rose"), (1, "a rose is a rose is a rose and a rose"), (2, None), (3, ""),
    (None, "no id here, mail me at jo@mail.example.org or +1 (212) 555-0199"), (5, "x" * 3000 + " " + "y z " * 900),
    (6, "one two three four five six seven"), (7, "one two three four five six eight"), (8, "ein Wort é中\U0001f600 \t\n mehr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, nulls, empty and long texts; extra columns whose names clash with the operators' own."""
    rows = [(i, t, "src" if n % 3 else None, n, 7.0, "k") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, uid int, key double, band string")


def words(text):
    return WORD.findall((text or "").lower())


def test_lm_equals_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 40)
    monkeypatch.setattr(lm, "BUCKET", 25)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 8), r.held_out, r.train_tokens)
                 for r in lm.score(docs).collect())
    bags, uni, bi, tri = [], Counter(), Counter(), Counter()
    for i, t in TEXTS:
        w = (t or "").encode().lower().split() + [b"\n"]
        held = zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
        bags.append((i, w, held))
        if not held:
            uni.update(w)
            bi.update(zip(w, w[1:]))
            tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)

    def discount(counts):
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        return min(0.95, max(0.1, once / (once + 2 * twice)))
    d2, d3 = discount(bi), discount(tri)
    after, after2 = Counter(h for h, _ in bi), Counter((a, b) for a, b, _ in tri)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda h, w: max(bi[h, w] - d2, 0) / uni[h] + d2 * after[h] / uni[h] * p(w) if after[h] else p(w)
    p3 = lambda g, h, w: (max(tri[g, h, w] - d3, 0) + d3 * after2[g, h] * p2(h, w)) / bi[g, h] if after2[g, h] else p2(h, w)
    want = []
    for i, w, held in bags:
        s = math.log10(p(w[0])) + sum(math.log10(p2(h, x)) for h, x in zip(w[:1], w[1:2]))
        s += sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:]))
        want.append((i or -1, len(w), sum(uni[x] > 0 for x in w), round(sum(math.log10(p(x)) for x in w), 8), round(s, 8), held, n))
    assert got == sorted(want)


def test_lm_mass_of_every_state_is_one():
    """Words 0 to 2, the end 3 and an unknown word after every history of one and of two words."""
    tokens = [*np.random.default_rng(4).integers(0, 3, 60), 3]
    n, asked = len(tokens), [(a, b, c) for a in range(3) for b in range(3) for c in range(4)]
    block = lm.Block({"codes": lm.pack(np.array([*tokens, *[x for t in asked for x in t]])), "keys": np.arange(4, dtype="<u8").tobytes(),
                      "size": [n] + [3] * len(asked), "held": [False] + [True] * len(asked), "lead": [0] * (1 + len(asked))})
    words, pairs, triples = block.word_counts, block.pair_counts, block.triple_counts
    a = lm.Automaton(block, words, np.bincount(block.left[pairs > 0], minlength=4), pairs,
                     np.bincount(block.pair[triples > 0], minlength=len(pairs)), triples, n, 4, (0.5, 0.7))
    weight = a.walk(block)
    unknown = 0.5 / (n + 0.5 * 5)
    after_two = {t: 10 ** weight[n + 3 * k + 2] for k, t in enumerate(asked)}
    after_one = {t[:2]: 10 ** weight[n + 3 * k + 1] for k, t in enumerate(asked)}
    pair = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(block.left, block.right))}
    for g in range(3):
        ends = 10 ** a.pair[pair[g, 3]] if (g, 3) in pair and pairs[pair[g, 3]] else 10 ** (a.word_fail[g] + a.root[3])
        assert abs(sum(after_one[g, h] for h in range(3)) + ends + 10 ** a.word_fail[g] * unknown - 1) < 1e-9
        for h in range(3):
            mass = sum(after_two[g, h, w] for w in range(4))
            assert abs(mass + 10 ** (a.pair_fail[pair[g, h]] + a.word_fail[h]) * unknown - 1) < 1e-9


def test_chat_round_trip_and_layouts(spark):
    said = r"\### Assistant: </turn> ok \l \\ <text> \\l"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, None, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "b"),
            (3, 0, None, "x"), (3, 0, "a<b\\", "y"), (None, 0, "user", "\n"), (4, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "gpt", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_records(chat.records_of(df)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.under_mask(F.col("formatted"), F.col("loss_mask"))).collect()
    assert len(out) == 5 and len({r.layout_hash for r in out}) >= 3
    for r in out:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        turns = [(x[2] or "", x[3] or "") for x in own]
        assert [tuple(t) for t in r.back] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
    odd = spark.createDataFrame([('{"other":[1]}',), ("no json",), (None,)], "record string")
    assert [r.turns for r in chat.format_records(odd).collect()] == [None] * 3
    assert chat.format_records(chat.records_of(df.limit(0))).count() == 0


def test_toxicity_held_out_and_gapped_words(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(3, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = [str(x) for x in rng.choice(plain, 60)]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            text.insert(int(rng.integers(60)), str(rng.choice(["zwoxel", "quirvik"])))
        rows.append((i, ". ".join(" ".join(text[k:k + 10]) for k in range(0, len(text), 10)), "extra"))
        labels.append((i, 1, toxic))
    rows += [(900 + k, rows[0][1], "copy") for k in range(60)]  # copies must not teach their rare words
    labels += [(900 + k, 1, labels[0][2]) for k in range(60)] + [(None, 1, 1), (5, 1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, lab)
    held = toxicity.score_texts(df, model).where("held_out and doc_id < 400").collect()
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    p = lambda t: float(model.probability(model.documents([t]))[0])
    assert min(p("zwoxel"), p("z.w.o.x.e.l"), p("z w o x e l"), p("zwooxel")) >= 0.5 > max(p(""), p(plain[0]))
    k = toxicity.kernel(["zwoxel", "zwoaxel", plain[0]], ["zwoxel"])[:, 0]
    assert abs(k[0] - 1) < 0.2 and k[0] > k[1] > k[2]
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")
    assert toxicity.score_texts(odd, model).count() == 3 and toxicity.score_texts(odd.limit(0), model).count() == 0
    assert toxicity.fit(df, lab.limit(0)) is None and toxicity.score_texts(odd, None).count() == 3
    assert toxicity.keep_clean(df, "text", model).columns == df.columns


def test_bpe_chunks_match_the_whole_text(spark, docs):
    import tiktoken
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    c = bpe.Bpe(spark, RANKS, public_tokenizers.PATTERN, chunk=50, overlap=12)
    got = c.decode(c.encode(docs)).collect()
    want = Counter((i, np.array(whole.encode_ordinary(t or ""), dtype="<u4").tobytes()) for i, t in TEXTS)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert Counter(bytes(r.decoded) for r in got) == Counter((t or "").encode() for _, t in TEXTS)
    assert c.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.Bpe(spark, RANKS, public_tokenizers.PATTERN, chunk=10, overlap=11)


def test_length_table_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lengths, "BAND", 4)
    sizes = [0, 0, 3, 5, 5, 9, 40, 41, 3]
    t = lengths.length_table(spark.createDataFrame([(x,) for x in sizes], "n_tokens bigint"))
    rows = {r.length: r for r in t.collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert (r.docs, r.docs_ge, r.tokens_ge) == (sizes.count(n), sum(x >= n for x in sizes), sum(x for x in sizes if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in sizes) and abs(r.share_le - sum(x <= n for x in sizes) / 9) < 1e-12
    at = {r.context_limit: r for r in lengths.at_limits(t, [0, 1, 4, 10, 100]).collect()}
    assert {k: r.truncated_total for k, r in at.items()} == {k: sum(min(x, k) for x in sizes) for k in (0, 1, 4, 10, 100)}
    assert {r.share: r.length for r in lengths.quantiles(t, [0.5, 1.0]).collect()} == {0.5: 5, 1.0: 41}
    assert lengths.length_table(t.limit(0).select(F.col("length").alias("n_tokens"))).count() == 0


def base_spans(text):
    rx = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, p in rx:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans_match_the_patterns(spark, docs):
    rng = np.random.default_rng(5)
    bits = ["a@b.co", "@", ".", "+1 ", "212", "555-0199", " ", "4539148803436467", "10.0.0.1", "256", "-", "x", "é", "@@b.c", "(", ")", "_%+"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(1500)] + [t or "" for _, t in TEXTS] + ["9" * 4000 + ".1.1.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    model = pii.fit(df)
    for r in pii.find_spans(df, model).collect():
        assert r.base == base_spans(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    empty = pii.fit(df.limit(0))
    assert pii.find_spans(docs, empty).count() == len(TEXTS) and pii.find_spans(docs.limit(0), model).count() == 0


def test_pii_learns_wider_spans_and_redacts(spark):
    texts = [f"mail ann{i}@site{i}.com now" for i in range(300)] + [f"call +1 (212) 555-{i:04d} now" for i in range(300)]
    texts += ["write to bob (at) mail (dot) com please", "call 212 555 0199 today"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    model = pii.fit(df)
    out = {r.doc_id: r.text for r in pii.redact(df, "text", model).collect()}
    assert out[0] == "mail [EMAIL] now" and out[300] == "call [PHONE] now" and out[600] == "write to [EMAIL] please"
    rel = model.reliability["email"]
    assert rel.shape == (2, pii.VOTES, 3) and np.allclose(rel.sum(axis=2), 1)


ADDED = [("phone", "555-123-4567"), ("phone", "555.123.4567"), ("phone", "(212) 555-0199"), ("phone", "0049 301 2345 678"),
         ("card", "4111.1111.1111.1111"), ("card", "4111/1111/1111/1111"), ("card", "4111_1111_1111_1111"),
         ("ip", "192[.]168[.]1[.]10"), ("ip", "192(.)168(.)1(.)10"), ("ip", "1[.]2[.]3[.]4"),
         ("email", "bob [at] mail [dot] example [dot] org")]


def test_pii_adds_every_wider_form(spark):
    texts = [f"call +1 (212) 555-{i:04d} now" for i in range(200)] + [f"host 10.0.{i}.1 up, not 10.0.{i + 256}.1" for i in range(200)]
    texts += ["paid by 4539148803436467 ok", "paid by 4111 1111 1111 1111 ok", "mail ann@site.com now", "room 12 of 30, part 77"] * 50
    texts += ["paid by 4111 1111 1111 1112 ok"] * 20  # a failing number; no phone is cut out of it
    first = len(texts)
    texts += [f"call {s} now" for _, s in ADDED] + ["on 10.0.0.1-555-123-4567 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.find_spans(df, pii.fit(df)).collect()}
    for i, (kind, s) in enumerate(ADDED):
        assert f"{kind}:5:{5 + len(s)}" in out[first + i].spans.split(",") and out[first + i].base == "", s
    assert all(out[i].spans == "" for i in range(first - 20, first))
    assert out[first + len(ADDED)].spans == out[first + len(ADDED)].base == "ip:3:11"


def test_collisions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collisions, "CELL", 60)
    monkeypatch.setattr(collisions, "BLOCK", 40)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((120, 24))
    vecs = np.vstack([base, base[:60] + 0.2 * rng.standard_normal((60, 24)), np.repeat(base[:1], 30, axis=0)])
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vecs)]
    bad = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 0), (903, [1.0, None], 0), (904, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id bigint, embedding array<double>, label int, uid string")
    got = {r.vec_id: r for r in collisions.near_duplicates(df).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(210)[:, None] % 2 == np.arange(210) % 2) & ~np.eye(210, dtype=bool)
    assert [got[i].n_links for i in range(210)] == near.sum(axis=1).tolist()
    for i in range(210):
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert collisions.near_duplicates(df.limit(0)).count() == 0
    assert collisions.calibrated_count() == 11


def test_collisions_find_planted_pairs_of_a_large_cell():
    rng = np.random.default_rng(11)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.94, (2000, 1))
    cell = np.vstack([a, cos * a + np.sqrt(1 - cos ** 2) * side])
    found = {(x, y) for i, j in collisions._links(cell, cell, collisions.THRESHOLD) for x, y in zip(i.tolist(), j.tolist())}
    assert sum((i, 2000 + i) in found for i in range(2000)) >= 1996
    assert 3.29 < collisions.slice_window() < 4  # misses less than 0.1 % by itself


def test_mixing_targets_and_near_words(spark, docs):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), s) for i, s in enumerate(
        rng.choice(["a", "b", "c", None], 800, p=[0.02, 0.5, 0.28, 0.2]).tolist())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s), key=str) + [None]
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        left = total - sum(2 * size[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s, x in share.items() if x > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * size[s] if s in full else share[s] for s in order}
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.source_size == size[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in order) and "a" in full
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect()))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(docs.limit(0)).count() == 0


def bag(text):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_bagminhash_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "GROUP", 12)
    monkeypatch.setattr(bagminhash, "SPLIT", 5)
    rng = np.random.default_rng(11)
    voc = [f"w{i}" for i in range(500)]
    texts = []
    for g in range(12):
        base = [str(x) for x in rng.choice(voc, 150)]
        texts.append(" ".join(base))
        for k in range(6 if g else 25):
            t = list(base)
            for i in rng.integers(0, 150, int(rng.integers(0, 7))):
                t[i] = str(rng.choice(voc))
            texts.append(" ".join(t))
    texts += ["", None, "", "a b", "a b", "A  b", " ".join(["spam eggs"] * 200), " ".join(["spam eggs"] * 190)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rep int")
    got = bagminhash.classes(df).collect()
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            same = sum((a & b).values()) >= 0.8 * sum((a | b).values()) if a and b else (texts[i] or "") == (texts[j] or "")
            if same:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert all(r.class_id == find(r.doc_id) for r in got) and len(got) == len(rows)
    assert sum(r.kept for r in got) == len({find(i) for i in range(len(texts))})
    left = bagminhash.deduplicate(df)
    assert left.columns == df.columns and left.count() == sum(r.kept for r in got)
    assert bagminhash.classes(df.limit(0)).count() == 0


def test_bagminhash_is_unbiased_for_weights():
    rng, found = np.random.default_rng(13), []
    for t in range(60):
        key = np.arange(1, 41, dtype=np.uint64) * np.uint64(7919) + np.uint64(t * 1_000_003)
        a, b = rng.integers(1, 30, 40), rng.integers(1, 30, 40)
        s = bagminhash.signatures(np.repeat([0, 1], 40), np.concatenate([key, key]), np.concatenate([a, b]), 2)
        found.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(found)) < 0.02


def test_fingerprint_likeness(spark, docs):
    rng = np.random.default_rng(17)
    voc = [f"w{i}" for i in range(2000)]
    pairs = []
    for share in (1.0, 0.9, 0.6, 0.3, 0.0):
        for n in (40, 400, 3000):
            a = [str(x) for x in rng.choice(voc, n)]
            b = a[:int(n * share)] + [str(x) for x in rng.choice(voc, n - int(n * share))]
            pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.withColumn("x", fingerprint.fingerprint(F.col("a"))).withColumn("y", fingerprint.fingerprint(F.col("b"))).withColumn(
        "near", fingerprint.likeness(F.col("x"), F.col("y"))).collect()
    for r in out:
        a, b = set(bag(r.a)), set(bag(r.b))
        assert abs(r.near - len(a & b) / len(a | b)) < 0.2 and len(r.x) == fingerprint.BINS
    nxt = fingerprint.with_next(docs, 4).collect()
    order = sorted(TEXTS, key=lambda x: (x[0] is None, -(x[0] or 0), [-ord(c) for c in (x[1] or "")]))
    want = Counter((i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order))
    assert Counter((r.doc_id, r.text, r.next_text) for r in nxt) == want
    empty = fingerprint.fingerprints(docs.where("text is null or text = ''")).collect()
    assert {r.fingerprint for r in empty} == {""}
    assert fingerprint.with_next(docs.limit(0), 4).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, k) for k in range(300, 360)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(path + star, "a bigint, b bigint"), "t").collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[k] for k in [7, *range(300, 360)]} == {7}


def test_pre_tokens_cover_the_text():
    text = "It's 12 o'clock 中文  \n\t x"
    assert "".join(regex.findall(public_tokenizers.PATTERN, text)) == text
    assert hashlib.sha256(text.encode()).hexdigest()
