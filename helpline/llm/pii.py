"""Personal data by weak supervision.

Four kinds of spans: e-mail, IP address, payment card, phone. Base patterns give
spans that are always kept. Wider candidates (written-out addresses, numbers
with other separators or without a country code) are voted on by five labelers:
the regular expression itself, a checksum or range rule, a gazetteer, the words around, and the characters next to the
span (a longer run of digits that failed its check among them). The gazetteers are the
country calling codes, the networks without hosts, the generic and two-letter domain
endings and the card issuers' prefixes. Votes are counted per kind and vote pattern over
all texts (a table whose size is bounded by the patterns, not by the data); expectation-maximisation over
that table estimates each labeler's reliability, with base spans fixed as true
and candidates that fail their own check fixed as false; a logistic classifier
fitted to the posteriors decides which candidates become spans.

Offsets are code points, end exclusive. Edge cases: null and empty texts have no
spans; repeated rows and null ids give one output row each; an empty table gives
no rows (and a model that keeps base spans only); extra columns are ignored; equal
candidates of one kind count each. Every pattern reads a text of any length, runs of
digits or letters included, in linear time.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.llm.common import id_and_text

# Kinds in output order, and the base patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # its parts by fours are the matches of the IP pattern
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider candidates.
AT, DOT = re.compile(r" ?(?:\[at\]|\(at\)|\{at\}| at )", re.I), r"(?:\[dot\]|\(dot\)|\{dot\}| dot )"
WRITTEN = re.compile(rf" ?[A-Z0-9-]++(?: ?{DOT} ?[A-Z0-9-]++)+", re.I)
WIDE = {
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[./_][0-9]{4}){3}"),
    "phone": re.compile(r"(?:(?:\+|00)[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}"),
}
# Gazetteers and cue words (fixed values).
# Generic top-level domains; every ending of two letters counts as a country's.
ENDINGS = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel cat asia tel post "
                    "app dev cloud online shop site store tech xyz email blog news".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "2")
# Country calling codes, ranges inclusive.
CALLING_CODES = frozenset(str(c) for part in (
    "1 7 20 27 30-34 36 39-41 43-49 51-58 60-66 81-82 84 86 90-95 98 211-213 216 218 220-258 260-269 290-291 297-299 "
    "350-359 370-378 380-383 385-387 389 420-421 423 500-509 590-599 670 672-683 685-692 800 808 850 852-853 855-856 "
    "870 878 880-883 886 888 960-968 970-977 979 992-996 998").split()
    for c in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1))
# Networks that hold no single host's address: this network, documentation, multicast, reserved.
NO_HOST = tuple(map(ipaddress.ip_network, (
    "0.0.0.0/8", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")))
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "server", "host", "addr", "login"),
    "card": ("card", "visa", "credit", "payment", "iban"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "number"),
}
AGAINST = ("order", "invoice", "version", "isbn", "ticket", "serial", "art.", "page", "ref")
NEAR = 32          # code points before a span that context labelers read
KEEP_AT = 0.9      # classifier probability from which a candidate becomes a span
VOTES = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _parts_ok(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def valid(kind: str, s: str) -> bool:
    """The checksum or range rule of a kind."""
    if kind == "email":
        return True
    if kind == "ip":
        return _parts_ok(re.findall("[0-9]+", s))
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def base_matches(text: str):
    """``(kind, start, end, passes)`` of the base patterns, leftmost and
    non-overlapping per kind; failing ones are told so that they can be dropped."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield "email", start, last, True
        at = text.find("@", max(at + 1, last))
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            cut = [-1, *(i for i, c in enumerate(m[0]) if c == "."), len(m[0])]
            for i in range(0, len(cut) - 4, 4):
                a, b = m.start() + cut[i] + 1, m.start() + cut[i + 4]
                yield "ip", a, b, valid("ip", text[a:b])
    for kind, pattern in (("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end(), valid(kind, m[0])


def written_out(text: str):
    """Spans of addresses with ``at`` and ``dot`` in words or brackets, leftmost and
    non-overlapping: from each ``at`` the name is read to the left."""
    last, m = 0, AT.search(text)
    while m:
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        right = WRITTEN.match(text, m.end()) if start < m.start() else None
        if right:
            last = right.end()
            yield start, last
        m = AT.search(text, max(m.start() + 1, last))


def _inside(runs: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a run of digits covers the span or an end of it and goes on outside."""
    near = runs[max(0, bisect_right(runs, (start, 0)) - 2):bisect_right(runs, (end, 0))]
    return any(a < end and start < b and (a < start or b > end) for a, b in near)


def hosts(s: str) -> bool:
    """Whether an address of four parts can be a single host's."""
    address = ipaddress.ip_address(bytes(int(p.lstrip("0") or "0") for p in re.findall("[0-9]+", s)))
    return not any(address in net for net in NO_HOST)


def votes(text: str, kind: str, start: int, end: int, base: bool, inside: bool = False) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains. ``inside``: the span is cut out of a longer
    run of digits that failed its check."""
    s = text[start:end]
    d = _digits(s)
    check = 1 if valid(kind, s) else -1
    if kind == "email":
        check = 0
        ending = re.split(r"[^a-z]+", s.lower().rstrip(")]}"))[-1]
        known = 1 if len(ending) == 2 or ending in ENDINGS else -1
    elif kind == "card":
        known = 1 if d.startswith(CARD_PREFIXES) else -1
    elif kind == "ip":
        known = 1 if check == 1 and hosts(s) else -1
    elif s.startswith(("+", "00")):
        code = d[2:] if s.startswith("00") else d
        known = 1 if any(code[:n] in CALLING_CODES for n in (1, 2, 3)) else -1
    else:
        known = 0 if 10 <= len(d) <= 12 else -1
    before = text[max(0, start - NEAR):start].lower()
    context = -1 if any(w in before for w in AGAINST) else (1 if any(w in before for w in CUES[kind]) else 0)
    left, right = text[start - 1:start], text[end:end + 1]
    edge = -1 if inside or left.isalnum() or right.isalnum() or left in ("-", "#", "/", "$") and left or right in ("/", "%") and right else 1
    return (1 if base else 0, check, known, context, edge)


def candidates(text: str):
    """``(kind, start, end, state, votes)``; state: 1 base span, -1 a base
    pattern's match that fails its check, 0 open."""
    found = [(k, a, b, 1 if ok else -1) for k, a, b, ok in base_matches(text)]
    failed = {(k, a, b) for k, a, b, st in found if st == -1}
    runs = sorted((a, b) for k, a, b in failed if k in ("ip", "card"))
    kept: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b, st in found if st == 1):
        if kept and a < kept[-1][1]:
            kept[-1][1] = max(b, kept[-1][1])
        else:
            kept.append([a, b])
    starts = [a for a, _ in kept]
    wide = []
    wide += [("email", a, b) for a, b in written_out(text)]
    for kind, pattern in WIDE.items():
        wide += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    out = [(k, a, b, st, votes(text, k, a, b, st == 1)) for k, a, b, st in found]
    for kind, a, b in wide:
        # over a base span nothing is added; a failing match says no only about itself
        i = bisect_right(starts, b - 1)
        if not (i and kept[i - 1][1] > a) and (kind, a, b) not in failed:
            out.append((kind, a, b, 0, votes(text, kind, a, b, False, text[a] != "+" and _inside(runs, a, b))))
    return out


@dataclass
class Model:
    """Per kind: labeler reliabilities (probability of each vote given false and
    true) and the classifier's weights over one-hot votes."""
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    reliability: dict[str, np.ndarray] = field(default_factory=dict)

    def probability(self, kind: str, v: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-(w @ _one_hot(v)))))


def _one_hot(v) -> np.ndarray:
    x = np.zeros(3 * VOTES + 1)
    x[[3 * i + int(k) + 1 for i, k in enumerate(v)]] = 1
    x[-1] = 1
    return x


def estimate(counts: list[tuple[str, int, tuple[int, ...], int]], rounds: int = 50) -> Model:
    """``(kind, state, votes, count)`` -> model: expectation-maximisation over
    the vote patterns, then a logistic classifier of the posteriors. The first
    labeler is what fixes the base spans, so it has no say about open ones."""
    model = Model()
    for kind in KINDS:
        rows = [(st, v, n) for k, st, v, n in counts if k == kind]
        if not rows:
            continue
        state = np.array([r[0] for r in rows])
        v = np.array([r[1] for r in rows])
        n = np.array([r[2] for r in rows], float)
        post = np.where(state == 1, 1.0, np.where(state == -1, 0.0, 0.5))
        table = np.zeros((2, VOTES, 3))
        for _ in range(rounds):
            for z, weight in ((1, n * post), (0, n * (1 - post))):
                for j in range(VOTES):
                    for c in (-1, 0, 1):
                        table[z, j, c + 1] = (weight * (v[:, j] == c)).sum() + 1.0
                table[z] /= table[z].sum(axis=1, keepdims=True)
            prior = ((n * post).sum() + 1) / (n.sum() + 2)
            odds = np.log(prior / (1 - prior)) + sum(
                np.log(table[1, j, v[:, j] + 1]) - np.log(table[0, j, v[:, j] + 1]) for j in range(1, VOTES))
            post = np.where(state == 1, 1.0, np.where(state == -1, 0.0, 1 / (1 + np.exp(-odds))))
        x = np.array([_one_hot(r) for r in v])
        x[:, :3] = 0
        w = np.zeros(x.shape[1])
        share = n / n.sum()
        for _ in range(100):  # Newton steps of a ridge-penalised logistic fit
            p = 1 / (1 + np.exp(-x @ w))
            grad = x.T @ (share * (post - p)) - 1e-4 * w
            hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        model.weights[kind], model.reliability[kind] = w, table
    return model


def fit(docs: DataFrame) -> Model:
    """Counts vote patterns over every text; at most 4 * 3 * 3**5 rows come back."""
    def run(batches):
        seen: dict[tuple, int] = {}
        for b in batches:
            for t in b["text"]:
                for k, _, _, st, v in candidates(t):
                    key = (k, st, *v)
                    seen[key] = seen.get(key, 0) + 1
        cols = ["kind", "state", *[f"v{i}" for i in range(VOTES)], "n"]
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=cols)
    schema = "kind string, state int, " + ", ".join(f"v{i} int" for i in range(VOTES)) + ", n bigint"
    keys = ["kind", "state", *[f"v{i}" for i in range(VOTES)]]
    rows = id_and_text(docs).select("text").mapInPandas(run, schema).groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    return estimate(sorted((r["kind"], r["state"], tuple(r[f"v{i}"] for i in range(VOTES)), r["n"]) for r in rows))


def spans_of(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans as ``(kind number, start, end)``, sorted."""
    base, more = [], []
    for kind, a, b, st, v in candidates(text):
        if st == 1:
            base.append((KINDS.index(kind), a, b))
        elif st == 0 and model.probability(kind, v) >= KEEP_AT:
            more.append((KINDS.index(kind), a, b))
    return sorted(base), sorted(base + more)


def find_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, spans)``: counts and
    ``kind:start:end`` lists of the base spans, and all spans."""
    def tell(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                base, every = spans_of(t, model)
                rows.append((doc_id, *[sum(k == i for k, _, _ in base) for i in range(4)], tell(base), tell(every)))
            yield pd.DataFrame(rows, columns=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"]).astype({"doc_id": "Int64"})
    return id_and_text(docs).mapInPandas(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")


def redact(texts: DataFrame, column: str, model: Model) -> DataFrame:
    """The same rows with every span in ``column`` replaced by its kind in
    brackets (overlapping spans as one, under the first kind); nulls stay."""
    def clean(t):
        if t is None:
            return None
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans_of(t, model)[1]):
            if a >= at:
                out += [t[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join(out) + t[at:] if out else t

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(clean, na_action="ignore")
    return texts.withColumn(column, apply(F.col(column)))
