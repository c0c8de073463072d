"""Personal data: fixed patterns, and further spans found by weak supervision.

Four kinds have fixed patterns (email, ip, card, phone). Other forms have none that is sure: secrets, phone numbers
without a plus, names of persons, street addresses, and mail addresses spelled in words. A wide pattern of each kind
gives candidates, on which labelers vote for, against or not at all: strict patterns, gazetteers (vendors' prefixes,
first names), words in the context before it, what stands directly before it, the mix and variety of its characters,
and words that speak against it. Expectation-maximisation over the vote patterns of all documents estimates for each
kind how reliable each labeler is, and a logistic span classifier over span features is trained on the posteriors it
gives. Candidates that the classifier accepts are added; fixed-pattern spans always stay.

What comes to the driver is one row per kind, vote pattern and feature row: at most 5 * 3**7 * 2**9, whatever the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import textscan as ts
from tractloom.llm.runtime import arrow_pass, flat, given_back

KINDS = ("email", "ip", "card", "phone", "secret", "number", "name", "address", "spelled")
SECRET, NUMBER, PERSON, ADDRESS, SPELLED = range(4, 9)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits can't succeed where the run's start failed, so the look-behind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: How published key formats begin.
VENDOR = re.compile(r"AKIA[0-9A-Z]{12,}|ASIA[0-9A-Z]{12,}|ghp_|gho_|xox[bp]-|sk-|sk_live_|AIza")
#: Titles, common first names, and words that streets are named with.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora")
FIRST_NAMES = frozenset(
    "Anna Ben Carlos Daniel David Elena Emma Eva Hans Jack James Jan Jean John Jose José Juan Julia Karl Laura Linda Lisa Louis Lucas Luis Maria Marie Mark Martin Mary Max Michael Miguel Nina Olivia Paul Peter Pierre Robert Sarah Sofia Susan Thomas William".split()
)
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Way|Court|Square"
#: The wide pattern of each kind that has no fixed one.
CANDIDATES = {
    SECRET: re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}+"),
    NUMBER: re.compile(r"(?<![\w+.,-])(?<![0-9][ ])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){2,4}(?![\w-]|[ .][0-9])"),
    PERSON: re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.?|{'|'.join(sorted(FIRST_NAMES))})(?:\s[A-Z][a-zà-ÿ]+){{1,2}}"),
    ADDRESS: re.compile(rf"\b[0-9]{{1,5}}(?:\s[A-Z][a-zà-ÿ]+){{1,3}}\s(?:{STREETS})\b\.?"),
    SPELLED: re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\s?[\[(]?\s?(?:at|AT)\s?[\])]?\s?[A-Za-z0-9-]+(?:\s?[\[(]?\s?(?:dot|DOT)\s?[\])]?\s?[A-Za-z]+)+\b"),
}
#: The strict pattern of each.
STRICT = {
    SECRET: re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}"),
    NUMBER: re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}(?:[ .-][0-9]{2,4}){2,4}"),
    PERSON: re.compile(rf"(?:{'|'.join(TITLES)})\.?\s.*"),
    ADDRESS: re.compile(rf"[0-9]{{1,4}}(?:\s[A-Z][a-zà-ÿ]+){{1,2}}\s(?:{STREETS})\.?"),
    SPELLED: re.compile(r".*[\[(]\s?(?:at|dot)\s?[\])].*", re.I),
}
#: Names that secrets are given, and words that stand before the other kinds.
WORDS = {
    SECRET: ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential"),
    NUMBER: ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "number"),
    PERSON: ("name", "contact", "dear", "sincerely", "signed", "regards", "from", "by"),
    ADDRESS: ("address", "live", "lives", "street", "home", "located", "ship"),
    SPELLED: ("mail", "contact", "write", "reach", "send"),
}
#: Words before a candidate that speak against it.
AGAINST = ("version", "page", "chapter", "section", "isbn", "figure", "table", "commit", "sha", "md5", "checksum", "year")
#: Characters before a candidate that count as its context: a parameter of the labelers.
BEFORE = 32
INTERESTING = ts.byte_class([(0x30, 0x39), (0x40, 0x40)])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: its local part is the run before it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        if at >= floor:
            local = text[floor:at]
            n = len(local) - len(local.rstrip(LOCAL))
            if n and (m := DOMAIN.match(text, at)):
                out.append((at - n, m.end()))
                floor = m.end()
            else:
                floor = max(floor, at + 1)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def facts(kind: int, t: str, before: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """What the labelers vote on a candidate, for (1), against (-1) or not (0); and what the span classifier sees, 0 or 1."""
    low, ends = before.lower(), before.rstrip(" \"'`")
    digits = sum(c.isdigit() for c in t)
    strict = STRICT[kind].fullmatch(t) is not None
    named = any(k in low for k in WORDS[kind])
    given = ends.endswith(("=", ":"))
    against = any(k in low for k in AGAINST)
    if kind == SECRET:
        listed, form, varied = VENDOR.match(t) is not None, 0.1 <= digits / len(t) <= 0.9, entropy(t) >= 3.0
    elif kind == NUMBER:
        listed, form, varied = t.startswith("("), 9 <= digits <= 15, len(set(t)) >= 5
    elif kind == PERSON:
        listed, form, varied = any(w.strip(".") in FIRST_NAMES for w in t.split()), len(t.split()) > 2, not ends or ends[-1] not in ".!?\n"
    elif kind == ADDRESS:
        listed, form, varied = not t.endswith(("Way", "Court", "Square")), digits <= 4, ends.endswith((",", "at", "in"))
    else:
        listed, form, varied = "[" in t or "(" in t, len(t) <= 60, "." in t or "_" in t
    votes = (int(strict), int(listed), int(named), 1 if given else -1 if kind == SECRET else 0, 1 if form else -1, 1 if varied else -1, -int(against))
    seen = (len(t) >= 18, len(t) >= 32, strict, digits * 5 >= len(t), digits == len(t), any(map(str.isupper, t)) and not any(map(str.islower, t)), named, given, listed)
    return votes, tuple(map(int, seen))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple, tuple]]:
    """Spans of the wide patterns that overlap no fixed-pattern span: start, kind, end, votes, features."""
    out = []
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))  # the furthest end of the spans so far
    for kind, pattern in CANDIDATES.items():
        for m in pattern.finditer(text):
            s, e = m.span()
            t = m.group()
            if kind == SECRET and not (any(map(str.isdigit, t)) or (len(t) >= 20 and any(map(str.isupper, t[1:])) and any(map(str.islower, t)))):
                continue
            k = bisect.bisect_left(starts, e)  # spans that begin before this one ends
            if k and reach[k - 1] > s:
                continue
            out.append((s, kind, e, *facts(kind, t, text[max(0, s - BEFORE) : s])))
    return out


WITHOUT_DIGITS = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.?|{'|'.join(sorted(FIRST_NAMES))})\s[A-Z]|\b(?:dot|DOT)\b|[A-Za-z0-9_+/-]{{20,}}")


def interesting(col: pa.Array) -> list[int]:
    """Texts that can hold a span: those with a digit, an @, or one of the few things that candidates without both begin with."""
    b = ts.as_bytes(col)
    hit = np.flatnonzero(INTERESTING[b.data])
    out = np.zeros(b.n, bool)
    out[np.searchsorted(b.offsets, hit, "right") - 1] = True
    for k in np.flatnonzero(~out & (np.diff(b.offsets) > 0)).tolist():
        out[k] = WITHOUT_DIGITS.search(col[k].as_py()) is not None
    return np.flatnonzero(out).tolist()


def vote_table(docs: DataFrame) -> DataFrame:
    """(kind, votes, features, n) over the candidates of all documents; summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            col = batch.column(0)
            for k in interesting(col):
                t = col[k].as_py()
                c.update((kind, v, f) for _, kind, _, v, f in candidates(t, base_spans(t)))
        keys = list(c)
        text = [[" ".join(map(str, k[i])) for k in keys] for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array(text[0], pa.string()), pa.array(text[1], pa.string()), pa.array([c[k] for k in keys], pa.int64())], names=["kind", "votes", "features", "n"])

    return docs.select("text").mapInArrow(given_back(run), "kind int, votes string, features string, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of -1, 0, 1) with counts: posterior of each, P(vote | class) per labeler, and the share of secrets."""
    post = 1 / (1 + np.exp(-v.sum(1).astype(float)))
    table, share = np.zeros((2, v.shape[1], 3)), 0.5
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])
        share = float(np.clip(w[1].sum() / n.sum(), 0.01, 0.99))
        for k in (-1, 0, 1):
            table[:, :, k + 1] = w @ (v == k) + 0.5
        table /= table.sum(2, keepdims=True)
        ll = np.log(np.stack([1 - share, share]))[:, None] + sum(np.log(table[:, j, v[:, j] + 1]) for j in range(v.shape[1]))
        post = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
    return post, table, share


def span_classifier(x: np.ndarray, target: np.ndarray, n: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression on soft targets, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros(z.shape[1])
    n = n / n.sum() * len(n)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (n * (target - q)) - 0.01 * w
        h = (z * (n * q * (1 - q))[:, None]).T @ z + 0.01 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, g), -2, 2)
    return w


Weights = dict[int, np.ndarray]


def train(docs: DataFrame) -> Weights:
    """Weights of the span classifier of each kind that any document has a candidate of."""
    got = vote_table(docs).orderBy("kind", "votes", "features").collect()
    out = {}
    for kind in sorted({r["kind"] for r in got}):
        rows = [r for r in got if r["kind"] == kind]
        v = np.array([[int(k) for k in r["votes"].split()] for r in rows])
        x = np.array([[int(k) for k in r["features"].split()] for r in rows])
        n = np.array([r["n"] for r in rows], float)
        post, _, _ = reliabilities(v, n)
        out[kind] = span_classifier(x, post, n)
    return out


def all_spans(text: str, weights: Weights) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = [(s, kind, e) for s, kind, e, _, f in candidates(text, base) if kind in weights and float(np.dot(weights[kind][:-1], f) + weights[kind][-1]) >= 0]
    return base, sorted(base + more)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


OUT = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("redacted", T.StringType()),
])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or group of spans that overlap, becomes its first kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, weights: Weights, carry: list[str], redact: bool = False) -> DataFrame:
    """Counts, digest, spans and (where redact) the redacted text of every row. Null is the empty text, and stays null redacted."""
    nothing = hashlib.sha256(b"").hexdigest()

    def make() -> Callable:
        def f(batch: pa.RecordBatch) -> dict:
            col, n = batch.column(0), batch.num_rows
            counts = np.zeros((4, n), np.int64)
            sha, spans, n_spans, new = [nothing] * n, [""] * n, np.zeros(n, np.int64), {}
            for k in interesting(col):
                t = col[k].as_py()
                base, every = all_spans(t, weights)
                for _, kind, _ in base:
                    counts[kind, k] += 1
                if base:
                    sha[k] = hashlib.sha256(spelled(base).encode()).hexdigest()
                if every:
                    spans[k], n_spans[k] = spelled(every), len(every)
                    new[k] = redacted(t, every) if redact else None
            text = pa.nulls(n, pa.string())
            if redact:
                text = pa.array([new.get(k, t) for k, t in enumerate(col.to_pylist())], pa.string()) if new else col.cast(pa.string())
            return {**{f"n_{k}": counts[i] for i, k in enumerate(KINDS[:4])}, "base_sha256": sha, "spans": spans, "n_spans": n_spans, "redacted": text}

        return f

    return arrow_pass(docs, {"text": F.col("text")}, carry, make, OUT)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts per fixed kind, base_sha256, spans and n_spans (fixed and learned ones) of every document.

    Null and empty texts have no spans; texts of any length are searched whole, and overlaps are found by bisection;
    spans that begin alike are ordered by kind; repeated rows give repeated results; an empty table gives no rows; other
    columns are not carried.
    """
    return flat(find(docs, train(docs), ["doc_id"])).drop("redacted")
