"""Operators on single texts against brute force, and their odd cases."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.helpers import ALNUM, SF, no_docs, odd_docs, words
from tractloom.llm import bpe, html_text, katz, kneser_ney, pii, quality_gam, queries, runtime, textscan, toxicity

TEXT = hs.text(alphabet=hs.sampled_from(list("aAbB zZ\n\t.,#1é ß\U0001f600@+-")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.one_of(hs.none(), TEXT), max_size=6))
def test_word_scan(texts):
    b = textscan.as_bytes(pa.array(texts, pa.string()))
    for table, pattern in ((textscan.SPACE_WORDS, None), (textscan.ALNUM_WORDS, ALNUM)):
        w = textscan.words(b, table)
        got = [[b.data[s:e].tobytes() for s, e in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first, w.first[1:], strict=False)]
        want = [[x.encode() for x in (words(t) if pattern is None else words(t, pattern=pattern))] for t in texts]
        assert [[bytes(textscan.LOWER[np.frombuffer(x, np.uint8)]) for x in d] for d in got] == want
        flat = [x for d in want for x in d]
        same = {}
        assert all(same.setdefault(x, h) == h for x, h in zip(flat, w.hash.tolist(), strict=True)) and len(set(same.values())) == len(same)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


# 8


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


def test_bpe_is_exact():
    rnd = random.Random(5)
    own, lib = bpe.WordBpe(queries.tokenizer_file(), cache_words=50), tokenizer()
    texts = ["", " ", "it's <|endoftext|>x ΣΑΣ İ 12", "x\x1cy\x85z \xa0​", "é Å <|ENDOFTEXT|>", "aaaaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!"]
    texts += ["".join(rnd.choice("aabeinotsrh' é.,!<|>") for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 0x250), rnd.randint(0x370, 0x3FF), rnd.randint(0x4E00, 0x4E40), rnd.randint(0x1F600, 0x1F640)])) for _ in range(20)) for _ in range(200)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4")
        want = lib.encode(t, add_special_tokens=False)
        assert ids.tolist() == want.ids
        assert own.decode(ids).decode() == lib.decode(want.ids, skip_special_tokens=False)


def test_op8(spark, docs):
    lib = tokenizer()
    got = queries.op8_bpe_encoding(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        r = got.loc[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 5


def slow_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and total % 10 == 0 else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(hs.text(alphabet=hs.sampled_from(list("0123456789..@@+- ()ab,%_")), max_size=60))
def test_fixed_patterns(t):
    assert pii.base_spans(t) == slow_spans(t)


def test_op5(spark, docs):
    got = queries.op5_personal_data(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        base, r = slow_spans(t), got.loc[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
        assert set(filter(None, pii.spelled(base).split(","))) <= set(filter(None, r.spans.split(",")))


def test_secrets_are_learned(spark):
    rnd = random.Random(1)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f'some words token = "{key(40)}" and more') for k in range(40)] + [(k, f"a number {rnd.randint(10**15, 10**16)}1 in a text") for k in range(100, 140)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(d).collect()}
    assert all("secret:" in got[k] for k in range(40)) and not any("secret:" in got[k] for k in range(100, 140))
    red = pii.find(d, pii.train(d), ["doc_id"], redact=True).where("doc_id = 0").first()["_out"]["redacted"]
    assert red == 'some words token = "[SECRET]" and more'


def test_other_kinds_are_learned(spark):
    """Labelers of each kind tell what is meant from what only looks like it."""
    rnd = random.Random(2)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    good = [
        lambda: ("number", f"please call ({num(3)}) {num(3)}-{num(4)}"), lambda: ("name", "a letter signed by Dr. Thomas " + rnd.choice(["Miller", "Weber", "Lopez"])),
        lambda: ("address", f"my address: {num(3)} Green {rnd.choice(['Hill', 'Oak'])} Street, in town"), lambda: ("spelled", "mail me (john.doe [at] example [dot] com)"),
    ]
    bad = [lambda: "table" + "".join(f" {num(2)}" for _ in range(10)) + " of numbers", lambda: "we stayed on page 12 and looked at it", lambda: "1 2 3 4 5"]
    rows, want = [], {}
    for k in range(200):
        kind, t = good[k % 4]()
        rows.append((k, t))
        want[k] = kind
    rows += [(1000 + k, bad[k % 3]()) for k in range(150)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[k] in got[k]["spans"] and got[k]["n_spans"] == 1 for k in want)
    assert not any(got[1000 + k]["spans"] for k in range(150))


def test_overlaps_in_linear_time():
    t = " ".join(f"+1 (017) 555-7{k:03d} a{k}bcdefghijklmn" for k in range(1000)) + ".a" * 100_000 + "1@" * 50_000
    start = time.process_time()
    base = pii.base_spans(t)
    found = pii.candidates(t, base)
    assert len(base) == 1000 and sum(k == pii.SECRET for _, k, *_ in found) == 1000
    assert all(e <= b or z <= s for s, _, e in base[:50] for b, _, z, *_ in found)
    assert time.process_time() - start < 8


# 10


def test_op10(spark, docs):
    got = queries.op10_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w, seen, dup = words(t, lower=False), set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = len({j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, failed)
        assert not (r.base_failed and r.kept)


def plain_kneser_ney(texts):
    """log10 probability of a byte after three others, by dictionaries."""
    grams = collections.Counter()
    rows = [[kneser_ney.EDGE] * 3 + list(t.encode()) for t in texts]
    for r in rows:
        grams.update(zip(r, r[1:], r[2:], r[3:], strict=False))
    counts = {4: grams}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cut, after = {}, {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if min(n) else 0
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]] if min(n) else [0.5, 0.75, 0.9]
        cut[k] = [min(max(d, lo), hi) for d, lo, hi in zip(raw, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85), strict=True)] if min(n) else raw
        after[k] = collections.defaultdict(dict)
        for g, v in c.items():
            after[k][g[:-1]][g[-1]] = v

    @functools.cache
    def prob(h, w):
        k = len(h) + 1
        lower = prob(h[1:], w) if h else 1 / 256
        seen = after[k].get(h)
        if not seen:
            return lower
        total, d = sum(seen.values()), cut[k]
        spare = sum(d[min(v, 3) - 1] for v in seen.values()) / total
        v = seen.get(w, 0)
        return (max(v - d[min(v, 3) - 1], 0) / total if v else 0) + spare * lower

    return lambda t: [math.log10(prob(tuple(r[k : k + 3]), r[k + 3])) for r in [[kneser_ney.EDGE] * 3 + list(t.encode())] for k in range(len(r) - 3)]


def test_op10_perplexity_and_bands_by_brute_force(spark, docs):
    got = queries.op10_quality_rules(spark, SF).toPandas().set_index("doc_id")
    ok = {i for i in docs.doc_id if not got.loc[i].base_failed}
    lang, size = dict(zip(docs.doc_id, docs.lang, strict=True)), {i: len(t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    score = {name: plain_kneser_ney([t for i, t in text.items() if i in ok and lang[i] == name]) for name in set(lang.values())}
    x = {i: -sum(score[lang[i]](t)) / size[i] if t else 0.0 for i, t in text.items()}
    assert got.log10_perplexity.to_dict() == pytest.approx(x, abs=1e-9)
    for name in set(lang.values()):
        first = {text[i]: i for i in ok if lang[i] == name}  # copies count once
        bins = sorted(math.floor(got.loc[i].log10_perplexity / kneser_ney.BIN) for i in first.values())
        mid = bins[(len(bins) - 1) // 2]
        mad = sorted(abs(b - mid) for b in bins)[(len(bins) - 1) // 2]
        for i in (i for i in lang if lang[i] == name):
            half = max(kneser_ney.BAND_LEAST, mad * kneser_ney.BIN * kneser_ney.BAND) * math.sqrt(max(1.0, kneser_ney.BAND_CHARS / max(size[i], 1)))
            r = got.loc[i]
            assert (r.band_lower, r.band_upper) == pytest.approx((mid * kneser_ney.BIN - half, mid * kneser_ney.BIN + half))
            assert r.kept == (i in ok and r.band_lower <= r.log10_perplexity <= r.band_upper)


def test_kneser_ney_sums_to_one(spark):
    """Over all 256 bytes after a context, of contexts that were seen, seen in part, and not seen at all."""
    rnd = np.random.default_rng(0)
    b = textscan.as_bytes(pa.array(["".join(rnd.choice(list("abc .\n\u00e9"), 400)) for _ in range(20)]))
    g, n = np.unique(kneser_ney.gram_ids(b), return_counts=True)
    counts = dict(zip(g.tolist(), n.tolist(), strict=True))
    heads = [*np.unique(g >> 8)[:12].tolist(), 5, (ord("z") << 16) | (ord("a") << 8) | ord("b")]
    rows = [(1, x, counts.get(x, 0)) for x in {*counts, *((h << 8) + c for h in heads for c in range(256))}]
    p = kneser_ney.probabilities(kneser_ney.stored(spark.createDataFrame(rows, "lang_id long, gram long, n long"), "grams")).toPandas().set_index("gram").p
    for h in heads:
        assert p.loc[[(h << 8) + c for c in range(256)]].sum() == pytest.approx(1, abs=1e-9)


def test_perplexity_by_packs_equals_broadcast(spark):
    """A model that stays partitioned gives the same results, whatever the packs."""
    odd = odd_docs(spark).selectExpr("doc_id", "coalesce(lang, '') AS lang", "text")
    d = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang", "text").union(odd)
    model = kneser_ney.probabilities(kneser_ney.stored(kneser_ney.count_grams(d), "grams"))
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(kneser_ney.score(d, model))
    assert len(want) == d.count()
    assert rows(kneser_ney.score_by_packs(d, model, 20_000)) == want
    assert rows(kneser_ney.score(d, model, 0)) == want


# 4


def plain_katz(texts, out):
    """Probabilities of a trigram Katz model by dictionaries: texts, and which of them are held out."""
    n1, n2, n3 = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if not out[i]:
            x = ["\0S", "\0S", *t]
            n1.update(t)
            n2.update(zip(x[1:], t, strict=False))
            n3.update(zip(x, x[1:], t, strict=False))
    n, v = sum(n1.values()), len(n1)
    seen = {1: collections.defaultdict(dict), 2: collections.defaultdict(dict)}
    for (b, w), c in n2.items():
        seen[1][b,][w] = c
    for (a, b, w), c in n3.items():
        seen[2][a, b][w] = c
    ratio = {k: katz.discounts(collections.Counter(min(c, 7) for c in t.values())) for k, t in ((1, n2), (2, n3))}

    @functools.cache
    def context(h):
        """Shares of the words seen after h, and the weight of backing off."""
        after, d = seen[len(h)].get(h, {}), ratio[len(h)]
        if not after:
            return {}, 1.0
        total = sum(after.values())
        share = {w: d.get(c, 1.0) * c / total for w, c in after.items()}
        mass = sum(share.values())
        if mass > 1 - 1e-6:
            share = {w: s * (1 - 1 / (len(share) + 1)) / mass for w, s in share.items()}
        return share, (1 - sum(share.values())) / (1 - sum(prob(h[1:], w) for w in share))

    def prob(h, w):
        if not h:
            return (n1.get(w, 0) + 1) / (n + v + 1)
        share, alpha = context(h)
        return share[w] if w in share else alpha * prob(h[1:], w)

    return prob, n1, n


@pytest.mark.parametrize("parts", ["3", "40"])
def test_op4_against_brute_force(spark, parts):
    """With 40 partitions frequent words are hot, and are dealt over several parts."""
    d = pd.read_parquet(f"{SF}/documents.parquet")
    key, old = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, parts)
    got = queries.op4_language_model(spark, SF).toPandas().set_index("doc_id")
    spark.conf.set(key, old)
    text = {i: [*words(t), "\0E"] for i, t in zip(d.doc_id, d.text, strict=True)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in text}
    prob, n1, n = plain_katz(text, out)
    for h in [("\0S",), ("the",), ("\0S", "\0S"), ("of", "the"), ("never", "seen")]:  # with one unknown word, probabilities sum to one
        assert sum(prob(h, w) for w in n1) + prob(h, "\0unknown") == pytest.approx(1, abs=1e-9)
    assert len(got) == len(text)
    for i, t in text.items():
        r, x = got.loc[i], ["\0S", "\0S", *t]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in n1 for w in t), n, out[i])
        assert r.base_score == pytest.approx(sum(math.log10(prob((), w)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(prob((a, b), w)) for a, b, w in zip(x, x[1:], t, strict=False)), rel=1e-6)
    assert (got[got.held_out].score > got[got.held_out].base_score).mean() > 0.6


def test_packed_columns():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 700):
        head, tail = np.sort(rnd.integers(0, 40, n)).astype(np.uint64), rnd.integers(0, 2**32, n).astype(np.uint64)
        o = np.lexsort((tail, head))
        assert all((x == y).all() for x, y in zip(katz.ungrouped(*katz.grouped(head[o], tail[o])), (head[o], tail[o]), strict=True))
        assert (katz.spread(katz.squeeze(tail)) == tail).all()


# 1 and 9


def test_training_sample_keeps_what_fits(spark):
    docs = spark.createDataFrame([(i, "y" * 20 if i else None) for i in range(40)] + [(i, "x" * 1500) for i in range(40, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(-5000, 60)] + [(None, 1), (1, 1)], "doc_id long, toxic int")
    usable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    got = toxicity.labelled(docs, labels, "toxic", 1000, 1000).toPandas()
    assert len(got) == sum(i < 40 for i in usable) and got.text.str.len().max() == 20
    assert len(toxicity.labelled(docs, labels, "toxic", 1000).collect()) == len(usable)
    assert len(toxicity.labelled(docs, labels, "toxic", 7).collect()) == 7
    assert toxicity.labelled(docs, labels, "toxic", 1000, 0).toPandas().text.isna().all()


def test_training_takes_the_sample_in_one_python_pass(spark):
    docs = spark.createDataFrame([(i, "y" * (20 + i)) for i in range(40)] + [(i, "x" * 1500) for i in range(40, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    want = [(r.text, r.label) for r in toxicity.labelled(docs, labels, "toxic", 1000, 900).collect()]
    text, y = toxicity.trained(docs, labels, "toxic", 1000, lambda t, y: (t.to_pylist(), y.tolist()), 900)
    assert list(zip(text, y, strict=True)) == want and want
    sample = toxicity.sampled(docs, labels, "toxic", 1000)
    assert "MapInArrow" not in sample._jdf.queryExecution().executedPlan().toString() and sample.rdd.getNumPartitions() == 1


def test_workers_give_back_what_a_task_freed(spark):
    def rss(pid="self"):
        return int(re.search(r"VmRSS:\s+(\d+)", open(f"/proc/{pid}/status").read())[1]) >> 10

    def make():
        def f(b):
            held = [np.ones(8000) for _ in range(4000)]
            np.kept_by_a_test = np.ones(8000)  # above what goes, as a table that a worker keeps
            return {"pid": [os.getpid()] * b.num_rows, "mb": [rss() if held else 0] * b.num_rows}

        return f

    out = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("mb", T.IntegerType())])
    r = runtime.flat(runtime.arrow_pass(spark.range(1).coalesce(1), {"id": F.col("id")}, ["id"], make, out)).collect()[0]
    assert rss(r.pid) < r.mb - 150


def labelled(d):
    x = pd.read_parquet(f"{d}/documents.parquet").merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    return x, np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in x.doc_id])


def test_quality_on_held_out_rows():
    x, out = labelled("/root/testdata/sf0.01")
    f, y = quality_gam.all_features(pa.array(x.text)), x.quality.to_numpy(float)
    m = quality_gam.train(f[~out], y[~out])
    kept = quality_gam.sigmoid(m.logit(f[out])) >= quality_gam.THRESHOLD
    assert kept[y[out] == 1].mean() > 0.95 and kept[y[out] == 0].mean() < 0.3


def test_toxicity_on_held_out_rows():
    x, out = labelled("/root/testdata/sf0.1")
    x, out = x[:1600], out[:1600]
    net = toxicity.train(x.text[~out].tolist(), x.toxic[~out].to_numpy())
    s = toxicity.sigmoid(net.slope * toxicity.worst_windows(net, pa.array(x.text[out])) + net.shift)
    hit, y = s >= toxicity.THRESHOLD, x.toxic[out].to_numpy() == 1
    assert hit[~y].mean() < 0.03 and hit[y].mean() > 0.6


def test_gradients_of_the_network():
    rng = np.random.default_rng(3)
    net = toxicity.Network(np.arange(1, 4, dtype=np.uint64), np.zeros(0, np.uint64), rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vec, idx = rng.standard_normal((5, toxicity.INPUT_DIM)), rng.integers(0, 5, (3, toxicity.WINDOW))
    mask = np.arange(toxicity.WINDOW) < np.array([16, 5, 9])[:, None]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        q = toxicity.sigmoid(net.forward(vec @ net.p["Wf"] + net.p["bf"], vec @ net.p["Wb"] + net.p["bb"], idx, mask).astype(np.float64))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    g, dvec, _ = net.gradients(vec, idx, mask, y)
    for name, at in (("Uf", (1, 2)), ("Wb", (3, 20)), ("bf", (17,)), ("A", (2, 1)), ("v", (3,)), ("u", (9,))):
        p = net.p[name]
        keep, eps = p[at], 1e-3
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4)


# 2

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<div id=menu><ul><li><a href=x>Home</a></ul></div><div class="content"><h2>A &amp; B</h2><p>First, a long   paragraph with commas,\n and words enough to count, yes.<div class="share">share</div>
<p>Second paragraph, also long enough, with <b>bold</b><br>text.<ul><li>one<li>two</ul></div><div class=sidebar><p>Side text, which is long, with commas, more, and more of them.</p></div>
<section id="comments"><p>A reader's comment that is long, with commas, many, many.</p></section><form><p>Form</p></form><footer>&copy; x</footer></body>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A & B\n\nFirst, a long paragraph with commas, and words enough to count, yes.\n\nSecond paragraph, also long enough, with bold text.\n\none\n\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("no markup at all") == "no markup at all"
    assert html_text.main_text("<article><p>short</p></article") == "short"


PROSE = "A long paragraph of prose, with commas, and enough words to be scored as text of an article here. "


@pytest.mark.parametrize(
    ("page", "there", "gone"),
    [
        (f'<p>{PROSE}</p><script src="a.js"/>var x=1; leak();</script><style type=text/css/>.a{{}}</style><p>Then a second paragraph of text.</p>', ["Then a second"], ["leak", ".a"]),
        (f"<div id=top><section><h2>One</h2><p>{PROSE * 3}</p><p>{PROSE * 2}</p></section><section><h2>Two</h2><p>A short one, here it is now.</p></section></div>", ["One", "Two", "A short one"], []),
        (f"<div class=wrap><div class=x><p>A short lead paragraph goes here.</p></div><div class=y><p>{PROSE * 3}</p><p>{PROSE}</p></div></div>", ["A short lead"], []),
        (f'<article><p>{PROSE}</p><div class="share-price"><p>Prices: {PROSE * 3}</p></div><section id="related-work"><p>Others: {PROSE * 3}</p></section><div class="share-bar"><a>Tweet</a></div></article>', ["Prices", "Others"], ["Tweet"]),
        (f'<article><p>{PROSE * 2}</p></article><div id="user-feedback-list"><p>I say: {PROSE * 3}</p></div>', ["A long"], ["I say"]),
    ],
)
def test_article_is_whole_and_nothing_else(page, there, gone):
    text = html_text.main_text(f"<body>{page}</body>")
    assert all(x in text for x in there) and not any(x in text for x in gone)


LONG = "This paragraph, which is long enough, has commas, words and all that an article needs to be found by its score."


def test_main_text_of_other_pages():
    m = html_text.main_text
    assert m(f"<div><datalist><option>A</datalist><article><p>{LONG}</p></article></div>") == LONG
    assert m(f'<select><option>x<option>y</select><div class="social-history"><p>{LONG}</p><p>{LONG}</p></div>') == f"{LONG}\n\n{LONG}"
    assert m(f'<div class="footer"><p>{LONG}</p></div>') == LONG  # a name alone doesn't empty a page
    assert m(f"<main><p>{LONG}</p><math>x</math><object><p>{LONG}</p></object></main>") == f"{LONG}\n\nx\n\n{LONG}"
    assert m(f'<div id=a><div class="comment-body"><p>{LONG}</p></div></div><div><p>{LONG} 2</p></div>') == LONG + " 2"
    assert m(f"<div><p>{LONG}</p></div><p>2 < 3 &lt; 4</p>") == LONG
    # Scored, without any article element.
    assert m(f"<div><ul>{'<li><a href=x>Some link of a menu, long</a>' * 9}</ul></div><div>{f'<p>{LONG}</p>' * 3}</div><div><p>Short.</p></div>") == "\n\n".join([LONG] * 3)


def test_articles_renamed(spark):
    """Without article elements the containers' scores find the same texts."""
    p = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    same = [html_text.main_text(h) == html_text.main_text(h.replace("<article", "<div").replace("</article", "</div")) for h in p]
    assert sum(same) == len(same)


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "deep", "<a " * 200_000, '<a "' * 200_000, "<p><ul><li>" * 60_000, "<td>x</tr>" * 100_000, "<![" * 100_000, "<b title='" + "<i x=\"" * 100_000])
def test_html_in_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 8


def test_op2(spark):
    p = pd.read_parquet(f"{SF}/pages.parquet")
    got = queries.op2_html_extraction(spark, SF).toPandas().set_index("page_id")
    import html

    for i, h in zip(p.page_id, p.html, strict=True):
        body = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert got.loc[i].text == "\n\n".join(filter(None, parts)) and got.loc[i].n_chars == len(got.loc[i].text)


# Odd rows


def test_odd_rows(spark):
    d = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, 0), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    n = d.count()
    runs = {
        "bpe": lambda x: bpe.encode_documents(x, queries.tokenizer_file(), x.columns),
        "pii": pii.personal_data,
        "kn": kneser_ney.quality_rules,
        "katz": katz.language_model,
        "gam": lambda x: quality_gam.quality(x, labels),
        "tox": lambda x: toxicity.toxicity(x, labels),
    }
    for name, f in runs.items():
        got = f(d).collect()
        assert len(got) == n, name
        assert sum(r["doc_id"] == 1 for r in got) == 2, name
        one = [r for r in got if r["doc_id"] == 1]
        assert one[0] == one[1], name
        assert f(no_docs(spark)).count() == 0, name
    kn = {r["doc_id"]: r for r in kneser_ney.quality_rules(d).collect()}
    assert kn[2]["base_failed"] and kn[3]["n_words"] == 0 and not kn[4]["kept"] and kn[7]["n_words"] == 120_000
    lm = {r["doc_id"]: r for r in katz.language_model(d).collect()}
    assert lm[2]["n_tokens"] == lm[3]["n_tokens"] == 1 and lm[7]["n_tokens"] == 120_001


def test_odd_pages(spark):
    d = spark.createDataFrame([(1, "u", None, 3), (1, "u", "", 3), (2, None, "<p>" * 3000 + "deep", 3), (3, "u", "<a href=" + "x" * 100_000, 3)], "page_id long, url string, html string, n_chars int")
    got = html_text.main_texts(d).collect()
    assert [r["text"] for r in got] == ["", "", "deep", ""] and [r["n_chars"] for r in got] == [0, 0, 4, 0]
