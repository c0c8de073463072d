"""Operators that look across documents, the dialogue operator and the pipeline."""

from __future__ import annotations

import collections
import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.llm.helpers import SF, no_docs, odd_docs, words
from tractloom.llm import chat, components, decontaminate, neardup, queries, sql, textscan


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def groups(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {p for ids in by.values() if len(ids) < 2000 for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_op7_against_brute_force(spark):
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_near_duplicates(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    sets = {i: shingles(t) for i, t in zip(d.doc_id, d.text, strict=True)}
    want = groups(sets)
    for i, s in sets.items():
        assert (got.loc[i].n_shingles, got.loc[i].component_id, got.loc[i].kept) == (len(s), want[i], want[i] == i)


def test_chain_of_near_copies(spark):
    """Each text is near the next but far from the ones beyond: no pair with the first would find the chain."""
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(300)]
    rows, text = [], list(base)
    for i in range(12):
        rows.append((i, " ".join(text)))
        for k in rng.choice(300, 6, replace=False):
            text[k] = f"n{i}x{k}"
    sets = {i: shingles(t) for i, t in rows}
    want = groups(sets)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 12


def test_sketch_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        k = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 400 - k).astype(np.uint64)])
        s = neardup.sketches(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
        assert (s != np.uint64(2**64 - 1)).all()
        assert (s[0] == s[1]).mean() == pytest.approx(share, abs=0.16)
    one = neardup.sketches(np.array([7], np.uint64), np.array([0]), 1)
    assert (one != np.uint64(2**64 - 1)).all()  # even one shingle fills every coordinate


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 130)] + [(1, 50), (50, 7), (9, 9)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(101, 131)}, 50: 1, 7: 1}


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(sql.ORACLE[name])
    names = [d[0] for d in want.description]
    assert cols == sorted(names)
    key = lambda rows, order: sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)
    assert key(df.select(*cols).collect(), range(len(cols))) == key(want.fetchall(), [names.index(c) for c in cols])


def test_contamination_in_blocks(spark):
    """A benchmark cut into several blocks gives the same result."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    run = lambda limit: sorted(map(tuple, decontaminate.contamination(docs, bench, ["doc_id"], limit).select("doc_id", "_out.*").collect()))
    assert run(decontaminate.BLOCK_WINDOWS) == run(1500)


def test_odd_corpora(spark):
    d = odd_docs(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "X"), (3, "x"), (None, "and1 word2"), (4, "a b c d e f g")], "item_id long, text string")
    got = decontaminate.contamination(d, bench, d.columns)
    assert got.columns == [*d.columns, "_out_"]
    got = got.collect()
    assert len(got) == d.count()
    by = {r["doc_id"]: r["_out_"] for r in got}
    assert by[5]["n_hit"] == 1 and by[5]["n_items"] == 1 and by[5]["contaminated"] and by[1]["n_hit"] == 7 and by[2]["n_words"] == 0 and not by[3]["contaminated"]
    assert by[7]["n_hit"] == 2 and by[7]["n_items"] == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_table(d, empty).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination_table(no_docs(spark), bench).count() == 0
    near = neardup.near_duplicates(d).collect()
    assert len(near) == d.count()
    of = {r["doc_id"]: r for r in near}
    assert of[6]["component_id"] == 5 and of[8]["component_id"] == 7 and of[2]["component_id"] == 2 and of[3]["kept"] and of[None]["component_id"] is None and of[None]["kept"]
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


def test_dialogues(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|end|>"), (1, 2, "ann", None), (1, 2, "ann", None), (2, None, None, "x"), (None, 0, "u", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(d).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "u")}
    t = got[1, "bob"]
    assert t["text"] == "<|user name=ann|>\nhi<|end|>\n<|assistant|>\nyo < |end|><|end|>\n<|user name=ann|>\n<|end|>\n<|user name=ann|>\n<|end|>\n"
    assert [t["text"][m["start"] : m["end"]] for m in t["mask"]] == ["yo < |end|><|end|>"]
    assert [got[1, "ann"]["text"][m["start"] : m["end"]] for m in got[1, "ann"]["mask"]] == ["hi<|end|>", "<|end|>", "<|end|>"]
    assert chat.rotated(d.where("conv_id = 77")).count() == 0


def test_names_that_look_like_markers(spark):
    rows = [(1, 0, "x|>\n<|assistant|>", "hi", 5, "c"), (1, 1, "b", "yo", 6, "d")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start_char int, rendered string")
    got = {r["perspective"]: r["text"] for r in chat.dialogues(d).collect()}
    assert got["b"] == "<|user name=x| >\n< |assistant| >|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"


def pipeline_docs(spark, rows):
    """Documents with a column that clashes with what the stages compute."""
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean")


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns through every stage, against brute force."""
    import corpus_pipeline as cp
    from tractloom.llm import pii

    long = " ".join(f"w{k % 911} v{k}" for k in range(30_000))
    base = " ".join(f"t{k}" for k in range(200))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    rows = [(1, base), (2, base), (3, base.replace("t7 ", "u7 ")), (4, None), (5, ""), (6, ""), (None, "no id here"), (7, long), (7, long), (8, bench), (9, "mail a.b@c.example.com or +1 (017) 555-7713"), (10, "only one")]
    docs = pipeline_docs(spark, rows)
    at = {name: stage for name, stage in cp.STAGES}
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    clean = at["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and ids(clean) == sorted((r[0] for r in rows), key=str)
    one = at["near_duplicates"](spark, docs, SF)
    want = groups({i: shingles(t) for i, t in rows if i is not None and shingles(t)})
    assert one.columns == docs.columns and ids(one) == sorted((i for i, t in rows if i is None or want.get(i, i) == i), key=str)
    fresh = at["decontamination"](spark, docs, SF)
    assert fresh.columns == docs.columns and ids(fresh) == sorted((i for i, _ in rows if i != 8), key=str)
    red = at["personal_data"](spark, docs, SF)
    got = {r["doc_id"]: r for r in red.collect()}
    assert red.columns == docs.columns and red.count() == len(rows) and got[4]["text"] is None and got[7]["text"] == long
    assert got[9]["text"] == "mail [EMAIL] or [PHONE]" and got[9]["n_chars"] == len(got[9]["text"]) and not any(pii.base_spans(r["text"] or "") for r in got.values())
    out = at["bpe"](spark, docs, SF).collect()
    assert len(out) == len(rows) and {r["n_tokens"] for r in out if r["doc_id"] in (4, 5, 6)} == {0}
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("doc_id = 77"), SF).count() == 0, name


def test_toxicity_stage_drops_what_the_query_rejects(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bad = {r["doc_id"] for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").where("predicted = 1").collect()}
    kept = {r["doc_id"] for r in cp.STAGES[0][1](spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert bad and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad


@pytest.mark.parametrize("name, label, least, most", [("op1_quality_classifier", "quality", 0.97, 0.1), ("op9_toxicity", "toxic", 0.7, 0.05)])
def test_classifier_queries_on_held_out_rows(spark, name, label, least, most):
    """The queries themselves, over whole tables: folds, ranges, and accuracy on labels that were not learned from."""
    import zlib

    sf = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"])) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    x = got.merge(labels, on="doc_id")
    x = x[x.held_out]
    hit = x.predicted == 1
    assert hit[x[label] == 1].mean() >= least and hit[x[label] == 0].mean() <= most
    edge = 0.7 if label == "quality" else 0.3
    assert ((got.score >= edge) == (got.predicted == 1)).all()


def test_dialogue_in_blocks(spark):
    n = 3 * chat.BLOCK_TURNS
    d = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "concat('p', id % 2) AS role", "repeat('x', cast(id % 7 as int)) AS text")
    r = chat.dialogues(d).where("perspective = 'p1'").first()
    assert len(r["mask"]) == n // 2 and all(r["text"][m["start"] : m["end"]] == "x" * ((2 * k + 1) % 7) + "<|end|>" for k, m in enumerate(r["mask"]))


def test_window_hashes_differ():
    h = np.arange(1, 50, dtype=np.uint64)
    assert len(np.unique(textscan.window_hash(h, 3))) == 47


def test_pipeline(spark):
    import corpus_pipeline as cp
    from tractloom.llm import pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        before = kept.count()
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        assert kept.count() <= before and (k != 3 or kept.count() == before), name
    texts = [r["text"] for r in kept.select("text").collect()]
    assert not any(pii.base_spans(t) for t in texts)
    sets = {k: shingles(t) for k, t in enumerate(texts) if t}
    assert len(set(groups(sets).values())) >= 0.98 * len(sets)
    got = cp.run(spark, SF)
    assert got.count() == len(texts) and set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
