from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t, lower=True, pattern=WORDS):
    t = t or ""
    return pattern.findall(t.translate(LOWER) if lower else t)


def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names clash with results and internals."""
    long = " ".join(f"word{k % 997} and{k}" for k in range(60_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (6, "x"), (None, "a b c d e f g"), (7, long), (8, long), (9, "é ü \U0001f600 Ünïcode TEXT"), (10, None)]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", 1, "q", 0.5, 2) for i, t in rows], "doc_id long, text string, lang string, n_words int, _out string, score double, c0 int")


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
