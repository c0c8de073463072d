"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
personal data are redacted, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents. Empty tables pass through every stage; documents without text are kept by every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.llm import bpe, decontaminate, neardup, pii, toxicity
from tractloom.llm.queries import tokenizer_file
from tractloom.llm.runtime import result, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't reject. It learns from the labels of documents among docs."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    done = toxicity.score(docs, net, docs.columns)
    return done.where(result(done, "predicted") == 0).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group. Rows that repeat an id are one document and stay or go together."""
    verdict = neardup.near_duplicates(docs)
    gone = verdict.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated; single hits below the rule's share stay."""
    done = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return done.where(~result(done, "contaminated")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacted texts; n_chars is counted anew, so that it still is the length of the text."""
    done = pii.find(docs, pii.train(docs), docs.columns, redact=True)
    kinds = dict(docs.dtypes)
    text = done.withColumn("text", result(done, "redacted"))
    if "n_chars" in kinds:
        text = text.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return text.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    done = bpe.encode_documents(docs, tokenizer_file(), ["doc_id"])
    return done.select("doc_id", "_out.n_tokens", "_out.ids_sha256", "_out.decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode),
]
#: Learned scores, groups and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
