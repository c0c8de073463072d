"""Every query that SQL can express, against DuckDB on the smallest tables; and partition independence."""

from __future__ import annotations

import math

import duckdb
import pytest

from tractloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Needs more regions than the smallest tables join.
EMPTY_HERE: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    return v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", ["connectome_count", "permutation_mean_diff", "quickbundles", "seeds_whole_brain", "track_probabilistic"])
def test_partitioning_does_not_matter(spark, name):
    key, seen = "spark.sql.shuffle.partitions", []
    old = spark.conf.get(key)
    for n in ("1", "13"):
        spark.conf.set(key, n)
        df = catalogue.queries()[name](spark, SF)
        seen.append(rows(df.columns, df.collect()))
    spark.conf.set(key, old)
    assert seen[0] == seen[1]
