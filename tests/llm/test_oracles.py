"""Queries against their SQL."""

import collections
import os

import duckdb
import pytest

from vetra.llm import registry


@pytest.fixture(scope="module")
def duck(sf):
    out = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        p = f"{sf}/{t}.parquet"
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return out


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    cursor = duck.execute(registry.ORACLES[name])
    own = [c[0] for c in cursor.description]
    assert sorted(own) == names
    want = [tuple(r[own.index(c)] for c in names) for r in cursor.fetchall()]
    assert collections.Counter(got) == collections.Counter(want)


def test_all_are_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}
