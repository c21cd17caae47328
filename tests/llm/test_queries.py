"""Registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quern.llm.oracles import ORACLES
from quern.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(DATA)).select(*expected.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected.fetchall(), key=str)


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
