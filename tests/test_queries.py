"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from stratalode.plans import registry

TABLES = "lineitem embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_oracle(spark, sf_dir, duck, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if want[c].dtype.kind == "f":
            assert (got[c] - want[c]).abs().max() <= 2e-6, c
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", ["kmeans", "ward", "dssensemble", "ssdssensemble", "krigecluster", "ok_estimate", "consensus_hier", "consensus_spec", "cluster_metrics", "subensemble", "mds_embed", "rf_predict"])
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
