"""Every registered query with SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracewright.plans import queries_files, queries_findings, queries_rules, queries_store, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"taint_cyclic", "taint_dag", "fold_chains", "unfold_paths"}


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if pd.isna(v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return bool(v)
        return f"{float(v):.6f}" if isinstance(v, float) or "int" in type(v).__name__ or "float" in type(v).__name__ else str(v)

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW) + sorted(SLOW))
def test_query(spark, db, name):
    mine = registry.QUERIES[name](spark, SF).toPandas()
    theirs = db.execute(registry.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)
