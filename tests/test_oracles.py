"""Every registered query that has an oracle equals it at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from spanloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return v.tolist() if hasattr(v, "tolist") else v

    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
