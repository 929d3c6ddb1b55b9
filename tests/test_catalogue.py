import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from compare import TABLES, canonical

SMALL = "/root/testdata/sf0.001"
CORE = {k for k, f in entry.queries().items() if not f.__module__.startswith("papyra.llm")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["gene_id", "n_papers"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    mine = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(CORE - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).collect() is not None
