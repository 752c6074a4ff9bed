"""Every query with SQL gives the rows of that SQL in DuckDB."""

import sys
import threading
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

from corvane import catalog_queries as cq  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(cq.QUERIES))
def test_same_rows_as_sql(spark, tiny, duck, name):
    got, want = normal(cq.QUERIES[name](spark, tiny).toPandas()), normal(duck.execute(cq.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(cq.QUERIES))
def test_same_types_as_sql_which_ends_below_a_limit(spark, tiny, duck, name):
    want = {c: t for c, t, *_ in duck.execute(f"DESCRIBE {cq.ORACLE_SQL[name]}").fetchall()}
    assert {c: KINDS[t] for c, t in cq.QUERIES[name](spark, tiny).dtypes} == want
    stop = threading.Timer(20, duck.interrupt)
    stop.start()
    duck.execute(f"SELECT * FROM ({cq.ORACLE_SQL[name]}) LIMIT 1000000").fetchall()
    stop.cancel()


def test_every_query_has_sql():
    assert set(cq.QUERIES) == set(cq.ORACLE_SQL)


def test_contract(spark):
    assert entry.entry(spark).columns == ["corpus", "start", "end", "position", "sentence", "words"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_default_plan_does_not_shuffle(spark, tiny):
    plan = cq.QUERIES["seq_three"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "f_lemma" in plan and "f_lang" not in plan.split("ReadSchema")[-1]
