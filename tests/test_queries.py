"""Every query of the library against DuckDB on the smallest data."""

import duckdb
import pandas as pd
import pytest

from tracejobs.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__.startswith(("int", "float")) else str(v)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "labels", "documents", "part", "customer", "supplier", "nation", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
