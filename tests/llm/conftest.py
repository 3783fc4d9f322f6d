import duckdb
import pytest


@pytest.fixture(scope="session")
def rows_of(small):
    """Rows of a given table as dictionaries."""
    con = duckdb.connect()

    def get(name, sf=small):
        cursor = con.execute(f"select * from '{sf}/{name}.parquet'")
        names = [c[0] for c in cursor.description]
        return [dict(zip(names, r)) for r in cursor.fetchall()]

    return get
