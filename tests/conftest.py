import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_session

    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    """Rows as sorted tuples, columns by name, floats rounded, dates as text."""

    def one(v):
        if v is None or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return v

    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)
