from __future__ import annotations

import math
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("STEPFREE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stepfree.session import build_session

    session = build_session("local[4]", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    if hasattr(value, "item"):
        return plain(value.item())
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


@pytest.fixture(scope="session")
def same(duck):
    """Compare a DataFrame with DuckDB's rows for a text, as multisets."""

    def check(df, sql: str) -> int:
        cols = sorted(df.columns)
        ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
        assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
        return sum(ours.values())

    return check
