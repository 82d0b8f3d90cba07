"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def tidy(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.5f}" if not math.isclose(v, 0, abs_tol=1e-9) else "0.00000"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


from joust.plans.registry import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if q.oracle() is None:
        assert df.columns
        return
    cur = duck.execute(q.oracle())
    names = [d[0] for d in cur.description]
    other = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    assert sorted(tuple(tidy(r[k]) for k in key) for r in rows) == sorted(tuple(tidy(r[k]) for k in key) for r in other)


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['joust.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [k for k in e.queries() if k[:2] == 'op']"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
