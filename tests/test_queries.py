"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if not getattr(v, "hour", 0) else v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]}) x").fetchall()
    key = lambda row: tuple(str(v) for v in row)
    a = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in found), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-5) if all(isinstance(v, (int, float)) for v in (*x, *y)) else all(p == q or (isinstance(p, float) and abs(p - q) < 2e-5) for p, q in zip(x, y, strict=True))


def test_plans_are_pruned(spark):
    """No Python in relational plans; filters and columns reach the scan."""
    text = registry.queries()["salary_overview"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text or "GreaterThanOrEqual(o_orderdate" in text
    assert "o_orderstatus" in text and "l_orderkey" not in text


def test_engine(spark):
    from tidemark.engine import Engine, ResultCache
    from tidemark.filters import AnalyticsFilter
    from tidemark.plans import star

    engine = Engine(star.jobs(spark, DIR), star.bridge(spark, DIR), star.dimension(spark, DIR), ResultCache(), star.remote())
    flt = AnalyticsFilter(as_of=star.AS_OF, window_days=365, limit=5)
    assert engine.demand(flt).count() == 5 and engine.demand(flt) is engine.demand(flt)
    assert engine.cache.invalidate("tidemark:v1:skills") == 1
    name = engine.live.first().company_name
    assert engine.company(flt.with_window(1825), name).count() <= 1
    assert set(engine.explorer(flt, "Brand#23")) >= {"trend", "related", "salary"} and engine.seniority(flt).count() == 11
    assert all(df.columns for df in engine.report(flt).values())
    for bad in ({"window_days": 0}, {"limit": 501}):
        with pytest.raises(ValueError):
            AnalyticsFilter(as_of=star.AS_OF, **bad)
    with pytest.raises(ValueError):
        engine.salaries_by(flt, "shoe_size")


def test_entry_without_the_optional_subpackage(tmp_path):
    """A copy without tidemark/llm, tests/llm and the pipeline: the entry imports and its queries are there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) == len(registry.queries()) and out[1:] == ["False", "True"]
