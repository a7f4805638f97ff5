"""Every registered query against its DuckDB twin on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest
from eventide import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries that SQL cannot express: tests/test_fits.py compares their results with slow versions.
FITTED = "ml_ridge_cv ml_elasticnet_cv ml_logistic ml_gbm wf_two_mode wf_elasticnet wf_spread wf_full_regime wf_sign wf_classify_fit wf_iv_era wf_forward_once wf_forward_locked wf_ablation".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.ndim == 0:
        return float(x) + 0.0
    return str(x)


def rows(df):
    cols = sorted(df.columns)
    out = [tuple(cell(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-5 * max(1.0, abs(a), abs(b))
    return a == b


def test_every_query_has_sql_or_a_slow_version():
    assert sorted(set(catalog.queries()) - set(catalog.oracle_sql())) == sorted(FITTED)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    oracle = catalog.oracle_sql()[name]
    (cols, mine), (want_cols, want) = rows(got), rows(duck.execute(oracle).df())
    assert cols == want_cols
    assert len(mine) == len(want)
    different = [(a, b) for a, b in zip(mine, want) if not all(map(close, a, b))]
    assert not different, different[:3]


def test_names_need_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
    n, oracles = map(int, out.stdout.split()[-2:])
    assert n >= 290 and oracles >= 270
