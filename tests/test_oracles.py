"""Every registered query with SQL against DuckDB on the smallest driver tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from marlstone.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if "T00:00:00" in v.isoformat() or len(v.isoformat()) == 10 else v.isoformat()
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, float | np.floating):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted([tuple(value(v) for v in r) for r in df.astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_imports_without_the_llm_subpackage(tmp_path):
    """The library and its entry point work after the subpackage and the pipeline are taken away."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "marlstone"), tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); print(len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert said.returncode == 0, said.stderr
