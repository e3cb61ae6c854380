"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark import catalogue

SF = f"{DATA}/sf0.001"


def _plain(value):
    if value is None or (not isinstance(value, (list, str)) and pd.isna(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return float(value)
    return float(f"{float(value):.7g}") + 0.0 if isinstance(value, (int, float)) or hasattr(value, "dtype") else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    own, other = catalogue.queries()[name](spark, SF).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    rows = [sorted(([_plain(v) for v in r] for r in f[sorted(own.columns)].itertuples(index=False)), key=str) for f in (own, other)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts():
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as d:
        for part in ("__spark_entry__.py", "tidemark"):
            (Path(d) / part).symlink_to(root / part) if part.endswith(".py") else None
        target = Path(d) / "tidemark"
        target.mkdir()
        for p in (root / "tidemark").iterdir():
            if p.name not in ("llm", "__pycache__"):
                (target / p.name).symlink_to(p)
        code = "import sys; sys.path[:] = [p for p in sys.path if 'root/repo' not in p]; sys.path.insert(0, '.'); exec(open('__spark_entry__.py').read()); q = queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
        out = subprocess.run([sys.executable, "-B", "-c", code], cwd=d, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr
