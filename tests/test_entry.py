import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from oracle import TABLES, rows  # noqa: E402
from planeflow.plans import registry  # noqa: E402


def test_entry(spark):
    out = entry.entry(spark).collect()
    assert out and all(r["status"] == "OK" for r in out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in out.description]
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, out.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_the_rest_stands_without_llm():
    code = "import sys; sys.modules['planeflow.llm'] = None; import planeflow.plans.registry as r; assert r.queries(); assert not [m for m in sys.modules if m.startswith('planeflow.llm.')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
