"""Registered queries against their SQL, the flagship, and the library without its llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from skyframe.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(names).collect())))
    assert rows
    if name in catalogue.oracle_sql():
        con = duckdb.connect()
        for t in ("events", "embeddings"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(f"select {', '.join(names)} from ({catalogue.oracle_sql()[name]})").fetchall()
        assert rows == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    for name in ("skyframe", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith("py") else (tmp_path / name).mkdir()
    for part in (ROOT / "skyframe").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "skyframe" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; assert 'pixelise_events' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
