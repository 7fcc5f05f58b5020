"""Every registered query of the library's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from orrery import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows):
    return sorted([tuple(None if x is None else f"{x:.12g}" if isinstance(x, float) and math.isfinite(x) else str(x) for x in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    found = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = plans.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(found.fetchall())


def test_registry():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_lists_need_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], check=True, cwd=root)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
