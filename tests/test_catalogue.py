"""Every query of the catalogue against its SQL in DuckDB, and the driver's entry points."""

import datetime
import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from argosift.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[plain(r[i]) for i in order] for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    got = catalogue.queries()[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.columns, rows) == canonical(columns, want.fetchall())
    assert rows


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm(tmp_path):
    """The entry points work where the pipeline and the subpackage are gone."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, *a):
        if name.startswith('corpus_pipeline') or name.startswith('argosift.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {__spark_entry__.__file__.rpartition('/')[0]!r})
import __spark_entry__ as e
assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_a_missing_package_is_no_missing_subpackage(tmp_path):
    """What the optional modules need and don't find is an error, not a shorter list of queries."""
    (tmp_path / "corpus_pipeline.py").write_text("import package_that_is_not_there\n")
    code = f"""
import sys
sys.path[:0] = [{str(tmp_path)!r}, {__spark_entry__.__file__.rpartition('/')[0]!r}]
try:
    import __spark_entry__
except ModuleNotFoundError as e:
    assert e.name in ('package_that_is_not_there',)
else:
    assert __spark_entry__.corpus_pipeline is None  # the subpackage is gone altogether
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
