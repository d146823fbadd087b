"""Every registered job against its DuckDB SQL (row count, names, values)."""

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from oracle_check import compare, duck

JOBS = sorted(E.queries())
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_job_has_oracle_sql():
    from rightsize.plans.jobs import JOBS as own
    assert [j for j in own if j not in ORACLE] == []


@pytest.mark.parametrize("name", [j for j in JOBS if j in ORACLE])
def test_job_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], ORACLE[name], SF_SMALL)
    assert r["cols_match"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["exact"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "k_comp" in df.columns
