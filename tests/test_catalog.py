"""Every query with SQL against DuckDB; the others must run and return rows.

The smallest data has a bank with a single positive, so the split's fallback is used.
"""

from __future__ import annotations

import pytest
from compare import check, duck

from ledgerweave.catalog.oracles import ORACLES
from ledgerweave.catalog.queries import BUILDERS, QUERIES


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, inputs, small_dir, name):
    def build(_spark, _dir):
        return BUILDERS[name](inputs)

    assert check(spark, con, name, build, ORACLES[name], small_dir) is None


@pytest.mark.parametrize("name", sorted(set(BUILDERS) - set(ORACLES)))
def test_runs(inputs, name):
    df = BUILDERS[name](inputs)
    assert len(df.collect()) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(BUILDERS)


def test_guards_refuse_only_broken_reports(inputs):
    outcome = {r["case"]: r["refused"] for r in BUILDERS["guards"](inputs).collect()}
    assert outcome == {
        "complete": False,
        "bank missing": True,
        "field missing": True,
        "weights not positive": True,
        "update without rows": True,
        "empty secret": True,
    }


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 150
