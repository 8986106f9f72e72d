"""Every query with a DuckDB oracle must match it (rows, columns, values) at sf0.001."""

import pytest

import __spark_entry__ as E
from scripts.oracle_check import norm

from .conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.execute(ORACLES[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    oorder = [ocols.index(scols[i]) for i in order]
    assert sorted(tuple(norm(r[i]) for i in order) for r in srows) == \
        sorted(tuple(norm(r[i]) for i in oorder) for r in orows)


def test_every_query_is_registered_with_unique_name():
    qs = E.queries()
    assert len(qs) >= 100
    assert set(ORACLES) <= set(qs)


def test_entry_returns_one_record_per_account(spark):
    df = E.entry(spark)
    assert df.count() == 150
    assert {"username", "label", "probability", "risk_band", "confidence", "explanation"} <= set(df.columns)
