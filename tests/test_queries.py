"""Every registered query against its check SQL, and the entry point."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from tools.check import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        rel = duck.execute(ORACLES[name])
        cols = [d[0] for d in rel.description]
        assert compare(rows, df.columns, rel.fetchall(), cols) is None
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
