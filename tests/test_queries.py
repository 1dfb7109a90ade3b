"""Every registered query against its SQL check, on the smallest tables."""

import compare as cmp
import pytest

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, CHECKS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return cmp.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    result, _ = cmp.compare(spark, sf_dir, name, QUERIES[name], CHECKS.get(name), con)
    assert result.startswith(("ok", "rows")), result
    assert int(result.split()[1]) > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
