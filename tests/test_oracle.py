"""Every query with an SQL twin gives the twin's whole result; the comparison notices a changed value."""

import pytest

from tests import oracle
from vektorium.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, con, name):
    got = oracle.spark_rows(registry.queries()[name](spark, sf_dir))
    want = oracle.sql_rows(con, registry.oracle_sql()[name])
    assert want[1]
    assert oracle.mismatch(got, want) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_comparison_notices(con):
    want = oracle.sql_rows(con, registry.oracle_sql()["exact_topk_dot"])
    for change in (lambda r: (r[0], r[1], r[2] + 1e-12, r[3]), lambda r: (r[0] + 1, *r[1:])):
        rows = [change(want[1][0]), *want[1][1:]]
        assert oracle.mismatch((want[0], rows), want)
    assert oracle.mismatch((want[0], want[1][1:]), want)
