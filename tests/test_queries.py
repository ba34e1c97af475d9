import pytest

from roadweave.queries import ORACLES, QUERIES
from tests.parity import SF, check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


def test_every_query_but_the_listed_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"rf_chained_impute", "rf_cv_scores", "cv_scores", "cv_sample"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_chained_forests_fill_and_keep(spark):
    got = QUERIES["rf_chained_impute"](spark, SF).collect()
    assert all(r["t1"] is not None and r["t1"] >= 0 for r in got)
