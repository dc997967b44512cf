import os

import pytest
from compare import check

from helixframe.jobs.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir):
    check(name, spark, sf_dir, QUERIES, ORACLES)


def test_other_queries_have_a_plain_version():
    """What SQL can't say is compared in test_brute_force.py."""
    plain = open(os.path.join(os.path.dirname(__file__), "test_brute_force.py")).read()
    assert all(f"test_{name.split('_')[0]}_" in plain for name in set(QUERIES) - set(ORACLES))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
