import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and "state_at" in q


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
