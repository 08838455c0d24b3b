import pytest
from oracle import differing

from tramline.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    assert differing(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER) == ([], [])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).schema == entry.queries()["departures_at_stop"](spark, FOLDER).schema
    assert set(entry.oracle_sql()) <= set(entry.queries())
