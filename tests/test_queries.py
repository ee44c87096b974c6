"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from glossalith.plans.registry import ORACLES, QUERIES

from .compare import connect, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert name in ORACLES
    same(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLES[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["word_a", "word_b", "window_size", "pair_count", "pmi"]
    assert frame.limit(1).count() == 1
    assert set(QUERIES) <= set(entry.queries())
