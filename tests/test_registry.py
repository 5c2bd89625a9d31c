"""Every registered query runs on sf0.001 with a stable schema; the driver entry works."""

import importlib.util
import os

import pytest

from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry(spark):
    m = _entry()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"category", "file_count", "total_size"}


def test_oracles_cover_queries():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def _catalogue_queries():
    """The corpus operators' queries have tests of their own beside them."""
    from shelfspark.queries import queries
    return sorted(queries())


@pytest.mark.parametrize("name", _catalogue_queries())
def test_query_runs(spark, name):
    m = _entry()
    df = m.queries()[name](spark, SF_SMALL)
    schema1 = df.schema
    n = df.count()
    assert n >= 0
    assert m.queries()[name](spark, SF_SMALL).schema == schema1
