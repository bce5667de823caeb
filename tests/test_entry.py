import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import compare, connect

import __spark_entry__ as entry
from lexloom import queries as core

CORE = core.queries()


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_core_query_equals_its_sql(spark, sf_dir, name):
    assert compare(CORE[name](spark, sf_dir), connect(sf_dir), core.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(CORE) - set(core.oracle_sql())))
def test_core_query_runs(spark, sf_dir, name):
    df = CORE[name](spark, sf_dir)
    assert df.count() >= 0 and df.columns


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["clause_id", "root_id", "depth"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
