import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import compare, connect

from lexloom.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(llm.queries()[name](spark, sf_dir), connect(sf_dir), llm.oracle_sql()[name]) == ""


COLUMNS = {
    "p1_found": ["table_name", "row_id", "pii_type", "char_start"],
    "p3_found": ["id_a", "id_b"],
    "p4_found": ["id_a", "id_b"],
    "p5_found": ["table_name", "row_id", "boundary"],
    "p6_found": ["table_name", "id_a", "id_b"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    assert df.count() >= 0
    assert sorted(df.columns) == sorted(COLUMNS.get(name, df.columns))
