import os

import pytest

from lexloom.llm import queries as q
from tests.compare import DATA, connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
FOUND = {
    "p1_found": ["file_id bigint", "line_no bigint"], "p2_found": ["chunk string"], "p3_found": ["file_id bigint"], "p4_found": ["tbl string", "row_id bigint"], "p6_ids": ["doc_id bigint", "ids array<int>"], "p7_found": ["doc_id bigint", "item_id bigint"], "p8_found": ["doc_id bigint", "subject string"],
}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_runs(spark, name):
    if name == "p6_ids" and not os.path.exists(q.tokenizer_dir()):
        pytest.skip("no tokenizer files here")
    df = q.QUERIES[name](spark, DATA)
    found = df.collect()
    assert found
    if name in FOUND:
        assert [f"{a} {b}" for a, b in df.dtypes] == FOUND[name]
        assert len({str(r) for r in found}) == len(found)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_as_sql(spark, name):
    assert rows(q.QUERIES[name](spark, DATA).toPandas()) == rows(connection().execute(q.SQL[name]).df())
