import os

import pytest

from inkweir.llm import queries
from tests.compare import TABLES, canonical, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
COLUMNS = {
    "p1_found": "field string, id_a bigint, id_b bigint", "p2_found": "tbl string, item_id bigint, kind string", "p3_found": "id_a bigint, id_b bigint", "p4_found": "tbl string, item_key string, line_no int", "p5_found": "id bigint",
    "p6_found": "cand_id bigint, kind string", "p7_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint, kind string, start_pos int",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, TABLES)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    got = df.toPandas()
    if name in queries.oracle_sql():
        assert canonical(got) == canonical(connection().execute(queries.oracle_sql()[name]).df())
    if name.endswith("_found"):
        assert not got.duplicated().any()
