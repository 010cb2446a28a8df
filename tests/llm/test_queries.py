import pytest

from pagemill.llm import queries
from tests.compare import database, rows, spark_frame
from tests.conftest import SMALL

COLUMNS = {
    "p1_found": ["page_id"], "p2_found": ["page_id", "line_no"], "p3_found": ["page_id"], "p4_found": ["page_id_a", "page_id_b"], "p5_found": ["page_id", "line_no"], "p6_found": ["page_id"], "p7_found": ["page_id", "markup"],
    "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "start_char"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    ours = spark_frame(queries.queries()[name](spark, SMALL))
    if name in COLUMNS:
        assert list(ours.columns) == COLUMNS[name]
        assert not ours.duplicated().any() and not ours.isna().any().any()
    if name in queries.oracle_sql():
        theirs = database(SMALL).execute(queries.oracle_sql()[name]).fetchdf().astype(object)
        assert rows(ours) == rows(theirs)
