import pytest

from engram.llm import queries
from tests.parity import FOLDER, same

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, str(FOLDER)).count() > 0
