import pytest

from engram.plans import core_queries, more_queries, record_queries, reference_queries
from tests.parity import FOLDER, same

MODULES = (core_queries, reference_queries, more_queries, record_queries)
WITH_SQL = [(m, n) for m in MODULES for n in m.ORACLE_SQL]
WITHOUT = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.ORACLE_SQL]
needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@needs_tables
@pytest.mark.parametrize(("module", "name"), WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_query_equals_its_sql(spark, module, name):
    same(spark, module.QUERIES[name], module.ORACLE_SQL[name])


@needs_tables
@pytest.mark.parametrize(("module", "name"), WITHOUT, ids=[n for _, n in WITHOUT])
def test_query_without_sql_gives_rows(spark, module, name):
    assert module.QUERIES[name](spark, str(FOLDER)).count() > 0


def test_names_are_unique_and_every_sql_has_its_query():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names)) and all(n in m.QUERIES for m in MODULES for n in m.ORACLE_SQL)
