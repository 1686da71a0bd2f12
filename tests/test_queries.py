import ast
from pathlib import Path

import pytest
from oracle import DATA, check

from millrace.plans import found, intake, orders

QUERIES, SQL = found.QUERIES | orders.QUERIES | intake.QUERIES, found.SQL | orders.SQL | intake.SQL
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, name):
    check(spark, QUERIES[name], SQL.get(name))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == len(found.QUERIES) + len(orders.QUERIES) + len(intake.QUERIES)


def test_nothing_imports_the_llm_package():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("millrace.llm") for n in names), path
