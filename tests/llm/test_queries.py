import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import DATA, check

from millrace.llm.queries import QUERIES, SQL


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, name):
    check(spark, QUERIES[name], SQL.get(name))
