import re

import __spark_entry__

from quantaloom.llm import queries


def test_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries())
    assert numbers == list(range(1, 11))
    assert {"pipeline", *queries.queries()} <= set(__spark_entry__.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())
