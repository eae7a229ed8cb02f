"""Every query of the package that has DuckDB SQL against it."""

import pytest
from compare import difference

from tillscope.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, key, size):
    assert difference(QUERIES[key](spark, f"/root/testdata/{size}"), ORACLES[key], f"/root/testdata/{size}") is None


def test_all_queries(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))
