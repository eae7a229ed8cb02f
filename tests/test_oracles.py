"""Every registered query against its DuckDB SQL, and every plan it runs on the way."""

import re

import pytest
from compare import difference
from pyspark.sql import DataFrame
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame
from pyspark.sql.readwriter import DataFrameWriter

from tillscope.plans.catalog import ORACLES, QUERIES

PYTHON = re.compile(r"ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas|FlatMapCoGroupsInPandas|BatchEvalPython")
PYTHON_ALLOWED = {"cosine_match", "cosine_match_cells", "trend_bends"}


@pytest.fixture
def plans(monkeypatch):
    """Plans of everything written or checkpointed: what lies before such a cut is not in the final plan."""
    seen = []
    checkpoint, parquet = ClassicDataFrame.checkpoint, DataFrameWriter.parquet
    plan = lambda df: df._jdf.queryExecution().toString()

    def noted_checkpoint(self: DataFrame, *args, **kwargs):
        seen.append(plan(self))
        return checkpoint(self, *args, **kwargs)

    def noted_parquet(self, *args, **kwargs):
        seen.append(plan(self._df))
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(ClassicDataFrame, "checkpoint", noted_checkpoint)
    monkeypatch.setattr(DataFrameWriter, "parquet", noted_parquet)
    return seen


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, folder, key, plans):
    df = QUERIES[key](spark, folder)
    plans.append(df._jdf.queryExecution().toString())
    assert difference(df, ORACLES[key], folder) is None
    for plan in plans:
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
        assert key in PYTHON_ALLOWED or not PYTHON.search(plan)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | {"trend_bends"}  # held against planted bends
