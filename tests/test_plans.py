"""Plans stay on the JVM, push work into the scan and never window a whole table."""

import re

import pytest

from tillscope.plans import views
from tillscope.plans.catalog import QUERIES
from tillscope.operators import metrics, panel

PYTHON_ALLOWED = {"cosine_match", "cosine_match_cells", "trend_bends"}
SAMPLE = ("kpi_panel", "category_panel", "kpi_pack", "drop_duplicates", "standardize_text", "ffill_bfill",
          "profile_columns", "top_values", "fuzzy_match", "text_sections", "text_tables", "trend_fit",
          "clip_outliers_by_group", "impute_by_group", "period_change", "cosine_match", "seasonal_fit")


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", SAMPLE)
def test_python_only_where_it_must(spark, folder, key):
    plan = _plan(QUERIES[key](spark, folder))
    has_python = bool(re.search(r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|FlatMapCoGroupsInPandas|BatchEvalPython", plan))
    assert has_python == (key in PYTHON_ALLOWED)


@pytest.mark.parametrize("key", SAMPLE)
def test_no_cross_join(spark, folder, key):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", _plan(QUERIES[key](spark, folder)))


def test_only_the_needed_columns_are_read(spark, folder):
    plan = _plan(metrics.sales_by(views.sales(spark, folder, ["selling_price", "quantity", "category"]), "category"))
    schemas = re.findall(r"ReadSchema: (\S+)", plan)
    assert any("l_quantity" in s and "l_tax" not in s for s in schemas)
    assert not any("o_orderkey" in s for s in schemas)


def test_row_filters_reach_the_scan(spark, folder):
    sales = views.sales(spark, folder).where("order_id < 100")
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(l_orderkey,100\)", _plan(sales))


def test_panel_needs_no_row_expansion(spark, folder):
    plan = _plan(panel.kpi_panel(views.sales(spark, folder), "order_date"))
    physical = plan[plan.index("== Physical Plan ==") :]
    # One Expand turns the finished wide row into long rows; distinct counts add none.
    assert physical.count("Expand") + physical.count("Generate ") <= 1
