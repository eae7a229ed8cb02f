"""What the report moves and writes on the way."""

from pyspark.sql import functions as F

from tillscope.operators import metrics, panel
from tillscope.plans import queries_report, views
from tillscope.sources import sinks


def test_the_report_is_written_compressed(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_report, "work_folder", lambda spark, name: str(tmp_path / name))
    rows = queries_report.report_json(spark, folder)
    lines = sinks.as_json(rows).agg(F.sum(F.octet_length("record") + 1)).first()[0]
    files = sum(f.stat().st_size for f in (tmp_path / "report").iterdir() if f.name.startswith("part-"))
    assert 0 < files < lines / 2


def test_a_report_is_plain_unless_asked_otherwise(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), (None, float("nan"))], "k string, v double")
    for codec in ("none", "gzip"):
        sinks.write_report(rows, str(tmp_path / codec), codec)
        got = spark.read.schema(rows.schema).json(str(tmp_path / codec)).collect()
        assert sorted(map(str, map(tuple, got))) == ["('a', 1.5)", "(None, None)"]
    sinks.write_report(rows, str(tmp_path / "default"))
    assert any(f.name.endswith(".json") for f in (tmp_path / "default").iterdir())


def test_sums_by_order_follow_the_join_without_a_shuffle(spark, folder):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sales = panel.add_period(views.sales(spark, folder), "order_date", "month")
        plan = metrics.order_grain(sales, ["period"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    # Lines and parts meet by part, then lines and orders by order; nothing else moves.
    assert plan.count("Exchange hashpartitioning") == 4
