"""Time operators on made-up skewed rows: a third of them share one order, product and category.

ROWS (20,000,000) and BENCH_CPUS (8) are read from the environment; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from tillscope.operators import clean, metrics, panel, quantiles
from tillscope.session import build_session


def main() -> None:
    rows, cpus = int(os.environ.get("ROWS", "20000000")), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory(prefix="tillscope-skew-") as work:
        spark = build_session(
            "tillscope-skew",
            f"local[{cpus}]",
            **{
                "spark.sql.shuffle.partitions": cpus,
                "spark.driver.memory": "12g",
                "spark.checkpoint.dir": work,
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
            },
        )
        spark.sparkContext.setLogLevel("ERROR")
        noise = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
        hot = F.col("id") % 3 == 0
        pick = lambda n, salt: F.when(hot, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)) + 1)
        spark.range(rows).select(
            "id",
            pick(5_000_000, 1).alias("order_id"),
            pick(300_000, 2).cast("string").alias("product"),
            pick(150, 3).cast("string").alias("category"),
            pick(5, 4).cast("string").alias("channel"),
            (noise.cast("double") / 100).alias("selling_price"),
            (noise % 9 + 1).cast("int").alias("quantity"),
            (noise % 4 * 5).cast("int").alias("discount_percent"),
            F.expr("date_add(date'2016-01-01', cast(pmod(xxhash64(id, 5), 2900) as int))").alias("order_date"),
            F.when(F.col("id") % 7 > 1, F.col("id")).alias("gappy"),
        ).write.parquet(f"{work}/sales")
        sales = spark.read.parquet(f"{work}/sales")
        steps = {
            "kpi_panel": lambda: panel.kpi_panel(sales, "order_date", "month"),
            "category_panel": lambda: panel.category_panel(sales, "order_date", "month"),
            "clip_outliers_by_category": lambda: clean.clip_outliers_by_group(sales, ["selling_price", "quantity"], "category"),
            "clip_outliers_by_product": lambda: clean.clip_outliers_by_group(sales, ["selling_price", "quantity"], "product"),
            "global_median": lambda: quantiles.exact_quantiles(sales, [], "selling_price", [0.5]),
            "ordered_fill": lambda: clean.fill_in_order(sales.select("id", "gappy"), ["gappy"], "id"),
        }
        times = {}
        for name, step in steps.items():
            start = time.perf_counter()
            step().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 2)
        print(json.dumps({"metric": "seconds on skewed rows", "rows": rows, "cpus": cpus, "steps": times}))
        spark.stop()


if __name__ == "__main__":
    main()
