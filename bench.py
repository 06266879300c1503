"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR names the folder of tables (default /root/testdata/sf0.1),
BENCH_CPUS the threads. Each query runs once to warm up and then three times;
the median counts. Besides queries of the retail pack, two shapes are timed on
generated rows: a sum over a fan of five (pre-aggregated, and by identity) and a
level taken at the last of 30 dates against a plain sum.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from metricspine.facade import Spine  # noqa: E402
from metricspine.queries import QUERIES  # noqa: E402
from metricspine.sources.catalog import Catalog  # noqa: E402

HEADLINE = [
    "fan_preagg_by_segment", "fan_preagg_two_tables", "fan_two_hops", "identity_matches_preaggregate", "through_then_fan_identity", "many_to_one_hop",
    "many_to_one_far_table", "dotted_filter_direct", "median_fan", "median_global", "stock_last_by_user", "stock_last_global", "recursive_closure", "topk_order_desc",
]

SHAPES = """
objects:
  Parent:
    primary: parent
    properties:
      group: {column: parent.dim_id, type: integer}
      v: {column: parent.v, type: decimal, quantity: flow}
  Child:
    primary: child
  Level:
    primary: level
    properties:
      group: {column: level.dim_id, type: integer}
      t: {column: level.t, type: date, time_unit: day}
links:
  Children: {from: Parent, to: Child, cardinality: one_to_many, on: [{from: parent.id, to: child.parent_id}]}
metrics:
  total: {measured_on: parent, agg: sum, value: parent.v}
  level: {measured_on: level, agg: sum, value: level.v, quantity: stock, over_time: {dimension: t, choice: last}}
  flat: {measured_on: level, agg: sum, value: level.v, quantity: flow}
"""


def shapes(spark: SparkSession, rows: int) -> dict[str, DataFrame]:
    """The fan and the level over rows generated rows, with five children each, 97 groups and 30 dates."""
    parent = spark.range(rows).selectExpr("id", "cast(id % 97 as int) dim_id", "cast(id % 1000 as decimal(12,2)) v")
    child = spark.range(rows * 5).selectExpr("id", f"id % {rows} parent_id")
    level = spark.range(rows).selectExpr("id", "cast(id % 97 as int) dim_id", "date_add(date'2024-01-01', cast(id % 30 as int)) t", "cast(id % 1000 as decimal(12,2)) v")
    catalog = Catalog(spark)
    for name, df in (("parent", parent), ("child", child), ("level", level)):
        catalog.add(name, df, [("id",)], {"*"})
    spine = Spine.load(spark, SHAPES, catalog=catalog)
    fan = {"object": "Parent", "traverse": ["Children"], "group_by": ["group"], "metrics": ["total"], "limit": None}
    return {
        f"fan5_preaggregate_{rows}": spine.df(fan),
        f"fan5_identity_{rows}": spine.df(fan, "identity"),
        f"level_window_{rows}": spine.df({"object": "Level", "group_by": ["group"], "metrics": ["level"], "limit": None}),
        f"level_plain_sum_{rows}": spine.df({"object": "Level", "group_by": ["group"], "metrics": ["flat"], "limit": None}),
    }


def timed(df_of) -> float:
    """Median of three runs after one to warm up; every row is computed and dropped."""
    took = []
    for _ in range(4):
        began = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return median(took[1:])


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: round(timed(lambda name=name: QUERIES[name](spark, folder)), 4) for name in HEADLINE}
    for rows in (1_000, 100_000, 1_000_000):
        for name, df in shapes(spark, rows).items():
            queries[name] = round(timed(lambda df=df: df), 4)
    print(json.dumps({"metric": "total seconds of the headline queries, warm median of 3", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
