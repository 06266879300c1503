"""Exact order statistics that keep the type of their values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the sketch that brackets an order statistic; ranks are off by at most rows / ACCURACY.
ACCURACY = 10_000


def rank_of(p: float, n: Column) -> Column:
    """The rank of the p-quantile among n values: the least k with k / n >= p, and at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(p)) * n.cast("double")))


def _measure(v: Column, kind: T.DataType) -> Column | None:
    """v on a scale that a sketch knows and that never turns the order of two values around; None for text and the like."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(v.cast("double"), F.lit(float("inf")))
    if isinstance(kind, T.NumericType):
        return v.cast("double")
    return v if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None


def discrete_percentile(df: DataFrame, keys: list[str], value: Column, p: float, label: str) -> DataFrame:
    """keys and the smallest value v such that at least the share p of the group's values is at most v; nulls don't count.

    A sketch for each group, merged from partial ones, brackets the rank. Values
    are counted; those below the bracket are summed up to one row of their
    group, those above are left out, and the few inside are ordered. So no
    task orders a group, however large. Text, which no sketch knows, is
    ordered by a group's distinct values, in a window that spills.
    """
    by = [F.col(f"`{k}`") for k in keys]
    valued = df.select(*by, value.alias("_v"))
    counted = valued.groupBy(*by, "_v").agg(F.count("_v").alias("_n"))
    measure = _measure(F.col("_v"), counted.schema["_v"].dataType)
    if measure is None:
        totals = counted.groupBy(*by).agg(F.sum("_n").alias("_total"))
    else:
        low, high = (F.percentile_approx(measure, min(1.0, max(0.0, q)), ACCURACY) for q in (p - 2 / ACCURACY, p + 2 / ACCURACY))
        totals = valued.groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.count("_v").alias("_total"))
    if keys:
        totals = totals.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        near = counted.join(totals, reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]))
    else:
        near = counted.crossJoin(F.broadcast(totals))
    if measure is not None:
        # a group of nulls alone keeps its row
        near = near.where((measure <= F.col("_high")) | (F.col("_total") == 0)).withColumn("_v", F.when(measure >= F.col("_low"), F.col("_v")))
        near = near.groupBy(*by, "_v", "_total").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("_v").isNotNull() & (F.sum("_n").over(w) >= rank_of(p, F.col("_total")))
    return near.withColumn("_hit", hit).groupBy(*by).agg(F.min(F.when(F.col("_hit"), F.col("_v"))).alias(label))
