"""Aggregation of metrics over a frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bound, columns_of
from ..functions.ordered import discrete_percentile
from ..model import Metric
from ..plans.resolve import Resolved
from ..plans.verdict import MetricPlan
from ..sources.catalog import Catalog
from .frames import name


def quoted(label: str) -> Column:
    return F.col(f"`{label}`")


def place(rq: Resolved, p: MetricPlan) -> int | str:
    """Where the metric's table stands: an object's position, or the junction of its hop."""
    obj = rq.object_at(p.position)
    return p.position if p.metric.measured_on in obj.tables else f"{p.position}j"


def _bind(rq: Resolved, p: MetricPlan, catalog: Catalog):
    at = place(rq, p)
    return lambda table, column: f"`{name(at, p.metric.measured_on, catalog[p.metric.measured_on].column(column))}`"


def value(rq: Resolved, p: MetricPlan, catalog: Catalog) -> Column:
    return F.expr(bound(p.metric.value, _bind(rq, p, catalog)))


def aggregated(m: Metric, v: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "min": F.min, "max": F.max, "avg": F.avg}[m.agg](v)


def keyed(df: DataFrame, rq: Resolved) -> DataFrame:
    """df with the group keys under their labels."""
    return df.withColumns({k.label: F.col(name(k.position, k.prop.column.table, k.prop.column.column)) for k in rq.keys}) if rq.keys else df


def labels(rq: Resolved) -> list[str]:
    return [k.label for k in rq.keys]


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Two frames with one row for each group, joined null-safely; without keys each is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, same, how).drop(*[f"_r{i}" for i in range(len(keys))])


def grouped(df: DataFrame, rq: Resolved, plans: list[MetricPlan], catalog: Catalog, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group with the metrics, which share df as their rows; one aggregation for all but order statistics. more: further keys."""
    keys = [*labels(rq), *more]
    plain = [p for p in plans if p.metric.rank is None]
    out = None
    if plain or not plans:
        columns = [(aggregated(p.metric, value(rq, p, catalog)) if p.metric.agg else F.expr(bound(p.metric.expr, _bind(rq, p, catalog)))).alias(p.metric.name) for p in plain]
        out = df.groupBy(*map(quoted, keys)).agg(*columns) if columns else df.select(*map(quoted, keys)).distinct()
    for p in plans:
        if p.metric.rank is not None:
            ranked = discrete_percentile(df, keys, value(rq, p, catalog), p.metric.rank, p.metric.name)
            out = ranked if out is None else match(out, ranked, keys, "left")
    return out


def told_apart(df: DataFrame, rq: Resolved, plans: list[MetricPlan], catalog: Catalog, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each row of the metric's table once in each group: grouped by the keys and the table's own key."""
    p = plans[0]
    at, table = place(rq, p), catalog[p.metric.measured_on]
    own = [name(at, table.name, table.column(c)) for c in table.keys[0]]
    used = {name(at, table.name, table.column(c)) for q in plans for _, c in columns_of(q.metric.body)} | set(extra)
    columns = [F.any_value(F.col(c)).alias(c) for c in sorted(used - set(own))]
    grouping = [*map(quoted, labels(rq)), *[F.col(c) for c in own]]
    rows = df.where(F.col(own[0]).isNotNull()).groupBy(*grouping)
    return rows.agg(*columns) if columns else df.where(F.col(own[0]).isNotNull()).select(*grouping).distinct()


def at_one_instant(df: DataFrame, rq: Resolved, p: MetricPlan, catalog: Catalog, time: str) -> DataFrame:
    """The metric over the rows of each group at the group's last or first instant, all ties kept.

    Every instant of a group is aggregated, with partial results before the
    shuffle, and the group keeps the one that counts; no row is moved by itself.
    """
    pick = F.max_by if p.metric.over_time.choice == "last" else F.min_by
    each = grouped(df.withColumn("_instant", F.col(time)), rq, [p], catalog, ("_instant",))
    taken = pick(quoted(p.metric.name), F.col("_instant"))
    if p.metric.agg in ("count", "count_distinct"):
        taken = F.coalesce(taken, F.lit(0))
    return each.groupBy(*map(quoted, labels(rq))).agg(taken.alias(p.metric.name))
