"""From a plan to a lazy DataFrame; all that Spark can optimise is left to it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import Ontology
from ..operators.aggregate import at_one_instant, grouped, keyed, labels, match, place, quoted, told_apart
from ..operators.frames import deep, each_once, extended, name, root_frame, surviving
from ..sources.catalog import Catalog
from .verdict import IDENTITY, INLINE, PREAGGREGATE, MetricPlan, Plan


def build(plan: Plan, o: Ontology, catalog: Catalog) -> DataFrame:
    """Columns in the order of the request: keys, then metrics.

    Metrics that read the same rows share one aggregation. A pre-aggregated
    metric's rows are those that the whole walk keeps, so its groups are the
    groups of the whole walk: where all metrics are pre-aggregated, the
    fanned-out walk is never built.
    """
    rq = plan.resolved
    used = rq.tables()
    root = root_frame(catalog, rq.root, rq.conditions, used)
    whole = keyed(extended(catalog, root, rq.path, 0, len(rq.path), used), rq)
    frames: list[DataFrame] = []

    def survivors(df: DataFrame, position: int) -> DataFrame:
        return keyed(surviving(catalog, df, rq.path, position, used), rq)

    def rows_apart(group: list[MetricPlan], extra: tuple[str, ...] = ()) -> DataFrame:
        """Each row of the group's table once in each group, by joins alone where that is possible."""
        p = group[0]
        plain = p.metric.measured_on == rq.object_at(p.position).primary and all(k.position <= p.position for k in rq.keys)
        if plain and not any(map(deep, rq.path[: p.position])):
            return survivors(each_once(catalog, root, rq, p.position), p.position)
        return told_apart(whole, rq, group, catalog, extra)

    inline = [p for p in plan.metrics if p.strategy == INLINE and not p.stock]
    before = [p for p in plan.metrics if p.strategy == PREAGGREGATE]
    apart = [p for p in plan.metrics if p.strategy == IDENTITY and not p.stock]
    if inline or not plan.metrics:
        frames.append(grouped(whole, rq, inline, catalog))
    for position in dict.fromkeys(p.position for p in before):
        rows = survivors(extended(catalog, root, rq.path, 0, position, used), position)
        frames.append(grouped(rows, rq, [p for p in before if p.position == position], catalog))
    for where in dict.fromkeys((place(rq, p), p.metric.measured_on) for p in apart):
        group = [p for p in apart if (place(rq, p), p.metric.measured_on) == where]
        frames.append(grouped(rows_apart(group), rq, group, catalog))
    for p in (p for p in plan.metrics if p.stock):
        over = o.object_for_table(p.metric.measured_on).properties[p.metric.over_time.dimension]
        time = name(place(rq, p), p.metric.measured_on, over.column.column)
        frames.append(at_one_instant(rows_apart([p], (time,)) if p.strategy == IDENTITY else whole, rq, p, catalog, time))

    keys = labels(rq)
    spanned = any(p.metric.measured_on != rq.object_at(p.position).primary for p in apart)
    if keys and spanned and not inline and not before:
        # a left-joined table may have no row for a group
        frames.insert(0, whole.select(*map(quoted, keys)).distinct())
    out = frames[0]
    for frame in frames[1:]:
        out = match(out, frame, keys, "left")
    out = out.select(*[quoted(x) for x in keys + [m.name for m in rq.metrics]])
    if rq.order:
        # as the backends of such layers do: nulls last going up, first going down
        out = out.orderBy(*[quoted(x.key).desc_nulls_first() if x.desc else quoted(x.key).asc_nulls_last() for x in rq.order])
    return out if rq.limit is None else out.limit(rq.limit)

