"""How each metric may be computed on a walk, and whether its column adds up.

A step of the walk fans if a source row may meet several target rows, and fans
in reverse if a target row may meet several source rows. A metric's rows are
those of the table it is measured on, at the first position that has it. Before that
position a reverse fan repeats them, after it a fan does. A unique group key at
the right end of such a step holds it to one row in each group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import FanOutRefused, KeyBeyondMetric, NonAdditiveRefused, NoRowKey, SpineError, StockRefused
from ..model import FANNING, REVERSE_FANNING, Metric, Ontology
from ..sources.catalog import Catalog
from .resolve import Edge, Resolved

INLINE = "inline"
PREAGGREGATE = "aggregate_then_join"
IDENTITY = "identity"
#: What the engines are called; the other names are accepted for the same.
ENGINES = {"preaggregate": "preaggregate", "subquery": "preaggregate", "identity": "identity", "symmetric": "identity"}


@dataclass(frozen=True)
class MetricPlan:
    metric: Metric
    strategy: str
    position: int
    #: The link whose fan made inline impossible.
    forced_by: str | None = None
    stock: bool = False
    overlap: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    resolved: Resolved
    metrics: tuple[MetricPlan, ...]
    additive: bool
    reasons: tuple[str, ...] = ()
    rewrites: tuple[dict, ...] = field(default=())


def home_position(rq: Resolved, table: str) -> int | None:
    """The first position whose object has the table, or whose hop passes through it."""
    if table in rq.root.tables:
        return 0
    for i, edge in enumerate(rq.path, 1):
        if table in edge.target.tables or edge.link.via == table:
            return i
    return None


def _ways_to(o: Ontology, rq: Resolved, table: str) -> list[str]:
    """Hops that would bring a table onto the walk, found breadth first from where it ends."""
    here = rq.object_at(len(rq.path)).name
    queue, seen = [(here, [])], {here}
    while queue:
        name, hops = queue.pop(0)
        for link in o.links_from(name):
            if table in o.objects[link.target].tables or link.via == table:
                return [f"add the hop{'s' if hops else ''} {', '.join([*hops, link.name])}"]
            if link.target not in seen:
                seen.add(link.target)
                queue.append((link.target, [*hops, link.name]))
    owner = o.object_for_table(table)
    return [f"make {owner.name} the root"] if owner else []


def _unique_keys(rq: Resolved) -> set[int]:
    """Positions that a unique group key holds to one row."""
    return {k.position for k in rq.keys if k.prop.unique}


def analyse(rq: Resolved, o: Ontology, catalog: Catalog, engine: str = "preaggregate") -> Plan:
    """A strategy for each metric, or a refusal. engine: preaggregate refuses what has no plain reading; identity tells rows apart by their keys and answers that too."""
    if engine not in ENGINES:
        raise SpineError(f"There is no engine called '{engine}'", sorted(ENGINES))
    strict = ENGINES[engine] == "preaggregate"
    pinned = _unique_keys(rq)
    plans = [_metric_plan(rq, o, catalog, m, pinned, strict) for m in rq.metrics]
    _check_stocks(plans)
    if strict and not rq.keys and plans and all(p.strategy == PREAGGREGATE for p in plans):
        p = plans[0]
        raise FanOutRefused(p.metric.name, p.metric.measured_on, p.forced_by, [f"drop the hop {p.forced_by}", f"group by a property of {rq.root.name}", "use engine 'identity'"])
    reasons = [r for p in plans for r in _additivity(rq, p, pinned)]
    rewrites = tuple(
        {"metric": p.metric.name, "strategy": p.strategy, "forced_by": p.forced_by, "reason": f"'{p.forced_by}' is {_effective(rq, p.forced_by)} and would repeat rows of {p.metric.measured_on}"}
        for p in plans
        if p.strategy != INLINE
    )
    return Plan(rq, tuple(plans), not reasons, tuple(dict.fromkeys(reasons)), rewrites)


def _effective(rq: Resolved, link: str) -> str:
    return next((e.link.effective_cardinality for e in rq.path if e.link.name == link), "a spanned table")


def _pairs_repeat(edge: Edge, catalog: Catalog) -> bool:
    """Whether a junction may hold a pair of rows twice: no declared key of it lies within the link's columns."""
    link = edge.link
    if link.kind != "through":
        return False
    own = {ref.column.lower() for p in (*link.on_from, *link.on_to) for ref in (p.source, p.target) if ref.table == link.via}
    return not any({c.lower() for c in key} <= own for key in catalog[link.via].keys)


def _repeating(rq: Resolved, catalog: Catalog, metric: Metric, at: int, pinned: set[int]) -> tuple[list[str], list[str]]:
    """Links that may repeat the metric's rows within a group: before its position, and after it."""
    before = []
    for i, edge in enumerate(rq.path[:at]):
        through_junction = edge.link.via == metric.measured_on and i == at - 1 and metric.measured_on not in edge.target.tables
        if edge.link.effective_cardinality in REVERSE_FANNING and not through_junction and (i not in pinned or _pairs_repeat(edge, catalog)):
            before.append(edge.link.name)
    obj = rq.object_at(at)
    if metric.measured_on in obj.tables and metric.measured_on != obj.primary:
        join = next(j for j in obj.joins.values() if j.to == metric.measured_on)
        if join.cardinality in REVERSE_FANNING and at not in pinned:
            before.append(f"{obj.name}.{metric.measured_on}")
    after = [e.link.name for j, e in enumerate(rq.path[at:], at + 1) if e.link.effective_cardinality in FANNING and (j not in pinned or _pairs_repeat(e, catalog))]
    return before, after


def _metric_plan(rq: Resolved, o: Ontology, catalog: Catalog, m: Metric, pinned: set[int], strict: bool) -> MetricPlan:
    at = home_position(rq, m.measured_on)
    if at is None:
        raise FanOutRefused(m.name, m.measured_on, None, _ways_to(o, rq, m.measured_on))
    before, after = _repeating(rq, catalog, m, at, pinned)
    stock = m.over_time is not None
    beyond = next((k for k in rq.keys if k.position > at and any(e.link.effective_cardinality in FANNING for e in rq.path[at : k.position])), None)
    if strict:
        many = next((e.link.name for e in rq.path[:at] if e.link.effective_cardinality == "many_to_many"), None)
        if many is not None and not pinned:
            repairs = [k for pos in range(at + 1) for k in _unique_properties(rq, pos)]
            raise NonAdditiveRefused(
                f"Metric '{m.name}' lies across '{many}', which is many_to_many: one row of {m.measured_on} belongs to several groups, and no group key tells them apart",
                [f"group by {k}" for k in repairs] + ["use engine 'identity'"],
            )
        if after and beyond is not None:
            raise KeyBeyondMetric(
                f"Key '{beyond.label}' lies beyond {m.measured_on}, which '{m.name}' is measured on, across '{after[0]}', which fans out",
                [f"drop the key '{beyond.label}'", f"drop the hop {after[0]}", "use engine 'identity'"],
            )
        if stock and after:
            raise StockRefused(f"Level '{m.name}' is taken at one instant, and '{after[0]}' repeats its rows", [f"drop the hop {after[0]}", f"group by a unique property after {after[0]}" if _unique_properties(rq, len(rq.path)) else "ask for the level by itself", "use engine 'identity'"])
    if m.immune and not stock or not before and not after:
        return MetricPlan(m, INLINE, at, stock=stock, overlap=tuple(before))
    reaches = all(k.position <= at for k in rq.keys)
    if not before and reaches and not stock:
        return MetricPlan(m, PREAGGREGATE, at, forced_by=after[0])
    if not catalog[m.measured_on].keys:
        raise NoRowKey(f"Rows of '{m.measured_on}' must be told apart for metric '{m.name}', and the table declares no key", [f"declare a key of {m.measured_on}"])
    return MetricPlan(m, IDENTITY, at, forced_by=(before + after)[0], stock=stock, overlap=tuple(before))


def _unique_properties(rq: Resolved, position: int) -> list[str]:
    prefix = f"{rq.path[position - 1].link.name}." if position else ""
    return [prefix + n for n, p in rq.object_at(position).properties.items() if p.unique]


def _check_stocks(plans: list[MetricPlan]) -> None:
    stocks = [p.metric.name for p in plans if p.stock]
    if len(stocks) > 1:
        raise StockRefused(f"Levels {', '.join(stocks)} each have an instant of their own", [f"ask for {s} by itself" for s in stocks])
    if stocks and len(plans) > 1:
        raise StockRefused(f"Level '{stocks[0]}' is taken at one instant, the other metrics over all rows", [f"ask for {stocks[0]} by itself", "ask for the others in a second query"])


def _additivity(rq: Resolved, p: MetricPlan, pinned: set[int]) -> list[str]:
    """Why the groups of a metric don't add up to its total."""
    if not rq.keys:
        return []
    m, why = p.metric, []
    overlap = [e.link.name for e in rq.path[: p.position] if e.link.effective_cardinality in REVERSE_FANNING]
    overlap += [x for x in p.overlap if "." in x]
    if overlap:
        why.append(f"{m.name}: a row of {m.measured_on} may belong to several groups, across {overlap[0]}")
    beyond = next((e.link.name for k in rq.keys for e in rq.path[p.position : k.position] if e.link.effective_cardinality in FANNING), None)
    if beyond:
        why.append(f"{m.name}: a row of {m.measured_on} is counted in each of the groups that {beyond} leads it to")
    if p.stock:
        why.append(f"{m.name}: each group is taken at its own instant")
    elif m.agg in ("avg", "median", "percentile", "min", "max"):
        why.append(f"{m.name}: {m.agg} of groups is not {m.agg} of all rows when added")
    return why
