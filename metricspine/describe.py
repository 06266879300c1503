"""What a pack offers, and the rules a caller should know before asking."""

from __future__ import annotations

from typing import Any

from .errors import UnknownName
from .model import FANNING, Ontology
from .plans.resolve import near

RULES = {
    "one_count": "A metric counts each row of the table it is measured on once in each group. A walk that would repeat rows is rewritten and the rewrite reported, or refused with a move that works.",
    "non_additivity": "Groups that are reached across a many_to_many link share rows: each is right, but they don't add up to the total. Such a query needs a group key marked unique.",
    "dotted_filter": "A filter 'Link.property' chooses which root objects take part (those with at least one such row); all their rows are then measured. To restrict the measured rows, make that object the root.",
    "qualified_key": "A group key 'Link.property' is read off the object that the hop lands on; the query must walk that link exactly once. A bare key is a property of the root.",
    "recursive_link": "A recursive link pairs a row with every row above it, up to max_depth; with max_depth 1, with the one above it. A row with nothing above it drops out. A dotted filter takes one step.",
    "stock": "A level is taken at one instant, the first or last of each group, and never summed over time. It is asked for by itself. Grouped levels don't add up, for each group has its own instant.",
    "matching_table": "Choose the metric by what is measured, not by what it is grouped by: average order value is measured on orders, wherever the groups come from.",
}


def _context(x) -> dict[str, Any]:
    return {k: v for k, v in (x.model_dump() if x else {}).items() if v}


def describe(o: Ontology, object: str | None = None) -> dict[str, Any]:
    """The whole pack, or one object with those a single hop away."""
    if object is not None and object not in o.objects:
        raise UnknownName("object", object, near(object, o.objects))
    shown = set(o.objects) if object is None else {object} | {x.target for x in o.links_from(object)}
    objects = {
        n: {
            "description": x.description,
            "properties": {k: {a: v for a, v in (("type", p.type), ("nullable", p.nullable), ("unique", p.unique), ("time_unit", p.time_unit), ("description", p.description)) if v} for k, p in x.properties.items()},
            "links": [y.name for y in o.links_from(n)],
            **_context(x.ai_context),
        }
        for n, x in o.objects.items()
        if n in shown
    }
    links = {
        n: {"from": x.source, "to": x.target, "cardinality": x.cardinality, "fans_out": x.effective_cardinality in FANNING, "kind": x.kind, "description": x.description, **({"max_depth": x.max_depth} if x.kind == "recursive" else {}), **_context(x.ai_context)}
        for n, x in o.links.items()
        if object is None and x.source in shown or x.source == object
    }
    tables = {t for n in shown for t in o.objects[n].tables} | {o.links[n].via for n in links if o.links[n].via}
    metrics = {}
    for n, m in o.metrics.items():
        if m.measured_on in tables:
            owner = o.object_for_table(m.measured_on)
            metrics[n] = {"measured_on": m.measured_on, "measures": owner.name if owner else None, "aggregate": m.agg or "expression", "description": m.description, **_context(m.ai_context)}
    return {"name": o.name, "description": o.description, "objects": objects, "links": links, "metrics": metrics, "rules": RULES}
