"""Packs: YAML documents that declare tables, objects, links and metrics, checked against a catalog."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

import yaml
from pydantic import ValidationError
from pyspark.sql import types as T

from ..errors import OntologyError
from ..functions.expressions import BARE_COLUMN, columns_of, has_window, stray_word
from ..model import FANNING, REVERSE_FANNING, LinkType, Metric, ObjectType, Ontology
from .catalog import Catalog


class _PackLoader(yaml.SafeLoader):
    """YAML in which only true and false are booleans, so that on: stays a key."""


_PackLoader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_PackLoader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def parse_pack(source: str | Path) -> tuple[Ontology, dict[str, Any]]:
    """The ontology and the table declarations of a pack, given as a file or as YAML text."""
    text = Path(source).read_text() if isinstance(source, Path) or "\n" not in source else source
    try:
        raw = yaml.load(text, Loader=_PackLoader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise OntologyError(f"The pack is no YAML: {e}") from e
    if not isinstance(raw, dict):
        raise OntologyError("A pack is a mapping of objects, links and metrics")
    tables = raw.pop("tables", None) or {}
    for part in ("objects", "links", "metrics"):
        entries = raw.get(part) or {}
        if not isinstance(entries, dict) or not all(isinstance(x, dict) for x in entries.values()):
            raise OntologyError(f"Each entry of {part} is a mapping")
        raw[part] = entries
    try:
        return Ontology(**raw), tables
    except ValidationError as e:
        where = "; ".join(f"{'.'.join(map(str, x['loc']))}: {x['msg']}" for x in e.errors())
        raise OntologyError(f"The pack doesn't hold together: {where}") from e


def catalog_for(spark, folder: str, tables: dict[str, Any]) -> Catalog:
    """The tables that a pack declares, read lazily from folder."""
    catalog = Catalog(spark)
    for name, t in tables.items():
        catalog.read(folder, name, t.get("source"), t.get("format", "parquet"), t.get("keys"), t.get("not_null"), t.get("casts"), t.get("select"))
    return catalog


def load_pack(source: str | Path, catalog: Catalog, verify: bool = False) -> Ontology:
    """A pack's ontology after all its rules are checked; with verify, declared keys, not-null columns and link cardinalities are checked against the data too."""
    ontology, _ = parse_pack(source)
    check(ontology, catalog)
    if verify:
        verify_data(ontology, catalog)
    return ontology


def check(o: Ontology, catalog: Catalog) -> None:
    for obj in o.objects.values():
        _check_object(o, obj, catalog)
    for link in o.links.values():
        _check_link(o, link, catalog)
    for metric in o.metrics.values():
        _check_metric(o, metric, catalog)


def _table(catalog: Catalog, name: str, who: str) -> None:
    if name not in catalog:
        raise OntologyError(f"{who} names table '{name}', which doesn't exist", sorted(catalog.tables))


def _column(catalog: Catalog, table: str, column: str, who: str) -> None:
    _table(catalog, table, who)
    if catalog[table].column(column) is None:
        raise OntologyError(f"{who} names column '{table}.{column}', which doesn't exist", [n for n, _ in catalog[table].types.values()])


def _check_object(o: Ontology, obj: ObjectType, catalog: Catalog) -> None:
    who = f"object {obj.name}"
    _table(catalog, obj.primary, who)
    for name, join in obj.joins.items():
        for pair in join.on:
            for ref in (pair.source, pair.target):
                _column(catalog, ref.table, ref.column, f"{who}, join {name}")
        if join.cardinality in FANNING:
            raise OntologyError(f"{who}: join {name} may meet several rows of {join.to}, which would repeat the object's own", [f"declare a link to an object over {join.to}"])
        if not catalog[join.to].is_key([p.target.column for p in join.on]):
            raise OntologyError(f"{who}: join {name} does not join {join.to} on exactly one of its keys", [str(k) for k in catalog[join.to].keys])
    for name, p in obj.properties.items():
        at = f"{who}, property {name}"
        _column(catalog, p.column.table, p.column.column, at)
        if name in o.metrics:
            raise OntologyError(f"{at} has the name of a metric")
        if p.via is not None and p.via not in obj.joins:
            raise OntologyError(f"{at} comes via '{p.via}', which is no join of the object", sorted(obj.joins))
        if p.via is None and p.column.table != obj.primary or p.via is not None and p.column.table != obj.joins[p.via].to:
            raise OntologyError(f"{at} is a column of '{p.column.table}', which it doesn't say how to reach", sorted(obj.joins))
        if p.unique and (p.via is not None or not catalog[obj.primary].is_key([p.column.column])):
            raise OntologyError(f"{at} is declared unique, but is no key of {obj.primary} by itself")
        if not p.nullable and p.via is not None and obj.joins[p.via].kind == "left":
            raise OntologyError(f"{at} comes over a left join, so it may be null", ["nullable: true"])
        if not p.nullable and p.column.column.lower() not in catalog[p.column.table].not_null:
            raise OntologyError(f"{at} is declared not null, which its table doesn't say of the column", ["nullable: true", "list the column under not_null"])
        if p.time_unit:
            if not isinstance(catalog[p.column.table].type(p.column.column), (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise OntologyError(f"{at} has a time_unit, but its column is no date or timestamp")
            if p.nullable or p.via is not None and obj.joins[p.via].kind == "left":
                raise OntologyError(f"{at} has a time_unit, but may be null")


def _check_link(o: Ontology, link: LinkType, catalog: Catalog) -> None:
    who = f"link {link.name}"
    for end in (link.source, link.target):
        if end not in o.objects:
            raise OntologyError(f"{who} names object '{end}', which isn't declared", sorted(o.objects))
    if link.via is not None:
        _table(catalog, link.via, who)
    for pair in (*link.on, *link.on_from, *link.on_to):
        for ref in (pair.source, pair.target):
            _column(catalog, ref.table, ref.column, who)
    if link.inverse_of is not None and link.inverse_of not in o.links:
        raise OntologyError(f"{who} is the inverse of '{link.inverse_of}', which isn't declared", sorted(o.links))
    if link.kind == "recursive":
        if link.source != link.target:
            raise OntologyError(f"{who} is recursive, but leads to another object")
        if len(link.on) != 1:
            raise OntologyError(f"{who} is recursive on {len(link.on)} columns; a walk follows one")


def effective_quantity(o: Ontology, metric: Metric) -> str | None:
    """The metric's own quantity, else that of the bare column it sums."""
    if metric.quantity or metric.agg != "sum":
        return metric.quantity
    found = BARE_COLUMN.fullmatch(metric.value)
    if not found:
        return None
    table, column = found.groups()
    for obj in o.objects.values():
        for p in obj.properties.values():
            if p.column.table.lower() == table.lower() and p.column.column.lower() == column.lower() and p.quantity:
                return p.quantity
    return None


def time_property(o: Ontology, metric: Metric):
    obj = o.object_for_table(metric.measured_on)
    return obj.properties.get(metric.over_time.dimension) if obj and metric.over_time else None


def _check_metric(o: Ontology, m: Metric, catalog: Catalog) -> None:
    who = f"metric {m.name}"
    _table(catalog, m.measured_on, who)
    for table, column in columns_of(m.body):
        if table.lower() != m.measured_on.lower():
            raise OntologyError(f"{who} is measured on '{m.measured_on}' but uses {table}.{column}", [f"use columns of {m.measured_on}"])
        _column(catalog, m.measured_on, column, who)
    word = stray_word(m.body)
    if word is not None:
        raise OntologyError(f"{who} holds '{word}', which is no qualified column, function or SQL word", [f"{m.measured_on}.{word}"])
    if m.expr is not None and has_window(m.expr):
        raise OntologyError(f"{who} has a window over rows that are not aggregated yet", ["aggregate inside the window, as in sum(sum(x)) over ()"])
    quantity = effective_quantity(o, m)
    if m.agg == "sum" and BARE_COLUMN.fullmatch(m.value):
        if quantity is None:
            raise OntologyError(f"{who} sums a column whose quantity is not declared", ["quantity: flow on the property", "quantity on the metric"])
        if quantity == "value_per_unit":
            raise OntologyError(f"{who} sums a value per unit, which accumulates to nothing", ["agg: avg", "multiply by a flow"])
    if (quantity == "stock") != (m.over_time is not None):
        raise OntologyError(f"{who}: " + ("a stock says over which time it is taken" if quantity == "stock" else "over_time belongs to a stock"), ["over_time: {dimension: ..., choice: last}", "quantity: stock"])
    if m.over_time is not None:
        p = time_property(o, m)
        if p is None or not p.time_unit:
            obj = o.object_for_table(m.measured_on)
            raise OntologyError(f"{who} is taken over '{m.over_time.dimension}', which is no property with a time_unit of the object over {m.measured_on}", [n for n, x in (obj.properties if obj else {}).items() if x.time_unit])
        if m.agg is None:
            raise OntologyError(f"{who} is a stock given by expr, which cannot be taken at one instant", ["agg and value"])


def verify_data(o: Ontology, catalog: Catalog) -> None:
    """Declared keys, not-null columns and cardinalities, each by one aggregation over its table."""
    for t in catalog.tables.values():
        for key in t.keys:
            if catalog.repeats(t.name, list(key)):
                raise OntologyError(f"Table {t.name} repeats its key ({', '.join(key)})")
        hit = catalog.nulls(t.name, [t.column(c) for c in sorted(t.not_null) if t.column(c)])
        if hit:
            raise OntologyError(f"Table {t.name} has nulls in {', '.join(hit)}, declared not null")
    for link in o.links.values():
        if link.kind == "through":
            # a source row meets several targets if the junction repeats the columns that lead to it, and the other way round
            for allowed, pairs, meets in ((FANNING, link.on_from, link.source), (REVERSE_FANNING, link.on_to, link.target)):
                own = [ref.column for p in pairs for ref in (p.source, p.target) if ref.table == link.via]
                if link.cardinality not in allowed and not catalog[link.via].is_key(own) and catalog.repeats(link.via, own):
                    raise OntologyError(f"Link {link.name} is {link.cardinality}, but {link.via} has several rows for one {meets}", ["many_to_many"])
        sides = [(link.on, "target", "source")] if link.on else []
        for pairs, target, source in sides:
            to, frm = [[getattr(p, side) for p in pairs] for side in (target, source)]
            if link.cardinality not in FANNING and not catalog[to[0].table].is_key([c.column for c in to]) and catalog.repeats(to[0].table, [c.column for c in to]):
                raise OntologyError(f"Link {link.name} is {link.cardinality}, but {to[0].table} repeats {', '.join(c.column for c in to)}", ["a fanning cardinality"])
            if link.cardinality not in REVERSE_FANNING and not catalog[frm[0].table].is_key([c.column for c in frm]) and catalog.repeats(frm[0].table, [c.column for c in frm]):
                raise OntologyError(f"Link {link.name} is {link.cardinality}, but {frm[0].table} repeats {', '.join(c.column for c in frm)}", ["many_to_one or many_to_many"])
