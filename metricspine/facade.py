"""The engine: load a pack over tables, then describe, explain and query."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .describe import describe
from .errors import SpineError, GuardTripped
from .model import Ontology
from .plans.build import build
from .plans.resolve import resolve
from .plans.verdict import ENGINES, Plan, analyse
from .sources.catalog import Catalog
from .sources.packs import catalog_for, load_pack, parse_pack
from .spec import QuerySpec


@dataclass(frozen=True)
class Guard:
    """Limits of an execution: rows that may be fetched, and milliseconds that it may take."""

    max_rows: int = 10_000
    timeout_ms: int = 10_000


@dataclass
class Result:
    rows: list[tuple]
    columns: list[str]
    additive: bool
    non_additive_reason: str | None
    rewrites: list[dict]
    limit_reached: bool
    elements: list[str]
    engine: str
    plan: str
    df: DataFrame = field(repr=False, default=None)


class Spine:
    """A pack over a catalog. Everything but query() and a verified load is decided without touching data."""

    def __init__(self, ontology: Ontology, catalog: Catalog, engine: str = "preaggregate", guard: Guard | None = None):
        if engine not in ENGINES:
            raise SpineError(f"There is no engine called '{engine}'", sorted(ENGINES))
        self.ontology, self.catalog, self.engine, self.guard = ontology, catalog, engine, guard or Guard()

    @classmethod
    def load(cls, spark: SparkSession, pack: str | Path, folder: str | None = None, catalog: Catalog | None = None, engine: str = "preaggregate", guard: Guard | None = None, verify: bool = False) -> Spine:
        """From a pack that declares its tables below folder, or over the tables of a catalog."""
        if catalog is None:
            catalog = catalog_for(spark, folder or "", parse_pack(pack)[1])
        return cls(load_pack(pack, catalog, verify), catalog, engine, guard)

    def describe(self, object: str | None = None) -> dict[str, Any]:
        return describe(self.ontology, object)

    def plan(self, spec: QuerySpec | dict, engine: str | None = None) -> Plan:
        spec = spec if isinstance(spec, QuerySpec) else QuerySpec(**spec)
        return analyse(resolve(spec, self.ontology), self.ontology, self.catalog, engine or self.engine)

    def df(self, spec: QuerySpec | dict, engine: str | None = None) -> DataFrame:
        """The answer as a lazy DataFrame."""
        return build(self.plan(spec, engine), self.ontology, self.catalog)

    def explain(self, spec: QuerySpec | dict, engine: str | None = None) -> dict[str, Any]:
        """What query() would run, without running it."""
        plan = self.plan(spec, engine)
        df = build(plan, self.ontology, self.catalog)
        return {
            "plan": plan_text(df),
            "columns": df.columns,
            "rewrites": list(plan.rewrites),
            "strategies": {p.metric.name: p.strategy for p in plan.metrics},
            "additive": plan.additive,
            "non_additive_reason": "; ".join(plan.reasons) or None,
            "ontology_elements_used": elements(plan),
            "engine": ENGINES[engine or self.engine],
        }

    def query(self, spec: QuerySpec | dict, engine: str | None = None) -> Result:
        plan = self.plan(spec, engine)
        df = build(plan, self.ontology, self.catalog)
        rows = guarded(df, self.guard)
        limit = plan.resolved.limit
        return Result(rows, df.columns, plan.additive, "; ".join(plan.reasons) or None, list(plan.rewrites), limit is not None and len(rows) == limit, elements(plan), ENGINES[engine or self.engine], plan_text(df), df)


def elements(plan: Plan) -> list[str]:
    rq = plan.resolved
    return [rq.root.name, *(e.link.name for e in rq.path), *(m.name for m in rq.metrics)]


def plan_text(df: DataFrame) -> str:
    """The optimised plan with expression ids numbered by first use, so that equal requests read the same."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    seen: dict[str, str] = {}
    return re.sub(r"#\d+", lambda m: seen.setdefault(m.group(), f"#{len(seen)}"), text)


def guarded(df: DataFrame, guard: Guard) -> list[tuple]:
    """The rows of df, at most max_rows, within timeout_ms; else the jobs are cancelled and the guard trips."""
    context = df.sparkSession.sparkContext
    tag, late = f"metricspine-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(guard.timeout_ms / 1000, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        rows = df.limit(guard.max_rows + 1).collect()
    except Exception as e:
        if late.is_set():
            raise GuardTripped("timeout_ms", guard.timeout_ms) from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if len(rows) > guard.max_rows:
        raise GuardTripped("max_rows", guard.max_rows)
    return [tuple(r) for r in rows]
