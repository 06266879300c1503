"""The declared domain: objects over tables, links between them, metrics on them."""

from __future__ import annotations

from typing import Literal

from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

# The vocabulary of a pack.
ValueType = Literal["string", "integer", "decimal", "boolean", "date", "datetime"]
Cardinality = Literal["one_to_one", "many_to_one", "one_to_many", "many_to_many"]
Quantity = Literal["flow", "stock", "value_per_unit"]
TimeUnit = Literal["day", "week", "month", "quarter", "year"]
Aggregate = Literal["sum", "count", "count_distinct", "min", "max", "avg", "median", "percentile"]

# Which cardinalities repeat rows, and which aggregates don't mind.
#: One source row may meet several target rows.
FANNING = frozenset({"one_to_many", "many_to_many"})
#: One target row may meet several source rows.
REVERSE_FANNING = frozenset({"many_to_one", "many_to_many"})
#: Aggregates that repeated rows do not change.
IMMUNE = frozenset({"min", "max", "count_distinct"})


class ColumnRef(BaseModel):
    model_config = ConfigDict(frozen=True)
    table: str
    column: str

    @model_validator(mode="before")
    @classmethod
    def _dotted(cls, raw):
        if isinstance(raw, str):
            table, dot, column = raw.partition(".")
            if not (table and dot and column) or "." in column:
                raise ValueError(f"'{raw}' is not table.column")
            return {"table": table, "column": column}
        return raw

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


class JoinPair(BaseModel):
    model_config = ConfigDict(populate_by_name=True, frozen=True)
    source: ColumnRef = Field(alias="from")
    target: ColumnRef = Field(alias="to")


class AiContext(BaseModel):
    synonyms: list[str] = []
    instructions: str | None = None


class Property(BaseModel):
    model_config = ConfigDict(extra="forbid")
    column: ColumnRef
    type: ValueType
    nullable: bool = False
    unique: bool = False
    quantity: Quantity | None = None
    time_unit: TimeUnit | None = None
    via: str | None = None
    description: str | None = None

    @model_validator(mode="after")
    def _time(self) -> Property:
        if self.time_unit and self.type not in ("date", "datetime"):
            raise ValueError("time_unit needs a date or datetime property")
        return self


class TableJoin(BaseModel):
    """A further table that an object spans, at most one row of it for each of its own."""

    to: str
    kind: Literal["left", "inner"] = "left"
    cardinality: Cardinality
    on: list[JoinPair] = Field(min_length=1)


class ObjectType(BaseModel):
    name: str = ""
    primary: str
    description: str | None = None
    title_property: str | None = None
    joins: dict[str, TableJoin] = {}
    properties: dict[str, Property] = {}
    ai_context: AiContext | None = None

    @property
    def tables(self) -> list[str]:
        return [self.primary, *(j.to for j in self.joins.values())]


class LinkType(BaseModel):
    model_config = ConfigDict(populate_by_name=True)
    name: str = ""
    source: str = Field(alias="from")
    target: str = Field(alias="to")
    kind: Literal["direct", "through", "recursive"] = "direct"
    cardinality: Cardinality
    description: str | None = None
    on: list[JoinPair] = []
    via: str | None = None
    on_from: list[JoinPair] = []
    on_to: list[JoinPair] = []
    max_depth: int = Field(default=10, ge=1, le=50)
    inverse_of: str | None = None
    ai_context: AiContext | None = None

    @model_validator(mode="after")
    def _shape(self) -> LinkType:
        if self.kind == "through":
            if not (self.via and self.on_from and self.on_to):
                raise ValueError("a through link needs via, on_from and on_to")
        elif not self.on:
            raise ValueError(f"a {self.kind} link needs on")
        return self

    @property
    def effective_cardinality(self) -> str:
        """A recursive walk of more than one step pairs a row with many ancestors, and an ancestor with many rows."""
        return "many_to_many" if self.kind == "recursive" and self.max_depth > 1 else self.cardinality


class OverTime(BaseModel):
    model_config = ConfigDict(extra="forbid")
    dimension: str
    choice: Literal["first", "last"] = "last"


class Metric(BaseModel):
    model_config = ConfigDict(extra="forbid")
    name: str = ""
    measured_on: str
    description: str | None = None
    expr: str | None = None
    agg: Aggregate | None = None
    value: str | None = None
    percentile: float | None = None
    quantity: Quantity | None = None
    over_time: OverTime | None = None
    type: ValueType | None = None
    ai_context: AiContext | None = None

    @field_validator("value", mode="before")
    @classmethod
    def _text(cls, raw):
        return str(raw) if raw is not None else None

    @model_validator(mode="after")
    def _form(self) -> Metric:
        if (self.expr is None) == (self.agg is None) or (self.agg is None) != (self.value is None):
            raise ValueError("a metric has either expr, or agg and value")
        if self.agg == "percentile":
            if self.percentile is None or not 0 <= self.percentile <= 1:
                raise ValueError("a percentile metric needs percentile between 0 and 1")
        elif self.percentile is not None:
            raise ValueError("percentile belongs to agg: percentile")
        if self.quantity == "stock" and self.over_time is None:
            raise ValueError("a stock metric needs over_time")
        if self.over_time and self.quantity not in (None, "stock"):
            raise ValueError("over_time belongs to a stock")
        return self

    @property
    def body(self) -> str:
        """The text whose columns must all be of the metric's own table."""
        return self.expr if self.expr is not None else self.value

    @property
    def immune(self) -> bool:
        return self.agg in IMMUNE

    @property
    def rank(self) -> float | None:
        """The p of an order statistic."""
        return 0.5 if self.agg == "median" else self.percentile if self.agg == "percentile" else None


class Ontology(BaseModel):
    name: str = "domain"
    description: str | None = None
    objects: dict[str, ObjectType] = {}
    links: dict[str, LinkType] = {}
    metrics: dict[str, Metric] = {}

    @model_validator(mode="after")
    def _names(self) -> Ontology:
        for entries in (self.objects, self.links, self.metrics):
            for key, entry in entries.items():
                entry.name = entry.name or key
        return self

    def links_from(self, name: str) -> list[LinkType]:
        return [x for x in self.links.values() if x.source == name]

    def object_for_table(self, table: str) -> ObjectType | None:
        return next((o for o in self.objects.values() if o.primary == table), None)
