"""The request: what a caller may ask."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

# The vocabulary and the limits of a request.
Scalar = bool | int | Decimal | float | dt.datetime | dt.date | str
FilterOp = Literal["eq", "ne", "gt", "gte", "lt", "lte", "in", "like", "is_null"]


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class Filter(_Strict):
    """A condition on a root property, or through one link ('Link.property') on which roots take part."""

    property: str
    op: FilterOp
    value: Any = None

    @model_validator(mode="after")
    def _fits(self) -> Filter:
        if self.op == "in":
            if not isinstance(self.value, list):
                raise ValueError("a filter by 'in' wants the values as a list")
        elif self.op == "is_null":
            if self.value is not None:
                raise ValueError("a filter by 'is_null' stands without a value")
        elif isinstance(self.value, (list, dict)):
            raise ValueError(f"a filter by '{self.op}' compares with a single value")
        elif self.value is None and self.op not in ("eq", "ne"):
            raise ValueError(f"a filter by '{self.op}' compares with something; give a value")
        for v in self.value if isinstance(self.value, list) else [self.value]:
            if v is not None and not isinstance(v, Scalar):
                raise ValueError(f"{v!r} is not a scalar")
        return self


class Hop(_Strict):
    link: str
    max_depth: int | None = Field(default=None, ge=1, le=50)


class OrderBy(_Strict):
    key: str
    desc: bool = False


class QuerySpec(_Strict):
    """One question: a root object, a walk, group keys and metrics."""

    object: str
    filters: list[Filter] = []
    traverse: list[Hop] = []
    group_by: list[str] = []
    metrics: list[str] = []
    order_by: list[OrderBy] = []
    limit: int | None = Field(default=100, ge=1)

    @field_validator("traverse", mode="before")
    @classmethod
    def _bare_links(cls, hops: Any) -> Any:
        return [{"link": h} if isinstance(h, str) else h for h in hops] if isinstance(hops, list) else hops
