"""Physical tables: DataFrames with the keys and nullability that Parquet cannot carry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class PhysicalTable:
    name: str
    df: DataFrame
    keys: list[tuple[str, ...]] = field(default_factory=list)
    not_null: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.types = {f.name.lower(): (f.name, f.dataType) for f in self.df.schema.fields}
        self.not_null = {c.lower() for c in self.not_null} | {c.lower() for k in self.keys for c in k}
        # as with a primary key, the columns of a declared key are not null
        if "*" in self.not_null:
            self.not_null = set(self.types)

    def column(self, name: str) -> str | None:
        """The column's own spelling; names fold case as Spark does."""
        found = self.types.get(name.lower())
        return found[0] if found else None

    def type(self, name: str) -> T.DataType:
        return self.types[name.lower()][1]

    def is_key(self, columns: list[str]) -> bool:
        """Whether exactly these columns are declared to tell rows apart."""
        return {c.lower() for c in columns} in [{c.lower() for c in k} for k in self.keys]


class Catalog:
    """The tables a pack may name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, PhysicalTable] = {}

    def add(self, name: str, df: DataFrame, keys: list[tuple[str, ...]] | None = None, not_null: set[str] | None = None) -> Catalog:
        self.tables[name] = PhysicalTable(name, df, [tuple(k) for k in keys or []], set(not_null or ()))
        return self

    def read(self, folder: str, name: str, source: str | None = None, format: str = "parquet", keys=None, not_null=None, casts: dict[str, str] | None = None, select: str | None = None) -> Catalog:
        """A table from folder, read by Spark's reader for format; casts give columns exact types, select derives the table by SQL over {source}."""
        path = f"{folder.rstrip('/')}/{source or name}"
        df = self.spark.read.format(format).load(f"{path}.{format}")
        if select:
            df = self.spark.sql(select, source=df)
        if casts:
            df = df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})
        return self.add(name, df, keys, not_null)

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def __getitem__(self, name: str) -> PhysicalTable:
        return self.tables[name]

    def repeats(self, name: str, columns: list[str]) -> bool:
        """Whether some combination of the columns occurs twice; an aggregation with partial counts, stopped at the first."""
        return bool(self[name].df.groupBy(*columns).count().where("count > 1").limit(1).count())

    def nulls(self, name: str, columns: list[str]) -> list[str]:
        """Those of the columns that hold a null, by one scan."""
        if not columns:
            return []
        found = self[name].df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first()
        return [c for c, hit in zip(columns, found, strict=True) if hit]
