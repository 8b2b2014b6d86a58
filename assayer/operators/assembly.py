"""Devices from the rows of evidence about them, by the first of several providers that knows them.

A provider is a small class: it sees a device's rows one after the other in order, keeps what it needs and
answers, or not, at the end. ``assembled`` runs them in a table function that Spark partitions by device, so
its state is one device's and is as large as what the providers keep.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


#: Column of how many rows a row stands for.
TIMES = "__times"


class Provider(Protocol):
    """What a provider has: a name, ``see`` for each row and ``answer`` at the end (None: not known).

    ``counted`` are kinds of which it only needs the number of rows: those that all providers
    count come as one row a device, without name and value, whose ``TIMES`` is their number.
    """

    name: str
    counted: tuple[str, ...] = ()

    def see(self, row: dict) -> None: ...

    def answer(self) -> dict | None: ...


class ByDefinition:
    """A device whose definition has a name and a description, bound to exactly one module.

    Rows of kind definition (name, value: its description), module (name) and parameter (name, value).
    """

    name, definition, description, model, maker = "by_definition", "", "", "", ""
    counted = ("parameter",)

    def __init__(self) -> None:
        self.matches, self.modules, self.parameters = False, set(), 0

    def see(self, row: dict) -> None:
        if row["kind"] == "definition":
            self.matches |= (row["name"] or "").casefold() == self.definition and (row["value"] or "").strip().casefold() == self.description
        elif row["kind"] == "module" and len(self.modules) < 2:
            self.modules.add(row["name"])
        elif row["kind"] == "parameter":
            self.parameters += row.get(TIMES, 1)

    def answer(self) -> dict | None:
        if not self.matches or len(self.modules) != 1:
            return None
        return {"model": self.model, "maker": self.maker, "module": next(iter(self.modules)), "parameters": self.parameters}


def definition_provider(name: str, definition: str, description: str, model: str, maker: str) -> type[ByDefinition]:
    """A provider of devices that are known by their definition."""
    return type(f"Provider_{name}", (ByDefinition,), {"name": name, "definition": definition.casefold(), "description": description.casefold(), "model": model, "maker": maker})


class AnyModule:
    """Any device that is bound to a module: the least of them in order, without a model."""

    name, counted = "any_module", ("parameter",)

    def __init__(self) -> None:
        self.module, self.parameters = None, 0

    def see(self, row: dict) -> None:
        if row["kind"] == "module" and row["name"] is not None:
            self.module = row["name"] if self.module is None else min(self.module, row["name"])
        if row["kind"] == "parameter":
            self.parameters += row.get(TIMES, 1)

    def answer(self) -> dict | None:
        return None if self.module is None else {"model": None, "maker": None, "module": self.module, "parameters": self.parameters}


def table_function(providers: Sequence[type[Provider]], key: str = "device") -> type:
    """A table function over rows of ``key``, kind, name and value: one row a device that a provider knows.

    Its result has the type that the argument's key has, so keys are of any type.
    """
    chosen = list(providers)

    class Assemble:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the argument is a table")
            given = rows.dataType
            missing = [c for c in (key, "kind", "name", "value") if c not in given.names]
            if missing:
                raise ValueError(f"the table has no column {', '.join(missing)}")
            schema = StructType([given[key]]).add("provider", "string").add("model", "string").add("maker", "string").add("module", "string").add("parameters", "long")
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn("kind"), OrderingColumn("name")])

        def __init__(self) -> None:
            self.device, self.asked = None, [p() for p in chosen]

        def eval(self, rows: object) -> None:
            row = rows.asDict()
            self.device = row[key]
            for p in self.asked:
                p.see(row)

        def terminate(self) -> Iterator[tuple]:
            for p in self.asked:
                found = p.answer()
                if found is not None:
                    yield self.device, p.name, found["model"], found["maker"], found["module"], found["parameters"]
                    return

    return Assemble


def assembled(rows: DataFrame, providers: Sequence[type[Provider]], key: str = "device") -> DataFrame:
    """``key``, provider, model, maker, module and parameters of every device that one of ``providers`` knows.

    rows: ``key``, kind, name and value. The first provider in order that answers names the device;
    devices that none knows are left out. ``register`` makes the same function known to SQL.
    """
    function = udtf(table_function(providers, key))
    kinds = sorted(set.intersection(*[set(getattr(p, "counted", ())) for p in providers])) if providers else []
    rows = rows.select(*[c for c in rows.columns if c in (key, "kind", "name", "value")])
    if kinds and len(rows.columns) == 4:
        # Spark counts these rows before they are shuffled; the others pass one by one.
        counted = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
        number = rows.where(counted).groupBy(key, "kind").agg(F.count(F.lit(1)).alias(TIMES))
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("name", "value")]
        rows = rows.where(~counted).select(key, "kind", "name", "value", F.lit(1).cast("long").alias(TIMES)).union(number.select(key, "kind", *none, TIMES))
    return function(rows.asTable())


def register(spark: SparkSession, name: str, providers: Sequence[type[Provider]], key: str = "device") -> None:
    """``SELECT * FROM name(TABLE(rows))`` from now on."""
    spark.udtf.register(name, udtf(table_function(providers, key)))
