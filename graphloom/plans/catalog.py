"""What the query languages are defined over: entities, their properties, and selectors between them.

An entity is a table with a key.  A property is a column of it, or a table ``(node, value)`` such as a metric.  A selector is a
table of pairs ``(src, dst)`` of keys.  Initial selections name entities, or positions when the caller gives one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Entity:
    name: str
    table: DataFrame
    key: str
    properties: dict[str, Column] = field(default_factory=dict)
    metrics: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def has(self, name: str) -> bool:
        return name in self.properties or name in self.metrics

    def values(self, name: str) -> DataFrame:
        """``(node, value)`` of a property."""
        if name in self.properties:
            return self.table.select(F.col(self.key).alias("node"), self.properties[name].alias("value"))
        return self.metrics[name]().select("node", "value")

    def nodes(self) -> DataFrame:
        return self.table.select(F.col(self.key).alias("node"))


@dataclass
class Catalog:
    entities: dict[str, Entity] = field(default_factory=dict)
    #: (entity, selector) to (target entity, pairs)
    selectors: dict[tuple[str, str], tuple[str, Callable[[], DataFrame]]] = field(default_factory=dict)
    #: initial selection to (entity, nodes)
    starts: dict[str, tuple[str, Callable[[], DataFrame]]] = field(default_factory=dict)

    def entity(self, name: str, table: DataFrame, key: str, start: str | None = None, /, **properties: str) -> Entity:
        out = self.entities[name] = Entity(name, table, key, {p: F.col(c) for p, c in properties.items()})
        if start:
            self.starts[start] = (name, out.nodes)
        return out

    def selector(self, source: str, names: str | tuple[str, ...], target: str, pairs: DataFrame | Callable[[], DataFrame], src: str, dst: str) -> None:
        """``pairs`` may be made when a query first asks for them."""
        found = lambda: (pairs() if callable(pairs) else pairs).select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        for name in (names,) if isinstance(names, str) else names:
            self.selectors[source, name] = (target, found)

    def start(self, name: str, entity: str, nodes: DataFrame) -> None:
        """A position-based initial selection: ``nodes (node)`` is what stands at the position."""
        self.starts[name] = (entity, lambda: nodes.select("node"))
