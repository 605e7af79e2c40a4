"""Evidence channels: typed provenance columns merged onto results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column types of a channel and the types they are in Spark.
TYPES = {"Float32": "float", "Float64": "double", "Int32": "int", "Int64": "bigint", "Utf8": "string", "Boolean": "boolean"}


class ChannelAssembly(ValueError):
    pass


@dataclass
class Channel:
    id: str
    priority: int
    columns: list[tuple[str, str]]


@dataclass
class ChannelRegistry:
    channels: dict[str, Channel] = field(default_factory=dict)

    @classmethod
    def seeded(cls) -> ChannelRegistry:
        made = cls()
        made.register("vector", 1, [("similarity", "Float32")])
        made.register("inference", 2, [("model", "Utf8"), ("task", "Utf8"), ("confidence", "Float32")])
        made.register("bm25", 3, [("score", "Float32"), ("rank", "Int32")])
        return made

    def register(self, id: str, priority: int, columns: list[tuple[str, str]]) -> None:
        if id in self.channels:
            raise ChannelAssembly(f"channel {id} is registered")
        self._check(columns)
        self.channels[id] = Channel(id, priority, list(columns))

    def add_columns(self, id: str, columns: list[tuple[str, str]]) -> None:
        """Columns are only ever added; a known one keeps its type."""
        self._check(columns)
        held = dict(self.channels[id].columns)
        for name, kind in columns:
            if name in held and held[name] != kind:
                raise ChannelAssembly(f"{id}.{name} is {held[name]}")
            if name not in held:
                self.channels[id].columns.append((name, kind))

    @staticmethod
    def _check(columns: list[tuple[str, str]]) -> None:
        for name, kind in columns:
            if kind not in TYPES:
                raise ChannelAssembly(f"{name}: {kind}")

    def ordered(self) -> list[tuple[str, str, str]]:
        """``(channel, column, type)`` by priority and ordinal."""
        return [(c.id, n, t) for c in sorted(self.channels.values(), key=lambda c: (c.priority, c.id)) for n, t in c.columns]

    def merge(self, df: DataFrame, values: dict[str, dict[str, Column]], retrieved_by: list[str], annotated_by: list[str] = ()) -> DataFrame:
        """``df`` without channel columns, then ``retrieved_by``, ``annotated_by`` and all channel columns (absent: null)."""
        for id, given in values.items():
            if id not in self.channels:
                raise ChannelAssembly(f"channel {id} is not registered")
            unknown = set(given) - {n for n, _ in self.channels[id].columns}
            if unknown:
                raise ChannelAssembly(f"{id} has no {sorted(unknown)}")
        names = [n for _, n, _ in self.ordered()]
        if len(set(names)) != len(names):
            raise ChannelAssembly("two channels have a column of one name")
        made = [values.get(id, {}).get(n, F.lit(None)).cast(TYPES[t]).alias(n) for id, n, t in self.ordered()]
        label = lambda ids: F.array(*(F.lit(i) for i in ids)).cast("array<string>")
        return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names), label(retrieved_by).alias("retrieved_by"), label(annotated_by).alias("annotated_by"), *made)
