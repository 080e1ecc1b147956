"""Sensors that each add a part of a snapshot's graph, and the scanner that puts them together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import selectors
from ripplegraph.model import Graph, GraphError, Snapshot
from ripplegraph.operators.graph import absorbed, namespace, validated

RESERVED = frozenset(("locals", "target"))


@dataclass(frozen=True)
class Sensor:
    """What a source gives: each callable takes the input and returns DataFrames."""

    namespace: str
    graph: Callable[[Any], Graph | None] | None = None
    tokens: Callable[[Any], DataFrame] | None = None
    followed: tuple[str, ...] = ()
    targets: Callable[[Any], DataFrame] | None = None
    decode: Callable[[str], str] | None = None
    functions: dict[str, Callable] = field(default_factory=dict)


@dataclass
class Builder:
    """Collects sensors, target kinds and settings; every name may be taken once."""

    sensors: dict[str, Sensor] = field(default_factory=dict)
    kinds: dict[str, Callable] = field(default_factory=dict)
    settings: dict[str, Callable] = field(default_factory=dict)

    def attach(self, sensor: Sensor) -> Builder:
        if not sensor.namespace or sensor.namespace in self.sensors:
            raise GraphError(f"namespace {sensor.namespace!r} is empty or taken")
        if bool(sensor.followed) != bool(sensor.tokens):
            raise GraphError("relations to follow and tokens go together")
        if not (sensor.graph or sensor.tokens or sensor.targets or sensor.decode or sensor.functions):
            raise GraphError(f"sensor {sensor.namespace!r} gives nothing")
        self.sensors[sensor.namespace] = sensor
        return self

    def _name(self, name: str, decoder) -> None:
        if not name.isidentifier() or name in RESERVED or name in self.kinds or name in self.settings:
            raise GraphError(f"name {name!r} is invalid, reserved or taken")
        if decoder is None:
            raise GraphError(f"{name!r} needs a decoder")

    def attach_kind(self, name: str, decoder: Callable) -> Builder:
        self._name(name, decoder)
        self.kinds[name] = decoder
        return self

    def attach_setting(self, name: str, decoder: Callable) -> Builder:
        self._name(name, decoder)
        self.settings[name] = decoder
        return self

    def compile(self) -> Scanner:
        functions: dict[str, Callable] = {}
        for s in (self.sensors[k] for k in sorted(self.sensors)):
            if twice := functions.keys() & s.functions.keys():
                raise GraphError(f"function {min(twice)!r} is given twice")
            functions |= s.functions
        return Scanner(tuple(self.sensors[k] for k in sorted(self.sensors)), functions, dict(self.kinds), dict(self.settings))


@dataclass(frozen=True)
class Scanner:
    """Sensors in order of their namespaces; immutable."""

    sensors: tuple[Sensor, ...]
    functions: dict[str, Callable]
    kinds: dict[str, Callable]
    settings: dict[str, Callable]

    def graph(self, source) -> Graph:
        """The union of the sensors' graphs, which must agree on every entity's kind."""
        found = [g for s in self.sensors if s.graph and (g := s.graph(source)) is not None]
        if not found:
            raise GraphError("no sensor gives a graph")
        return absorbed(*found)

    def tokens(self, source) -> DataFrame:
        """The union of the sensors' tokens; one outside its sensor's namespace is an error."""
        out = None
        for s in self.sensors:
            if s.tokens:
                t = s.tokens(source).select("id", "token")
                own = namespace(F.col("id")) == s.namespace
                t = t.select(F.when(own, F.col("id")).otherwise(F.raise_error(F.concat(F.lit(f"{s.namespace} gave a token to "), F.col("id")))).alias("id"), "token")
                out = t if out is None else out.union(t)
        if out is None:
            raise GraphError("no sensor gives tokens")
        return out

    def capture(self, source, hashes: bool = True) -> Snapshot:
        """A validated snapshot; tokens are only asked for where sums are wanted."""
        followed = tuple(dict.fromkeys(k for s in self.sensors for k in s.followed))
        graph = validated(self.graph(source))
        return Snapshot(graph, self.tokens(source), followed) if hashes else Snapshot(graph)

    def targets(self, source) -> DataFrame:
        found = [s.targets(source) for s in self.sensors if s.targets]
        if not found:
            raise GraphError("no sensor gives targets")
        out = found[0]
        for t in found[1:]:
            out = out.unionByName(t)
        return out

    def resolve(self, source, text: str, cwd: str = "") -> str:
        return selectors.resolve_one(self.targets(source), text, cwd)

    def decode(self, id_: str) -> str:
        """The kind of an id, by the sensor of its namespace."""
        space, colon, _ = id_.partition(":")
        sensor = next((s for s in self.sensors if colon and s.namespace == space and s.decode), None)
        if sensor is None:
            raise GraphError(f"no sensor decodes {id_!r}")
        return sensor.decode(id_)
