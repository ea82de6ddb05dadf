"""Cube specs: parsing, validation that reports every problem at once, canonical form and hash."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from .errors import CubeError, SpecError
from .functions.blake3 import blake3
from .functions.times import parse_origin, parse_resolution, show_resolution, show_time
from .rules import dims_of, parse_rule

V1, V2 = "v1", "cubism/v2alpha1"
AGGS = ("sum", "count", "min", "max", "avg", "variance", "count_distinct", "top_k", "quantile", "centroid", "reservoir_sample")
SKETCHES = ("count_distinct", "top_k", "reservoir_sample", "centroid")
_STATE = {"version": None, "kmvSize": "count_distinct", "quantileBinWidth": "quantile", "sampleCapacity": "reservoir_sample", "centroidTolerance": "centroid"}


@dataclass(frozen=True)
class Level:
    name: str
    expr: str | None = None

    @property
    def sql(self) -> str:
        return self.expr or f"`{self.name}`"


@dataclass(frozen=True)
class Dimension:
    name: str
    declared: tuple[Level, ...] = ()

    @property
    def levels(self) -> tuple[Level, ...]:
        return self.declared or (Level(self.name),)


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    input: str | None = None
    by: str | None = None
    state: dict = field(default_factory=dict, hash=False)

    @property
    def version(self) -> int:
        return self.state.get("version", 1)


@dataclass(frozen=True)
class Temporal:
    event_time: str
    base: int | str
    lateness: int
    ingestion_time: str | None = None
    origin: int = 0
    timezone: str = "UTC"
    rollups: tuple[int | str, ...] = ()
    retention: int | None = None


@dataclass(frozen=True)
class CubeSpec:
    api_version: str
    name: str
    dimensions: tuple[Dimension, ...]
    rules: tuple[dict, ...] = field(default=(), hash=False)
    measures: tuple[Measure, ...] = ()
    include_global: bool = False
    temporal: Temporal | None = None
    max_dictionary_entries: int = 1_000_000

    @property
    def sorted_dimensions(self) -> list[Dimension]:
        return sorted(self.dimensions, key=lambda d: d.name)

    @classmethod
    def from_yaml(cls, text: str) -> CubeSpec:
        import yaml

        try:
            return cls.from_dict(yaml.safe_load(text))
        except yaml.YAMLError as e:
            raise SpecError([f"not YAML: {e}"]) from e

    @classmethod
    def from_json(cls, text: str) -> CubeSpec:
        try:
            return cls.from_dict(json.loads(text))
        except json.JSONDecodeError as e:
            raise SpecError([f"not JSON: {e}"]) from e

    @classmethod
    def from_dict(cls, raw) -> CubeSpec:
        top = _object(raw, "spec", ["apiVersion", "name", "dimensions"], ["filterRules", "measures", "includeGlobal", "temporal", "maxDictionaryEntries"])
        dims = []
        for d in _list(top["dimensions"], "dimensions"):
            d = _object(d, "dimensions", ["name"], ["levels"])
            levels = []
            for x in _list(d.get("levels") or [], "levels"):
                x = {"name": x} if isinstance(x, str) else _object(x, "levels", ["name"], ["expr"])
                levels.append(Level(_text(x["name"], "level"), x.get("expr")))
            dims.append(Dimension(_text(d["name"], "dimension"), tuple(levels)))
        measures = []
        for m in _list(top.get("measures") or [], "measures"):
            m = _object(m, "measures", ["name", "agg"], ["input", "by", "state"])
            if m["agg"] not in AGGS:
                raise SpecError([f"measures: unknown agg {m['agg']!r}"])
            state = {k: v for k, v in _object(m.get("state") or {}, "state", [], list(_STATE)).items() if v is not None}
            measures.append(Measure(_text(m["name"], "measure"), m["agg"], m.get("input"), m.get("by"), state))
        most = top.get("maxDictionaryEntries", 1_000_000)
        if not isinstance(most, int) or isinstance(most, bool) or most < 0:
            raise SpecError(["maxDictionaryEntries is a whole number"])
        if not isinstance(top.get("includeGlobal", False), bool):
            raise SpecError(["includeGlobal is true or false"])
        rules = tuple(parse_rule(r) for r in _list(top.get("filterRules") or [], "filterRules"))
        spec = cls(str(top["apiVersion"]), _text(top["name"], "name"), tuple(dims), rules, tuple(measures), top.get("includeGlobal", False), _temporal(top.get("temporal")), most)
        problems = spec.problems()
        if problems:
            raise SpecError(problems)
        return spec

    def problems(self) -> list[str]:
        out = []
        if self.api_version not in (V1, V2):
            out.append(f"apiVersion {self.api_version!r} is neither {V1!r} nor {V2!r}")
        if self.api_version == V1 and self.temporal:
            out.append(f"a temporal section needs apiVersion {V2!r}")
        if self.api_version == V2:
            out += _temporal_problems(self.temporal) if self.temporal else [f"apiVersion {V2!r} needs a temporal section"]
        if self.max_dictionary_entries < 1:
            out.append("maxDictionaryEntries is 1 or more")
        if not self.name:
            out.append("the cube has no name")
        if not self.dimensions:
            out.append("a cube has one dimension or more")
        for d in self.dimensions:
            for what, name in [("dimension", d.name), *((f"level of {d.name!r}", x.name) for x in d.declared)]:
                if not name:
                    out.append(f"a {what} has no name")
                elif set(name) & set("/=,"):
                    out.append(f"{what} {name!r} holds one of '/', '=', ','")
            out += [f"dimension {d.name!r} has two levels {n!r}" for n in _twice(x.name for x in d.declared)]
        names = {d.name for d in self.dimensions}
        out += [f"there are two dimensions {n!r}" for n in _twice(d.name for d in self.dimensions)]
        for r in self.rules:
            out += [f"rule {r['type']} names the unknown dimension {n!r} (there are: {', '.join(sorted(names))})" for n in dims_of(r) if n not in names]
            if r["type"] == "max_dimensions" and r["n"] == 0:
                out.append("max_dimensions of 0 keeps no cell")
        out += [f"there are two measures {n!r}" for n in _twice(m.name for m in self.measures)]
        for m in self.measures:
            out += [f"measure {m.name!r}: {x}" for x in _measure_problems(m, self.api_version == V2)]
        return out

    def to_dict(self) -> dict:
        """In the order and with the defaults left out that the canonical form has."""
        return {
            "apiVersion": self.api_version,
            "name": self.name,
            "dimensions": [{"name": d.name, "levels": [{"name": x.name} | ({"expr": x.expr} if x.expr is not None else {}) for x in d.declared]} for d in self.dimensions],
            "filterRules": [*self.rules],
            "measures": [
                {"name": m.name, "agg": m.agg} | {k: v for k, v in (("input", m.input), ("by", m.by)) if v is not None} | ({"state": {"version": m.version} | {k: m.state[k] for k in _STATE if k in m.state and k != "version"}} if {k: v for k, v in m.state.items() if (k, v) != ("version", 1)} else {})
                for m in self.measures
            ],
            "includeGlobal": self.include_global,
        } | ({"temporal": _temporal_dict(self.temporal)} if self.temporal else {}) | {"maxDictionaryEntries": self.max_dictionary_entries}

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)

    def spec_hash(self) -> bytes:
        return blake3(json.dumps(self.to_dict(), separators=(",", ":"), ensure_ascii=False).encode())


def _object(raw, where: str, need: list[str], may: list[str]) -> dict:
    if not isinstance(raw, dict):
        raise SpecError([f"{where} is a mapping"])
    wrong = [f"{where}: unknown field {k!r}" for k in raw if k not in (*need, *may)] + [f"{where}: field {k!r} is missing" for k in need if k not in raw]
    if wrong:
        raise SpecError(wrong)
    return raw


def _list(raw, where: str) -> list:
    if not isinstance(raw, list):
        raise SpecError([f"{where} is a list"])
    return raw


def _text(raw, where: str) -> str:
    if not isinstance(raw, str):
        raise SpecError([f"the name of a {where} is text"])
    return raw


def _twice(names) -> list[str]:
    seen, out = set(), []
    for n in names:
        if n in seen:
            out.append(n)
        seen.add(n)
    return out


def _temporal(raw) -> Temporal | None:
    if raw is None:
        return None
    t = _object(raw, "temporal", ["eventTime", "baseResolution", "allowedLateness"], ["ingestionTime", "origin", "timezone", "rollups", "retention"])
    try:
        lateness = 0 if str(t["allowedLateness"]) in ("0", "0s") else parse_resolution(t["allowedLateness"])
        retention = None if t.get("retention") is None else parse_resolution(t["retention"])
        if isinstance(lateness, str) or isinstance(retention, str):
            raise CubeError("allowedLateness and retention are fixed lengths of time")
        return Temporal(t["eventTime"], parse_resolution(t["baseResolution"]), lateness, t.get("ingestionTime"), parse_origin(t.get("origin", "unix")), t.get("timezone", "UTC"), tuple(parse_resolution(r) for r in t.get("rollups") or []), retention)
    except CubeError as e:
        raise SpecError([f"temporal: {e}"]) from e


def _temporal_dict(t: Temporal) -> dict:
    out = {"eventTime": t.event_time} | ({"ingestionTime": t.ingestion_time} if t.ingestion_time is not None else {})
    out |= {"baseResolution": show_resolution(t.base), "origin": "unix" if t.origin == 0 else show_time(t.origin), "timezone": t.timezone}
    out |= {"allowedLateness": show_resolution(t.lateness) if t.lateness else "0s"}
    out |= {"rollups": [show_resolution(r) for r in t.rollups]} if t.rollups else {}
    return out | ({"retention": show_resolution(t.retention)} if t.retention is not None else {})


def _temporal_problems(t: Temporal) -> list[str]:
    out = []
    if not str(t.event_time).strip():
        out.append("temporal.eventTime is empty")
    if t.ingestion_time is not None and not str(t.ingestion_time).strip():
        out.append("temporal.ingestionTime is empty")
    if t.timezone != "UTC":
        out.append(f"temporal.timezone {t.timezone!r}: only 'UTC' is supported")
    if isinstance(t.base, str):
        out.append(f"calendar resolution {t.base!r} is not supported")
    for r in t.rollups:
        if isinstance(r, str):
            out.append(f"calendar rollup {r!r} is not supported")
        elif not isinstance(t.base, str) and r <= t.base:
            out.append(f"rollup {show_resolution(r)} is not coarser than {show_resolution(t.base)}")
        elif not isinstance(t.base, str) and r % t.base:
            out.append(f"rollup {show_resolution(r)} is no multiple of {show_resolution(t.base)}")
    return out


def _measure_problems(m: Measure, temporal: bool) -> list[str]:
    out = []
    if m.agg != "count" and m.input is None:
        out.append(f"{m.agg} needs an input")
    if m.agg == "top_k" and m.by is None:
        out.append("top_k needs 'by', the score of its key 'input'")
    if m.agg != "top_k" and m.by is not None:
        out.append("only top_k takes 'by'")
    if not temporal and {k: v for k, v in m.state.items() if (k, v) != ("version", 1)}:
        return [*out, f"state parameters need apiVersion {V2!r}"]
    if m.version != 1:
        out.append(f"state version {m.version} is not 1")
    for key, agg in _STATE.items():
        if agg and key in m.state:
            value = m.state[key]
            if m.agg != agg:
                out.append(f"state.{key} is for {agg} only")
            if key == "kmvSize" and value < 2 or key == "sampleCapacity" and value < 1:
                out.append(f"state.{key} is too small")
            if key in ("quantileBinWidth", "centroidTolerance") and not (math.isfinite(value) and value > 0):
                out.append(f"state.{key} is finite and above 0")
    if temporal and m.agg == "quantile" and "quantileBinWidth" not in m.state:
        out.append("a temporal quantile needs state.quantileBinWidth")
    if temporal and m.agg == "top_k":
        out.append("top_k has no temporal state: a pruned merge is not associative")
    return out
