"""Cells as text: a path per dimension (``/geo/country=CZ/city=Brno``), and the conjunction of paths that names a cell."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import CubeError

GLOBAL = "/G"
#: What stands for structural characters inside values, in order of replacement.
SCRUB = [("/", "___"), ("=", "###"), (",", "+++")]


def scrub(value: str) -> str:
    for raw, safe in SCRUB:
        value = value.replace(raw, safe)
    return value


def unscrub(value: str) -> str:
    for raw, safe in SCRUB:
        value = value.replace(safe, raw)
    return value


@dataclass(frozen=True)
class YPath:
    """A dimension and its attributes in drill-down order; a value of None is an attribute without one."""

    dim: str
    attrs: tuple[tuple[str, str | None], ...] = ()

    def down(self, attr: str, value: str | None) -> YPath:
        return YPath(self.dim, (*self.attrs, (attr, value)))

    def has_attribute(self, attr: str) -> bool:
        return any(a == attr for a, _ in self.attrs)

    def __str__(self) -> str:
        return "".join([f"/{self.dim}", *(f"/{a}" if v is None else f"/{a}={scrub(v)}" for a, v in self.attrs)])

    @classmethod
    def parse(cls, text: str) -> YPath:
        if not text.startswith("/"):
            raise CubeError(f"a path starts with '/': {text!r}")
        dim, *rest = text[1:].split("/")
        if not dim or "" in rest:
            raise CubeError(f"a path has no empty parts: {text!r}")
        attrs = []
        for part in rest:
            name, has, value = part.partition("=")
            attrs.append((name, unscrub(value) if has else None))
        return cls(dim, tuple(attrs))


@dataclass(frozen=True)
class XUnit:
    """A cell: at most one path per dimension, sorted by dimension; none at all is the global cell."""

    paths: tuple[YPath, ...] = ()

    @classmethod
    def of(cls, *paths: YPath) -> XUnit:
        ordered = tuple(sorted(paths, key=lambda p: p.dim))
        if len({p.dim for p in ordered}) < len(ordered):
            raise CubeError("a cell has one path per dimension")
        return cls(ordered)

    @classmethod
    def parse(cls, text: str) -> XUnit:
        return cls() if text == GLOBAL else cls.of(*(YPath.parse(p) for p in text.split(",")))

    def __str__(self) -> str:
        return ",".join(map(str, self.paths)) or GLOBAL

    @property
    def dims(self) -> list[str]:
        return [p.dim for p in self.paths]

    def path(self, dim: str) -> YPath | None:
        return next((p for p in self.paths if p.dim == dim), None)

    def has(self, dim: str) -> bool:
        return self.path(dim) is not None

    def without(self, dim: str) -> XUnit:
        return XUnit(tuple(p for p in self.paths if p.dim != dim))
