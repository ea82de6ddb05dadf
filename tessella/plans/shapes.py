"""The lattice: which shapes of cells a spec keeps. All of this runs on the driver, once per build and never per row."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from ..rules import keeps, most_dimensions
from ..spec import CubeSpec
from ..xunits import XUnit, YPath

#: A shape: how deep each dimension, sorted by name, is drilled down; 0 leaves it out.
Depths = tuple[int, ...]


def attributes(spec: CubeSpec, depths: Depths) -> dict[str, tuple[str, ...]]:
    """The shape as rules see it."""
    return {d.name: tuple(x.name for x in d.levels[:n]) for d, n in zip(spec.sorted_dimensions, depths, strict=True) if n}


def shapes(spec: CubeSpec) -> list[Depths]:
    """All kept shapes; the global one comes last and no rule touches it."""
    dims, bound = spec.sorted_dimensions, most_dimensions(list(spec.rules))
    out: list[Depths] = []

    def grow(at: int, taken: Depths, used: int) -> None:
        if at == len(dims):
            if used and all(keeps(r, attributes(spec, taken)) for r in spec.rules):
                out.append(taken)
            return
        grow(at + 1, (*taken, 0), used)
        if bound is None or used < bound:  # no kept cell has more dimensions
            for n in range(1, len(dims[at].levels) + 1):
                grow(at + 1, (*taken, n), used + 1)

    grow(0, (), 0)
    if spec.include_global:
        out.append((0,) * len(dims))
    return out


def ypaths(spec: CubeSpec, dim: str, values: Sequence[str | None]) -> list[YPath]:
    """Every prefix of a row's level values, up to the first that is missing."""
    path, out = YPath(dim), []
    levels = next(d.levels for d in spec.dimensions if d.name == dim)
    for level, value in zip(levels, values, strict=False):
        if value is None:
            break
        path = path.down(level.name, value)
        out.append(path)
    return out


def generate_xunits(spec: CubeSpec, row: Mapping[str, Sequence[str | None]], pruned: bool = True) -> list[XUnit]:
    """The cells of one row, {dimension: level values}. For tests and small inputs: builds work on shapes."""
    dims = spec.sorted_dimensions
    choices = [[None, *ypaths(spec, d.name, row.get(d.name, ()))] for d in dims]
    kept = set(shapes(spec)) if pruned else None
    out = []
    for combo in itertools.product(*choices):
        depths = tuple(0 if p is None else len(p.attrs) for p in combo)
        if any(depths) and (depths in kept if pruned else all(keeps(r, attributes(spec, depths)) for r in spec.rules)):
            out.append(XUnit(tuple(p for p in combo if p)))
    return out + [XUnit()] * spec.include_global
