"""Range queries: which resolution, which segments, and what published windows cover of them. Driver only."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import CubeError, IncompleteError
from ..functions.times import Range, bucket, parse_resolution, show_resolution
from ..spec import Temporal
from ..xunits import XUnit


@dataclass(frozen=True)
class TemporalQuery:
    cube: str
    selectors: tuple[XUnit, ...]
    measures: tuple[str, ...]
    range: Range
    resolution: int | None = None
    exact: bool = False
    gap: str = "missing"

    @classmethod
    def of(cls, spec: Temporal, cube: str, selectors, measures, start: int, end: int, resolution: str | int | None = None, exact: bool = False, gap: str = "missing") -> TemporalQuery:
        wanted = parse_resolution(resolution) if isinstance(resolution, str) else resolution
        if wanted is not None and wanted != spec.base and wanted not in spec.rollups:
            raise CubeError(f"resolution {show_resolution(wanted)} is neither the base {show_resolution(spec.base)} nor a rollup of this cube")
        if gap not in ("missing", "zero"):
            raise CubeError("gap is 'missing' or 'zero'")
        return cls(cube, tuple(selectors), tuple(measures), Range(start, end), wanted, exact, gap)


@dataclass(frozen=True)
class Segment:
    range: Range
    aligned: bool


@dataclass(frozen=True)
class ResolutionPlan:
    resolution: int
    segments: tuple[Segment, ...]

    @classmethod
    def of(cls, query: TemporalQuery, spec: Temporal) -> ResolutionPlan:
        """Without a resolution in the query: the coarsest that fits into the range, else the base."""
        if isinstance(query.resolution, str) or isinstance(spec.base, str):
            raise CubeError("calendar resolutions have no buckets of fixed width")
        fit = [r for r in spec.rollups if not isinstance(r, str) and r <= query.range.length]
        width = query.resolution or max([spec.base, *fit])
        return cls(width, decompose(query.range, width, spec.origin))


def decompose(r: Range, width: int, origin: int = 0) -> tuple[Segment, ...]:
    """At most a partial head, one aligned interior and a partial tail; a range inside one bucket is a single part."""
    first, last = bucket(r.start, width, origin), bucket(r.end, width, origin)
    inner = r.start if first.start == r.start else first.end
    outer = last.start
    if inner > outer:
        return (Segment(r, False),)
    cuts = [(r.start, inner, False), (inner, outer, True), (outer, r.end, False)]
    return tuple(Segment(Range(a, b), ok) for a, b, ok in cuts if a < b)


@dataclass(frozen=True)
class SegmentCoverage:
    segment: Segment
    published: tuple[tuple[str, int], ...] = ()
    missing: tuple[str, ...] = ()

    @property
    def is_exact(self) -> bool:
        """By publication alone: aligned, something published, nothing missing."""
        return self.segment.aligned and bool(self.published) and not self.missing


@dataclass(frozen=True)
class CoveragePlan:
    resolution: int
    segments: tuple[SegmentCoverage, ...] = field(default=())

    @classmethod
    def of(cls, plan: ResolutionPlan, windows: list[list[tuple[str, int | None]]], exact: bool = False) -> CoveragePlan:
        """``windows``: for each segment its windows, each with its current revision or None."""
        if len(windows) != len(plan.segments):
            raise CubeError(f"{len(plan.segments)} segments need as many lists of windows, not {len(windows)}")
        found = tuple(SegmentCoverage(s, tuple((w, r) for w, r in ws if r is not None), tuple(w for w, r in ws if r is None)) for s, ws in zip(plan.segments, windows, strict=True))
        short = [c for c in found if not c.is_exact]
        if exact and short:
            raise IncompleteError("no exact answer for " + ", ".join(f"[{c.segment.range.start}, {c.segment.range.end})" for c in short), [w for c in short for w in c.missing])
        return cls(plan.resolution, found)
