"""Series: one point per segment of a range, merged from the states of its published windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions.encoding import content_id
from ..functions.states import average_parts
from ..plans.range_query import CoveragePlan
from ..xunits import XUnit


def merged(agg: str, column: Column) -> Column:
    """An aggregate over states: sums and counts add up, min and max pass over NaN, averages merge as (sum, count); null where there is nothing."""
    if agg in ("sum", "count"):
        return F.sum(column)
    if agg in ("min", "max"):
        f = F.min if agg == "min" else F.max
        return F.coalesce(f(F.when(~F.isnan(column), column)), f(column))
    if agg == "avg":
        n = F.sum(column["count"])
        return F.when(n > 0, F.sum(column["total"]) / n)
    raise CubeError(f"no series of {agg}")


@dataclass(frozen=True)
class Point:
    start: int
    end: int
    exact: bool
    value: float | None
    published: tuple[tuple[str, int], ...]
    missing: tuple[str, ...]


def segment_values(states: DataFrame, coverage: CoveragePlan, selector: XUnit, measure: str, agg: str) -> DataFrame:
    """(segment, value): one row per segment that has states of the selected cell; ``states`` hold window_id and the measure's column."""
    where = {w: i for i, c in enumerate(coverage.segments) for w, _ in c.published}
    rows = states.where(F.col("xunit_id") == F.lit(content_id(selector)))
    if not where:
        rows = rows.where(F.lit(False))
    at = F.element_at(F.create_map(*[F.lit(x) for kv in where.items() for x in kv]), F.col("window_id")) if where else F.lit(0)
    some = rows.where(F.col("window_id").isin(list(where))) if where else rows
    column = average_parts(measure) if agg == "avg" else F.col(measure).cast("double")
    picked = some.select(at.alias("segment"), F.col(measure).isNotNull().alias("has"), column.alias("v")).where("has")
    return picked.groupBy("segment").agg(merged(agg, F.col("v")).cast("double").alias("value"))


def series(states: DataFrame, coverage: CoveragePlan, selectors: list[XUnit], measure: str, agg: str, gap: str = "missing") -> list[Point]:
    """Takes exactly one selector. ``gap='zero'`` fills segments without data only; a value is never touched."""
    if len(selectors) != 1:
        raise CubeError("a series has exactly one selector")
    found = {r["segment"]: r["value"] for r in segment_values(states, coverage, selectors[0], measure, agg).collect()}
    blank = 0.0 if gap == "zero" else None
    return [Point(c.segment.range.start, c.segment.range.end, c.is_exact, blank if found.get(i) is None else found[i], c.published, c.missing) for i, c in enumerate(coverage.segments)]
