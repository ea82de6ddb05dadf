"""Temporal cubes: states keyed by (bucket_start, xunit_id), with a registry of cells and what the build covered.

Time is a key of its own in every grouping set and never part of a cell. Canonical bytes of cells are
built by column functions; only their BLAKE3 ids need Python, over arrays of many cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CubeError
from ..functions import sketches as S
from ..functions import states as A
from ..functions.blake3 import blake3_many
from ..functions.encoding import MAGIC, STRING, VERSION
from ..functions.times import Range, bucket, bucket_start, show_time
from ..spec import CubeSpec, Measure
from .cells import Layout, guard, level_columns, measure_cells


def state_column(m: Measure) -> str:
    return f"{m.name}_v{m.version}"


def state_schema(spec: CubeSpec) -> T.StructType:
    """Of the states of a spec; counts alone are never null."""
    kinds = {"sum": T.DoubleType(), "min": T.DoubleType(), "max": T.DoubleType(), "count": T.LongType()}
    fields = [T.StructField("bucket_start", T.TimestampType(), False), T.StructField("xunit_id", T.BinaryType(), False)]
    for m in spec.measures:
        if m.agg == "top_k":
            raise CubeError("top_k has no temporal state")
        fields.append(T.StructField(state_column(m), kinds.get(m.agg, T.BinaryType()), m.agg != "count"))
    return T.StructType(fields)


def canonical_column(layout: Layout) -> Column:
    """Canonical bytes of the cell, from its level columns."""

    def number(c: Column) -> Column:
        return F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))

    def sized(raw: bytes) -> bytes:
        return len(raw).to_bytes(4, "big") + raw

    none = F.lit(b"")
    paths, count = [], F.lit(0)
    for dim, names in zip(layout.spec.sorted_dimensions, layout.columns, strict=True):
        if not names:
            continue
        has = F.col(names[0]).isNotNull()
        count = count + has.cast("int")
        depth = F.lit(0)
        parts = []
        for level, c in zip(dim.levels, names, strict=False):
            depth = depth + F.col(c).isNotNull().cast("int")
            value = F.concat(F.lit(sized(level.name.encode()) + bytes([STRING])), number(F.octet_length(c)), F.col(c).cast("binary"))
            parts.append(F.when(F.col(c).isNotNull(), value).otherwise(none))
        paths.append(F.when(has, F.concat(F.lit(sized(dim.name.encode())), number(depth), *parts)).otherwise(none))
    return F.concat(F.lit(MAGIC + bytes([VERSION])), number(count), *paths)


@F.pandas_udf(T.BinaryType())
def content_ids(canonical: pd.Series) -> pd.Series:
    return pd.Series(blake3_many([bytes(b) for b in canonical]))


def state_value(m: Measure, exact: bool = False) -> Column:
    """The state of a cell's raw measure, as its column is stored."""
    c = F.col(m.name)
    if m.agg == "avg":
        return A.average_bytes(F.coalesce(c["total"], F.lit(0.0)), c["count"])
    if m.agg == "variance":
        return A.variance_bytes(c["count"], c["mean"], c["m2"])
    if m.agg == "quantile":
        return A.quantile_bytes(m.state["quantileBinWidth"])(c)
    if m.agg == "count_distinct":
        return S.kmv_bytes(m.state.get("kmvSize", S.WHOLE if exact else S.KMV_SIZE))(F.coalesce(c, F.array().cast("array<long>")))
    if m.agg == "reservoir_sample":
        return S.sample_bytes(m.state.get("sampleCapacity", S.SAMPLE_SIZE))(c)
    if m.agg == "centroid":
        return S.centroid_bytes(c["count"], c["sums"])
    return c


@dataclass
class TemporalBuild:
    """States, registry and raw cells of a build; ``coverage`` is (start, end, exact) or None where nothing was asked or found."""

    spec: CubeSpec
    states: DataFrame
    registry: DataFrame
    cells: DataFrame
    null_event_times: int
    coverage: tuple[int, int, bool] | None
    source: DataFrame

    def explain(self) -> dict:
        """Rows in, null times, generated cells, buckets, rows out."""
        cells = self.cells.agg(F.count("*").alias("n"), F.countDistinct("bucket_start").alias("b"), F.sum("__rows").alias("x")).first()
        return {"source_rows": self.source.count(), "null_event_times": self.null_event_times, "generated_xunits": cells["x"] or 0, "buckets": cells["b"], "output_rows": cells["n"]}


def build_temporal(spec: CubeSpec, source: DataFrame, window: Range | None = None, null_times: str = "reject", check: bool = True, ordered: bool = True, exact: bool = False) -> TemporalBuild:
    """The states of ``source``, of events in ``window`` if one is given.

    ``null_times``: ``reject`` fails if any row of the whole source has no event time; ``quarantine``
    leaves such rows out and counts them. ``exact``: states of distinct counts without a kmvSize hold all hashes, so they count exactly when merged. Coverage is the range from the first to the last bucket found, cut to the window; it is exact if that is the window, and says nothing of what lies between.
    """
    t = spec.temporal
    if t is None:
        raise CubeError("a temporal build needs a temporal section")
    if null_times not in ("reject", "quarantine"):
        raise CubeError("null_times is 'reject' or 'quarantine'")
    if not spec.measures:
        raise CubeError("a cube needs one measure or more")
    state_schema(spec)
    time = F.expr(t.event_time)
    kind = source.select(time.alias("t")).schema["t"].dataType
    if not isinstance(kind, T.TimestampType | T.TimestampNTZType):
        raise CubeError(f"event time {t.event_time!r} is a {kind.simpleString()}, not a timestamp")
    missing = source.where(time.isNull()).count()
    if missing and null_times == "reject":
        raise CubeError(f"{missing} rows have no event time; null_times='quarantine' leaves them out")
    layout = Layout.of(spec)
    rows = source.where(time.isNotNull())
    if window:
        edge = lambda at: F.timestamp_micros(F.lit(at)).cast(kind)
        rows = rows.where((time >= edge(window.start)) & (time < edge(window.end)))  # reaches the scan
    if check:
        guard(rows.select(*level_columns(layout)), layout)
    named = rows.withColumn("bucket_start", bucket_start(time, t.base, t.origin))
    counted = CubeSpec(spec.api_version, spec.name, spec.dimensions, spec.rules, (*spec.measures, Measure("__rows_", "count")), spec.include_global, t, spec.max_dictionary_entries)
    inputs = {m.name: (None if m.agg == "count" else F.expr(m.input), None) for m in counted.measures}
    cells = measure_cells(named, Layout(counted, layout.kept, layout.columns), ["bucket_start"], inputs, doubles=True, distinct="whole" if exact else "sketch")
    cells = cells.withColumnRenamed("__rows_", "__rows").withColumn("xunit_canonical", canonical_column(layout))
    registry = cells.select("xunit_canonical").distinct().withColumn("xunit_id", content_ids("xunit_canonical")).select("xunit_id", "xunit_canonical")
    states = cells.select("bucket_start", content_ids("xunit_canonical").alias("xunit_id"), *[state_value(m, exact).alias(state_column(m)) for m in spec.measures])
    if ordered:
        states = states.orderBy("bucket_start", "xunit_id")
    coverage = None
    if window:
        low, high = named.agg(F.unix_micros(F.min("bucket_start")), F.unix_micros(F.max("bucket_start"))).first()
        if low is not None:
            start, end = max(low, window.start), min(high + t.base, window.end)
            coverage = (start, end, (start, end) == (window.start, window.end))
    return TemporalBuild(spec, states, registry, cells, missing, coverage, source)


def write_fixtures(build: TemporalBuild, states_path: str, registry_path: str) -> None:
    """One file each, in order; for small builds that other tools read."""
    build.states.coalesce(1).write.mode("overwrite").parquet(states_path)
    build.registry.coalesce(1).write.mode("overwrite").parquet(registry_path)


def rollup_states(states: DataFrame, spec: CubeSpec, width: int) -> DataFrame:
    """States of base buckets merged to coarser ones: numbers as aggregates, averages as (sum, count), all others by their bytes.

    Bytes of a cell are gathered first: as many as there are base buckets (and stored parts) in a coarse one, each of a bounded size.
    """
    t = spec.temporal
    if width % t.base:
        raise CubeError("a rollup is a multiple of the base resolution")
    aggs, last = [], {}
    for m in spec.measures:
        c = state_column(m)
        if m.agg in ("sum", "count"):
            aggs.append(F.sum(c).alias(c))
        elif m.agg in ("min", "max"):
            aggs.append((F.min if m.agg == "min" else F.max)(c).alias(c))
        elif m.agg == "avg":
            aggs.append(F.struct(F.sum(f"__{c}.total").alias("total"), F.sum(f"__{c}.count").alias("count")).alias(c))
        else:
            aggs.append(F.collect_list(c).alias(c))
            last[c] = A.merge_all(c)
    parts = states.withColumns({f"__{state_column(m)}": A.average_parts(state_column(m)) for m in spec.measures if m.agg == "avg"} or {"__": F.lit(0)})
    return parts.groupBy(bucket_start(F.col("bucket_start"), width, t.origin).alias("bucket_start"), "xunit_id").agg(*aggs).withColumns(last)


def bucket_of(spec: CubeSpec, at: int) -> str:
    return show_time(bucket(at, spec.temporal.base, spec.temporal.origin).start)
