"""Static cubes: one row per cell, with presented measures and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions import sketches as S
from ..spec import CubeSpec, Measure
from .cells import Layout, guard, level_columns, measure_cells, xunit_text


def quantile_of(bins: Column, width: float, p: float = 0.5) -> Column:
    """Midpoint of the bin that holds rank floor((n - 1) * p)."""
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda a, b: a + b["n"])
    rank = F.floor((total - 1) * F.lit(p))
    at = F.aggregate(
        bins,
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
        lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.when(a["bin"].isNull() & (a["seen"] + b["n"] > rank), b["bin"]).otherwise(a["bin"]).alias("bin")),
    )["bin"]
    return (at + 0.5) * F.lit(width)


def variance_json(v: Column) -> Column:
    sample = F.when(v["count"] > 1, v["m2"] / (v["count"] - 1))
    text = F.to_json(F.struct(v["count"].alias("count"), v["mean"].alias("mean"), (v["m2"] / v["count"]).alias("populationVariance"), sample.alias("sampleVariance")), {"ignoreNullFields": "false"})
    return F.when(v["count"] > 0, text)


def present(m: Measure, width: float = 1.0, exact: bool = False, counted: bool = False) -> list[Column]:
    """The output columns of a measure; sketches give two, the value and the bytes. Bytes of a distinct count hold 1024 hashes or the spec's kmvSize. ``exact``: the hashes are whole sets; ``counted``: exact counts are in a column of their own."""
    c, empty = F.col(m.name), F.array()
    if m.agg == "avg":
        return [F.when(c["count"] > 0, c["total"] / c["count"]).alias(m.name)]
    if m.agg == "variance":
        return [variance_json(c).alias(m.name)]
    if m.agg == "quantile":
        return [quantile_of(c, width).alias(m.name)]
    if m.agg == "count_distinct":
        k, most = m.state.get("kmvSize", S.KMV_SIZE), m.state.get("kmvSize", S.WHOLE if exact else S.KMV_SIZE)
        h = F.coalesce(c, empty.cast("array<long>"))
        value = F.coalesce(f"{m.name}__count", F.lit(0)).cast("double") if counted and "kmvSize" not in m.state else S.kmv_estimate(h, most)
        return [value.alias(m.name), S.kmv_bytes(k)(F.slice(h, 1, k)).alias(f"{m.name}__sketch")]
    if m.agg == "top_k":
        items = F.coalesce(c, empty.cast("array<struct<key:string,score:double>>"))
        return [S.topk_json(items).alias(m.name), S.topk_bytes(S.TOP_K_SIZE)(items).alias(f"{m.name}__sketch")]
    if m.agg == "reservoir_sample":
        cap = m.state.get("sampleCapacity", S.SAMPLE_SIZE)
        items = F.coalesce(c, empty.cast("array<struct<h:bigint,v:string>>"))
        return [F.to_json(F.transform(items, lambda i: i["v"])).alias(m.name), S.sample_bytes(cap)(items).alias(f"{m.name}__sketch")]
    if m.agg == "centroid":
        mean = F.transform(c["sums"], lambda x: x / c["count"])
        return [F.when(c["count"] > 0, mean).alias(m.name), S.centroid_bytes(c["count"], c["sums"]).alias(f"{m.name}__sketch")]
    return [c]


def build_cube(spec: CubeSpec, source: DataFrame, strict: bool = False, quantile_width: float = 1.0, check: bool = True, raw: bool = False, exact: bool = False) -> DataFrame:
    """The cube of ``source``: ``xunit`` and the measures, sketches with their bytes as ``{name}__sketch``.

    ``strict`` refuses variance and quantile, which specs of version v1 may name but not build;
    otherwise quantiles use bins of ``quantile_width``. ``check``: count distinct strings against the
    spec's bound first. ``raw``: measures as mergeable structs and arrays, with level columns, for further plans.
    ``exact``: distinct counts are exact where the spec names no kmvSize, and whole sets of hashes if ``raw``; else estimates of their sketches.
    """
    if not spec.measures:
        raise CubeError("a cube needs one measure or more")
    if strict and any(m.agg in ("variance", "quantile") for m in spec.measures):
        raise CubeError("variance and quantile are for temporal cubes")
    layout = Layout.of(spec)
    if not layout.kept:
        raise CubeError("the rules keep no cell")
    if check:
        guard(source.select(*level_columns(layout)), layout)
    inputs = {m.name: (None if m.agg == "count" else F.expr(m.input), None if m.by is None else F.expr(m.by)) for m in spec.measures}
    cells = measure_cells(source, layout, [], inputs, widths={m.name: quantile_width for m in spec.measures if m.agg == "quantile" and "quantileBinWidth" not in m.state}, distinct=("whole" if raw else "count") if exact else "sketch")
    named = cells.withColumn("xunit", xunit_text(layout))
    if raw:
        return named.select("xunit", *layout.flat, *[m.name for m in spec.measures])
    width = lambda m: m.state.get("quantileBinWidth", quantile_width)
    return named.select("xunit", *[c for m in spec.measures for c in present(m, width(m), counted=exact)])


def show_cube(cube: DataFrame, first_measure: str | None = None, limit: int = 10) -> DataFrame:
    """What a terminal shows: no sketch bytes, highest first measure first."""
    plain = cube.drop(*[c for c in cube.columns if c.endswith("__sketch")])
    by = first_measure or next((c for c in plain.columns if c != "xunit"), "xunit")
    return plain.orderBy(F.desc_nulls_last(by), "xunit").limit(limit)
