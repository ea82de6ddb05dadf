"""From rows to cells: the one grouped pass that static and temporal cubes share.

Rows are first aggregated to base tuples (all levels in use), with states that merge;
tuples are then grouped by GROUPING SETS, one set for each shape that the
rules keep. So Expand multiplies tuples, not rows. Measures that need more than a merge of numbers
(sample, top_k, quantile) go the same way with their own key, and are cut to size by a
rank that Spark also limits before the shuffle; distinct counts have a reduction of their own (``bottom_k``). All parts meet in one more aggregation by cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions.sketches import KMV_SIZE, SAMPLE_SIZE, TOP_K_SIZE, WHOLE, value_hash
from ..plans.shapes import Depths, shapes
from ..spec import CubeSpec, Measure
from ..xunits import GLOBAL, SCRUB
from .bottom_k import bottom_k_cells

#: Grouping sets in one pass; more shapes go in several passes.
SETS_AT_ONCE = 48


@dataclass(frozen=True)
class Layout:
    """Where levels stand: column names by dimension, and the kept shapes."""

    spec: CubeSpec
    kept: list[Depths]
    columns: list[list[str]]  # by sorted dimension, outermost level first; only levels that some shape uses

    @classmethod
    def of(cls, spec: CubeSpec) -> Layout:
        kept = shapes(spec)
        deep = [max((k[i] for k in kept), default=0) for i in range(len(spec.dimensions))]
        return cls(spec, kept, [[f"__d{i}_l{j}" for j in range(n)] for i, n in enumerate(deep)])

    @property
    def flat(self) -> list[str]:
        return [c for cs in self.columns for c in cs]

    def members(self, depths: Depths) -> list[str]:
        return [c for cs, n in zip(self.columns, depths, strict=True) for c in cs[:n]]

    def deepest(self, depths: Depths) -> list[str]:
        return [cs[n - 1] for cs, n in zip(self.columns, depths, strict=True) if n]


def level_columns(layout: Layout) -> list[Column]:
    """Levels as text, cut off at the first null of their hierarchy."""
    out = []
    for dim, names in zip(layout.spec.sorted_dimensions, layout.columns, strict=True):
        exprs = [F.expr(x.sql).cast("string") for x in dim.levels[: len(names)]]
        for j, name in enumerate(names):
            value = exprs[j]
            for above in reversed(exprs[:j]):
                value = F.when(above.isNotNull(), value)
            out.append(value.alias(name))
    return out


def xunit_text(layout: Layout) -> Column:
    """The cell's name from its level columns: a level is null just where the cell is not drilled down to it."""

    def safe(c: str) -> Column:
        out = F.col(c)
        for raw, mark in SCRUB:
            out = F.replace(out, F.lit(raw), F.lit(mark))
        return out

    paths = []
    for dim, names in zip(layout.spec.sorted_dimensions, layout.columns, strict=True):
        if names:
            parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"/{x.name}="), safe(c))).otherwise(F.lit("")) for x, c in zip(dim.levels, names, strict=False)]
            paths.append(F.when(F.col(names[0]).isNotNull(), F.concat(F.lit(f"/{dim.name}"), *parts)))
    text = F.concat_ws(",", *paths) if paths else F.lit("")
    return F.when(text == "", F.lit(GLOBAL)).otherwise(text)


def to_cells(tuples: DataFrame, layout: Layout, extra: list[str], aggs: list[Column], only: list[str] | None = None) -> DataFrame:
    """Tuples to cells: level columns and ``extra`` keys (in every set), with ``aggs``. Groups whose deepest level is null belong to a shallower shape and are dropped."""
    flat, parts = layout.flat, []
    keys = [*extra, *flat]
    for at in range(0, len(layout.kept), SETS_AT_ONCE):
        some = layout.kept[at : at + SETS_AT_ONCE]
        sets = [[*extra, *layout.members(k)] for k in some]
        if keys:
            grouped = tuples.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(*aggs, F.grouping_id().alias("__gid"))
        else:
            grouped = tuples.groupBy().agg(*aggs, F.count(F.lit(1)).alias("__rows")).where("__rows > 0").drop("__rows").withColumn("__gid", F.lit(0))
        keep = F.lit(False)
        for k, s in zip(some, sets, strict=True):
            gid = sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in s)
            ok = F.col("__gid") == gid
            for c in layout.deepest(k):
                ok = ok & F.col(c).isNotNull()
            keep = keep | ok
        parts.append(grouped.where(keep).drop("__gid"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def guard(base: DataFrame, layout: Layout) -> None:
    """Fails if the names and level values of kept cells are more than the spec's maxDictionaryEntries. Stops counting just beyond it."""
    spec, names = layout.spec, set()
    for k in layout.kept:
        for d, n in zip(spec.sorted_dimensions, k, strict=True):
            names |= {d.name, *(x.name for x in d.levels[:n])} if n else set()
    most = spec.max_dictionary_entries
    if layout.flat:
        values = base.select(*layout.flat).distinct().select(F.explode(F.array(*layout.flat)).alias("v")).where("v IS NOT NULL").distinct().limit(most + 1)
        found = len(names) + values.where(~F.col("v").isin(sorted(names))).count()
    else:
        found = len(names)
    if found > most:
        raise CubeError(f"cube {spec.name!r} holds more than {most} distinct strings (maxDictionaryEntries): bucket or drop a level of many values")


def _finite(x: Column, m: Measure) -> Column:
    bad = x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"measure {m.name!r} takes finite numbers only")).cast("double")).otherwise(x)


def _ranked(cells: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return cells.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most)


def measure_cells(base: DataFrame, layout: Layout, extra: list[str], inputs: dict[str, tuple[Column, Column | None]], doubles: bool = False, widths: dict[str, float] | None = None, distinct: str = "sketch") -> DataFrame:
    """One row per cell with a column ``m`` for each measure ``m``: numbers for scalars, else structs and arrays that the presenters take. Distinct counts hold the
    least hashes of a cell, 1024 or the spec's kmvSize. Where the spec names no kmvSize, ``distinct`` may ask for more: ``count`` adds ``m__count``, the exact count, by groups of values; ``whole`` holds all hashes (8 bytes each, in one task).

    ``inputs``: the input and by columns of each measure; ``doubles``: numbers are made doubles first, as temporal states need.
    """
    spec, keys = layout.spec, [*extra, *layout.flat]
    picked = [*[F.col(c) for c in extra], *level_columns(layout)]
    for i, m in enumerate(spec.measures):
        x, by = inputs[m.name]
        if m.agg in ("avg", "variance", "quantile") or doubles and m.agg in ("sum", "min", "max"):
            x = x.cast("double")
        if m.agg in ("avg", "variance", "quantile"):
            x = _finite(x, m)
        if m.agg in ("count_distinct", "reservoir_sample", "top_k"):
            x = x.cast("string")
        if m.agg == "centroid":
            x = x.cast("array<double>")
        picked.append((F.lit(1) if x is None else x).alias(f"__x{i}"))
        if by is not None:
            picked.append(by.cast("double").alias(f"__y{i}"))
    rows = base.select(*picked)
    frames, first, merged = [], [F.count(F.lit(1)).alias("__rows")], [F.sum("__rows").alias("__rows")]
    scalar: list[tuple[str, Column]] = []
    for i, m in enumerate(spec.measures):
        x = F.col(f"__x{i}")
        if m.agg == "count":
            scalar.append((m.name, F.col("__rows")))
        elif m.agg in ("sum", "min", "max"):
            f = {"sum": F.sum, "min": F.min, "max": F.max}[m.agg]
            first.append(f(x).alias(f"__a{i}"))
            merged.append(f(f"__a{i}").alias(f"__a{i}"))
            scalar.append((m.name, F.col(f"__a{i}")))
        elif m.agg in ("avg", "variance"):
            first += [F.count(x).alias(f"__n{i}"), F.sum(x).alias(f"__s{i}")]
            merged += [F.sum(f"__n{i}").alias(f"__n{i}"), F.sum(f"__s{i}").alias(f"__s{i}")]
            if m.agg == "avg":
                scalar.append((m.name, F.struct(F.col(f"__s{i}").alias("total"), F.col(f"__n{i}").alias("count"))))
            else:  # pairwise merge of squared differences, written as sums over the merged tuples
                first += [(F.var_pop(x) * F.count(x)).alias(f"__q{i}")]
                merged += [F.sum(F.coalesce(f"__q{i}", F.lit(0.0)) + F.when(F.col(f"__n{i}") > 0, F.col(f"__s{i}") * F.col(f"__s{i}") / F.col(f"__n{i}")).otherwise(F.lit(0.0))).alias(f"__q{i}")]
                mean = F.when(F.col(f"__n{i}") > 0, F.col(f"__s{i}") / F.col(f"__n{i}")).otherwise(F.lit(0.0))
                m2 = F.greatest(F.col(f"__q{i}") - F.col(f"__n{i}") * mean * mean, F.lit(0.0))
                scalar.append((m.name, F.struct(F.col(f"__n{i}").alias("count"), mean.alias("mean"), F.when(F.col(f"__n{i}") > 1, m2).otherwise(F.lit(0.0)).alias("m2"))))
        elif m.agg == "centroid":
            low, high = rows.where(x.isNotNull()).agg(F.min(F.size(x)), F.max(F.size(x))).first()
            if low != high:
                raise CubeError(f"measure {m.name!r}: vectors of {low} and {high} elements")
            names = [f"__v{i}_{j}" for j in range(high or 0)]
            first += [F.count(x).alias(f"__n{i}"), *[F.sum(F.when(x.isNotNull(), F.coalesce(x[j], F.lit(0.0)))).alias(n) for j, n in enumerate(names)]]
            merged += [F.sum(f"__n{i}").alias(f"__n{i}"), *[F.sum(n).alias(n) for n in names]]
            sums = F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<double>")
            scalar.append((m.name, F.struct(F.col(f"__n{i}").alias("count"), F.when(F.col(f"__n{i}") > 0, sums).alias("sums"))))
        elif m.agg == "count_distinct":
            sets = [([*extra, *layout.members(k)], layout.deepest(k)) for k in layout.kept]
            frames.append((m.name, bottom_k_cells(rows, f"__x{i}", extra, layout.flat, sets, m.state.get("kmvSize", WHOLE if distinct == "whole" else KMV_SIZE), m.name)))
            if distinct == "count" and "kmvSize" not in m.state:
                name = f"{m.name}__count"
                seen = to_cells_of(rows.where(x.isNotNull()).select(*keys, x.alias("v")).distinct(), layout, extra, ["v"])
                frames.append((name, seen.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > 0)))
        elif m.agg == "reservoir_sample":
            most = m.state.get("sampleCapacity", SAMPLE_SIZE)
            seen = rows.where(x.isNotNull()).select(*keys, x.alias("v")).distinct()
            values = seen.select("v").distinct().withColumn("h", value_hash("v"))  # Python sees each value once
            hashed, what = seen.join(values, "v").select(*keys, "h", "v"), ["h", "v"]
            tuples = _ranked(hashed, keys, [F.col(w) for w in what], most) if keys else hashed
            cells = to_cells_of(tuples, layout, extra, what)
            cut = _ranked(cells, keys or ["__one"], [F.col(w) for w in what], most)
            frames.append((m.name, cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", "v"))).alias(m.name))))
        elif m.agg == "top_k":
            summed = rows.where(x.isNotNull() & F.col(f"__y{i}").isNotNull()).groupBy(*keys, x.alias("key")).agg(F.sum(f"__y{i}").alias("score"))
            cells = to_cells_of(summed, layout, extra, ["key"], [F.sum("score").alias("score")])
            cut = _ranked(cells, keys or ["__one"], [F.desc("score"), F.col("key")], TOP_K_SIZE)
            items = F.transform(F.array_sort(F.collect_list(F.struct("__rank", "key", "score"))), lambda s: F.struct(s["key"].alias("key"), s["score"].alias("score")))
            frames.append((m.name, cut.groupBy(*keys).agg(items.alias(m.name))))
        elif m.agg == "quantile":
            width = (widths or {}).get(m.name, m.state.get("quantileBinWidth", 1.0))
            binned = rows.where(x.isNotNull()).groupBy(*keys, F.floor(x / F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            cells = to_cells_of(binned, layout, extra, ["bin"], [F.sum("n").alias("n")])
            frames.append((m.name, cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias(m.name))))
    tuples = rows.groupBy(*keys).agg(*first) if keys else rows.agg(*first).where("__rows > 0")
    main = to_cells(tuples, layout, extra, merged).select(*keys, "__rows", *[c.alias(n) for n, c in scalar])
    if not frames:
        return main.select(*keys, *[m.name for m in spec.measures])
    every = main
    for _, f in frames:
        every = every.unionByName(f, allowMissingColumns=True)
    merged_names = [m.name for m in spec.measures]
    merged_names += [n for n, _ in frames if n not in merged_names]
    return every.groupBy(*keys).agg(F.max("__rows").alias("__rows"), *[F.first(n, ignorenulls=True).alias(n) for n in merged_names]).select(*keys, *merged_names)


def to_cells_of(tuples: DataFrame, layout: Layout, extra: list[str], what: list[str], aggs: list[Column] | None = None) -> DataFrame:
    """Cells with a further key: each (cell, ``what``) once."""
    out = to_cells(tuples, layout, [*extra, *what], aggs or [F.count(F.lit(1)).alias("__rows")])
    return out.drop("__rows").withColumn("__one", F.lit(1)) if aggs is None else out.withColumn("__one", F.lit(1))
