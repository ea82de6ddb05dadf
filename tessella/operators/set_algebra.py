"""Set algebra over the distinct-count sketches of a cube, neighbours by centroid, rates, and merges of cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CubeError
from ..functions import sketches as S
from ..xunits import GLOBAL

#: Cells of a slice that all-pairs takes; a slice is what a person reads, and its pairs grow with its square.
MOST_CELLS = 5000


def slice_of(dim: str, depth: int = 1, xunit: Column | None = None) -> Column:
    """Cells of one dimension alone, at one depth. Structural marks in values are scrubbed, so the text decides."""
    x = F.col("xunit") if xunit is None else xunit
    return x.startswith(f"/{dim}/") & ~x.contains(",") & (F.regexp_count(x, F.lit("=")) == depth)


def label_of(xunit: Column) -> Column:
    """The values of a cell, for people."""
    values = F.transform(F.regexp_extract_all(xunit, F.lit(r"=([^/,]*)"), F.lit(1)), lambda v: F.replace(F.replace(F.replace(v, F.lit("___"), F.lit("/")), F.lit("###"), F.lit("=")), F.lit("+++"), F.lit(",")))
    return F.when(xunit == GLOBAL, F.lit(GLOBAL)).otherwise(F.array_join(values, " / "))


def pair_algebra(pairs: DataFrame, a: str, b: str, k: int = S.KMV_SIZE, total: str | None = None) -> DataFrame:
    """Adds estimates of both sides (exact counts of whole sets if ``k`` is ``WHOLE``), union, intersection, jaccard and, given the population's hashes in ``total``, lift."""
    x, y = F.col(a), F.col(b)
    out = pairs.withColumns({"estimate_a": S.kmv_estimate(x, k), "estimate_b": S.kmv_estimate(y, k), "union_estimate": S.kmv_estimate(S.kmv_union(x, y, k), k), "intersection_estimate": S.kmv_intersection(x, y, k), "jaccard": S.kmv_jaccard(x, y, k)})
    lift = F.lit(None).cast("double")
    if total:
        inter = F.col("intersection_estimate")
        lift = F.when(F.col(total).isNull(), F.lit(None)).when(inter == 0, F.lit(0.0)).otherwise(inter * S.kmv_estimate(F.col(total), k) / (F.col("estimate_a") * F.col("estimate_b")))
    return out.withColumn("lift", lift)


def _small(cells: DataFrame) -> DataFrame:
    n = cells.limit(MOST_CELLS + 1).count()
    if n > MOST_CELLS:
        raise CubeError(f"more than {MOST_CELLS} cells: choose a coarser slice")
    return cells


def all_pairs(cells: DataFrame, measure: str, k: int = S.KMV_SIZE) -> DataFrame:
    """Overlap of each two cells of a slice (xunit, ``measure`` as hashes); global population for lift if ``/G`` is among them.

    Pairs are what is asked for here; the number of cells is checked first. One side is broadcast, being small by that check.
    """
    part = _small(cells.where(F.col("xunit") != GLOBAL).select("xunit", F.col(measure).alias("h")))
    whole = cells.where(F.col("xunit") == GLOBAL).select(F.col(measure).alias("g")).limit(1)
    left = part.select(F.col("xunit").alias("a"), F.col("h").alias("ha"), F.lit(1).alias("j"))
    right = part.select(F.col("xunit").alias("b"), F.col("h").alias("hb"), F.lit(1).alias("j"))
    both = left.join(F.broadcast(right), (left["j"] == right["j"]) & (left["a"] < right["b"])).select("a", "b", "ha", "hb", F.lit(1).alias("j"))
    both = both.join(F.broadcast(whole.withColumn("j", F.lit(1))), "j", "left")
    return pair_algebra(both, "ha", "hb", k, "g").drop("ha", "hb", "g", "j")


def set_ops(cells: DataFrame, a: str, b: str, measure: str, k: int = S.KMV_SIZE) -> DataFrame:
    """The algebra of two cells; no row if one is missing."""
    pick = lambda x, name: cells.where(F.col("xunit") == x).select(F.lit(1).alias("j"), F.col(measure).alias(name)).limit(1)
    row = pick(a, "ha").join(pick(b, "hb"), "j").join(pick(GLOBAL, "g"), "j", "left")
    return pair_algebra(row.withColumns({"a": F.lit(a), "b": F.lit(b)}), "ha", "hb", k, "g").drop("ha", "hb", "g", "j")


def cosine(v: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    size = sum(x * x for x in query) ** 0.5
    return F.when(norm * F.lit(size) == 0, F.lit(0.0)).otherwise(dot / (norm * F.lit(size)))


def nearest_cells(cells: DataFrame, centroid: str, query: list[float], k: int = 10, support: str | None = None, more_than: int = 0) -> DataFrame:
    """Cells whose mean vector points most nearly as ``query`` does, of those with more than so many in ``support``."""
    some = cells.where(F.col(centroid).isNotNull())
    if support:
        some = some.where(F.col(support) > more_than)
    return some.select("xunit", cosine(F.col(centroid), query).alias("similarity")).orderBy(F.desc("similarity"), "xunit").limit(k)


def rates(cells: DataFrame, measure: str, dim: str, attr: str, value: str) -> DataFrame:
    """For each cell without ``dim``: its ``measure``, that of the same cell with ``/dim/attr=value``, and their ratio."""
    from ..xunits import scrub

    mark = f"/{dim}/{attr}={scrub(value)}"
    parts = F.split("xunit", ",")
    hit = cells.where(F.array_contains(parts, mark)).select(F.array_join(F.array_remove(parts, mark), ",").alias("rest"), F.col(measure).alias("part"))
    hit = hit.withColumn("rest", F.when(F.col("rest") == "", F.lit(GLOBAL)).otherwise(F.col("rest")))
    whole = cells.where(~F.exists(parts, lambda p: p.startswith(f"/{dim}/")))
    return whole.join(hit, whole["xunit"] == hit["rest"], "left").select("xunit", F.col(measure).alias("whole"), F.coalesce("part", F.lit(0)).alias("part"), (F.coalesce("part", F.lit(0)) / F.col(measure)).alias("rate"))


def merge_cubes(parts: list[DataFrame], spec, presented: bool = True, quantile_width: float = 1.0, exact: bool = False) -> DataFrame:
    """Raw cubes (``build_cube(raw=True)``, all of them or none ``exact``) of disjoint rows, merged by cell: the cube of all rows together.

    Averages travel as (sum, count); hashes and bins as rows, so that no merged group stands in one place before it is cut.
    """
    from .cells import _ranked
    from .static_cube import present

    every = parts[0].select("xunit", *[m.name for m in spec.measures])
    for p in parts[1:]:
        every = every.unionByName(p.select("xunit", *[m.name for m in spec.measures]))
    aggs, frames = [], []
    for m in spec.measures:
        c = F.col(m.name)
        if m.agg in ("sum", "count"):
            aggs.append(F.sum(c).alias(m.name))
        elif m.agg in ("min", "max"):
            aggs.append((F.min if m.agg == "min" else F.max)(c).alias(m.name))
        elif m.agg == "avg":
            aggs.append(F.struct(F.sum(c["total"]).alias("total"), F.sum(c["count"]).alias("count")).alias(m.name))
        elif m.agg == "variance":
            n, s = F.sum(c["count"]), F.sum(c["count"] * c["mean"])
            m2 = F.sum(c["m2"] + c["count"] * c["mean"] * c["mean"]) - F.when(n > 0, s * s / n).otherwise(F.lit(0.0))
            aggs.append(F.struct(n.alias("count"), F.when(n > 0, s / n).otherwise(F.lit(0.0)).alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2")).alias(m.name))
        elif m.agg == "centroid":
            flat = every.select("xunit", F.posexplode(c["sums"]).alias("i", "x")).groupBy("xunit", "i").agg(F.sum("x").alias("x"))
            sums = flat.groupBy("xunit").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("__s"))
            count = every.groupBy("xunit").agg(F.sum(c["count"]).alias("__n"))
            frames.append(count.join(sums, "xunit", "left").select("xunit", F.struct(F.col("__n").alias("count"), F.col("__s").alias("sums")).alias(m.name)))
        elif m.agg == "quantile":
            bins = every.select("xunit", F.explode(c).alias("b")).groupBy("xunit", F.col("b.bin").alias("bin")).agg(F.sum("b.n").alias("n"))
            frames.append(bins.groupBy("xunit").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias(m.name)))
        elif m.agg == "top_k":
            items = every.select("xunit", F.explode(c).alias("i")).groupBy("xunit", F.col("i.key").alias("key")).agg(F.sum("i.score").alias("score"))
            cut = _ranked(items, ["xunit"], [F.desc("score"), F.col("key")], S.TOP_K_SIZE)
            frames.append(cut.groupBy("xunit").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "key", "score"))), lambda e: F.struct(e["key"].alias("key"), e["score"].alias("score"))).alias(m.name)))
        else:
            most = m.state.get("kmvSize", S.WHOLE if exact else S.KMV_SIZE) if m.agg == "count_distinct" else m.state.get("sampleCapacity", S.SAMPLE_SIZE)
            items = every.select("xunit", F.explode(c).alias("h")).distinct()
            cut = _ranked(items, ["xunit"], [F.col("h")], most)
            frames.append(cut.groupBy("xunit").agg(F.array_sort(F.collect_list("h")).alias(m.name)))
    out = every.groupBy("xunit").agg(*aggs) if aggs else every.select("xunit").distinct()
    for f in frames:
        out = out.join(f, "xunit", "left")
    out = out.select("xunit", *[m.name for m in spec.measures])
    return out.select("xunit", *[c for m in spec.measures for c in present(m, quantile_width, exact)]) if presented else out
