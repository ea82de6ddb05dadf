"""Streams into temporal cubes: partial states per micro-batch, merged by (bucket, cell) when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import show_resolution
from ..operators.temporal_cube import build_temporal, rollup_states
from ..spec import CubeSpec

def partial_states(spec: CubeSpec, path: str):
    """A function for ``foreachBatch``: the batch's states under its number, so a batch that is played again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        build = build_temporal(spec, batch, None, "quarantine", check=False, ordered=False)
        build.states.write.mode("overwrite").parquet(f"{path}/batch={number}/states")
        build.registry.write.mode("overwrite").parquet(f"{path}/batch={number}/registry")

    return run


def start(stream: DataFrame, spec: CubeSpec, path: str, checkpoint: str, once: bool = True):
    """Starts the query; with ``once`` it takes what there is and ends."""
    writer = stream.writeStream.foreachBatch(partial_states(spec, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged_states(spark, spec: CubeSpec, path: str) -> DataFrame:
    """All batches merged, whatever their states: a row per bucket and cell."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(_schema(spec)).parquet(f"{path}/*/states")
    return rollup_states(rows, spec, spec.temporal.base)


def _schema(spec: CubeSpec):
    from ..operators.temporal_cube import state_schema

    return state_schema(spec)


def windowed(stream: DataFrame, spec: CubeSpec, keys: list[str]) -> DataFrame:
    """Counts per bucket and keys with a watermark of the allowed lateness: rows that come later are dropped by Spark."""
    t = spec.temporal
    late = f"{t.lateness} microseconds"
    window = F.window(F.expr(t.event_time), f"{t.base} microseconds", None, f"{t.origin % t.base} microseconds" if t.origin % t.base else None)
    return stream.withWatermark(t.event_time, late).groupBy(window, *keys).agg(F.count("*").alias("n"))


def describe(spec: CubeSpec) -> str:
    return f"buckets of {show_resolution(spec.temporal.base)}, rows late by {spec.temporal.lateness} us at most"
