"""Rows of the temporal benchmark, their four physical layouts, range reads, and a digest of what they mean."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blake3 import blake3

#: Hourly buckets from 2026-01-01 and the constants of SplitMix64.
BUCKETS, BASE, HOUR = 168, 1_767_225_600_000_000, 3_600_000_000
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def splitmix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def bench_rows(spark: SparkSession, rows: int, seed: int = 42, dense: bool = False) -> DataFrame:
    """bucket_start, region, device, amount, entity_id; each row depends on its number alone, so any executor can make it again."""
    fields = [T.StructField(n, T.LongType()) for n in ("b", "r", "d", "a", "e")]

    @F.pandas_udf(T.StructType(fields))
    def numbers(ids: pd.Series) -> pd.DataFrame:
        row = ids.to_numpy().astype(np.uint64)
        x = splitmix64(row ^ np.uint64(seed))
        if dense:
            parts = row % np.uint64(BUCKETS), row // np.uint64(BUCKETS) % np.uint64(256), row // np.uint64(17) % np.uint64(8), row * np.uint64(13) % np.uint64(10_000)
        else:
            parts = x % np.uint64(BUCKETS), _turn(x, 17) % np.uint64(50_000), _turn(x, 31) % np.uint64(8), _turn(x, 43) % np.uint64(200_000)
        b, r, d, e = (p.astype(np.int64) for p in parts)
        return pd.DataFrame({"b": b, "r": r, "d": d, "a": (x % np.uint64(97)).astype(np.int64) + 1, "e": e})

    n = spark.range(rows).select(numbers("id").alias("n"))
    return n.select(
        F.timestamp_micros(F.lit(BASE) + F.col("n.b") * F.lit(HOUR)).alias("bucket_start"), F.format_string("region_%05d", "n.r").alias("region"),
        F.format_string("device_%d", "n.d").alias("device"), F.col("n.a").alias("amount"), F.format_string("entity_%06d", "n.e").alias("entity_id"),
    )


def layouts(states: DataFrame, registry: DataFrame, measures: list[str]) -> dict[str, DataFrame]:
    """Four ways to store the same cells: a row per measure, a row per cell, a row of tagged structs, and ids with a registry apart."""
    named = states.join(registry, "xunit_id")
    keys = ["bucket_start", "xunit_id", "xunit_canonical"]
    text = lambda m: F.when(F.col(m).isNotNull(), F.hex(F.col(m).cast("binary")) if dict(states.dtypes)[m] == "binary" else F.col(m).cast("string"))
    per = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), text(m).alias("state")) for m in measures]))
    return {
        "per_measure": named.select(*keys, per.alias("x")).select(*keys, "x.measure", "x.state"),
        "wide": named.select(*keys, *measures),
        "tagged_struct": named.select(*keys, F.array(*[F.struct(F.lit(m).alias("tag"), text(m).alias("state")) for m in measures]).alias("states")),
        "registry_states": states.select("bucket_start", "xunit_id", *measures),
        "xunit_registry": registry.distinct(),
    }


def write_layouts(states: DataFrame, registry: DataFrame, measures: list[str], path: str, partitions: int | None = None) -> None:
    for name, df in layouts(states, registry, measures).items():
        order = [c for c in ("bucket_start", "xunit_id") if c in df.columns]
        if "bucket_start" in order:  # neighbours in time share row groups, so a range reads few of them
            df = (df.repartitionByRange(partitions, "bucket_start") if partitions else df.repartitionByRange("bucket_start")).sortWithinPartitions(*order)
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows of a half-open range; the bounds reach the Parquet scan and skip row groups by their statistics."""
    return spark.read.parquet(path).where((F.col("bucket_start") >= F.timestamp_micros(F.lit(start))) & (F.col("bucket_start") < F.timestamp_micros(F.lit(end))))


def digest(states: DataFrame, measures: list[str], domain: bytes = b"states-v1") -> str:
    """Of the cells in order of time and id. Spark sorts and hashes each row with SHA-256; the driver folds one hash per day and then the days."""
    doubles = [F.coalesce(F.hex(F.col(m).cast("binary")) if t == "binary" else F.col(m).cast("string"), F.lit("~")) for m, t in states.dtypes if m in measures]
    row = F.sha2(F.concat_ws("|", F.unix_micros("bucket_start").cast("string"), F.hex("xunit_id"), *doubles), 256)
    days = states.select(F.to_date("bucket_start").alias("day"), F.unix_micros("bucket_start").alias("b"), F.hex("xunit_id").alias("i"), row.alias("h"))
    per_bucket = days.groupBy("day", "b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    out = blake3(domain)
    for r in per_bucket.orderBy("b").toLocalIterator():
        out = blake3(out + struct.pack("<q", r["b"]) + bytes.fromhex(r["h"]))
    return out.hex()
