"""What several operators share: the shared folder, word splitting, components of a graph."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, as the session names it. Only a session on one machine (tests) may name none; one is made for it here."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for columns of an operator's own that differ from all ``taken`` ones, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        made = f"__{name}"
        while made.lower() in used:
            made += "_"
        used.add(made.lower())
        out.append(made)
    return out


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it back: lineage ends there, so a lost executor costs a read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
    out._stored_at = path
    return out


def store_dealt(df: DataFrame, name: str, by: str, key: str, buckets: int) -> DataFrame:
    """As ``store``, in ``buckets`` by a hash of ``key``: what is later grouped by that key need not be shuffled again."""
    spark, label = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{label}"
    df.write.partitionBy(by).bucketBy(buckets, key).option("path", path).saveAsTable(label, format="parquet")
    out = spark.table(label).select(*df.columns)
    out._stored_at, out._label = path, label
    return out


def drop(df: DataFrame, part: str = "") -> None:
    """Delete what ``store`` wrote, or the folder ``part`` of it (``column=value``); nothing lazy may still read it."""
    path, spark = getattr(df, "_stored_at", None), df.sparkSession
    if getattr(df, "_label", None) and not part:
        spark.sql(f"DROP TABLE IF EXISTS {df._label}")
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def tidy(spark: SparkSession) -> None:
    """Files of shuffles that nothing refers to any more go; Spark deletes them when the driver has collected their last reference."""
    gc.collect()
    spark._jvm.System.gc()


def executors_tidy(spark: SparkSession) -> None:
    """The JVM of every executor that stands idle collects its garbage and returns free heap to the system: else it keeps what earlier work has touched, beside the Python workers of the next.

    One task for each of them (the driver counts as one, where it has tasks of its own); Spark deals tasks of one stage to free executors in turn.
    """
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def give_back() -> None:
    """In a Python worker: memory that is free but still held goes back to the system, so that the next task finds it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def ascii_lower(col):
    """Lower-cases A-Z alone."""
    return F.translate(col, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: of one orderable type) as (node, root), root the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) as joins on
    a minimum per node: minima are combined map-side and a node of huge degree is
    a skewed join that adaptive execution splits. Nulls and loops are dropped; an
    empty input gives an empty result. Ends when no edge changes, after a number of rounds that grows with the logarithm of the nodes.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, before = store(e, "cc"), None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = store(small.distinct(), "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(cur)
        cur = new
        if now == before:
            break
        before = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def whole_groups(batches, keys: list[str]):
    """From batches sorted by ``keys``: frames of whole groups, one or more at a time."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf.iloc[-1]
        inside = pdf[keys].eq(last[keys]).all(axis=1).to_numpy()
        first = len(pdf) - int(inside[::-1].cumprod().sum())
        if first:
            yield pd.concat([*held, pdf.iloc[:first]], ignore_index=True)
            held = [pdf.iloc[first:]]
        elif held and not held[-1].iloc[-1][keys].equals(last[keys]):
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


#: 64-bit cells of a filter of keys: 4 MB in a broadcast join, at any size of the input.
FILTER_CELLS = 1 << 18


def split_by(docs: DataFrame, keys: DataFrame, doc_id: str = "doc_id", th: str = "th") -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose key may be in ``keys`` (doc_id, th), and those whose key surely is not: these need no join and never leave their task.

    One bit per key in a table of at most FILTER_CELLS rows, which is what is broadcast.
    """
    cell, bit = lambda h: F.pmod(h, F.lit(FILTER_CELLS)), lambda h: F.shiftrightunsigned(h, 48).bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64("doc_id", "th")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit(h))
    at, where, bits = fresh(docs.columns, "at", "cell", "bits")
    cells = store(keys.groupBy(cell(h).alias(where)).agg(F.bit_or(mask).alias(bits)), "filter")
    own = F.xxhash64(doc_id, th)
    marked = docs.withColumn(at, cell(own)).join(F.broadcast(cells), F.col(at) == F.col(where), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(bits), bit(own)).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get this many rows at once: batches of long texts stay small. Holds for the session, until ``settings_kept`` ends."""
    spark.conf.set(_BATCH, rows)


@contextmanager
def settings_kept(spark: SparkSession):
    """Afterwards the session has the settings it had before."""
    before = spark.conf.get(_BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
