"""Sources and sinks: Parquet, CSV, tables and subqueries, batches in memory; cubes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import CubeError


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header by its suffix, else Parquet; schemas are inferred."""
    if path.lower().endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def source_of(spark: SparkSession, source: str | DataFrame, **tables: DataFrame) -> DataFrame:
    """A DataFrame, the name of a table, or the text of a subquery over ``tables`` and what the session knows."""
    if isinstance(source, DataFrame):
        return source
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    text = source.strip()
    if text.lower().startswith(("select", "with", "(")):
        return spark.sql(text[1:-1] if text.startswith("(") and text.endswith(")") else text)
    return spark.table(text)


def from_batches(spark: SparkSession, batches, schema=None) -> DataFrame:
    """Rows, pandas or Arrow data in memory."""
    return spark.createDataFrame(batches, schema) if schema else spark.createDataFrame(batches)


def write_cube(cube: DataFrame, path: str, overwrite: bool = True) -> None:
    if "xunit" not in cube.columns and "xunit_id" not in cube.columns:
        raise CubeError("not a cube: it has no cells")
    cube.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def to_arrow(cube: DataFrame):
    """The whole result as an Arrow table on the driver: for cubes that a person reads."""
    return cube.toArrow()
