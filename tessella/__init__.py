"""Declarative cubes on Spark: a spec of dimensions, rules and measures becomes one grouped plan."""

from __future__ import annotations

from .errors import CubeError, SpecError
from .functions.sketches import KmvSketch, SampleSketch, TopKSketch
from .spec import CubeSpec
from .xunits import XUnit, YPath


def validate_spec(text: str) -> str:
    """A spec in YAML, checked; returns its name. Raises SpecError with every problem."""
    return CubeSpec.from_yaml(text).name


def build_cube(text: str, path: str, spark=None):
    """The cube of a spec in YAML over a Parquet or CSV file, as an Arrow table."""
    from pyspark.sql import SparkSession

    from .operators.static_cube import build_cube as build
    from .sources.tables import read_source, to_arrow

    session = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return to_arrow(build(CubeSpec.from_yaml(text), read_source(session, path)))


def topk_items(raw: bytes) -> list[tuple[str, float]]:
    return TopKSketch.from_bytes(raw).items


def sample_values(raw: bytes) -> list[str]:
    return SampleSketch.from_bytes(raw).values


__all__ = ["CubeError", "CubeSpec", "KmvSketch", "SampleSketch", "SpecError", "TopKSketch", "XUnit", "YPath", "build_cube", "sample_values", "topk_items", "validate_spec"]
