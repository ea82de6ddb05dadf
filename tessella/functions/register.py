"""Stored sketches and states in SQL: presenters of their bytes, merges as aggregates, buckets, and ids of cells.

Presenters run once per cell. The merging aggregates gather a group's bytes, which have a bounded size each; a build never needs them, since its
plans merge numbers and arrays. They are for stored cubes, where a group is a handful of parts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..xunits import XUnit
from .encoding import canonical_bytes, content_id
from .sketches import CentroidSketch, KmvSketch, SampleSketch, TopKSketch
from .states import AverageState, QuantileState, VarianceState


def _presenter(kind, show, result):
    @F.pandas_udf(result)
    def present(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else show(kind.from_bytes(bytes(b))) for b in blobs], dtype=object)

    return present


def _merger(kind):
    def merge(blobs: pd.Series) -> bytes:
        out = None
        for b in blobs:
            if b is not None:
                one = kind.from_bytes(bytes(b))
                out = one if out is None else out.merge(one)
        return None if out is None else out.to_bytes()

    merge.__annotations__ = {"blobs": pd.Series, "return": bytes}
    return F.pandas_udf(merge, T.BinaryType(), F.PandasUDFType.GROUPED_AGG)


def _of_cell(make):
    @F.pandas_udf(T.BinaryType())
    def encode(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else make(XUnit.parse(x)))

    return encode


@F.pandas_udf(T.DoubleType())
def quantile_at(blobs: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else QuantileState.from_bytes(bytes(b)).quantile(q) for b, q in zip(blobs, p, strict=True)], dtype="float64")


def functions() -> dict:
    return {
        "kmv_estimate": _presenter(KmvSketch, KmvSketch.estimate, T.DoubleType()),
        "topk_json": _presenter(TopKSketch, TopKSketch.to_json, T.StringType()),
        "sample_json": _presenter(SampleSketch, SampleSketch.to_json, T.StringType()),
        "centroid_mean": _presenter(CentroidSketch, CentroidSketch.mean, T.ArrayType(T.DoubleType())),
        "average_value": _presenter(AverageState, AverageState.value, T.DoubleType()),
        "variance_json": _presenter(VarianceState, VarianceState.present, T.StringType()),
        "quantile_median": _presenter(QuantileState, lambda q: q.quantile(0.5), T.DoubleType()),
        "quantile_at": quantile_at,
        "kmv_merge": _merger(KmvSketch),
        "topk_merge": _merger(TopKSketch),
        "sample_merge": _merger(SampleSketch),
        "centroid_merge": _merger(CentroidSketch),
        "average_merge": _merger(AverageState),
        "variance_merge": _merger(VarianceState),
        "quantile_merge": _merger(QuantileState),
        "xunit_canonical": _of_cell(canonical_bytes),
        "xunit_content_id": _of_cell(content_id),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL; ``bucket_start(ts, width_us, origin_us)`` is a SQL expression of its own."""
    made = functions()
    for name, f in made.items():
        spark.udf.register(name, f)
    micros = "unix_micros(CAST(ts AS TIMESTAMP))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bucket_start(ts TIMESTAMP, width BIGINT, origin BIGINT) RETURNS TIMESTAMP RETURN timestamp_micros({micros} - pmod({micros} - origin, width))")
    return [*made, "bucket_start"]
