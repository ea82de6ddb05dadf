"""Mergeable aggregate states as bytes: average, variance, quantile. Version 2 ends with a CRC-32 of all before it; version 1, without, is still read."""

from __future__ import annotations

import json
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodecError, CubeError
from .sketches import sketch_of

#: For each aggregate (associative, commutative, idempotent, subtractable, exact, tolerance).
CAPABILITIES = {
    "sum": (False, True, False, True, True, 1e-12),
    "count": (True, True, False, True, True, None),
    "min": (True, True, True, False, True, None),
    "max": (True, True, True, False, True, None),
    "avg": (False, True, False, False, True, 1e-12),
    "variance": (False, True, False, False, True, 1e-12),
    "count_distinct": (True, True, True, False, False, None),
    "top_k": (False, True, False, False, False, None),
    "quantile": (True, True, False, False, False, None),
    "centroid": (False, True, False, False, True, 1e-12),
    "reservoir_sample": (True, True, True, False, False, None),
}


def _seal(magic: bytes, payload: bytes) -> bytes:
    raw = magic + b"\x02" + payload
    return raw + struct.pack("<I", zlib.crc32(raw))


def _open(magic: bytes, raw: bytes) -> bytes:
    raw = bytes(raw)
    if len(raw) < 4 or raw[:3] != magic or raw[3] not in (1, 2):
        raise CodecError(f"not a {magic.decode()} state of a known version")
    if raw[3] == 1:
        return raw[4:]
    if len(raw) < 8 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise CodecError("the checksum of a state is wrong")
    return raw[4:-4]


def _finite(x: float) -> float:
    if not math.isfinite(x):
        raise CubeError("states take finite numbers only")
    return x


def _unpack(form: str, payload: bytes):
    if len(payload) != struct.calcsize(form):
        raise CodecError("a state of wrong length")
    return struct.unpack(form, payload)


@dataclass
class AverageState:
    total: float = 0.0
    count: int = 0

    def add(self, x: float) -> None:
        self.total, self.count = self.total + _finite(x), self.count + 1

    def merge(self, o: AverageState) -> AverageState:
        return AverageState(self.total + o.total, self.count + o.count)

    def value(self) -> float | None:
        return self.total / self.count if self.count else None

    def to_bytes(self) -> bytes:
        return _seal(b"AVG", struct.pack("<dQ", self.total, self.count))

    @classmethod
    def from_bytes(cls, raw: bytes) -> AverageState:
        return cls(*_unpack("<dQ", _open(b"AVG", raw)))


@dataclass
class VarianceState:
    """Count, mean and sum of squared differences; merged pairwise."""

    count: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def add(self, x: float) -> None:
        self.count += 1
        d = _finite(x) - self.mean
        self.mean += d / self.count
        self.m2 += d * (x - self.mean)

    def merge(self, o: VarianceState) -> VarianceState:
        n = self.count + o.count
        if not self.count or not o.count:
            return o if not self.count else self
        d = o.mean - self.mean
        return VarianceState(n, self.mean + d * o.count / n, self.m2 + o.m2 + d * d * self.count * o.count / n)

    def present(self) -> str | None:
        if not self.count:
            return None
        sample = self.m2 / (self.count - 1) if self.count > 1 else None
        return json.dumps({"count": self.count, "mean": self.mean, "populationVariance": self.m2 / self.count, "sampleVariance": sample}, separators=(",", ":"))

    def to_bytes(self) -> bytes:
        return _seal(b"VAR", struct.pack("<Qdd", self.count, self.mean, self.m2))

    @classmethod
    def from_bytes(cls, raw: bytes) -> VarianceState:
        return cls(*_unpack("<Qdd", _open(b"VAR", raw)))


@dataclass
class QuantileState:
    """Counts of bins of one width."""

    width: float
    bins: dict[int, int] = field(default_factory=dict)

    def add(self, x: float) -> None:
        at = math.floor(_finite(x) / self.width)
        self.bins[at] = self.bins.get(at, 0) + 1

    def merge(self, o: QuantileState) -> QuantileState:
        if struct.pack("<d", self.width) != struct.pack("<d", o.width):
            raise CubeError("histograms of different widths do not merge")
        out = dict(self.bins)
        for k, n in o.bins.items():
            out[k] = out.get(k, 0) + n
        return QuantileState(self.width, out)

    def quantile(self, p: float) -> float | None:
        if not 0 <= p <= 1:
            raise CubeError("p lies between 0 and 1")
        rank = math.floor((sum(self.bins.values()) - 1) * p)
        for at in sorted(self.bins):
            rank -= self.bins[at]
            if rank < 0:
                return (at + 0.5) * self.width
        return None

    def to_bytes(self) -> bytes:
        return _seal(b"QNT", struct.pack("<dQI", self.width, sum(self.bins.values()), len(self.bins)) + b"".join(struct.pack("<qQ", k, self.bins[k]) for k in sorted(self.bins)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuantileState:
        payload = _open(b"QNT", raw)
        if len(payload) < 20:
            raise CodecError("a state of wrong length")
        width, count, n = struct.unpack("<dQI", payload[:20])
        pairs = _unpack("<" + "qQ" * n, payload[20:])
        if count != sum(pairs[1::2]) or not (math.isfinite(width) and width > 0) or list(pairs[0::2]) != sorted(set(pairs[0::2])):
            raise CodecError("a histogram that cannot be")
        return cls(width, dict(zip(pairs[0::2], pairs[1::2], strict=True)))


STATES = {b"AVG": AverageState, b"VAR": VarianceState, b"QNT": QuantileState}


def state_of(raw: bytes):
    """The state or sketch that ``raw`` holds, by its magic."""
    kind = STATES.get(bytes(raw[:3]))
    return kind.from_bytes(raw) if kind else sketch_of(raw)


# ---- over columns: bytes are made once per cell ---------------------------------------------------------------------


def _sealed(magic: bytes, *columns: np.ndarray) -> pd.Series:
    """One state per row: the columns' bytes side by side, sealed."""
    head = np.broadcast_to(np.frombuffer(magic + b"\x02", np.uint8), (len(columns[0]), len(magic) + 1))
    rows = np.concatenate([head, *[np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8) for c in columns]], axis=1)
    raw, n, crc = rows.tobytes(), rows.shape[1], zlib.crc32
    return pd.Series([(b := raw[i : i + n]) + crc(b).to_bytes(4, "little") for i in range(0, len(raw), n)], dtype=object)


def _numbers(c: pd.Series, kind: str) -> np.ndarray:
    return c.fillna(0).to_numpy().astype(kind)


@F.pandas_udf(T.BinaryType())
def average_bytes(total: pd.Series, count: pd.Series) -> pd.Series:
    n = _numbers(count, "<u8")
    return _sealed(b"AVG", np.where(n > 0, _numbers(total, "<f8"), 0.0).astype("<f8"), n)


@F.pandas_udf(T.BinaryType())
def variance_bytes(count: pd.Series, mean: pd.Series, m2: pd.Series) -> pd.Series:
    n = _numbers(count, "<u8")
    return _sealed(b"VAR", n, *[np.where(n > 0, _numbers(c, "<f8"), 0.0).astype("<f8") for c in (mean, m2)])


def quantile_bytes(width: float):
    @F.pandas_udf(T.BinaryType())
    def encode(bins: pd.Series) -> pd.Series:
        return pd.Series([QuantileState(width, {int(b["bin"]): int(b["n"]) for b in (() if x is None else x)}).to_bytes() for x in bins])

    return encode


@F.pandas_udf(T.StructType([T.StructField("total", T.DoubleType()), T.StructField("count", T.LongType())]))
def average_parts(blobs: pd.Series) -> pd.DataFrame:
    got = [None if b is None else AverageState.from_bytes(b) for b in blobs]
    return pd.DataFrame({"total": [g.total if g else 0.0 for g in got], "count": [g.count if g else 0 for g in got]})


@F.pandas_udf(T.BinaryType())
def merge_all(groups: pd.Series) -> pd.Series:
    """Arrays of states or sketches of one kind, as bytes, merged; an empty array gives null."""
    out = []
    for blobs in groups:
        merged = None
        for b in blobs if blobs is not None else ():
            one = state_of(bytes(b))
            merged = one if merged is None else merged.merge(one)
        out.append(None if merged is None else merged.to_bytes())
    return pd.Series(out, dtype=object)
