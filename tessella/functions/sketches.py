"""Mergeable sketches as bytes, and the same operations over Spark columns.

Inside a plan a sketch is a plain array (hashes, structs, sums), so that Spark can merge and
sort it; bytes are made once per cell, at the end. All bytes are little-endian: magic, version 1, payload.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodecError

#: Default sizes, and 2**64 - 1 as a float.
KMV_SIZE, TOP_K_SIZE, SAMPLE_SIZE = 1024, 100, 64
HASH_RANGE = float(2**64 - 1)
#: The size of a sketch that holds all hashes, so counts exactly: as long as an array can be.
WHOLE = 2**31 - 1
_SIGN = 1 << 63


class _Reader:
    def __init__(self, raw: bytes, magic: bytes):
        self.raw, self.at = bytes(raw), 0
        if self.take(4) != magic + b"\x01":
            raise CodecError(f"not a {magic.decode()} sketch of a known version")

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise CodecError("a sketch ends too soon")
        self.at += n
        return self.raw[self.at - n : self.at]

    def unpack(self, form: str):
        out = struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))
        return out if len(out) > 1 else out[0]

    def text(self) -> str:
        return self.take(self.unpack("H")).decode()

    def end(self) -> None:
        if self.at != len(self.raw):
            raise CodecError("bytes after the end of a sketch")


def _text16(value: str) -> bytes:
    raw = value.encode()
    if len(raw) > 65535:
        raise CodecError("a key of a sketch is longer than 65535 bytes")
    return struct.pack("<H", len(raw)) + raw


@dataclass
class KmvSketch:
    """The k least distinct 64-bit hashes: distinct counts with unions and intersections."""

    k: int = KMV_SIZE
    hashes: list[int] = field(default_factory=list)

    def __post_init__(self):
        if self.k < 8:
            raise CodecError("k is 8 or more")

    def add(self, value: str) -> None:
        self.hashes = sorted({*self.hashes, xxhash.xxh3_64_intdigest(value.encode())})[: self.k]

    def extend(self, values) -> KmvSketch:
        self.hashes = sorted({*self.hashes, *(xxhash.xxh3_64_intdigest(v.encode()) for v in values)})[: self.k]
        return self

    def merge(self, other: KmvSketch) -> KmvSketch:
        k = min(self.k, other.k)
        return KmvSketch(k, sorted({*self.hashes, *other.hashes})[:k])

    def estimate(self) -> float:
        n = len(self.hashes)
        return float(n) if n < self.k else (n - 1) / (self.hashes[-1] / HASH_RANGE)

    def union_estimate(self, other: KmvSketch) -> float:
        return self.merge(other).estimate()

    def intersection_estimate(self, other: KmvSketch) -> float:
        return max(self.estimate() + other.estimate() - self.union_estimate(other), 0.0)

    def jaccard(self, other: KmvSketch) -> float:
        union = self.union_estimate(other)
        return self.intersection_estimate(other) / union if union else 0.0

    def to_bytes(self) -> bytes:
        return b"KMV\x01" + struct.pack(f"<II{len(self.hashes)}Q", self.k, len(self.hashes), *self.hashes)

    @classmethod
    def from_bytes(cls, raw: bytes) -> KmvSketch:
        r = _Reader(raw, b"KMV")
        k, n = r.unpack("II")
        if k < 8 or n > k:
            raise CodecError("a KMV sketch of impossible size")
        hashes = list(struct.unpack(f"<{n}Q", r.take(8 * n)))
        r.end()
        if any(a >= b for a, b in zip(hashes, hashes[1:], strict=False)):
            raise CodecError("hashes are not in order")
        return cls(k, hashes)


@dataclass
class TopKSketch:
    """Keys by score, best first; equal scores by key. Exact: sums are complete before anything is cut."""

    capacity: int = TOP_K_SIZE
    items: list[tuple[str, float]] = field(default_factory=list)

    def merge(self, other: TopKSketch) -> TopKSketch:
        sums: dict[str, float] = {}
        for key, score in [*self.items, *other.items]:
            sums[key] = sums.get(key, 0.0) + score
        cap = min(self.capacity, other.capacity)
        return TopKSketch(cap, sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:cap])

    def to_json(self) -> str:
        return json.dumps([{"key": k, "score": s} for k, s in self.items], separators=(",", ":"), ensure_ascii=False)

    def to_bytes(self) -> bytes:
        return b"TPK\x01" + struct.pack("<II", self.capacity, len(self.items)) + b"".join(struct.pack("<d", s) + _text16(k) for k, s in self.items)

    @classmethod
    def from_bytes(cls, raw: bytes) -> TopKSketch:
        r = _Reader(raw, b"TPK")
        cap, n = r.unpack("II")
        items = []
        for _ in range(n):
            score = r.unpack("d")
            items.append((r.text(), score))
        r.end()
        if any((-a[1], a[0]) > (-b[1], b[0]) for a, b in zip(items, items[1:], strict=False)):
            raise CodecError("items are not in order")
        return cls(cap, items)


@dataclass
class SampleSketch:
    """Exemplars: the distinct values of least hash."""

    capacity: int = SAMPLE_SIZE
    items: list[tuple[int, str]] = field(default_factory=list)

    def extend(self, values) -> SampleSketch:
        self.items = sorted({*self.items, *((xxhash.xxh3_64_intdigest(v.encode()), v) for v in values)})[: self.capacity]
        return self

    def merge(self, other: SampleSketch) -> SampleSketch:
        cap = min(self.capacity, other.capacity)
        return SampleSketch(cap, sorted({*self.items, *other.items})[:cap])

    @property
    def values(self) -> list[str]:
        return [v for _, v in self.items]

    def to_json(self) -> str:
        return json.dumps(self.values, separators=(",", ":"), ensure_ascii=False)

    def to_bytes(self) -> bytes:
        return b"SMP\x01" + struct.pack("<II", self.capacity, len(self.items)) + b"".join(struct.pack("<Q", h) + _text16(v) for h, v in self.items)

    @classmethod
    def from_bytes(cls, raw: bytes) -> SampleSketch:
        r = _Reader(raw, b"SMP")
        cap, n = r.unpack("II")
        items = []
        for _ in range(n):
            h = r.unpack("Q")
            items.append((h, r.text()))
        r.end()
        if n > cap or any(a >= b for a, b in zip(items, items[1:], strict=False)):
            raise CodecError("items are not in order")
        return cls(cap, items)


@dataclass
class CentroidSketch:
    """Sum of vectors and their number."""

    count: int = 0
    sums: list[float] = field(default_factory=list)

    def merge(self, other: CentroidSketch) -> CentroidSketch:
        if not self.count or not other.count:
            return self if self.count else other
        if len(self.sums) != len(other.sums):
            raise CodecError("vectors of different lengths")
        return CentroidSketch(self.count + other.count, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    def mean(self) -> list[float] | None:
        return [x / self.count for x in self.sums] if self.count else None

    def to_bytes(self) -> bytes:
        return b"CTR\x01" + struct.pack(f"<QI{len(self.sums)}d", self.count, len(self.sums), *self.sums)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CentroidSketch:
        r = _Reader(raw, b"CTR")
        count, n = r.unpack("QI")
        sums = list(struct.unpack(f"<{n}d", r.take(8 * n)))
        r.end()
        return cls(count, sums)


KINDS = {b"KMV": KmvSketch, b"TPK": TopKSketch, b"SMP": SampleSketch, b"CTR": CentroidSketch}


def sketch_of(raw: bytes):
    """The sketch that ``raw`` holds, by its magic."""
    kind = KINDS.get(bytes(raw[:3]))
    if kind is None:
        raise CodecError("unknown kind of sketch")
    return kind.from_bytes(raw)


# ---- over columns ------------------------------------------------------------------------------------------------


@F.pandas_udf(T.LongType())
def value_hash(values: pd.Series) -> pd.Series:
    """XXH3-64 of the text less 2**63, so that signed order is the order of the hashes. Called on distinct values only."""
    digest = xxhash.xxh3_64_intdigest
    return pd.Series([None if v is None else digest(v.encode()) - _SIGN for v in values], dtype="Int64")


def unsigned(h: Column) -> Column:
    """The hash as a float, from its shifted form."""
    return h.cast("double") + F.lit(float(_SIGN))


def kmv_estimate(hashes: Column, k: int) -> Column:
    n = F.size(hashes)
    return F.when(n < k, n.cast("double")).otherwise((n - 1) / (unsigned(F.element_at(hashes, F.lit(k))) / F.lit(HASH_RANGE)))


def kmv_union(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def kmv_intersection(a: Column, b: Column, k: int) -> Column:
    """By inclusion and exclusion of estimates."""
    return F.greatest(kmv_estimate(a, k) + kmv_estimate(b, k) - kmv_estimate(kmv_union(a, b, k), k), F.lit(0.0))


def kmv_jaccard(a: Column, b: Column, k: int) -> Column:
    union = kmv_estimate(kmv_union(a, b, k), k)
    return F.when(union == 0, F.lit(0.0)).otherwise(kmv_intersection(a, b, k) / union)


def kmv_bytes(k: int):
    @F.pandas_udf(T.BinaryType())
    def encode(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            u = np.asarray([] if h is None else h, np.int64).astype("<u8") + np.uint64(_SIGN)
            out.append(b"KMV\x01" + struct.pack("<II", k, len(u)) + u.astype("<u8").tobytes())
        return pd.Series(out)

    return encode


@F.pandas_udf(T.ArrayType(T.LongType()))
def kmv_hashes(blobs: pd.Series) -> pd.Series:
    """Shifted hashes out of bytes."""
    return pd.Series([None if b is None else [h - _SIGN for h in KmvSketch.from_bytes(b).hashes] for b in blobs])


def topk_bytes(capacity: int):
    @F.pandas_udf(T.BinaryType())
    def encode(items: pd.Series) -> pd.Series:
        return pd.Series([TopKSketch(capacity, [(i["key"], i["score"]) for i in (() if x is None else x)]).to_bytes() for x in items])

    return encode


def topk_json(items: Column) -> Column:
    return F.to_json(F.transform(items, lambda i: F.struct(i["key"].alias("key"), i["score"].alias("score"))))


def sample_bytes(capacity: int):
    @F.pandas_udf(T.BinaryType())
    def encode(items: pd.Series) -> pd.Series:
        return pd.Series([SampleSketch(capacity, [(int(i["h"]) + _SIGN, i["v"]) for i in (() if x is None else x)]).to_bytes() for x in items])

    return encode


@F.pandas_udf(T.BinaryType())
def centroid_bytes(counts: pd.Series, sums: pd.Series) -> pd.Series:
    return pd.Series([CentroidSketch(int(n or 0), [] if s is None else [float(x) for x in s]).to_bytes() for n, s in zip(counts, sums, strict=True)])
