"""Canonical bytes of a cell and its content id. All big-endian: magic, version, number of paths, and for each path its dimension and typed attribute values."""

from __future__ import annotations

import math
import struct

from ..errors import CodecError
from ..xunits import XUnit, YPath
from .blake3 import blake3

#: Magic and version; tags of values.
MAGIC, VERSION = b"CXU", 1
NULL, FALSE, TRUE, I64, U64, F64, STRING, BYTES = range(8)

Value = None | bool | int | float | str | bytes


def _sized(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "big") + raw


def encode_value(value: Value, unsigned: bool = False) -> bytes:
    if value is None:
        return bytes([NULL])
    if isinstance(value, bool):
        return bytes([TRUE if value else FALSE])
    if isinstance(value, int):
        return bytes([U64 if unsigned else I64]) + value.to_bytes(8, "big", signed=not unsigned)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise CodecError("a cell holds finite numbers only")
        return bytes([F64]) + struct.pack(">d", value or 0.0)
    return bytes([BYTES]) + _sized(value) if isinstance(value, bytes) else bytes([STRING]) + _sized(value.encode())


def canonical(paths: list[tuple[str, list[tuple[str, Value]]]]) -> bytes:
    """Of (dimension, [(attribute, value)]); dimensions are sorted here and may not repeat."""
    ordered = sorted(paths, key=lambda p: p[0].encode())
    if len({p[0] for p in ordered}) < len(ordered):
        raise CodecError("a cell has one path per dimension")
    out = MAGIC + bytes([VERSION]) + len(ordered).to_bytes(4, "big")
    for dim, attrs in ordered:
        out += _sized(dim.encode()) + len(attrs).to_bytes(4, "big")
        out += b"".join(_sized(a.encode()) + encode_value(v) for a, v in attrs)
    return out


def canonical_bytes(unit: XUnit) -> bytes:
    return canonical([(p.dim, list(p.attrs)) for p in unit.paths])


def content_id(unit: XUnit) -> bytes:
    return blake3(canonical_bytes(unit))


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise CodecError("canonical bytes end too soon")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def text(self) -> str:
        try:
            return self.take(self.number()).decode()
        except UnicodeDecodeError as e:
            raise CodecError("canonical bytes hold broken text") from e

    def value(self) -> Value:
        tag = self.take(1)[0]
        if tag in (NULL, FALSE, TRUE):
            return (None, False, True)[tag]
        if tag in (I64, U64):
            return int.from_bytes(self.take(8), "big", signed=tag == I64)
        if tag == F64:
            value = struct.unpack(">d", self.take(8))[0]
            if not math.isfinite(value):
                raise CodecError("a cell holds finite numbers only")
            return value
        if tag == STRING:
            return self.text()
        if tag == BYTES:
            return self.take(self.number())
        raise CodecError(f"unknown tag {tag}")


def decode_canonical(raw: bytes) -> list[tuple[str, list[tuple[str, Value]]]]:
    r = _Reader(bytes(raw))
    if r.take(3) != MAGIC or r.take(1)[0] != VERSION:
        raise CodecError("not canonical bytes of a known version")
    out = []
    for _ in range(r.number()):
        dim = r.text()
        if out and dim.encode() <= out[-1][0].encode():
            raise CodecError("dimensions are not in order")
        out.append((dim, [(r.text(), r.value()) for _ in range(r.number())]))
    if r.at != len(r.raw):
        raise CodecError("bytes after the end")
    return out


def decode_unit(raw: bytes) -> XUnit:
    return XUnit(tuple(YPath(d, tuple(a)) for d, a in decode_canonical(raw)))
