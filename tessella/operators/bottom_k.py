"""Bottom-k hashes per cell. Spark has no aggregate that keeps the k least values and merges partial results, and
ranking rows would shuffle every row once per shape; here each task reduces its rows to one packed array per cell. Arrays of a cell then
stream by in one task, which holds k hashes of it at a time, however many tasks there were before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task reduces at once.
ROWS_AT_ONCE = 400_000
_SIGN = 1 << 63


def _codes(values: pd.Series) -> tuple[np.ndarray, int]:
    codes, found = pd.factorize(values)
    return codes.astype(np.int64), len(found)


def _reduced(pdf: pd.DataFrame, keys: list[str], shapes: list[tuple[list[str], list[str]]], k: int):
    """One frame per shape: the key columns of its cells (others null) and their k least hashes."""
    values, names = pd.factorize(pdf["__v"])
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(v.encode()) - _SIGN for v in names], np.int64)[values]
    coded = {c: _codes(pdf[c]) for c in keys}
    for members, deepest in shapes:
        rows = np.ones(len(pdf), bool)
        for c in deepest:
            rows &= coded[c][0] >= 0
        rows = np.flatnonzero(rows)
        if not len(rows):
            continue
        cell, size = np.zeros(len(rows), np.int64), 1
        for c in members:
            code, n = coded[c]
            if size > 2**62 // (n + 1):
                cell, size = np.unique(cell, return_inverse=True)[1].astype(np.int64), len(rows)
            cell, size = cell * (n + 1) + code[rows] + 1, size * (n + 1)
        h = hashes[rows]
        order = np.lexsort((h, cell))
        cell, h, rows = cell[order], h[order], rows[order]
        new = np.concatenate([[True], cell[1:] != cell[:-1]])
        fresh = new | np.concatenate([[True], h[1:] != h[:-1]])
        cell, h, rows, new = cell[fresh], h[fresh], rows[fresh], new[fresh]
        start = np.flatnonzero(new)
        least = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h)))) < k
        h, first = h[least], rows[start]
        ends = np.cumsum(np.add.reduceat(least.astype(np.int64), start)) * 8
        raw, begins = h.tobytes(), np.concatenate([[0], ends[:-1]])
        one = pdf.iloc[first]
        out = {c: one[c].to_numpy() if c in members else np.full(len(first), None, object) for c in keys}
        yield pd.DataFrame(out | {"blob": [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]})


def bottom_k_cells(rows: DataFrame, value: str, extra: list[str], flat: list[str], shapes: list[tuple[list[str], list[str]]], k: int, name: str) -> DataFrame:
    """(``extra``, ``flat``, ``name``): the k least shifted hashes of ``value`` of each cell, ascending.

    ``shapes``: for each, its key columns and the columns that may not be null. ``extra`` keys are timestamps. Rows with a null value are left out.
    """
    keys = [*extra, *flat]
    picked = rows.where(F.col(value).isNotNull()).select(*[F.unix_micros(c).alias(c) for c in extra], *flat, F.col(value).alias("__v"))
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in extra], *[T.StructField(c, T.StringType()) for c in flat], T.StructField("blob", T.BinaryType())])

    def reduce(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= ROWS_AT_ONCE:
                yield from _reduced(pd.concat(held, ignore_index=True), keys, shapes, k)
                held, n = [], 0
        if n:
            yield from _reduced(pd.concat(held, ignore_index=True), keys, shapes, k)

    def merge(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            merged = _merged(pdf, keys, k)
            held = merged.iloc[-1:]  # its cell may go on in the next batch
            if len(merged) > 1:
                yield _listed(merged.iloc[:-1], name)
        if held is not None:
            yield _listed(held, name)

    parts = picked.mapInPandas(reduce, schema)
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    out = ordered.mapInPandas(merge, T.StructType([*schema.fields[:-1], T.StructField(name, T.ArrayType(T.LongType()))]))
    return out.select(*[F.timestamp_micros(c).alias(c) for c in extra], *flat, name)


def _merged(pdf: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    """Rows of one cell, which stand together, as one row with the k least hashes of all."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for c in keys:
        code = pd.factorize(pdf[c])[0]
        new[1:] |= code[1:] != code[:-1]
    cell = np.cumsum(new) - 1
    blobs = pdf["blob"].tolist()
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
    h, at = np.frombuffer(b"".join(blobs), np.int64), np.repeat(cell, sizes)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])]) if len(h) else np.zeros(0, bool)
    h, at = h[fresh], at[fresh]
    begin = np.searchsorted(at, np.arange(cell[-1] + 1))
    keep = np.arange(len(h)) - begin[at] < k
    h, n = h[keep], np.bincount(at[keep], minlength=cell[-1] + 1) * 8
    raw, ends = h.tobytes(), np.cumsum(n)
    return pdf[new].assign(blob=[raw[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)])


def _listed(pdf: pd.DataFrame, name: str) -> pd.DataFrame:
    return pdf.drop(columns="blob").assign(**{name: [np.frombuffer(b, np.int64) for b in pdf["blob"]]})
