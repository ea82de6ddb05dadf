"""Shards of near equal bytes by histogram sort: probes are counted exactly and refined, then rows are exchanged once."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: A splitter may miss its target by this part of a shard.
TOLERANCE = 0.01
#: Rows that one task sorts, about; a shard is sorted in so many ranges, up to MAX_RANGES in all: beyond 6 million rows, ranges grow instead (sorting spills to disk).
RANGE_ROWS, MAX_RANGES = 1500, 4096
#: Keys that a task proposes for an open interval, and probes of an interval and round.
PROPOSED, PROBES = 8, 64
_KEY = "S24"


def sort_key(text, doc_id):
    """24 bytes: hash of the text, doc_id, a number of the row. Equal texts are neighbours; no two rows are equal."""
    sign = F.lit(-(2**63)).cast("long")
    part = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return F.concat(part(F.xxhash64(F.coalesce(text, F.lit("")))), part(F.coalesce(doc_id.cast("long"), sign).bitwiseXOR(sign)), part(F.monotonically_increasing_id()))


def _bounds(keys: list[bytes]) -> np.ndarray:
    return np.array(keys, _KEY) if keys else np.zeros(0, _KEY)


def count_below(keyed: DataFrame, probes: list[bytes]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) between each two neighbouring probes, and before the first and from the last on."""

    def count(batches):
        edges, size, rows = _bounds(probes), np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for pdf in batches:
            at = np.searchsorted(edges, np.array(pdf["key"].tolist(), _KEY), side="right")
            np.add.at(size, at, pdf["size"].to_numpy(np.int64))
            np.add.at(rows, at, 1)
        some = np.flatnonzero(rows)
        yield pd.DataFrame({"at": some, "size": size[some], "rows": rows[some]})

    found = keyed.select("key", "size").mapInPandas(count, "at bigint, size bigint, rows bigint").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    out = [(0, 0)] * (len(probes) + 1)
    for r in found.collect():
        out[r["at"]] = (r["size"], r["rows"])
    return out


def propose(keyed: DataFrame, gaps: list[tuple[bytes, bytes | None]]) -> list[list[bytes]]:
    """For each interval, at most PROBES keys in it: starts of groups of equal texts, or rows where it holds one group only.

    Tasks offer evenly spaced keys; one offer in each of PROBES slots, taken by a hash of the key, reaches the driver.
    """
    lows, highs = [g[0] for g in gaps], [g[1] for g in gaps]

    def pick(batches):
        got = [[] for _ in gaps]
        for pdf in batches:
            keys = np.sort(np.array(pdf["key"].tolist(), _KEY))
            for i, (lo, hi) in enumerate(zip(lows, highs, strict=True)):
                a = np.searchsorted(keys, np.array(lo, _KEY), side="right")
                b = len(keys) if hi is None else np.searchsorted(keys, np.array(hi, _KEY))
                if b > a:
                    got[i] += keys[np.unique(np.linspace(a, b - 1, PROPOSED).astype(int))].tolist()
        rows = [(i, k.ljust(24, b"\0")) for i, ks in enumerate(got) for k in _thin(sorted(set(ks)), PROPOSED)]
        yield pd.DataFrame(rows, columns=["gap", "key"])

    out = [[] for _ in gaps]
    offers = keyed.select("key").mapInPandas(pick, "gap int, key binary")
    slot = F.pmod(F.xxhash64("key"), F.lit(PROBES))
    for r in offers.groupBy("gap", slot.alias("slot")).agg(F.min_by("key", F.xxhash64("key", F.lit(1))).alias("key")).collect():
        out[r["gap"]].append(bytes(r["key"]))
    for i, (lo, hi) in enumerate(gaps):
        starts = {k[:8].ljust(24, b"\0") for k in out[i]}
        starts = {k for k in starts if k > lo.ljust(24, b"\0") and (hi is None or k < hi)}
        out[i] = _thin(sorted(starts or set(out[i])), PROBES)
    return out


def _thin(keys: list, most: int) -> list:
    return keys if len(keys) <= most else [keys[i] for i in np.unique(np.linspace(0, len(keys) - 1, most).astype(int))]


def splitters(keyed: DataFrame, targets: list[int], slack: int, total: tuple[int, int]) -> list[tuple[bytes, int, int]]:
    """For each target of bytes, (key, exact bytes below, exact rows below) within ``slack`` of it, or the nearest row."""
    known: dict[bytes, tuple[int, int]] = {b"": (0, 0)}
    ended: set[bytes] = set()
    while True:
        keys = sorted(known, key=lambda k: k.ljust(24, b"\0"))
        below = [known[k][0] for k in keys]
        chosen, gaps = [], {}
        for t in targets:
            i = bisect.bisect_right(below, t) - 1
            near = [keys[j] for j in (i, i + 1) if j < len(keys)]
            best = min(near, key=lambda k: abs(known[k][0] - t))
            chosen.append((best, *known[best]))
            if abs(known[best][0] - t) > slack and keys[i] not in ended:
                gaps[keys[i]] = keys[i + 1] if i + 1 < len(keys) else None
        if not gaps:
            return chosen
        offered = propose(keyed, list(gaps.items()))
        ended |= {lo for lo, ks in zip(gaps, offered, strict=True) if not ks}
        fresh = sorted({k for ks in offered for k in ks} - set(known))
        if fresh:
            every = sorted([k for k in known if k] + fresh)
            size = rows = 0
            for k, (s, r) in zip(every, count_below(keyed, every), strict=False):
                size, rows = size + s, rows + r
                known[k] = (size, rows)


def shard_by_bytes(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot (gapless from 0 in the shard).

    Shards hold consecutive ranges of the sort key and near equal bytes: each of their borders lies
    within TOLERANCE of a shard's size from its target, or as near as a row allows. A group of
    equal texts stays whole where that allows it; a group that is too large
    is cut between rows. Null texts count as empty; null ids and repeated rows are rows
    like any other; with fewer rows than shards, some shards are empty; an empty table gives no rows.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    keyed = store(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), sort_key(F.col(text), F.col(doc_id)).alias("key")), "keys")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(max(1, -(-total[1] // (shards * RANGE_ROWS))), max(1, MAX_RANGES // shards))
    parts = shards * ranges
    main = splitters(keyed, [total[0] * i // shards for i in range(1, shards)], int(total[0] / shards * TOLERANCE), tuple(total))
    cut = [(b"", 0, 0), *main]
    ends = [*[c[1] for c in main], total[0]]
    fine = [c[1] + (e - c[1]) * j // ranges for c, e in zip(cut, ends, strict=True) for j in range(1, ranges)]
    sub = splitters(keyed, fine, int(total[0] / parts * 0.1), tuple(total)) if fine else []
    marks = sorted({(k.ljust(24, b"\0"), rows) for k, _, rows in [*main, *sub]})
    edges, first = [k for k, _ in marks], [0, *[r for _, r in marks]]
    heads = [k.ljust(24, b"\0") for k, _, _ in main]
    start = [0, *[rows for _, _, rows in main]]

    def place(batches):
        e, h = _bounds(edges), _bounds(heads)
        for pdf in batches:
            keys = np.array(pdf["key"].tolist(), _KEY)
            at, shard = np.searchsorted(e, keys, side="right"), np.searchsorted(h, keys, side="right")
            yield pdf.assign(part=at, shard=shard.astype(np.int32), ahead=np.asarray(first)[at] - np.asarray(start)[shard])

    placed = keyed.mapInPandas(place, "doc_id bigint, size bigint, text_crc32 bigint, key binary, part bigint, shard int, ahead bigint")
    slot = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
