"""Substring dedup over a de Bruijn graph of words, compacted through Spark joins.

A window of ``span`` consecutive words is an edge of the graph. Neighbouring windows that share
their minimizer (the least hash of ``seed`` words inside) are cut as one piece of a
path, and equal windows have equal minimizers, so:

1. minimizers found in one document only are dropped: their edges occur once;
2. equal pieces are one class. Where each of two classes has the other as its only neighbour on that side, a join
   glues them; the runs of glued classes are the nonbranching paths, and a path occurs wherever its first class does;
3. classes that share a minimizer but differ are where paths branch: they are opened into single edges, once for each class;
4. the words at the coordinates (document, word) of paths and opened edges are read again and digested: only spans of
   equal words count as repeats, and all but those of the least document are cut from the texts.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, fresh, give_back, split_by, store

#: Words of a minimizer seed.
SEED = 8
#: Words hashed at once, and entries of a worker's memory of word hashes.
WORDS_AT_ONCE, REMEMBERED = 120_000, 100_000

_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh3_128_digest(word)
        return got


class _Digests:
    """128-bit digests of runs of words in a flat list: two polynomials modulo 2**64 over word hashes."""

    _powers = np.zeros((0, 2), np.uint64)
    _inverses = np.zeros((0, 2), np.uint64)

    def __init__(self, raw: bytes):
        h = np.frombuffer(raw, "<u8").reshape(-1, 2)
        n = len(h)
        if n + 1 > len(_Digests._powers):
            size = max(n + 1, WORDS_AT_ONCE + 1000)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.broadcast_to(base, (size, 2)).copy()
                steps[0] = 1
                setattr(_Digests, name, np.cumprod(steps, axis=0, dtype=np.uint64))
        self.sums = np.zeros((n + 1, 2), np.uint64)
        np.cumsum(h * _Digests._inverses[:n], axis=0, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * _Digests._powers[end - 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words(text: str | None) -> list[bytes]:
    """Runs of other than blanks and line ends (0x20, 0x09-0x0D), unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _pieces(hashes: bytes, starts: np.ndarray, sizes: np.ndarray, span: int):
    """(document, first window, windows, minimizer, digest 1, digest 2, digest 1 of the piece before and after; 0: none) of each piece of the documents laid end to end."""
    dig, total, reach = _Digests(hashes), int(sizes.sum()), span - SEED + 1
    if total < span:
        return None
    at = np.arange(total - SEED + 1)
    seeds = _mixed(dig.of(at, at + SEED)[:, 0])
    low, width = at, 1
    while width < reach:  # leftmost least of each run of ``reach`` seeds, by doubling
        step = min(width, reach - width)
        a, b = low[: len(low) - step], low[step:]
        low, width = np.where(seeds[a] <= seeds[b], a, b), width + step
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - span + 1, 0))
    if not len(doc):
        return None
    count = np.maximum(sizes - span + 1, 0)
    begin = starts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    least = low[begin]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(least) != 0)]))
    n = np.diff(np.append(first, len(doc)))
    d = dig.of(begin[first], begin[first] + n + span - 1)
    own, same = d[:, 0].view(np.int64), np.diff(doc[first]) == 0
    before, after = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return doc[first], begin[first] - starts[doc[first]], n, seeds[least[first]].view(np.int64), own, d[:, 1].view(np.int64), before, after


_PIECE = {"start": np.int32, "n": np.int32, "m": np.int64, "s1": np.int64, "s2": np.int64, "before": np.int64, "after": np.int64}


def pieces(docs: DataFrame, span: int = 50) -> DataFrame:
    """Path pieces of (doc_id, th, text): each is ``n`` windows from word ``start`` on with minimizer ``m``, content digest (s1, s2), and s1 of its neighbours in the text."""

    def run(batches):
        memory = _WordHashes()
        for pdf in batches:
            ids, ths, held, sizes, rows = pdf["doc_id"].to_numpy(), pdf["th"].to_numpy(), [], [], []
            total, texts = 0, pdf["text"].tolist()
            for i, t in enumerate([*texts, None]):
                w = words(t if isinstance(t, str) else None)
                if len(w) >= span:
                    held.append(b"".join(map(memory.__getitem__, w)))
                    sizes.append(len(w))
                    rows.append(i)
                    total += len(w)
                if sizes and (total >= WORDS_AT_ONCE or i == len(texts)):
                    size = np.array(sizes)
                    got = _pieces(b"".join(held), np.cumsum(size) - size, size, span)
                    own = np.array(rows)[got[0]]
                    yield pd.DataFrame({"doc_id": ids[own], "th": ths[own]} | {k: x.astype(kind) for (k, kind), x in zip(_PIECE.items(), got[1:], strict=True)})
                    held, sizes, rows, total = [], [], [], 0
        memory.clear()
        give_back()

    return docs.mapInPandas(run, "doc_id bigint, th bigint, start int, n int, m bigint, s1 bigint, s2 bigint, before bigint, after bigint")


def unitigs(classes: DataFrame) -> DataFrame:
    """Nonbranching paths of classes found in several documents: (m, s1, s2) of the first class, and n, the windows of the path.

    Two classes are glued if all pieces of one are followed by the other and all of that preceded by the one. Their pieces then
    follow each other in the same places, so the path is a run of neighbours where it first occurs.
    """
    several = classes.where("at.doc_id < most")
    ahead = several.where("after = after_most AND after <> 0").select(F.col("s1").alias("p"), F.col("after").alias("q"), F.struct("at.doc_id", "at.th", (F.col("at.start") + F.col("n")).alias("start")).alias("end"))
    joined = several.join(ahead, (F.col("s1") == F.col("q")) & (F.col("before") == F.col("p")) & (F.col("before_most") == F.col("p")) & (F.col("at") == F.col("end")), "left")
    path = F.sum(F.col("p").isNull().cast("long")).over(Window.partitionBy("at.doc_id", "at.th").orderBy("at.start"))
    runs = joined.select("m", "s1", "s2", "n", F.col("at.doc_id").alias("d"), F.col("at.th").alias("t"), F.col("at.start").alias("start"), path.alias("path"))
    return runs.groupBy("d", "t", "path").agg(F.min(F.struct("start", "m", "s1", "s2")).alias("head"), F.sum("n").alias("n")).select("head.m", "head.s1", "head.s2", "n")


def repeated_ranges(docs: DataFrame, span: int = 50) -> DataFrame:
    """(doc_id, th, ranges) of (doc_id, th, text): windows whose words also start in a document of a smaller doc_id, each range as first word << 32 | windows."""
    own = store(pieces(docs.where("doc_id IS NOT NULL"), span), "pieces")
    twice = store(own.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("m"), "minimizers")
    shared = store(own.join(twice, "m", "left_semi"), "shared")
    drop(own)
    kind = ["m", "s1", "s2"]
    ends = [f(k).alias(k + end) for k in ("before", "after") for f, end in ((F.min, ""), (F.max, "_most"))]
    classes = store(shared.groupBy(*kind).agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("at"), F.max("doc_id").alias("most"), F.count("*").alias("pieces"), *ends), "classes")
    paths = store(unitigs(classes), "paths")
    packed = lambda start, n, opened: F.shiftleft(start.cast("long"), 32).bitwiseOR(F.shiftleft(n.cast("long"), 1)).bitwiseOR(F.lit(opened).cast("long"))
    opened = F.array(packed(F.col("start"), F.col("n"), 1)).alias("spans")
    by_text = shared.groupBy(*kind, "doc_id", "th").agg(F.collect_list("start").alias("starts"))  # a text that repeats a piece has it in one row
    whole = by_text.join(paths, kind).select("doc_id", "th", F.transform("starts", lambda s: packed(s, F.col("n"), 0)).alias("spans"))
    branching = store(classes.groupBy("m").count().where("count > 1").select("m"), "branching")
    branches = store(classes.join(branching, "m", "left_semi").select(*kind, "n", "at", "pieces"), "branches")
    once = branches.where("pieces = 1").select(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th"), F.col("at.start").alias("start"), "n").select("doc_id", "th", opened)
    more = shared.join(branches.where("pieces > 1").select(*kind, F.col("at.doc_id").alias("doc_id")), [*kind, "doc_id"], "left_semi").select("doc_id", "th", opened)
    spans = store(whole.unionByName(once).unionByName(more).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for t in (twice, shared, classes, paths, branching, branches):
        drop(t)
    texts = split_by(docs.where("doc_id IS NOT NULL"), spans)[0].join(spans, ["doc_id", "th"])
    found = store(verified(texts, span), "verified")
    least = store(found.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "least")
    f, one = found.alias("f"), least.alias("one")
    repeats = f.join(one, (F.col("f.d1") == F.col("one.d1")) & (F.col("f.d2") == F.col("one.d2")) & (F.col("f.doc_id") > F.col("one.least"))).select("doc_id", "th", "range")
    out = store(repeats.groupBy("doc_id", "th").agg(F.collect_set("range").alias("ranges")), "ranges")
    for t in (spans, found, least):
        drop(t)
    return out


def verified(texts: DataFrame, span: int) -> DataFrame:
    """(doc_id, th, range, d1, d2): BLAKE2 digest of the words themselves at each of ``spans`` (first word << 32 | windows << 1 | opened) of (doc_id, th, text, spans); opened ones window by window."""

    def run(batches):
        for pdf in batches:
            ids, ths, ranges, digests = [], [], [], []
            for i, h, t, o in zip(pdf["doc_id"].tolist(), pdf["th"].tolist(), pdf["text"].tolist(), pdf["spans"].tolist(), strict=True):
                w, o = words(t), np.unique(np.asarray(o, np.int64))
                joined, edge = b" ".join(w), np.concatenate([[0], np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)])
                start, n, opened = o >> 32, (o & 0xFFFFFFFF) >> 1, (o & 1).astype(bool)
                s, k = start[opened], n[opened]
                single = np.unique(np.repeat(s - (np.cumsum(k) - k), k) + np.arange(k.sum()))
                start, n = np.concatenate([start[~opened], single]), np.concatenate([n[~opened], np.ones(len(single), np.int64)])
                lo, hi = edge[start].tolist(), (edge[start + n + span - 1] - 1).tolist()
                digests += [blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(lo, hi, strict=True)]
                ids.append(np.full(len(lo), i))
                ths.append(np.full(len(lo), h))
                ranges.append((start << 32) | n)
                if len(digests) > 100_000:
                    yield _digested(ids, ths, ranges, digests)
                    ids, ths, ranges, digests = [], [], [], []
            if digests:
                yield _digested(ids, ths, ranges, digests)
        give_back()

    return texts.select("doc_id", "th", "text", "spans").mapInPandas(run, "doc_id bigint, th bigint, range bigint, d1 bigint, d2 bigint")


def _digested(ids, ths, ranges, digests) -> pd.DataFrame:
    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pd.DataFrame({"doc_id": np.concatenate(ids), "th": np.concatenate(ths), "range": np.concatenate(ranges), "d1": d[:, 0], "d2": d[:, 1]})


def dedup_substrings(docs: DataFrame, span: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n_words, n_removed, spans (removed words, as [first, end) pairs in a flat list) and kept_text (other words, one blank between) added.

    A word goes if a window of ``span`` words covers it whose words also start in a document of a
    smaller doc_id; windows are judged on the input. Repeats inside one document stay. Null, empty and short texts lose
    nothing; a row with a null doc_id is no source and loses nothing; rows that share a doc_id are one document
    for the judgement and are each cut. Columns named as the new ones are replaced.
    """
    new = ("n_words", "n_removed", "spans", "kept_text")
    rest = [c for c in docs.columns if c not in new]
    key, th, found, at, hashed = fresh([*docs.columns, *new], "id", "th", "ranges", "at", "hash")
    named = docs.select(*rest, F.col(doc_id).cast("long").alias(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(th))
    ranges = repeated_ranges(named.select(F.col(key).alias("doc_id"), F.col(th).alias("th"), F.col(text).alias("text")), span)
    fields = [f for f in named.schema.fields if f.name not in (key, th)]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("kept_text", T.StringType())])

    def cut(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500].reset_index(drop=True)
                rows = []
                for t, r in zip(part[text].tolist(), part[found].tolist(), strict=True):
                    w = words(t if isinstance(t, str) else None)
                    if r is None or not len(r):
                        rows.append((len(w), 0, [], b" ".join(w).decode("utf-8", "surrogatepass")))
                        continue
                    o = np.asarray(r, np.int64)
                    cover = np.zeros(len(w) + 1, np.int64)
                    np.add.at(cover, o >> 32, 1)
                    np.add.at(cover, (o >> 32) + (o & 0xFFFFFFFF) + span - 1, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    kept = [w[k] for k in np.flatnonzero(~gone).tolist()]
                    rows.append((len(w), int(gone.sum()), edge.tolist(), b" ".join(kept).decode("utf-8", "surrogatepass")))
                yield pd.concat([part.drop(columns=found), pd.DataFrame(rows, columns=list(new))], axis=1)

    keys = ranges.select(F.col("doc_id").alias(at), F.col("th").alias(hashed), F.col("ranges").alias(found))
    flagged, clean = split_by(named, ranges, key, th)
    own = [f.name for f in fields]
    joined = flagged.join(keys, (F.col(key) == F.col(at)) & (F.col(th) == F.col(hashed)), "left").select(*own, found)
    plain = clean.select(*own, F.lit(None).cast("array<bigint>").alias(found))
    return joined.mapInPandas(cut, schema).unionByName(plain.mapInPandas(cut, schema))
