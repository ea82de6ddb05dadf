"""Distributed positional inverted index, with exact phrase and proximity matches, for benchmark decontamination.

The index is cut by documents: a segment holds the postings (term -> word positions)
of one batch of documents. Segments are stored as rows of a table in the shared folder, so matching
reads them without a shuffle, a hot source or copied document is never gathered
anywhere, and a lost executor costs a few segments. Phrases go through all segments in blocks of a bounded size.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, store

#: Words of a segment, about; a single longer document is one segment.
SEGMENT_WORDS = 1_000_000
#: Bytes of benchmark texts that the driver and a worker hold at once; a larger benchmark goes through in blocks of about this size.
BLOCK_BYTES = 8_000_000

_KEPT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

INDEX_SCHEMA = "segment bigint, doc_ids array<bigint>, text_hashes array<bigint>, n_words array<int>, terms array<binary>, counts array<int>, postings binary"


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes runs of a-z, 0-9 and non-ASCII characters, as UTF-8. None has no words."""
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split() if text else []


def build_index(docs: DataFrame, terms: set[bytes] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments over every document of ``docs``; with ``terms``, only their postings are kept.

    A document with a null or empty text has a row in its segment and no postings.
    Repeated rows are separate documents, and so are rows without an id. Only the two named columns are read. An empty table gives no segments.
    """
    session = docs.sparkSession
    wanted = None if terms is None else session.sparkContext.broadcast({w: i for i, w in enumerate(sorted(terms))})

    def segments(batches):
        ids, hashes, sizes, parts, total, vocab = [], [], [], [], 0, {} if wanted is None else wanted.value
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for pdf in batches:
            for i, h, t in zip(pdf["i"].tolist(), pdf["h"].tolist(), pdf["t"].tolist(), strict=True):
                w = words(t if isinstance(t, str) else None)
                if wanted is None:
                    for x in w:
                        vocab.setdefault(x, len(vocab))
                ids.append(None if pd.isna(i) else int(i))
                hashes.append(int(h))
                sizes.append(len(w))
                parts.append(np.fromiter(map(vocab.get, w, repeat(-1)), np.int32, len(w)))
                total += len(w) + 1
                if total >= SEGMENT_WORDS:
                    yield _segment(number, ids, hashes, sizes, parts, vocab)
                    number += 1
                    ids, hashes, sizes, parts, total = [], [], [], [], 0
                    vocab = {} if wanted is None else vocab
        if ids:
            yield _segment(number, ids, hashes, sizes, parts, vocab)
        give_back()

    own = docs.select(F.col(doc_id).cast("long").alias("i"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return own.mapInPandas(segments, INDEX_SCHEMA)


def _segment(number, ids, hashes, sizes, parts, vocab) -> pd.DataFrame:
    """Postings are word positions in the segment, where one position is left free after each document."""
    gap = np.full(1, -1, np.int32)
    at = np.concatenate([x for p in parts for x in (p, gap)])
    place = np.flatnonzero(at >= 0).astype(np.uint32)
    order = np.argsort(at[place], kind="stable")
    found, counts = np.unique(at[place], return_counts=True)
    names = list(vocab)
    delta = np.diff(place[order], prepend=np.uint32(0)).astype(np.uint32)  # wraps between terms; the running sum wraps back
    return pd.DataFrame({"segment": [number], "doc_ids": [ids], "text_hashes": [hashes], "n_words": [sizes], "terms": [[names[k] for k in found]], "counts": [counts.tolist()], "postings": [delta.tobytes()]})


class _Segment:
    """One stored segment, opened: sorted lists of positions, one after the other."""

    def __init__(self, row):
        self.number_of, self.doc_ids, self.hashes, self.sizes = int(row["segment"]), row["doc_ids"], row["text_hashes"], np.asarray(row["n_words"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.number = {bytes(t): k for k, t in enumerate(row["terms"])}
        self.counts = np.append(np.asarray(row["counts"], np.int64), 0)  # the last stands for terms that don't occur
        self.list_at = np.concatenate([[0], np.cumsum(self.counts)])
        self.places = np.cumsum(np.frombuffer(row["postings"], np.uint32), dtype=np.uint32).astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.counts) - 1), self.counts[:-1]) << 32) | self.places  # all lists in one: ascending by term, then position

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.list_at[term] : self.list_at[term + 1]]

    def phrases(self, want: np.ndarray, chunk: int = 4_000_000):
        """(row of ``want``, start) of each place where a row's terms stand one after the other.

        Starts with the postings of a row's rarest term here, less its offset, and intersects
        them with the list of the next rarest, less its own, and so on: a start stays if the list holds its position.
        """
        n, length = want.shape
        rarity = self.counts[want]
        live = np.flatnonzero(rarity.min(axis=1) > 0)
        order = np.argsort(rarity[live], axis=1, kind="stable")
        first = want[live, order[:, 0]] if len(live) else np.zeros(0, np.int64)
        cost = np.cumsum(self.counts[first])
        for lo, hi in _chunks(cost, chunk):
            part, terms = live[lo:hi], first[lo:hi]
            rows = np.repeat(np.arange(hi - lo), self.counts[terms])
            begin = np.repeat(self.list_at[terms] - np.concatenate([[0], np.cumsum(self.counts[terms])[:-1]]), self.counts[terms])
            start = self.places[begin + np.arange(len(rows))] - order[lo:hi][rows, 0]
            for k in range(1, length):
                if not len(rows):
                    break
                off = order[lo:hi][rows, k]
                aim = (want[part[rows], off] << 32) | np.maximum(start + off, 0)
                at = np.minimum(np.searchsorted(self.keys, aim), len(self.keys) - 1)
                keep = (self.keys[at] == aim) & (start >= 0)
                rows, start = rows[keep], start[keep]
            yield part[rows], start

    def matches(self, block: Block):
        """(first word, words, item ids of each) of all occurrences of a block's phrases."""
        number = np.array([self.number.get(w, -1) for w in block.terms], np.int64)
        for length, (windows, owners) in block.phrases.items():
            for row, start in self.phrases(number[windows]):
                yield start, length, owners[row]


def _chunks(cost: np.ndarray, most: int):
    lo = 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


class Block:
    """Some items of a benchmark: their terms, and by length the windows of terms, of all items, with the items' ids."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        number: dict[bytes, int] = {}
        held: dict[int, list] = {}
        for i, text in items:
            ids = np.array([number.setdefault(w, len(number)) for w in words(text)], np.int64)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                held.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), i, np.int64)))
        self.terms = list(number)
        self.phrases = {n: (np.concatenate([r for r, _ in x]), np.concatenate([o for _, o in x])) for n, x in held.items()}


def phrase_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 13) -> list:
    """Functions that each make a Block of the items' windows; more than one if the texts have over BLOCK_BYTES. Null items, ids and texts without words give no phrase."""
    own = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    return [lambda k=k: Block([tuple(r) for r in own.where(part == k).collect()], window) for k in range(parts)]


def _covered(s: _Segment, found: list[tuple[np.ndarray, int, np.ndarray]]):
    """(words inside any occurrence, ids of items that occur) of each document."""
    cover, pairs = np.zeros(int(s.starts[-1]) + 2, np.int32), [np.zeros((0, 2), np.int64)]
    for start, length, own in found:
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
        pairs.append(np.unique(np.stack([np.searchsorted(s.starts, start, side="right") - 1, own], 1), axis=0))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    items = [[] for _ in s.sizes]
    for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
        items[d].append(i)
    return hit[s.starts[1:] - 1] - hit[s.starts[:-1]], items


_MATCH = "doc_id bigint, text_hash bigint, n_words bigint, n_hit bigint, item_ids array<bigint>"


def _matched(s: _Segment, found: list) -> pd.DataFrame:
    hit, items = _covered(s, found)
    return pd.DataFrame({"doc_id": pd.array(s.doc_ids, dtype="Int64"), "text_hash": s.hashes, "n_words": s.sizes, "n_hit": hit, "item_ids": items})


def match_phrases(index: DataFrame, blocks: list) -> DataFrame:
    """Per document of the index: doc_id, text_hash, n_words, n_hit (words inside any occurrence of a phrase), item_ids (of phrases that occur, ascending).

    One block is matched in one pass over the segments. Of several, one is held at a time; occurrences are stored and joined to their segments.
    """
    sc = index.sparkSession.sparkContext
    if len(blocks) == 1:
        shared = sc.broadcast(blocks[0]())

        def match(batches):
            for pdf in batches:
                for _, row in pdf.iterrows():
                    s = _Segment(row)
                    yield _matched(s, list(s.matches(shared.value)))

        return index.mapInPandas(match, _MATCH)
    hits = None
    for make in blocks:
        shared = sc.broadcast(make())

        def find(batches, shared=shared):
            for pdf in batches:
                for _, row in pdf.iterrows():
                    s = _Segment(row)
                    for start, length, own in s.matches(shared.value):
                        if len(start):
                            yield pd.DataFrame({"segment": [s.number_of], "length": [length], "start": [start.tobytes()], "owner": [own.tobytes()]})

        part = store(index.mapInPandas(find, "segment bigint, length int, start binary, owner binary"), "hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    joined = index.join(hits.groupBy("segment").agg(F.collect_list(F.struct("length", "start", "owner")).alias("hits")), "segment", "left")

    def gather(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                found = [(np.frombuffer(h["start"], np.int64), h["length"], np.frombuffer(h["owner"], np.int64)) for h in (row["hits"] if row["hits"] is not None else [])]
                yield _matched(_Segment(row), found)

    return joined.mapInPandas(gather, _MATCH)


def match_near(index: DataFrame, queries: dict[int, list[str]], slop: int) -> DataFrame:
    """(query, doc_id, position): where all words of a query, in any order, lie within len(query) + slop words from ``position`` on.

    ``position`` counts from 0 in the document and holds a word of the query. Words are as ``words`` gives them; an empty query matches nothing.
    """
    wanted = {q: [w for t in ws for w in words(t)] for q, ws in queries.items()}

    def match(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                s = _Segment(row)
                for q, ws in wanted.items():
                    terms = sorted({s.number.get(w, -1) for w in ws}, key=lambda t: s.counts[t])
                    if not terms or s.counts[terms[0]] == 0:
                        continue
                    span, lists = len(ws) + slop, [s.postings(t) for t in terms]
                    for start in np.unique(np.concatenate(lists)).tolist():
                        doc = int(np.searchsorted(s.starts, start, side="right") - 1)
                        end = min(start + span, int(s.starts[doc + 1]) - 1)
                        if all(np.searchsorted(x, end) > np.searchsorted(x, start) for x in lists):
                            out.append((q, s.doc_ids[doc], start - int(s.starts[doc])))
            yield pd.DataFrame(out, columns=["query", "doc_id", "position"]).astype({"query": "int64", "doc_id": "Int64", "position": "int64"})

    return index.mapInPandas(match, "query bigint, doc_id bigint, position bigint")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Phrase matches of every item window against every document, through a stored index; (doc_id, text_hash, n_words, n_hit, item_ids, contaminated), one row for each of ``docs``.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. The index holds the terms of the items only where these are one block, else all. Null and empty texts
    have no words and are never hit; null doc_ids and repeated rows are documents of their own; long texts are read whole. Empty items: nothing is hit. Empty ``docs``: no rows.
    """
    blocks = phrase_blocks(items, window=window)
    if len(blocks) == 1:
        only = blocks[0]()
        blocks, terms = [lambda: only], set(only.terms)
    else:
        terms = None
    found = match_phrases(store(build_index(docs, terms), "index"), blocks)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
