"""Hierarchical Pitman-Yor language model of words, sampled by Gibbs over Chinese-restaurant seatings.

Every word, and the end of a text, is a dish; every previous word is a context with a restaurant of its own. All contexts
share one parent, the restaurant without context, whose customers are the tables of its children; its base is uniform over the words seen and
one place for all others. A seating enters probabilities by its numbers of tables only, so the sampler draws the tables of
a dish, given all others, from their exact conditional (generalised Stirling numbers count the seatings). Customers are whole counts: no word and no context is left out.

In Spark, contexts are dealt to rooms (a frequent context to several) and words to shards of the parent. A room or shard is a few
packed arrays. In a sweep the rooms send their tables to the shards, which seat the parent and answer with its counts;
then the rooms reseat. Predictive probabilities are averaged over the samples. Rooms and shards depend on the
texts alone, and so do the seeds: the same texts give the same scores, however they are dealt to tasks.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, give_back, store, store_dealt, tidy

#: Bytes of text for each room, about; tokens that a task sorts at once; texts of such a lot at most.
ROOM_BYTES, LOT_TOKENS, LOT_TEXTS = 16_000_000, 2_000_000, 65_535
#: A context is frequent, and dealt to several rooms, if it holds this part of a room; texts are sampled to find them: bytes for each room. This deals out work and changes no count.
FREQUENT, SAMPLE_BYTES = 0.25, 100_000
#: Sweeps before samples are taken, and samples.
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
SEED = 7
#: Up to this many customers the number of tables is drawn from a table of all its probabilities; beyond by STEPS Metropolis steps.
EXACT, STEPS = 100, 6


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of other than blanks and line ends (0x20, 0x09-0x0D)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: The end of a text, named as the word of no letters.
END = xxhash.xxh3_64_intdigest(b"")


# ---- numbers of tables -------------------------------------------------------------------------------------------


def discount(once: float, twice: float) -> float:
    """From the numbers of things seen once and twice, as in Kneser-Ney smoothing."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


_stirling: dict[float, np.ndarray] = {}


def log_stirling_table(d: float) -> np.ndarray:
    """log of the number of seatings, weighted by the sizes of tables, of c customers at t tables, c and t up to EXACT."""
    if d not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        for c in range(1, EXACT):
            stay = out[c, 1:] + np.log(np.maximum(c - t * d, 1e-300))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
        _stirling.clear()
        _stirling[d] = out
    return _stirling[d]


def _log_factorial(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    x = n + 1.0
    shift = np.where(x < 10, np.log(np.maximum(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) * (x + 8) * (x + 9), 1e-300)), 0.0)
    x = np.where(x < 10, x + 10, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - shift


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the same number over c!, by the saddle point of its generating function ((1 - (1 - z)**d) / d)**t / t!."""
    want = np.log(c / t)
    lo, hi = np.full(len(c), -690.0), np.full(len(c), -1e-12)  # log(1 - z)
    for _ in range(42):
        mid = (lo + hi) / 2
        g = np.log(d) + np.log(-np.expm1(mid)) + (d - 1) * mid - np.log(-np.expm1(d * mid))
        low = g > want
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    y = (lo + hi) / 2
    z, f, h = -np.expm1(y), -np.expm1(d * y) / d, c / t
    spread = t * np.maximum(h - h * h + z * z * (1 - d) * np.exp((d - 2) * y) / f, 1e-12)
    return -_log_factorial(t) + t * np.log(f) - c * np.log(z) - 0.5 * np.log(2 * np.pi * spread)


def _series(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the same number over c!, by the finite alternating sum over powers of (1 - z)**d; exact where tables are few for their customers."""
    n, log_c = c.astype(float), np.log(c)
    total, binomial = np.zeros(len(c)), np.zeros(len(c))
    for j in range(1, 81):
        x = j * d
        binomial = binomial + np.log(np.maximum(t - j + 1, 0) / j, where=t >= j, out=np.full(len(c), -np.inf))
        fall = np.where(n > 1e5, -x * log_c + x * (x + 1) / (2 * n), _log_factorial(np.maximum(n - x - 1, 0.0)) - _log_factorial(n - 1))  # gamma(c - x) / gamma(c)
        term = np.exp(binomial + fall + float(_log_factorial(np.array(x))))
        total += (-1) ** (j + 1) * np.sin(np.pi * x) / np.pi * term
        if not (term > 1e-13).any():
            break
    return np.log(np.maximum(total, 1e-300)) - log_c - t * np.log(d) - _log_factorial(t)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same over c!, for many customers: the sum where tables are few, the saddle point elsewhere."""
    few = t < np.exp(d * np.log(c)) * min(2 ** (1 - d) / d, 10.0)
    out = np.empty(len(c))
    out[few] = _series(c[few], t[few], d)
    out[~few] = _saddle(c[~few], t[~few], d)
    return out


def _rising(others: np.ndarray, t: np.ndarray, d: float, strength: float) -> np.ndarray:
    """log of the product of strength + d * (others + i) for i below t."""
    x = strength / d + others
    return t * np.log(d) + _log_factorial(x + t - 1) - _log_factorial(x - 1)


def draw_tables(c: np.ndarray, prior: np.ndarray, others: np.ndarray, t: np.ndarray, d: float, rng, strength: float = STRENGTH, first: bool = False) -> np.ndarray:
    """New numbers of tables of dishes with ``c`` customers, each given ``others``, the tables of all other dishes in its restaurant, and ``prior``, the parent's probability."""
    out, table = t.copy(), log_stirling_table(d)
    out[c <= 1] = c[c <= 1]
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(c[small])) + 1, [len(small)]])
    for a, b in zip(bounds, bounds[1:], strict=False):
        for lo in range(a, b, 100_000):
            at = small[lo : min(b, lo + 100_000)]
            n = int(c[at[0]]) if len(at) else 0
            if n == 0:
                continue
            weight = np.log((strength + d * (others[at][:, None] + np.arange(n))) * prior[at][:, None])
            weight = np.cumsum(weight, axis=1) + table[n, 1 : n + 1]
            cum = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + np.minimum((cum < (rng.random(len(at)) * cum[:, -1])[:, None]).sum(axis=1), n - 1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        n, p, o = c[large].astype(float), np.log(prior[large]), others[large].astype(float)
        now = out[large].astype(np.int64)
        if first:  # about where a seating by the predictive rule would end
            seated, tables = np.ones(len(n)), np.ones(len(n))
            while (seated < n).any():
                step = np.minimum(np.maximum(1.0, seated * 0.2), n - seated)
                x = (strength + d * (o + tables)) * prior[large]
                tables += step * x / (x + seated - d * tables)
                seated += step
            now = np.clip(np.rint(tables), 1, n).astype(np.int64)
        value = lambda k: log_stirling(n, k, d) + _rising(o, k, d, strength) + k * p
        have = value(now)
        for _ in range(STEPS * (4 if first else 1)):
            scale = np.maximum(1.0, 0.8 * np.sqrt(now))
            move = np.rint(rng.normal(size=len(n)) * scale).astype(np.int64)
            move = np.where(move == 0, np.where(rng.random(len(n)) < 0.5, 1, -1), move)
            new = now + move
            ok = (new >= 1) & (new <= n)
            new = np.where(ok, new, now)
            got = value(new)
            back = np.maximum(1.0, 0.8 * np.sqrt(new))  # the way back is proposed with another spread
            ratio = got - have + np.log(scale / back) + move**2 / 2 * (1 / scale**2 - 1 / back**2)
            take = ok & (np.log(rng.random(len(n))) < ratio)
            now, have = np.where(take, new, now), np.where(take, got, have)
        out[large] = now
    return out


# ---- packed arrays -----------------------------------------------------------------------------------------------

_ROW = "key bigint, kind int, src bigint, data binary, x double, y double"
LOT, META, PAIRS, SEATS, STATE, ASK, PARENT, ANSWER, TABLES, SUMS = range(10)


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the least type that holds them."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 2**32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for part in raw[4 : 4 + n].decode().split(";"):
        kind, size = part.rsplit(",", 1)
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += kind.itemsize * int(size)
    return out


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*r, *(0.0,) * (6 - len(r))) for r in rows], columns=["key", "kind", "src", "data", "x", "y"])


def _lean(function):
    """``function``, which gives its memory back when it is done."""

    def run(*frames):
        out = function(*frames)
        give_back()
        return out

    return run


def _heads(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


# ---- counts ------------------------------------------------------------------------------------------------------


class _Lot:
    """Texts of one task, sorted by room, context and word."""

    def __init__(self, rooms: int, frequent: dict[int, int]):
        self.rooms = rooms
        self.frequent = np.array(sorted(frequent), np.uint64)
        self.parts = np.array([frequent[k] for k in sorted(frequent)], np.uint64)
        self.clear()

    def clear(self):
        self.ids, self.held, self.tokens, self.total = [], [], [], 0
        self.local = defaultdict()
        self.local.default_factory = self.local.__len__
        self.local[b""]

    def add(self, doc_id, held: bool, text: str | None) -> bool:
        w = words(text)
        self.tokens.append(np.fromiter(map(self.local.__getitem__, w), np.int32, len(w)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.total += len(w) + 1
        return self.total >= LOT_TOKENS or len(self.ids) >= LOT_TEXTS

    def rows(self, lot: int) -> pd.DataFrame:
        order = np.argsort(np.array(self.held), kind="stable")  # texts to learn from come first
        n_train = len(order) - sum(self.held)
        ids = [self.ids[k] for k in order]
        tokens = [self.tokens[k] for k in order]
        end = np.zeros(1, np.int32)
        size = np.array([len(t) + 1 for t in tokens])
        word = np.concatenate([x for t in tokens for x in (t, end)])
        context = np.concatenate([x for t in tokens for x in (end, t)])
        doc = np.repeat(np.arange(len(tokens), dtype=np.int32), size)
        self.tokens, tokens = [], None
        name = np.fromiter(map(xxhash.xxh3_64_intdigest, self.local), np.uint64, len(self.local))
        room = (name % np.uint64(self.rooms)).astype(np.int64)[context]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, name), len(self.frequent) - 1)
            split = np.where(self.frequent[at] == name, self.parts[at], np.uint64(1))
            some = np.flatnonzero(split[context] > 1)
            c, w = name[context[some]], name[word[some]]
            part = (w >> np.uint64(24)) % split[context[some]]
            room[some] = ((c + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.rooms)).astype(np.int64)
        many = len(self.local)
        place, seat = np.unique(room * many + context, return_inverse=True)
        key = seat.reshape(-1) * many + word
        del room, context, word, seat
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        seen = np.diff(np.append(first, len(key)))
        seat, word = key[first] // many, key[first] % many
        rooms, begin = np.unique(place[seat] // many, return_index=True)
        out, limit = [], [*begin.tolist(), len(first)]
        for r, a, b in zip(rooms.tolist(), limit, limit[1:], strict=False):
            s, held = np.unique(seat[a:b], return_counts=True)
            w, at = np.unique(word[a:b], return_inverse=True)
            o, p = first[a], first[b] if b < len(first) else len(doc)
            out.append((r, LOT, lot, pack(name[place[s] % many], _small(held), name[w], _small(at.reshape(-1)), _small(seen[a:b]), _small(doc[o:p]), np.array([n_train]))))
        known = np.array([x is not None for x in ids])
        meta = pack(np.array([x or 0 for x in ids], np.int64), known, np.arange(len(ids)) >= n_train, size)
        self.clear()
        return _rows([*out, (self.rooms + lot % self.rooms, META, lot, meta)])


def _lots(texts: DataFrame, rooms: int, frequent) -> DataFrame:
    """Rows of LOT and META over (doc_id, held_out, text)."""

    def run(batches):
        held, number = _Lot(rooms, frequent.value), 0
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for pdf in batches:
            for i, h, t in zip(pdf["doc_id"].tolist(), pdf["held_out"].tolist(), pdf["text"].tolist(), strict=True):
                if held.add(None if pd.isna(i) else int(i), bool(h), t if isinstance(t, str) else None):
                    yield held.rows(part + number)
                    number += 1
                    give_back()
        if held.ids:
            yield held.rows(part + number)
        del held
        give_back()

    return texts.mapInPandas(run, _ROW)


def _gather(rooms: int):
    """All lots of a room in one: PAIRS (contexts, words by shard, counts), SEATS (in which text each token stands), STATE, and an ASK to each shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pdf[pdf["kind"] == META]
        out = [(r.src, META, r.src, r.data) for r in meta.itertuples()]
        lots = pdf[pdf["kind"] == LOT].sort_values("src").copy()
        if not len(lots):
            return _rows(out)
        room = int(pdf["key"].iloc[0])
        got = [unpack(d) for d in lots["data"]]
        u, ui = np.unique(np.concatenate([np.repeat(g[0], g[1]) for g in got]), return_inverse=True)
        w, wi = np.unique(np.concatenate([g[2][g[3]] for g in got]), return_inverse=True)
        seen = np.concatenate([g[4] for g in got])
        doc = np.concatenate([g[5] for g in got])
        lot = np.repeat(np.arange(len(got), dtype=np.int32), [len(g[5]) for g in got])
        train = np.concatenate([g[5] < g[6][0] for g in got])
        del got, lots["data"], pdf
        shard = ((w >> np.uint64(20)) % np.uint64(rooms)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        w, shard, wi = w[by], shard[by], back[wi.reshape(-1)]
        key = ui.reshape(-1) * len(w) + wi
        del ui, wi, by, back
        pair, at = np.unique(key, return_inverse=True)
        del key
        seat = np.repeat(at.reshape(-1).astype(np.int32), seen)
        del at, seen
        order = np.argsort(seat, kind="stable").astype(np.int32)
        seat, doc, lot, train = seat[order], doc[order], lot[order], train[order]
        del order
        n = np.bincount(seat, minlength=len(pair))
        c = np.bincount(seat, train, minlength=len(pair)).astype(np.int64)
        ui, wi = pair // len(w), pair % len(w)
        several = np.flatnonzero(c > 1)
        asked = np.unique(wi[several])
        customers = np.bincount(ui, c, minlength=len(u)).astype(np.int64)
        alone = np.bincount(ui, c == 1, minlength=len(u)).astype(np.int64)
        once, twice = float((c == 1).sum()), float((c == 2).sum())
        state = pack(u, _small(customers), _small(alone), _small(ui[several]), _small(np.searchsorted(asked, wi[several])), _small(c[several]), np.ones(len(several), np.uint8), np.zeros(len(several)), np.zeros(0))
        out += [
            (room, PAIRS, room, pack(u, w, _small(np.bincount(ui, minlength=len(u))), _small(wi), _small(c), np.bincount(shard, minlength=rooms))),
            (room, SEATS, room, pack(_small(n), _small(lot), _small(doc), lots["src"].to_numpy(np.int64))),
            (room, STATE, room, state, once, twice),
        ]
        ones, all_c = np.bincount(wi, c == 1, minlength=len(w)).astype(np.int64), np.bincount(wi, c, minlength=len(w)).astype(np.int64)
        first = np.bincount(wi, c > 1, minlength=len(w)).astype(np.int64)  # a table for each dish to begin with
        is_asked = np.zeros(len(w), bool)
        is_asked[asked] = True
        shards, begin = np.unique(shard, return_index=True)
        limit = [*begin.tolist(), len(w)]
        for s, a, b in zip(shards.tolist(), limit, limit[1:], strict=False):
            out.append((s, ASK, room, pack(w[a:b], _small(ones[a:b]), _small(all_c[a:b]), _small(np.flatnonzero(is_asked[a:b])), _small(first[a:b][is_asked[a:b]]))))
        return _rows(out)

    return run


# ---- the parent --------------------------------------------------------------------------------------------------


def _open_parent(pdf: pd.DataFrame) -> pd.DataFrame:
    """From all ASKs of a shard: PARENT (words, tables that never change, customers, own tables; who asked for which), with sums of its customers and distinct words."""
    asks = pdf.sort_values("src")
    got = [unpack(d) for d in asks["data"]]
    w, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    at = at.reshape(-1)
    fixed = np.bincount(at, np.concatenate([g[1] for g in got]), minlength=len(w)).astype(np.int64)
    customers = np.bincount(at, np.concatenate([g[2] for g in got]).astype(np.int64), minlength=len(w)).astype(np.int64)
    head = _heads(np.array([len(g[0]) for g in got]))
    some = np.concatenate([at[h + g[3].astype(np.int64)] for h, g in zip(head, got, strict=True)])
    tables = np.concatenate([g[4] for g in got])
    n = fixed + np.bincount(some, tables, minlength=len(w)).astype(np.int64)
    data = pack(_small(fixed), _small(customers), _small(np.minimum(n, 1)), asks["src"].to_numpy(np.int64), np.array([len(g[0]) for g in got]), np.array([len(g[3]) for g in got]), _small(at), _small(some), w)
    shard = int(pdf["key"].iloc[0])
    out = [(shard, PARENT, shard, data, float(customers.sum()), float((customers > 0).sum())), (shard, SUMS, shard, b"", float((n == 1).sum()), float((n == 2).sum()))]
    out += [(shard, TABLES, int(s), pack(g[4])) for s, g in zip(asks["src"], got, strict=True)]
    return _rows(out)


def _seat_parent(disc: float, total_tables: float, words_seen: int, number: int, keep: bool):
    """Reseats a shard of the parent. ANSWERs to the rooms: customers less discounted tables of the words asked for; SUMS: customers and tables; with ``keep`` a sample of all words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["key"].iloc[0])
        parent = unpack(pdf.loc[pdf["kind"] == PARENT, "data"].iloc[0])
        fixed, customers, own, rooms, sizes, asked, at, some, w = parent
        msgs = {r.src: r.data for r in pdf[pdf["kind"] == TABLES].itertuples()}
        tables = np.concatenate([unpack(msgs[r])[0] for r in rooms.tolist()])
        n = fixed.astype(np.int64) + np.bincount(some, tables, minlength=len(w)).astype(np.int64)
        own = np.minimum(np.maximum(own.astype(np.int64), n > 0), n)
        rng = np.random.default_rng([SEED, 1, number, shard])
        others = np.maximum(0.0, total_tables - own)
        new = draw_tables(n, np.full(len(n), 1.0 / (words_seen + 1)), others, own, disc, rng, first=number == 0)
        value = (n - disc * new).astype(np.float32)
        data = pack(fixed, customers, _small(new), rooms, sizes, asked, at, some, w)
        out = [(shard, PARENT, shard, data), (shard, SUMS, shard, b"", float(n.sum()), float(new.sum()))]
        limit = np.append(0, np.cumsum(asked)).tolist()
        out += [(int(r), ANSWER, shard, pack(value[some[a:b]])) for r, a, b in zip(rooms.tolist(), limit, limit[1:], strict=False)]
        if keep:
            limit = np.append(0, np.cumsum(sizes)).tolist()
            out += [(int(r), ASK, shard * 64 + number, pack(value[at[a:b]], customers[at[a:b]] if number == BURN_IN else customers[:0])) for r, a, b in zip(rooms.tolist(), limit, limit[1:], strict=False)]
        return _rows(out)

    return run


# ---- the rooms ---------------------------------------------------------------------------------------------------


def _totals(u: np.ndarray, own: np.ndarray, shared: dict[int, float]) -> np.ndarray:
    """Of each context: ``own``, or for one in several rooms what ``shared`` has."""
    if not shared:
        return own
    keys = np.array(sorted(shared), np.uint64)
    at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
    return np.where(keys[at] == u, np.array([shared[k] for k in sorted(shared)])[at], own)


def _seat_rooms(disc: float, parent_disc: float, sums: tuple[float, float], words_seen: int, number: int, keep: bool, customers, tables, rooms: int):
    """Reseats all dishes of a room's contexts, given the parent; STATE, and TABLES to the shards. ``customers``, ``tables``: totals of contexts in several rooms, before the sweep."""
    n, t0 = sums

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        room = int(pdf["key"].iloc[0])
        state = pdf.loc[pdf["kind"] == STATE, "data"]
        u, guests, alone, ui, ask, c, t, own, back = unpack(state.iloc[0])
        answers = pdf[pdf["kind"] == ANSWER].sort_values("src")
        parts = [unpack(d)[0] for d in answers["data"]]
        value = np.concatenate(parts).astype(float) if parts else np.zeros(0)
        prior = (value + (STRENGTH + parent_disc * t0) / (words_seen + 1)) / (STRENGTH + n)
        ui, c, t = ui.astype(np.int64), c.astype(np.int64), t.astype(np.int64)
        mine = alone + np.bincount(ui, t, minlength=len(u))
        total = _totals(u, mine, tables.value)
        away = total - mine
        rng = np.random.default_rng([SEED, 0, number, room])
        place = np.arange(len(ui)) - np.searchsorted(ui, ui)
        turns = int(min(4, place.max(initial=0) + 1))
        for turn in range(turns):  # neighbours in a restaurant see each other's new tables
            some = np.flatnonzero(place % turns == turn)
            now = (away + alone + np.bincount(ui, t, minlength=len(u)))[ui[some]]
            t[some] = draw_tables(c[some], prior[ask[some]], now - t[some], t[some], disc, rng, first=number == 0)
        mine = alone + np.bincount(ui, t, minlength=len(u))
        everyone = _totals(u, guests.astype(float), customers.value)
        if keep:
            own = own + (c - disc * t) / (STRENGTH + everyone)[ui] / SAMPLES
            back = np.concatenate([back, (STRENGTH + disc * (away + mine)) / (STRENGTH + everyone)])
        data = pack(u, guests, alone, _small(ui), ask, _small(c), _small(t), own, back)
        sent = np.bincount(ask, t, minlength=len(value)).astype(np.int64)
        out, at = [(room, STATE, room, data)], 0
        for s, p in zip(answers["src"].tolist(), parts, strict=True):
            out.append((s, TABLES, room, pack(_small(sent[at : at + len(p)]))))
            at += len(p)
        return _rows(out)

    return run


def _shared(state: DataFrame, frequent: dict[int, int], what: str) -> dict[int, float]:
    """Customers or tables of the contexts that stand in several rooms, over all of them; as many numbers as there are such contexts."""
    if not frequent:
        return {}
    names = np.array(sorted(frequent), np.uint64)

    def run(batches):
        for pdf in batches:
            for d in pdf["data"]:
                u, guests, alone, ui, _, _, t, _, _ = unpack(d)
                some = np.flatnonzero(np.isin(u, names))
                n = guests if what == "customers" else alone + np.bincount(ui, t, minlength=len(u))
                yield pd.DataFrame({"u": u[some].view(np.int64), "n": n[some].astype(float)})

    found = state.select("data").mapInPandas(run, "u bigint, n double").groupBy("u").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["u"]).view(np.uint64)): r["n"] for r in found}


def _score(disc: float, parent_disc: float, sums: dict[int, tuple[float, float]], words_seen: int, tokens: float, rooms: int, customers):
    """Sums by text of a room's tokens: log10 probability, log10 of the base, known tokens. Goes to the lots that the texts came in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        room = int(pdf["key"].iloc[0])
        one = lambda kind: unpack(pdf.loc[pdf["kind"] == kind, "data"].iloc[0])
        u, w, width, wi, c, shards = one(PAIRS)
        _, guests, _, mui, _, mc, _, own, back = one(STATE)
        seen, lot, doc, lots = one(SEATS)
        answers = pdf[pdf["kind"] == ASK].sort_values("src")
        number, shard = answers["src"].to_numpy() % 64, answers["src"].to_numpy() // 64
        ui = np.repeat(np.arange(len(u)), width)
        everyone = _totals(u, guests.astype(float), customers.value)
        seats = np.where(c == 1, (1 - disc) / (STRENGTH + everyone)[ui], 0.0)
        seats[np.flatnonzero(c > 1)] = own
        back = back.reshape(SAMPLES, len(u))
        p = seats
        for k, at in enumerate(sorted(sums)):
            parts = [unpack(d) for d in answers.loc[number == at, "data"]]  # by shard, as the words are
            n, t0 = sums[at]
            prior = (np.concatenate([x[0] for x in parts]).astype(float) + (STRENGTH + parent_disc * t0) / (words_seen + 1)) / (STRENGTH + n)
            p = p + back[k][ui] * prior[wi] / SAMPLES
            if k == 0:  # the first sample carries the words' own counts as well
                count = np.concatenate([x[1] for x in parts]).astype(np.int64)
        log, base, known = np.log10(p), np.log10((count + 1.0) / (tokens + words_seen + 1))[wi], (count > 0)[wi]
        pair = np.repeat(np.arange(len(wi), dtype=np.int32), seen)
        order = np.argsort(lot, kind="stable").astype(np.int32)
        pair, doc, lot = pair[order], doc[order], lot[order]
        out, limit = [], np.searchsorted(lot, np.arange(len(lots) + 1)).tolist()
        for name, a, b in zip(lots.tolist(), limit, limit[1:], strict=False):
            some, at = np.unique(doc[a:b], return_inverse=True)
            at = at.reshape(-1)
            out.append((name, SUMS, room, pack(_small(some), *(np.bincount(at, x[pair[a:b]], minlength=len(some)) for x in (log, base)), _small(np.bincount(at, known[pair[a:b]], minlength=len(some)).astype(np.int64)))))
        return _rows(out)

    return run


def _texts(tokens: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, known, held, size = unpack(pdf.loc[pdf["kind"] == META, "data"].iloc[0])
        total = np.zeros((3, len(ids)))
        for d in pdf[pdf["kind"] == SUMS].sort_values("src")["data"]:
            doc, *sums = unpack(d)
            for k, s in enumerate(sums):
                total[k, doc] += s
        return pd.DataFrame(
            {"doc_id": pd.array(np.where(known, ids, 0), dtype="Int64").copy() if known.all() else pd.array([int(i) if k else None for i, k in zip(ids, known, strict=True)], dtype="Int64"),
             "held_out": held, "n_tokens": size.astype(np.int64), "n_known": total[2].astype(np.int64), "train_tokens": tokens, "base_score": total[1], "score": total[0]}
        )

    return run


def _frequent(own: DataFrame, size: int, rooms: int) -> dict[int, int]:
    """Contexts that hold FREQUENT of a room or more, by their hash, and how many rooms they are dealt to; at most rooms / FREQUENT of them."""
    share = max(1, size // (SAMPLE_BYTES * rooms))

    def run(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"].tolist():
                seen.update([b"", *words(t if isinstance(t, str) else None)])
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    some = own.where(F.pmod(F.xxhash64("text", "doc_id"), share) == 0).select("text").mapInPandas(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    some = store(some, "sampled")
    total = some.agg(F.sum("n")).first()[0] or 0
    least = max(1.0, total * FREQUENT / rooms)
    out = {}
    for r in some.where(F.col("n") >= least).collect() if rooms > 1 else []:
        out[xxhash.xxh3_64_intdigest(bytes(r["word"]))] = min(rooms, 1 + int(np.ceil(r["n"] / least)))
    drop(some)
    return out


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``; held_out marks the others. Tokens of a text are its words and one
    end. Null and empty texts have the end alone. A null doc_id is learnt from. Repeated rows count as often as they stand there. Without rows to learn from, N and V are 0
    and probabilities uniform. An empty table gives no rows. base_score: sum of log10((c + 1) / (N + V + 1)); score: the model's log10 probability.
    Words are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    rooms = max(1, -(-size // ROOM_BYTES))
    frequent = _frequent(own, size, rooms)
    share = spark.sparkContext.broadcast

    def step(rows: DataFrame, function, name: str) -> DataFrame:
        one = lambda pdf: lean(pdf)
        lean = _lean(function)
        out = store(rows.groupBy("key").applyInPandas(one, _ROW), name, by="kind")
        tidy(spark)
        return out

    def of(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds)).select("key", "kind", "src", "data", "x", "y")

    def sums(rows: DataFrame, kind: int) -> tuple[float, float]:
        return tuple(rows.where(F.col("kind") == kind).agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first())

    gather = _lean(_gather(rooms))
    gathered = _lots(own, rooms, share(frequent)).groupBy("key").applyInPandas(lambda pdf: gather(pdf), _ROW)
    packed = store_dealt(gathered, "rooms", "kind", "key", min(rooms, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    del gathered
    tidy(spark)
    disc = discount(*sums(packed, STATE))
    parent = step(of(packed, ASK), _open_parent, "parent")
    drop(packed, f"kind={ASK}")
    tokens, types = (int(x) for x in sums(parent, PARENT))
    parent_disc = discount(*sums(parent, SUMS))
    customers = share(_shared(of(packed, STATE), frequent, "customers"))
    seated, tables, samples, kept = packed, float(types), {}, []
    for number in range(BURN_IN + SAMPLES):
        keep = number >= BURN_IN
        new = step(of(parent, PARENT).unionByName(of(parent if number == 0 else seated, TABLES)), _seat_parent(parent_disc, tables, types, number, keep), "parent")
        for kind in (PARENT, ANSWER) if number > BURN_IN else ():  # of a sample, what it tells of all words stays
            drop(parent, f"kind={kind}")
        if number <= BURN_IN:
            drop(parent)
        parent = new
        total = sums(parent, SUMS)
        tables = total[1]
        if keep:
            samples[number] = total
            kept.append(parent)
        before = share(_shared(of(seated, STATE), frequent, "tables"))
        new = step(of(seated, STATE).unionByName(of(parent, ANSWER)), _seat_rooms(disc, parent_disc, total, types, number, keep, customers, before, rooms), "seated")
        if seated is not packed:
            drop(seated)
        seated = new
    for kind in (PARENT, ANSWER):
        drop(parent, f"kind={kind}")
    found = of(seated, STATE)
    for k in kept:
        found = found.unionByName(of(k, ASK))
    function = _lean(_score(disc, parent_disc, samples, types, float(tokens), rooms, customers))
    whole = of(packed, PAIRS, SEATS).groupBy("key").cogroup(found.groupBy("key")).applyInPandas(lambda left, right: function(pd.concat([left, right], ignore_index=True)), _ROW)
    scored = store(whole, "sums", by="kind")
    del whole
    tidy(spark)
    out = of(packed, META).unionByName(of(scored, SUMS)).groupBy("key").applyInPandas(_texts(tokens), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    out = store(out, "scores")
    for t in (packed, seated, scored, *kept):
        drop(t)
    return out
