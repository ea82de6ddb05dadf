"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits are cut into blocks of odd length; the code is a product of
repetition codes, which are perfect: every block has one nearest codeword, at
most half its length away. A fingerprint lives at its nearest anchor and visits every
anchor within the covering radius plus the threshold, counted block by block: each
anchor that a fingerprint at most ``threshold`` bits away can live at. So two linked
fingerprints meet at the home of either, and are compared there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, executors_tidy, give_back, split_by, store, tidy, whole_groups

#: (Distinct fingerprints up to, block length): shorter blocks give more anchors with fewer fingerprints at each.
CODES = [(20_000, 7), (1_000_000, 5), (2**63, 3)]
#: Visitors of an anchor in one task; a larger anchor is cut into pieces that each meet all its residents, in pieces as well.
PIECE = 20_000
#: Comparisons at once, and visitors from which on neighbours are looked up instead of compared.
AT_ONCE, LOOK_UP = 4_000_000, 200_000


def fingerprint(text: str | bytes | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; no words: 0. Bytes count as they are, characters or not."""
    w = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split() if text else []
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w])
        begins = [0, *ends[:-words].tolist()]
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8")
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long) of every row; null and empty texts have 0.

    Arrow columns, not frames: among null ids a frame would hold the others as doubles, exact to 53 bits only.
    """

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id bigint, fp bigint")


def anchors(fps: np.ndarray, length: int, threshold: int = 2):
    """(row, anchor, at home) for each anchor that a fingerprint lives at or visits."""
    count = 64 // length
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)[:, : count * length]
    ones = bits.reshape(len(fps), count, length).sum(axis=2, dtype=np.int64)
    major = ones > length // 2
    cost = np.where(major, ones - length // 2, length // 2 + 1 - ones)  # flips until another codeword is nearest
    power = np.int64(1) << np.arange(count, dtype=np.int64)
    home = major @ power
    rows, where, here = [np.arange(len(fps))], [home], [np.ones(len(fps), bool)]

    def visit(first: int, spent: np.ndarray, turned: np.ndarray, own: np.ndarray):
        for b in range(first, count):
            ok = spent + cost[own, b] <= threshold
            if ok.any():
                r, s, t = own[ok], spent[ok] + cost[own[ok], b], turned[ok] ^ power[b]
                rows.append(r)
                where.append(t)
                here.append(np.zeros(len(r), bool))
                more = s < threshold
                if more.any():
                    visit(b + 1, s[more], t[more], r[more])

    visit(0, np.zeros(len(fps), np.int64), home.copy(), np.arange(len(fps)))
    return np.concatenate(rows), np.concatenate(where), np.concatenate(here)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of components after links a-b; labels are least indices."""
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _near(threshold: int) -> np.ndarray:
    masks = level = [0]
    for _ in range(threshold):
        level = sorted({m ^ (1 << i) for m in level for i in range(64)})
        masks = sorted({*masks, *level})
    return np.array([m for m in masks if m], np.uint64)


def _links(guests: np.ndarray, homes: np.ndarray, threshold: int) -> np.ndarray:
    """Component labels of ``guests`` (indices) after all links between ``homes`` (values, all compared with every guest) and guests."""
    nodes = np.concatenate([guests, homes])
    label = np.arange(len(nodes))
    _, inverse = np.unique(nodes, return_inverse=True)
    first = np.full(inverse.max() + 1, len(nodes))
    np.minimum.at(first, inverse, label)
    label = first[inverse]
    if len(guests) >= LOOK_UP:
        order, near = np.argsort(guests, kind="stable"), _near(threshold)
        ranked = guests[order]
        for i in range(len(homes)):
            want = homes[i] ^ near
            at = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
            hit = order[at[ranked[at] == want]]
            if len(hit):
                label = _join(label, np.full(len(hit), len(guests) + i), hit)
        return label
    step = max(1, AT_ONCE // max(1, len(guests)))
    for at in range(0, len(homes), step):
        d = np.bitwise_count(homes[at : at + step, None] ^ guests[None, :])
        h, g = np.nonzero((d <= threshold) & (d > 0))
        if len(h):
            label = _join(label, len(guests) + at + h, g)
    return label


def near_links(distinct: DataFrame, threshold: int = 2, rows: int | None = None) -> DataFrame:
    """Links (a, b) that join all of ``distinct`` (fp) which chains of at most ``threshold`` differing bits join.

    At each anchor, links are found exactly and a forest of them is returned, so the rows never exceed the visits.
    """
    n = distinct.count() if rows is None else rows
    length = next(k for most, k in CODES if n <= most)

    def spread(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 2000):
                part = fps[at : at + 2000]
                r, where, here = anchors(part.view(np.uint64), length, threshold)
                yield pd.DataFrame({"anchor": where, "fp": part[r], "home": here})

    visits = distinct.select("fp").mapInPandas(spread, "anchor bigint, fp bigint, home boolean")
    if n > PIECE:
        crowd = visits.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("h")).where(F.col("n") > PIECE)
        crowd = store(crowd.select("anchor", F.ceil(F.col("n") / PIECE).cast("int").alias("gs"), F.ceil(F.greatest(F.col("h"), F.lit(1)) / PIECE).cast("int").alias("hs")), "crowd")
        few = crowd.count()
        if few:
            visits = visits.join(F.broadcast(crowd) if few <= 10_000 else crowd, "anchor", "left")
    if "gs" not in visits.columns:
        visits = visits.withColumns({"gs": F.lit(1), "hs": F.lit(1)})
    gs, hs, pick = F.coalesce("gs", F.lit(1)), F.coalesce("hs", F.lit(1)), lambda k: F.pmod(F.xxhash64("fp"), k).cast("int")
    guest = visits.select("anchor", "fp", F.lit(False).alias("home"), pick(gs).alias("g"), F.explode(F.sequence(F.lit(0), hs - 1)).alias("h"))
    home = visits.where("home").select("anchor", "fp", F.lit(True).alias("home"), F.explode(F.sequence(F.lit(0), gs - 1)).alias("g"), pick(hs).alias("h"))
    keys = ["anchor", "g", "h"]

    def link(batches):
        for pdf in whole_groups(batches, keys):
            a, b = [], []
            for _, rows in pdf.groupby(keys, sort=False).indices.items():
                fps, at_home = pdf["fp"].to_numpy(np.int64)[rows].view(np.uint64), pdf["home"].to_numpy(bool)[rows]
                guests, homes = fps[~at_home], fps[at_home]
                if len(homes) and len(guests) and (len(guests) > 1 or (homes != guests[0]).any()):
                    label = _links(guests, homes, threshold)
                    nodes = np.concatenate([guests, homes]).view(np.int64)
                    other = nodes != nodes[label]
                    a.append(nodes[other])
                    b.append(nodes[label][other])
            yield pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)}).drop_duplicates()

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return guest.unionByName(home).repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id that chains of links reach, itself included.

    Equal fingerprints are one node, so groups of copies cost one comparison. Null and empty texts
    share fingerprint 0. Rows with a null doc_id are linked too, but name no component; a component of them alone has null.
    Repeated rows give repeated rows. An empty table gives no rows.
    """
    own = store(fingerprints(docs, text, words, doc_id), "fingerprints")
    distinct = store(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct")
    found = components(near_links(distinct, threshold))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())  # a root is a member as well
    least = found.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    every = distinct.join(named, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id"))
    return _handed_out(own, every)


def _handed_out(own: DataFrame, every: DataFrame) -> DataFrame:
    """Rows of ``own`` (doc_id, fp) with the component of their fingerprint. Fingerprints of over a thousandth of all rows, so fewer than a thousand, are broadcast: their rows stay where they are."""
    every = store(every, "components")
    most = F.lit((every.agg(F.sum("rows")).first()[0] or 0) / 1000)
    hot = every.where(F.col("rows") > most).select(F.col("fp").alias("hot"), F.col("component_id").alias("at"))
    marked = own.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left")
    rest = marked.where("hot IS NULL").select("doc_id", "fp").join(every.where(F.col("rows") <= most).drop("rows"), "fp").select("doc_id", "fp", "component_id")
    return marked.where("hot IS NOT NULL").select("doc_id", "fp", F.col("at").alias("component_id")).unionByName(rest)


# ---- links by similarity of shingles -----------------------------------------------------------------------------

#: Least hashes that documents of like shingles are first linked by.
TABLES = 8
#: Documents whose shingles are counted to find frequent ones, and in how many of these a frequent one is. They set the order of shingles only, not what is found.
SAMPLE, FREQUENT = 20_000, 3
#: Slices of the shingles of prefixes, at most, and sets from which on there is one more.
SLICES, SLICED = 5, 45_000


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a text of fewer words is one shingle."""
    digest = xxhash.xxh3_64_intdigest
    w = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]).tolist()
    begins = [0, *ends]
    some = [digest(joined[begins[k] : ends[k + words - 1] - 1]) for k in range(len(w) - words + 1)] or [digest(joined)]
    return np.unique(np.array(some, np.uint64))


def _named(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 1)).view(np.int64))


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that several documents of a sample hold, and how many."""

    def run(batches):
        for pdf in batches:
            sets = [shingle_set(t, words) for t in pdf["t"].tolist()]
            yield pd.DataFrame({"s": np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)})

    n = docs.count()
    share = max(1, -(-n // SAMPLE))
    some = docs.where(F.pmod(F.xxhash64("i"), share) == 0).select("t").mapInPandas(run, "s bigint")
    found = some.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(500_000).toPandas()
    s, k = found["s"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], k[order]


def _prefix(shingles: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles, rare ones first: two sets that are alike have their first common shingle among these of either."""
    s, k = frequent
    many = np.zeros(len(shingles), np.int64)
    if len(s):
        at = np.minimum(np.searchsorted(s, shingles), len(s) - 1)
        many = np.where(s[at] == shingles, k[at], 0)
    keep = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
    return shingles[np.lexsort((shingles, many))][:keep]


def _meetings(group: np.ndarray, comp: np.ndarray, size: np.ndarray, place: np.ndarray, part: np.ndarray, apart: np.ndarray, similarity: float):
    """Index pairs of rows (sorted by group) that may be alike: of one group and two components, of like sizes, and with enough shingles left behind the common one.

    Where ``apart``, the rows are two pieces of a crowd and only rows of different pieces meet.
    """
    ahead = np.arange(len(group)) - np.searchsorted(group, group)
    left = np.flatnonzero(ahead)
    for lag in range(1, int(ahead.max(initial=0)) + 1):
        j = left = left[ahead[left] >= lag]
        i = j - lag
        x, y = size[i], size[j]
        common = np.minimum(x - place[i], y - place[j])  # at most, if this is their first common shingle
        ok = (comp[i] != comp[j]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6) & ((1 + similarity) * common >= similarity * (x + y) - 1e-6)
        ok &= ~apart[j] | (part[i] != part[j])
        if ok.any():
            yield i[ok], j[ok]


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Parities of numbers of shingles by their hashes, packed: a power of two of them, four a shingle or more (65536 at most)."""
    m = 1 << min(16, max(6, int(4 * len(shingles) - 1).bit_length()))
    return np.packbits((np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8))


def _may_be_alike(x: int, p: bytes, y: int, q: bytes, similarity: float) -> bool:
    """False only if sets of ``x`` and ``y`` shingles surely are not: what both hold cancels out, so they differ in as many shingles as in parities, or more."""
    u, v = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return (1 + similarity) * int(np.bitwise_count(u ^ v).sum()) <= (1 - similarity) * (x + y) + 1e-6


def similar_links(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) between doc_ids whose sets of word shingles have a Jaccard similarity of ``similarity`` or more: each a true one, and enough to join all that chains of such links join.

    Equal sets are one node, named by the least doc_id that holds it. Sets with a common least hash are first compared with the least, the one before and one at random,
    so a group of copies gives as many pairs as it has members. Then every two sets of different components that share a shingle
    of their prefixes (all but ``similarity`` of a set, and one more, rare shingles first) are compared, which no two alike can escape; the shingles of a crowd are cut into pieces that all meet.
    Only pairs whose parities leave it open are compared whole. Prefixes are worked off in ``SLICES`` by shingle, and pairs in rounds, so that shuffles of a part of them are on disk at once; all are worked off.
    Texts of fewer words are one shingle. Null ids name no document; a doc_id of several texts has the links of each.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    odd = np.random.default_rng(20).integers(1, 2**63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def describe(batches):
        for pdf in batches:
            sets = [shingle_set(t, words) for t in pdf["t"].tolist()]
            least = [np.array([(s * m).min() for m in odd]).tobytes() for s in sets]
            yield pd.DataFrame({"doc_id": pdf["i"], "node": [_named(s) for s in sets], "size": [len(s) for s in sets], "least": least, "parities": [_parities(s).tobytes() for s in sets]})
        give_back()

    described = store(texts.mapInPandas(describe, "doc_id bigint, node bigint, size int, least binary, parities binary"), "sets")
    own = store(described.select("doc_id", "node"), "own")
    sets = store(described.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("least").alias("least"), F.first("parities").alias("parities")), "distinct-sets")
    nodes = sets.select("node", "doc_id")
    drop(described)
    del described
    tidy(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b: nodes) that are alike."""
        marks = lambda k, x, p: sets.select(F.col("node").alias(k), F.col("size").alias(x), F.col("parities").alias(p))

        def open_ones(batches):
            for pdf in batches:
                ok = [_may_be_alike(x, p, y, q, similarity) for x, p, y, q in zip(pdf["x"].tolist(), pdf["p"].tolist(), pdf["y"].tolist(), pdf["q"].tolist(), strict=True)]
                yield pdf.loc[np.array(ok, bool), ["a", "b"]]

        def in_rounds(todo: DataFrame, n: int, most: int, work, name: str) -> DataFrame:
            """``work`` on ``todo`` in rounds of ``most`` pairs or so, all of them stored."""
            done, rounds = None, max(1, -(-n // max(1, most)))
            for r in range(rounds):
                part = todo if rounds == 1 else todo.where(F.pmod(F.xxhash64("b", "a"), rounds) == r)
                one = store(work(part), name)
                done = one if done is None else done.unionByName(one)
                stored.append(one)
                tidy(spark)
            return done

        def by_parities(part: DataFrame) -> DataFrame:
            return part.join(marks("a", "x", "p"), "a").join(marks("b", "y", "q"), "b").select("a", "b", "x", "p", "y", "q").mapInPandas(open_ones, "a bigint, b bigint")

        stored = [pairs]
        left = in_rounds(pairs, pairs.count(), 4 * sets.count(), by_parities, "open")
        asked = store(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
        holders = store(nodes.join(asked, "node").select("doc_id", F.lit(0).alias("th")).distinct(), "holders")

        def shingled(batches):
            for pdf in batches:
                found = [shingle_set(t, words) for t in pdf["t"].tolist()]
                yield pd.DataFrame({"node": [_named(s) for s in found], "shingles": [s.tobytes() for s in found]})
            give_back()

        again = split_by(texts.withColumn("_z", F.lit(0)), holders, "i", "_z")[0].select("t").mapInPandas(shingled, "node bigint, shingles binary")
        known = store(again.join(asked, "node", "left_semi").dropDuplicates(["node"]), "shingles")
        del again
        tidy(spark)

        def check(batches):
            for pdf in batches:
                ok = []
                for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(common >= similarity * (len(x) + len(y) - common))
                yield pdf.loc[np.array(ok, bool), ["a", "b"]]
            give_back()

        def whole(part: DataFrame) -> DataFrame:
            both = part.join(known.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            return both.select("a", "b", "x", "y").mapInPandas(check, "a bigint, b bigint")

        out = store(in_rounds(left, left.count(), 2 * asked.count(), whole, "alike"), "alike")
        for t in (asked, holders, known, *stored):
            drop(t)
        tidy(spark)
        return out

    # first links, linear in the members of a group
    def by_least(batches):
        for pdf in batches:
            for t in range(TABLES):
                least = np.array([np.frombuffer(x, np.int64)[t] for x in pdf["least"].tolist()], np.int64)
                yield pd.DataFrame({"table": t, "least": least, "node": pdf["node"], "doc_id": pdf["doc_id"], "size": pdf["size"]})

    spread = store(sets.select("node", "doc_id", "size", "least").mapInPandas(by_least, "table int, least bigint, node bigint, doc_id bigint, size bigint"), "least")
    shared = spread.groupBy("table", "least").agg(F.min(F.struct("doc_id", "node", "size")).alias("low"), F.count("*").alias("n")).where("n > 1")
    met = store(spread.join(shared, ["table", "least"]), "met")
    drop(spread)
    del spread, shared
    tidy(spark)
    # neighbours in order of ids and in an order by chance: members of a crowd are dealt to groups of a bounded size
    dealt = met.withColumn("g", F.pmod(F.xxhash64("doc_id", "table"), F.ceil(F.col("n") / 1000))).drop("low", "n")

    def neighbours(batches):
        for pdf in whole_groups(batches, ["table", "least", "g"]):
            key = np.unique(np.stack([pdf["table"].to_numpy(np.int64), pdf["least"].to_numpy(np.int64), pdf["g"].to_numpy(np.int64)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            ids, node, size = (pdf[k].to_numpy(np.int64) for k in ("doc_id", "node", "size"))
            a, b, t = [], [], []
            for by in (ids, (ids * np.int64(-7046029254386353131)) ^ key):
                order = np.lexsort((by, key))
                i, j = order[:-1], order[1:]
                ok = (key[i] == key[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
                a.append(node[i[ok]])
                b.append(node[j[ok]])
                t.append(pdf["table"].to_numpy(np.int32)[i[ok]])
            yield pd.DataFrame({"table": np.concatenate(t), "a": np.concatenate(a), "b": np.concatenate(b)})

    keys = ["table", "least", "g"]
    near = dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(neighbours, "table int, a bigint, b bigint")
    hub = met.where((F.col("node") != F.col("low.node")) & (F.least("size", "low.size") >= similarity * F.greatest("size", "low.size"))).select("table", F.col("node").alias("a"), F.col("low.node").alias("b"))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    # two that are 0.8 alike share most least hashes; what meets by one of them only is left to the second pass, which finds all
    met_in = near.unionByName(hub).select("table", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    first = verified(store(met_in.groupBy("a", "b").count().where("count > 1").select("a", "b"), "pairs"))
    drop(met)
    del met, dealt, near, hub, met_in
    comps = components(first).select("node", F.col("root").alias("comp"))
    tidy(spark)
    executors_tidy(spark)

    # every other pair
    frequent = spark.sparkContext.broadcast(_frequent(texts, words))
    tidy(spark)

    def prefixed(batches):
        for pdf in batches:
            found = [shingle_set(t, words) for t in pdf["t"].tolist()]
            yield pd.DataFrame({"doc_id": pdf["i"], "node": [_named(s) for s in found], "prefix": [_prefix(s, similarity, frequent.value).tobytes() for s in found]})
        give_back()

    named = sets.select("node", "doc_id", "size").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    once = texts.mapInPandas(prefixed, "doc_id bigint, node bigint, prefix binary").groupBy("node", "doc_id").agg(F.first("prefix").alias("prefix"))
    with_comp = store(once.join(named, ["node", "doc_id"]).select("node", "comp", "size", "prefix"), "prefixes")
    del named, once
    tidy(spark)
    piece = max(2, PIECE // 4)
    crowd_keys = ["s", "g", "h"]

    def exploded(k: int, slices: int):
        def run(batches):
            for pdf in batches:
                rows = pdf["prefix"].tolist()
                for at in range(0, len(rows), 500):
                    every, here = [np.frombuffer(x, np.uint64) for x in rows[at : at + 500]], pdf.iloc[at : at + 500]
                    places = [np.flatnonzero((x >> np.uint64(32)) % np.uint64(slices) == k) for x in every]
                    n = [len(x) for x in places]
                    s = np.concatenate([x[p] for x, p in zip(every, places, strict=True)]).view(np.int64)
                    yield pd.DataFrame({"s": s, "node": np.repeat(here["node"].to_numpy(), n), "comp": np.repeat(here["comp"].to_numpy(), n), "size": np.repeat(here["size"].to_numpy(), n), "place": np.concatenate(places)})

        return run

    def pair(batches):
        for pdf in whole_groups(batches, crowd_keys):
            v = {k: pdf[k].to_numpy(np.int64) for k in pdf.columns}
            change = (v["s"][1:] != v["s"][:-1]) | (v["g"][1:] != v["g"][:-1]) | (v["h"][1:] != v["h"][:-1])
            group = np.concatenate([[0], np.cumsum(change)])
            a, b, held = [], [], 0
            for i, j in _meetings(group, v["comp"], v["size"], v["place"], v["part"], v["g"] != v["h"], similarity):
                a.append(v["node"][i])
                b.append(v["node"][j])
                held += len(i)
                if held > 500_000:
                    yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
                    a, b, held = [], [], 0
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
        give_back()

    def met_in_slice(k: int, slices: int) -> DataFrame:
        """Pairs that share a shingle of this slice, stored."""
        postings = with_comp.mapInPandas(exploded(k, slices), "s bigint, node bigint, comp bigint, size int, place int")
        several = postings.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y")
        live = store(several.select("s", F.ceil(F.col("n") / piece).cast("int").alias("k")), "live")
        del several
        tidy(spark)
        some = split_by(postings.withColumn("_z", F.lit(0)), live.select(F.col("s").alias("doc_id"), F.lit(0).alias("th")), "s", "_z")[0].drop("_z").join(live, "s")
        some = some.withColumn("part", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        some = some.withColumns({"g": F.least("part", "q"), "h": F.greatest("part", "q")}).drop("q", "k")
        found = some.repartition(parts, *crowd_keys).sortWithinPartitions(*crowd_keys).mapInPandas(pair, "a bigint, b bigint")
        out = store(ordered(found), "pairs")
        drop(live)
        del some, found, postings
        tidy(spark)
        return out

    slices = min(SLICES, -(-sets.count() // SLICED) or 1)
    met = [met_in_slice(k, slices) for k in range(slices)]
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    pairs = store(every.distinct(), "pairs") if slices > 1 else every
    for t in (with_comp, *(met if slices > 1 else [])):
        drop(t)
    del met, every
    tidy(spark)
    executors_tidy(spark)
    second = verified(pairs)

    names = lambda k: nodes.select(F.col("node").alias(k), F.col("doc_id").alias(f"{k}_id"))
    links = first.unionByName(second).join(names("a"), "a").join(names("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = own.join(nodes.withColumnRenamed("doc_id", "b"), "node").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    out = store(links.unionByName(same).where("a <> b"), "links")
    for t in (own, sets, first, second):
        drop(t)
    tidy(spark)
    return out
