import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import pitman_yor as py
from tessella.llm.mtree_topk import MTree, top_k, whole_vectors
from tessella.llm.quality_rff import NAMES, classify, isotonic, statistics

# ---- top-k ---------------------------------------------------------------------------------------------------------


def best(vectors, q, own, k):
    return sorted(((int(sum(a * b for a, b in zip(v, q, strict=True))), i) for i, v in vectors if i != own), key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "few values"])
def test_mtree_is_exact(kind):
    rng = np.random.default_rng(4)
    n = 1500
    v = {"random": rng.integers(-60, 60, (n, 8)), "clusters": rng.integers(-60, 60, (10, 8))[rng.integers(0, 10, n)] + rng.integers(-2, 3, (n, 8)), "equal": np.full((n, 8), 3), "few values": rng.integers(0, 2, (n, 8))}[kind].astype(float)
    ids = rng.permutation(n)
    tree = MTree(ids, v)
    rows = list(zip(ids.tolist(), v.tolist(), strict=True))
    some = np.arange(0, n, 150)
    assert tree.search(v[some], ids[some], 20) == [best(rows, v[j], int(ids[j]), 20) for j in some]
    assert len(MTree(ids[:3], v[:3]).search(v[:1], ids[:1], 20)[0]) == 2 and MTree(ids[:0], v[:0]).search(v[:2], ids[:2], 5) == [[], []]


def test_topk_over_tables(spark, monkeypatch, with_clashes):
    from tessella.llm import mtree_topk as M

    monkeypatch.setattr(M, "SHARD_ROWS", 40)
    monkeypatch.setattr(M, "QUERY_ROWS", 5)
    monkeypatch.setattr(M, "PAGE", 8)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 4).round(3).tolist()) for i in range(120)] + [(i, [0.5, -0.5, 0.25, 1.0]) for i in range(200, 260)]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    v = whole_vectors(with_clashes(df, "v", "shard", "block", "score"))
    got = {}
    for r in top_k(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    whole = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
    asked = [(i, e) for i, e in whole if i % 20 == 0]
    assert sorted(got) == sorted(i for i, _ in asked)
    for i, e in asked:
        assert sorted(got[i]) == [(k + 1, s, j) for k, (s, j) in enumerate(best(whole, e, i, 20))]
    assert top_k(v.limit(0), v).count() == 0 and top_k(v, v.limit(0)).count() == 0
    assert top_k(v.where("vec_id < 3"), v.where("vec_id = 0")).count() == 2


def test_large_products_are_exact_or_refused(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(-(2**22), 2**22, (600, 64)).astype(float)
    ids = np.arange(600)
    rows = list(zip(ids.tolist(), v.astype(int).tolist(), strict=True))
    assert MTree(ids, v).search(v[:6], ids[:6], 20) == [best(rows, r, i, 20) for i, r in rows[:6]]
    huge = spark.createDataFrame([(1, [2.0**27] * 4), (2, [1.0] * 4)], "vec_id long, v array<double>")
    with pytest.raises(ValueError):
        top_k(huge, huge)


def test_bounds_spare_distances():
    rng = np.random.default_rng(8)
    v = (rng.integers(-3000, 3000, (40, 8))[np.arange(4000) % 40] + rng.integers(-3, 4, (4000, 8))).astype(float)
    tree = MTree(np.arange(4000), v)
    asked = v[:20]
    got = tree.search(asked, np.arange(20), 10)
    assert got == [best(list(enumerate(v.tolist())), q, i, 10) for i, q in enumerate(asked.tolist())]
    assert tree.computed < 0.35 * 4000 * 20  # all pairs are 4000 * 20; pages of 256 hold several of the 40 clusters
    spent = tree.computed
    tree.search(asked, np.arange(20), 10, np.array([g[-1][0] for g in got]))
    assert tree.computed - spent <= spent


# ---- classifier ------------------------------------------------------------------------------------------------------


def test_isotonic():
    got = isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1]))
    assert got == pytest.approx([0, 2 / 3, 2 / 3, 1]) and len(isotonic(np.zeros(0), np.zeros(0))) == 0


def test_classifier(spark, documents, odd, no_documents, with_clashes):
    rng = np.random.default_rng(8)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "over", "stones,", "slowly.", "north", "of", "town"], 40))
    bad = lambda: " ".join(w + "%%% |" for w in rng.choice(["BUY", "NOW", "!!!"], 40))
    rows = [(i, good() if i % 2 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)] + [(0, None, 0), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(with_clashes(documents(rows), "stats", "score", "y", "part", "_t", "__text"), labels).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.97
    assert {r["score"] for r in classify(odd, labels.limit(0)).collect()} == {0.5}
    assert classify(odd, labels).count() == odd.count() and classify(no_documents, labels).count() == 0
    assert len(statistics(None)) == len(NAMES) == len(statistics("a | b!")) and all(map(math.isfinite, statistics("x" * 100_000)))


def test_scores_are_those_of_plain_least_squares(spark, documents):
    """The same model with all rows in one matrix, and isotonic values by their max-min formula."""
    from tessella.llm import quality_rff as Q

    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["the", "of", "BUY", "12", "x|", "stone,"], int(rng.integers(1, 60))))) for i in range(300)]
    label = {i: int(rng.random() < (0.9 if "BUY" not in t else 0.2)) for i, t in rows}
    labels = spark.createDataFrame([(i, y, 0) for i, y in label.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in classify(documents(rows), labels).collect()}
    stats = np.array([statistics(t) for _, t in rows])
    part = {r[0]: r[1] for r in spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(Q.PARTS))).collect()}
    model = Q.Model(stats.mean(axis=0), stats.std(axis=0))
    z, y, part = model.features(stats), np.array([label[i] for i, _ in rows], float), np.array([part[i] for i, _ in rows])
    learnt = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows])

    def weights(at):
        return np.linalg.solve(z[at].T @ z[at] + Q.RIDGE * at.sum() * np.eye(z.shape[1]), z[at].T @ y[at])

    unseen = np.zeros(300)
    for p in range(Q.PARTS):
        at = part == p
        unseen[at] = z[at] @ weights(learnt & ~at)
    bins = ((np.clip(unseen, -0.5, 1.5) + 0.5) / 2 * Q.BINS).astype(int)
    knots = np.unique(bins[learnt])
    n = np.array([(bins[learnt] == b).sum() for b in knots], float)
    total = np.array([y[learnt][bins[learnt] == b].sum() for b in knots])
    mean = lambda a, b: total[a : b + 1].sum() / n[a : b + 1].sum()
    value = [max(min(mean(a, b) for b in range(i, len(knots))) for a in range(i + 1)) for i in range(len(knots))]
    want = np.interp(z @ weights(learnt), (knots + 0.5) / Q.BINS * 2 - 0.5, value)
    assert max(abs(got[i] - want[k]) for k, (i, _) in enumerate(rows)) < 1e-6


def test_labels_of_held_out_rows_are_not_learnt(spark, documents):
    docs = documents([(i, f"text {i} " * (i % 9 + 1)) for i in range(300)])
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = lambda flip: spark.createDataFrame([(i, (i % 9 < 4) ^ (flip and out(i)), 0) for i in range(300)], "doc_id long, quality boolean, toxic int").withColumn("quality", F.col("quality").cast("int"))
    assert sorted(classify(docs, label(False)).collect()) == sorted(classify(docs, label(True)).collect())


# ---- language model --------------------------------------------------------------------------------------------------


def tables_by_hand(c, prior, others, d, a):
    """Probabilities of 1 to c tables, from the recursion of generalised Stirling numbers."""
    row = [-math.inf, 0.0]
    for n in range(1, c):
        row.append(-math.inf)
        row = [-math.inf] + [np.logaddexp(row[t - 1], row[t] + math.log(n - t * d) if n - t * d > 0 else -math.inf) for t in range(1, n + 2)]
    w = np.array([row[t] + sum(math.log((a + d * (others + i)) * prior) for i in range(t)) for t in range(1, c + 1)])
    p = np.exp(w - w.max())
    return p / p.sum()


@pytest.mark.parametrize("c,prior,others", [(3, 0.3, 0), (20, 0.05, 10), (90, 0.2, 300), (500, 0.01, 200), (2000, 0.01, 500), (400, 0.5, 400)])
def test_tables_follow_their_exact_conditional(c, prior, others):
    d, a, n = 0.7, 1.0, 3000
    want = tables_by_hand(c, prior, others, d, a)
    mean = float((want * np.arange(1, c + 1)).sum())
    spread = math.sqrt(float((want * np.arange(1, c + 1) ** 2).sum()) - mean**2)
    rng, t = np.random.default_rng(2), np.ones(n, np.int64)
    for k in range(6):
        t = py.draw_tables(np.full(n, c), np.full(n, prior), np.full(n, others), t, d, rng, a, first=k == 0)
    assert t.min() >= 1 and t.max() <= c
    assert abs(t.mean() - mean) < 0.05 * spread + 0.02 * mean and abs(t.std() - spread) < 0.1 * spread + 0.02


def test_log_stirling_of_many_customers():
    for d in (0.2, 0.5, 0.8):
        for c in (101, 700):
            exact = [-math.inf, 0.0]
            for n in range(1, c):
                exact = [-math.inf] + [np.logaddexp(exact[t - 1], (exact[t] if t <= n else -math.inf) + (math.log(n - t * d) if n > t * d else -math.inf)) for t in range(1, n + 2)]
            t = np.arange(1, 80)
            got = py.log_stirling(np.full(len(t), c), t, d) + math.lgamma(c + 1)
            assert np.abs(got - np.array(exact[1:80])).max() < 0.05 and np.abs(got - np.array(exact[1:80]))[:10].max() < 1e-4, (d, c)


def gibbs_by_hand(texts, rounds, rng):
    """Averaged predictive probabilities of a customer-by-customer sampler of the same model, as a function of (context, word)."""
    rooms = {}
    for t in texts:
        for u, w in zip(["", *t], [*t, ""], strict=True):
            rooms.setdefault(u, Counter())[w] += 1
    vocabulary = {w for r in rooms.values() for w in r}
    pairs = [c for r in rooms.values() for c in r.values()]
    d = py.discount(pairs.count(1), pairs.count(2))
    contexts = Counter(w for r in rooms.values() for w in r)
    d0 = py.discount(list(contexts.values()).count(1), list(contexts.values()).count(2))
    base = 1 / (len(vocabulary) + 1)
    seats = {u: {w: [1] * c for w, c in r.items()} for u, r in rooms.items()}
    top = {w: [1] * sum(len(r.get(w, [])) for r in seats.values()) for w in vocabulary}

    def p0(w):
        n, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(top.get(w, [])) - d0 * len(top.get(w, [])) + (1 + d0 * t) * base) / (1 + n)

    def p(u, w):
        r = seats.get(u, {})
        n, t = sum(map(sum, r.values())), sum(map(len, r.values()))
        return (sum(r.get(w, [])) - d * len(r.get(w, [])) + (1 + d * t) * p0(w)) / (1 + n)

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def sit(tables, d, fresh):
        k = rng.choices(range(len(tables) + 1), [*[s - d for s in tables], fresh])[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def move_top(w, on):
        if on:
            sit(top[w], d0, (1 + d0 * sum(map(len, top.values()))) * base)
        else:
            leave(top[w])

    asked = [(u, w) for u in [*rooms, "?"] for w in [*vocabulary, "?"]]
    total = dict.fromkeys(asked, 0.0)
    for k in range(rounds + 30):
        for u, r in seats.items():
            for w, tables in r.items():
                for _ in range(sum(tables)):
                    if leave(tables):
                        move_top(w, False)
                    if sit(tables, d, (1 + d * sum(map(len, r.values()))) * p0(w)):
                        move_top(w, True)
        if k >= 30:
            for x in asked:
                total[x] += p(*x) / rounds
    return total


def test_scores_agree_with_a_sampler_by_hand(documents, monkeypatch):
    import random

    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rng = random.Random(4)
    texts = [rng.choices(["a", "b", "c", "d"], [8, 3, 2, 1], k=5) + (["e"] if k % 3 == 0 else []) for k in range(16)]
    train, out = [i for i in range(100) if not held(i)][:16], [i for i in range(100) if held(i)][:2]
    rows = [*zip(train, texts, strict=True), (out[0], ["a", "a", "new", "b"]), (out[1], ["e", "c", "d"])]
    want = gibbs_by_hand(texts, 400, rng)
    monkeypatch.setattr(py, "SAMPLES", 16)
    got = {r["doc_id"]: r["score"] for r in py.score(documents([(i, " ".join(t)) for i, t in rows])).collect()}
    known = {w for t in texts for w in t}
    name = lambda w: w if w in known or not w else "?"
    for i, t in rows:
        assert abs(got[i] - sum(math.log10(want[name(u), name(w)]) for u, w in zip(["", *t], [*t, ""], strict=True))) < 0.1


def test_scores(spark, documents, odd, no_documents, with_clashes, monkeypatch):
    rng = np.random.default_rng(3)
    chain = {w: rng.choice([f"w{k}" for k in range(60)], 3) for w in (f"w{k}" for k in range(60))}

    def text():
        w = ["w0"]
        for _ in range(40):
            w.append(str(rng.choice(chain[w[-1]])))
        return " ".join(w).upper()

    rows = [(i, text()) for i in range(200)] + [(1000, None), (1001, ""), (1002, "never seen W1"), (None, text()), (3, text())]
    monkeypatch.setattr(py, "BURN_IN", 1)
    monkeypatch.setattr(py, "SAMPLES", 1)
    for room in (16_000_000, 4000):
        monkeypatch.setattr(py, "ROOM_BYTES", room)
        got = py.score(with_clashes(documents(rows), "held_out", "others", "row", "c", "key", "kind")).collect()
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        counts, ends = Counter(), 0
        for i, t in rows:
            if not held(i):
                counts.update((t or "").lower().split())
                ends += 1
        n, v = sum(counts.values()) + ends, len(counts) + 1

        def base(t):
            w = (t or "").lower().split()
            return len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), 6)

        key = lambda i, *x: (i is None, i or 0, *x)
        assert sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted(key(i, held(i), *base(t)) for i, t in rows)
        assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 100
    assert py.score(odd).count() == odd.count() and py.score(no_documents).count() == 0
    nothing = documents([(i, "a b") for i in range(40) if held(i)])
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in py.score(nothing).collect()} == {(0, 0, 0.0)}


def test_scores_do_not_depend_on_how_texts_are_dealt(spark, documents, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice([f"v{k * k % 37}" for k in range(60)], 30))) for i in range(120)]
    monkeypatch.setattr(py, "ROOM_BYTES", 3000)
    monkeypatch.setattr(py, "BURN_IN", 1)
    seen = []
    for parts, lot, order in ((1, 3_000_000, rows), (5, 400, rows[::-1])):
        monkeypatch.setattr(py, "LOT_TOKENS", lot)
        seen.append({r["doc_id"]: round(r["score"], 9) for r in py.score(documents(order).repartition(parts)).collect()})
    assert seen[0] == seen[1]


def test_texts_seen_twice_score_higher(documents, monkeypatch):
    monkeypatch.setattr(py, "SAMPLES", 1)
    rng = np.random.default_rng(6)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [i for i in range(900) if not held(i)]
    text = {i: " ".join(f"r{x}" for x in rng.integers(0, 2000, 30)) for i in train[:300]}
    rows = [*text.items(), *zip(train[300:340], [text[i] for i in train[:40]], strict=True)]
    gain = {r["doc_id"]: r["score"] - r["base_score"] for r in py.score(documents(rows)).collect()}
    once, twice = [gain[i] for i in train[40:300]], [gain[i] for i in train[:40]]
    assert np.mean(np.array(twice) > np.quantile(once, 0.95)) > 0.9
