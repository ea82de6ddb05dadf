import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from tessella.llm.queries import all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_entry_lists_the_queries():
    names = set(entry.queries())
    assert {"pipeline", *all_queries()} <= names and len([n for n in names if n.startswith("op")]) == 10
    assert set(entry.oracle_sql()) <= names


def stay_by_hand(rows):
    """The least id of each group, by links of fingerprints and of 5-word shingles that are 0.8 alike."""
    from tests.llm.test_text_operators import plain_fingerprint

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    fps, sets, root = [plain_fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            common = len(sets[i] & sets[j])
            if bin(fps[i] ^ fps[j]).count("1") <= 2 or common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return set(least.values())


def test_stages_against_what_they_promise(spark):
    from tests.llm.test_text_operators import cut_by_hand, hits_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages, kept = dict(cp.STAGES), {}
    for name, stage in cp.STAGES:
        before, docs = docs, cp.store(stage(spark, docs, SF), name)
        kept[name] = (before.toPandas(), docs.toPandas())
        assert docs.columns[:5] == cp.COLUMNS
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontaminate", "encode"]
    before, after = kept["quality"]
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").toPandas()["doc_id"]
    assert 0 < len(after) < len(before) and set(good) & set(before["doc_id"]) <= set(after["doc_id"])
    before, after = kept["near_dedup"]
    assert set(after["doc_id"]) == stay_by_hand(list(zip(before["doc_id"], before["text"], strict=True)))
    before, after = kept["substring_dedup"]
    want = {i: t for (i, n, gone, t) in cut_by_hand(list(zip(before["doc_id"], before["text"], strict=True)), 50) if gone and gone < n}
    texts = dict(zip(after["doc_id"], after["text"], strict=True))
    assert all(texts[i] == t for i, t in want.items()) and (after["n_chars"] == after["text"].str.len()).all()
    before, after = kept["decontaminate"]
    clean = {i for i, t in zip(before["doc_id"], before["text"], strict=True) if not (lambda n, h, _: h and 20 * h >= n)(*hits_by_hand(t, items))}
    assert set(after["doc_id"]) == clean
    assert len(kept["encode"][1]) == len(after) and (kept["encode"][1]["n_tokens"] > 0).all()
    assert cp.run(spark, SF).select(F.sum("n_tokens")).first()[0] == kept["encode"][1]["n_tokens"].sum()


def test_similar_links(documents, no_documents, with_clashes, odd, monkeypatch):
    from tessella.llm import simhash_anchors as S

    rng = np.random.default_rng(9)
    word = lambda: "w" + str(int(rng.zipf(1.3)) % 5000)
    rows = []
    for k in range(25):
        base = [word() for _ in range(int(rng.integers(60, 300)))]
        for c in range(4):
            w = list(base)
            for _ in range(int(c * rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = word()
            rows.append((k * 10 + c, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a c"), (None, rows[0][1]), (905, rows[0][1]), (905, rows[0][1])]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for piece in (20_000, 30):
        monkeypatch.setattr(S, "PIECE", piece)
        links = {tuple(sorted(r)) for r in S.similar_links(with_clashes(documents(rows), "a", "b", "fp", "more")).collect()}
        assert all(alike(a, b) for a, b in links) and (902, 903) in links and (902, 904) not in links
        ids = sorted({i for i, _ in rows if i is not None})
        linked = {b for a, b in links}
        want = {b for b in ids if any(a < b and alike(a, b) for a in ids)}
        assert linked <= want and len(want - linked) <= 0.05 * len(want)
    assert S.similar_links(no_documents).count() == 0 and {tuple(sorted(r)) for r in S.similar_links(odd).collect()} >= {(5, 6), (4, 9), (1, 2)}


def alike_by_hand(rows, k=5):
    """All pairs of ids whose sets of k-word shingles are 0.8 alike."""
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}))
    return {tuple(sorted((a, b))) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if len(x & y) >= 0.8 * len(x | y)}


def joined(ids, links):
    """The least id that chains of links reach, of each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def similar_by(documents, rows):
    from tessella.llm.simhash_anchors import similar_links

    links = {tuple(sorted(r)) for r in similar_links(documents(rows)).collect()}
    want = alike_by_hand(rows)
    assert links <= want
    ids = [i for i, _ in rows]
    assert joined(ids, links) == joined(ids, want)


def test_similar_links_of_copies_with_a_passage_added(documents):
    """Pairs of a Jaccard similarity just over 0.8 that differ in one block of words the other has none of."""
    rng, rows = np.random.default_rng(4), []
    for k in range(120):
        base = [f"b{k}x{i}" for i in range(int(rng.integers(200, 500)))]
        more = [f"n{k}x{i}" for i in range(int(0.235 * len(base)))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + more))]
    similar_by(documents, rows)


def test_similar_links_in_a_crowd(documents, monkeypatch):
    """Pairs of 0.82 among texts that share most of their words but are 0.7 alike: pieces of a crowd all meet."""
    from tessella.llm import simhash_anchors as S

    rows, base = [], [f"t{i}" for i in range(300)]
    for k in range(40):
        for c in range(2):
            rows.append((2 * k + c, " ".join(base + [f"p{k}x{i}" for i in range(60)] + [f"o{k}x{c}x{i}" for i in range(36)])))
    monkeypatch.setattr(S, "PIECE", 8)
    similar_by(documents, rows)


def test_similar_links_of_texts_with_equal_words(documents):
    """The least id has the same words in another order, so it is like neither of two that are alike."""
    rng, rows = np.random.default_rng(6), []
    for k in range(10):
        q = [[f"q{k}s{s}w{i}" for i in range(20)] for s in range(30)]
        text = lambda x: " ".join(w for s in x for w in s)
        mixed = [w for s in q for w in s]
        rng.shuffle(mixed)
        rows += [(3 * k, " ".join(mixed)), (3 * k + 1, text(q)), (3 * k + 2, text([q[1], q[0], *q[2:]]))]
    similar_by(documents, rows)


def test_near_dedup_keeps_one_of_repeated_rows(spark, documents):
    rows = [(1, "one text that is repeated"), (1, "one text that is repeated"), (2, "two"), (2, "two"), (2, "another text of the id"), (3, None), (3, None), (None, "no id"), (None, "no id"), (4, "alone among them all here")]
    got = [(r["doc_id"], r["text"]) for r in cp.near_dedup(spark, documents(rows), SF).collect()]
    want = [(1, "one text that is repeated"), (2, "another text of the id"), (2, "two"), (3, None), (4, "alone among them all here"), (None, "no id"), (None, "no id")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_similar_links_keep_little_on_disk(spark, documents, monkeypatch):
    """Stored tables never hold as much as the texts: prefixes are stored once, and worked off in slices and rounds."""
    from tessella.llm import simhash_anchors as S

    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        w = [f"w{int(x)}" for x in rng.integers(0, 50_000, int(rng.integers(300, 500)))]
        rows.append((3 * k, " ".join(w)))
        if k % 3 == 0:  # alike, or not quite
            for c, n in ((1, 4), (2, 12)):
                v = list(w)
                for at in rng.integers(0, len(w), n):
                    v[int(at)] = "x"
                rows.append((3 * k + c, " ".join(v)))
    kept, peak = {}, [0]
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))

    def store(df, name, by=None):
        out = stored(df.coalesce(1), name, by)
        kept[out._stored_at.removeprefix("file://")] = None
        peak[0] = max(peak[0], sum(size(p) for p in kept if os.path.isdir(p)))
        return out

    stored = S.store
    monkeypatch.setattr(S, "store", store)
    ids = [i for i, _ in rows]
    want = joined(ids, alike_by_hand(rows))
    for sliced in (45_000, 100):
        if sliced == 100:
            monkeypatch.setattr(S, "SLICED", sliced)
        links = [tuple(r) for r in S.similar_links(documents(rows)).collect()]
        assert joined(ids, links) == want and peak[0] < 0.8 * sum(len(t) for _, t in rows)


def test_parities_let_all_alike_pass():
    from tessella.llm import simhash_anchors as S

    rng, refused = np.random.default_rng(5), 0
    for n in (1, 3, 40, 400, 3000, 30_000):
        for share in (0.5, 0.78, 0.8, 0.82, 1.0):
            for more in (0.0, 0.5, 1.0):  # of the shingles that differ, on one side
                both = int(round(share * n))
                pool = np.unique(rng.integers(0, 2**64, 2 * n + 8, dtype=np.uint64))[:n]
                rng.shuffle(pool)
                own = int(round((n - both) * more))
                x, y = np.sort(pool[: both + own]), np.sort(np.concatenate([pool[:both], pool[both + own :]]))
                if len(x) and len(y):
                    ok = S._may_be_alike(len(x), S._parities(x).tobytes(), len(y), S._parities(y).tobytes(), 0.8)
                    assert ok or both < 0.8 * n
                    refused += not ok
    assert refused >= 10


def test_stages_begin_with_tidy_executors(spark, documents, monkeypatch):
    class Begun(Exception):
        pass

    def begun(session):
        raise Begun

    monkeypatch.setattr(cp, "executors_tidy", begun)
    for _, stage in cp.STAGES:
        with pytest.raises(Begun):
            stage(spark, documents([(1, "one")]), SF)


CLUSTER = """
import glob, sys
from pyspark.sql import SparkSession
from tessella.llm.common import executors_tidy

spark = SparkSession.builder.master("local-cluster[3,2,1000]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.executor.extraJavaOptions", "-Xlog:gc:file=" + sys.argv[1] + "/%p.gc").getOrCreate()
pauses = lambda: [open(f).read().count("(System.gc())") for f in sorted(glob.glob(sys.argv[1] + "/*.gc"))]
spark.range(0, 60, 1, 60).selectExpr("java_method('java.lang.Thread', 'activeCount')").collect()
while spark._jsc.sc().getExecutorMemoryStatus().size() < 4:
    pass
before = pauses()
executors_tidy(spark)
print("GC", len(before), sum(before), sum(n > 0 for n in pauses()))
spark.stop()
"""


def test_every_executor_collects_its_garbage(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    (tmp_path / "home" / "work").mkdir(parents=True)  # executors work in Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    repo = str(Path(cp.__file__).parent)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "GC 3 0 3" in ran.stdout, ran.stdout + ran.stderr
