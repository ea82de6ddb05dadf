"""Exact top-k by inner product with M-trees.

A vector x gets one more component sqrt(M**2 - |x|**2), where M is the greatest norm of its shard; for a
query with 0 there, a greater inner product is then a smaller Euclidean distance. Vectors go to the cell of their nearest pivot, and
each shard of a cell is one tree of paged metric nodes with covering radii and distances to the parent, built once and stored. A query
visits nodes best first; stored distances and the triangle inequality spare it the others. It first searches the cell of its own nearest pivot, then
only cells whose covering radius lets them hold something better. Scores are exact integers.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, store

#: Vectors of a tree, queries of a task, entries of a leaf, children of a node, pivots at most (further vectors of a cell go to further shards of it).
SHARD_ROWS, QUERY_ROWS, PAGE, FANOUT, PIVOTS = 8192, 8192, 256, 64, 1024
#: What rounding may do to a distance, as a part of the greatest distance there can be.
SLACK = 1e-7
#: Below this share of needed distances in a page they are computed one by one.
SPARSE = 0.2
_NONE = -(2**62)


class MTree:
    """Bulk-loaded M-tree over augmented vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        norms = (self.vectors**2).sum(axis=1)
        self.most = float(norms.max(initial=0.0))
        self.points = np.column_stack([self.vectors, np.sqrt(np.maximum(self.most - norms, 0.0))])
        self.nodes: list[dict] = []
        self.rng = np.random.default_rng(len(ids))
        self.computed = 0  # distances and products so far
        if len(ids):
            self.root = self._build(np.arange(len(ids)), self.points[0])

    def _build(self, rows: np.ndarray, center: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append({})
        far = np.sqrt(((self.points[rows] - center) ** 2).sum(axis=1))
        if len(rows) <= PAGE:
            order = np.argsort(rows)
            rows = rows[order]
            self.nodes[me] = {"center": center, "radius": float(far.max()), "rows": rows, "to_parent": far[order], "data": self.vectors[rows], "own": self.ids[rows]}
            return me
        pivots = self.points[self.rng.choice(rows, min(FANOUT, 1 + len(rows) // PAGE), replace=False)]
        p = self.points[rows]
        near = ((pivots**2).sum(axis=1)[None, :] - 2 * p @ pivots.T).argmin(axis=1)
        groups = [rows[near == i] for i in range(len(pivots))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # equal vectors cannot be told apart: pages in order of id
            groups = np.array_split(rows, min(FANOUT, -(-len(rows) // PAGE)))
        kids = [self._build(g, self.points[g[np.argmin(((self.points[g] - self.points[g].mean(axis=0)) ** 2).sum(axis=1))]]) for g in groups]
        ks = [self.nodes[k] for k in kids]
        centers = np.stack([k["center"] for k in ks])
        self.nodes[me] = {
            "center": center, "radius": float(far.max()), "kids": np.array(kids), "centers": centers, "radii": np.array([k["radius"] for k in ks]),
            "to_parent": np.sqrt(((centers - center) ** 2).sum(axis=1)),
        }
        return me

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, id) but for its ``own`` id: highest score first, ties to the smaller id.

        Every query goes best first on its own: its next node is the one of least possible distance, and it ends
        when that lies beyond its k-th best. Queries that are at the same node at the same time share the arithmetic.
        ``floor``: scores that a query already has k of; what is lower need not be found.
        """
        n, m = len(self.ids), len(queries)
        if not n or not m:
            return [[] for _ in range(m)]
        best, place = np.full((m, k), _NONE, np.int64), np.full((m, k), n, np.int64)  # scores, and positions: these ascend with ids
        q2, q = (queries**2).sum(axis=1), np.column_stack([queries, np.zeros(m)])
        slack = SLACK * np.sqrt(q2 + self.most)
        bound = np.full(m, np.inf) if floor is None else np.where(floor > _NONE, np.sqrt(np.maximum(0.0, q2 + self.most - 2.0 * floor)), np.inf)
        low = np.full((m, len(self.nodes)), np.inf)  # of nodes found and not yet visited
        far = np.zeros((m, len(self.nodes)))  # from a query to a node's center, where computed
        far[:, self.root] = np.sqrt(((q - self.nodes[self.root]["center"]) ** 2).sum(axis=1))
        low[:, self.root] = np.maximum(0, far[:, self.root] - self.nodes[self.root]["radius"])
        active = np.arange(m)
        while len(active):
            at = low[active].argmin(axis=1)
            live = np.isfinite(low[active, at]) & (low[active, at] <= (bound + slack)[active])
            active, at = active[live], at[live]
            low[active, at] = np.inf
            order = np.argsort(at, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                node, asked = self.nodes[at[group[0]]], active[group]
                near = np.abs(far[asked, at[group[0]], None] - node["to_parent"][None, :])
                if "rows" in node:
                    some = near <= (bound + slack)[asked, None]
                    self._leaf(node, asked, some, queries, own, best, place)
                    full = asked[best[asked, -1] > _NONE]
                    bound[full] = np.minimum(bound[full], np.sqrt(np.maximum(0.0, q2[full] + self.most - 2.0 * best[full, -1])))
                else:
                    some = near - node["radii"][None, :] <= (bound + slack)[asked, None]  # no distance is computed for a child that all of these pass by
                    kids = np.flatnonzero(some.any(axis=0))
                    centers = node["centers"][kids]
                    self.computed += len(asked) * len(kids)
                    d = np.sqrt(np.maximum(0.0, (q[asked] ** 2).sum(axis=1)[:, None] - 2 * q[asked] @ centers.T + (centers**2).sum(axis=1)[None, :]))
                    far[np.ix_(asked, node["kids"][kids])] = d
                    low[np.ix_(asked, node["kids"][kids])] = np.where(some[:, kids], np.maximum(0.0, d - node["radii"][kids]), np.inf)
        return [[(s, int(self.ids[p])) for s, p in zip(ss, ps, strict=True) if s > _NONE] for ss, ps in zip(best.tolist(), place.tolist(), strict=True)]

    def _leaf(self, node, asked, some, queries, own, best, place) -> None:
        """Scores of the entries that some of the queries need, merged into their best: by score, then position."""
        columns = np.flatnonzero(some.any(axis=0))
        rows = np.flatnonzero(some.any(axis=1))
        if not len(rows):
            return
        asked, some = asked[rows], some[np.ix_(rows, columns)]
        score = np.full(some.shape, _NONE, np.int64)
        if some.mean() < SPARSE:
            i, j = np.nonzero(some)
            self.computed += len(i)
            score[i, j] = np.einsum("ij,ij->i", queries[asked[i]], node["data"][columns[j]]).astype(np.int64)
        else:
            self.computed += some.size
            score[:] = (queries[asked] @ node["data"][columns].T).astype(np.int64)
        score[own[asked][:, None] == node["own"][columns][None, :]] = _NONE
        k = best.shape[1]
        every = np.concatenate([best[asked], score], axis=1)
        least = np.partition(every, every.shape[1] - k, axis=1)[:, every.shape[1] - k]
        i, j = np.nonzero((every >= least[:, None]) & (every > _NONE))  # k of each query, and more where scores are equal
        found = every[i, j]
        spot = np.where(j < k, place[asked[i], np.minimum(j, k - 1)], node["rows"][columns[np.maximum(j - k, 0)]])
        order = np.lexsort((spot, -found, i))
        i, found, spot = i[order], found[order], spot[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        best[asked], place[asked] = _NONE, len(self.ids)
        best[asked[i[top]], rank[top]], place[asked[i[top]], rank[top]] = found[top], spot[top]


def whole_vectors(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Rows with a null id, a null vector, or a null or non-finite component are left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(row_id).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _dealt(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with the cell of their nearest pivot and their distance from it."""
    dim, squares = pivots.shape[1], (pivots**2).sum(axis=1)

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                x = _matrix(part["v"], dim)
                cell = (squares[None, :] - 2 * x @ pivots.T).argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), far=np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)))

    return vectors.select("vec_id", "v").mapInPandas(run, "vec_id bigint, v array<double>, cell int, far double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over ``vectors`` but those of its own id.

    Both tables: (vec_id, v) as ``whole_vectors`` gives them; products that could reach 2**53, where doubles stop being exact, are refused with a ValueError. Ties go to the smaller vec_id; fewer vectors give
    fewer ranks; shorter vectors count as padded with 0. A repeated row is a candidate for itself as often as it stands there
    more, but for its own id. Empty tables give no rows. A task holds one stored tree and QUERY_ROWS queries at most; of a cell, only queries that may find something better there.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, dim, most = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    m, qdim, qmost = queries.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if (most or 0.0) * (qmost or 0.0) >= 2**53:
        raise ValueError("inner products may reach 2**53 and would not be exact")
    dim, blocks = max(dim or 0, qdim or 0), max(1, -(-m // QUERY_ROWS))
    few = min(PIVOTS, max(1, -(-n // SHARD_ROWS)))
    pivots = _matrix([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(few).collect()], dim)
    if not len(pivots) or not m:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = store(_dealt(vectors, pivots), "cells")
    cells = {r["cell"]: (r["n"], r["far"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    parts = {c: -(-size // SHARD_ROWS) for c, (size, _) in cells.items()}
    first = dict(zip(sorted(parts), np.cumsum([0] + [parts[c] for c in sorted(parts)]).tolist(), strict=False))
    of = F.create_map(*[F.lit(x) for c in sorted(parts) for x in (c, F.array(F.lit(first[c]), F.lit(parts[c])))])
    shard = of[F.col("cell")][0] + F.pmod(F.xxhash64("vec_id"), of[F.col("cell")][1]).cast("int")

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"], dim))
        del tree.points
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [pickle.dumps(tree, protocol=5)]})

    trees = store(dealt.select(shard.alias("shard"), "vec_id", "v").groupBy("shard").applyInPandas(plant, "shard int, tree binary"), "trees")

    def searched(asked: DataFrame) -> DataFrame:
        """``asked``: (vec_id, v, floor, cells): queries and the cells they go to."""
        block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
        each = asked.select("vec_id", "v", "floor", block, F.explode("cells").alias("cell"))
        each = each.withColumn("shard", F.explode(F.sequence(of[F.col("cell")][0], of[F.col("cell")][0] + of[F.col("cell")][1] - 1))).drop("cell")

        def search(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(some):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            ids = some["vec_id"].to_numpy(np.int64)
            found = pickle.loads(own["tree"].iloc[0]).search(_matrix(some["v"], dim), ids, k, some["floor"].to_numpy(np.int64))
            out = [(q, i, s) for q, got in zip(ids.tolist(), found, strict=True) for s, i in got]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

        met = each.select(F.col("shard").alias("at_shard"), F.col("block").alias("at_block")).distinct()
        needed = trees.join(met, F.col("shard") == F.col("at_shard")).drop("shard")
        return needed.groupBy("at_shard", "at_block").cogroup(each.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    at_home = _dealt(queries, pivots).select("vec_id", "v", F.lit(_NONE).cast("long").alias("floor"), "cell")
    at_home = store(at_home.withColumn("cells", F.array("cell") if len(cells) else F.array().cast("array<int>")).where(F.col("cell").isin(list(cells))), "queries")
    one = store(ranked(searched(at_home)).drop("rank"), "at-home")
    have = one.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "least")
    radius = np.full(len(pivots), -1.0)
    for c, (_, far) in cells.items():
        radius[c] = far

    def elsewhere(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            size = np.sqrt((x**2).sum(axis=1))[:, None]
            reach = size * np.maximum(radius, 0)[None, :]
            top = x @ pivots.T + reach + SLACK * (size * most + reach + 1)  # no score of the cell is above this
            go = (radius >= 0)[None, :] & (top >= pdf["floor"].to_numpy(float)[:, None])
            go[np.arange(len(x)), pdf["cell"].to_numpy()] = False
            some = go.any(axis=1)
            yield pdf[["vec_id", "v", "floor"]].assign(cells=[np.flatnonzero(g).astype(np.int32) for g in go])[some]

    if len(cells) > 1:
        known = at_home.drop("floor", "cells").join(have, "vec_id", "left").withColumn("floor", F.coalesce("least", F.lit(_NONE).cast("long"))).select("vec_id", "v", "floor", "cell")
        more = searched(known.mapInPandas(elsewhere, "vec_id bigint, v array<double>, floor bigint, cells array<int>"))
        one = one.unionByName(more)
    drop(dealt)
    return ranked(one).select("query_id", "rank", "vec_id", "score")
