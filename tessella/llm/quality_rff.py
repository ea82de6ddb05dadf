"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel; each task sums its rows' normal equations, the
sums are added in two steps, and only matrices of a fixed size reach the driver.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, store

#: Random features, kernel width over standardised statistics, ridge weight per row, calibration bins, parts of the labelled rows that are scored by weights of the others for calibration.
FEATURES, WIDTH, RIDGE, BINS, PARTS = 256, 3.0, 1e-4, 1000, 5
SEED = 20
NAMES = ["words", "bytes", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops", "foreign", "distinct", "top", "pairs", "fours", "lines", "line_words", "blanks"]


def statistics(text: str | None) -> list[float]:
    """Statistics of a text, named in NAMES; null counts as empty, whole texts are read."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    w = raw.split()
    n, total = len(w), max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, foreign = int(c[65:91].sum()), int(c[97:123].sum()), int(c[128:].sum())
    letters, digits, blanks = max(1, upper + lower + foreign), int(c[48:58].sum()), int(c[9:14].sum() + c[32])
    stops = int(c[46] + c[44])
    some = max(1, n)
    lines = raw.split(b"\n")
    return [
        np.log1p(n), np.log1p(len(raw)), min((total - blanks) / some, 100.0), upper / letters, digits / total, (total - letters - digits - blanks - stops) / total,
        c[124] / some, c[33] / some, stops / some, foreign / letters, len(set(w)) / some, max(Counter(w).values(), default=0) / some,
        len(set(zip(w, w[1:], strict=False))) / some, len(set(zip(w, w[1:], w[2:], w[3:], strict=False))) / some, len(set(lines)) / len(lines), np.log1p(n / len(lines)), blanks / total,
    ]


def with_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """``docs`` with the array ``into`` of its text's statistics; one row in, one row out."""
    rest = docs.drop(into)
    (own_text,) = fresh([*rest.columns, into], "text")

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns=own_text).assign(**{into: [statistics(t if isinstance(t, str) else None) for t in pdf[own_text].tolist()]})
        give_back()

    own = rest.withColumn(own_text, F.col(text))
    return own.mapInPandas(run, T.StructType([*rest.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))]))


class Model:
    """Standardisation, random features, weights and calibration; all of fixed size."""

    def __init__(self, mean, spread):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = np.asarray(mean), np.where(np.asarray(spread) > 1e-9, spread, 1.0)
        self.omega = rng.normal(0, 1 / WIDTH, (len(self.mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.knots, self.values = None, None, None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.omega + self.phase), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), 0.5) if self.weights is None else self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return np.full(len(raw), 0.5) if self.knots is None else np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def _stacked(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in col]) if len(col) else np.zeros((0, len(NAMES)))


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of least weighted squares over ordered bins: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist(), strict=True):
        pools.append([w, t, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, t2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + w2, pools[-1][1] + t2, pools[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in pools]) if pools else np.zeros(0)


def fit(labelled: DataFrame, every: DataFrame) -> Model:
    """``labelled``: (doc_id, stats, y); ``every``: (stats), for the standardisation. Without labels every score is 0.5.

    Calibration is fitted to scores of rows that the weights behind them have not seen.
    """
    cols = [f(F.col("stats")[i].cast("double")) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    moments = [x or 0.0 for x in every.agg(*cols).first()]
    model = Model(moments[0::2], moments[1::2])
    size = FEATURES + 1
    labelled = labelled.select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"))

    def packed(total):
        some = [p for p in range(PARTS) if total[p].any()]
        return pd.DataFrame({"part": some, "sums": [total[p].tobytes() for p in some]})

    def sums(batches):
        total = np.zeros((PARTS, size, size + 1))
        for pdf in batches:
            z, y, part = model.features(_stacked(pdf["stats"])), pdf["y"].to_numpy(float), pdf["part"].to_numpy()
            for p in np.unique(part).tolist():
                at = part == p
                total[p] += z[at].T @ np.column_stack([z[at], y[at]])
        yield packed(total)

    def add(batches):
        total = np.zeros((PARTS, size * (size + 1)))
        for pdf in batches:
            for p, raw in zip(pdf["part"].tolist(), pdf["sums"].tolist(), strict=True):
                total[p] += np.frombuffer(raw)
        yield packed(total)

    total = np.zeros((PARTS, size, size + 1))
    for r in labelled.mapInPandas(sums, "part int, sums binary").repartition(8).mapInPandas(add, "part int, sums binary").collect():
        total[r["part"]] += np.frombuffer(bytes(r["sums"])).reshape(size, size + 1)

    def solved(t):
        rows = t[-1, size - 1]
        return np.linalg.solve(t[:, :size] + RIDGE * rows * np.eye(size), t[:, size]) if rows else None

    model.weights = solved(total.sum(axis=0))
    if model.weights is None:
        return model
    unseen = [solved(total.sum(axis=0) - total[p]) for p in range(PARTS)]
    unseen = np.stack([model.weights if w is None else w for w in unseen])  # all labels in one part: nothing else is known

    def bins(batches):
        for pdf in batches:
            z = model.features(_stacked(pdf["stats"]))
            raw = np.clip((z * unseen[pdf["part"].to_numpy()]).sum(axis=1), -0.5, 1.5)
            yield pd.DataFrame({"bin": ((raw + 0.5) / 2 * BINS).astype(int), "y": pdf["y"].to_numpy(float)})

    found = sorted(labelled.mapInPandas(bins, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect())
    model.knots = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in found])
    model.values = isotonic(np.array([r["n"] for r in found], float), np.array([r["y"] for r in found]))
    return model


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` (with stats) with the calibrated score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(stats: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_stacked(stats)))

    return docs.withColumn(into, scored("stats"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more; statistics and score in one step."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            stats = np.array([statistics(t if isinstance(t, str) else None) for t in pdf[text].tolist()]).reshape(-1, len(NAMES))
            yield pdf[shared.value.score(stats) >= threshold]
        give_back()

    return docs.mapInPandas(run, docs.schema)


def held_out(doc_id, folds: int = 5):
    """crc32(doc_id as text) mod ``folds`` is 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, label: str = "quality", stats: DataFrame | None = None) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out; ``stats``: (doc_id, stats) of all rows, if they are at hand."""
    if stats is None:
        stats = store(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    return fit(store(stats.where(~held_out(F.col("doc_id"), folds)).join(known, "doc_id").select("doc_id", "stats", "y"), "labelled"), stats)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels are learnt only where crc32(doc_id as text) mod ``folds`` is not 0; only the text enters a score.
    Null and empty texts are scored like any other; a null doc_id is never held out and has no label; null labels are
    passed over; repeated labels count as often as they stand there; no labels at all: 0.5 for every row.
    """
    stats = store(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    out = score(stats, train(docs, labels, folds, label, stats))
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
