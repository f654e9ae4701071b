"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_buffer, word_hashes

FEATURES = ("log_words", "upper", "symbols", "digits", "pipes", "marks", "lines", "word_bytes", "repeats", "distinct", "distinct_pairs", "line_repeats", "bare_words", "short_words")
_KIND = np.zeros((7, 256), np.float32)  # upper, symbols, digits, pipes, marks, line ends, letters
_KIND[0, 65:91] = 1
_KIND[1, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[1, [ord(","), ord(".")]] = 0
_KIND[2, 48:58] = 1
_KIND[3, ord("|")] = 1
_KIND[4, [ord("!"), ord("?")]] = 1
_KIND[5, 10] = 1
_KIND[6, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts have zeros."""
    data, offsets = text_buffer(column)
    hashes, first = word_hashes(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    for k in range(n):
        raw, words = data[offsets[k] : offsets[k + 1]], hashes[first[k] : first[k + 1]]
        if not len(words):
            continue
        seen = _KIND @ np.bincount(raw, minlength=256).astype(np.float32)
        letters = max(float(seen[6]), 1.0)
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]
        lines = raw.tobytes().split(b"\n")
        m = len(words)
        out[k] = (
            np.log1p(m), seen[0] / letters, seen[1] / len(raw), seen[2] / len(raw), seen[3] / m, seen[4] / m, seen[5] / m, letters / m,
            np.count_nonzero(words[1:] == words[:-1]) / m, len(np.unique(words)) / m, len(np.unique(pairs)) / max(m - 1, 1) if m > 1 else 1.0,
            1 - len(set(lines)) / len(lines), np.exp(-m / 20), np.exp(-m / 100),
        )
    return out


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * (w . (x - mean) / sd - cut) + log-odds of `at`))): at least `at` from the cut on."""

    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    cut: float
    slope: float
    at: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = (x - self.mean) / self.sd @ self.w
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + np.log(self.at / (1 - self.at)), -60, 60)))


def fit(x: np.ndarray, good: np.ndarray, at: float = 0.3, partners: int = 16, ridge: float = 1e-3, seed: int = 17) -> Model:
    """Each row of one class meets `partners` seeded rows of the other; the loss is log(1 + exp(-w . (better - worse))).

    The cut is the quantile of the scores at the share of rejected rows. Without rows of both classes the score is 0.5."""
    if not good.any() or good.all():
        d = len(FEATURES)
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.0, 0.5)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-9, sd, 1.0)
    z, rng = (x - mean) / sd, np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    better = np.concatenate([np.repeat(up, partners), rng.choice(up, len(down) * partners)])
    worse = np.concatenate([rng.choice(down, len(up) * partners), np.repeat(down, partners)])
    d, w = z[better] - z[worse], np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        grad = d.T @ p / len(d) - ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    cut = float(np.quantile(raw, (~good).mean()))
    slope = 2.0 / max(1e-6, float(np.std(raw)))
    return Model(mean, sd, w, cut, slope, at)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is held out; rows without an id aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, at: float = 0.3, sample: int = 12_000) -> Model:
    """Fit on at most `sample` labelled documents outside the held-out fold, those with the lowest hashes of their ids.

    `sample` bounds what the driver gets and what is broadcast. Repeated labels of a document count once, by majority."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    rows = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0, bool), at)
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["good"]) for r in rows], "__id long, __good boolean")
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "__good")

    def vectors(batches):
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "good"])

    got = own.mapInArrow(vectors, "x array<double>, good boolean").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0, bool), at)
    x, good = np.stack(got["x"].to_numpy()), got["good"].to_numpy(bool)
    order = np.lexsort([*x.T, good])  # the fit doesn't depend on the order of arrival
    return fit(x[order], good[order], at)


def score(docs: DataFrame, model: Model, into: str = "score", keep_from: float | None = None) -> DataFrame:
    """Add `into` (0 to 1), replacing a column of that name; with `keep_from`, keep only rows scored at least that.

    Null and empty texts are scored as texts without words; repeated rows get equal scores; other columns pass through;
    no rows in, no rows out."""
    names = [c for c in docs.columns if c != into]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")

    def run(batches):
        for b in batches:
            s = pa.array(model.score(features(b.column(at))), pa.float64())
            out = pa.RecordBatch.from_arrays([*b.columns, s], names=[*names, into])
            yield out if keep_from is None else out.filter(pc.greater_equal(s, keep_from))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
