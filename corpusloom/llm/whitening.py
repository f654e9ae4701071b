"""Embedding whitening by digit-slice products: entries become integers, integers become limbs of 20 bits, and float64 matrix
products of limbs stay exact; limbs' products are recombined as big integers and merged, so the covariance has no rounding at
any number of rows. One decomposition of a dims x dims matrix on the driver follows, then a projection of all rows.

The driver holds dims * (dims + 1) / 2 sums for at most 2 * LIMBS - 1 powers, however many rows there are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a limb, limbs that hold any difference of two longs, and rows of a product: BITS + BITS + log2(ROWS) <= 53.
BITS, LIMBS, ROWS = 20, 4, 8192
SCALE, SHIFT = 64.0, 1_000_000


def integers(rows: np.ndarray, scale: float = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * c) + shift as longs; what a long can't hold is held at its ends."""
    y = np.floor(scale * rows)
    out = np.clip(y, -(2.0**62), 2.0**62).astype(np.int64) + shift
    return out


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed longs as sum of limb * 2**(BITS * place): limbs from 0 to 2**BITS - 1, the last one signed; as few as y needs."""
    out = []
    while len(out) < LIMBS - 1 and y.size and (y.min() < -(1 << (BITS - 1)) or y.max() >= 1 << (BITS - 1)):
        out.append((y & ((1 << BITS) - 1)).astype(np.float64))
        y = y >> BITS
    return [*out, y.astype(np.float64)]


def gram(y: np.ndarray) -> dict[int, np.ndarray]:
    """{power: longs}: the sum of them times 2**(BITS * power) is the exact product of y's transpose and y."""
    parts, out = limbs(y), {}
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out[i + j] = out.get(i + j, 0) + (a.T @ b).astype(np.int64)
    return out


def recombined(parts: dict[int, int]) -> int:
    return sum(int(v) << (BITS * power) for power, v in parts.items())


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are vectors of `dims` finite entries, their entries as doubles)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    kept = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(kept)).flatten()
    data = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(kept), dims) if len(kept) else np.zeros((0, dims))
    good = np.isfinite(data).all(axis=1)
    return kept[good], data[good]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: float, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            kept, data = _matrix(part.column(part.num_columns - 1), dims)
            if len(kept):
                yield part, kept, integers(data, scale, shift)


def _split_sum(y: np.ndarray) -> list[int]:
    """Exact sums of columns of longs."""
    return [recombined(dict(enumerate(int(limb[:, d].sum()) for limb in limbs(y)))) for d in range(y.shape[1])]


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n, sums of x, the centre (sums over n, rounded), the covariance, and the components."""

    dims: int
    n: int
    sums: tuple[int, ...]
    centre: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scale: float
    shift: int

    def rest(self) -> np.ndarray:
        """sums / n - centre, each entry rounded once."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre, strict=True)])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates. Components without variance are 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = np.where(self.values > 0, self.vectors / np.sqrt(self.values), 0.0)
        return ((x - self.centre) - self.rest()) @ weights

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)**2; null where that is more than a long holds."""
        y = x - self.centre
        rest = [s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)]
        most = self.n * int(max(abs(int(y.min())), abs(int(y.max())))) + max(map(abs, rest))
        if most * most * self.dims < 1 << 63:
            z = self.n * y - np.array(rest, np.int64)
            return np.einsum("ij,ij->i", z, z).tolist()
        z = y.astype(object) * self.n - np.array(rest, object)
        return [v if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric long-double matrix.

    Float64 vectors are corrected twice in long double from the residual of their products, so that vectors of small
    eigenvalues are right to double precision as well. The largest entry of each vector is positive."""
    _, x = np.linalg.eigh(v.astype(np.float64))
    x = x.astype(np.longdouble)
    one = np.eye(len(v), dtype=np.longdouble)
    for _ in range(2):
        r, s = one - x.T @ x, x.T @ v @ x
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        close = np.abs(gap) <= 2 * (np.abs(s - np.diag(e)).max() + np.abs(e).max() * np.abs(r).max())
        x = x + x @ np.where(close, r / 2, (s + e[None, :] * r) / np.where(close, 1, gap))
    x = x / np.sqrt((x * x).sum(axis=0))
    e = np.einsum("ij,ik,kj->j", x, v, x)
    order = np.argsort(-e, kind="stable")
    e, x = e[order], x[:, order]
    return e, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])


def fit(df: DataFrame, embedding: str = "embedding", most: int = 32, scale: float = SCALE, shift: int = SHIFT) -> Whitening | None:
    """From all vectors that are valid: not null, all entries finite, and of the commonest length (of ties the longest).

    None if there is none. Two passes: the sums, then the products of what is left after the centre is taken away."""
    vectors = df.select(F.col(f"`{embedding}`").cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    sizes = vectors.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return None
    dims, n = sizes["dims"], sizes["count"]

    def add_up(batches):
        total = [0] * dims
        for _, _, x in _blocks(batches, dims, scale, shift):
            total = [a + b for a, b in zip(total, _split_sum(x), strict=True)]
        rows = [(i, p, t >> (BITS * 2 * p) & ((1 << 2 * BITS) - 1) if p < 2 else t >> (BITS * 4)) for i, t in enumerate(total) for p in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["i", "power", "value"])

    parts = vectors.mapInArrow(add_up, "i long, power long, value long").groupBy("i", "power").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = [0] * dims
    for r in parts:
        sums[r["i"]] += int(r["value"]) << (2 * BITS * r["power"])
    centre = [(2 * s + n) // (2 * n) for s in sums]
    held = np.array(centre, np.int64)
    upper = np.triu_indices(dims)

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for _, _, x in _blocks(batches, dims, scale, shift):
            for power, g in gram(x - held).items():
                # a long holds what 2**8 blocks sum up; Python's integers hold any number of them
                total[power] = total.get(power, np.zeros(len(upper[0]), object)) + g[upper]
        for power, g in total.items():
            cells = np.arange(len(g))
            for piece in range(3):  # 40 bits each, the last one signed
                part = (g >> (40 * piece)) & ((1 << 40) - 1) if piece < 2 else g >> 80
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.full(len(g), power + 2 * piece), pa.int64()), pa.array(part.astype(np.int64))], names=["cell", "power", "value"])

    merged = vectors.mapInArrow(products, "cell long, power long, value long").where("value <> 0").groupBy("cell", "power").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    g = [0] * len(upper[0])
    for r in merged.toLocalIterator():
        g[r["cell"]] += int(r["value"]) << (BITS * r["power"])
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((dims, dims), np.longdouble)
    for cell, (i, j) in enumerate(zip(*upper, strict=True)):
        over = n * g[cell] - rest[i] * rest[j]  # n * n times the covariance, a whole number
        high = over / (n * n)
        up, down = high.as_integer_ratio()
        v[i, j] = v[j, i] = np.longdouble(high) + np.longdouble((over * down - up * n * n) / (down * n * n))
    values, x = components(v)
    trace = v.trace()
    values = np.where(values > dims * np.finfo(np.float64).eps * values.max(initial=0), values, 0)[:most] if trace > 0 else values[:most] * 0
    explained = values / trace if trace > 0 else values
    return Whitening(dims, n, tuple(sums), held, v, values.astype(np.float64), x[:, :most].astype(np.float64), explained.astype(np.float64), scale, shift)


def identity_error(df: DataFrame, model: Whitening, embedding: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components that have variance."""
    have = int((model.values > 0).sum())
    if not have:
        return 0.0

    def products(batches):
        total, mean = np.zeros((have, have)), np.zeros(have)
        for _, _, x in _blocks(batches, model.dims, model.scale, model.shift):
            w = model.project(x)[:, :have]  # already centred: their exact mean is 0
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        cells = np.concatenate([total.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

    cells = df.select(F.col(f"`{embedding}`").cast("array<double>")).mapInArrow(products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(have * have + have)
    for r in cells:
        flat[r["cell"]] = r["value"]
    mean = flat[have * have :] / model.n
    return float(np.abs(flat[: have * have].reshape(have, have) / model.n - np.outer(mean, mean) - np.eye(have)).max())


def whiten(df: DataFrame, model: Whitening | None, embedding: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """id, deviation, whitened (an array by component) for each valid vector; others give no row, as fit() leaves them out.

    Null ids stay null, repeated rows all count, in the fit, too; without valid vectors the result is empty. Components without
    variance (constant dimensions, fewer rows than dimensions) are 0 for all rows. Other columns, of whatever name, aren't read."""
    kind = dict(df.dtypes)[id_column]
    ids = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    if model is None:
        return ids.select("id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).where("false").withColumnRenamed("id", id_column)

    def rows(batches):
        for part, kept, x in _blocks(batches, model.dims, model.scale, model.shift):
            w = model.project(x)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(model.deviations(x), pa.int64()), arrays], names=["id", "deviation", "whitened"])

    return ids.mapInArrow(rows, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_column)
