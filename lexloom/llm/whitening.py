"""Whitening of embeddings: principal components and standard deviations by a blockwise QR and a one-sided Jacobi SVD.

Entries are put on a grid of whole numbers, so that the number of vectors, the sums and the centred entries n * x - S are exact.
Every block of centred rows becomes the R of its QR; Rs are stacked and reduced, a fixed number of blocks at a time, until one
is left (TSQR). Plane rotations of R's columns make them orthogonal: their lengths are the singular values, and the
rotations multiplied together are the components. The covariance itself is never formed, so small deviations keep
their digits. What leaves a task is one R of d * d numbers for each block, whatever the number of rows.

Defined results: rows whose vector is null, empty, or holds a null or an entry that is not finite are left out, and so are rows
whose vector has another length than most rows' (at a tie the longer). Rows with a null or repeated id each give their rows. A
component without variance (there are some if vectors are fewer than dimensions, or a dimension is constant) has null
whitened values and explained 0 and does not count in identity_error. deviation is null where it does not fit into a long.
An entry beyond 2**46 in size raises an ArithmeticException. An empty table gives no rows. Other columns of the input are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written

SCALE, SHIFT = 64, 1_000_000
#: blocks that one task reduces to one
FAN_IN = 32
#: rows that a task holds as numbers at once
ROWS = 4096
LIMIT = float(1 << 46)
#: a component has no variance if its deviation is below this part of the largest
NEGLIGIBLE = 1e-13
_LONG = (1 << 63) - 1


def _slim(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _grids(batches: Iterator[pa.RecordBatch], dimensions: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and whole numbers of the rows with whole vectors, of one length at a time: the one asked for, or each."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = part.column(1).flatten().to_numpy(zero_copy_only=False)  # a null entry is NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            whole = (np.bincount(row, ~np.isfinite(values), len(sizes)) == 0) & (sizes > 0)
            for d in np.unique(sizes[whole]) if dimensions is None else [dimensions]:
                taken = whole & (sizes == d)
                if taken.any():
                    c = values[taken[row]].reshape(-1, d)
                    if (np.abs(c) > LIMIT).any():
                        raise ArithmeticError("an entry is beyond 2**46 in size")
                    yield part.column(0).filter(pa.array(taken)), np.floor(c * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Sums:
    """The number of vectors and the exact sum of each dimension: whole * n + rest. Centred entries times n are n * (x - whole) - rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.whole)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: of longs, or of Python's whole numbers where longs could run over."""
        near = x - self.whole
        if self.n * (int(np.abs(near).max(initial=0)) + 1) <= _LONG:
            return near * self.n - self.rest
        return near.astype(object) * self.n - self.rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n * x - S."""
        scaled = self.scaled(x)
        if scaled.dtype != object and (scaled.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
            return (scaled**2).sum(axis=1).tolist()
        return [v if v <= _LONG else None for v in (scaled.astype(object) ** 2).sum(axis=1)]


def exact_sums(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Sums:
    """Number and sums of the whole vectors of the most frequent length, added up as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, x in _grids(batches):
            part = found.setdefault(x.shape[1], [0, 0, 0])
            for i, v in enumerate((len(x), (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0))):
                part[i] = part[i] + v
        for d, (n, low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d), pa.array(np.arange(d)), pa.array([n] * d), pa.array(low), pa.array(high)], ["d", "i", "n", "low", "high"])

    parts = _slim(vectors, id_col, vector_col).mapInArrow(run, "d bigint, i bigint, n bigint, low bigint, high bigint")
    exact = F.col("high").cast("decimal(38,0)") * (1 << 32) + F.col("low")
    rows = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(exact.cast("decimal(38,0)")).alias("s"))
    most = rows.where("i = 0").orderBy(F.col("n").desc(), F.col("d").desc()).limit(1).collect()
    if not most:
        return Sums(0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    n, sums = most[0]["n"], {r["i"]: int(r["s"]) for r in rows.where(F.col("d") == most[0]["d"]).collect()}  # one row for each dimension
    split = [divmod(sums[i], n) for i in sorted(sums)]
    return Sums(n, np.array([q for q, _ in split], np.int64), np.array([r for _, r in split], np.int64))


def reduced(blocks: DataFrame, merge: Callable[[list[tuple]], tuple], fields: str) -> tuple | None:
    """The only row left of (block bigint, fields ...): FAN_IN neighbouring blocks at a time are merged in a task."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        found = merge(list(zip(*[table.column(n).to_pylist() for n in names])))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())} | {n: pa.array([v]) for n, v in zip(names, found)})

    blocks = written(blocks, "blocks")
    while (blocks.agg(F.max("block")).first()[0] or 0) > 0:
        dealt = blocks.withColumn("to", F.floor(F.col("block") / FAN_IN).cast("bigint"))
        blocks = written(dealt.groupBy("to").applyInArrow(run, f"block bigint, {fields}"), "blocks")
    rows = blocks.select(*names).collect()  # block 0, or nothing
    return tuple(rows[0]) if rows else None


def triangle(vectors: DataFrame, sums: Sums, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """R of the QR of all centred rows: of each task's rows, block after block, then of the tasks' Rs."""
    d = sums.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for _, x in _grids(batches, d):
            r = np.linalg.qr(np.vstack([r, sums.centred(x)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()])], ["block", "r"])

    def merge(rows: list[tuple]) -> tuple:
        return (np.linalg.qr(np.vstack([np.array(r).reshape(-1, d) for r, in rows]), mode="r").ravel(),)

    found = reduced(_slim(vectors, id_col, vector_col).mapInArrow(run, "block bigint, r array<double>"), merge, "r array<double>")
    r = np.array(found[0]).reshape(-1, d) if found else np.zeros((0, d))
    return np.vstack([r, np.zeros((d - len(r), d))])


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of d columns once, in rounds of pairs that share no column (the circle method)."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :])) if a < d and b < d]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi_svd(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values in falling order and the right singular vectors as columns. Rotations of pairs of columns until all are
    orthogonal to within rounding; the rotations' product is the vectors."""
    d = r.shape[1]
    size = np.abs(r).max(initial=0.0) or 1.0
    order = np.argsort(-(r**2).sum(axis=0), kind="stable")
    a, v = (r / size)[:, order], np.eye(d)[:, order]
    rounds = [p for p in _rounds(d) if len(p[0])]
    close = np.finfo(float).eps * max(d, 8)
    nothing = (close * np.sqrt((a * a).sum(axis=0).max(initial=0.0))) ** 2  # shorter columns are rounding errors
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = (np.abs(gamma) > close * np.sqrt(alpha * beta)) & (np.minimum(alpha, beta) > nothing)
            if not turn.any():
                continue
            turned, p, q = True, p[turn], q[turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - c * t * right, c * t * left + c * right
        if not turned:
            break
    else:
        raise ArithmeticError("the columns did not become orthogonal")
    sigma = np.sqrt((a * a).sum(axis=0)) * size
    falling = np.argsort(-sigma, kind="stable")
    return sigma[falling], v[:, falling]


@dataclass(frozen=True)
class Whitening:
    """components: one column each, by falling variance; deviations: the square roots of their eigenvalues; explained: parts of the trace."""

    sums: Sums
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    @property
    def varied(self) -> np.ndarray:
        return self.deviations > NEGLIGIBLE * self.deviations.max(initial=0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component; NaN where it has no variance."""
        scale = np.where(self.varied, self.deviations, np.nan)
        return self.sums.centred(x) @ self.components / scale


def fit(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening:
    """Two passes over the vectors: exact sums, then R."""
    sums = exact_sums(vectors, id_col, vector_col)
    sigma, v = jacobi_svd(triangle(vectors, sums, id_col, vector_col))
    variances = sigma**2 / max(sums.n, 1)
    kept, total = slice(0, components), variances.sum() or 1.0
    return Whitening(sums, v[:, kept], np.sqrt(variances[kept]), variances[kept] / total)


def identity_error(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, one pass: counts, means and centred
    products of blocks, merged pair by pair."""
    varied = np.flatnonzero(model.varied)
    k = len(varied)
    if not k:
        return 0.0

    def merged(a: tuple, b: tuple) -> tuple:
        n, step = a[0] + b[0], b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (0, np.zeros(k), np.zeros((k, k)))
        for _, x in _grids(batches, model.sums.dimensions):
            w = model.whitened(x)[:, varied]
            mean = w.mean(axis=0)
            found = merged(found, (len(w), mean, (w - mean).T @ (w - mean)))
        if found[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found[0]]), pa.array([found[1]]), pa.array([found[2].ravel()])], ["block", "n", "mean", "products"]
            )

    def merge(rows: list[tuple]) -> tuple:
        found = (0, np.zeros(k), np.zeros((k, k)))
        for n, mean, products in rows:
            found = merged(found, (n, np.array(mean), np.array(products).reshape(k, k)))
        return found[0], found[1], found[2].ravel()

    fields = "n bigint, mean array<double>, products array<double>"
    n, _, products = reduced(_slim(vectors, id_col, vector_col).mapInArrow(run, f"block bigint, {fields}"), merge, fields)
    return float(np.abs(np.array(products).reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation, whitened: an array with one number for each component, null where it has no variance. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _grids(batches, model.sums.dimensions):
            w = model.whitened(x)
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.sums.deviations(x), pa.int64()), rows], ["id", "deviation", "whitened"])

    slim = _slim(vectors, id_col, vector_col)
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, deviation bigint, whitened array<double>")


def component_rows(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component from 1, n, deviation, whitened, explained, identity_error: one row for each vector and component."""
    model = fit(vectors, components, id_col, vector_col)
    error = identity_error(vectors, model, id_col, vector_col)
    rows = whiten(vectors, model, id_col, vector_col).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    return rows.select(
        "id", (F.col("at") + 1).alias("component"), F.lit(model.sums.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
