"""Whitening of embeddings by principal components.

The fit takes two passes: sums of each dimension, then the scatter of the centred vectors, each task's products added up by
Spark. Both results are bounded by the dimension alone. The driver turns the covariance diagonal by cyclic Jacobi rotations,
which keep small eigenvalues accurate relative to their own size, sorts the components and sends the whitening matrix to the
tasks. A third pass measures the covariance of what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut

#: Vectors of a block, at most.
BLOCK_ROWS = 2048
#: Whole numbers beyond this are held there: a vector with such components stays in the fit and in the result.
LARGEST = 2.0**52
#: Sweeps after which the rotations stop at the latest; they end after six to ten.
SWEEPS = 60
#: A component whose variance is below this share of the largest has none that doubles can tell from rounding.
LEAST = 1e-13


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: float) -> DataFrame:
    """dim, ids, data: blocks of the usable vectors of one length in a partition; data: floor(scale * x) + shift as doubles, whole numbers."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                lists, ids = b.column(1), b.column(0)
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(), 0)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null component becomes NaN
                ends = np.cumsum(sizes)
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
                good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
                for dim in np.unique(sizes[good]):
                    chosen = np.flatnonzero(good & (sizes == dim))
                    x = flat[(ends[chosen] - dim)[:, None] + np.arange(dim)[None, :]]
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(scale * x) + shift, -LARGEST, LARGEST)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.take(pa.array(chosen)).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()])], names=["dim", "ids", "data"])

    return rows.mapInArrow(run, "dim int, ids array<long>, data binary")


def matrix(b: pa.RecordBatch, i: int) -> np.ndarray:
    return np.frombuffer(b.column("data")[i].as_buffer(), np.float64).reshape(-1, b.column("dim")[i].as_py())


@dataclass
class Fit:
    """What is known of the vectors of one length: rows, sums of each dimension, covariance, variances of the components
    (falling), components (rows are unit vectors) and their whitening; all of a size that the dimension alone sets."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    variances: np.ndarray
    components: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole numbers first, so that no digits are lost."""
        near = [round(s / self.n) if abs(s) < 2**52 else (2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, near, strict=True)])
        return (x - np.array(near, float)) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; 0 where a component has no variance."""
        has = self.variances > LEAST * max(self.variances[0], 0) if len(self.variances) else np.zeros(0, bool)
        scale = np.where(has, 1 / np.sqrt(np.where(has, self.variances, 1)), 0)
        return (self.centred(x) @ self.components.T) * scale


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, by cyclic rotations until every entry off the diagonal is nothing
    beside the two diagonal entries that it joins."""
    a, d = np.array(symmetric, float), len(symmetric)
    v = np.eye(d)
    eps = np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                x = a[p, q]
                if x == 0 or abs(x) <= eps * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(1, theta))
                c = 1 / np.hypot(1, t)
                s = t * c
                app, aqq = a[p, p] - t * x, a[q, q] + t * x
                left, right = a[p].copy(), a[q].copy()
                a[p], a[q] = c * left - s * right, s * left + c * right
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0, 0
                left, right = v[p].copy(), v[q].copy()
                v[p], v[q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[order]


def added(blocks: DataFrame, dim: int, products) -> np.ndarray:
    """The sum over all blocks of products(x), a symmetric matrix: each task adds up its own, Spark adds the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                p = products(matrix(b, i))
                total = p if total is None else total + p
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    rows = blocks.where(F.col("dim") == dim).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    side = max((r["j"] for r in rows), default=-1) + 1
    out = np.zeros((side, side))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def sums_of(blocks: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums of each dimension, by length. A row for each task, length and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for i in range(b.num_rows):
                x = matrix(b, i)
                # In two halves: each half's sum over a block is exact in a long.
                high = np.floor(x / 2**26)
                own = [int(h) * 2**26 + int(w) for h, w in zip(high.sum(axis=0), (x - high * 2**26).sum(axis=0), strict=True)]
                old = held.get(x.shape[1])
                held[x.shape[1]] = [len(x), own] if old is None else [old[0] + len(x), [a + c for a, c in zip(old[1], own, strict=True)]]
        rows = [(dim, k, n, s) for dim, (n, own) in held.items() for k, s in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([str(r[3]) for r in rows], pa.string())], names=["dim", "k", "n", "s"])

    total = F.sum(F.col("s").cast("decimal(28,0)")).cast("string").alias("s")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(blocks.mapInArrow(run, "dim int, k int, n long, s string").groupBy("dim", "k").agg(F.sum("n").alias("n"), total).collect(), key=lambda r: (r["dim"], r["k"])):
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def fit(blocks: DataFrame, most: int) -> dict[int, tuple[Fit, float]]:
    """The fit of each length with at most `most` components, and the largest entry of the outcome's covariance less the identity."""
    out = {}
    for dim, (n, sums) in sums_of(blocks).items():
        made = Fit(n, sums, np.zeros((dim, dim)), np.zeros(0), np.zeros((0, dim)))

        def scatter(x: np.ndarray, own: Fit = made) -> np.ndarray:
            c = own.centred(x)
            return c.T @ c

        made.covariance = added(blocks, dim, scatter) / n
        values, vectors = jacobi(made.covariance)
        made.variances, made.components = values[:most], vectors[:most]

        def outcome(x: np.ndarray, own: Fit = made) -> np.ndarray:
            w = own.whitened(x)
            return w.T @ w

        got = added(blocks, dim, outcome) / n
        has = made.variances > LEAST * max(made.variances[0], 0)
        out[dim] = (made, float(np.abs(got - np.diag(has.astype(float))).max()))
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over the dimensions of (n * x - sum) squared; None where no long holds it."""
    about = ((x - np.array([s / n for s in sums])) ** 2).sum(axis=1) * float(n) * float(n)
    if np.abs(x).max(initial=0) * n < 2.0**61 and max(map(abs, sums)) < 2**61 and about.max(initial=0) < 2.0**61:
        far = x.astype(np.int64) * n - np.array(sums, np.int64)
        return (far * far).sum(axis=1).tolist()
    out: list[int | None] = []
    for row, guess in zip(x.tolist(), about.tolist(), strict=True):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) if guess < 2.0**64 else 1 << 63
        out.append(exact if exact < 1 << 63 else None)
    return out


def whiten(vectors: DataFrame, most: int = 32, scale: float = 64, shift: float = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Components become x = floor(scale * c) + shift. Vectors that are null, empty or hold a null or non-finite component take no
    part; ids may be null or repeated, each row is fitted and returned. Vectors of different lengths are fitted apart. Whole
    numbers beyond LARGEST are held at it. A deviation that no long holds is null. A component without variance is 0 in every
    row and explains 0; identity_error leaves it out (its diagonal is held against 0). Other columns aren't read. A table without
    usable vectors gives an empty result. The rows of a run come from one fit; sums of doubles may differ in their last digits
    between runs.
    """
    blocks = cut(packed(vectors, id_col, vector_col, scale, shift), "whitening-blocks")
    fits = fit(blocks, most)
    shares = {dim: (own.variances / trace if (trace := float(np.trace(own.covariance))) > 0 else np.zeros(len(own.variances))) for dim, (own, _) in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, ids = matrix(b, i), b.column("ids")[i].values
                own, error = fits[x.shape[1]]
                w = own.whitened(x)
                rows, k = w.shape
                far = pa.array(deviations(x, own.n, own.sums), pa.int64())
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, own.n, np.int64)), far.take(each), pa.array(w.ravel()), pa.array(np.tile(shares[x.shape[1]], rows)), pa.array(np.full(rows * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
