"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are read as whole numbers x = floor(256 * c). With X the centred rows
of the fit list (every distinct x once), the bidiagonalisation alternates two
distributed products: r = X v gives the next left vector, g = X' u the next
right one. Each new vector is orthogonalised twice against all earlier ones
of its side. X = U B V' with B upper bidiagonal and no larger than the number
of dimensions, so its SVD is a small local matter: singular values give the
deviations, V times its right vectors the components.

A left vector has a number per row. It is kept as the coordinates z with
u = X z, from which a pass over the rows has all earlier left vectors at hand
without storing them: every pass reads the stored rows only, sends a few sums
of the size of the vectors to the driver, and can be repeated after a lost
executor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import stored, unused

#: relative size of what the singular vectors may still miss
TOLERANCE = 1e-15
#: a new direction smaller than this part of the largest is none
RANK = 1e-8
CHUNK = 4096


def whole_numbers(vectors: DataFrame, keep: tuple[str, ...], column: str = "embedding") -> DataFrame:
    """The columns ``keep`` as ``k_0``, ``k_1``, ... and ``x``, the vector in whole numbers.

    Vectors that are null, empty, or hold a null or non-finite entry go.
    """
    c = F.col(column).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where(c.isNotNull() & (F.size(c) > 0) & fine)
            .select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.transform(c, lambda v: F.floor(v * 256) + F.lit(0).cast("long")).alias("x")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def sums(rows: DataFrame, dims: int, size: int, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``step`` over blocks of rows: ``size`` doubles, added up per task and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                total += step(_matrix(b.column(0).slice(i, CHUNK), dims)).ravel()
        yield pa.record_batch({"at": np.arange(size, dtype=np.int32), "v": total})

    parts = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # size rows
    out = np.zeros(size)
    for r in parts:
        out[r["at"]] = r["v"]
    return out


def bidiagonal(x: DataFrame, mean: np.ndarray, n: int, want: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred rows, falling, and the right vectors as columns: at most ``want``.

    ``x`` holds the rows as ``x array<bigint>``. Ends when the wanted vectors
    have converged, or the directions of the rows are used up. A direction
    that vanishes is followed by a new random one (B has a zero there), so
    equal singular values are all found.
    """
    dims, rng = len(mean), np.random.default_rng(seed)
    # right vectors, coordinates of the left ones, and X' times these
    v_all, z_all, g_all = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    alphas: list[float] = []
    betas: list[float] = []

    def fresh() -> np.ndarray | None:
        w = rng.standard_normal(dims)
        for _ in range(2):
            w -= v_all @ (v_all.T @ w)
        size = np.linalg.norm(w)
        return w / size if v_all.shape[1] < dims and size > 1e-8 else None

    v, scale = fresh(), 0.0
    while v is not None:
        k = z_all.shape[1]
        # first pass: r = X v - beta u, and its parts along the earlier left vectors
        y = v - betas[-1] * z_all[:, -1] if betas else v

        def left(m, y=y, z_old=z_all):
            c = m - mean
            r = c @ y
            return np.concatenate([[r @ r], (c @ z_old).T @ r])

        got = sums(x, dims, 1 + k, left)
        y = y - z_all @ got[1:]
        v_all = np.column_stack([v_all, v])
        alpha = math.sqrt(max(got[0] - got[1:] @ got[1:], 0.0))

        # second pass: the same for what is left, and X' r
        def right(m, y=y, z_old=z_all):
            c = m - mean
            r = c @ y
            return np.concatenate([[r @ r], (c @ z_old).T @ r, r @ c])

        got = sums(x, dims, 1 + k + dims, right) if alpha > RANK * scale else np.zeros(1 + k + dims)
        part = got[1:1 + k]
        alpha = math.sqrt(max(got[0] - part @ part, 0.0))
        if alpha <= RANK * scale:  # X v is spanned already: this column of B has no diagonal entry
            alphas.append(0.0)
            betas.append(0.0)
            z_all, g_all = np.column_stack([z_all, np.zeros(dims)]), np.column_stack([g_all, np.zeros(dims)])
            v = fresh()
            continue
        scale = max(scale, alpha)
        g = (got[1 + k:] - g_all @ part) / alpha
        z_all, g_all = np.column_stack([z_all, (y - z_all @ part) / alpha]), np.column_stack([g_all, g])
        alphas.append(alpha)
        w = g - alpha * v
        for _ in range(2):
            w -= v_all @ (v_all.T @ w)
        beta = float(np.linalg.norm(w))
        scale = max(scale, beta)
        if beta <= RANK * scale:
            beta, v = 0.0, fresh()
        else:
            p, s, _ = np.linalg.svd(_bidiagonal(alphas, betas))
            if len(s) > want and np.all(beta * np.abs(p[-1, :want]) <= TOLERANCE * scale):
                break
            v = w / beta
        betas.append(beta)
    if not alphas:
        return np.zeros(0), np.zeros((dims, 0))
    _, s, q = np.linalg.svd(_bidiagonal(alphas, betas))
    real = s > RANK * max(s[0], 0.0) if s[0] > 0 else np.zeros(len(s), bool)
    return s[real][:want], (v_all @ q.T)[:, real][:, :want]


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    b = np.diag(alphas)
    for i in range(len(alphas) - 1):
        b[i, i + 1] = betas[i]
    return b


def whiten(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), column: str = "embedding", components: int = 4) -> DataFrame:
    """A row per kept vector and component: ``keep``, component, n, deviation, whitened, explained, identity_error.

    The fit list is each distinct vector once; n is its length and every
    covariance has divisor n. Components are numbered from 1 by falling
    eigenvalue; directions without variance have none, so fewer than
    ``components`` come out where the rows span less, and no rows at all if
    there is one distinct vector or none. Vectors of another length than the
    commonest (of equally common ones: the longest) take no part, as do those
    that ``whole_numbers`` leaves out. Repeated input rows stay. ``deviation``
    is exact, and null where it passes the range of a long.
    A column of ``keep`` named as a result comes out with ``_`` behind it.
    """
    spark = vectors.sparkSession
    rows = stored(whole_numbers(vectors, keep, column), "whiten-rows")
    taken = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    names = [unused(spark.createDataFrame([], ", ".join(f"{t} int" for t in taken)), k) for k in keep]
    out = T.StructType([T.StructField(m, rows.schema[f"k_{i}"].dataType) for i, m in enumerate(names)] + [
        T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    dims = lengths["d"]
    rows = rows.where(F.size("x") == dims)
    fit = stored(rows.select("x").distinct(), "whiten-fit")
    whole = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]).first()
    n, total = whole["n"], [int(whole[f"s{i}"]) for i in range(dims)]
    mean = np.array([s / n for s in total])
    s, q = bidiagonal(fit, mean, n, components)
    if not len(s):
        return spark.createDataFrame([], out)
    e = s * s / n
    trace = sums(fit, dims, 1, lambda m: np.array([((m - mean) ** 2).sum()]))[0] / n
    project = q / np.sqrt(e)
    k = len(s)

    def moments(m):
        w = (m - mean) @ project
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = sums(fit, dims, k + k * k, moments)
    error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(got[:k], got[:k]) / n**2 - np.eye(k)).max())
    explained, held = e / trace, len(keep)

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                m = _matrix(part.column(held), dims)
                w = (m - mean) @ project
                # exact: in longs where they cannot pass 63 bits, in Python's numbers otherwise
                most = max(n * int(np.abs(m).max()) + max(map(abs, total)), 1)
                if dims * most * most < 1 << 63:
                    off = n * m - np.array(total, dtype=np.int64)
                    deviation = (off * off).sum(1).tolist()
                else:
                    deviation = [sum((n * x - t) ** 2 for x, t in zip(r, total, strict=True)) for r in m.tolist()]
                    deviation = [d if d < 1 << 63 else None for d in deviation]
                at = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(j).take(pa.array(at)) for j in range(held)]
                    + [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(at), n)), pa.array(deviation, pa.int64()).take(pa.array(at)),
                       pa.array(w.ravel()), pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(len(at), error))], names=out.names)

    return rows.mapInArrow(project_rows, out)
