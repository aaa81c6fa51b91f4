"""Whitening of embeddings with refined eigenvectors.

Entries become integers on a grid, so the counts, sums and products that Spark adds up
are exact whatever the order of tasks: a first pass gives the number of vectors and
the sum of every dimension, a second one the products of the entries less the integer
nearest to their mean (what is left of the mean is taken off exactly). Both leave a task
as one row per dimension or pair of dimensions and are summed with partial
aggregation; the driver receives one number per pair of dimensions, never vectors.

The covariance, rounded once to extended precision, is decomposed in float32. Steps of
matrix products only, after Ogita and Aishima, then bring those eigenvectors to the higher
precision: a step measures how far the columns are from being orthonormal and the
matrix from being diagonal in them, and corrects both at once. Eigenvalues that lie closer
together than the measured error are a cluster; their columns are turned by the
eigenvectors of the matrix restricted to their span, shifted and so with all its digits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DIMS = 4096  # the driver holds a few matrices of this width
EXACT = 1 << 53  # integers that a double holds
HIGH = np.longdouble


# ---------------------------------------------------------------- eigenvectors

def _cluster_ends(values: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Runs (from, past) of neighbours in falling ``values`` closer than ``gap``, longer than one."""
    cut = np.flatnonzero(np.r_[True, values[:-1] - values[1:] > gap, True])
    return [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b - a > 1]


def _orthonormal(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Newton's iteration for the nearest matrix with orthonormal columns; ``x`` is close to one."""
    one, small = np.eye(x.shape[1], dtype=x.dtype), np.finfo(x.dtype).eps * x.shape[1]
    for _ in range(rounds):
        r = one - x.T @ x
        x = x + x @ r / 2
        if np.abs(r).max() <= np.sqrt(small) / 8:  # the error squares
            break
    return x


def _turn_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, runs: list[tuple[int, int]], solve) -> np.ndarray:
    """Sub-solves: turn the columns of every cluster by the eigenvectors (``solve``) of the matrix on their
    span. It is shifted and scaled first, so it has all the digits that tell the members apart."""
    x = x.copy()
    for lo, hi in runs:
        part = x[:, lo:hi]
        middle = values[lo:hi].mean()
        small = part.T @ (a @ part - middle * part)
        scale = np.abs(small).max()
        if scale > np.abs(a).max() * np.finfo(a.dtype).eps * 4:  # else equal as far as the precision goes
            x[:, lo:hi] = part @ solve((small + small.T) / (2 * scale))
    return x


def _double_solve(small: np.ndarray) -> np.ndarray:
    turn = np.linalg.eigh(small.astype(np.float64))[1][:, ::-1].astype(small.dtype)
    return _orthonormal(turn)


def refine(a: np.ndarray, x: np.ndarray, max_rounds: int = 60) -> np.ndarray:
    """Orthonormal eigenvectors (falling eigenvalues) of the symmetric ``a`` from the approximate ones ``x``, in
    the precision of ``a``. Rounds go on until what is off the diagonal, and off orthonormal, is of
    the size of rounding or no longer falls. Clusters that the precision cannot part by steps are solved
    by themselves at the end."""
    eps, size = np.finfo(a.dtype).eps, len(a)
    one, norm = np.eye(size, dtype=a.dtype), max(np.abs(a).sum(axis=1).max(), np.finfo(a.dtype).tiny)
    x, last, runs, values = x.astype(a.dtype), np.inf, [], np.zeros(size, a.dtype)
    for turn in range(max_rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        off = s - np.diag(np.diag(s))
        gap = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), norm * eps * 1e5)
        runs = _cluster_ends(values, gap)
        far = values[None, :] - values[:, None]
        apart = np.abs(far) > gap
        for lo, hi in runs:  # a chain of close ones is one cluster
            apart[lo:hi, lo:hi] = False
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, far, 1), r / 2)
        rest = max(np.abs(np.where(apart, off, 0)).max() / norm, np.abs(r).max())
        if rest <= eps * size or turn > 4 and rest >= last / 2:
            break
        last = rest
        if runs:
            x = _turn_clusters(a, _orthonormal(x), values, runs, _double_solve)
    return _orthonormal(_turn_clusters(a, _orthonormal(x), values, runs, _components))


def _components(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a symmetric matrix whose largest entry is about 1: float32, corrected in double,
    then in the matrix's own precision."""
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    x = refine(a.astype(np.float64), start) if a.dtype != np.float64 else start
    return refine(a, x)


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix in extended precision.
    An empty matrix has none."""
    a = a.astype(HIGH)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a), HIGH), np.eye(len(a), dtype=HIGH)
    x = _components((a + a.T) / (2 * scale))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


# ---------------------------------------------------------------- exact sums

def _grid(column, width: int | None, per_unit: int, offset: int):
    """Rows of an Arrow list column that count, and their entries as integers: ``(rows, lengths, matrix)``.

    ``rows`` are the positions of lists without null or non-finite entries whose entries fit; with
    ``width`` only those of that length, as one matrix, else ``matrix`` is the flat entries."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    offs = np.asarray(column.offsets)
    flat, base = column.values, int(offs[0]) if len(column) else 0
    flat = flat.slice(base, int(offs[-1]) - base if len(column) else 0)
    entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(per_unit * entries) + offset
        good = np.abs(x) < EXACT  # false for what is not finite
    bad = np.concatenate([[0], np.cumsum(~good)])
    start, lengths = offs[:-1] - base, np.diff(offs)
    fine = np.asarray(column.is_valid()) & (lengths > 0) & (bad[start + lengths] == bad[start])
    if width is not None:
        fine &= lengths == width
    rows = np.flatnonzero(fine)
    if width is None:
        return rows, lengths[rows], (x, start)
    at = start[rows][:, None] + np.arange(width)[None, :]
    return rows, lengths[rows], x[at].astype(np.int64)


def _products(y: np.ndarray) -> list:
    """Exact sums over rows of the products of all pairs of columns, as Python integers, row by row of the upper
    triangle. Blocks are so short that doubles hold their sums."""
    top = max(1, int(np.abs(y).max(initial=0)))
    lines = EXACT // (top * top)
    if lines < 1:  # entries beyond 2^26: Python's integers
        total = y.astype(object).T @ y.astype(object)
    else:
        total = np.zeros((y.shape[1], y.shape[1]), object if len(y) * top * top >= 1 << 62 else np.int64)
        for at in range(0, len(y), lines):
            part = y[at:at + lines].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64)
    return total[np.triu_indices(y.shape[1])].tolist()


@dataclass
class Fit:
    """Exact moments of the vectors that count, and their components."""
    n: int
    width: int
    sums: list[int]
    values: np.ndarray  # falling eigenvalues of the covariance
    vectors: np.ndarray  # unit eigenvectors, columns
    trace: float
    per_unit: int
    offset: int


def _decimal_rows(keys: dict, values: list, name: str):
    import decimal

    import pyarrow as pa

    with decimal.localcontext() as c:
        c.prec = 60
        column = pa.array([decimal.Decimal(v) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([*keys.values(), column], [*keys, name])


def moments(vectors: DataFrame, per_unit: int, offset: int) -> tuple[int, int, list[int]]:
    """Length, number and exact sum by dimension of the vectors that count."""
    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            rows, lengths, (x, start) = _grid(b.column(0), None, per_unit, offset)
            for k in np.unique(lengths).tolist():
                some = rows[lengths == k]
                y = x[start[some][:, None] + np.arange(k)[None, :]].astype(np.int64)
                high, low = (y >> 26).sum(axis=0), (y & (1 << 26) - 1).sum(axis=0)
                sums = [(h << 26) + m for h, m in zip(high.tolist(), low.tolist())]
                old = held.get(k, [0, [0] * k])
                held[k] = [old[0] + len(some), [p + q for p, q in zip(old[1], sums)]]
        for k, (n, sums) in held.items():
            yield _decimal_rows({"k": pa.array([k] * (k + 1), pa.int32()), "j": pa.array(range(-1, k), pa.int32())}, [n, *sums], "v")

    kind = "decimal(38,0)"
    parts = vectors.mapInArrow(run, f"k int, j int, v {kind}").groupBy("k", "j").agg(F.sum("v").cast(kind).alias("v"))
    # The length most vectors have, the longer one of equals: one row comes back per length and dimension.
    best = parts.where("j = -1").orderBy(F.desc("v"), F.desc("k")).first()
    if best is None:
        return 0, 0, []
    if best.k > MAX_DIMS:
        raise ValueError(f"vectors of {best.k} entries: at most {MAX_DIMS} are supported")
    sums = {r.j: int(r.v) for r in parts.where((F.col("k") == best.k) & (F.col("j") >= 0)).collect()}
    return best.k, int(best.v), [sums[j] for j in range(best.k)]


def fit(vectors: DataFrame, vector_col: str = "embedding", per_unit: int = 64, offset: int = 1_000_000) -> Fit:
    """Exact count, sums and covariance (divisor n) of the vectors that count, and all its components.

    Left out are null vectors, those with a null or non-finite entry or one that does not fit
    (2^53 and more on the grid), empty ones, and those whose length is not the most frequent one (the longer of
    equally frequent ones). No vectors: a fit of width 0."""
    rows = vectors.select(F.col(vector_col).alias("v"))
    width, n, sums = moments(rows, per_unit, offset)
    if not n:
        return Fit(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0, per_unit, offset)
    middle = [(2 * s + n) // (2 * n) for s in sums]  # the integer nearest to the mean
    centre = np.array(middle, np.int64)
    upper = [a.astype(np.int32) for a in np.triu_indices(width)]

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            _, _, x = _grid(b.column(0), width, per_unit, offset)
            if len(x):
                part = _products(x - centre)
                total = part if total is None else [p + q for p, q in zip(total, part)]
        if total is not None:
            yield _decimal_rows({"i": pa.array(upper[0]), "j": pa.array(upper[1])}, total, "v")

    kind = "decimal(38,0)"
    got = rows.mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").cast(kind).alias("v")).toArrow()
    left = [s - n * m for s, m in zip(sums, middle)]  # n times what is left of the mean
    cov = np.zeros((width, width), HIGH)
    for i, j, v in zip(*(got.column(c).to_pylist() for c in ("i", "j", "v"))):
        cov[i, j] = cov[j, i] = _ratio(n * int(v) - left[i] * left[j], n * n)
    values, x = eigenvectors(cov)
    return Fit(n, width, sums, values.astype(np.float64), x.astype(np.float64), float(np.trace(cov)), per_unit, offset)


def _ratio(p: int, q: int) -> np.longdouble:
    """p / q of exact integers, rounded to extended precision."""
    if p < 0:
        return -_ratio(-p, q)
    shift = max(0, 80 - (p.bit_length() - q.bit_length()))
    whole = (p << shift) // q
    high = whole >> 53
    high_high, high_low = high >> 53, high & EXACT - 1
    with np.errstate(over="ignore"):
        value = (HIGH(float(high_high)) * HIGH(EXACT) + HIGH(float(high_low))) * HIGH(EXACT) + HIGH(float(whole & EXACT - 1))
    return np.ldexp(value, -shift)


# ---------------------------------------------------------------- whitening

def _scaled(y: np.ndarray, n: int, left: list[int]) -> np.ndarray:
    """n times the centred rows, exact: 64-bit integers where they hold it, else Python's."""
    if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
        return y * n - np.array(left, np.int64)
    return y.astype(object) * n - np.array(left, object)


def _squares(d: np.ndarray) -> list:
    """Exact sum of squares of every row of integers; null where a long cannot hold it."""
    top = int(np.abs(d).max(initial=0))
    if d.dtype != object and top * top * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    totals = [sum(v * v for v in row) for row in d.tolist()]
    return [t if t < 1 << 63 else None for t in totals]


def transform(vectors: DataFrame, model: Fit, id_col: str = "vec_id", vector_col: str = "embedding",
              components: int = 32) -> DataFrame:
    """One row per vector that counts (see ``fit``): id, ``deviation`` (sum over dimensions of (n x - S)^2, exact; null
    where no long can hold it) and ``whitened`` (array of double): the centred vector on the first
    components, over the square root of their eigenvalues. Components without variance are left out."""
    k = usable(model, components)
    n, width, per_unit, offset = model.n, model.width, model.per_unit, model.offset
    sums = model.sums
    project = model.vectors[:, :k] / np.sqrt(model.values[:k])[None, :] if k else np.zeros((width, 0))
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        if not n:
            return
        centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        left = [s - n * c for s, c in zip(sums, centre.tolist())]
        for b in batches:
            rows, _, x = _grid(b.column(1), width, per_unit, offset)
            d = _scaled(x - centre, n, left)
            exact = _squares(d)
            w = (d.astype(np.float64) / n) @ project
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) * k + 1, k, dtype=np.int32) if k else np.zeros(len(w) + 1, np.int32)),
                                            pa.array(np.ascontiguousarray(w).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(exact, pa.int64()), flat], schema.names)

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def usable(model: Fit, components: int) -> int:
    """Number of the first components that have variance (beyond rounding of the trace)."""
    return int((model.values[:components] > model.trace * 1e-13).sum()) if model.width else 0


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of the array column ``whitened``
    minus the identity, from all rows."""
    if not k or not n:
        return 0.0

    def by_task(width, of):
        def run(batches):
            import pyarrow as pa

            total = np.zeros(width)
            for b in batches:
                w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total = total + of(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["e", "v"])

        rows = whitened.select("whitened").mapInArrow(run, "e int, v double").groupBy("e").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in rows:
            out[r.e] = r.v
        return out

    mean = by_task(k, lambda w: w.sum(axis=0)) / n
    cov = by_task(k * k, lambda w: ((w - mean).T @ (w - mean)).ravel()).reshape(k, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           per_unit: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Fit on all vectors that count and return a row for each of them and component: id, ``component`` (from 1),
    ``n``, ``deviation``, ``whitened``, ``explained`` (eigenvalue over trace), ``identity_error`` (one value).

    Vectors that do not count (see ``fit``) have no rows, and neither have components without variance, so equal
    vectors alone, or an empty table, give an empty result. Null ids and repeated rows stay; other columns are not
    read."""
    model = fit(vectors, vector_col, per_unit, offset)
    k = usable(model, components)
    rows = transform(vectors, model, id_col, vector_col, components)
    error = identity_error(rows, model.n, k)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]]) if k else F.array().cast("array<double>")
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
