"""Whitening of embeddings by spectrum slicing.

The covariance is gathered exactly, in whole numbers: entries become x = floor(256 * c), every distinct x-vector counts
once, sums of x and of products of (x - c) with a whole-number centre c near the mean are added up without rounding, and

    V = (n * sum (x - c)(x - c)' - s s') / n^2      with s = sum (x - c)

is rounded once. So V doesn't depend on how rows lie in partitions. The leading eigenvalues are found on the driver, on a
matrix of dimension x dimension numbers, whatever the number of rows: the inertia of L D L' of V - t I counts the
eigenvalues above t, bisection on these counts isolates each leading eigenvalue, Rayleigh quotient iteration converges
cubically inside the interval, and two more counts on both sides of the result certify its number.

Defined results: vectors that are null or hold a null, NaN or infinity take no part; repeated rows are returned each, with
their vec_id, which may be null; a shorter vector counts as filled with zeros (and as
distinct from the filled one); extra columns are left out; no rows give no
rows. Equal eigenvalues (closer than rounding can tell) are numbered together and have any orthonormal basis of their
space. Components without variance have no whitened form: they are left out, so that a table with one distinct vector
gives no rows. ``deviation`` is null where it does not fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

SCALE = 256
COMPONENTS = 4
LIMB = 40  # bits of a whole number that travel in one long; four longs hold 160 bits
_LOW = (1 << LIMB) - 1
_LONG = (1 << 63) - 1
ROUNDING = 1e-12  # of the trace: eigenvalues closer than this are one cluster


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x: array of longs, for the vectors that take part."""
    c = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    top = F.lit(float(1 << 62))  # doubles beyond 2^62 are kept there
    x = F.transform("e", lambda y: F.floor(F.greatest(-top, F.least(top, F.lit(float(scale)) * y))).cast("long"))
    return c.filter(F.col("e").isNotNull() & fine).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, filled with zeros up to ``width``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _reach(m: np.ndarray) -> int:
    return max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly: in floating point where all sums are whole there, else in Python's whole numbers."""
    if _reach(y) ** 2 * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _limbs(values: np.ndarray) -> dict[str, pa.Array]:
    """Whole numbers as four longs each, whose sums can be put together again."""
    out, rest = {}, values.ravel()
    for k in range(4):
        out[f"l{k}"] = pa.array([int(v) & _LOW if k < 3 else int(v) for v in rest], pa.int64())
        rest = np.array([int(v) >> LIMB for v in rest], dtype=object)
    return out


def _whole(row) -> int:
    return sum(int(row[f"l{k}"]) << (LIMB * k) for k in range(4))


def _sums(centre: list[int] | None, width: int):
    """Per task: sums of x without a centre (i = -1), else sums of the products of x - centre (i <= j)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column("x").slice(at, 4096), width)
                if centre is None:
                    part = x.sum(axis=0).astype(object) if _reach(x) < 1 << 50 else x.astype(object).sum(axis=0)
                else:
                    c = np.array(centre, dtype=object)
                    y = x - c.astype(np.int64) if max(_reach(x), _reach(c)) < 1 << 61 else x.astype(object) - c
                    part = products(y)
                total = part if total is None else total + part
        if total is None:
            return
        if centre is None:
            i, j = np.full(width, -1), np.arange(width)
        else:
            i, j = np.triu_indices(width)
            total = total[i, j]
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), **_limbs(total)})
    return run


def _gather(fit: DataFrame, centre: list[int] | None, width: int) -> dict[tuple[int, int], int]:
    """Sums over all tasks: one number for each dimension or pair of dimensions comes to the driver."""
    limbs = [f"l{k}" for k in range(4)]
    rows = (fit.mapInArrow(_sums(centre, width), "i int, j int, l0 long, l1 long, l2 long, l3 long")
            .groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs]).collect())
    return {(r["i"], r["j"]): _whole(r) for r in rows}


def inertia(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are above ``shift``: positive pivots of L D L' of v - shift I.

    Pivots are blocks of one or two rows, chosen by size (Bunch and Kaufman); a zero pivot counts as half above, which
    bisection then leaves by its next shift."""
    a = v - shift * np.eye(len(v))
    alpha, n, k, above = (1 + 17 ** 0.5) / 8, len(v), 0, 0
    while k < n:
        column = np.abs(a[k + 1:, k])
        r = k + 1 + int(column.argmax()) if k + 1 < n else k
        largest = column[r - k - 1] if k + 1 < n else 0.0
        two = False
        if abs(a[k, k]) < alpha * largest:
            row = np.abs(a[r, k:]).copy()
            row[r - k] = 0
            second = row.max()
            if abs(a[k, k]) * second < alpha * largest ** 2:
                two = abs(a[r, r]) < alpha * second
                swap = k + 1 if two else k
                a[[swap, r]] = a[[r, swap]]
                a[:, [swap, r]] = a[:, [r, swap]]
        if two:
            d, b = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            above += int((np.linalg.eigvalsh(d) > 0).sum())
            if len(b):
                a[k + 2:, k + 2:] -= b @ np.linalg.solve(d, b.T)
            k += 2
        else:
            above += a[k, k] > 0
            if a[k, k] != 0 and k + 1 < n:
                b = a[k + 1:, k]
                a[k + 1:, k + 1:] -= np.outer(b, b / a[k, k])
            k += 1
    return int(above)


def _converge(v: np.ndarray, low: float, high: float, known: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval with one eigenvalue; None if it ends elsewhere."""
    n, shift = len(v), (low + high) / 2
    x = np.cos(np.arange(1, n + 1) * 1.7) + 0.1
    size = np.abs(v).sum(axis=1).max()
    for step in range(60):
        for k in known:
            x = x - k * (k @ x)
        x /= np.linalg.norm(x)
        if step > 2:  # the first steps keep the middle, so that the eigenvalue of the interval is the nearest
            shift = float(x @ v @ x)
            if np.linalg.norm(v @ x - shift * x) <= 4 * np.finfo(float).eps * size:
                break
        try:
            x = np.linalg.solve(v - shift * np.eye(n), x)
        except np.linalg.LinAlgError:
            x = np.linalg.solve(v - (shift + np.finfo(float).eps * size) * np.eye(n), x)
        if not np.isfinite(x).all():
            return None
    value = float(x @ v @ x)
    return (value, x) if low - ROUNDING * size <= value <= high + ROUNDING * size else None


def _cluster(v: np.ndarray, middle: float, size: int, known: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Values and a basis of ``size`` eigenvalues too close to be told apart: inverse iteration of a whole block."""
    n = len(v)
    shifted = v - (middle + 3 * ROUNDING * np.trace(v)) * np.eye(n)
    block = np.cos(np.outer(np.arange(1, n + 1), np.arange(1, size + 1)) * 1.3)
    for _ in range(6):
        block = np.linalg.solve(shifted, block)
        for k in known:
            block = block - np.outer(k, k @ block)
        block = np.linalg.qr(block)[0]
    small, turn = np.linalg.eigh(block.T @ v @ block)
    return [(float(small[i]), block @ turn[:, i]) for i in range(size - 1, -1, -1)]


def leading(v: np.ndarray, components: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues above rounding and unit eigenvectors of ``v``, in falling order, numbered by certified counts."""
    n, trace = len(v), float(np.trace(v))
    if not n or trace <= 0:
        return []
    bound = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    close = ROUNDING * trace
    counts = {bound: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v, shift)
        return counts[shift]

    out: list[tuple[float, np.ndarray]] = []
    while len(out) < min(components, n):
        number = len(out) + 1  # of the eigenvalue looked for
        if count(n * close) < number:
            break  # what is left has no variance
        low = max(s for s, c in counts.items() if c >= number)
        high = min(s for s, c in counts.items() if c < number)
        while True:
            if count(low) - count(high) == 1:
                one = _converge(v, low, high, [e for _, e in out])
                if one and count(one[0] + 2 * close) == number - 1 and count(one[0] - 2 * close) == number:
                    found = [one]
                    break
            if high - low <= close:  # neighbours that rounding can't tell apart, with a gap on both sides
                while count(high + 2 * close) != count(high):
                    high += 2 * close
                while count(low - 2 * close) != count(low):
                    low -= 2 * close
                if count(high) != number - 1:
                    raise ArithmeticError(f"eigenvalue {number} can't be certified")
                found = _cluster(v, (low + high) / 2, count(low) - count(high), [e for _, e in out])
                break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        out += found
    return out[:components]


@dataclass(frozen=True)
class Whitening:
    """What whitening needs: the number of distinct vectors, the sums, the trace, and the leading pairs."""
    n: int
    sums: list[int]
    trace: float
    values: list[float]
    vectors: np.ndarray  # a column for each component


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Exact covariance of the distinct vectors ``x`` and its leading components. Reads the rows twice, so from a file."""
    head = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = head["n"], head["width"] or 0
    sums = [0] * width
    for (_, j), value in _gather(distinct, None, width).items() if width else ():
        sums[j] = value
    if not n or not width:
        return Whitening(n, sums, 0.0, [], np.zeros((width, 0)))
    centre = [s // n for s in sums]
    products_of = _gather(distinct, centre, width)
    rest = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((width, width))
    for (i, j), p in products_of.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    pairs = leading(v, components)
    return Whitening(n, sums, float(np.trace(v)), [e for e, _ in pairs],
                     np.stack([x for _, x in pairs], axis=1) if pairs else np.zeros((width, 0)))


def _centred(x: np.ndarray, w: Whitening) -> np.ndarray:
    """n * x - S in whole numbers."""
    if w.n * _reach(x) + max(map(abs, w.sums)) < 1 << 62:
        return w.n * x - np.array(w.sums, dtype=np.int64)
    return w.n * x.astype(object) - np.array(w.sums, dtype=object)


def _whiten(centred: np.ndarray, w: Whitening) -> np.ndarray:
    return (centred.astype(np.float64) / w.n) @ w.vectors / np.sqrt(w.values)


def _moments(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                y = _whiten(_centred(_matrix(batch.column("x").slice(at, 4096), len(w.sums)), w), w)
                total += y.sum(axis=0)
                square += y.T @ y
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()], pa.list_(pa.float64())),
                                          "square": pa.array([square.ravel().tolist()], pa.list_(pa.float64()))})
    return run


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity."""
    k = len(w.values)
    parts = distinct.mapInArrow(_moments(w), "total array<double>, square array<double>")
    sums = {name: dict(parts.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(F.sum("v")).collect())
            for name in ("total", "square")}  # at most components squared numbers
    mean = np.array([sums["total"].get(i, 0.0) for i in range(k)]) / w.n
    square = np.array([sums["square"].get(i, 0.0) for i in range(k * k)]).reshape(k, k) / w.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def _projected(w: Whitening, error: float):
    explained = [e / w.trace for e in w.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = part.num_rows
                d = _centred(_matrix(part.column("x"), len(w.sums)), w)
                y = _whiten(d, w)
                if _reach(d) ** 2 * d.shape[1] < 1 << 62:
                    deviation = pa.array((d * d).sum(axis=1), pa.int64())
                else:
                    exact = (d.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(v) if v <= _LONG else None for v in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").take(each), "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    "n": pa.array(np.full(rows * k, w.n), pa.int64()), "deviation": deviation.take(each),
                    "whitened": pa.array(y.ravel()), "explained": pa.array(np.tile(explained, rows), pa.float64()),
                    "identity_error": pa.array(np.full(rows * k, error))})
    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row with a whole vector."""
    rows = whole_vectors(embeddings, scale)
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    w = fit(distinct, components)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if not w.values:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_projected(w, identity_error(distinct, w)), schema)
