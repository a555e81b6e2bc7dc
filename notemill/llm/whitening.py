"""Whitening of embeddings by a compensated covariance.

Vectors are taken on a grid of 1/SCALE, so that sums are exact whole numbers. The covariance is that of the distinct vectors:
each is centred on the exact mean, held as an unevaluated sum of two doubles, and its outer products are accumulated in such
double-double numbers with error-free sums and products (Knuth's two-sum, Dekker's two-product). Every task sends its high and
low parts row by row of the matrix; the parts of a row meet in order of tasks and are merged as a stream, again in
double-double. The matrix has the vectors' width, not their number; the driver solves it by the symmetric tridiagonal
divide-and-conquer routine (LAPACK's syevd, which numpy's eigh calls).

Distinct vectors are found by an aggregate with partial sums, so a vector that very many rows hold is one row before the
shuffle. All other passes are scans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import checkpoint, table

SCALE = 256
COMPONENTS = 4
#: An eigenvalue under this part of the greatest is no direction of its own.
FLAT = 1e-13
#: Sums that a task holds side by side, in doubles.
BLOCK_DOUBLES = 1 << 19
#: Grid values are held within this; larger ones stay at it.
EDGE = 2.0**62
_SPLIT = 134217729.0  # 2^27 + 1


def two_sum(a, b):
    """The rounded sum and what rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_two_sum(a, b):
    """two_sum() where |a| >= |b|."""
    s = a + b
    return s, b - (s - a)


def two_product(a, b):
    """The rounded product and what rounding lost, exactly (within the range of doubles)."""
    p, (ah, al), (bh, bl) = a * b, _split(a), _split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(ah, al, bh, bl):
    """Sum of two double-doubles."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = quick_two_sum(s, e + t)
    return quick_two_sum(s, e + f)


def dd_sum(high, low):
    """Sum of double-doubles over the first axis, in pairs."""
    while len(high) > 1:
        half = len(high) // 2
        h, l = dd_add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        if len(high) % 2:
            h, l = np.concatenate([h, high[-1:]]), np.concatenate([l, low[-1:]])
        high, low = h, l
    return high[0], low[0]


def dd_quotient(a: int, b: int) -> tuple[float, float]:
    """a / b of whole numbers as a double-double."""
    from fractions import Fraction

    exact = Fraction(a, b)
    high = float(exact)
    return high, float(exact - Fraction(high))


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]):
    """Rows less the mean, as double-doubles."""
    h, e = two_sum(x, -mean[0])
    return quick_two_sum(h, e - mean[1])


def _split(a):
    """Halves of 26 bits each, whose products are exact."""
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


class OuterSums:
    """Running sums of z_i z_j for i <= j as double-doubles: for each i, `rows` sums side by side of the columns from i on."""

    def __init__(self, dim: int):
        self.rows = max(1, BLOCK_DOUBLES // max(1, dim * (dim + 1) // 2))
        self.high = [np.zeros((self.rows, dim - i)) for i in range(dim)]
        self.low = [np.zeros((self.rows, dim - i)) for i in range(dim)]

    def add(self, zh: np.ndarray, zl: np.ndarray) -> None:
        """At most `rows` rows; the product's rounding error, the low parts' products and the sum's error go to the low sums."""
        n, (ah, al) = len(zh), _split(zh)
        for i, (high, low) in enumerate(zip(self.high, self.low, strict=True)):
            a, ahi, ali, b, ahb, alb = zh[:, i : i + 1], ah[:, i : i + 1], al[:, i : i + 1], zh[:, i:], ah[:, i:], al[:, i:]
            p = a * b
            error = ((ahi * ahb - p) + ahi * alb + ali * ahb) + ali * alb + (a * zl[:, i:] + zl[:, i : i + 1] * b)
            total, lost = two_sum(high[:n], p)
            high[:n] = total
            low[:n] += lost + error

    def totals(self):
        """(high, low) of each i."""
        return [dd_sum(*quick_two_sum(h, l)) for h, l in zip(self.high, self.low, strict=True)]


def _matrix(batch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _covariance_parts(dim: int, centre):
    """A task's sums of outer products, one row of the matrix a record."""

    def build(batches):
        import pyspark

        sums, some = OuterSums(dim), False
        for batch in batches:
            for k in range(0, batch.num_rows, sums.rows):
                sums.add(*centre(batch.slice(k, sums.rows)))
                some = True
        if some:
            high, low = zip(*sums.totals(), strict=True)
            task = pyspark.TaskContext.get().partitionId()
            columns = [np.arange(dim), np.full(dim, task), high, low]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["i", "task", "high", "low"])

    return build


def _merge_parts(batches):
    """Records come sorted by row of the matrix and task; one row's sum is held at a time."""
    at, high, low = None, None, None
    record = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([high], pa.list_(pa.float64())), pa.array([low], pa.list_(pa.float64()))], names=["i", "high", "low"])
    for batch in batches:
        for i, h, l in zip(batch.column("i").to_pylist(), batch.column("high"), batch.column("low"), strict=True):
            h, l = (v.values.to_numpy() for v in (h, l))
            if i != at:
                if at is not None:
                    yield record()
                at, high, low = i, h, l
            else:
                high, low = dd_add(high, low, h, l)
    if at is not None:
        yield record()


def covariance(rows: DataFrame, dim: int, n: int, centre) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sums of outer products over n, shape (dim, dim); centre makes a batch centred double-doubles."""
    parts = rows.mapInArrow(_covariance_parts(dim, centre), "i int, task int, high array<double>, low array<double>")
    merged = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(_merge_parts, "i int, high array<double>, low array<double>")
    high, low = np.zeros((dim, dim)), np.zeros((dim, dim))
    for r in merged.collect():  # dim records
        high[r.i, r.i :], low[r.i, r.i :] = r.high, r.low
        high[r.i :, r.i], low[r.i :, r.i] = r.high, r.low
    q = high / n  # a double-double over a whole number
    p, e = two_product(q, np.full_like(q, float(n)))
    return quick_two_sum(q, ((high - p) - e + low) / n)


def on_grid(c: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(scale * c) + 0.0, -EDGE, EDGE).astype(np.int64)


def _grid(dim: int, scale: int):
    def vectors(batches):
        for batch in batches:
            x = on_grid(_matrix(batch, 0, dim), scale)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.int64()))], names=["x"])

    return vectors


class Whitening:
    """What is fitted: n, whole sums, eigenvalues, components as columns, explained shares and the identity error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray, explained: list[float | None]):
        self.n, self.sums, self.values, self.axes, self.explained = n, sums, values, axes, explained
        means = [dd_quotient(s, n) for s in sums]
        self.mean = (np.array([m[0] for m in means]), np.array([m[1] for m in means]))
        self.live = values > FLAT * max(float(values[0]) if len(values) else 0.0, 0.0)
        self.identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of grid vectors; those of a flat component are not defined (NaN)."""
        zh, zl = centred(x.astype(np.float64), self.mean)
        low = x - x.astype(np.float64).astype(np.int64) if np.abs(x).max(initial=0) > 2**53 else 0
        y = zh @ self.axes + (zl + low) @ self.axes
        return np.where(self.live, y / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly; None where it is beyond a long."""
        n, top = self.n, max(map(abs, self.sums), default=0)
        if (int(np.abs(x).max(initial=0)) * n + top) ** 2 * max(x.shape[1], 1) < 2**63:
            return ((n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(1).tolist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 2**63 else None for d in exact]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is not null and has finite entries only."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(v.isNotNull() & finite)


def _width(usable: DataFrame) -> int | None:
    """The length that most usable vectors have, the lower of several; null if there is none."""
    top = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return top.d if top else None


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of the distinct grid vectors of `vectors`; None if no row is usable. See whiten() for which rows are."""
    usable = _usable(vectors, id_col, vector_col)
    dim = _width(usable)
    if dim is None:
        return None
    grid = usable.where(F.size("v") == dim).select("v").mapInArrow(_grid(dim, scale), "x array<long>") if dim else usable.select(F.array().cast("array<long>").alias("x"))
    fitted = checkpoint(grid.distinct())
    if not dim:
        return Whitening(1, [], np.zeros(0), np.zeros((0, 0)), [])

    def sums(batches):
        total, n = [0] * dim, 0
        for batch in batches:
            x = _matrix(batch, 0, dim)
            exact = int(np.abs(x).max(initial=0)) * len(x) < 2**62
            total = [a + int(b) for a, b in zip(total, x.sum(0) if exact else x.astype(object).sum(0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * dim, pa.int64())], names=["i", "total", "n"])

    whole = fitted.mapInArrow(sums, "i int, total string, n long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
    n, totals = whole[0].n, [int(r.total) for r in whole]
    means = [dd_quotient(s, n) for s in totals]
    mean = (np.array([m[0] for m in means]), np.array([m[1] for m in means]))
    high, low = covariance(fitted, dim, n, lambda batch: centred(_matrix(batch, 0, dim).astype(np.float64), mean))
    values, axes = np.linalg.eigh(high + low)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = np.maximum(values[order], 0.0), axes[:, order]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)  # the largest entry is positive
    trace = float(high.trace() + low.trace())
    out = Whitening(n, totals, values, axes, [float(v) / trace if trace > 0 else None for v in values])
    live = int(out.live.sum())
    if live:

        def whitened(batch):
            y = out.project(_matrix(batch, 0, dim))[:, :live]
            return y, np.zeros_like(y)  # centred already, as the vectors are

        unit, rest = covariance(fitted, live, n, whitened)
        out.identity_error = float(np.abs(unit - np.eye(live) + rest).max())
    return out


WHITENED = "n long, deviation long, whitened array<double>"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", model: Whitening | None = None) -> DataFrame:
    """(id_col, n, deviation, whitened, explained, identity_error) of every usable row.

    Left out are rows whose vector is null or holds a null or a non-finite entry, and those whose length is not that of most
    usable vectors (the lower length of two as frequent). Entries beyond 2^62 on the grid stay there. whitened has
    a value for each component, null where the component's eigenvalue is zero (fewer directions than components), and as many
    as the vectors are wide if that is less. deviation is null beyond a long. identity_error is null if no component is live.
    Repeated rows all come out; null ids are ids like others; an empty table gives an empty result. Other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    fitted = model or fit(vectors, components, scale, id_col, vector_col)
    extra = "explained array<double>, identity_error double"
    if fitted is None:
        return vectors.limit(0).select(F.col(f"`{id_col}`"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in f"{WHITENED}, {extra}".split(", ")])
    dim = len(fitted.sums)

    def scored(batches):
        for batch in batches:
            if dim:
                x = on_grid(_matrix(batch, 1, dim), scale)
                y, deviation = fitted.project(x), fitted.deviation(x)
            else:
                y, deviation = np.zeros((batch.num_rows, 0)), [0] * batch.num_rows
            flat = pa.array(y.ravel(), pa.float64(), from_pandas=True)  # NaN to null
            offsets = pa.array(np.arange(batch.num_rows + 1) * y.shape[1], pa.int32())
            columns = [batch.column(0), pa.array([fitted.n] * batch.num_rows, pa.int64()), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "deviation", "whitened"])

    rows = _usable(vectors, id_col, vector_col).where(F.size("v") == dim).mapInArrow(scored, f"id {kind}, {WHITENED}")
    explained = F.array(*[F.lit(e).cast("double") for e in fitted.explained]).cast("array<double>")
    return rows.select(F.col("id").alias(id_col), "n", "deviation", "whitened", explained.alias("explained"), F.lit(fitted.identity_error).cast("double").alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each usable vector and each of up to 4 components."""
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")
