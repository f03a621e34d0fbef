"""Embedding whitening: covariance from upper-triangle column aggregates, decomposed with LAPACK.

One generated SQL aggregation sums the centred products of every pair of dimensions. Entries are whole numbers, so they
are centred by the whole number next to the mean; the products' sums are exact then, and what is left of the mean (half
a step at most) is taken off them exactly, too. The covariance is therefore the same however rows are dealt to tasks.
Only sums go to the driver: some numbers for each dimension, one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Entries whose scaled whole number is as large as this aren't held exactly by a double; vectors with one take no part.
LARGEST = 1 << 52
#: Eigenvalues up to this share of the largest (times the dimensions) can't be told from zero in double precision.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Fit:
    """Means and eigenvectors of ``n`` vectors of ``size`` whole numbers."""

    n: int
    size: int
    sums: list[int]
    eigenvalues: np.ndarray  # falling
    components: np.ndarray  # a row each, unit length
    trace: float

    @property
    def near(self) -> list[int]:
        """Of each dimension, the whole number next to the mean."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """``n`` times what the mean has beyond ``near``."""
        return [s - self.n * r for s, r in zip(self.sums, self.near)]

    def variance(self, k: int) -> float:
        """The eigenvalue of a component; 0 where there is no variance that double precision can tell from none."""
        e = float(self.eigenvalues[k])
        return e if e > LEAST_SHARE * self.size * float(self.eigenvalues[0]) and e > 0 else 0.0


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, x`` with floor(scale * c) + shift of every entry; vectors that are null, or hold null, non-finite or
    too large entries (``LARGEST``), are left out."""
    v = F.col("v")
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    return named.where(v.isNotNull() & fine).select("vec_id", F.transform(v, lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))


def _columns(x: DataFrame, size: int) -> DataFrame:
    return x.select(*[F.col("x")[i].alias(f"x{i}") for i in range(size)])


def product_sums(columns: list[str]) -> list[str]:
    """SQL of the sum of the products of each two of the given expressions, the upper triangle row by row."""
    return [f"sum({a} * {b})" for i, a in enumerate(columns) for b in columns[i:]]


def sums_of_products(rows: DataFrame, columns: list[str]) -> list[list]:
    """The symmetric matrix of the sums of all products of two columns, from one aggregation.

    No two products have a part in common, so the search for common parts among thousands of them is left out while this
    one is planned.
    """
    key = "spark.sql.subexpressionElimination.enabled"
    conf = rows.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "false")
    try:
        upper = rows.selectExpr(f"array({', '.join(product_sums(columns))}) AS sums").collect()[0]["sums"]
    finally:
        conf.set(key, before)
    return _square(upper, len(columns))


def _square(upper: list, size: int) -> list[list]:
    """The whole matrix of an upper triangle."""
    full, it = [[None] * size for _ in range(size)], iter(upper)
    for i in range(size):
        for j in range(i, size):
            full[i][j] = full[j][i] = next(it)
    return full


def fit(x: DataFrame) -> Fit | None:
    """The whitening of all vectors of the most common length (the longer one of ties); None without vectors."""
    most = x.where("size(x) > 0").groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return None
    size, n = most["size"], most["count"]
    vectors = _columns(x.where(F.size("x") == size), size)
    of_all = [f"{f}(x{i})" for f in ("sum", "min", "max") for i in range(size)]
    first = tuple(vectors.selectExpr(*of_all).first())
    sums, low, high = first[:size], first[size : 2 * size], first[2 * size :]
    part = Fit(n, size, list(sums), np.zeros(size), np.eye(size), 0.0)
    reach = max(max(abs(a - r), abs(b - r)) for a, b, r in zip(low, high, part.near))
    # whole numbers where their sums surely fit, which is so but for vectors with entries far from all others
    kind = "bigint" if n * reach * reach < 1 << 62 else "double"
    centred = vectors.selectExpr(*[f"cast(x{i} - {r} AS {kind}) AS y{i}" for i, r in enumerate(part.near)])
    products = sums_of_products(centred, [f"y{i}" for i in range(size)])
    rest = part.rest
    if kind == "bigint":
        cov = np.array([[(products[i][j] * n - rest[i] * rest[j]) / (n * n) for j in range(size)] for i in range(size)])
    else:
        mean = np.array(rest, float) / n
        cov = np.array(products, float) / n - np.outer(mean, mean)
    values, vectors_of = np.linalg.eigh(cov)
    return Fit(n, size, list(sums), values[::-1], vectors_of.T[::-1], float(np.trace(cov)))


def whiten(x: DataFrame, f: Fit, most: int = 32) -> DataFrame:
    """``vec_id, x, w``: the vectors of the fit's length with their first ``most`` whitened components."""
    count = min(most, f.size)
    scaled = np.array([f.components[k] / np.sqrt(f.variance(k)) if f.variance(k) else np.zeros(f.size) for k in range(count)])
    near, rest = np.array(f.near, np.int64), np.array(f.rest, float) / f.n
    size = f.size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            w = ((rows - near) - rest) @ scaled.T
            ends = pa.array(np.arange(0, w.size + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], names=["vec_id", "x", "w"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return mapped(x.where(F.size("x") == size), run, f"vec_id {kind}, x array<long>, w array<double>")


def identity_error(white: DataFrame, f: Fit, most: int = 32) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, measured over all of them; components
    without variance are left out."""
    live = [k for k in range(min(most, f.size)) if f.variance(k)]
    if not live:
        return 0.0
    columns = white.select(*[F.col("w")[k].alias(f"w{k}") for k in live])
    means = tuple(columns.selectExpr(*[f"avg(w{k})" for k in live]).first())
    centred = columns.selectExpr(*[f"w{k} - cast('{m!r}' AS double) AS c{k}" for k, m in zip(live, means)])
    found = np.array(sums_of_products(centred, [f"c{k}" for k in live]), float) / f.n
    return float(np.abs(found - np.eye(len(live))).max())


def whitening(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every vector and component up to ``most``.

    Rows that repeat, or have no id, are vectors of their own; other columns aren't read. Vectors that ``whole_vectors``
    leaves out, empty ones and those of another length than most have no rows; neither has an empty table. A component
    without variance is 0 for every vector. ``deviation`` is null where it doesn't fit 64 bits (``n`` over some hundred
    millions); ``deviation_digits`` has all digits then, as text.
    """
    x = whole_vectors(rows, id_col, vector_col)
    f = fit(x)
    if f is None:
        empty = "cast(0 AS int) AS component, 0L AS n, 0L AS deviation, 0D AS whitened, 0D AS explained, 0D AS identity_error, '' AS deviation_digits"
        return x.select("vec_id", F.expr(f"inline(array(struct({empty})))")).where("false")
    white = whiten(x, f, most)
    error = identity_error(white, f, most)
    near, rest = F.array(*[F.lit(r).cast("long") for r in f.near]), F.array(*[F.lit(r).cast("long") for r in f.rest])
    # n * x - S is n * y - rest; its square is taken apart so that 38 digits are needed three times a vector only
    big = lambda c: c.cast("decimal(38,0)")
    total = lambda v: F.aggregate(v, big(F.lit(0)), lambda s, p: big(s + p))
    y = F.zip_with("x", near, lambda a, b: a - b)
    squares, cross = total(F.transform(y, lambda a: big(big(a) * big(a)))), total(F.zip_with(y, rest, lambda a, b: big(big(a) * big(b))))
    whole = big(big(squares * F.lit(f.n * f.n).cast("decimal(38,0)")) - big(cross * F.lit(2 * f.n).cast("decimal(38,0)"))) + F.expr(f"cast('{sum(r * r for r in f.rest)}' AS decimal(38,0))")
    share = [float(f.eigenvalues[k] / f.trace) if f.variance(k) else 0.0 for k in range(min(most, f.size))]
    per_vector = white.select("vec_id", big(whole).alias("whole"), F.posexplode("w").alias("k", "whitened"))
    return per_vector.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(f.n).cast("long").alias("n"),
        F.expr("try_cast(whole AS bigint)").alias("deviation"),
        "whitened",
        F.array(*[F.lit(s) for s in share])[F.col("k")].alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("whole").cast("string").alias("deviation_digits"),
    )
