"""Embedding whitening from an exact scatter matrix, counted on bit slices.

Entries become integers x = floor(scale * c) + shift.  The fit list holds each distinct integer vector once.  Tasks cut it
into batches, shift each dimension by the batch's least entry and pack the bit planes of what is left across rows into
64-bit words.  The cross-product of two dimensions is then the sum over pairs of planes of 2**(p + q) times the number of
set bits in the AND of their words, to which the shifts are added back.  Counts of batches are whole numbers and meet in
sums of decimals, so neither their order nor a repeated task changes a digit.  The driver gets one number for each pair of
dimensions, centres them as integers (n * sum(xy) - sum(x) * sum(y)) and only then divides and calls ``eigh``.

Rows whose vector is null, or holds null or non-finite entries, are dropped, as are those that are not of the commonest
length (the longer one of two equally common).  Null and repeated ids are kept, each row by itself.  An entry beyond long,
or a deviation beyond long, fails with an overflow error.  Components whose eigenvalue is not above the rounding of the
largest (constant or dependent dimensions, a single distinct vector) have no whitened value and are left out; no rows, or
rows without such a component, give an empty table.  Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stage import stage

_LONG = 2 ** 63 - 1
#: Words of 64 rows that the planes of one batch may take.
PLANE_WORDS = 1 << 21


@dataclass
class Whitening:
    """Exact counts of the fit list and the components that stand out of its covariance, by falling eigenvalue."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # one column a component
    explained: np.ndarray


def integer_rows(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``id`` and the integer vector ``x`` of each usable row, written once."""
    rows = table.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null")
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.where(usable)
    lengths = rows.groupBy(F.size("v").alias("m")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max(F.struct("n", "m"))["m"].alias("m")).first()["m"]
    def whole(c):
        c = c.cast("double") * scale
        return F.when(F.abs(c) < 2.0 ** 62, F.floor(c)).otherwise(c.cast("long")) + F.lit(shift).cast("long")  # the cast fails beyond long

    x = F.transform("v", whole)
    return stage(rows.where(F.size("v") == F.lit(common or 0)).select("id", x.alias("x")), "whitening-rows")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), flat.dtype)


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Planes of x less each dimension's least entry, as (plane, word); each plane's dimension and weight; the least entries."""
    low = [int(v) for v in x.min(axis=0)]
    words, of, bits = [], [], []
    width = -(-len(x) // 64) * 8
    for d, least in enumerate(low):
        u = x[:, d].astype(np.uint64) - np.uint64(least % 2 ** 64)  # below 2**64, also across zero
        for b in range(int(u.max()).bit_length()):
            packed = np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            words.append(np.pad(packed, (0, width - len(packed))).view(np.uint64))
            of.append(d)
            bits.append(b)
    return np.array(words, np.uint64).reshape(len(words), width // 8), of, bits, low


def scatter(x: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Exact sums of each dimension and of the products of each pair i <= j of them, by AND and bit counts."""
    n, dims = x.shape
    planes, of, bits, low = bit_planes(x)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for k in range(len(planes)):
        counts[k, k:] = counts[k:, k] = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
    # sums of whole numbers below 2**53 are exact as doubles, larger ones take Python's integers
    exact = float if 2 * (max(bits, default=0) + 1) + n.bit_length() + 2 * dims.bit_length() < 52 else object
    weights = np.zeros((len(planes), dims), exact)
    weights[range(len(planes)), of] = [2 ** b for b in bits]
    over = weights.T @ counts.astype(exact) @ weights
    ones = weights.T @ np.diagonal(counts).astype(exact)
    sums = [int(v) for v in ones]
    products = {(i, j): int(over[i, j]) + low[i] * sums[j] + low[j] * sums[i] + n * low[i] * low[j] for i in range(dims) for j in range(i, dims)}
    return [s + n * v for s, v in zip(sums, low)], products


def _scatter_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One number for each pair of dimensions and task; pairs with -1 are sums, (-1, -1) the number of rows."""
    total: dict[tuple[int, int], int] = {}
    for batch in batches:
        x = matrix(batch.column(0))
        if not x.size:
            continue
        step = max(64, PLANE_WORDS // (64 * x.shape[1]) * 64)
        for at in range(0, len(x), step):
            part = x[at:at + step]
            sums, products = scatter(part)
            for where, v in [((-1, -1), len(part)), *(((-1, d), s) for d, s in enumerate(sums)), *products.items()]:
                total[where] = total.get(where, 0) + v
    if total:
        i, j = zip(*total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v) for v in total.values()], pa.decimal128(38, 0))], ["i", "j", "v"])


def fit(rows: DataFrame) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of ``integer_rows``, and these vectors."""
    distinct = stage(rows.select("x").distinct(), "whitening-fit")
    parts = distinct.mapInArrow(_scatter_task, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    found = {(r.i, r.j): int(r.v) for r in parts.collect()}  # one number a pair of dimensions
    n = found.get((-1, -1), 0)
    dims = sum(i == -1 and j >= 0 for i, j in found)
    if not n or not dims:
        return None, distinct
    s = [found[-1, d] for d in range(dims)]
    v = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = float(Fraction(n * found[i, j] - s[i] * s[j], n * n))  # centred whole numbers, rounded once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    firm = values > max(values[0], 0.0) * dims * np.finfo(float).eps * 8
    trace = float(Fraction(sum(n * found[i, i] - s[i] * s[i] for i in range(dims)), n * n))
    return Whitening(n, s, values[firm], vectors[:, firm], values[firm] / trace if trace else values[firm]), distinct


def centred(x: np.ndarray, w: Whitening) -> np.ndarray:
    """n * x - S as doubles, exact as long as they stay below 2**53; x and S are first brought near zero as integers."""
    base = [s // w.n for s in w.sums]
    rest = np.array([s - w.n * b for s, b in zip(w.sums, base)], np.float64)
    return (x - np.array(base, np.int64)).astype(np.float64) * w.n - rest


def deviation(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Sum over dimensions of (n * x - S)**2 as an exact long."""
    rough = np.square(centred(x, w)).sum(axis=1)
    if len(rough) and rough.max() < 2 ** 62:
        base = [s // w.n for s in w.sums]
        d = (x - np.array(base, np.int64)) * np.int64(w.n) - np.array([s - w.n * b for s, b in zip(w.sums, base)], np.int64)
        return np.square(d).sum(axis=1)
    exact = [sum((w.n * int(v) - s) ** 2 for v, s in zip(row, w.sums)) for row in x.tolist()]
    if exact and max(exact) > _LONG:
        raise OverflowError("a deviation is beyond long")
    return np.array(exact, np.int64)


def whitened(x: np.ndarray, w: Whitening, most: int) -> np.ndarray:
    """(x - S / n) on each component over the root of its eigenvalue."""
    return (centred(x, w) / w.n) @ (w.vectors[:, :most] / np.sqrt(w.values[:most]))


def identity_error(distinct: DataFrame, w: Whitening, most: int) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, measured on all its vectors.

    Vectors are centred by the exact mean before they are projected; the mean of what is left is taken off as well.
    """
    k = min(most, len(w.values))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                y = whitened(matrix(batch.column(0)), w, k)
                one += y.sum(axis=0)
                two += y.T @ y
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array([*[-1] * k, *i], pa.int32()), pa.array([*range(k), *j], pa.int32()), pa.array([*one, *two[i, j]], pa.float64())], ["i", "j", "v"])

    found = {(r.i, r.j): r.v / w.n for r in distinct.mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max((abs(v - found[-1, i] * found[-1, j] - (i == j)) for (i, j), v in found.items() if i >= 0), default=0.0)


def apply(rows: DataFrame, w: Whitening | None, most: int = 16) -> DataFrame:
    """id, component (from 1), deviation, whitened and explained for each row and component up to ``most``."""
    kind = dict(rows.dtypes)["id"]
    ddl = f"id {kind}, component int, deviation long, whitened double, explained double"
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], ddl)
    k = min(most, len(w.values))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            values = pa.array(whitened(x, w, k).ravel())
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.repeat(deviation(x, w), k)), values, pa.array(np.tile(w.explained[:k], len(x)))],
                                             ["id", "component", "deviation", "whitened", "explained"])

    return rows.mapInArrow(body, ddl)
