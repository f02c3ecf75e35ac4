"""Embedding whitening by polarisation: exact sums of squares of every dimension and every sum of two dimensions.

With y = n * x - S (whole numbers: x the quantised vector, S the sums over the n fitted vectors) each task adds up the squares of y_i and of
y_i + y_j. Half of what the square of a sum has more than the squares of its parts is the product's sum, so
all covariances follow from squares alone, without rounding. They are divided once and given to ``eigh``.

Squares are kept in digits of 24 bits, so sums of any length are exact; a task sends one row per pair. The model is a few arrays whose size
depends on the number of dimensions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.ordering import replaced
from tabulon.session import staged

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LEAST_SHARE = 1e-12  # of the largest eigenvalue: directions with less are flat and can't be whitened
ROWS = 4096  # worked on at once
DIGIT, DIGITS = 24, 8
LARGEST = 2.0**46  # entries beyond are no embeddings; 64 times as much still is a whole number in a double


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors, sums ``s`` of their entries, unit ``vectors`` (columns) and ``values`` of their covariance, its ``trace``."""

    n: int
    s: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def quantised(batch_column: pa.Array) -> np.ndarray:
    """Rows of an Arrow array of equally long lists as whole numbers."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"an embedding has an entry beyond {LARGEST:g}")
    return (np.floor(SCALE * flat) + SHIFT).astype(np.int64).reshape(len(batch_column), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` is there, without null or non-finite entries, and of the length that most such rows have (of equally frequent ones the longer)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.forall("embedding", lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))))
    lengths = good.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return good.where(F.size("embedding") == lengths[0]["length"]) if lengths else good.where("false")


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - S, as longs where they suffice, else as Python integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) * 2 < 1 << 62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def square_sums(x: np.ndarray, n: int, s: np.ndarray, digits: np.ndarray) -> None:
    """Adds the squares of y_i (i = j) and y_i + y_j (i < j) of the rows ``x`` to ``digits`` (pairs x 8, the last one open)."""
    y = centred(x, n, s)
    at = 0
    for i in range(y.shape[1]):
        z = y[:, i:] + y[:, i : i + 1]
        z[:, 0] = y[:, i]
        most = max(abs(int(z.max())), abs(int(z.min())))
        end = at + z.shape[1]
        if y.dtype == object or most >= 1 << 47:
            for k in range(z.shape[1]):
                total = sum(int(v) * int(v) for v in z[:, k])
                digits[at + k] += np.array([total >> DIGIT * p & (1 << DIGIT) - 1 for p in range(DIGITS - 1)] + [total >> DIGIT * (DIGITS - 1)])
        elif most < 1 << 25:  # 4096 squares fit a long
            digits[at:end, 0] += np.einsum("rk,rk->k", z, z)
        else:
            high, low = z >> DIGIT, z & (1 << DIGIT) - 1
            for k, (a, b, times) in enumerate(((low, low, 1), (low, high, 2), (high, high, 1))):
                digits[at:end, k] += times * np.einsum("rk,rk->k", a, b)
        at = end
    for k in range(DIGITS - 1):
        digits[:, k + 1] += digits[:, k] >> DIGIT
        digits[:, k] &= (1 << DIGIT) - 1


def fit(embeddings: DataFrame) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the usable vectors (each distinct quantised one counts once), and those as ``x`` (8 bytes an entry); None if there are none."""

    def pack(batches):
        for batch in batches:
            if len(batch):
                x = quantised(batch.column(0))
                width = 8 * x.shape[1]
                data = pa.py_buffer(np.ascontiguousarray(x))
                offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, data])], ["x"])

    vectors = staged(embeddings.select("embedding").mapInArrow(pack, "x binary").distinct(), "whitening-fit")

    def sums(batches):
        n, s = 0, None
        for x in _arrays(batches):
            n, s = n + len(x), x.sum(axis=0) + (0 if s is None else s)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s))), pa.array([n] * len(s), pa.int64()), pa.array(s)], ["dim", "n", "s"])

    found = vectors.mapInArrow(sums, "dim long, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = found.orderBy("dim").collect()
    if not rows:
        return None
    n, s, d = rows[0]["n"], np.array([int(r["s"]) for r in rows], object), len(rows)

    places = [f"p{k}" for k in range(DIGITS)]

    def squares(batches):
        digits = np.zeros((d * (d + 1) // 2, DIGITS), np.int64)
        for x in _arrays(batches):
            square_sums(x, n, s, digits)
        if digits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(digits))), *(pa.array(digits[:, k]) for k in range(DIGITS))], ["pair", *places])

    total = vectors.mapInArrow(squares, f"pair long, {' long, '.join(places)} long").groupBy("pair").agg(*(F.sum(k).alias(k) for k in places)).collect()
    square = dict.fromkeys(range(d * (d + 1) // 2), 0) | {r["pair"]: sum(r[k] << DIGIT * i for i, k in enumerate(places)) for r in total}
    first = np.cumsum([0] + [d - i for i in range(d)])
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            own, other = square[int(first[i])], square[int(first[j])]
            product = own if i == j else (square[int(first[i]) + j - i] - own - other) // 2
            covariance[i, j] = covariance[j, i] = product / n**3
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    largest = axes[np.abs(axes).argmax(axis=0), range(d)]
    return Whitening(n, s, axes * np.where(largest < 0, -1.0, 1.0), values, float(sum(square[int(f)] for f in first[:-1]) / n**3)), vectors


def _arrays(batches):
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            part = batch.column("x").slice(low, ROWS)
            if len(part):
                yield np.frombuffer(b"".join(v.as_buffer() for v in part), np.int64).reshape(len(part), -1)


def projected(x: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """Whitened values of rows ``x``: (x - S/n) on the first components, each over the root of its eigenvalue."""
    y = centred(x, model.n, model.s).astype(np.float64) / model.n
    return y @ (model.vectors[:, :components] / np.sqrt(model.values[:components]))


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float:
    """The largest entry, in absolute value, of the covariance of the fitted vectors' whitened values minus the identity."""

    def products(batches):
        n, s, m = 0, np.zeros(components), np.zeros((components, components))
        for x in _arrays(batches):
            w = projected(x, model, components)
            n, s, m = n + len(w), s + w.sum(axis=0), m + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([m.ravel().tolist()])], ["n", "s", "m"])

    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(components)] + [F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(components**2)]
    row = vectors.mapInArrow(products, "n long, s array<double>, m array<double>").agg(F.sum("n").alias("n"), *sums).first()
    mean = np.array([row[f"s{i}"] for i in range(components)]) / row["n"]
    second = np.array([row[f"m{i}"] for i in range(components**2)]).reshape(components, -1) / row["n"]
    return float(np.abs(second - np.outer(mean, mean) - np.eye(components)).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row of ``embeddings`` (``embedding`` and any other columns, which are kept) and component.

    Adds ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation`` (sum of (n * x - S)^2; null beyond a long), ``whitened``, ``explained`` and
    ``identity_error``; own columns of these names are replaced, ``embedding`` goes. Rows whose vector is null, empty, of an unusual length
    or holds null or non-finite entries are left out. Repeated vectors count once in the fit and come out each. Directions without
    spread (eigenvalue below 1e-12 of the largest) have no whitened value and no row; so a table of equal vectors, like an empty one, gives no rows.
    """
    good = usable(embeddings)
    names = {k: F.lit(None).cast(t) for k, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))}
    kept = replaced(good, names | {"embedding": F.lit(None)}).drop("embedding", *names)
    empty = kept.withColumns(names).where("false")
    found = fit(good)
    if found is None:
        return empty
    model, vectors = found
    k = min(components, int((model.values > LEAST_SHARE * max(model.values[0], 0)).sum()))
    if not k:
        return empty
    error, explained = identity_error(vectors, model, k), model.values / model.trace
    labels = ["carried", *names]
    carried = F.struct(*(F.col(f"`{c}`") for c in kept.columns)) if kept.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.slice(low, ROWS)
                if not len(part):
                    continue
                x = quantised(part.column("embedding"))
                y = centred(x, model.n, model.s)
                if y.dtype == object or float(np.abs(y).max()) ** 2 * y.shape[1] >= 2.0**62:
                    y = y.astype(object)
                deviation = [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]
                each = np.repeat(np.arange(len(part)), k)
                columns = [
                    part.column("carried").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(each), model.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(projected(x, model, k).ravel()), pa.array(np.tile(explained[:k], len(part))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, labels)

    schema = f"carried {good.select(carried.alias('c')).schema['c'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = good.select(carried.alias("carried"), "embedding").mapInArrow(run, schema)
    return out.select(*(["carried.*"] if kept.columns else []), *names)
