"""Logistic regression on hashed features of texts, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.wordhash import C1, SPACE, Words, encoded, mix, slices

DIMS = 1 << 18  # weights of one model: 1 MB

#: Sparse features of texts: the text's number, the feature's index (0 is the bias) and its value.
Features = tuple[np.ndarray, np.ndarray, np.ndarray]


def word_runs(texts: Sequence[bytes]) -> Iterator[tuple[Words, np.ndarray]]:
    """Slices of words, as ``slices`` gives them."""
    yield from slices(texts)


def index_of(hashes: np.ndarray, family: int, dims: int = DIMS) -> np.ndarray:
    return (mix(hashes + np.uint64(family * int(C1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(dims - 1)).astype(np.int64) + 1


def ngrams(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and their texts' numbers."""
    if n == 1:
        return hashes, of
    if len(hashes) < n:
        return hashes[:0], of[:0]
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + hashes[k : len(hashes) - n + 1 + k]
    inside = of[: len(of) - n + 1] == of[n - 1 :]
    return out[inside], of[: len(of) - n + 1][inside]


def summed(of: np.ndarray, index: np.ndarray, value: np.ndarray, dims: int = DIMS) -> Features:
    """One entry for each text and index, with the sum of its values."""
    key, back = np.unique(of.astype(np.int64) * dims + index, return_inverse=True)
    return key // dims, key % dims, np.bincount(back, value, len(key))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Ftrl:
    """Settings of the updates: step ``alpha``/(``beta`` + root of squared gradients), penalties ``l1`` and ``l2``, passes."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1
    passes: int = 4

    def fit(
        self,
        rows: Sequence[tuple[np.ndarray, np.ndarray]],
        labels: Sequence[int],
        dims: int = DIMS,
        more: tuple[np.ndarray, np.ndarray] | None = None,
        skip: np.ndarray | None = None,
    ) -> np.ndarray:
        """Weights (float32; index 0 is the bias) from rows of indices and values in the given order; no rows: all zero.

        ``more`` are further features: their indices, and a row of values for each row. Rows in ``skip`` are left out.
        """
        z, n = np.zeros(dims), np.zeros(dims)
        for _ in range(self.passes):
            for i, ((index, value), label) in enumerate(zip(rows, labels, strict=True)):
                if skip is not None and skip[i]:
                    continue
                if more is not None and len(more[0]):
                    index, value = np.r_[index, more[0]], np.r_[value, more[1][i]]
                root, state = np.sqrt(n[index]), z[index]
                w = self._weights(state, root, index)
                p = sigmoid(float(w @ value))
                gradient = (p - label) * value
                new = n[index] + gradient * gradient
                z[index] = state + gradient - (np.sqrt(new) - root) / self.alpha * w
                n[index] = new
        return self._weights(z, np.sqrt(n), np.arange(dims)).astype(np.float32)

    def _weights(self, z: np.ndarray, root: np.ndarray, index: np.ndarray) -> np.ndarray:
        l1 = np.where(index == 0, 0.0, self.l1)  # the bias is not pulled to zero
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + root) / self.alpha + self.l2))


def sample(docs: DataFrame, labels: DataFrame, rows: int, features: Callable[[Sequence[bytes]], Features], seed: str) -> DataFrame:
    """At most ``rows`` labelled documents, drawn by a hash of their id, as ``doc_id``, ``index``, ``value`` and the labels.

    ``labels`` has one row per doc_id. The result is one partition in the order of the draw: its size is bounded by ``rows``.
    """
    names = [c for c in labels.columns if c != "doc_id"]
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    drawn = labels.where("doc_id IS NOT NULL").orderBy(draw, "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    made = joined.select("doc_id", *names, "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} int" for c in names) + ", index binary, value binary"

    def vectors(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                of, index, value = features(encoded(part.column("text")))
                cut = np.searchsorted(of, np.arange(part.num_rows + 1))
                pieces = list(zip(cut, cut[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(part.column(c).cast(pa.int32()) for c in names),
                        pa.array([index[a:b].astype("<i4").tobytes() for a, b in pieces], pa.binary()),
                        pa.array([value[a:b].astype("<f4").tobytes() for a, b in pieces], pa.binary()),
                    ],
                    ["doc_id", *names, "index", "value"],
                )

    return made.mapInArrow(vectors, schema).orderBy(draw, F.xxhash64("index", "value")).limit(rows)


def fitted(rows: DataFrame, train: Callable[[dict], list[bytes]], names: Sequence[str]) -> dict[str, np.ndarray]:
    """Weights by name from ``train`` over the drawn rows, run as one task on an executor (the rows are bounded by ``sample``)."""

    def run(batches):
        batches = list(batches)
        got = {}
        if batches:
            table = pa.Table.from_batches(batches).combine_chunks()
            for name in table.column_names:
                column = table.column(name)
                # Views of the Arrow buffers, not a Python object per row.
                got[name] = [_bytes(column[i]) for i in range(len(column))] if pa.types.is_binary(column.type) else column.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(list(names)), pa.array(train(got), pa.binary())], ["name", "weights"])

    found = {r["name"]: np.frombuffer(r["weights"], "<f4") for r in rows.mapInArrow(run, "name string, weights binary").collect()}
    return {n: found.get(n, np.zeros(DIMS, np.float32)) for n in names}


def _bytes(scalar: pa.Scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), np.uint8)


def unpacked(rows: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``sample`` as pairs of indices and values, without copies."""
    pairs = zip(rows.get("index", []), rows.get("value", []), strict=True)
    return [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")) for i, v in pairs]


def in_parts(texts, width: int = 256) -> Iterator[list[bytes]]:
    values = list(texts)
    for low in range(0, len(values), width):
        yield encoded(values[low : low + width])


def remainder(doc_id: Column, n: int = 5) -> Column:
    """CRC-32 of the id as text, modulo ``n``; null counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


__all__ = ["SPACE", "Ftrl", "fitted", "in_parts", "index_of", "ngrams", "remainder", "sample", "sigmoid", "summed", "unpacked", "word_runs"]
