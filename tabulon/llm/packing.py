"""Token ids packed into rows of equal length: best fit, longest segments first."""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut before bytes are merged (a fixed value that belongs to the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
LENGTH = 2048
POOL_BYTES = 2 << 20  # of text whose segments are packed together
POOL_MOST = 16 << 20  # tokens that a task holds at most; a fuller pool (of equal rows) is packed in parts
CHUNK = 1 << 18  # characters that are encoded at once
LONG_WORD = re.compile(r"\S{4096}")


def ranks_of(path: str) -> bytes:
    """The content of a vocabulary file, read once by the driver and sent along with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def encoder(ranks: bytes, pattern: str = PATTERN) -> Callable[[str], np.ndarray]:
    """Text to ids (int32), whole: decoding the ids gives back the text.

    Long texts are encoded in chunks that end before white space, very long words in pieces.
    """
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if len(text) <= 4096:
            return np.array(own.encode_ordinary(text), np.int32)
        cuts = {m.end() for m in LONG_WORD.finditer(text)}
        low = 0
        while len(text) - low > CHUNK:
            space = text.rfind(" ", low + 1, low + CHUNK)
            low = space if space > low else low + CHUNK
            cuts.add(low)
        edges = [0, *sorted(cuts - {0, len(text)}), len(text)]
        return np.concatenate([np.array(own.encode_ordinary(text[a:b]), np.int32) for a, b in zip(edges, edges[1:], strict=False)])

    return encode


class Capacities:
    """Open rows by free places: a segment tree over capacities finds the fullest row that still has room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = np.zeros(2 * self.size, np.int32).tolist()
        self.rows: list[deque[int]] = [deque() for _ in range(most + 1)]

    def add(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        node = free + self.size
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of ``need`` or more (the one that came first to it) and its room; None: there is none."""
        node, any_row = need + self.size, self.any
        if not any_row[node]:
            while node > 1 and (node & 1 or not any_row[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not any_row[node]:
                    node += 1
        free = node - self.size
        while node:
            any_row[node] -= 1
            node >>= 1
        return self.rows[free].popleft(), free


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The row of each segment: in the given order (longest first), each goes to the fullest row that still has room."""
    open_rows, out, count = Capacities(capacity), [], 0
    for length in lengths:
        found = open_rows.take(length)
        if found is None:
            row, free = count, capacity
            count += 1
        else:
            row, free = found
        out.append(row)
        open_rows.add(row, free - length)
    return out


def packed_rows(ids: list[np.ndarray], capacity: int, pad: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows: the numbers of their segments, ids and positions (``capacity`` long) and cumulative lengths (from 0)."""
    members: dict[int, list[int]] = {}
    for segment, row in enumerate(best_fit([len(x) for x in ids], capacity)):
        members.setdefault(row, []).append(segment)
    for row in sorted(members):
        lengths = [len(ids[s]) for s in members[row]]
        ends = np.cumsum([0, *lengths]).astype(np.int32)
        matrix, places = np.full(capacity, pad, np.int32), np.zeros(capacity, np.int32)
        used = ends[-1]
        matrix[:used] = np.concatenate([ids[s] for s in members[row]])
        places[:used] = np.arange(used) - np.repeat(ends[:-1], lengths)
        yield members[row], matrix, places, ends


def segments(docs: DataFrame, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """``doc_id``, ``start``, ``n`` and ``ids`` (bytes): each document's ids with the end mark, cut into segments of ``length`` at most."""
    ranks = ranks_of(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = "<u2" if max(end_id, ranks.count(b"\n")) < 1 << 16 else "<u4"

    def cut(batches):
        encode = encoder(ranks)
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                of, starts, sizes, data = [], [], [], []
                for number, text in enumerate(batch.column("text").to_pylist()):
                    tokens = np.append(encode(text or ""), np.int32(end_id))
                    for start in range(0, len(tokens), length):
                        part = tokens[start : start + length]
                        of.append(number)
                        starts.append(start)
                        sizes.append(len(part))
                        data.append(part.astype(width).tobytes())
                ids = batch.column("doc_id").take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["doc_id", "start", "n", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, n int, ids binary")


def packed(
    docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID, pool_bytes: int = POOL_BYTES
) -> DataFrame:
    """All documents (``doc_id``, ``text``) as token ids in rows of ``length``; one result row per packed row.

    ``pool`` and ``pack`` number the rows; ``ids`` and ``positions`` are ``length`` little-endian int32 (a row of the id
    matrix, and the places that restart at 0 with each segment); ``cu_seqlens`` are the cumulative lengths of the segments
    from 0; ``doc_ids`` and ``starts`` say what each segment is: its document and the place of its first token in the
    document's ids; ``n_tokens`` is what is filled, the rest is ``end_id`` at position 0. Every document
    ends with ``end_id``, so an empty or null text is a segment of one. Documents longer than a row are cut into segments, none
    is dropped. Segments are dealt by a hash to pools of about ``pool_bytes`` of text, and best fit by decreasing
    length packs each pool: what a task holds does not grow with the corpus. An empty table gives no rows.
    """
    ranks = ranks_of(vocabulary)
    width = "<u2" if max(end_id, ranks.count(b"\n")) < 1 << 16 else "<u4"
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pools = -(-size // pool_bytes) or 1
    pieces = segments(docs, vocabulary, length, end_id)
    dealt = pieces.withColumn("pool", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(pools)))
    ordered = dealt.repartition("pool").sortWithinPartitions("pool", F.desc("n"), "doc_id", "start", "ids")

    def pack(batches):
        pool, base, held, tokens = None, 0, [], 0

        def rows():
            nonlocal base
            out, last = [], base
            for members, matrix, places, ends in packed_rows([h[2] for h in held], length, end_id):
                out.append((pool, last, matrix.tobytes(), places.tobytes(), ends, [held[m][0] for m in members], [held[m][1] for m in members]))
                last += 1
                if len(out) == 256:
                    yield made(out)
                    out = []
            base = last
            if out:
                yield made(out)

        def made(out):
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.binary()),
                    pa.array(columns[3], pa.binary()),
                    pa.array(columns[4], pa.list_(pa.int32())),
                    pa.array(columns[5], pa.list_(id_kind)),
                    pa.array(columns[6], pa.list_(pa.int64())),
                    pa.array([int(e[-1]) for e in columns[4]], pa.int32()),
                ],
                ["pool", "pack", "ids", "positions", "cu_seqlens", "doc_ids", "starts", "n_tokens"],
            )

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            lists = (batch.column(c).to_pylist() for c in ("pool", "doc_id", "start", "ids"))
            for own, doc, start, data in zip(*lists, strict=True):
                if own != pool or tokens > POOL_MOST:
                    if held:
                        yield from rows()
                    base = base if own == pool else 0
                    pool, held, tokens = own, [], 0
                held.append((doc, start, np.frombuffer(data, width)))
                tokens += len(data)
        if held:
            yield from rows()

    return ordered.select("pool", "doc_id", "start", "ids").mapInArrow(
        pack,
        f"pool long, pack int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<long>, n_tokens int",
    )


def unpacked(rows: DataFrame) -> DataFrame:
    """The documents' ids back from packed rows: ``doc_id``, ``start`` and ``ids`` (array) of every segment."""

    def split(batches):
        for batch in batches:
            docs, starts, ids = [], [], []
            for data, ends, own, first in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "starts")), strict=True):
                row = np.frombuffer(data, "<i4")
                docs += own
                starts += first
                ids += [row[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            kind = batch.schema.field("doc_ids").type.value_type
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, kind), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"]
            )

    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(split, f"doc_id {kind}, start long, ids array<int>")


def write_packed(rows: DataFrame, path: str | None = None) -> str:
    """Write packed rows as Parquet files of 4096 rows (32 MB of ids) at most; returns the folder."""
    path = path or scratch_path(rows.sparkSession, "packed")
    rows.write.option("maxRecordsPerFile", 4096).parquet(path)
    return path
