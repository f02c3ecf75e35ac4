"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import shingles
from tabulon.llm.components import components
from tabulon.llm.ordering import unique_name
from tabulon.llm.wordhash import parts_of
from tabulon.session import brief_shuffles, discard, small_batches, staged

BITS = 64
SEED = 42
DISTANCE = 4
SHINGLE = 4
BROADCAST_ROWS = 2_000_000  # hashes of documents (32 MB); more are joined by a shuffle
PIECE = 1 << 16  # shingles whose hashes are held at once

NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, unsigned; no words: 0.

    A-Z are lower-cased, words are runs of characters other than ASCII white space, a text of fewer words
    is one shingle. A bit is set if it is set in over half of the shingles' XXH64 hashes (repeats count).
    """
    digest, counts, shingles = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0

    def add(tokens: list[bytes], k: int) -> None:
        nonlocal counts, shingles
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        begin, end = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
        for low in range(0, len(begin), PIECE):
            hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begin[low : low + PIECE], end[low : low + PIECE], strict=True)], np.uint64)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        shingles += len(begin)

    held: list[bytes] = []  # a long text comes in parts; the last words of one begin the next
    for part in parts_of((text or "").encode("utf-8", "surrogatepass").translate(NORMAL)):
        held += part.split()
        if len(held) >= words:
            add(held, words)
            held = held[len(held) - words + 1 :]
    if not shingles:
        if not held:
            return 0
        add(held, len(held))
    set_bits = np.flatnonzero(2 * counts > shingles).tolist()
    return sum(1 << b for b in set_bits)


def fingerprint(text: Column) -> Column:
    """``fingerprint_of`` as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in texts], dtype="uint64").astype("int64")

    return prints(text)


def block_count(fingerprints: int, distance: int = DISTANCE) -> int:
    """Into how many blocks to cut fingerprints: the fewest that leave about 8 by chance under one key at most.

    Any number above ``distance`` finds the same pairs; more blocks mean more keys, each of which is more selective.
    """
    blocks = distance + 2
    while blocks < 12 and fingerprints > 8 * 2 ** (BITS * (blocks - distance) / blocks):
        blocks += 1
    return blocks


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks: fingerprints within ``distance`` agree in one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(single, blocks - distance)]


def linked_within(prints: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever pairs within ``distance`` connect among ``prints`` (distinct, uint64).

    Fingerprints within half the distance of a pivot form a ball: its members are linked to the pivot. Balls whose
    pivots are near are linked; only balls not connected so far are compared member by member. Memory is a
    few arrays of the length of ``prints``, and no more links come out than there are fingerprints and balls.
    """
    n, half = len(prints), distance // 2
    ball = np.full(n, -1)
    pivots: list[int] = []
    members: list[np.ndarray] = []
    left = np.arange(n)
    while len(left):
        near = np.bitwise_count(prints[left] ^ prints[left[0]]) <= half
        got = left[near]
        ball[got] = len(pivots)
        pivots.append(int(left[0]))
        members.append(got)
        left = left[~near]
    parent = list(range(len(pivots)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for got in members:
        if len(got) > 1:
            yield prints[np.full(len(got) - 1, got[0])], prints[got[1:]]
    centre = prints[pivots]
    for i in range(1, len(pivots)):
        apart = np.bitwise_count(centre[:i] ^ centre[i])
        for j in np.flatnonzero(apart <= distance).tolist():
            if root(i) != root(j):
                parent[root(i)] = root(j)
                yield centre[i : i + 1], centre[j : j + 1]
    for i in range(1, len(pivots)):
        apart = np.bitwise_count(centre[:i] ^ centre[i])
        for j in np.flatnonzero((apart > distance) & (apart <= distance + 2 * half)).tolist():
            if root(i) == root(j):
                continue
            small, large = sorted((members[i], members[j]), key=len)
            for x in small.tolist():
                hit = np.flatnonzero(np.bitwise_count(prints[large] ^ prints[x]) <= distance)
                if len(hit):
                    parent[root(i)] = root(j)
                    yield prints[x : x + 1], prints[large[hit[:1]]]
                    break


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` (longs) that join all fingerprints within ``distance`` into components.

    ``prints`` has distinct longs ``fp``. Each goes out under one key for each choice of blocks; fingerprints of one key
    are sorted together and compared. Not all pairs come out, but enough to connect all that are connected.
    """
    blocks = blocks or block_count(prints.count(), distance)
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(blocks, distance)]
    keyed = prints.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("choice", "part")
    ).select("fp", F.xxhash64("choice", "part").alias("key"))
    together = keyed.repartition("key").sortWithinPartitions("key")

    def compare(batches):
        key = None
        held: list[np.ndarray] = []

        def found(parts):
            unique = np.unique(np.concatenate(parts))
            if len(unique) > 1:
                for a, b in linked_within(unique, distance):
                    yield a.view(np.int64), b.view(np.int64)

        def out(pairs):
            pairs = list(pairs)
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            pairs = []
            if key is not None and keys[0] == key:
                held.append(values[: ends[0]].copy())
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if held:
                    pairs.extend(found(held))
                key, held = keys[-1], [values[starts[-1] :].copy()]
                sizes = (ends - starts)[:-1]
                two = starts[:-1][sizes == 2]  # most groups by far
                near = np.bitwise_count(values[two] ^ values[two + 1]) <= distance
                pairs.append((values[two[near]].view(np.int64), values[two[near] + 1].view(np.int64)))
                for i in np.flatnonzero(sizes > 2).tolist():
                    pairs.extend(found([values[starts[i] : ends[i]]]))
            yield from out(pairs)
        if held:
            yield from out(found(held))

    return together.mapInArrow(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, distance: int = DISTANCE, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) plus ``fp``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints link at ``distance`` differing bits or fewer; ``component_id`` is the smallest doc_id reachable (null only
    if a whole component has none). Copies share one fingerprint, so only distinct ones are compared, and
    a group of copies of any size is one of them. Texts without words (null or empty) have fingerprint
    zero and are linked like any other. ``keep`` names the columns to carry along (all of them if None);
    own columns of the new names are replaced; an empty table gives no rows.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("fp", "fingerprint", "component_id")]
    made = docs.select(*(F.col(f"`{c}`") for c in carried), F.col("doc_id").alias("__id"), fingerprint(F.col("text")).alias("fp"))
    rows = staged(made, "simhash")
    nodes = staged(rows.groupBy("fp").agg(F.min("__id").alias("least")), "simhash-nodes")
    member = components(links(nodes.select("fp"), distance))
    grouped = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    grouped = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    joined = rows.join(grouped.select("fp", "component_id"), "fp")
    return joined.select(*(F.col(f"`{c}`") for c in carried), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = shingles.SHINGLE, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id; columns as in ``docs``.

    Texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more are linked, and groups are what
    links connect; texts without words are one group. Candidates are texts whose SimHashes (of those shingles) link at ``DISTANCE``
    bits; these would miss most such pairs, so the exact prefix filter of ``shingles`` adds those that they have not connected.

    Rows are known by a hash of doc_id and text; of rows equal in both, that with the smallest JSON form stays. Texts are
    neither shuffled nor written, as long as the hashes of the documents that go fit a broadcast (``BROADCAST_ROWS``).
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    with brief_shuffles(docs.sparkSession):
        judged = _judged(docs.select("doc_id", key.alias("row"), "text"), words, similarity)
        if judged.count() <= BROADCAST_ROWS:
            judged = F.broadcast(judged)
    name = unique_name(docs, "row")
    marked = docs.withColumn(name, key).join(judged.withColumnsRenamed({"row": "__row", "copies": "__copies", "stays": "__stays"}), F.col(name) == F.col("__row"), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.where("__row IS NULL").select(*own)
    repeated = marked.where("__stays").select(name, F.struct(*own).alias("document"))
    once = repeated.groupBy(name).agg(F.min_by("document", F.to_json("document")).alias("document"))
    return single.unionByName(once.select("document.*"))


def _judged(keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """``row``, ``copies`` and ``stays`` (null: goes) of the ``keyed`` documents that go or are there more than once, as a staged table."""
    with small_batches(keyed.sparkSession):
        slim = staged(shingles.prefixes(keyed, words, similarity), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = staged(slim.groupBy("fp").agg(first.alias("first")), "shingle-nodes")
    near = staged(links(slim.select(F.col("print").alias("fp")).where("fp IS NOT NULL").distinct()), "simhash-links")
    member = shingles.alike_components(keyed, nodes.select("fp", "first.row"), slim, near, words, similarity)
    discard(near)
    grouped = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    keepers = grouped.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    counted = slim.groupBy("row").agg(F.count("*").alias("copies")).join(keepers, "row", "left")
    judged = staged(counted.where("stays IS NULL OR copies > 1"), "simhash-judged")  # the others stay as they are
    discard(slim, nodes, member)
    return judged
