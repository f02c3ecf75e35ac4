"""Texts whose sets of word shingles are alike: SimHash, then an exact prefix filter; exact Jaccard verification, links of components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.components import components
from tabulon.llm.wordhash import Words, mix, parts_of
from tabulon.session import brief_shuffles, discard, small_batches, staged

SHINGLE = 5
SIMILARITY = 0.8
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PIECE = 1 << 16  # shingles whose bits are held at once
BLOCK = 1 << 21  # bytes of texts whose shingles are held at once; a longer text is not cut
SAMPLE = 16  # one text of so many is counted for the order of shingles, which bears on speed only
COMMON = 3  # texts of the sample that make a shingle common
COMMON_MOST = 1_000_000  # common shingles that are sent with the tasks (9 MB)
SMALL = 12  # candidates of one key up to which all their pairs are compared at once; each round four times as many
ROUNDS = 4  # of comparing larger keys with one candidate each; then all pairs that are left
SALTS = 32
PAIRS_MOST = 2_000_000  # pairs that are broadcast (40 MB)


def shingle_sets(texts: Sequence[bytes], words: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (uint64); no words: none.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space, a text of fewer words is one shingle.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held: list[tuple[int, bytes]] = []

    def shingled(value: np.ndarray, k: int) -> np.ndarray:
        made = np.full(len(value) - k + 1, np.uint64(k))
        for i in range(k):
            made = mix(made) + value[i : i + len(made)]
        return mix(made)

    def add(numbers: list[int], counts: np.ndarray, value: np.ndarray) -> None:
        made = shingled(value, words) if len(value) >= words else value[:0]
        ends = np.cumsum(counts)
        for number, low, high in zip(numbers, (ends - counts).tolist(), ends.tolist(), strict=True):
            if high - low >= words:
                out[number] = np.unique(made[low : high - words + 1])
            elif high > low:
                out[number] = shingled(value[low:high], high - low)

    def flush() -> None:
        if held:
            found = Words(np.frombuffer(b"\n".join(t for _, t in held), np.uint8))
            begin = np.cumsum([0] + [len(t) + 1 for _, t in held[:-1]])
            of = np.searchsorted(begin, found.starts, side="right") - 1
            add([number for number, _ in held], np.bincount(of, minlength=len(held)), found.hashes())
            held.clear()

    size = 0
    for number, text in enumerate(texts):
        text = text.translate(NORMAL)
        if len(text) > wordhash.CHUNK:
            value = np.concatenate([Words(np.frombuffer(part, np.uint8)).hashes() for part in parts_of(text)])
            add([number], np.array([len(value)]), value)
            continue
        if size + len(text) > wordhash.CHUNK:
            flush()
            size = 0
        held.append((number, text))
        size += len(text)
    flush()
    return out


def least_shared(n: np.ndarray | int, similarity: float):
    """The fewest shingles that a set of ``n`` shares with any set of this similarity or more."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64) if isinstance(n, np.ndarray) else int(np.ceil(similarity * n - 1e-9))


def _blocks(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches in parts of about ``BLOCK`` bytes of text; only a part's texts are copied out of Arrow's memory."""
    for batch in batches:
        column = batch.column("text")
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
        low = 0
        while low < len(batch):
            most = (ends[low - 1] if low else 0) + BLOCK
            high = max(low + 1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(low, high - low), [bytes(t.as_buffer()) if t.is_valid else b"" for t in column.slice(low, high - low)]
            low = high


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def simhash(found: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, signed: a bit is set if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(found), PIECE):
        counts += np.unpackbits(found[low : low + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def common_shingles(docs: DataFrame, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts share, and the binary logarithms of how many of a sample do."""

    def run(batches):
        for _, texts in _blocks(batches):
            found = np.concatenate(shingle_sets(texts, words))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    with small_batches(docs.sparkSession):
        counts = staged(sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON), "common-shingles")
    level = F.floor(F.log2("count")).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > COMMON_MOST:
            break
        least = row["level"]
    if least is None:
        discard(counts)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    found = counts.where(level >= least).select("shingle", level.alias("level")).toArrow()
    discard(counts)
    shingle = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], found.column("level").to_numpy().astype(np.uint8)[order]


def prefixes(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (``doc_id``, ``row``, ``text``) as ``doc_id``, ``row``, ``fp``, ``n``, ``print``, ``odd`` and ``keys``, without their texts.

    ``fp`` is a hash of the set of shingles, ``n`` its size, ``print`` its SimHash (null: no shingles) and ``odd`` how many of them are not
    common. Shingles have one order throughout, rare ones first; of two
    sets whose similarity is enough, the first ``n - least_shared(n) + 1`` of each (``keys``) have one in common.
    """
    common, level = common_shingles(docs, words)

    def run(batches):
        for batch, texts in _blocks(batches):
            fps, sizes, prints, odd, keys = [], [], [], [], []
            for found in shingle_sets(texts, words):
                n = len(found)
                fps.append(mix(np.array([mix(found).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))[0] if n else np.uint64(0))
                sizes.append(n)
                prints.append(simhash(found) if n else None)
                odd.append(n)
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    place = np.where(common[at] == found, level[at] + 1, 0)
                    odd[-1] = int((place == 0).sum())
                    found = found[np.argsort(place, kind="stable")]
                keys.append(found[: n - least_shared(n, similarity) + 1] if n else found)
            numbers = [pa.array(np.array(fps, np.uint64).view(np.int64)), *(pa.array(x, pa.int64()) for x in (sizes, prints, odd))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *numbers, _lists(keys)], ["doc_id", "row", "fp", "n", "print", "odd", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row long, fp long, n long, print long, odd long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``fp`` and ``shingles`` (distinct) of the documents whose ``row`` ``wanted`` (``row``, ``fp``, ``copies``) has."""

    def run(batches):
        for batch, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("fp"), _lists(shingle_sets(texts, words))], ["fp", "shingles"])

    if wanted.count() <= 1_000_000:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, "row")
    made = lambda part: part.select("fp", "text").mapInArrow(run, "fp long, shingles array<long>")
    repeated = found.where("copies > 1").groupBy("fp").agg(F.first("text").alias("text"))  # a row that is there more than once
    return made(found.where("copies = 1")).union(made(repeated))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``, and ``salt``, which spreads the pairs of one ``a``) that are as similar as asked.

    Spark compares the two sets of a pair where they are joined, row by row: no Arrow batch holds the sets of thousands of pairs.
    """
    few = F.broadcast if pairs.count() <= PAIRS_MOST else lambda x: x  # then only sets that have pairs are shuffled
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")).join(few(pairs.select("a", "salt").distinct()), "a")
    both = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")).join(few(pairs), "b").join(left, ["a", "salt"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def print_pairs(slim: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``, ``salt``) of sets whose SimHashes ``links`` joins, and of sets with one SimHash: each with one set of its kind only."""
    sets = slim.where("print IS NOT NULL").select("print", "fp").distinct()
    first = sets.groupBy("print").agg(F.min("fp").alias("first"))
    same = sets.join(first, "print").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = links.join(first.select(F.col("print").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("print").alias("b"), F.col("first").alias("y")), "b")
    pairs = same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    return pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))


def alike_components(docs: DataFrame, nodes: DataFrame, slim: DataFrame, links: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``node`` and ``component`` of the sets (``fp`` in ``slim``) that pairs of the wanted similarity connect.

    ``nodes`` has a ``row`` of ``docs`` for each ``fp``. First come the pairs whose SimHashes ``links`` (``a``, ``b``) joins. Fingerprints miss
    pairs, so then sets that share a key are candidates. All pairs of a key with few sets are compared by their shingles. In a key with
    many, each round compares one set with all others and is done with it. It is drawn by properties of the set alone, so that the many
    keys of a group of near copies draw the same one and the pairs do not grow with the keys: that with the fewest shingles of its own,
    as the text that a group's others are copies of. It connects most of them, and the others differ from it by so many rare shingles
    that the sizes rule out most pairs. Pairs that are connected already need no comparison, so few rounds connect a large group.
    """
    copies = slim.groupBy("row").agg(F.count("*").alias("copies"))

    def sets_of(fps: DataFrame, label: str) -> DataFrame:
        with small_batches(docs.sparkSession):
            return staged(_sets(docs, fps.join(nodes, "fp").join(copies, "row"), words), label)

    pairs = staged(print_pairs(slim, links), "shingle-pairs")
    had = sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), "simhash-sets")
    member = components(_alike(pairs, had, similarity))
    discard(pairs)
    keyed = slim.select(F.posexplode("keys").alias("at", "key"), "fp", "n", "odd").withColumn("rest", F.col("n") - F.col("at")).drop("at")
    keyed = keyed.select("key", F.struct("fp", "n", "rest", "odd").alias("set")).repartition("key")  # shuffled once for both uses
    shared = keyed.groupBy("key").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least < most").select("key")
    left = read = staged(keyed.join(shared, "key").select("key", "set.*").distinct(), "shingle-keys")
    rest = sets = None
    for turn in range(ROUNDS + 1):
        grouped = left.join(member, left["fp"] == member["node"], "left").select("key", "fp", "n", "rest", "odd", F.coalesce("component", "fp").alias("c"))
        heads = grouped.groupBy("key").agg(
            F.min(F.struct("odd", F.xxhash64("fp").alias("draw"), "fp", "n", "rest", "c")).alias("head"), F.count("*").alias("size"), F.min("c").alias("least"), F.max("c").alias("most")
        )
        heads = heads.where("least < most").select("key", "head", (F.col("size") <= SMALL * 4**turn if turn < ROUNDS else F.lit(True)).alias("small"))
        judged = staged(grouped.join(heads, "key"), "shingle-candidates")
        discard(read)
        read = judged

        def near(n, m, n_rest, m_rest):
            """Sizes let two sets be alike, and so do the shingles from the key on (it may be the first they share)."""
            shared = F.least(n_rest, m_rest) >= similarity / (1 + similarity) * (n + m) - 1e-9
            return shared & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9)

        star = judged.where((~F.col("small")) & (F.col("c") != F.col("head.c")) & near(F.col("n"), F.col("head.n"), F.col("rest"), F.col("head.rest")))
        star = star.select(F.col("head.fp").alias("a"), F.col("fp").alias("b"), F.pmod(F.hash("fp"), F.lit(SALTS)).alias("salt"))
        few = judged.where("small").select("key", "fp", "n", "rest", "c")
        other = few.select("key", *(F.col(x).alias(f"{x}2") for x in ("fp", "n", "rest", "c")))
        each = few.join(other, "key").where((F.col("fp") < F.col("fp2")) & (F.col("c") != F.col("c2")) & near(F.col("n"), F.col("n2"), F.col("rest"), F.col("rest2")))
        each = each.select(F.col("fp").alias("a"), F.col("fp2").alias("b"), F.pmod(F.hash("fp2"), F.lit(SALTS)).alias("salt"))
        pairs = staged(star.union(each).distinct(), "shingle-pairs")
        if sets is None:
            fps = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(judged.where("NOT small").select("fp")).distinct()
            rest = sets_of(fps.join(had, "fp", "left_anti"), "shingle-sets")
            sets = had.union(rest)
        if not pairs.isEmpty():
            known = member.select(F.col("node").alias("a"), F.col("component").alias("b"))
            last, member = member, components(known.union(_alike(pairs, sets, similarity)))
            discard(last)
        discard(pairs)
        left = judged.where((~F.col("small")) & (F.col("fp") != F.col("head.fp"))).select("key", "fp", "n", "rest", "odd")
        if left.isEmpty():
            break
    discard(read, had, rest)
    return member
