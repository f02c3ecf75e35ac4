"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.wordhash import BYTE_CODES, SPACE, Words, encoded, mix, powers, slices
from tabulon.session import staged

WINDOW = 8
LITERALS = 5  # of the words in a window at least; windows with fewer match word by word only
SHARE = 0.5  # of an item's windows that a document holds, from which on it leaks the item
OVERLAP = 4 * WINDOW
BROADCAST_ROWS = 2_000_000  # hashes of leaking documents (32 MB); more are joined by a shuffle

#: Words that are numbers or units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
).split()
UNIT_WORDS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce "
    "ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent kmh mph hz khz mhz ghz kb mb gb tb w kw "
    "kwh v volt volts meter meters metre metres degree degrees celsius fahrenheit"
).split()

_kept = np.zeros(256, bool)  # letters, digits, and all bytes beyond ASCII
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _kept[_a:_b] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_digit = np.zeros(256, bool)
_digit[48:58] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_stop = np.isin(np.arange(256), list(b".!?:;"))
NUMBER, UNIT, NAME = (mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))


def _spelled(words: Sequence[str]) -> np.ndarray:
    found = Words(np.frombuffer(" ".join(words).encode(), np.uint8))
    return np.sort(_tokens(found, np.zeros(len(found.starts), int))[1])


def _tokens(words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' numbers, hashes of lower-cased words without punctuation, and which are digits, digits with a unit, capitalised."""
    data = words.data
    keep = _kept[data[words.at]]
    at = words.at[keep]
    per_word = np.add.reduceat(keep.astype(np.int64), words.first) if len(words.first) else np.zeros(0, np.int64)
    has = per_word > 0
    size = per_word[has]
    first = np.cumsum(size) - size
    value = _lower[data[at]]
    # A capital letter of Latin-1 in UTF-8 is 0xC3 and a byte from 0x80 to 0x9E other than the multiplication sign.
    before = np.r_[np.uint8(0), data[at][:-1]]
    latin = (before == 0xC3) & (data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)
    value = np.where(latin, data[at] + 32, value).astype(np.uint8)
    inside = np.arange(len(at)) - np.repeat(first, size)
    coded = BYTE_CODES[value] * powers(int(size.max()) if len(size) else 1)[inside]
    if not len(first):
        none = np.zeros(0, bool)
        return of[:0], np.zeros(0, np.uint64), none, none, none
    hashes = mix(np.add.reduceat(coded, first))
    digit = _digit[data[at]]
    digits = np.add.reduceat(digit.astype(np.int64), first)
    number = digits == size
    # Digits first, then letters: a number with its unit, when those letters are a unit.
    leading = np.add.reduceat((digit & (np.cumsum(~digit) - np.repeat(np.cumsum(~digit)[first] - ~digit[first], size) == 0)).astype(np.int64), first)
    mixed = (leading > 0) & (leading < size) & (leading == digits)
    starts = words.starts[has]
    lead = data[at[first]]
    second = data[np.minimum(at[first] + 1, len(data) - 1)]
    capital = _upper[lead] | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    ends = words.starts + words.lengths - 1
    stopped = np.r_[True, _stop[data[ends[:-1]]] | (of[1:] != of[:-1])][has]
    newline = np.r_[True, data[starts[1:] - 1] == 10]
    return of[has], hashes, number, mixed, capital & ~stopped & ~newline


NUMBER_HASHES, UNIT_HASHES = _spelled(NUMBER_WORDS), _spelled(UNIT_WORDS)


def windows(texts: Sequence[bytes], sizes: Sequence[int] = (WINDOW,)) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of canonical words: text number, place, size, hash, and the slots' values (0 where a word stands for itself).

    Numbers, names (capitalised words inside a sentence) and units become placeholders; windows with too few other words
    stay as they are.
    """
    base = 0
    for words, number_of in slices(texts, OVERLAP):
        of, value, number, mixed, name = _tokens(words, number_of)
        number = number | mixed | np.isin(value, NUMBER_HASHES)
        unit = np.isin(value, UNIT_HASHES) & ~number
        name = name & ~number & ~unit
        slot = number | unit | name
        token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
        for size in sizes:
            n = len(of) - size + 1
            if n <= 0:
                continue
            literals = np.convolve(~slot, np.ones(size, np.int64), "valid") if n else np.zeros(0)
            strong = literals * WINDOW >= LITERALS * size
            typed, plain = np.full(n, np.uint64(size)), np.full(n, np.uint64(size + 1000))
            for k in range(size):
                typed = mix(typed) + token[k : n + k]
                plain = mix(plain) + value[k : n + k]
            hashes = np.where(strong, typed, plain)
            whole = np.flatnonzero(of[:n] == of[size - 1 :])

            def slots(chosen, size=size, strong=strong, slot=slot, value=value):
                at = chosen[:, None] + np.arange(size)
                return np.where(slot[at] & strong[chosen][:, None], value[at], np.uint64(0))

            yield of, whole + base, whole, size, hashes, slots
        base += len(of) + 1


class Filter:
    """A bitmap of the benchmark's window hashes, of bounded size: no window of the benchmark is missed, few others pass."""

    MOST = 1 << 28  # bits: 32 MB

    def __init__(self, hashes: np.ndarray, expected: int):
        bits = 1 << 20
        while bits < 64 * expected and bits < self.MOST:
            bits *= 2
        self.mask = np.uint64(bits - 1)
        self.table = np.zeros(bits // 8, np.uint8)
        self.add(hashes)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes & self.mask
        np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _window_rows(key: str, kind: str, keep=None, sizes=None):
    """A task's function from batches of (``key``, text) to rows of windows that pass the filter ``keep``.

    Without ``sizes`` a text's windows have ``WINDOW`` words, or all its words if it has fewer.
    """

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                texts = encoded(batch.column("text"))
                wanted = sizes or tuple(range(1, WINDOW + 1))
                if not sizes:
                    counts = np.array([sum(bool(_kept[np.frombuffer(w, np.uint8)].any()) for w in t.split()) for t in texts])
                for of, place, at, size, hashes, slots in windows(texts, wanted):
                    good = np.ones(len(at), bool) if keep is None else keep.passes(hashes[at])
                    if not sizes:
                        good &= np.minimum(counts[of[at]], WINDOW) == size
                    at, place = at[good], place[good]
                    if not len(at):
                        continue
                    ids = batch.column(key).take(pa.array(of[at]))
                    held = slots(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(place.astype(np.int64)),
                            pa.array(hashes[at].view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, size, dtype=np.int32)), pa.array(held.ravel().view(np.int64))),
                        ],
                        [key, "place", "hash", "slots"],
                    )

    return run, f"{key} {kind}, place long, hash long, slots array<long>"


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers, names or units.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``. One row for each document and item of
    which it holds ``share`` of the windows or more: ``doc_id``, ``row_key`` (a hash of doc_id and text, equal for
    repeated rows, which give one result), ``item_id``, ``windows`` found, ``item_windows``, ``share`` and ``changed_slots``
    (slots whose value is another one). Windows count only where a run of them replaces each value by one value
    throughout. Null and empty texts on either side match nothing; of several texts of one item the best match counts.
    """
    item = F.struct("item_id", F.xxhash64("text").alias("text_key")).alias("item")
    items = benchmark.where("text IS NOT NULL").select(item, "text").distinct()
    run, kind = _window_rows("item", items.schema["item"].dataType.simpleString())
    indexed = staged(items.mapInArrow(run, kind), "benchmark-windows")
    sizes = tuple(sorted(r[0] for r in indexed.select(F.size("slots")).distinct().collect()))  # 1 to WINDOW
    if not sizes:
        sizes = (WINDOW,)
    hashes = indexed.select("hash").distinct()
    wanted = Filter(np.zeros(0, np.uint64), hashes.count())
    for part in _parts(hashes):
        wanted.add(part)
    keyed = docs.where("text IS NOT NULL").select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row_key")).alias("doc"), "text")
    run, kind = _window_rows("doc", keyed.schema["doc"].dataType.simpleString(), wanted, sizes)
    found = keyed.mapInArrow(run, kind)
    totals = indexed.groupBy("item").agg(F.countDistinct("place").alias("item_windows"))
    item = indexed.select("item", F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots"))
    pairs = found.join(item, "hash").withColumn("shift", F.col("place") - F.col("item_place"))
    # Within one run of windows (one shift) each of the item's values must have become one value.
    both = F.expr("filter(arrays_zip(item_slots, slots), x -> x.item_slots <> 0)")
    runs = pairs.groupBy("doc", "item", "shift").agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_list(both))).alias("values")
    )
    consistent = runs.where(F.size("values") == F.size(F.array_distinct(F.transform("values", lambda x: x["item_slots"]))))
    changed = F.size(F.filter("values", lambda x: x["item_slots"] != x["slots"]))
    per_item = consistent.withColumn("changed", changed).groupBy("doc", "item")
    per_item = per_item.agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("windows"), F.max("changed").alias("changed_slots"))
    judged = per_item.join(totals, "item").withColumn("share", F.col("windows") / F.col("item_windows"))
    best = F.max(F.struct("share", "windows", "item_windows", "changed_slots")).alias("best")
    found = judged.where(F.col("share") >= share).groupBy("doc", "item.item_id").agg(best)
    return found.select("doc.doc_id", "doc.row_key", "item_id", "best.windows", "best.item_windows", "best.share", "best.changed_slots")


def _parts(hashes: DataFrame, width: int = 1 << 16) -> Iterator[np.ndarray]:
    """Hashes in parts, one partition at a time on the driver, which keeps a bitmap of bounded size only."""
    part = []
    for row in hashes.toLocalIterator():
        part.append(row[0])
        if len(part) == width:
            yield np.array(part, np.int64).view(np.uint64)
            part = []
    yield np.array(part, np.int64).view(np.uint64)


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they are."""
    found = staged(leaks(docs.select("doc_id", "text"), benchmark, share).select("row_key").distinct(), "leaks")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    own = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.join(found.withColumnRenamed("row_key", "__leak"), own == F.col("__leak"), "left_anti")


__all__ = ["SPACE", "Filter", "clean_documents", "leaks", "windows"]
