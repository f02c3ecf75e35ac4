"""Perplexity bands: a modified Kneser-Ney model of character trigrams, counted by Spark, in sorted arrays of keys.

Every code point is a symbol of its own (21 bits of a key, which is so a hash without collisions), so a model grows with what the corpus holds.
Models of up to ``MODEL_MOST`` trigrams together are sent with the tasks that score. Larger ones stay a table, sorted and cut by
ranges of keys, and meet the trigrams of each document, counted beforehand, in a join. Both give the same values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.wordhash import SPACE, encoded, parts_of, slices
from tabulon.session import staged

BITS = 21
LEAST_DOCS = 2  # documents that hold a trigram, else it is as good as unseen: no text vouches for itself
MODEL_MOST = 2_000_000  # trigrams that are sent with the tasks (some 60 MB)
LOWER_DEVIATIONS, UPPER_DEVIATIONS = 6.0, 5.0
LEAST_DEVIATION = 0.01
SYMBOL_MARKS = frozenset(b"#*$%&|<>")
_marks = np.isin(np.arange(256), list(SYMBOL_MARKS))
KEY_LIMIT = 1 << 20  # keys that a task gathers before it counts them

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def characters(text: str | None) -> np.ndarray:
    """Code points of a text with runs of ASCII white space as one space, one before and one after all; no words: empty."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    if gap.all():
        return np.zeros(0, np.uint32)
    points = np.r_[32, np.where(gap, 32, points), 32]
    gap = points == 32
    return points[np.r_[True, ~(gap[1:] & gap[:-1])]].astype(np.uint32)


def runs(text: str | None) -> Iterator[np.ndarray]:
    """The code points of ``characters`` in parts, each after the two before it: all trigrams, each once; a long text is not held at once."""
    before = None
    for part in parts_of((text or "").encode("utf-8", "surrogatepass")):
        points = characters(part.decode("utf-8", "surrogatepass"))
        if len(points):
            yield np.r_[points[:1] if before is None else before, points if before is None else points[1:]]
            before = points[-2:]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of a whole text; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = encoded([text])[0]
    chars = symbols = 0
    hashes = [np.zeros(0, np.uint64)]
    for words, _ in slices([raw]):
        data = words.data
        hashes.append(words.hashes())
        chars += int(np.count_nonzero((~SPACE[data]) & ((data & 0xC0) != 0x80)))
        symbols += int(np.count_nonzero(_marks[data]))
    h = np.concatenate(hashes)
    n = len(h)
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated_lines += 1
        elif line.strip(b" \t\x0b\x0c\r"):
            seen.add(line)
    repeats = 0
    if n >= 4:
        c = np.uint64(0xD6E8FEB86659FD93)
        three = (h[:-2] * c + h[1:-1]) * c + h[2:]
        _, back, count = np.unique(three, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    return n, chars, symbols, repeated_lines, repeats


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``key`` (three code points), ``n`` and ``docs`` (how many documents hold it): all character trigrams of all texts, summed in tasks first."""

    def count(batches):
        held: dict[str | None, list] = {}
        fresh = 0

        def summed(parts):
            keys, amounts, holders = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, back = np.unique(keys, return_inverse=True)
            return unique, *(np.bincount(back, x, len(unique)).astype(np.int64) for x in (amounts, holders))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                parts = [np.unique(keys_of(run), return_counts=True) for run in runs(text.as_py())]
                if len(parts) > 1:  # a long text in parts is one document
                    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    parts = [(keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64))]
                for keys, n in parts:
                    held.setdefault(lang, []).append((keys, n, np.ones(len(keys), np.int64)))
                    fresh += len(keys)
                if fresh > KEY_LIMIT:
                    held = {k: [summed(v)] for k, v in held.items()}
                    fresh = 0
        for lang, parts in held.items():
            arrays = summed(parts)
            for low in range(0, len(arrays[0]), 50_000):
                part = [pa.array(x[low : low + 50_000]) for x in arrays]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part], ["lang", "key", "n", "docs"])

    found = docs.select("lang", "text").mapInArrow(count, "lang string, key long, n long, docs long")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from counts of counts, kept between 0 and the count they are taken from."""
    n = [max(1, int(np.count_nonzero(counts == k))) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))])


class Level:
    """One order: a sorted array of n-gram keys with their probabilities, and one of histories with their back-off weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lower: Level | None, base: float):
        d = discounts(counts)
        off = d[np.minimum(counts, 3)]
        history = keys >> BITS
        self.histories, back = np.unique(history, return_inverse=True)
        total = np.bincount(back, counts, len(self.histories))
        self.rest = np.bincount(back, off, len(self.histories)) / total
        below = lower.probability(keys & ((1 << (BITS * lower.order)) - 1)) if lower else np.full(len(keys), base)
        self.order, self.lower, self.base = (lower.order + 1 if lower else 1), lower, base
        self.keys, self.p = keys, (counts - off) / total[back] + self.rest[back] * below

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of the last symbol of each key; unseen ones by the lower order and the history's weight."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out, unseen = self.p[at], self.keys[at] != keys
        if unseen.any():
            missing = keys[unseen]
            below = self.lower.probability(missing & ((1 << (BITS * self.lower.order)) - 1)) if self.lower else np.full(len(missing), self.base)
            history = missing >> BITS
            h = np.minimum(np.searchsorted(self.histories, history), len(self.histories) - 1)
            out = out.copy()
            out[unseen] = np.where(self.histories[h] == history, self.rest[h], 1.0) * below
        return out


class Model:
    """The model of one language from its trigrams' keys (sorted) and counts: the levels of the orders 1 to 3."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        two, n_two = np.unique(keys & ((1 << 2 * BITS) - 1), return_counts=True)
        one, n_one = np.unique(two & ((1 << BITS) - 1), return_counts=True)
        base = 1 / (len(one) + 1)  # any other character
        self.top = Level(keys, counts, Level(two, n_two, Level(one, n_one, None, base), base), base)

    def entropy(self, text: str | None) -> float:
        """The mean of -log p over a text's symbols, the log of its perplexity; without words: 0."""
        total, n = 0.0, 0
        for run in runs(text):
            total -= float(np.log(self.top.probability(keys_of(run))).sum())
            n += len(run) - 2
        return total / n if n else 0.0


def keys_of(run: np.ndarray) -> np.ndarray:
    p = run.astype(np.int64)
    return (p[:-2] << 2 * BITS) | (p[1:-1] << BITS) | p[2:]


def models(counts: DataFrame) -> dict[str | None, Model]:
    """A model per language, from counts that are few enough to be gathered (``MODEL_MOST``)."""
    table = counts.select("lang", "key", "n").toArrow()
    codes = table.column("lang").combine_chunks().dictionary_encode(null_encoding="encode")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    key, n, code = table.column("key").to_numpy(), table.column("n").to_numpy(), codes.indices.to_numpy()
    order = np.lexsort((key, code))
    edges = np.searchsorted(code[order], np.arange(len(codes.dictionary) + 1))
    parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return {lang: Model(key[part], n[part]) for lang, part in zip(codes.dictionary.to_pylist(), parts, strict=True)}


def surprisals(kept: DataFrame, every: DataFrame) -> DataFrame:
    """``lang``, ``key`` and ``nll``: -log p of each trigram of ``every`` by the model of ``kept`` (both as ``trigram_counts``), as ``Model`` gives it.

    Orders are joined: a trigram, bigram or character that ``kept`` lacks takes its history's weight times the lower order.
    """

    def level(grams: DataFrame, history: str, n: str, names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
        """Grams with their share after the discount, and per history the weight of what the discounts leave."""
        share, rest = names
        of = grams.groupBy("lang").agg(*[F.greatest(F.lit(1), F.count_if(F.col(n) == k)).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        held = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)]
        of = of.select(F.col("lang").alias("own"), *held)
        off = F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = grams.join(of, F.col("lang").eqNullSafe(F.col("own"))).withColumn("off", off).drop("own", "d1", "d2", "d3")
        after = cut.groupBy("lang", history).agg(F.sum(n).alias("total"), (F.sum("off") / F.sum(n)).alias(rest))
        shares = met(cut, after.select("lang", history, "total"), history).withColumn(share, (F.col(n) - F.col("off")) / F.col("total"))
        return shares.drop("off", "total"), after.drop("total")

    def met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        other = right.withColumnsRenamed({"lang": "own", key: "own_key"})
        return left.join(other, F.col("lang").eqNullSafe(F.col("own")) & (F.col(key) == F.col("own_key")), "left").drop("own", "own_key")

    low = lambda c, orders: F.col(c).bitwiseAND(F.lit((1 << orders * BITS) - 1))
    parts = {"ab": F.shiftright("key", BITS), "bc": low("key", 2)}
    inner = {"b": F.shiftright("bc", BITS), "c": low("bc", 1)}
    three = kept.select("lang", "key", "n", *[e.alias(c) for c, e in parts.items()])
    two = three.groupBy("lang", "bc").agg(F.count("*").alias("n2")).withColumns(inner)
    one = two.groupBy("lang", "c").agg(F.count("*").alias("n1")).withColumn("all", F.lit(0))
    size = one.groupBy("lang", "all").agg((1 / (F.count("*") + 1)).alias("base"))
    one, rest1 = level(one, "all", "n1", ("s1", "rest1"))
    two, rest2 = level(two, "b", "n2", ("s2", "rest2"))
    three, rest3 = level(three, "ab", "n", ("s3", "rest3"))

    below = lambda share, rest, p: F.coalesce(F.col(share), F.lit(0.0)) + F.coalesce(F.col(rest), F.lit(1.0)) * p
    # Lower orders are worked out once for each bigram there is, then for each trigram.
    pairs = every.select("lang", low("key", 2).alias("bc")).distinct().withColumns({**inner, "all": F.lit(0)})
    pairs = met(met(met(pairs, size, "all"), rest1, "all"), one.select("lang", "c", "s1"), "c")
    pairs = met(met(pairs, rest2, "b"), two.select("lang", "bc", "s2"), "bc")
    p1 = below("s1", "rest1", F.coalesce("base", F.lit(1.0)))
    pairs = pairs.select("lang", "bc", below("s2", "rest2", p1).alias("p2"))
    found = every.select("lang", "key", *[e.alias(c) for c, e in parts.items()])
    found = met(met(met(found, pairs, "bc"), rest3, "ab"), three.select("lang", "key", "s3"), "key")
    return found.select("lang", "key", (-F.log(below("s3", "rest3", F.col("p2")))).alias("nll"))


def joined_entropies(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``row`` (a hash of language and text) and ``entropy`` of every text with words, by a join of its trigrams with a table of ``surprisals``."""

    def grams(batches):
        for batch in batches:
            for row, lang, text in zip(batch.column("row").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for run in runs(text.as_py()):  # a long text in parts
                    keys, n = np.unique(keys_of(run), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["row", "lang", "key", "n"])

    each = docs.select(F.xxhash64("lang", "text").alias("row"), "lang", "text").mapInArrow(grams, "row long, lang string, key long, n long")
    other = table.withColumnsRenamed({"lang": "own", "key": "own_key"})
    both = each.join(other, F.col("lang").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key")))
    # Copies of a text add to both sums alike.
    return both.groupBy("row").agg((F.sum(F.col("n") * F.col("nll")) / F.sum("n")).alias("entropy"))


def scored(docs: DataFrame, by_language: dict[str | None, Model], keep: Sequence[str]) -> DataFrame:
    """``keep`` plus ``lang``, the base counts and ``entropy`` of every document."""
    names = [*keep, *(c for c in ("lang", "row") if c in docs.columns and c not in keep)]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", {BASE_SCHEMA}, entropy double"

    def score(batches: Iterator[pa.RecordBatch]):
        known = by_language
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
                counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
                entropy = [known[k].entropy(t) if k in known else 0.0 for t, k in zip(texts, langs, strict=True)]  # all 0 where a join tells
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), *(pa.array(counts[:, k]) for k in range(5)), pa.array(entropy, pa.float64())],
                    [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "entropy"],
                )

    return docs.select(*names, "text").mapInArrow(score, schema)


def perplexity_rules(docs: DataFrame, lower: float = LOWER_DEVIATIONS, upper: float = UPPER_DEVIATIONS) -> DataFrame:
    """Base counts and verdict for every document: ``doc_id``, the counts, ``base_failed``, ``perplexity``, ``kept``.

    Trigrams that one document alone holds (or several parts of one) count as unseen. A document that passes the base rules (50 words or more, half of its words or fewer in repeated runs) is kept if its log
    perplexity lies within the band of its language: from ``lower`` deviations below the median to ``upper`` above, where
    a deviation is 1.4826 times the median distance from the median of the documents that pass (``LEAST_DEVIATION`` at least).
    A null language is a language of its own; null and empty texts have no words and fail; repeated rows get equal results;
    an empty table gives no rows.
    """
    grams = staged(trigram_counts(docs), "trigrams")
    kept = grams.where(F.col("docs") >= LEAST_DOCS)
    if kept.count() <= MODEL_MOST:
        rows = staged(scored(docs, models(kept), ["doc_id"]), "perplexity")
    else:
        table = staged(surprisals(kept, grams).repartitionByRange("lang", "key").sortWithinPartitions("lang", "key"), "surprisals")
        found = joined_entropies(docs, table)
        marked = docs.select("doc_id", "lang", "text", F.xxhash64("lang", "text").alias("row"))
        rows = scored(marked, {}, ["doc_id"]).drop("entropy").join(found, "row", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))
        rows = staged(rows.drop("row"), "perplexity")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed)
    passing = judged.where("NOT base_failed")
    middle = passing.groupBy("lang").agg(F.percentile_approx("entropy", 0.5, 10_000).alias("middle"))
    middle = middle.withColumnRenamed("lang", "own")  # one row per language
    near = F.col("lang").eqNullSafe(F.col("own"))
    spread = passing.join(middle, near).groupBy("own", "middle")
    spread = spread.agg((1.4826 * F.percentile_approx(F.abs(F.col("entropy") - F.col("middle")), 0.5, 10_000)).alias("deviation"))
    bands = spread.withColumn("deviation", F.greatest(F.col("deviation"), F.lit(LEAST_DEVIATION)))
    away = (F.col("entropy") - F.col("middle")) / F.col("deviation")
    inside = F.coalesce((away >= -lower) & (away <= upper), F.lit(True))
    return (
        judged.join(bands, near, "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.exp("entropy").alias("perplexity"), (~F.col("base_failed") & inside).alias("kept"),
        )
    )
