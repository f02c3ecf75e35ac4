"""Ranked lexical search: MaxScore whose bounds come from term pairs, over segments of the documents.

1. Documents become segments, one row each: which terms of the queries occur in which of its documents, how often, and
   how long the documents are. Spark counts documents, lengths and document frequencies over all of them.
2. Each segment is indexed: whole-number impacts, the largest impact of every term and, for pairs of terms that follow each other
   in the order of some query, the largest joint impact within the intersection of their lists. The documents at the head of the best
   intersections are scored at once; the k-th best of these scores over all segments is a threshold that k documents reach.
3. Queries run segment by segment. A query's terms are ordered by weight; a bound for the first i of them is the least
   sum of term maxima and pair maxima (the larger of joint and single ones) that covers them. Terms whose bound stays below the threshold bring
   in no document of their own; a segment whose whole bound does is skipped; documents leave as soon as score and
   bound do not reach it. Each task hands on k documents per query.

Queries come in blocks of bounded size, so the words and thresholds sent with the tasks are bounded too. Nothing is cut: every document
and every term of a query counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import staged

BEST = 10
SEGMENT_DOCS = 2048  # below 2^16
SEGMENT_POSTINGS = 400_000
CHUNK = 1 << 20  # bytes of a text that are split into words at once
TOKENS = 1 << 18  # words looked up at once
QUERIES = 1000  # of one block; each block is a pass over the documents
QUERY_TERMS = 500_000  # different words of one block, as far as one query alone has no more
SEED_PAIRS = 3  # intersections of a query whose first documents are scored for the threshold
LEAST = np.iinfo(np.int64).min

#: Bytes of terms stay (A-Z lower-cased), all others part them.
_letters = bytearray(b" " * 128) + bytearray(range(128, 256))
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _letters[_a:_b] = bytes(range(_a, _b)).lower()
LETTERS = bytes(_letters)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of a long one in several lists."""
    text = text.translate(LETTERS)
    low = 0
    while low < len(text):
        high = low + CHUNK
        if high < len(text):
            high = text.find(b" ", high)
            high = len(text) if high < 0 else high
        yield text[low:high].split()
        low = high


@dataclass
class Queries:
    """A block of queries: numbers of their terms, by falling document frequency once that is known, and the pairs of neighbours."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    def weighted(self, weights: np.ndarray) -> tuple[list[np.ndarray], dict[tuple[int, int], int]]:
        ordered, pairs = [], {}
        for own in self.terms:
            own = own[weights[own] > 0]
            own = own[np.lexsort((own, weights[own]))]
            ordered.append(own)
            for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
                pairs.setdefault((a, b), len(pairs))
        return ordered, pairs


def blocks_of(items: DataFrame) -> Iterator[tuple[Queries, list]]:
    """Queries in blocks, each with the ids of its items. Equal rows are one query; the texts pass one by one."""
    queries, ids = Queries({}, []), []
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        words = {w for part in terms_of((row["text"] or "").encode("utf-8", "surrogatepass")) for w in part}
        fresh = sum(w not in queries.vocabulary for w in words)
        if ids and (len(ids) >= QUERIES or len(queries.vocabulary) + fresh > QUERY_TERMS):
            yield queries, ids
            queries, ids = Queries({}, []), []
        queries.terms.append(np.array(sorted(queries.vocabulary.setdefault(w, len(queries.vocabulary)) for w in words), np.int64))
        ids.append(row["item_id"])
    if ids:
        yield queries, ids


class Segment:
    """Postings of a few thousand documents: for each of ``terms`` (ascending) a run of ``docs`` and ``values`` up to its ``ends``."""

    columns = {"ids": np.int64, "missing": np.uint8, "lengths": np.int64, "terms": np.int32, "ends": np.int64, "docs": np.uint16, "values": np.int32}

    def __init__(self, **arrays):
        self.__dict__.update(arrays)
        self.run = {t: (a, b) for t, a, b in zip(self.terms.tolist(), [0, *self.ends.tolist()], self.ends.tolist(), strict=False)}

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Segment:
        return cls(**{c: np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in cls.columns.items()})

    def written(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, c), kind).tobytes() for c, kind in self.columns.items()]

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.run[term]
        return self.docs[a:b], self.values[a:b]


SEGMENT_SCHEMA = ", ".join(f"{c} binary" for c in Segment.columns)


def segments(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) as segments with the frequencies of the terms in ``vocabulary``; every document is in one, also those without terms."""

    def run(batches):
        get = vocabulary.get
        ids: list = []
        lengths: list[int] = []
        tokens: list[bytes] = []
        of: list[tuple[int, int]] = []  # document and number of tokens, as they stand in ``tokens``
        keys, counts, postings = [], [], 0

        def look_up():
            nonlocal postings
            if tokens:
                found = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                doc = np.repeat(np.array([d for d, _ in of], np.int64), [n for _, n in of])
                key, n = np.unique((found << 16 | doc)[found >= 0], return_counts=True)
                keys.append(key)
                counts.append(n)
                postings += len(key)
                tokens.clear()
                of.clear()

        def segment():
            nonlocal postings
            look_up()
            key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)  # a long text was looked up in parts
            value = np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), len(key)).astype(np.int64)
            term, begin = np.unique(key >> 16, return_index=True)
            missing = np.array([i is None for i in ids], np.uint8)
            own = np.array([LEAST if i is None else i for i in ids], np.int64)
            made = Segment(ids=own, missing=missing, lengths=np.array(lengths, np.int64), terms=term, ends=np.r_[begin[1:], len(key)] if len(term) else begin, docs=key & 0xFFFF, values=value)
            keys.clear(), counts.clear(), ids.clear(), lengths.clear()
            postings = 0
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made.written()], list(Segment.columns))

        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for number, text in zip(numbers, batch.column("text"), strict=True):
                n = 0
                for part in terms_of(bytes(text.as_buffer())) if text.is_valid else ():
                    tokens += part
                    of.append((len(ids), len(part)))
                    n += len(part)
                    if len(tokens) >= TOKENS:
                        look_up()
                ids.append(number)
                lengths.append(n)
                if len(ids) >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield segment()
        if ids:
            yield segment()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SEGMENT_SCHEMA)


def statistics(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and for each term of the block the documents that hold it."""

    def run(batches):
        n, total, df = 0, 0, np.zeros(terms, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                s = Segment.read(batch, i)
                n, total = n + int(np.count_nonzero(s.lengths)), total + int(s.lengths.sum())
                df[s.terms] += np.diff(s.ends, prepend=0)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, held]), pa.array(np.r_[n, total, df[held]])], ["key", "value"])

    rows = dict(found.mapInArrow(run, "key long, value long").groupBy("key").agg(F.sum("value")).toArrow().to_pandas().itertuples(index=False, name=None))
    df = np.zeros(terms, np.int64)
    for key, value in rows.items():
        if key >= 0:
            df[key] = value
    return rows.get(-2, 0), rows.get(-1, 0), df


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def saturation(tf: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence counts before its weight: (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 length n) div total."""
    m = 10 + np.array([90 * x * n // total for x in lengths.tolist()] if total >= 1 << 40 else 90 * lengths * n // max(total, 1), np.int64)
    return (10**9 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


class Bounded(Segment):
    """A segment whose ``values`` are saturations; ``weights`` and ``pairs`` are the block's, ``joint`` has a largest joint impact for each pair."""

    def impacts(self, term: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, values = self.of(term)
        return docs, values.astype(np.int64) * weights[term]

    def maxima(self, weights: np.ndarray) -> dict[int, int]:
        if not len(self.terms):
            return {}
        top = np.maximum.reduceat(self.values.astype(np.int64), np.r_[0, self.ends[:-1]]) * weights[self.terms]
        return dict(zip(self.terms.tolist(), top.tolist(), strict=True))

    def intersections(self, pairs: dict[tuple[int, int], int], weights: np.ndarray, best: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """For each pair the largest joint impact in the intersection of its lists (0: empty), and the documents of its ``best`` ones."""
        joint, heads = np.zeros(len(pairs), np.int64), {}
        row = np.zeros(len(self.ids), np.int64)
        last = None
        for (a, b), number in sorted(pairs.items()):
            if a not in self.run or b not in self.run:
                continue
            if a != last:
                if last is not None:
                    row[self.of(last)[0]] = 0
                docs, own = self.impacts(a, weights)
                row[docs] = own
                last = a
            docs, own = self.impacts(b, weights)
            other = row[docs]
            both = other > 0
            if both.any():
                together = (own + other)[both]
                joint[number] = together.max()
                top = np.argpartition(together, len(together) - best)[-best:] if len(together) > best else slice(None)
                heads[number] = docs[both][top]
        return joint, heads

    def scores(self, terms: Sequence[int], docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t in terms:
            if t in self.run:
                out += self.looked_up(t, docs, weights)
        return out

    def looked_up(self, term: int, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The impacts of a term in ``docs`` (0: not there)."""
        held, values = self.of(term)
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, values[at].astype(np.int64) * weights[term], 0)


def prefix_bounds(terms: Sequence[int], maxima: dict[int, int], joint, pairs: dict[tuple[int, int], int] | None) -> list[int]:
    """Bounds for what the first i terms give one document, i = 0, 1, ...: the least sum of term and pair bounds that covers them."""
    bounds = [0]
    for i, t in enumerate(terms):
        most = maxima.get(t, 0)
        bound = bounds[-1] + most
        if i and pairs is not None:
            before = terms[i - 1]
            pair = max(most, maxima.get(before, 0), int(joint[pairs[before, t]]))
            bound = min(bound, bounds[i - 1] + pair)
        bounds.append(bound)
    return bounds


def evaluated(segment: Bounded, terms: Sequence[int], bounds: list[int], threshold: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a segment whose score reaches ``threshold`` (and is above 0), their scores, and how many postings were touched."""
    none = np.zeros(0, np.int64)
    if bounds[-1] < max(threshold, 1):
        return none, none, 0
    first = 0  # the first essential term
    while first < len(terms) and bounds[first + 1] < max(threshold, 1):
        first += 1
    row, touched = np.zeros(len(segment.ids), np.int64), 0
    for t in terms[first:]:
        if t in segment.run:
            docs, own = segment.impacts(t, weights)
            row[docs] += own
            touched += len(docs)
    docs = np.flatnonzero(row)
    score = row[docs]
    for i in reversed(range(first)):
        keep = score + bounds[i + 1] >= threshold
        docs, score = docs[keep], score[keep]
        if not len(docs):
            break
        if terms[i] in segment.run:
            score = score + segment.looked_up(terms[i], docs, weights)
            touched += len(docs)
    keep = score >= max(threshold, 1)
    return docs[keep], score[keep], touched


def search(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` highest-scoring documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` (above 0).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A document's score sums, over the
    item's different terms, weight times saturation (:func:`term_weights`, :func:`saturation`) in whole numbers; equal scores go by
    ascending doc_id (null first). Null texts have no terms; documents and items without terms appear in no result. Repeated rows
    of ``documents`` are several documents, repeated rows of ``items`` are one item; other columns do not matter. An empty table gives no rows.
    """
    kind = items.schema["item_id"].dataType
    doc_kind = documents.schema["doc_id"].dataType
    docs = documents.select("doc_id", "text")
    parts = [_block(docs, queries, ids, kind, best) for queries, ids in blocks_of(items)]
    if not parts:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(doc_kind).alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select("item_id", "rank", F.col("doc_id").cast(doc_kind), "score")


def _block(docs: DataFrame, queries: Queries, ids: list, kind, best: int) -> DataFrame:
    spark = docs.sparkSession
    found = staged(segments(docs, queries.vocabulary), "search-segments")
    n, total, df = statistics(found, len(queries.vocabulary))
    weights = term_weights(n, df)
    ordered, pairs = queries.weighted(weights)

    def index(batches):
        for batch in batches:
            for i in range(len(batch)):
                s = Segment.read(batch, i)
                s.values = saturation(s.values, s.lengths[s.docs], n, total)
                bounded = Bounded(**{c: getattr(s, c) for c in Segment.columns})
                joint, heads = bounded.intersections(pairs, weights, best)
                seeds = np.zeros((len(ordered), best), np.int64)
                for q, terms in enumerate(ordered):
                    own = [pairs[p] for p in zip(terms[:-1].tolist(), terms[1:].tolist(), strict=True)]
                    own = sorted((p for p in own if p in heads), key=lambda p: -joint[p])[:SEED_PAIRS]
                    if own:
                        first = np.unique(np.concatenate([heads[p] for p in own]))
                        score = np.sort(bounded.scores(terms.tolist(), first, weights))[::-1][:best]
                        seeds[q, : len(score)] = score
                columns = [*bounded.written(), joint.tobytes(), seeds.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], [*Segment.columns, "joint", "seeds"])

    indexed = staged(found.mapInArrow(index, f"{SEGMENT_SCHEMA}, joint binary, seeds binary"), "search-index")

    def highest(batches):
        top = np.zeros((len(ordered), best), np.int64)
        for batch in batches:
            for value in batch.column("seeds"):
                both = np.concatenate([top, np.frombuffer(value.as_buffer(), np.int64).reshape(top.shape)], axis=1)
                top = -np.partition(-both, best - 1, axis=1)[:, :best]
        q, at = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(top[q, at])], ["query", "score"])

    falling = Window.partitionBy("query").orderBy(F.desc("score"))
    seeds = indexed.select("seeds").mapInArrow(highest, "query long, score long").withColumn("place", F.row_number().over(falling))
    threshold = np.zeros(len(ordered), np.int64)
    for row in seeds.where(F.col("place") <= best).where(F.col("place") == best).collect():
        threshold[row["query"]] = row["score"]

    def run(batches):
        level, top = threshold.copy(), {}
        for batch in batches:
            for i in range(len(batch)):
                s = Bounded.read(batch, i)
                joint, maxima = np.frombuffer(batch.column("joint")[i].as_buffer(), np.int64), s.maxima(weights)
                for q, terms in enumerate(ordered):
                    terms = terms.tolist()
                    bounds = prefix_bounds(terms, maxima, joint, pairs)
                    at, score, _ = evaluated(s, terms, bounds, int(level[q]), weights)
                    if len(at):
                        held = top.get(q, (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint8),))
                        both = [np.concatenate(x) for x in zip(held, (score, s.ids[at], s.missing[at]), strict=True)]
                        order = np.lexsort((both[1], 1 - both[2], -both[0]))[:best]
                        top[q] = tuple(x[order] for x in both)
                        if len(order) == best:
                            level[q] = max(level[q], top[q][0][-1])
        for q, (score, own, missing) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q)), pa.array(own, mask=missing.astype(bool)), pa.array(score)], ["query", "doc_id", "score"])

    columns = [c for c in indexed.columns if c != "seeds"]
    hits = indexed.select(*columns).mapInArrow(run, "query long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    ranked = hits.withColumn("rank", place).where(F.col("rank") <= best)
    names = spark.createDataFrame(list(enumerate(ids)), f"query long, item_id {kind.simpleString()}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
