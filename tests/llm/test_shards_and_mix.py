"""Hilbert shards, mixing, running sums."""

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import hilbert, mixing
from tabulon.llm.ordering import running


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_running_sums(spark):
    rows = [(b, k, n) for b in (None, "x", "y") for k, n in zip((3, 1, None, 2, 1), (5, 1, 7, 0, 2), strict=True)]
    got = running(spark.createDataFrame(rows, "b string, k int, n long").repartition(7), ["k", "n"], "n", "before", by="b").collect()
    for name in (None, "x", "y"):
        own = sorted((r for r in got if r.b == name), key=lambda r: (r.k is not None, r.k or 0, r.n))
        assert [r.before for r in own] == [0, 7, 8, 10, 10]
    whole = running(spark.range(1000).select("id", F.lit(1).cast("long").alias("n")), ["id"], "n", "before")
    assert whole.where("before <> id").count() == 0 and whole.count() == 1000


def check_shards(rows, n):
    counts = Counter(r.shard for r in rows)
    if rows:
        per = [counts.get(s, 0) for s in range(n)]
        assert max(per) - min(per) <= 1
    for s, k in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_of_the_whole_table(spark, sf):
    from tabulon.llm.queries import op8_hilbert

    rows = op8_hilbert(spark, sf).collect()
    check_shards(rows, 16)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = op8_hilbert(spark, sf).collect()
    assert sorted(rows) == sorted(again)


def test_shards_prune(spark, sf):
    """Neighbouring sizes and equal sources meet in few shards: far fewer pairs of source and shard than by chance."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cut = hilbert.document_shards(docs)
    assert cut.select("source", "shard").distinct().count() < 0.6 * 20 * 10


def test_shards_of_odd_rows(odd, clashing, none):
    got = hilbert.document_shards(clashing)
    rows = got.collect()
    assert len(rows) == odd.count() and {"doc_id", "text", "size", "shard", "slot", "curve"} <= set(got.columns)
    check_shards(rows, 16)
    assert [r["size"] for r in rows if r.doc_id == 4] == [1] and rows[0].fp == "own fp"
    assert hilbert.document_shards(none).collect() == []
    check_shards(hilbert.document_shards(odd, shards=3).collect(), 3)


def test_written_shards(spark, odd):
    path = hilbert.write_shards(hilbert.document_shards(odd, shards=4))
    assert spark.read.parquet(path).count() == odd.count()


def highest_quotients(targets, seats):
    heap = [(-t, i, 0) for i, t in enumerate(targets)]
    heapq.heapify(heap)
    got = [0] * len(targets)
    for _ in range(seats):
        q, i, k = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-targets[i] / (2 * k + 3), i, k + 1))
    return got


def test_quotas_are_sainte_lague(spark):
    targets = [1000.0, 777.7, 431.2, 90.1, 12.3, 7.0, 0.0]
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(targets)], "source string, target double")
    quota = [r.q for r in table.select("source", mixing.quota(F.col("target"), 16).alias("q")).orderBy("source").collect()]
    assert quota == highest_quotients(targets, sum(quota))
    shards = mixing.shard_quotas(table, shards=5, block_words=16).collect()
    for k in range(1, 6):
        upto = [sum(r.blocks for r in shards if r.source == str(i) and r.shard < k) for i in range(len(targets))]
        assert upto == highest_quotients(targets, sum(upto))
    assert [sum(r.blocks for r in shards if r.source == str(i)) for i in range(len(targets))] == quota
    assert all(r.blocks >= 0 for r in shards)


def shared(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while len(fixed) < len(names):
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * level for s in free}}
        fixed |= {s: most * sizes[s] for s in over}
    return fixed


def check_mix(rows, block=mixing.BLOCK_WORDS):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    targets = shared(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 4 * block, s


def test_mix_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows)
    key = lambda r: (r.doc_id, r["size"], r.taken, r.target)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mixed(docs.repartition(5)).collect()))


def test_mix_with_caps(spark):
    rows = [(i, "w " * n, s, "") for i, (s, n) in enumerate([("a", 40)] * 5 + [("b", 3000)] * 4 + [("c", 90)] * 9 + [(None, 500)] * 3 + [("d", 0)])]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    check_mix(got)
    assert {r.source: round(r.target / max(1, r.source_size), 3) for r in got}["a"] == 3.0


def test_mix_of_odd_rows(odd, clashing, none):
    rows = mixing.mixed(clashing).collect()
    assert len(rows) == odd.count()
    check_mix(rows)
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    copies = mixing.mixed_documents(clashing)
    assert copies.columns == clashing.columns
    found = Counter(r.doc_id for r in copies.collect())
    assert all(found[i] == 1 for i in (4, 5, 6)) and max(found.values()) <= 6
    assert mixing.mixed(none).collect() == [] and mixing.mixed_documents(none).collect() == []
