"""SimHash groups and components against brute force."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_helpers import groups_of
from pyspark.sql import functions as F

from tabulon.llm import simhash
from tabulon.llm.components import components


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_hand():
    for text in (None, "", " \n", "One", "a b c", "a B c d", "x y\tz\nq r\x0bs " * 5, "é ß 東京 \xa0 x"):
        assert simhash.fingerprint_of(text) == plain_fingerprint(text)


@pytest.mark.parametrize("chunk", [1, 7, 30])
def test_long_texts_in_parts(monkeypatch, chunk):
    from tabulon.llm import wordhash

    monkeypatch.setattr(wordhash, "CHUNK", chunk)
    for text in ("a b c d e f g h", "One two  three\nfour five\tsix", "x", "x y", "", "long" * 30 + " w x y z " * 9):
        assert simhash.fingerprint_of(text) == plain_fingerprint(text)


def test_whole_table_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    ids = list(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(prints[a] ^ prints[b]).count("1") <= 4]
    expected = groups_of(ids, pairs)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in simhash.near_groups(docs, keep=["doc_id"]).collect():
        assert r.fingerprint == format(prints[r.doc_id], "016x")
        assert r.component_id == expected[r.doc_id]


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_masks_leave_no_pair_out(blocks):
    rng = random.Random(blocks)
    masks = simhash.block_masks(blocks)
    for _ in range(500):
        flips = rng.sample(range(64), 4)
        assert any(all(not m >> b & 1 for b in flips) for m in masks)


@pytest.mark.parametrize("seed", range(6))
def test_links_connect_what_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(120):
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                c ^= 1 << b
            prints.add(c)
    prints = np.array(sorted(prints), np.uint64)
    pairs = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4).tolist()]
    place = {p: i for i, p in enumerate(prints.tolist())}
    got = [(place[x], place[y]) for a, b in simhash.linked_within(prints) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(got) <= {p for i, j in pairs for p in ((i, j), (j, i))}
    assert groups_of(range(len(prints)), got) == groups_of(range(len(prints)), pairs)


def test_hot_group_over_several_batches(spark):
    """Thousands of near fingerprints under one key, split over Arrow batches, stay one group; no pair table is made."""
    rng = random.Random(5)
    base = 0x0123456789ABCDEF
    prints = {base}
    while len(prints) < 6000:
        p = base
        for b in rng.sample(range(0, 20), rng.randrange(1, 8)):
            p ^= 1 << b
        prints.add(p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
        member = components(links)
        assert member.select("component").distinct().count() == 1 and member.count() == len(prints)
        assert links.count() < 60 * len(prints)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {k: v for k, v in groups_of(nodes, pairs).items() if k in nodes}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, clashing, none):
    rows = simhash.near_groups(clashing).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == 1
    assert by_id[4].fingerprint == "0" * 16 and by_id[4].component_id == by_id[5].component_id == by_id[6].component_id == 4
    assert [r.component_id for r in rows if r.doc_id == 7] == [7, 7]
    assert by_id[1].size == "own size"
    assert simhash.near_groups(none).collect() == []


def test_deduplicated_keeps_one(odd, clashing, none):
    got = simhash.deduplicated(clashing)
    assert got.columns == clashing.columns
    groups = simhash.near_groups(odd).select("component_id").distinct().count()
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == groups and kept.count(7) == 1 and 1 in kept and 2 not in kept and 4 in kept and 5 not in kept
    assert simhash.deduplicated(none).collect() == []
    assert simhash.deduplicated(odd.where("doc_id IS NULL").select(*odd.columns, F.lit(1).alias("row"))).count() == 2


def jaccard_groups(rows, k=5, least=0.8):
    """Brute force: groups of doc_ids, and the pairs of different sets that link them."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()
    ids = sorted(sets)
    pairs = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y)):
                pairs.append((a, b))
    return groups_of(ids, pairs), [(a, b) for a, b in pairs if sets[a] != sets[b]]


def test_deduplicated_recall_against_jaccard(spark, monkeypatch):
    """Every pair of similarity 0.8 is found, also in groups larger than the keys whose pairs are compared at once."""
    from tabulon.llm import shingles

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    passage = [word() for _ in range(40)]
    for size in [3, 6, 12, 40, 120, 400] * 4:
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, size // 50, size // 30, size // 20):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(size)] = word()
            texts.append(" ".join(other))
        texts.append(" ".join(base + passage))
    hot = [word() for _ in range(200)]
    for _ in range(60):  # a chain: each from the one before, so that its ends are far apart
        hot[rng.randrange(200)] = word()
        texts.append(" ".join(hot))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    expected, pairs = jaccard_groups(rows)
    assert sum(bin(plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).count("1") > 4 for a, b in pairs) > 20
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(expected.values())
    monkeypatch.setattr(shingles, "SMALL", 2)
    monkeypatch.setattr(shingles, "ROUNDS", 2)
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(expected.values())


def test_shingles_of_long_texts(monkeypatch):
    from tabulon.llm import shingles, wordhash

    texts = [b"", b" \n", b"One", b"a b c d", b"a B c d e f g", b"x y\tz\nq r\x0bs " * 9, b"long" * 30 + b" w x y z"]
    whole = shingles.shingle_sets(texts)
    assert [len(x) for x in whole] == [0, 0, 1, 1, 3, 6, 1]
    monkeypatch.setattr(wordhash, "CHUNK", 7)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, shingles.shingle_sets(texts), strict=True))


def pieces_of(docs):
    """What ``alike_components`` takes: keyed texts, their sets, and a row for each set."""
    from tabulon.llm import shingles

    keyed = docs.select("doc_id", F.col("doc_id").cast("long").alias("row"), "text")
    slim = shingles.prefixes(keyed).cache()
    return keyed, slim.groupBy("fp").agg(F.min("row").alias("row")), slim


def test_fingerprints_of_sets_link_near_copies(spark):
    """Without any key of the prefix filter, SimHashes alone connect texts within few bits, if these are similar enough."""
    from tabulon.llm import shingles

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(300)), None, ""]
    for found in shingles.shingle_sets([(t or "").encode() for t in texts[:4]]):
        bits = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in found) > len(found))
        assert shingles.simhash(found) & (1 << 64) - 1 == bits
    docs, nodes, slim = pieces_of(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    links = simhash.links(slim.select(F.col("print").alias("fp")).where("fp IS NOT NULL").distinct())
    member = shingles.alike_components(docs, nodes, slim.withColumn("keys", F.expr("array()").cast("array<bigint>")), links)
    got = {r.row for r in slim.join(member, slim["fp"] == member["node"]).select("row").collect()}
    assert got == {0, 1, 2} and member.select("component").distinct().count() == 1
    every = spark.createDataFrame([(a.print, b.print) for a in slim.collect() for b in slim.collect() if a.print is not None and b.print is not None and a.print < b.print], "a long, b long")
    assert {(r.node, r.component) for r in shingles.alike_components(docs, nodes, slim, every).collect()} == {(r.node, r.component) for r in member.collect()}


def test_candidates_of_a_large_group_stay_few(spark, monkeypatch):
    """Copies of one text, each with other edits: candidates grow with the copies, not with their square."""
    from tabulon.llm import shingles

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        other = list(base)
        for at in rng.sample(range(0, 140, 6), i % 4):
            other[at] = word()
        rows.append((i, " ".join(other)))
    real, made = shingles.staged, []

    def counted(df, label):
        out = real(df, label)
        if label == "shingle-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(shingles, "staged", counted)
    expected, _ = jaccard_groups(rows)
    assert {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id int, text string")).collect()} == set(expected.values())
    assert sum(made) <= 10 * len(rows)


def test_sets_are_compared_by_spark(spark):
    """No batch of thousands of pairs goes to Python with both sets of each; sets are compared exactly."""
    from tabulon.llm import shingles

    rng = random.Random(8)
    sets = {0: set(range(10)), 1: set(range(2, 12)), 2: set(range(1, 10)), 3: set(range(8)), 4: {-(2**63), 2**63 - 1}, 5: {-(2**63), 2**63 - 1, 7}}
    sets |= {i: set(rng.sample(range(14), 11)) for i in range(6, 30)}
    table = spark.createDataFrame([(i, list(x)) for i, x in sets.items()], "fp long, shingles array<long>")
    pairs = spark.createDataFrame([(a, b, b % 4) for a in sets for b in sets if a < b], "a long, b long, salt int")
    found = shingles._alike(pairs, table, 0.8)
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in found.collect()} == expected and (0, 2) in expected and (0, 3) in expected and (0, 1) not in expected
    assert "InArrow" not in found._jdf.queryExecution().toString()


def test_deduplicated_leaves_only_what_its_result_reads(spark):
    """Tables of the steps before go when they have been read: of all rounds and links only the verdicts stay."""
    from tabulon.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: 50 + i % 3], f"v{i}"])) for i in range(40)] + [(40, None), (41, "other")]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id int, text string"))
    left = {re.sub("-[0-9a-f]{32}$", "", x) for x in set(os.listdir(folder)) - before}
    assert left == {"simhash-judged"}
    assert {r.doc_id for r in got.collect()} == set(jaccard_groups(rows)[0].values())


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    from tabulon import session
    from tabulon.llm import shingles

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}

    def noted(real):
        def staged(df, label):
            seen.setdefault(label, spark.conf.get(name, None))
            return real(df, label)

        return staged

    monkeypatch.setattr(shingles, "staged", noted(shingles.staged))
    monkeypatch.setattr(simhash, "staged", noted(simhash.staged))
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, None)], "doc_id int, text string")
    before = spark.conf.get(name, None)
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {1, 3}
    assert {seen[x] for x in ("common-shingles", "shingles", "simhash-sets")} == {session.BATCH_BYTES} and spark.conf.get(name, None) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    with session.small_batches(spark):
        cut = spark.range(0, 4000, 1, 1).selectExpr("id AS n", "repeat('x', 4000) AS t").mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in cut) == 4000 and max(r.n for r in cut) * 4000 < 5_000_000
