"""The pipeline: its stages in turn, its result against its parts."""

import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from llm_helpers import groups_of
from tabulon.llm import contamination, hilbert, mixing, toxicity


def first_of_alike(texts, words=5, similarity=0.8):
    """The smallest id of each group of texts whose sets of shingles are alike, all pairs compared."""
    made = {}
    for i, text in texts.items():
        tokens = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
        tokens = [t for t in tokens if t]
        made[i] = {tuple(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()
    pairs = [(a, b) for a in made for b in made if a < b and (made[a] == made[b] or len(made[a] & made[b]) >= similarity * len(made[a] | made[b]) - 1e-9)]
    return set(groups_of(made, pairs).values())


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs)
    return out


def test_stages(spark, sf, stages):
    documents, clean, single, pure, mix, sharded = stages
    assert all(d.columns == documents.columns for d in stages[:-1])
    tox = toxicity.toxicity_scores(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(clean) == ids(tox.where("NOT toxic")) and clean.count() < documents.count()
    assert ids(single) == first_of_alike({r.doc_id: r.text for r in clean.collect()}) and single.count() == len(ids(single))
    leaks = contamination.leaks(single, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids(pure) == ids(single) - ids(leaks) and len(ids(pure)) < len(ids(single))
    taken = {r.doc_id: r for r in mixing.mixed(pure, keep=["doc_id"]).collect()}
    copies = Counter(r.doc_id for r in mix.collect())
    for doc, r in taken.items():
        assert copies[doc] == (1 if r["size"] == 0 else int(r.taken / r["size"] + 0.5))
    assert sharded.count() == mix.count() and Counter(r.doc_id for r in sharded.collect()) == copies
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.text == texts[r.doc_id] for r in sharded.collect())
    counts = Counter(r.shard for r in sharded.collect())
    assert set(counts) == set(range(hilbert.SHARDS)) and max(counts.values()) - min(counts.values()) <= 1


def test_run(spark, sf, stages):
    columns = ("doc_id", "shard", "slot")
    got = sorted(tuple(r[c] for c in columns) for r in cp.run(spark, sf).collect())
    assert got == sorted(tuple(r[c] for c in columns) for r in stages[-1].collect())


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_odd_documents(spark, sf, odd, clashing, none, name, stage):
    got = stage(spark, clashing, sf)
    if name != cp.STAGES[-1][0]:
        assert got.columns == clashing.columns
    assert 0 < got.count() <= 6 * odd.count()
    assert stage(spark, none, sf).collect() == []
