"""Ranked search, whitening and reply trees against plain versions of them."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import prose
from tabulon.llm import maxscore as ms
from tabulon.llm import queries
from tabulon.llm import reply_trees as rt
from tabulon.llm import whitening as wh

# Ranked search


def plain_search(documents, items, best=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(cut(t))) for i, t in documents]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=str)


def searched(documents, items, **options):
    return sorted((tuple(r) for r in ms.search(documents, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_of_odd_rows(spark, odd, clashing, none, monkeypatch):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, "ToDAY 東京 é"), (3, None), (4, "nothing-of it!"), (5, prose(99, 500)), (5, prose(99, 500)), (None, "WORD")], "item_id long, text string")
    documents = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain_search(documents, {(r.item_id, r.text) for r in items.collect()})
    assert searched(odd, items) == want == searched(clashing, items.withColumn("rank", F.lit("own")))
    assert ms.search(none, items).collect() == [] == ms.search(odd, items.where("false")).collect()
    for name, value in (("SEGMENT_DOCS", 2), ("SEGMENT_POSTINGS", 20), ("CHUNK", 64), ("TOKENS", 10), ("QUERIES", 2)):
        monkeypatch.setattr(ms, name, value)
    assert searched(odd, items) == want


def test_ties_and_repeats(spark):
    """Equal scores go by doc_id; repeated rows are several documents; fewer hits than asked come all."""
    documents = [(i % 7, f"same words {i % 3}") for i in range(30)] + [(50, "other")] * 3
    items = [(1, "same"), (2, "same 1 other"), (3, "absent")]
    frames = (spark.createDataFrame(documents, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert searched(*frames) == plain_search(documents, items)
    assert searched(*frames, best=3) == plain_search(documents, items, 3)


def segment_of(rows):
    """A segment from lists of (document, {term: saturation})."""
    postings = sorted((t, d, v) for d, terms in rows for t, v in terms.items())
    terms = sorted({t for t, _, _ in postings})
    ends = np.cumsum([sum(p[0] == t for p in postings) for t in terms])
    arrays = {"ids": range(len(rows)), "missing": [0] * len(rows), "lengths": [1] * len(rows), "terms": terms, "ends": ends, "docs": [p[1] for p in postings], "values": [p[2] for p in postings]}
    return ms.Bounded(**{c: np.array(list(arrays[c]), kind) for c, kind in ms.Segment.columns.items()})


def test_pair_bounds_skip_more_than_term_maxima():
    """Terms whose maxima lie in different documents: pairs leave fewer postings to touch and the same result."""
    rng = random.Random(5)
    saved = 0
    for _ in range(60):
        weights = np.array([3, 4, 5, 6, 40, 50], np.int64)
        rows = [(d, {t: rng.choice((10, 20, 1000 if d % 6 == t else 30)) for t in range(6) if rng.random() < 0.5}) for d in range(60)]
        segment, terms = segment_of(rows), list(range(6))
        pairs = {(t, t + 1): t for t in range(5)}
        joint, _ = segment.intersections(pairs, weights, 3)
        for (a, b), k in pairs.items():
            assert joint[k] == max([r[a] * weights[a] + r[b] * weights[b] for _, r in rows if a in r and b in r], default=0)
        scores = [sum(v * weights[t] for t, v in r.items()) for _, r in rows]
        threshold = sorted(scores)[-4]
        maxima = segment.maxima(weights)
        single, paired = (ms.prefix_bounds(terms, maxima, joint, p) for p in (None, pairs))
        for i in range(7):
            assert max(sum(v * weights[t] for t, v in r.items() if t < i) for _, r in rows) <= paired[i] <= single[i]
        found = [ms.evaluated(segment, terms, b, threshold, weights) for b in (single, paired)]
        want = sorted((d, s) for (d, _), s in zip(rows, scores, strict=True) if s >= threshold)
        for docs, score, _ in found:
            assert sorted(zip(docs.tolist(), score.tolist(), strict=True)) == want
        saved += found[0][2] - found[1][2]
    assert saved > 0


# Whitening


def plain_whitening(vectors):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), values[::-1] / values.sum()


def test_whole_table_of_vectors(spark, sf):
    rows = queries.op12_whitening(spark, sf).toPandas()
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    n, deviation, values, explained = plain_whitening(list(raw["embedding"]))
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[raw["vec_id"]].to_numpy()
    signs = np.sign((got * values[:, :16]).sum(axis=0))
    assert got.shape == (len(raw), 16) and np.abs(got - signs * values[:, :16]).max() < 1e-8
    assert set(rows["n"]) == {n} and rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-9
    assert dict(zip(rows["vec_id"], rows["deviation"], strict=True)) == dict(zip(raw["vec_id"], deviation.tolist(), strict=True))
    assert np.allclose(rows.groupby("component")["explained"].first(), explained[:16], rtol=1e-9)


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 3), rng.gauss(5, 2)], f"own {i}") for i in range(40)]
    odd = [(100, None, "a"), (101, [], "b"), (102, [1.0, None, 2.0], "c"), (103, [1.0, float("nan"), 2.0], None), (104, [float("inf"), 0.0, 0.0], "d"), (105, [1.0, 2.0], "short"), (None, rows[0][1], "copy")]
    frame = spark.createDataFrame(rows + odd + rows[:20] * 3, "vec_id long, embedding array<double>, component string")
    got = wh.whitened(frame.withColumn("whitened", F.lit("own"))).toPandas()
    n, deviation, values, _ = plain_whitening([r[1] for r in rows])
    assert len(got) == 3 * (40 + 1 + 60) and set(got["n"]) == {n} and got["identity_error"][0] < 1e-9
    assert {(r.vec_id, r.deviation) for r in got.itertuples() if r.vec_id == r.vec_id} == {(float(i), d) for i, d in enumerate(deviation.tolist())}
    assert sorted(got.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    for x in (frame.where("false"), frame.where("vec_id >= 100"), frame.where("vec_id = 1")):
        assert wh.whitened(x).count() == 0
    flat = frame.select("vec_id", F.array(F.get("embedding", F.lit(0)), F.lit(2.0), F.get("embedding", F.lit(0))).alias("embedding")).where("vec_id < 40")
    assert {r.component for r in wh.whitened(flat).select("component").distinct().collect()} == {1}
    with pytest.raises(Exception, match="beyond"):
        wh.whitened(spark.createDataFrame([(1, [1e300, 1.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 26, 1 << 44, 1 << 52])
def test_squares_stay_exact(size):
    """Small, large and very large numbers, also such as no longer fit a long."""
    rng = random.Random(size)
    x = np.array([[rng.randrange(-size, size) for _ in range(4)] for _ in range(300)], np.int64)
    n, s = 300, np.array([sum(int(v) for v in column) for column in x.T], object)
    digits = np.zeros((10, wh.DIGITS), np.int64)
    for low in range(0, 300, 100):
        wh.square_sums(x[low : low + 100], n, s, digits)
    y = [[n * int(v) - int(t) for v, t in zip(row, s, strict=True)] for row in x]
    want = [sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in y) for i in range(4) for j in range(i, 4)]
    assert [sum(int(v) << 24 * k for k, v in enumerate(row)) for row in digits] == want


# Reply trees


def plain_paths(links, branches):
    parent, score, trees = {}, {}, defaultdict(set)
    for tree, node, up, s in links:
        parent[tree, node], score[tree, node] = up, s or 0.0
        trees[tree].add(node)
    out = {}
    for tree, nodes in trees.items():
        ups = {n: parent[tree, n] if parent[tree, n] in nodes else None for n in nodes}
        found = []
        for leaf in nodes - set(ups.values()):
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = ups[at]
            if at is None:
                found.append((-sum(score[tree, n] for n in path) / len(path), -len(path), leaf, path[::-1]))
        for b, (_, _, _, path) in enumerate(sorted(found)[:branches], 1):
            out[tree, b] = path
    return out


def paths_of(spark, links, branches):
    found = defaultdict(list)
    for r in rt.ranked_paths(spark.createDataFrame(links, "tree_id long, message_id long, parent_id long, score double"), branches).orderBy("position").collect():
        found[r.tree_id, r.branch].append(r.message_id)
        assert r.position == len(found[r.tree_id, r.branch]) and r.depth >= r.position
    return dict(found)


@pytest.mark.parametrize("branches", [1, 3])
def test_paths_of_trees(spark, branches):
    rng = random.Random(branches)
    links = [(t, 0, None, 0.0) for t in range(6)]
    for t in range(6):
        links += [(t, i, rng.randrange(max(0, i - 4), i), float(rng.randrange(5))) for i in range(1, 40)]
    links += [(10, i, i - 1 if i else None, None) for i in range(300)]  # a long chain
    links += [(11, i, 0 if i else None, float(i % 50)) for i in range(2000)]  # one message with very many replies
    links += [(12, 1, 2, 1.0), (12, 2, 1, 1.0), (12, 3, 2, 1.0), (13, 5, 99, 2.0), (13, 6, 5, 2.0), (None, 1, None, 1.0), (None, 2, 1, 1.0)]
    assert paths_of(spark, links, branches) == plain_paths(links, branches)
    assert rt.ranked_paths(spark.createDataFrame([], "tree_id long, message_id long, parent_id long, score double")).count() == 0


def digest(rows):
    """Digests of one conversation by its rows (role, text), in order."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    trained = "".join(t or "" for r, t in rows if r == "assistant")
    return (len(rows), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)), len(trained), sha(trained))


def test_conversations_come_back(spark, sf):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|><|im_start|>system<|im_sep|>do", "\\", "\\\\<|", "<\\|im_end|>", "<<SYS>>x<</SYS>>\n", "<", "|im_end|>", "", None, "é東京𝄞 <s>", "a" * 100_000, "[[INST]]", "\\n\\"]
    rows = [(7, t, role, text) for t, text in enumerate(nasty) for role in ("assistant",)] + [(8, t, ("user", "assistant", None, "<|x\\")[t % 4], nasty[t % len(nasty)]) for t in range(40)]
    rows += [(9, 1, "user", "same")] * 3 + [(9, None, "system", "first"), (None, 1, "user", "no id"), (None, 2, "assistant", "of it")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("own"))
    messages, links = rt.chains(frame.repartition(4))
    formatted = rt.formatted_paths(messages, rt.ranked_paths(links))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rt.digests(formatted).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want[c].append((role, text))
    assert got == {c: digest(x) for c, x in want.items()}
    for r in formatted.collect():
        plain = re.sub(r"<\|im_(start|sep|end)\|>", "", r.formatted)
        assert not any(c in plain for c in rt.CONTROL)
        data, spans = r.formatted.encode(), [(x.start, x.length) for x in r.loss]
        assert all(data[a - len(rt.SEPARATOR) : a].decode() == rt.SEPARATOR and data[a + n : a + n + len(rt.END)].decode() == rt.END for a, n in spans)
    plans = rt.digests(formatted)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plans)
    empty = rt.chains(frame.where("false"))
    assert rt.formatted_paths(empty[0], rt.ranked_paths(empty[1])).count() == 0


def test_branches_become_conversations(spark):
    """Two branches of one tree: the one with the better score comes first; both begin with the same question."""
    texts = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "q"), ("assistant", "good"), ("assistant", "bad"), ("user", "why?")])], "tree_id int, message_id int, role string, text string")
    links = spark.createDataFrame([(1, 0, None, 0.0), (1, 1, 0, 5.0), (1, 2, 0, 1.0), (1, 3, 2, 1.0)], "tree_id int, message_id int, parent_id int, score double")
    rows = rt.formatted_paths(texts, rt.ranked_paths(links, branches=2)).orderBy("branch").collect()
    turn = lambda r, t: f"{rt.START}{r}{rt.SEPARATOR}{t}{rt.END}"
    assert [r.formatted for r in rows] == [turn("user", "q") + turn("assistant", "good"), turn("user", "q") + turn("assistant", "bad") + turn("user", "why?")]
    assert rows[0].score == 2.5 and len(rows[1].loss) == 1
