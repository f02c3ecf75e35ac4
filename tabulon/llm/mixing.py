"""Mixing sources to target weights with equal blocks of tokens, apportioned by Sainte-Laguë."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.ordering import replaced, running
from tabulon.session import staged

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 16
SHARDS = 16
BROADCAST_ROWS = 100_000  # sources; more are joined by a shuffle
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """The number of words (runs of characters other than space and \\t \\n \\v \\f \\r); null: 0."""
    # ASCII white space only: the same set for translate as in the pattern [^\x20\x09-\x0D]+.
    runs = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(runs) == 0, 0).otherwise(F.length(runs) - F.length(F.translate(runs, " ", "")) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Targets by source of a table with ``source`` and ``size``: ``source``, ``source_size``, ``target``.

    Sources in order of their names (null last) get the weights in turn and share the sum of all sizes
    by them. A target stops at ``most`` times its source's size; what is above is shared again among
    the others by weight, until none is above. Only sums go to the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.withColumns({"__null": F.col("source").isNull().cast("int"), "__one": F.lit(1).cast("long")})
    numbered = running(by_source, ["__null", "source"], "__one", "__at", label="sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__at") % len(weights) + 1).cast("int"))
    table = staged(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("most")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words for each unit of weight
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > F.col("most")
        fixed, free, n = table.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(~above, 1))).first()
        if not n:
            break
        new = (total - (fixed or 0.0)) / free
        if level is not None and new <= level:
            break
        level = new
    target = F.col("most") if level is None else F.least(F.col("weight") * level, F.col("most"))
    return table.select("source", "source_size", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def quota(target: Column, block_words: int, share: Column | None = None) -> Column:
    """The number of blocks a source gets: all its quotients target / (2k + 1) that reach half a block.

    Blocks go to the highest quotients target / 1, target / 3, target / 5 …; stopping at the quotient
    ``block_words / 2`` gives each source ``floor(target / block_words + 1/2)`` blocks, and this is the
    Sainte-Laguë apportionment of as many blocks as that makes in all. ``share`` stops earlier: with
    share k/n the same apportionment of k/n of the mix.
    """
    part = target if share is None else target * share
    return F.floor(part / block_words + F.lit(0.5)).cast("long")


def shard_quotas(targets: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Integer quotas: ``source``, ``shard``, ``blocks``. The first k shards together hold an apportionment of their own."""
    each = targets.select("source", "target", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    upto = lambda k: quota(F.col("target"), block_words, k / F.lit(float(shards)))
    return each.select("source", "shard", (upto(F.col("shard") + 1) - upto(F.col("shard"))).alias("blocks"))


def draw_of(seed: str) -> Column:
    """A document's place in the order of its source: drawn from the seed, ``doc_id`` and ``text``."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS, seed: str = SEED, keep: Sequence[str] | None = None, places: bool = False) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target``, ``quota_blocks`` and ``taken``; own columns of these names go.

    The documents of a source, in an order drawn from ``seed``, ``doc_id`` and the text, are one stream of
    words that is cut into blocks. A quota of q blocks out of n takes the stream ``q // n`` times and
    then ``q % n`` neighbouring blocks, from a block drawn by ``seed`` on, over the end to the start. ``taken``
    counts a document's words in them, repeats included: 3 times its size at most. Documents without
    words (null or empty text) have size and ``taken`` 0. ``keep`` names the columns to carry along (all of
    them if None), ``places`` adds ``__draw``, the key of that order. An empty table gives no rows.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("size", "source_size", "target", "quota_blocks", "taken")]
    sized = replaced(docs, {"size": word_count(F.col("text"))}).withColumn("__draw", draw_of(seed))
    sized = sized.select(*(F.col(f"`{c}`") for c in own), F.col("source").alias("__by"), "size", "__draw")
    if keep is not None:
        sized = staged(sized, "mix-sizes")  # texts are read once
    # Only the last block of a stream can be short, so blocks have equal numbers of words.
    placed = running(sized, ["__draw"], "size", "__at", by="__by", label="mix")
    targets = source_targets(placed.select(F.col("__by").alias("source"), "size"), weights, most)
    targets = targets.withColumnsRenamed({"source": "__source", "target": "__target", "source_size": "__source_size"})
    joined = placed.join(targets, F.col("__by").eqNullSafe(F.col("__source")))
    blocks = F.ceil(F.col("__source_size") / block_words)
    q = quota(F.col("__target"), block_words)
    first = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("__by"), F.lit("")))), 1, 8), 16, 10).cast("long"), blocks)
    start, words = first * block_words, (q % blocks) * block_words
    # The taken stretch [start, start + words) on the ring of all blocks, as one or two stretches of the stream.
    ring = blocks * block_words
    a, b = F.col("__at"), F.col("__at") + F.col("size")
    inside = lambda low, high: F.greatest(F.lit(0), F.least(b, high) - F.greatest(a, low))
    once = inside(start, start + words) + inside(start - ring, start + words - ring)
    taken = F.when(F.col("size") == 0, 0).otherwise(F.floor(q / blocks) * F.col("size") + once).cast("long")
    return joined.select(
        *(F.col(f"`{c}`") for c in own),
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        q.alias("quota_blocks"),
        taken.alias("taken"),
        *([F.col("__draw")] if places else []),
    )


def mixed_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix as whole documents: each as many times as its ``taken`` words, rounded to whole copies.

    Only the documents at the two ends of a source's taken stretch are rounded. Documents without words stay once; rows equal
    in doc_id and text are taken alike. Columns as in ``docs``. A source's further copies are a run of its order, so its two
    ends say which documents they are, and texts are neither shuffled nor written.
    """
    rows = mixed(docs.select("doc_id", "text", "source"), seed=seed, keep=["source"], places=True, **options).where("size > 0")
    rows = staged(rows.withColumn("copies", F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")), "mix-copies")
    least = F.min("copies").alias("least")
    by_source = rows.groupBy("source").agg(least, F.max("copies").alias("most")).withColumnRenamed("source", "__source")
    placed = rows.join(by_source, F.col("source").eqNullSafe(F.col("__source")))
    high, low = F.col("copies") > F.col("least"), F.col("copies") == F.col("least")
    found = placed.groupBy("__source", "least", "most").agg(
        F.min("__draw").alias("first"),
        F.min(F.when(high, F.col("__draw"))).alias("high_a"),
        F.max(F.when(high, F.col("__draw"))).alias("high_b"),
        F.min(F.when(low, F.col("__draw"))).alias("low_a"),
        F.max(F.when(low, F.col("__draw"))).alias("low_b"),
        F.max("__draw").alias("last"),
    )
    # Over the end of the order and on from its start, the run is what lies outside the others' run.
    over = (F.col("high_a") == F.col("first")) & (F.col("high_b") == F.col("last"))
    ends = staged(found.withColumn("over", over & F.col("low_a").isNotNull()), "mix-runs")
    if ends.count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    document = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    told = docs.select(document, F.col("source").alias("__own"), draw_of(seed).alias("draw"), empty.alias("empty"))
    joined = told.join(ends, F.col("__own").eqNullSafe(F.col("__source")), "left")
    draw = F.col("draw")
    inside = F.when(F.col("over"), ~draw.between(F.col("low_a"), F.col("low_b"))).otherwise(draw.between(F.col("high_a"), F.col("high_b")))
    times = F.when(F.col("empty"), 1).when(inside, F.col("most")).otherwise(F.coalesce("least", F.lit(0)))
    return joined.select("document", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("document.*")
