"""Reply trees as conversations: root-to-leaf paths by self-joins, branches ranked by score, one formatted text per path.

Everything here is DataFrame functions.

* Links double: in round k every message knows its ancestor 2^k steps up, so a tree of depth d takes log2(d) + 1
  self-joins. Depth and summed score come along. A tree takes part only while one of its messages has not reached the root.
* Leaves are ranked within their tree; only the chosen ones are spelled out, again by doubling: a message and its
  distance give the ancestor 2^k steps above, each ancestor once.
* A parent with very many replies is one key of a join, which Spark can split; a tree of any size is spread over its messages.
  A formatted path is one value, so a path has to fit into a row (2 GB).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import staged

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that mean something to this or to another template: none of them is left inside a text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
ROOTS_MOST = 64  # rounds; 2^64 messages in a path are more than there can be


def escaped(text: Column) -> Column:
    """``text`` without control strings: the escape character is doubled, and parts each control string after its first character."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + ESCAPE + c[1:])), CONTROL, F.replace(text, F.lit(ESCAPE), F.lit(2 * ESCAPE)))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _kept(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A semi or anti join by all columns of ``right``, which may be null (null meets null)."""
    other = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns})
    return left.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in right.columns]), how)


def ranked_paths(links: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree: ``tree_id``, ``branch``, ``score``, ``depth``, ``position``, ``message_id``.

    ``links`` has ``tree_id``, ``message_id``, ``parent_id`` and ``score``, one row for each message (of several with one id the least parent
    and score count). A message whose parent is null or not in its tree is a root. A path's score is the mean of its messages'
    (null: 0); ties go to the longer path, then to the smaller leaf. ``branch`` counts from 1, ``position`` from 1 at the
    root. Null is a tree of its own and a message id like any other, except that no message replies to it. Messages on a
    circle of replies, or below one, have no root and are in no path. An empty table has no paths.
    """
    nodes = links.groupBy("tree_id", "message_id").agg(F.min(F.struct("parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"))).alias("x"))
    nodes = nodes.select("tree_id", "message_id", F.col("x.parent_id").alias("up"), F.col("x.s").alias("total"))
    known = nodes.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m")).where("m IS NOT NULL")
    nodes = nodes.join(known, nodes["tree_id"].eqNullSafe(known["t"]) & (nodes["up"] == known["m"]), "left")
    state = staged(nodes.select("tree_id", "message_id", F.col("m").alias("up"), F.lit(1).cast("long").alias("depth"), "total"), "reply-links")
    parents = state.where("up IS NOT NULL").select("tree_id", F.col("up").alias("message_id")).distinct()
    leaves = _kept(state.select("tree_id", "message_id"), parents, "left_anti")

    jumps: list[DataFrame] = []  # by k: message and its ancestor 2^k steps up
    settled: list[DataFrame] = []
    previous = None
    for _ in range(ROOTS_MOST):
        open_ones = state.where("up IS NOT NULL")
        trees = open_ones.select("tree_id").distinct()
        now = open_ones.count()
        done = state if not now else _kept(state, trees, "left_anti")
        settled.append(done)
        if not now or now == previous:  # nothing moves any more: what is left goes round in circles
            break
        previous = now
        jumps.append(open_ones.select("tree_id", "message_id", "up"))
        state = _kept(state, trees, "left_semi")
        above = state.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("up").alias("up2"), F.col("depth").alias("d"), F.col("total").alias("s"))
        moved = state.where("up IS NOT NULL").join(above, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
        moved = moved.select("tree_id", "message_id", F.col("up2").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total"))
        state = staged(moved.union(state.where("up IS NULL")), "reply-links")
    rooted = reduce(DataFrame.union, settled).where("up IS NULL").select("tree_id", "message_id", "depth", (F.col("total") / F.col("depth")).alias("score"))
    ends = _kept(rooted, leaves, "left_semi")
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), F.desc("depth"), F.asc("message_id"))
    chosen = ends.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    found = chosen.select("tree_id", "branch", "score", "depth", "message_id", F.col("depth").alias("position"))
    for k in reversed(range(len(jumps))):
        above = jumps[k].select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "up")
        joined = found.join(above, F.col("tree_id").eqNullSafe(F.col("t")) & F.col("message_id").eqNullSafe(F.col("m")), "left")
        both = F.array(
            F.struct("message_id", "position"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("message_id"), (F.col("position") - F.lit(2**k)).alias("position")))
        )
        found = joined.select("tree_id", "branch", "score", "depth", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("tree_id", "branch", "score", "depth", "x.*")
    return found.select("tree_id", "branch", "score", "depth", "position", "message_id")


def formatted_paths(messages: DataFrame, paths: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each path of ``paths`` (from :func:`ranked_paths`) as one text: ``tree_id``, ``branch``, ``score``, ``formatted``, ``loss``.

    ``messages`` has ``tree_id``, ``message_id``, ``role`` and ``text``. A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``; a missing role or text is
    empty. Control strings inside roles and texts are escaped (:func:`escaped`). ``loss`` lists what is trained on, the texts
    of ``trained`` roles, as ``start`` and ``length`` in bytes of the UTF-8 form of ``formatted``. A message that is there
    several times is as many turns. Other columns do not matter.
    """
    turns = messages.select(
        F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("role").isin(*trained).alias("counts"),
        F.concat(F.lit(START), escaped(F.coalesce("role", F.lit(""))), F.lit(SEPARATOR)).alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"),
    )
    rows = paths.join(turns, F.col("tree_id").eqNullSafe(F.col("t")) & F.col("message_id").eqNullSafe(F.col("m")))
    sizes = {"before": F.octet_length("head"), "length": F.octet_length("body")}
    rows = rows.select("tree_id", "branch", "score", "position", "counts", F.concat("head", "body", F.lit(END)).alias("turn"), *(e.cast("long").alias(n) for n, e in sizes.items()))
    in_order = Window.partitionBy("tree_id", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.octet_length("turn").cast("long")).over(in_order), F.lit(0)) + F.col("before"))
    loss = F.when(F.col("counts"), F.struct("start", "length"))
    made = rows.groupBy("tree_id", "branch", "score").agg(F.sort_array(F.collect_list(F.struct("start", "turn"))).alias("turns"), F.sort_array(F.collect_list(loss)).alias("loss"))
    return made.select("tree_id", "branch", "score", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text as an array of ``role`` and ``text``."""
    pieces = F.split(formatted, r"<\|im_end\|>")
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    parts = F.transform(whole, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    return F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    data = formatted.cast("binary")
    parts = F.transform(loss, lambda x: unescaped(F.decode(F.substring(data, x["start"].cast("int") + 1, x["length"].cast("int")), "UTF-8")))
    return F.array_join(parts, "")


def chains(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and links of linear conversations (``conv_id``, ``turn``, ``role``, ``text``): each row replies to the one before.

    Rows of one turn follow each other by role and a hash of their texts. Equal rows are one message that is there several times.
    """
    messages = conversations.select(F.col("conv_id").alias("tree_id"), "turn", "role", "text", F.xxhash64("turn", "role", "text").alias("message_id"))
    slim = messages.groupBy("tree_id", "turn", "role", "message_id").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("tree_id").orderBy("turn", "role", "message_id")
    links = slim.select("tree_id", "message_id", F.lag("message_id").over(before).alias("parent_id"), F.lit(0.0).alias("score"))
    return messages.select("tree_id", "message_id", "role", "text"), links


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted paths: numbers, hashes and sizes of turns and of trained text."""
    read = formatted.select("tree_id", "branch", "score", F.length("formatted").cast("long").alias("formatted_chars"), turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars", "branch",
    )
