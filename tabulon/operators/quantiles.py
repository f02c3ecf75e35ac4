"""Exact linear-interpolated percentiles whose state stays bounded.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer. The plans here narrow the table
first, at every size.

Whole columns (:func:`_bracketed`) take a few scans and move next to nothing: a sketch of the whole column gives a
bracket around each wanted rank, then the rows below each bracket are counted and the few values
inside it are grouped. The result is exact: should a rank lie outside its bracket, the slices below
decide.

Groups (:func:`_by_group`) do the same with a row of brackets per group: one aggregate sketches every group (callers add
their own statistics to it), a second scan counts below the brackets, a third groups the values inside.

Rows are counted by value in the tasks before they are shuffled, so a value that fills a third of a
group is one row per task; the brackets of groups reach the tasks by a broadcast of checked size, or by a join that Spark can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import col, present, small_table
from tabulon.session import staged

ACCURACY = 10_000
SKETCH_SAMPLE = 100_000  # rows inside a wide bracket that place a narrower one
INSIDE_ROWS = 5_000_000  # a bracket with more rows is narrowed again
GRID = 200
MAX_ROUNDS = 6
BROADCAST_BRACKETS = 1_000_000  # of groups, columns and probabilities (32 MB); more are joined by a shuffle


def percentile_expr(value: Column, probabilities: list[float], approx: bool = False) -> Column:
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    if approx:
        return F.percentile_approx(value, list(map(float, probabilities)), 10_000)
    return F.percentile(value, wanted)


def fits_direct(df: DataFrame, direct_rows: int | None = None) -> bool:
    """Whether the caller allows the one-buffer plan and the table has no more than ``direct_rows`` rows."""
    return direct_rows is not None and df.count() <= direct_rows


def _margins() -> list[tuple[float, float]]:
    """Shares on either side of a probability, each with the number of values from which on it is two ranks or more beyond what a sketch errs by (1 / ACCURACY)."""
    least = 3.0 / ACCURACY
    return [(3 / least, least), (200, max(least, 0.01)), (20, max(least, 0.1))]


def sketches(df: DataFrame, columns: list[str], probabilities: list[float]) -> list[Column]:
    """Aggregates from which :func:`percentiles` starts, to be taken along with others in one scan."""
    points = [min(1.0, max(0.0, p + side * share)) for p in probabilities for _, share in _margins() for side in (-1, 1)]
    found = []
    for i, n in enumerate(columns):
        value = present(df, n).cast("double")
        found += [F.count(value).alias(f"sketch_n_{i}"), F.percentile_approx(value, points, ACCURACY).alias(f"sketch_{i}")]
    return found


def _bracket(sketch: list[float] | None, n: int, j: int, p: float) -> tuple[float, float]:
    """The bracket around probability ``j`` by a sketch of ``n`` values; open where it has no value on that side."""
    for k, (least, share) in enumerate(_margins()):
        if sketch and n >= least:
            at = 2 * (j * len(_margins()) + k)
            return sketch[at] if p - share > 0 else float("-inf"), sketch[at + 1] if p + share < 1 else float("inf")
    return float("-inf"), float("inf")


def percentiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    keys: tuple[str, ...] = (),
    direct_rows: int | None = None,
    sketch=None,
) -> DataFrame:
    """``(keys…, column, q array<double>)``, one row per group and column that has values.

    The plan is the same at every size. A caller who knows that a table is small may allow Spark's own ``percentile``, which
    keeps all distinct values of a group in one buffer, for up to ``direct_rows`` rows. ``sketch`` is the result of
    :func:`sketches` where the caller has it already: a row, or with ``keys`` a table with a row per group. Rows with a missing key belong to no group.
    """
    if sketch is None and fits_direct(df, direct_rows):
        wide = df.groupBy(*[col(k) for k in keys]).agg(
            *[percentile_expr(present(df, n).cast("double"), probabilities).alias(f"q_{i}") for i, n in enumerate(columns)]
        )
        pairs = [F.struct(F.lit(n).alias("column"), F.col(f"q_{i}").alias("q")) for i, n in enumerate(columns)]
        return wide.select(*[col(k) for k in keys], F.inline(F.array(*pairs))).where("q IS NOT NULL")
    if keys:
        return _by_group(df, columns, probabilities, keys, sketch)
    return _bracketed(df, columns, probabilities, sketch)


def _bracketed(df: DataFrame, columns: list[str], probabilities: list[float], sketch=None) -> DataFrame:
    """Percentiles of whole columns without moving them.

    The driver holds two bounds and a count per column and percentile. A bracket holds some
    ``6 / ACCURACY`` of the rows, and its values are counted once per distinct value.
    """
    if sketch is None:
        sketch = df.agg(*sketches(df, columns, probabilities)).first()
    narrow = df.select(*[present(df, n).cast("double").alias(f"v_{i}") for i, n in enumerate(columns)])
    targets = []  # (id, column, probability index, low, high)
    for i, n in enumerate(columns):
        for j, p in enumerate(probabilities):
            targets.append((len(targets), n, j, *_bracket(sketch[f"sketch_{i}"], sketch[f"sketch_n_{i}"], j, p)))
    counts = _bracket_counts(narrow, columns, targets)
    for _ in range(MAX_ROUNDS):
        wide = {
            t[0]: F.lit(SKETCH_SAMPLE / counts[f"i_{t[0]}"])
            for t in targets
            if counts[f"i_{t[0]}"] > INSIDE_ROWS and t[3] < t[4]
        }
        narrower = _narrower(narrow, columns, probabilities, targets, counts, wide) if wide else targets
        if narrower == targets:
            break
        targets = narrower
        counts = _bracket_counts(narrow, columns, targets)

    brackets: dict[str, list] = {}
    for _, n, _, low, high in targets:
        brackets.setdefault(n, []).append((low, high))
    cells = []
    for n, bounds in brackets.items():
        value = F.col(f"v_{columns.index(n)}")
        inside = reduce(Column.__or__, [value.between(F.lit(low), F.lit(high)) for low, high in sorted(set(bounds))])
        cells += [F.lit(columns.index(n)), F.when(inside, value)]
    stacked = narrow.select(F.stack(F.lit(len(brackets)), *cells)).toDF("source", "value").where("value IS NOT NULL")
    counted = stacked.groupBy("source", "value").agg(F.count(F.lit(1)).alias("rows"))
    totals = {n: counts[f"n_{i}"] for i, n in enumerate(columns)}
    targets = [t for t in targets if totals[t[1]]]
    if not targets:
        return df.sparkSession.createDataFrame([], "column string, q array<double>")

    wanted = small_table(
        df.sparkSession,
        [(t, columns.index(n), low, high, counts[f"c_{t}"], (totals[n] - 1) * probabilities[j]) for t, n, j, low, high in targets],
        "id int, source int, low double, high double, below bigint, position double",
    )
    inner = counted.join(F.broadcast(wanted), "source").where("value BETWEEN low AND high")  # one row per percentile
    running = Window.partitionBy("id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = inner.withColumn("upto", F.col("below") + F.sum("rows").over(running))
    placed = placed.withColumn("from", F.col("upto") - F.col("rows"))
    hits = [
        F.max(F.when((r >= F.col("from")) & (r < F.col("upto")), F.col("value"))).alias(name)
        for name, r in (("lo", F.floor("position")), ("hi", F.ceil("position")))
    ]
    picked = {r["id"]: (r["lo"], r["hi"]) for r in placed.groupBy("id").agg(*hits).collect()}

    found: dict[str, list] = {}
    for number, n, j, _, _ in targets:
        lo, hi = picked.get(number, (None, None))
        if lo is None or hi is None:
            raise RuntimeError(f"a rank of column {n} lies outside its bracket")
        position = (totals[n] - 1) * probabilities[j]
        share = position - int(position)
        found.setdefault(n, []).append(lo if share == 0 else (1 - share) * lo + share * hi)
    return small_table(df.sparkSession, list(found.items()), "column string, q array<double>")


def _bracket_counts(narrow: DataFrame, columns: list[str], targets: list[tuple]):
    """Per target the rows below (``c_``) and inside (``i_``) its bracket, per column all (``n_``)."""
    value = {n: F.col(f"v_{i}") for i, n in enumerate(columns)}
    return narrow.agg(
        *[F.count_if(value[n] < F.lit(low)).alias(f"c_{t}") for t, n, _, low, _ in targets],
        *[F.count_if(value[n].between(F.lit(low), F.lit(high))).alias(f"i_{t}") for t, n, _, low, high in targets],
        *[F.count(value[n]).alias(f"n_{i}") for i, n in enumerate(columns)],
    ).first()


def _narrower(
    narrow: DataFrame, columns: list[str], probabilities: list[float], targets: list[tuple], counts, shares: dict[int, Column]
) -> list[tuple]:
    """The brackets in ``shares`` cut to about four of ``GRID`` steps around their rank, placed by
    a sample of the rows inside them. A bracket that would lose its rank shows in the next counts
    and is left as it was."""
    cells = []
    for t, n, _, low, high in targets:
        if t in shares:
            value = F.col(f"v_{columns.index(n)}")
            cells += [F.lit(t), F.when(value.between(F.lit(low), F.lit(high)) & (F.rand(42 + t) < shares[t]), value)]
    drawn = narrow.select(F.stack(F.lit(len(shares)), *cells)).toDF("id", "value").where("value IS NOT NULL")
    steps = [i / GRID for i in range(GRID + 1)]
    grids = {r["id"]: r["g"] for r in drawn.groupBy("id").agg(F.percentile_approx("value", steps, ACCURACY).alias("g")).collect()}
    proposed = []
    for t, n, j, low, high in targets:
        grid = grids.get(t)
        if grid:
            rank = (counts[f"n_{columns.index(n)}"] - 1) * probabilities[j] - counts[f"c_{t}"]
            at = int(rank / counts[f"i_{t}"] * GRID)
            low = grid[at - 2] if at - 2 > 0 else low
            high = grid[at + 3] if at + 3 < GRID else high
        proposed.append((t, n, j, low, high))
    check = _bracket_counts(narrow, columns, proposed)
    kept = []
    for old, new in zip(targets, proposed):
        rank = (check[f"n_{columns.index(new[1])}"] - 1) * probabilities[new[2]]
        first, beyond = check[f"c_{new[0]}"], check[f"c_{new[0]}"] + check[f"i_{new[0]}"]
        kept.append(new if first <= rank and rank + 1 < beyond else old)
    return kept


def _by_group(df: DataFrame, columns: list[str], probabilities: list[float], keys: tuple[str, ...], sketch: DataFrame | None) -> DataFrame:
    """Percentiles per group: brackets by a sketch of each group, ranks below them, values inside them."""
    if sketch is None:
        sketch = df.groupBy(*[col(k) for k in keys]).agg(*sketches(df, columns, probabilities))
    names = [f"key_{i}" for i in range(len(keys))]
    renamed = [col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    narrow = df.select(*renamed, *[present(df, c).cast("double").alias(f"v_{i}") for i, c in enumerate(columns)])
    every = [(i, j) for i in range(len(columns)) for j in range(len(probabilities))]
    bounds = []
    for i, j in every:
        low, high, n = F.lit(float("-inf")), F.lit(float("inf")), F.col(f"sketch_n_{i}")
        for k, (least, share) in reversed(list(enumerate(_margins()))):
            at = 2 * (j * len(_margins()) + k)
            low = F.when(n >= least, F.get(f"sketch_{i}", F.lit(at)) if probabilities[j] - share > 0 else F.lit(float("-inf"))).otherwise(low)
            high = F.when(n >= least, F.get(f"sketch_{i}", F.lit(at + 1)) if probabilities[j] + share < 1 else F.lit(float("inf"))).otherwise(high)
        bounds += [low.alias(f"low_{i}_{j}"), high.alias(f"high_{i}_{j}")]
    brackets = staged(sketch.select(*renamed, *[F.col(f"sketch_n_{i}").alias(f"n_{i}") for i in range(len(columns))], *bounds), "percentile-brackets")
    few = brackets.count() * len(every) <= BROADCAST_BRACKETS
    joined = narrow.join(F.broadcast(brackets) if few else brackets, names)

    below = joined.groupBy(*names).agg(*[F.count_if(F.col(f"v_{i}") < F.col(f"low_{i}_{j}")).alias(f"below_{i}_{j}") for i, j in every])
    per_target = [
        F.struct(
            F.lit(i).alias("source"), F.lit(j).alias("j"), F.col(f"low_{i}_{j}").alias("low"), F.col(f"high_{i}_{j}").alias("high"),
            F.col(f"below_{i}_{j}").alias("below"), ((F.col(f"n_{i}") - 1) * F.lit(float(probabilities[j]))).alias("position"),
        )
        for i, j in every
    ]
    targets = brackets.join(below, names).select(*names, F.inline(F.array(*per_target)))

    inside = {i: reduce(Column.__or__, [F.col(f"v_{i}").between(F.col(f"low_{i}_{j}"), F.col(f"high_{i}_{j}")) for j in range(len(probabilities))]) for i in range(len(columns))}
    hit = joined.where(reduce(Column.__or__, inside.values()))
    cells = [c for i in inside for c in (F.lit(i), F.when(inside[i], F.col(f"v_{i}")))]
    stacked = hit.select(*names, F.stack(F.lit(len(columns)), *cells).alias("source", "value")).where("value IS NOT NULL")
    counted = stacked.groupBy(*names, "source", "value").agg(F.count(F.lit(1)).alias("rows"))

    inner = counted.join(targets, [*names, "source"]).where("value BETWEEN low AND high")
    running = Window.partitionBy(*names, "source", "j").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = inner.withColumn("upto", F.col("below") + F.sum("rows").over(running)).withColumn("from", F.col("upto") - F.col("rows"))
    picks = []
    for side, rank in (("lo", F.floor("position")), ("hi", F.ceil("position"))):
        picks.append(F.max(F.when((rank >= F.col("from")) & (rank < F.col("upto")), F.col("value"))).alias(side))
    found = placed.groupBy(*names, "source", "j").agg(F.first("position").alias("position"), *picks)
    share = F.col("position") - F.floor("position")
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    blended = F.when(F.col("lo").isNull() | F.col("hi").isNull(), missed).when(share == 0, F.col("lo")).otherwise((1 - share) * F.col("lo") + share * F.col("hi"))
    each = found.groupBy(*names, "source").agg(F.sort_array(F.collect_list(F.struct("j", blended.alias("q"))))["q"].alias("q"))
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("source") + 1).alias("column")
    return each.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], named, "q")


def percentile_values(df: DataFrame, columns: list[str], probability: float, direct_rows: int | None = None) -> dict:
    """One percentile per column as plain numbers (columns without values are left out)."""
    rows = percentiles(df, columns, [probability], direct_rows=direct_rows).collect()
    return {r["column"]: r["q"][0] for r in rows}
