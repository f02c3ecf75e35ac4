"""K-Means with several starts per scan, cluster profiles and silhouettes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import col, present, small_table
from tabulon.session import small_batches, staged

# Model defaults.
SEED = 42
STARTS = 10
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
MIN_CLUSTERS, MAX_CLUSTERS, DEFAULT_CLUSTERS = 2, 12, 3

SEED_ROUNDS = 4  # rounds in which candidates for the first centres are drawn
SILHOUETTE_METRIC = "squared_euclidean"
SLICE_ROWS = 2048  # rows of a K-Means block that are worked on at once
BLOCK_ROWS = 1024  # points that are compared with as many at once
DIRECT_TASKS = 1024  # tasks whose sums the driver adds up itself (starts x clusters rows each)
GROUP_BLOCKS = 16  # blocks that meet another one in the same task
BROADCAST_NEEDED = 1_000_000  # pairs of groups and labels (12 MB); more are joined by a shuffle


@dataclass(frozen=True)
class KMeansModel:
    features: list[str]
    centers: np.ndarray
    cost: float
    costs: list[float]  # one per start
    sizes: list[int]
    iterations: int


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centre."""
    cross = rows @ centers.T
    return np.maximum((rows**2).sum(1)[:, None] - 2 * cross + (centers**2).sum(1)[None, :], 0.0)


def _first_centers(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ among weighted candidates: each further centre is drawn with weight times squared distance to the nearest one."""
    chosen = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
    nearest = _distances(candidates, chosen[0][None, :])[:, 0]
    while len(chosen) < k:
        pull = nearest * weights
        pick = rng.choice(len(candidates), p=pull / pull.sum()) if pull.sum() > 0 else rng.integers(len(candidates))
        chosen.append(candidates[pick])
        nearest = np.minimum(nearest, _distances(candidates, chosen[-1][None, :])[:, 0])
    return np.array(chosen)


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of all blocks, ``SLICE_ROWS`` at a time: what is computed on a slice stays in a core's cache."""
    for batch in batches:
        for block in batch.column("block"):
            rows = np.frombuffer(block.as_buffer()).reshape(-1, width)
            for low in range(0, len(rows), SLICE_ROWS):
                yield rows[low : low + SLICE_ROWS]


def _draws(rows: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for every row, from its values and ``salt`` alone: draws do not depend on how a table is partitioned."""
    h = np.full(len(rows), salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for column in (np.ascontiguousarray(rows.T) + 0.0).view(np.uint64):
        h ^= column
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(31)
    h >>= np.uint64(11)
    draw = h.astype(float)
    draw += 0.5
    draw *= 2.0**-53
    return draw


def _relative(centers: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """|x - c|^2 less |x|^2 as a row per centre; ``columns`` are those of the points, and one of ones."""
    return np.column_stack([-2 * centers, (centers**2).sum(1)]) @ columns


def _with_ones(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([rows, np.ones(len(rows))])


def _least_keys(rows: np.ndarray, weight: np.ndarray, salt: int, below: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys less than ``below`` and their rows; a row's key is -log(draw) / weight."""
    draw = _draws(rows, salt)
    if np.isfinite(below):  # -log(x) is 1 - x at least: few rows are left that need a logarithm
        at = np.flatnonzero(1.0 - draw <= weight * (below * (1 + 1e-9)))
        rows, weight, draw = rows[at], weight[at], draw[at]
    usable = weight > 1e-12
    key = -np.log(draw[usable]) / weight[usable]
    return key[key < below], rows[usable][key < below]


def _drawn(blocks: DataFrame, features: list[str], known: dict[int, np.ndarray], many: int, salt: int, few: bool = False) -> dict[int, np.ndarray]:
    """``many`` further rows per start, drawn from the whole table in one scan with weight = squared distance to the nearest known
    row (equal weights where none is known). A row's key is -log(draw) / weight, and the smallest keys win, in tasks and over all."""
    width = len(features)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: (np.zeros(0), np.zeros((0, width))) for s in known}
        for rows in _slices(batches, width):
            columns, squares = _with_ones(rows).T, (rows**2).sum(1)
            for start, near in known.items():
                had, points = held[start]
                weight = np.maximum(_relative(near, columns).min(axis=0) + squares, 0.0) if len(near) else np.ones(len(rows))
                # Only keys below the largest one held can come in. Equal rows have equal keys and count once.
                key, new = _least_keys(rows, weight, salt + 1009 * start, had[-1] if len(had) == many else np.inf)
                if len(key):
                    key, first = np.unique(np.r_[had, key], return_index=True)
                    held[start] = key[:many], np.r_[points, new][first[:many]]
        for start, (key, point) in held.items():
            if len(key):
                points = pa.array([p.tobytes() for p in point], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([start] * len(key), pa.int32()), pa.array(key), points], ["start", "key", "point"])

    found = blocks.mapInArrow(best, "start int, key double, point binary")
    if not few:
        rank = F.row_number().over(Window.partitionBy("start").orderBy("key", "point"))
        found = found.distinct().withColumn("rank", rank).where(F.col("rank") <= many)
    out: dict[int, list] = {s: [] for s in known}
    for start, _, point in sorted({(r["start"], r["key"], bytes(r["point"])) for r in found.collect()}):
        if len(out[start]) < many:
            out[start].append(np.frombuffer(point))
    return {s: np.array(points).reshape(-1, width) for s, points in out.items()}


def _initial_centers(blocks: DataFrame, features: list[str], k: int, starts: int, seed: int, few: bool = False) -> dict[int, np.ndarray]:
    """First centres by k-means|| over the whole table, all starts in the same scans.

    One row per start, then ``SEED_ROUNDS`` rounds of 2 k rows each far from those there are; rows are counted by their
    nearest candidate, and k-means++ chooses k of the weighted candidates. The driver holds the candidates only.
    """
    known = {s: np.zeros((0, len(features))) for s in range(starts)}
    for turn in range(SEED_ROUNDS + 1):
        more = _drawn(blocks, features, known, 2 * k if turn else 1, seed + 7919 * turn, few)
        known = {s: np.r_[known[s], more[s]] for s in known}
    width = max(map(len, known.values()))
    padded = {s: np.r_[c, np.full((width - len(c), len(features)), 1e150)] for s, c in known.items()}
    counts = _scan(blocks, features, padded, few=few, counts_only=True)
    rng = np.random.default_rng(seed)
    return {s: _first_centers(known[s], np.maximum(counts[s][0][: len(known[s])], 1e-9), k, rng) for s in known}


def _blocks(data: DataFrame, features: list[str]) -> DataFrame:
    """The feature rows as binary blocks of doubles, one per Arrow batch: repeated scans then move
    a few large values instead of many rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = np.ascontiguousarray(_matrix(batch, features), dtype=np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    return data.mapInArrow(pack, "block binary")


def _scan(
    blocks: DataFrame, features: list[str], centers: dict[int, np.ndarray], with_cost: bool = False, few: bool = False, counts_only: bool = False
) -> dict[int, tuple]:
    """One scan for all starts: per (start, cluster) row count, feature sums and cost (zero where not asked for).

    Tasks return one row per start and cluster. Spark adds them up, so the driver receives starts x clusters
    rows whatever the size of the data; those of ``few`` tasks (``DIRECT_TASKS`` at most) it adds up itself, which saves a shuffle.
    """
    starts = sorted(centers)
    k = len(next(iter(centers.values())))
    stacked = np.vstack([centers[s] for s in starts])
    sums = [f"s_{i}" for i in range(len(features))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(starts), k))
        totals = np.zeros((len(starts), k, len(features)))
        costs = np.zeros((len(starts), k))
        width = len(features)
        numbers = np.arange(k, dtype=np.int16)[:, None]
        seen = False
        for rows in _slices(batches, width):
            seen = True
            points = _with_ones(rows)
            relative = _relative(stacked, points.T).reshape(len(starts), k, len(rows))  # has the same nearest centre
            nearest, labels = relative[:, 0].copy(), np.zeros((len(starts), len(rows)), np.int16)
            for number in range(1, k):  # the lowest number wins ties
                less = relative[:, number] < nearest
                np.maximum(labels, less.view(np.int8) * np.int16(number), out=labels)
                np.minimum(nearest, relative[:, number], out=nearest)
            if counts_only:
                counts += np.stack([np.bincount(x, minlength=k) for x in labels])
                continue
            member = (labels[:, None, :] == numbers).astype(float)
            sums_of = member.reshape(-1, len(rows)) @ points
            totals += sums_of[:, :-1].reshape(totals.shape)
            counts += sums_of[:, -1].reshape(counts.shape)
            if with_cost:
                costs += np.einsum("skr,sr->sk", member, np.maximum(nearest + (rows**2).sum(1), 0.0))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(starts, k), pa.int32()),
                    pa.array(np.tile(np.arange(k), len(starts)), pa.int32()),
                    pa.array(counts.ravel()),
                    pa.array(costs.ravel()),
                    *[pa.array(totals[:, :, i].ravel()) for i in range(len(features))],
                ],
                names=["start", "cluster", "n", "cost", *sums],
            )

    fields = ", ".join(f"{s} double" for s in sums)
    merged = blocks.mapInArrow(partial, f"start int, cluster int, n double, cost double, {fields}")
    if not few:
        merged = merged.groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)])
    found: dict[int, tuple] = {s: (np.zeros(k), np.zeros((k, len(features))), np.zeros(k)) for s in starts}
    for row in merged.collect():
        counts, totals, costs = found[row["start"]]
        counts[row["cluster"]] += row["n"]
        costs[row["cluster"]] += row["cost"]
        totals[row["cluster"]] += [row[s] for s in sums]
    return found


def _farthest(blocks: DataFrame, features: list[str], centers: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` different rows farthest from their nearest centre (ties by their bytes)."""
    width = len(features)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, points = np.zeros(0), np.zeros((0, width))
        for rows in (np.frombuffer(b.as_py()).reshape(-1, width) for batch in batches for b in batch.column("block")):
            points = np.unique(np.r_[points, rows], axis=0)
            best = _distances(points, centers).min(axis=1)
            order = np.argsort(-best, kind="stable")[:many]
            best, points = best[order], points[order]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array([p.tobytes() for p in points], pa.binary())], ["d", "point"])

    top = blocks.mapInArrow(far, "d double, point binary").distinct().orderBy(F.desc("d"), "point").limit(many).collect()
    return np.array([np.frombuffer(r["point"]) for r in top]).reshape(-1, width)


def fit_kmeans(
    df: DataFrame,
    features: list[str],
    k: int = DEFAULT_CLUSTERS,
    starts: int = STARTS,
    seed: int = SEED,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    initial=None,
) -> KMeansModel:
    """Lowest-cost K-Means of ``starts`` runs; ``features`` are double columns without NULL.

    All unfinished starts move in the same scan. A start stops when its centres move less than
    ``tolerance`` times the mean feature variance (never, if that is negative). A centre without rows moves to a row
    farthest from its centre; with fewer different rows than clusters it stays. Clusters are numbered by size, largest
    first. ``initial`` gives the first centres of a single start. The packed features are written to the shared folder
    once, and every scan reads them from there.
    """
    if not MIN_CLUSTERS <= k <= MAX_CLUSTERS:
        raise ValueError(f"k must be between {MIN_CLUSTERS} and {MAX_CLUSTERS}")
    data = df.select(*[col(f).cast("double").alias(f) for f in features])
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = staged(_blocks(data, features).repartition(cores), "kmeans-blocks")
    few = blocks.rdd.getNumPartitions() <= DIRECT_TASKS
    one = data.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(col(f)).alias(f"v_{i}") for i, f in enumerate(features)]).first()
    if one["n"] < k:
        raise ValueError(f"{one['n']} rows are too few for {k} clusters")
    limit = tolerance * sum(one[f"v_{i}"] for i in range(len(features))) / len(features)
    with small_batches(df.sparkSession):  # so that Spark reads on while Python computes
        if initial is not None:
            centers = {0: np.array(initial, dtype=float)}
        else:
            centers = _initial_centers(blocks, features, k, starts, seed, few)
        active = dict(centers)
        iterations = 0
        while active and iterations < max_iterations:
            iterations += 1
            for start, (counts, totals, _) in _scan(blocks, features, active, few=few).items():
                moved = np.where(counts[:, None] > 0, totals / np.maximum(counts, 1)[:, None], centers[start])
                empty = np.flatnonzero(counts == 0)
                if len(empty):
                    far = _farthest(blocks, features, moved[counts > 0], len(empty))
                    far = far[_distances(far, moved[counts > 0]).min(axis=1) > 0]
                    moved[empty[: len(far)]] = far
                shift = float(((moved - centers[start]) ** 2).sum())
                centers[start] = moved
                active[start] = moved
                if shift <= limit:
                    del active[start]
        final = _scan(blocks, features, centers, with_cost=True, few=few)
    costs = [float(final[s][2].sum()) for s in sorted(centers)]
    best = int(np.argmin(costs))
    sizes = final[best][0]
    order = sorted(range(k), key=lambda c: (-sizes[c], tuple(centers[best][c])))
    return KMeansModel(features, centers[best][order], costs[best], costs, [int(sizes[c]) for c in order], iterations)


def nearest_center(features: list[str], centers) -> Column:
    """Number of the nearest centre (lowest number on ties), as one native expression."""
    options = []
    for number, center in enumerate(centers):
        distance = sum(((col(f) - F.lit(float(x))) * (col(f) - F.lit(float(x))) for f, x in zip(features, center)), F.lit(0.0))
        options.append(F.struct(distance.alias("distance"), F.lit(number).alias("number")))
    return F.least(*options)["number"] if len(options) > 1 else F.lit(0)


def assign_clusters(df: DataFrame, features: list[str], centers) -> DataFrame:
    return df.withColumn("cluster", nearest_center(features, centers))


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def cluster_profile(df: DataFrame, columns: list[str], label: str = "cluster", digits: int = 3) -> DataFrame:
    """Mean of the original values per cluster; missing values are skipped, infinities are not."""
    means = [F.round(F.avg(present(df, c)), digits).alias(c) for c in columns]
    return df.groupBy(col(label)).agg(*means).orderBy(label)


# --- silhouette -----------------------------------------------------------------------------


@dataclass(frozen=True)
class SilhouetteBlocks:
    """Rows in blocks of one label and one set of candidate clusters, and which groups of blocks have to meet which label.

    ``blocks``: ``code`` (of the label), ``grp``, ``candidates`` (a bit per code), ``block`` (rows as doubles). ``needed``: ``grp``, ``code``.
    """

    labels: list
    sizes: np.ndarray
    blocks: DataFrame
    needed: DataFrame

    def pairs(self) -> tuple[int, int]:
        """Pairs of blocks that are compared, and all there are."""
        both = self.blocks.groupBy("grp").count().join(self.needed, "grp").join(self.blocks.groupBy("code").agg(F.count("*").alias("targets")), "code")
        return both.agg(F.sum(F.col("count") * F.col("targets"))).first()[0] or 0, self.blocks.count() ** 2


def _candidates(rows: np.ndarray, own: np.ndarray, centers: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Which clusters may be the nearest other one of each row (rows x clusters).

    The mean distance from a row to a cluster is at least the distance d to its centre and at most sqrt(d^2 + spread), where spread is the cluster's
    mean squared distance to its centre. A cluster whose least value lies above another one's largest can't be the nearest.
    """
    squared = np.stack([((rows - c) ** 2).sum(axis=1) for c in centers], axis=1)
    least, most = np.sqrt(squared), np.sqrt(squared + spread)
    most[np.arange(len(rows)), own] = np.inf
    possible = ~(least > most.min(axis=1)[:, None] * (1 + 1e-9))  # NaN: possible
    possible[np.arange(len(rows)), own] = False
    return possible


def silhouette_blocks(df: DataFrame, features: list[str], label: str = "cluster") -> SilhouetteBlocks:
    """The plan of :func:`silhouette_rows`; one scan for the clusters' centres (they are collected: labels x features), one to pack the rows."""
    width = len(features)
    points = df.select(col(label).alias("label"), *[col(f).cast("double").alias(f"x_{i}") for i, f in enumerate(features)]).where("label IS NOT NULL")
    moments = [F.struct(F.avg(f"x_{i}").alias("mean"), F.var_pop(f"x_{i}").alias("var")).alias(f"m_{i}") for i in range(width)]
    found = points.groupBy("label").agg(F.count(F.lit(1)).alias("size"), *moments).orderBy("label").collect()
    labels, sizes = [r["label"] for r in found], np.array([r["size"] for r in found], np.int64)
    # A missing feature leaves its clusters without bounds, so that they stay candidates.
    number = lambda v: np.nan if v is None else v
    centers = np.array([[number(r[f"m_{i}"]["mean"]) for i in range(width)] for r in found]).reshape(len(found), width)
    spread = np.array([sum(number(r[f"m_{i}"]["var"]) for i in range(width)) for r in found])
    codes = small_table(df.sparkSession, [(v, i) for i, v in enumerate(labels)], f"label {points.schema['label'].dataType.simpleString()}, code int")
    columns = [f"x_{i}" for i in range(width)]
    coded = points.join(F.broadcast(codes), "label").select("code", *columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(low, BLOCK_ROWS)
                own = batch.column("code").to_numpy()
                bits = np.packbits(_candidates(_matrix(batch, columns), own, centers, spread), axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary())], [*batch.schema.names, "candidates"])

    schema = f"code int, {', '.join(f'{c} double' for c in columns)}, candidates binary"
    judged = coded.mapInArrow(judge, schema).withColumn("draw", F.xxhash64(*columns))
    order = judged.repartitionByRange("code", "candidates", "draw").sortWithinPartitions("code", "candidates")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, blocks, key, held, count = TaskContext.get().partitionId() << 33, 0, None, [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([number]), pa.array([key[1]], pa.binary()), pa.array([np.concatenate(held).tobytes()], pa.binary())],
                names=["code", "grp", "candidates", "block"],
            )

        for batch in batches:
            rows, code, bits = _matrix(batch, columns), batch.column("code").to_numpy(), batch.column("candidates").to_pylist()
            low = 0
            while low < len(rows):
                this = (int(code[low]), bits[low])
                if this != key or count == BLOCK_ROWS:
                    if count:
                        yield block()
                        blocks += 1
                        if this != key or blocks == GROUP_BLOCKS:
                            number, blocks = number + 1, 0
                    key, held, count = this, [], 0
                high = low
                while high < len(rows) and high - low < BLOCK_ROWS - count and (int(code[high]), bits[high]) == key:
                    high += 1
                held.append(rows[low:high])
                count, low = count + high - low, high
        if count:
            yield block()

    blocks = staged(order.drop("draw").mapInArrow(pack, "code int, grp bigint, candidates binary, block binary"), "silhouette-blocks")
    groups = blocks.select("grp", "code", "candidates").distinct()
    wanted = F.array(*[F.when((F.col("code") == c) | F.expr(f"shiftright(conv(hex(substring(candidates, {c // 8 + 1}, 1)), 16, 10)::int, {c % 8}) & 1 = 1"), c) for c in range(len(labels))])
    needed = groups.select("grp", F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("code"))
    return SilhouetteBlocks(labels, sizes, blocks, needed)


def silhouette_rows(df: DataFrame, features: list[str], label: str = "cluster") -> DataFrame:
    """Exact Euclidean silhouette per row: ``(label, silhouette)``; no rows unless 2 <= labels <= rows - 1.

    A row needs its mean distance to its own cluster and to the nearest other one. Bounds from the centres tell which
    others can be the nearest (:func:`_candidates`), and only their blocks are sent. Rows of one label and with the same candidates
    form groups of up to 16 blocks; a task holds one group and streams the blocks it has to meet past it, so pairs are never rows
    and sums are complete where they arise. Work still grows with the square of the clusters: :func:`silhouette_squared` is linear.
    """
    plan = silhouette_blocks(df, features, label)
    kind, width, sizes = df.schema[label].dataType.simpleString(), len(features), plan.sizes
    names = small_table(df.sparkSession, [(v, i) for i, v in enumerate(plan.labels)], f"label {kind}, code int")
    if not 2 <= len(sizes) < sizes.sum():
        return names.select("label", F.lit(0.0).alias("silhouette")).where("false")
    needed = plan.needed.withColumnRenamed("grp", "target")
    if needed.count() <= BROADCAST_NEEDED:
        needed = F.broadcast(needed)
    sent = plan.blocks.select("code", "block").join(needed, "code").select(F.col("target").alias("grp"), F.lit(1).alias("part"), "code", "block")
    own = plan.blocks.select("grp", F.lit(0).alias("part"), "code", "block")
    together = own.union(sent).repartition("grp").sortWithinPartitions("grp", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, rows, total, code = None, [], None, None, 0

        def result():
            counts = sizes.astype(float).copy()
            counts[code] = max(counts[code] - 1, 1)
            mean = np.full((len(rows), len(sizes)), np.inf)
            met = sorted(total)
            for c in met:
                mean[:, c] = total[c] / counts[c]
            inner = mean[:, code].copy()
            mean[:, code] = np.inf
            outer = np.minimum.reduce(mean, axis=1)
            larger = np.maximum(inner, outer)
            score = np.divide(outer - inner, larger, out=np.zeros(len(rows)), where=larger != 0)
            if sizes[code] == 1:
                score[:] = 0.0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), code, np.int32)), pa.array(score)], names=["code", "silhouette"])

        for batch in batches:
            for i in range(batch.num_rows):
                at, part, label_code = (batch.column(c)[i].as_py() for c in ("grp", "part", "code"))
                block = np.frombuffer(batch.column("block")[i].as_buffer()).reshape(-1, width)
                if at != group:
                    if group is not None:
                        yield result()
                    group, held, rows, total, code = at, [], None, {}, label_code
                if part == 0:
                    held.append(block.copy())
                    continue
                if rows is None:
                    rows = np.concatenate(held)
                sums = np.concatenate([np.sqrt(_distances(rows[low : low + BLOCK_ROWS], block)).sum(axis=1) for low in range(0, len(rows), BLOCK_ROWS)])
                total[label_code] = total.get(label_code, 0.0) + sums
        if group is not None:
            yield result()

    scored = together.mapInArrow(compare, "code int, silhouette double")
    return scored.join(F.broadcast(names), "code").select("label", "silhouette")


def silhouette_squared(df: DataFrame, features: list[str], label: str = "cluster") -> float | None:
    """Silhouette with squared distances: linear in the rows, a different number. None unless 2 <= labels <= rows - 1."""
    found = df.agg(F.count_distinct(col(label)).alias("labels"), F.count(F.lit(1)).alias("rows")).first()
    if not 2 <= found["labels"] <= found["rows"] - 1:
        return None
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(df).select("v", col(label).cast("int").alias("p"))
    return ClusteringEvaluator(featuresCol="v", predictionCol="p").evaluate(vectors)


def silhouette(df: DataFrame, features: list[str], label: str = "cluster", metric: str = SILHOUETTE_METRIC) -> float | None:
    """The mean silhouette by ``metric``: ``squared_euclidean`` (linear work) or ``euclidean`` (every pair of rows)."""
    if metric == "squared_euclidean":
        return silhouette_squared(df, features, label)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    return silhouette_rows(df, features, label).agg(F.avg("silhouette")).first()[0]
