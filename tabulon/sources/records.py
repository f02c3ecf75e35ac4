"""Records of CSV files whose quoted values may hold line breaks, found in byte ranges of the files.

Spark cuts text files into byte ranges and gives each line to the range it starts in. A range alone can't tell whether its first line
begins a record or lies within a quoted value, but there are only these two cases:

1. every range says for both of them how its last line leaves the next one (one row per range);
2. ranges in file order tell which case holds for each, by the last range that ends alike in both cases and the changes since;
3. every range then emits its own records. Only records that cross a range's end are put together from pieces, two per range at most.

A record is one value and must fit into a row; nothing else depends on the size of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.session import staged

WHOLE, BEGUN, ENDED, THROUGH = range(4)  # records, and pieces: begins here, ends here, neither


def quote_open_after(line: str, inside: bool) -> bool:
    """Whether a quoted value is still open at the end of ``line``; ``inside`` says whether one is at its beginning.

    A quote opens a value only as its first character. Within, two quotes are one; a single one closes it, and what
    follows up to the next comma belongs to an unquoted value.
    """
    at, size = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at, inside = at + 2, True
            continue
        inside = False
        at = line.find(",", at) + 1
        if not at or at > size:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``file`` and ``start`` (of the byte range) in the order of the file within each task."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.col("value").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Parts of a batch that come from one range."""
    file, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start"))
    if len(file):
        edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)], strict=True):
            yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def _quoted(lines: pa.Array) -> list[tuple[int, str]]:
    """The lines that hold a quote, with their places."""
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    return list(zip(at.tolist(), lines.take(pa.array(at)).to_pylist(), strict=True))


def range_states(lines: DataFrame) -> DataFrame:
    """``file``, ``start``, ``inside`` (a quoted value is open where the range's first line begins) and ``first`` (the file's first record starts there)."""

    def ends(batches):
        now, states, filled = None, [False, True], False

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *states, filled)], ["file", "start", "outside_to", "inside_to", "filled"])

        for batch in batches:
            for place, part in _runs(batch):
                if place != now:
                    if now is not None:
                        yield out()
                    now, states, filled = place, [False, True], False
                found = part.column("line")
                for _, line in _quoted(found):
                    states = [quote_open_after(line, s) for s in states]
                filled = filled or not pc.all(pc.is_in(found, pa.array(["", "\r"]))).as_py()
        if now is not None:
            yield out()

    found = lines.mapInArrow(ends, "file long, start long, outside_to boolean, inside_to boolean, filled boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    same, swaps = F.col("outside_to") == F.col("inside_to"), (F.col("outside_to") & ~F.col("inside_to")).cast("int")
    found = found.withColumn("changes", F.sum(swaps).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(same, F.struct("outside_to", "changes")), ignorenulls=True).over(before)
    now, known = F.coalesce(F.last("changes").over(before), F.lit(0)), F.col("known")
    odd = (F.col("now") - F.coalesce(known["changes"], F.lit(0))) % 2 == 1
    found = found.withColumns({"known": last, "now": now})
    first = F.min(F.when(F.col("filled"), F.col("start"))).over(Window.partitionBy("file"))
    return found.select("file", "start", (F.coalesce(known["outside_to"], F.lit(False)) != odd).alias("inside"), F.coalesce(F.col("start") == first, F.lit(False)).alias("first"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files but for each file's first one (the header), as ``record``, whatever ranges they are read in.

    Values are quoted by ``"``, which is doubled inside them; lines end with ``\\n`` or ``\\r\\n``. Empty lines between records are
    no records. Reads the files once for the ranges' states and once more where records cross ranges; the result is lazy.
    """
    lines = _lines(spark, path)
    states = staged(range_states(lines), "csv-ranges")  # one row per byte range
    inside = [F.col(c).alias(f"{c}_") for c in ("file", "start")] + [F.col("inside"), F.col("first")]
    known = lines.join(F.broadcast(states.select(*inside)), (F.col("file") == F.col("file_")) & (F.col("start") == F.col("start_")), "left").drop("file_", "start_")

    def cut(batches):
        now, open_quote, begun, pending, header = None, False, False, [], False

        def out(rows):
            kinds, heads, texts = zip(*rows, strict=True)
            n = len(rows)
            columns = [pa.array([now[0]] * n), pa.array([now[1]] * n), pa.array(kinds, pa.int32()), pa.array(heads), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["file", "start", "kind", "header", "record"])

        def finished():
            """What a range ends with is a piece, unless its last record has ended."""
            if pending:
                yield out([(BEGUN if begun else THROUGH, header, "\n".join(pending))])

        for batch in batches:
            for place, part in _runs(batch):
                if place != now:
                    yield from finished()
                    if part.column("inside")[0].as_py() is None:
                        raise ValueError("the files changed while they were read")
                    now, open_quote, header = place, part.column("inside")[0].as_py(), part.column("first")[0].as_py()
                    begun, pending = not open_quote, []
                found = part.column("line")
                marks = _quoted(found)
                if not marks and not open_quote:  # every line is a record
                    begun = True
                    if pc.any(pc.ends_with(found, "\r")).as_py():
                        found = pc.replace_substring_regex(found, r"\r\z", "")
                    found = found.filter(pc.not_equal(found, ""))
                    if n := len(found):
                        columns = [np.full(n, now[0]), np.full(n, now[1]), np.full(n, WHOLE, np.int32), np.r_[header, np.zeros(n - 1, bool)]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), found.cast(pa.string())], ["file", "start", "kind", "header", "record"])
                        header = False
                    continue
                opens = np.zeros(len(found) + 1, bool)  # a quoted value is open before this line
                low = 0
                for at, line in marks:
                    opens[low : at + 1] = open_quote
                    open_quote, low = quote_open_after(line, open_quote), at + 1
                opens[low:] = open_quote
                texts = found.to_pylist()
                begins = np.flatnonzero(~opens[:-1]).tolist()
                rows, a = [], 0
                for b in [*begins, len(texts)]:
                    # Lines from a to b belong to one record (before the first beginning: to the one that is pending).
                    if b > a:
                        pending += texts[a:b]
                    if pending and (b < len(texts) or not open_quote):
                        text = "\n".join(pending).removesuffix("\r") if len(pending) > 1 else pending[0].removesuffix("\r")
                        if text or not begun:
                            rows.append((WHOLE if begun else ENDED, header and begun, text))
                            header = header and not begun
                        pending = []
                    if b < len(texts):
                        begun = True
                    a = b
                if rows:
                    yield out(rows)
        yield from finished()

    made = known.mapInArrow(cut, "file long, start long, kind int, header boolean, record string")
    whole = made.where((F.col("kind") == WHOLE) & ~F.col("header")).select("record")
    if states.where("inside").isEmpty():
        return whole
    in_order = Window.partitionBy("file").orderBy("start", F.col("kind") == BEGUN)
    pieces = made.where(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == BEGUN).cast("int")).over(in_order))
    parts = F.sort_array(F.collect_list(F.struct("start", F.col("kind") == BEGUN, "record")))
    joined = pieces.groupBy("file", "number").agg(F.max("header").alias("header"), F.array_join(parts["record"], "\n").alias("record"))
    crossing = staged(joined.where(~F.col("header")).select(F.regexp_replace("record", "\r$", "").alias("record")), "csv-crossing")
    return whole.union(crossing)
