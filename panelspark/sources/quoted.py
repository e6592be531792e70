"""Delimited text whose quotes may hold line breaks, read by many tasks.

Spark's text source cuts a file into byte ranges, each with the lines that begin in it. A line break is the end of a row where an
even number of quotes stands before it, so pass 1 counts, for each range, its quotes and how many rows begin in it under either
parity; the parities at the ranges' beginnings are prefix sums over that table (a row a range). In pass 2 each task joins the
lines of its ranges to rows; what crosses the border of a range, at most an end and a beginning each, is put together by Spark.
Rows are parsed by from_csv, so the cells are what the CSV source gives with multiLine, for files in which quotes stand in pairs (those
inside quotes doubled). Gzip can't be cut: such a file is one range and one task, read line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from panelspark.operators.spread import BROADCAST_ROWS
from panelspark.sources import readers
from panelspark.sources.staging import staged


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, start of the range), first line, end) of the stretches of a batch."""
    files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    code = np.asarray(files.indices)
    edges = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield (files.dictionary[int(code[a])].as_py(), int(starts[a])), a, b


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        quotes = pc.count_substring(batch.column(2), '"').to_numpy()
        for key, a, b in _runs(batch):
            known = sums.setdefault(key, [0, 0, 0])
            odd = (known[0] + np.cumsum(quotes[a:b]) - quotes[a:b]) % 2
            known[0] += int(quotes[a:b].sum())
            known[1] += int((odd == 0).sum())
            known[2] += int((odd == 1).sum())
    keys = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(3)]],
        names=["file", "start", "quotes", "rows_even", "rows_odd"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, part, first, row): part 0 are whole rows, 1 the end of a row of an earlier range, 2 the last row that begins in the
    range; first is the first row of a file."""
    at, parity, held, begun, seen = None, 0, [], False, 0
    out: list[tuple] = []

    def closed(part: int) -> None:
        if held or part == 2:
            out.append((*at, part, begun and at[1] == 0 and seen == 1, "\n".join(held)))

    def sent() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "start", "part", "first", "row"])
        out.clear()
        return batch

    for batch in batches:
        lines, quotes, odd = batch.column(2).to_pylist(), pc.count_substring(batch.column(2), '"').to_numpy(), batch.column(3).to_pylist()
        for key, a, b in _runs(batch):
            if key != at:
                if at is not None:
                    closed(2 if begun else 1)
                at, parity, held, begun, seen = key, int(odd[a]), [], False, 0
            for i in range(a, b):
                if parity % 2 == 0:
                    if begun or held:
                        closed(0 if begun else 1)
                    held, begun, seen = [], True, seen + 1
                held.append(lines[i])
                parity += int(quotes[i])
        yield sent()
    if at is not None:
        closed(2 if begun else 1)
    yield sent()


def read(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as strings, as readers.delimited gives them, but each file by as many tasks as it has ranges of
    spark.sql.files.maxPartitionBytes. There is a row in memory for each range: at most BROADCAST_ROWS ranges a call."""
    options = {"sep": sep or readers.sniff_delimiter(spark, path), "quote": '"', "escape": '"'}
    names = [f.name for f in spark.read.csv(path, header=True, inferSchema=False, multiLine=True, **options).schema]
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    ranges = staged(lines.mapInArrow(_counted, "file string, start long, quotes long, rows_even long, rows_odd long"), "quoted-ranges")
    if ranges.count() > BROADCAST_ROWS:
        raise ValueError("too many ranges: raise spark.sql.files.maxPartitionBytes or read the files in several calls")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("odd"))
    marked = lines.join(F.broadcast(ranges), ["file", "start"]).select("file", "start", "line", "odd")
    parts = staged(marked.mapInArrow(_joined, "file string, start long, part int, first boolean, row string"), "quoted-rows")
    # the last row of a range goes on in the ends that follow it
    chain = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)
    cut = parts.filter("part > 0").withColumn("chain", F.sum((F.col("part") == 2).cast("int")).over(chain))
    whole = cut.groupBy("file", "chain").agg(F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "row"))), lambda x: x["row"]), "\n").alias("row"))
    rows = parts.filter("part = 0").select("first", "row").unionByName(whole.select("first", "row")).filter("not first")
    rows = rows.withColumn("row", F.regexp_replace("row", "\r$", "")).filter("row <> ''")
    bad = "__malformed"
    schema = StructType([StructField(n, StringType()) for n in [*names, bad]])
    cells = F.from_csv("row", ", ".join(f"`{f.name}` string" for f in schema), {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "maxCharsPerColumn": "-1"})
    return rows.select(cells.alias("c")).filter(F.col(f"c.{bad}").isNull()).select(*[F.col(f"c.`{n}`").alias(n) for n in names])
