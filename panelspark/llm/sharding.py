"""Sharding by histogram sort: probes are refined against exact byte counts until splitters are within tolerance, then one exchange.

A document's key is 64 bits: 44 of a hash of its text, then 20 of a hash of its id. So equal texts lie side by side (of 10^10
different texts one in some thousands has a stranger among them), and a group of copies that is larger than a shard is cut
between ids, in up to a million pieces. Law `bytes`: a document's size is its UTF-8 bytes plus 16,
and shards get sizes near equal.

Rounds: all keys are counted in 2**BITS intervals; the intervals that hold a splitter are counted again, each in as many parts
as make at most COUNTS together, until each splitter is off by at most `tolerance` of a shard or the interval is one key.
Each round is one map-side aggregation over (key, size), which were written once; the driver sees at most COUNTS counts of
it, however many documents and shards. The same rounds place the cuts of runs within shards, so that no task has to hold or
number a whole shard, and count the rows before each, so a row's slot is that count plus its place in its run. A run has
`run_bytes`, more where a shard would have over MAX_RUNS of them (its sort spills then). Texts move once: hashed by run,
sorted by key within it.

Defined results: a null text is empty (16 bytes) and has checksum 0; a null id hashes like ''; rows that repeat both id and
text share a key and a shard; columns named shard or slot are replaced; very long texts are rows like others; with an empty table nothing is returned.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import materialize, numbered

SHARDS, OVERHEAD, TOLERANCE, BITS = 40, 16, 0.001, 10
#: Bytes of a run, the piece of a shard that one task sorts.
RUN_BYTES, MAX_RUNS = 64 << 20, 256
#: Most counts of a round that the driver sees.
COUNTS = 1 << 18


def sort_key(doc_id: Column, text: Column) -> Column:
    """Unsigned order of 64 bits, kept in a long by turning the top bit."""
    high = F.shiftleft(F.xxhash64(F.coalesce(text, F.lit(""))), 20)
    low = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 20) - 1))
    return high.bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)))


def splitters(keys: DataFrame, wanted: list[float], tolerance: float) -> list[tuple[int, int, int]]:
    """For each wanted number of bytes (ascending): (key, bytes, rows) with the bytes and rows of all keys below that key.

    keys has columns key (from sort_key), size. A wanted number is met within tolerance bytes, or as near as keys allow.
    """
    done: dict[int, tuple[int, int, int]] = {}
    # open: start of an interval of keys -> (bytes before, rows before, places of the numbers that fall in it)
    open_, shift = {0: (0, 0, list(range(len(wanted))))}, 64
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    while open_ and shift > 0:
        last, shift = shift, max(0, shift - max(1, min(BITS, (COUNTS // len(open_)).bit_length() - 1)))
        rows = keys
        if last < 64:
            # as Arrow, since a list of rows would start further Python workers, and those stay in the executors' memory
            starts = keys.sparkSession.createDataFrame(pa.table({"__start": pa.array([s >> last for s in open_], pa.int64())}))
            rows = rows.join(F.broadcast(starts), F.shiftrightunsigned(unsigned, last) == F.col("__start"), "left_semi")  # at most a row per splitter
        counted = rows.groupBy(F.shiftrightunsigned(unsigned, shift).alias("p")).agg(F.sum("size"), F.count(F.lit(1))).collect()
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for p, size, n in counted:
            p = p % (1 << (64 - shift))
            parts.setdefault((p << shift) >> last << last if last < 64 else 0, []).append((p, size, n))
        following: dict[int, tuple[int, int, list[int]]] = {}
        for start, (size, n, places) in open_.items():
            edges = [(start, size, n)]  # what lies below each edge
            for p, more, rows_in in sorted(parts.get(start, [])):
                edges[-1] = (p << shift, *edges[-1][1:])
                edges.append(((p + 1) << shift, edges[-1][1] + more, edges[-1][2] + rows_in))
            sums = [e[1] for e in edges]
            for i in places:
                k = min(max(bisect_right(sums, wanted[i]) - 1, 0), len(edges) - 1)
                near = min(edges[k : k + 2], key=lambda e: abs(e[1] - wanted[i]))
                if abs(near[1] - wanted[i]) <= tolerance or shift == 0 or k + 1 >= len(edges):
                    done[i] = near
                else:
                    at = following.setdefault(edges[k][0] >> shift << shift, (edges[k][1], edges[k][2], []))
                    at[2].append(i)
        open_ = following
    return [done[i] for i in range(len(wanted))]


def _longs(values: list[int]) -> Column:
    """One constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _number_below(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds (below 2**31 of them) are at or below key: binary search without a Python worker."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    table = _longs(bounds)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


def shard_documents(documents: DataFrame, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE,
                    run_bytes: int = RUN_BYTES) -> DataFrame:
    """documents with shard (0 to shards - 1) and slot (0, 1, ... within a shard); shards are in key order."""
    documents = documents.drop("shard", "slot")
    columns = documents.columns
    documents, (doc_id, text) = numbered(documents, doc_id, text)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = sort_key(F.col(doc_id), content)
    keys = materialize(documents.select(key.alias("key"), (F.octet_length(content) + OVERHEAD).cast("long").alias("size")), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    runs = min(MAX_RUNS, max(1, round(total / shards / run_bytes)))
    cuts = splitters(keys, [total * i / (shards * runs) for i in range(1, shards * runs)], tolerance * total / shards / runs)
    bounds = sorted(min(c[0], (1 << 64) - 1) - (1 << 63) for c in cuts)
    rows_before = [0, *[c[2] for c in cuts]]
    first = _longs([rows_before[r] - rows_before[r // runs * runs] for r in range(shards * runs)])
    rows = documents.withColumn("__key", key)
    rows = rows.withColumn("__run", _number_below(bounds, F.col("__key")))
    place = F.row_number().over(Window.partitionBy("__run").orderBy("__key", doc_id, text)) - 1
    slot = (F.get(first, F.col("__run")) + place).cast("long")
    return rows.withColumn("slot", slot).withColumn("shard", F.floor(F.col("__run") / runs).cast("int")).select(*documents.columns, "shard", "slot").toDF(*columns, "shard", "slot")
