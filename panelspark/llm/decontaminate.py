"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the token windows of every document.

Words are runs of `[0-9a-z]` and non-ASCII characters after lower-casing A-Z. A benchmark item gives its windows of
`window` words, or itself where it is shorter. Window hashes of a document are found by rolling sums in numpy, looked up
in the broadcast set, and each hit is verified word by word, so a hash collision can't count.

Size of the broadcast: the items are taken in blocks of at most `block_windows` windows and one item (about 300 bytes a
window in a task, so some 60 MB). Each block is one pass over the documents, whose result is written and whose broadcast is
destroyed before the next block is read, so no two are in memory together; a small benchmark is one block and one pass, nothing
written. find_contamination() writes no texts: a row of counts for each document, and for later blocks the rows with hits alone, which
are put together by id and row key at the end.

Nulls and such: a very long text is scanned whole, alone in its slice; a null text has no words; an item without words has no window; an item with a null id still marks words, but has no
name to list. Repeated items count one by one by their distinct ids. An empty benchmark or document table gives no hit.
Columns of the documents other than id and text are not read; names that clash don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import ALNUM, LOWER, HashSet, Rolling, Scratch, bound_batches, numbered, row_key, text_slices, word_spans

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Windows of the benchmark that are broadcast at once.
BLOCK_WINDOWS = 200_000
_STATE = "doc_id long, rid long, n_words long, items array<string>, hit_spans array<long>"


def _item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _hash_windows(words: list[bytes], size: int) -> np.ndarray:
    """The same hashes that _scan finds for windows of a document."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    rolled = Rolling(Rolling(data).of(starts, ends))
    first = np.arange(len(words) - size + 1)
    return rolled.of(first, first + size)


class Windows:
    """The windows of a block of items: by length and hash, the true windows with the ids of their items."""

    def __init__(self, window: int):
        self.window, self.by_size, self.n = window, {}, 0

    def add(self, item: str | None, text: str | None) -> None:
        words = _item_words(text)
        if not words:
            return
        size = min(self.window, len(words))
        known = self.by_size.setdefault(size, {})
        for i, h in enumerate(_hash_windows(words, size).tolist()):
            known.setdefault(h, {}).setdefault(b" ".join(words[i : i + size]), set()).add(item)
            self.n += 1

    def sealed(self) -> list[tuple[int, dict]]:
        """Plain values, as a broadcast is read where this package may not be."""
        return sorted(self.by_size.items())


def _opened(table: Broadcast) -> list[tuple[int, HashSet, dict]]:
    return [(size, HashSet(np.fromiter(known, np.uint64, len(known))), known) for size, known in table.value]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_windows: int) -> Iterator[Windows]:
    block = Windows(window)
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        block.add(row[0], row[1])
        if block.n >= block_windows:
            yield block
            block = Windows(window)
    if block.n:
        yield block


def _united(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _hits(batch: pa.RecordBatch, sets: list) -> tuple[np.ndarray, dict[int, tuple[set, list]]]:
    """The number of words of each row, and for rows with a verified hit the items and the word ranges."""
    counts, hits = np.zeros(batch.num_rows, np.int64), {}
    for row, end, data, off in text_slices(batch, "text"):
        data = LOWER[data]
        starts, ends, first = word_spans(data, off, ALNUM)
        counts[row:end] = np.diff(first)
        if not len(starts):
            continue
        rolled = Rolling(Rolling(data).of(starts, ends))
        text_of = np.repeat(np.arange(end - row), np.diff(first))
        for size, hashes, known in sets:
            at = np.arange(max(0, len(starts) - size + 1))
            at = at[text_of[at] == text_of[at + size - 1]]
            found, place = hashes.find(rolled.of(at, at + size))
            for w, p in zip(at[found].tolist(), place.tolist()):
                words = b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(w, w + size))
                items = known[int(hashes.sorted[p])].get(words)  # the hit is verified here
                if items is not None:
                    doc = int(text_of[w])
                    seen, spans = hits.setdefault(row + doc, (set(), []))
                    seen |= items
                    spans.append((w - int(first[doc]), w - int(first[doc]) + size))
    return counts, hits


def _narrow(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """(doc_id, rid, n_words, items, hit_spans) of the windows of one block; the text ends here."""
    sets = _opened(table)
    for batch in batches:
        counts, hits = _hits(batch, sets)
        items: list[list] = [[] for _ in range(batch.num_rows)]
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        for row, (seen, new) in hits.items():
            items[row], spans[row] = sorted(x for x in seen if x is not None), _united(new)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))],
            names=["doc_id", "rid", "n_words", "items", "hit_spans"])


def _united_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, rid, n_words, items, hit_spans, more) with the spans of other blocks, several lists, united with their own."""
    for batch in batches:
        spans = [_united([(x, y) for flat in [own, *(more or [])] for x, y in zip(flat[::2], flat[1::2])]) for own, more in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "rid", "n_words", "items", "hit_spans"])


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (ids as sorted strings), hit_spans (word ranges, flat)."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(documents).alias("rid"), F.col(f"`{text}`").cast("string").alias("text"))
    scratch, found, hits = Scratch(spark, "contamination"), None, None
    blocks = enumerate(_blocks(benchmark, item_id, item_text, window, block_windows))
    k, block = next(blocks, (0, Windows(window)))
    while block is not None:
        table = spark.sparkContext.broadcast(block.sealed())
        scanned = rows.mapInArrow(lambda it, t=table: _narrow(it, t), _STATE)
        k, block = next(blocks, (k + 1, None))
        if found is None and block is None:
            found = scanned  # one block: nothing is written
        elif found is None:
            found = scratch.put(scanned, f"rows-{k}")
        else:
            more = scratch.put(scanned.filter(F.size("hit_spans") > 0).select("doc_id", "rid", "items", "hit_spans"), f"hits-{k}")
            hits = more if hits is None else hits.unionAll(more)
        if found is not scanned:
            table.destroy()
    if hits is not None:
        # rows that are equal in all columns share their hits
        merged = scratch.put(hits.distinct().groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("items")).alias("others"), F.collect_list("hit_spans").alias("more")).toDF("__id", "__rid", "others", "more"), "merged")
        joined = found.join(merged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("rid") == F.col("__rid")), "left")
        every = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("others", F.array().cast("array<string>")))))
        found = joined.select("doc_id", "rid", "n_words", every.alias("items"), "hit_spans", "more").mapInArrow(_united_rows, _STATE)
    covered = F.aggregate("hit_spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")),
                          lambda acc, x: F.struct((acc.sum + acc.sign * x).alias("sum"), (-acc.sign).alias("sign")), lambda acc: acc.sum)
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "items", "hit_spans")


def _block_by_block(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_windows: int,
                    scan: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """rows after scan(rows, block) for each block of the benchmark in turn; all results but the last one's are written."""
    scratch = Scratch(spark, "decontaminate")
    blocks = enumerate(_blocks(benchmark, item_id, item_text, window, block_windows))
    k, block = next(blocks, (0, Windows(window)))
    while True:
        table = spark.sparkContext.broadcast(block.sealed())
        scanned = scan(rows, table)
        k, block = next(blocks, (k, None))
        if block is None:
            return scanned
        rows = scratch.put(scanned, f"block-{k}")
        scratch.keep(f"block-{k}")
        table.destroy()


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """documents without those that hold a window of the benchmark; all columns and rows of the others stay as they are."""
    bound_batches(documents.sparkSession)
    rows, (text,) = numbered(documents, text)
    kept = _block_by_block(documents.sparkSession, rows, benchmark, item_id, item_text, window, block_windows, lambda df, t: df.mapInArrow(lambda it: _drop(it, t, text), rows.schema))
    return kept.toDF(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = 10, block_windows: int = BLOCK_WINDOWS, mark: str = " ") -> DataFrame:
    """documents with all that windows of the benchmark cover cut out of their texts, from the first word's beginning to the
    last one's end, `mark` in its place; texts without a hit stay as they are, all rows and columns stay."""
    bound_batches(documents.sparkSession)
    rows, (text,) = numbered(documents, text)
    cut = _block_by_block(documents.sparkSession, rows, benchmark, item_id, item_text, window, block_windows, lambda df, t: df.mapInArrow(lambda it: _cut(it, t, text, mark.encode()), rows.schema))
    return cut.toDF(*documents.columns)


def _cut(batches: Iterator[pa.RecordBatch], table, text: str, mark: bytes) -> Iterator[pa.RecordBatch]:
    sets = _opened(table)
    for batch in batches:
        place = batch.schema.get_field_index(text)
        slim = pa.RecordBatch.from_arrays([batch.column(place)], names=["text"])
        hits = _hits(slim, sets)[1]
        if hits:
            texts = batch.column(place).to_pylist()
            for row, (_, spans) in hits.items():
                raw = texts[row].encode("utf-8", "surrogatepass")
                words = [m.span() for m in _WORD.finditer(raw.lower())]
                flat = _united(spans)
                for a, b in reversed(list(zip(flat[::2], flat[1::2]))):
                    raw = raw[: words[a][0]] + mark + raw[words[b - 1][1] :]
                texts[row] = raw.decode("utf-8", "surrogatepass")
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
        yield batch


def _drop(batches: Iterator[pa.RecordBatch], table, text: str) -> Iterator[pa.RecordBatch]:
    sets = _opened(table)
    for batch in batches:
        slim = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text))], names=["text"])
        clean = np.ones(batch.num_rows, bool)
        clean[list(_hits(slim, sets)[1])] = False
        yield batch.filter(pa.array(clean))
