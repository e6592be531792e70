"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits, by Gray-ordered hierarchical indexes.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `shingle` words joined by a space (repeats
included; fewer words: all of them as one), XXH64 with seed 42 of each; a bit is 1 where over half of the hashes have it.

Linking, exact for every pair of fingerprints at `max_bits` or fewer differing bits:
 1. Equal fingerprints are one node (a group of copies of any size is aggregated map-side into one row).
 2. The 64 bits are cut into max_bits + 1 blocks. Two linked fingerprints agree on at least one block, so each node is
    turned (rotated) so that each block comes first once: as many turns of the table as blocks, 21 bytes a row.
 3. Each turn is range-partitioned and sorted by Gray rank. Fingerprints that agree on the first block have neighbouring
    ranks and come to one task. Over its sorted rows a task lays the hierarchical index: leaves of neighbours, then
    levels of FANOUT nodes; each holds the bits that all fingerprints below share (mask and value). A search for each
    fingerprint goes down from the top and only where the shared pattern agrees on the first block and differs in at most
    max_bits bits, so whole groups go at once. All candidates come from this index. What comes out is a forest over the
    links, not all pairs.
 4. Fingerprints of one first block that are more than `bucket_rows` are cut into runs of that many in Gray order, over as
    many tasks; pairs of runs whose shared patterns already differ by more than max_bits are dropped, each other pair is
    searched as a task by the same index.
 5. Components: alternating large-star and small-star steps over the edges, written to the shared folder each round.

Defined results: null or wordless texts have fingerprint zero and link like others; a null doc_id is in its group but
never its name (component_id is null if the whole group has none); repeated rows stay; an empty table gives none. Columns
other than id and text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.llm import similar
from panelspark.llm.common import LOWER, NON_SPACE, Scratch, bound_batches, materialize, numbered, row_key, text_slices, word_spans, xxh64
from panelspark.operators.spread import BROADCAST_ROWS, prefix_sums, sized_join

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Nodes of one first block that one index holds; larger groups are cut into runs of this many.
BUCKET_ROWS = 1 << 16
#: Rows of a turn that a task puts under one index, and more until the last first block is whole.
CHUNK_ROWS = 1 << 15
LEAF, FANOUT = 16, 8


def _plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Some texts in lower case, one blank between words, with the words' starts and ends and each text's first word."""
    data = LOWER[data]
    inside = NON_SPACE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # of white space the first byte after a word
    plain = data[keep]
    plain[~NON_SPACE[plain]] = 0x20
    return plain, *word_spans(plain, np.concatenate([[0], np.cumsum(keep)])[off], NON_SPACE)


def _slice_prints(data: np.ndarray, off: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """The fingerprints of some texts: all their shingles are hashed together, then bits are counted by text."""
    plain, starts, ends, first = _plain(data, off)
    counts = np.diff(first)
    begin, end, at = np.repeat(first[:-1], counts), np.repeat(first[1:], counts), np.arange(len(starts))
    at = np.flatnonzero((at + shingle <= end) | ((at == begin) & (end - begin < shingle)))
    out = np.zeros(len(counts), np.uint64)
    if not len(at):
        return out
    hashes = xxh64(plain, starts[at], ends[np.minimum(at + shingle, end[at]) - 1], seed)
    n = np.where(counts, np.maximum(counts - shingle + 1, 1), 0)
    some = np.flatnonzero(n)
    cuts = (np.cumsum(n) - n)[some]
    # four bits at a time are counted in one word, 16 bits for each, so in pieces of fewer than 2**16 hashes
    pieces = np.concatenate([np.arange(c, c + m, 65_535) for c, m in zip(cuts, n[some])]) if n.max() > 65_535 else cuts
    of_text = np.searchsorted(pieces, cuts)
    bits = np.empty((len(some), 64), np.int64)
    for k in range(16):
        held = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0001000100010001), pieces)
        for lane in range(4):
            bits[:, 16 * lane + k] = np.add.reduceat(((held >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), of_text)
    ones = 2 * bits > n[some, None]
    out[some] = (ones.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return int(_slice_prints(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shingle, seed)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, sketched: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [np.zeros(0, np.uint64), *[_slice_prints(data, off, shingle, SEED) for _, _, data, off in text_slices(batch, "text")]]
        columns = {"rid": batch.column(2), "doc_id": batch.column(0), "fp": pa.array(np.concatenate(prints).view(np.int64))}
        if sketched:
            columns["content"], columns["bands"] = similar.sketch(batch, "text", sketched)
        yield pa.RecordBatch.from_pydict(columns)


def fingerprints(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, sketched: int = 0) -> DataFrame:
    """(rid, doc_id, fp), a row per document; rid is common.row_key, fp holds the 64 bits in a long. With `sketched`, the
    length of shingles in words, also content and bands as similar.py takes them."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), row_key(documents).alias("rid"))
    more = T.StructType.fromDDL("fp long" + (", content long, bands array<long>" if sketched else ""))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle, sketched), T.StructType([T.StructField("rid", T.LongType()), rows.schema["doc_id"], *more]))


# ---------------------------------------------------------------- Gray order and the index

def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _gray_rank(c: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    return c


class GrayIndex:
    """Fingerprints in Gray order under levels of nodes, each with the mask and value of the bits shared below it."""

    def __init__(self, prints: np.ndarray):
        self.order = np.argsort(gray_rank(prints), kind="stable")
        self.prints = prints[self.order]
        ones, zeros, self.levels = self.prints, ~self.prints, []
        width = LEAF
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), width)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones | zeros, ones))
            width = FANOUT
        self.levels.reverse()

    def near(self, queries: np.ndarray, max_bits: int, same: np.uint64 = np.uint64(0)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of a query, place of a print) at max_bits or fewer differing bits, none of them in `same`, by slices of queries."""
        for first in range(0, len(queries), 256):
            q = np.arange(first, min(first + 256, len(queries)))
            at = np.zeros(len(q), np.int64)
            widths = [FANOUT] * (len(self.levels) - 1) + [LEAF]
            sizes = [len(m) for m, _ in self.levels[1:]] + [len(self.prints)]
            for (mask, value), width, size in zip(self.levels, widths, sizes):
                differ = (queries[q] ^ value[at]) & mask[at]
                fits = (np.bitwise_count(differ) <= max_bits) & ((differ & same) == 0)
                q, at = q[fits], at[fits]
                below = (at[:, None] * width + np.arange(width)).ravel()
                q = np.repeat(q, width)[below < size]
                at = below[below < size]
            differ = queries[q] ^ self.prints[at]
            fits = (np.bitwise_count(differ) <= max_bits) & ((differ & same) == 0)
            yield q[fits], self.order[at[fits]]


def _lowest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the lowest one that the pairs connect it with; pairs are met slice by slice."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def _forest(prints: np.ndarray, max_bits: int, first: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the index finds linked, each to the lowest of its tree."""
    index = GrayIndex(prints)
    label = _lowest(len(prints), index.near(prints, max_bits, first))
    mine = np.flatnonzero(label != np.arange(len(prints)))
    return prints[mine], prints[label[mine]]


def _search(batches: Iterator[pa.RecordBatch], max_bits: int, lead: int) -> Iterator[pa.RecordBatch]:
    """Turns arrive as (turn, print), one after another and each in Gray order; prints that share the first `lead` bits are
    searched together, as many such groups at a time as make CHUNK_ROWS."""
    turn_left, print_left = np.zeros(0, np.int32), np.zeros(0, np.uint64)
    first = np.uint64((1 << 64) - (1 << (64 - lead)))

    def edges(turn: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in np.unique(turn):
            a, b = _forest(prints[turn == t], max_bits, first)
            back = [np.uint64(64) - np.uint64(t * lead), np.uint64(t * lead)]
            a, b = ((x << back[0] | x >> back[1]) if t else x for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        turn = np.concatenate([turn_left, batch.column(0).to_numpy()])
        prints = np.concatenate([print_left, batch.column(1).to_numpy().view(np.uint64)])
        cut = 0
        if len(turn) >= CHUNK_ROWS:  # the last group may go on in the next batch
            group = prints & first
            others = np.flatnonzero((group != group[-1]) | (turn != turn[-1]))
            cut = int(others[-1]) + 1 if len(others) else 0
        turn_left, print_left = turn[cut:], prints[cut:]
        if cut:
            yield from edges(turn[:cut], prints[:cut])
    if len(turn_left):
        yield from edges(turn_left, print_left)


def _search_runs(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Pairs of runs, each of at most BUCKET_ROWS prints."""
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            both = np.unique(np.concatenate([v.values.to_numpy().view(np.uint64) for v in (left, right)]))
            a, b = _forest(both, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (a, b)], names=["a", "b"])


def links(nodes: DataFrame, *, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) of a forest over all links between distinct fingerprints; nodes has a unique column fp."""
    spark = nodes.sparkSession
    lead = 64 // (max_bits + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    turned = lambda t: F.shiftleft("fp", t * lead).bitwiseOR(F.shiftrightunsigned("fp", 64 - t * lead)) if t else F.col("fp")
    turns = F.array(*[F.struct(F.lit(t).alias("turn"), turned(t).alias("print")) for t in range(max_bits + 1)])
    rows = nodes.select(F.explode(turns).alias("t")).select("t.*")
    rows = rows.withColumn("rank", _gray_rank(F.col("print")).bitwiseXOR(F.lit(-(1 << 63)))).withColumn("block", F.shiftright("rank", 64 - lead))
    rows = materialize(rows, "simhash-turns")
    # at most (max_bits + 1) * 2**lead groups, and no more than rows / bucket_rows of them are large
    large = materialize(rows.groupBy("turn", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows).select("turn", "block"), "simhash-large")
    some = not large.isEmpty()
    small = rows.join(large, ["turn", "block"], "left_anti") if some else rows
    found = (
        small.repartitionByRange(parts, "turn", "block").sortWithinPartitions("turn", "rank").select("turn", "print")
        .mapInArrow(lambda it: _search(it, max_bits, lead), "a long, b long"))
    if some:
        bucket = F.col("block") * (max_bits + 1) + F.col("turn")
        runs = prefix_sums(rows.join(large, ["turn", "block"]).withColumns({"one": F.lit(1).cast("long"), "bucket": bucket}), "bucket", [F.col("rank")], {"place": "one"}, "simhash-runs")
        runs = materialize(
            runs.groupBy("bucket", "turn", F.floor(F.col("place") / bucket_rows).alias("run"))
            .agg(F.collect_list("print").alias("fps"), F.bit_and("print").alias("ones"), F.bit_and(F.bitwise_not("print")).alias("zeros")), "simhash-run")
        slim = runs.select("bucket", "run", "ones", "zeros")
        left, right = slim.toDF("bucket", "i", "ones", "zeros"), slim.toDF("bucket", "j", "ones2", "zeros2")
        apart = F.bit_count(F.col("ones").bitwiseAND(F.col("zeros2"))) + F.bit_count(F.col("zeros").bitwiseAND(F.col("ones2")))
        pairs = left.join(right, "bucket").filter((F.col("i") <= F.col("j")) & (apart <= max_bits)).select("bucket", "i", "j")
        back = lambda c: F.transform(c, lambda p: functools.reduce(lambda w, t: w.when(F.col("turn") == t, F.shiftrightunsigned(p, t * lead).bitwiseOR(F.shiftleft(p, 64 - t * lead))), range(1, max_bits + 1), F.when(F.col("turn") == 0, p)))
        fps = runs.select("bucket", "run", back("fps").alias("fps"))
        pairs = (pairs.join(fps.toDF("bucket", "i", "left"), ["bucket", "i"]).join(fps.toDF("bucket", "j", "right"), ["bucket", "j"])
                 .select("left", "right"))
        found = found.unionAll(pairs.mapInArrow(lambda it: _search_runs(it, max_bits), "a long, b long"))
    return found.distinct()


# ---------------------------------------------------------------- components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the lowest node that it is connected with.

    Large-star and small-star in turn until each node hangs on its root. A hub's neighbours are aggregated map-side to their
    minimum, which is written and joined back by sized_join, so a hub of any size is no task's load.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "round-0")
    for k in range(max_rounds):
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("child")), F.struct(F.col("b").alias("n"), F.lit(0).alias("child")))).alias("e")).select("e.*")
        times = ends.groupBy("n").agg(F.sum("child").alias("c"), F.min("child").alias("low"))
        if times.filter("c > 1 or (c = 1 and low = 0)").isEmpty():  # each node has one parent, and no parent has one
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"low-{k}")
        large = scratch.put(sized_join(both.filter("b > a"), low, ["a"], ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"), f"large-{k}")
        low = scratch.put(large.groupBy("a").agg(F.min("b").alias("m")), f"low-again-{k}")
        small = sized_join(large, low, ["a"], ["b"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = scratch.put(small.filter("a <> b").distinct(), f"round-{k + 1}")
        scratch.keep(f"round-{k + 1}")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _grouped(documents: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
             bucket_rows: int = BUCKET_ROWS, similarity: float | None = None, similar_shingle: int = similar.SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, fp) of all documents and (fp, root) of all fingerprints, both written."""
    prints = scratch.put(fingerprints(documents, doc_id=doc_id, text=text, shingle=shingle, sketched=similar_shingle if similarity else 0), "prints")
    nodes = scratch.put(prints.select("fp").distinct(), "nodes")
    edges = scratch.put(links(nodes, max_bits=max_bits, bucket_rows=bucket_rows), "links")
    if similarity:
        texts = prints.filter(F.size("bands") > 0).groupBy("content").agg(F.min(F.struct("rid", F.col("fp").alias("label"), "bands")).alias("t"))
        texts = scratch.put(texts.select("content", "t.*"), "texts")
        rows = documents.select(row_key(documents).alias("rid"), F.col(f"`{text}`").cast("string").alias("text"))
        roots = similar.similar_labels(rows, texts, edges, components, shingle=similar_shingle, similarity=similarity)
    else:
        roots = components(edges)
    labelled = scratch.put(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "labelled")
    scratch.keep("prints", "labelled")
    return prints.select("rid", "doc_id", "fp"), labelled


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, fp, component_id), a row per document; component_id is the smallest doc_id reachable over links.

    Options: shingle, max_bits, bucket_rows; with `similarity`, texts whose sets of `similar_shingle`-word shingles are that
    similar are linked too (similar.py).
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    prints, labelled = _grouped(documents, scratch, doc_id=doc_id, text=text, **options)
    least = scratch.put(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(labelled, "fp"), "least")
    names = scratch.put(least.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    by_print = scratch.put(sized_join(least, names, ["root"], ["fp"]).select("fp", "component_id"), "by-print")
    scratch.keep("prints", "by-print")
    return sized_join(prints, by_print, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def keep_one_of_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """documents with one row of each group; all columns stay.

    Of a group the row with the smallest id stays (rows without an id come last); of rows that tie in that, the one with the
    smallest common.row_key; of rows that are equal in all columns, one. Rows are told apart by id and key, not by id alone:
    different texts under one id are in different groups, and rows without an id are compared like others.
    """
    scratch, columns = Scratch(documents.sparkSession, "keep-one"), documents.columns
    documents, (doc_id, text) = numbered(documents, doc_id, text)
    prints, labelled = _grouped(documents, scratch, doc_id=doc_id, text=text, **options)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    least = scratch.put(prints.groupBy("fp").agg(F.min(order).alias("t")).join(labelled, "fp"), "least")
    names = scratch.put(least.groupBy("root").agg(F.min("t").alias("t")).select(F.struct("t.last", "t.doc_id", "t.rid").alias("t"), F.lit(True).alias("kept")), "names")
    # keys of rows that go, and of rows that stay but are there more than once
    keys = scratch.put(prints.groupBy(order.alias("t")).agg(F.count(F.lit(1)).alias("n")), "keys")
    marked = keys.join(names, "t", "left").select(F.col("t.doc_id").alias("__id"), F.col("t.rid").alias("__rid"), F.coalesce("kept", F.lit(False)).alias("kept"), "n")
    marked = scratch.put(marked.filter("not kept or n > 1"), "marked")
    scratch.keep("marked")
    same = F.col("__id").eqNullSafe(F.col(doc_id)) & (F.col("__rid") == F.col("__key"))
    rows = documents.withColumn("__key", row_key(documents))
    gone = marked.select("__id", "__rid")
    once = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    twice = marked.filter("kept").select("__id", "__rid")
    if not twice.isEmpty():  # few or many, their texts meet map-side
        once = once.unionByName(rows.join(twice, same, "left_semi").dropDuplicates([doc_id, "__key"]))
    return once.select(*documents.columns).toDF(*columns)
