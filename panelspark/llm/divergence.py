"""How the sources of a language differ in their words: exact divergences between (language, source) groups from bitmaps.

Words are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps the V words that are in at least
`min_docs` of its documents. A group that has a word count times, of N kept words in all, gives it
p = 1 + floor(1e9 * (count + 1) / (N + V)); q is the same of another group; f = floor((p - q)^2 / q). All in whole numbers.

Words get dense ids by language, frequent first, 64 of them a bitset word. A group stores, for each count, the bitsets of the ids
that it has that often: rows (language, word of 64 ids, source, count, bits). For two groups, AND and popcount of their
bitsets give the ids of each joint cell (count, count), times f of the cell. Cells with a zero follow by complement and are
never stored: with n(a) the words that a group has a times,
  sum over all V words of f(a, b) = sum over stored cells n(a, b) (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
      + sum n(a) (f(a, 0) - f(0, 0)) + sum n(b) (f(0, b) - f(0, 0)) + V f(0, 0).
The first sum is made in tasks on WORDS bitset words at a time, in tiles of TILE bitsets, so its memory doesn't grow; the others
come from the small table of n(a). As frequent words are first, the many different counts of those meet in few bitset words, and
the long tail of rare words has few counts a bitset word.

Scale: tasks count words of a batch before anything is shuffled, so a group with a third of all rows is no larger than others. All
later rows are per (group, word) or less, spread by word; the only rows per pair of groups are those of the result.

Nulls and such: null texts, languages and sources are read as ''. A group without words has rows for all its pairs, with 0 where
the language keeps no word. A language of one source has no pairs. Very long texts count whole; repeated rows count each. Ties go
by UTF-8 bytes of the item. An empty table gives no rows. Only the three columns are read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import LOWER, bound_batches, materialize, text_slices, word_spans
from panelspark.operators.spread import prefix_sums

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Probabilities are in parts of this.
SCALE = 1_000_000_000
#: Bitset words of a task's group, and bitsets of a tile.
WORDS, TILE = 8, 512
_COUNTS = "lang string, source string, term string, n long, docs long"


def _slice_counts(batch: pa.RecordBatch, row: int, end: int, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """Words of some texts of a batch by group: occurrences, and texts that have the word; an empty word marks each group."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, off, _LETTER)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    inside = _LETTER[low]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(low[inside])]).dictionary_encode()
    code, many = np.asarray(words.indices, np.int64), max(len(words.dictionary), 1)
    labels = [pc.fill_null(batch.column(i).slice(row, end - row), "").dictionary_encode() for i in (1, 2)]
    of = [np.asarray(x.indices, np.int64) for x in labels]
    groups, group = np.unique(of[0] * len(labels[1].dictionary) + of[1], return_inverse=True)
    text_of = np.repeat(np.arange(end - row), np.diff(first))
    in_text = np.unique(text_of * many + code)
    key, n = np.unique(group[text_of] * many + code, return_counts=True)
    docs = np.unique(group[in_text // many] * many + in_text % many, return_counts=True)[1]  # same keys in the same order
    none = np.zeros(len(groups), np.int64)
    owner = groups[np.concatenate([key // many, np.arange(len(groups))])]
    terms = pa.concat_arrays([words.dictionary.take(pa.array(key % many)).cast(pa.string()), pa.array([""] * len(groups), pa.string())])
    pick = lambda x, i: x.dictionary.take(pa.array(i)).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pick(labels[0], owner // len(labels[1].dictionary)), pick(labels[1], owner % len(labels[1].dictionary)), terms,
         pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))], names=["lang", "source", "term", "n", "docs"])


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_slice_counts(batch, *s) for s in text_slices(batch, "text")]
        if parts:  # slices of a batch share most words
            table = pa.Table.from_batches(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            yield from table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks().to_batches()


def term_counts(documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each word in each group; the term '' stands for the group."""
    bound_batches(documents.sparkSession)
    rows = documents.select(*[F.col(f"`{c}`").cast("string").alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    counted = rows.mapInArrow(_batch_counts, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + vocabulary)) in whole numbers of up to 38 digits; null for an empty vocabulary."""
    over = F.when(vocabulary > 0, (total + vocabulary).cast("decimal(19,0)"))
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, over)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _bits(df: DataFrame) -> DataFrame:
    """(lang, at, source, n, p, p0, bits): bitsets of 64 ids by group and count."""
    return df.groupBy("lang", F.shiftright("id", 6).alias("at"), "source", "n", "p", "p0").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int"))).alias("bits"))


def _cells(rows: pa.Table) -> pa.Table:
    """For some bitset words of a language: (lang, source, other, value) summed over the cells without a zero."""
    f = lambda p, q: (p - q) * (p - q) // q
    rows = rows.sort_by([("at", "ascending"), ("source", "ascending")])
    encoded = rows["source"].combine_chunks().dictionary_encode()
    code = np.asarray(encoded.indices, np.int64)
    at, bits, p, p0 = (rows[c].to_numpy() for c in ("at", "bits", "p", "p0"))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
    sums: dict[tuple[int, int], int] = {}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        runs = a + np.concatenate([[0], np.flatnonzero(np.diff(code[a:b])) + 1])
        tiles = [(t, min(t + TILE, b)) for t in range(a, b, TILE)]
        starts = [np.concatenate([[lo], runs[(runs > lo) & (runs < hi)]]) for lo, hi in tiles]
        for (lo, hi), mine in zip(tiles, starts):
            for (lo_b, hi_b), theirs in zip(tiles, starts):
                x, y = slice(lo, hi), slice(lo_b, hi_b)
                n = np.bitwise_count((bits[x, None] & bits[None, y]).view(np.uint64)).astype(np.int64)
                i, j = np.nonzero(n)
                value = np.zeros(n.shape, np.int64)
                pi, qj, p0i, q0j = p[x][i], p[y][j], p0[x][i], p0[y][j]
                value[i, j] = n[i, j] * (f(pi, qj) - f(pi, q0j) - f(p0i, qj) + f(p0i, q0j))
                value = np.add.reduceat(np.add.reduceat(value, theirs - lo_b, axis=1), mine - lo, axis=0)
                for r, one in zip(code[mine].tolist(), value.tolist()):
                    for s, v in zip(code[theirs].tolist(), one):
                        if v and r != s:
                            sums[r, s] = sums.get((r, s), 0) + v
    sides = [encoded.dictionary.take(pa.array([k[i] for k in sums], pa.int64())).cast(pa.string()) for i in (0, 1)]
    return pa.table([pa.array([rows["lang"][0].as_py()] * len(sums), pa.string()), *sides, pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "other", "value"])


def _joint(bitmaps: DataFrame) -> DataFrame:
    cells = bitmaps.groupBy("lang", (F.col("at") / WORDS).cast("long").alias("part")).applyInArrow(_cells, "lang string, source string, other string, value long")
    return cells.groupBy("lang", "source", "other").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("joint"))


def audit(documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part `pair`: for each group and each other source of its language, f summed over the kept words. Part `term`: the `top` words
    that a group has more often than its language, by f against the language.
    """
    counts = materialize(term_counts(documents, text=text, lang=lang, source=source), "divergence-counts")
    words = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    ids = prefix_sums(words.select("lang", "term", "all_n", F.lit(1).alias("one")), "lang", [-F.col("all_n"), F.col("term")], {"id": "one"}, "divergence-ids").drop("one")
    kept = materialize(counts.filter("term != ''").join(ids, ["lang", "term"]).select("lang", "source", "term", "n", "all_n", "id"), "divergence-kept")

    # a row for each group, with its size and its language's
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = ids.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count(F.lit(1)).alias("v"))
    groups = counts.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "all_total", "v")])
    groups = materialize(groups.withColumn("p0", _p(F.lit(0), F.col("total"), F.col("v"))), "divergence-groups")
    known = kept.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))

    # words of a group against its language
    q = _p(F.col("all_n"), F.col("all_total"), F.col("v"))
    more = known.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # groups against one another
    joint = _joint(_bits(known))
    levels = materialize(known.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms")), "divergence-levels")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    n = F.col("terms").cast("decimal(19,0)")
    change = lambda a, b: n * (a - b).cast("decimal(20,0)")
    mine = levels.join(other, "lang").groupBy("lang", "source", "other").agg(exact(change(_f(F.col("p"), F.col("q0")), _f(F.col("p0"), F.col("q0")))).alias("mine"))
    # the other's levels q against this group's p0
    theirs = levels.join(other, "lang").groupBy("lang", F.col("other").alias("source"), F.col("source").alias("other")).agg(
        exact(change(_f(F.col("q0"), F.col("p")), _f(F.col("q0"), F.col("p0")))).alias("theirs"))
    pairs = groups.join(other, "lang").filter(F.col("source") != F.col("other")).select("lang", "source", "other", (F.col("v").cast("decimal(19,0)") * _f(F.col("p0"), F.col("q0")).cast("decimal(19,0)")).alias("zero"))
    for part in (joint, mine, theirs):
        pairs = pairs.join(part, ["lang", "source", "other"], "left")
    value = sum((F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)")) for c in ("joint", "mine", "theirs")), F.coalesce(F.col("zero"), F.lit(0).cast("decimal(38,0)"))).cast("long")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
