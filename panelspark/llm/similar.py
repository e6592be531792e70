"""Links between texts that share most of their word shingles, for near-duplicates that lie beyond a few SimHash bits.

Words as in simhash.py (A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`); a text is the set of its shingles of `shingle` words (fewer
words: all of them as one). Two texts are linked where their sets have a Jaccard similarity of `similarity` or more; each
link that is reported was decided on the whole sets.

 1. Each text gets BANDS hashes of ROWS min-wise hashes each. Texts with a band in common form a bucket (two texts at 0.8
    miss all bands once in 300,000 pairs). Equal texts are one member.
 2. Each bucket has one pivot, the member whose bands are the most frequent ones, so the middle of its family. All others are
    compared with it, a number of pairs that is linear in the members. What links is joined into components.
 3. Members that are still apart go on in sub-buckets, REPLICATES for each bucket, each keyed by MORE further min-wise hashes
    of its own, with a pivot of its own. Members that are far from all others are soon alone there; near ones stay together.
    A bucket with one component ends. Rounds end when the last one found no link (the first two are always made), at
    the latest after `levels`.
 4. Steps 1 to 3 only save work: they join most texts early. What they can miss (no band in common, links off the middle, the
    end of the rounds) is found by an exact prefix join over all texts, between components only, as others change nothing:
    a. A set of n shingles that is similar to another lacks at most n - ceil(similarity * n) of its own there. So the first ones of
       both, in any one order, have some in common. Each text gives this prefix in the order of the hashes, a little longer than
       needed, and goes on if enough of it is in the prefix of a text of another component. Most texts end here. The prefixes are
       shuffled once and not written: what is written are the shingles that another text has too.
    b. Those left go through the same shuffle with their whole sets, and go on if other components have as much of them as
       a similar text must. Shingles that no other component has count as lacking; the others are
       ordered by the number of texts that have them, so that the prefix holds the rarest.
    c. Texts of different components that meet at a shingle of their prefixes, and whose sizes and places leave room for the
       similarity, are compared on the whole sets. Large meetings are dealt in pieces over tasks; none is left out.

Defined results: very long texts are compared whole; of members that tie for the middle of a bucket the one with the larger
content hash is the pivot; texts without words and null texts have no links here; repeated rows and rows with equal texts are one
member; an empty table gives no links. The columns of documents other than the text are not read (but for the row key), so
clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import LOWER, NON_SPACE, Rolling, Scratch, bound_batches, mix, text_slices, word_spans
from panelspark.operators.spread import sized_join, spread_join

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
MORE, REPLICATES, LEVELS = 2, 2, 8
#: Rows that a slice of texts gives at most for a shingle that one component alone has there.
ALIKE = 16
#: Pairs of texts that one task looks at where texts of different components meet at a shingle.
PIECE_PAIRS = 1 << 22
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts, the number of them by text, and a hash of each text's whole word sequence."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, NON_SPACE)
    words = Rolling(Rolling(data).of(starts, ends))
    counts = np.diff(first)
    begin, end, at = np.repeat(first[:-1], counts), np.repeat(first[1:], counts), np.arange(len(starts))
    at = np.flatnonzero((at + shingle <= end) | ((at == begin) & (end - begin < shingle)))
    hashes = words.of(at, np.minimum(at + shingle, end[at]))
    return hashes, np.where(counts, np.maximum(counts - shingle + 1, 1), 0), words.of(first[:-1], first[1:])


def sketch(batch: pa.RecordBatch, column: str, shingle: int) -> tuple[pa.Array, pa.Array]:
    """For each row the hash of its words and its bands (none without words)."""
    contents, bands, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int32)]
    for _, _, data, off in text_slices(batch, column):
        hashes, n, content = shingle_hashes(data, off, shingle)
        contents.append(content)
        sizes.append(np.where(n, BANDS, 0).astype(np.int32))
        if len(hashes):
            cuts = (np.cumsum(n) - n)[n > 0]
            lowest = np.stack([np.minimum.reduceat(hashes * f, cuts) for f in _FACTORS], axis=1).reshape(len(cuts), BANDS, ROWS)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), lowest.shape[:2])
            for r in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + lowest[:, :, r])
            bands.append(band.ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes), dtype=np.int32)), pa.array(np.concatenate(bands).view(np.int64)))
    return pa.array(np.concatenate(contents).view(np.int64)), lists


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column(0).to_numpy().view(np.uint64)
        for row, end, data, off in text_slices(batch, "text"):
            hashes, n, content = shingle_hashes(data, off, shingle)
            mine = np.flatnonzero(content == wanted[row:end])
            parts = np.split(hashes, np.cumsum(n)[:-1])
            sets = [np.unique(parts[i]) for i in mine]
            at = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(content[mine].view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["content", "shingles"])


def shingle_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(content, n, shingles) of the texts that the written table wanted (rid, content) names in rows (rid, text), a row for each;
    rows that are equal in all columns share a rid and give one each."""
    bound_batches(rows.sparkSession)
    sets = sized_join(rows, wanted, ["rid"]).select("content", "text").mapInArrow(lambda it: _sets(it, shingle), "content long, shingles array<long>")
    return sets.select("content", F.size("shingles").alias("n"), "shingles")


def _finer(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """(content, bucket) for each row (content, buckets, shingles) and each replicate of each of its buckets."""
    odd, even = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
    for batch in batches:
        contents, out = [], []
        for content, buckets, shingles in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2)):
            own, held = (v.values.to_numpy().view(np.uint64) for v in (buckets, shingles))
            for r in range(REPLICATES):
                key = mix(own * odd + np.uint64(level * REPLICATES + r + 1))
                for m in range(MORE):
                    factors = mix(key + np.uint64(m + 1) * even) | np.uint64(1)
                    # one min-wise hash for each bucket: all members of a bucket use the same factor
                    lowest = np.array([(held * f).min() for f in factors], np.uint64)
                    key = mix(key * odd + lowest)
                contents.append(np.full(len(key), content))
                out.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *contents])), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64))], names=["content", "bucket"])


def close_pairs(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the written pairs (a, b, ...) whose shingle sets are as similar; b may be in many pairs."""
    scratch.drop("a", "b")
    side = lambda c: sized_join(sets.select("content", "shingles"), scratch.put(pairs.select(F.col(c).alias("content")).distinct(), c), ["content"], how="left_semi")
    both = spread_join(pairs, side("b").toDF("b", "y"), ["b"], ["a"]).join(side("a").toDF("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("shared", shared).filter(F.col("shared") >= similarity * (F.size("x") + F.size("y") - F.col("shared"))).drop("x", "y", "shared")


def _required(n, similarity: float):
    """Shingles that a set of n has in common with each similar one, at least; a bit low, against rounding."""
    return (np if isinstance(n, np.ndarray) else F).ceil(n * (similarity * (1 - 1e-9)))


def _prefixes(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(rid, content, need, tokens) for each row (rid, text) with words: two similar sets have at least `need` of both their tokens in common."""
    for batch in batches:
        for row, end, data, off in text_slices(batch, "text"):
            hashes, n, content = shingle_hashes(data, off, shingle)
            some = np.flatnonzero(n)
            sets = [np.unique(part) for part in np.split(hashes, np.cumsum(n[some])[:-1])] if len(some) else []
            n = np.array([len(x) for x in sets], np.int64)
            least = _required(n, similarity).astype(np.int64)
            need = np.minimum(1 + n // 20, least)
            tokens = [x[:m] for x, m in zip(sets, n - least + need)]
            at = np.cumsum([0] + [len(x) for x in tokens], dtype=np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[row:end].take(pa.array(some)), pa.array(content[some].view(np.int64)), pa.array(need),
                pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["rid", "content", "need", "tokens"])


def _whole(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(content, root, need, tokens) for each row (content, root, text) whose text has that content: its whole set."""
    for batch in batches:
        roots = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for sets in _sets([batch], shingle):
            root = pa.array([roots[c] for c in sets.column(0).to_pylist()], pa.int64())
            need = _required(np.diff(sets.column(1).offsets.to_numpy()), similarity).astype(np.int64)
            yield pa.RecordBatch.from_arrays([sets.column(0), root, pa.array(need), sets.column(1)], names=["content", "root", "need", "tokens"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, other, root, need, sure) for each token of the rows (content, need, tokens), with root or else content as root.

    Key and other are token and content; sure ones have content and token: another root has their token in the same batch already, or
    (which the caller may not rely on) one root has it in over ALIKE texts there. So no batch gives a key more than a few rows, and
    all texts of a token learn of another root: where a batch has several, two of them go by the token.
    """
    for batch in batches:
        content, need, tokens = batch.column("content").to_numpy(), batch.column("need").to_numpy(), batch.column("tokens")
        root = batch.column("root").to_numpy() if "root" in batch.schema.names else content
        once = np.zeros(len(content), bool)
        once[np.unique(content, return_index=True)[1]] = True
        owner = np.repeat(np.arange(len(content)), np.diff(tokens.offsets.to_numpy()))
        token = tokens.values.to_numpy()[once[owner]]
        owner = owner[once[owner]]
        order = np.lexsort((root[owner], token))
        token, owner = token[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(token)))
        last = first + size - 1
        several = np.repeat(root[owner[first]] != root[owner[last]], size)
        place = np.arange(len(token)) - np.repeat(first, size)
        sure = np.where(several, (place > 0) & (place < np.repeat(size, size) - 1), place >= ALIKE)
        own = content[owner]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.where(sure, own, token)), pa.array(np.where(sure, token, own)), pa.array(root[owner]), pa.array(need[owner]), pa.array(sure)],
            names=["key", "other", "root", "need", "sure"])


def shared_tokens(dealt: DataFrame, root: str) -> DataFrame:
    """(content, token, need) of the rows of _dealt whose token another root has too, in one shuffle; root names its column.
    A token that equals a sure row's content by chance may be taken for shared, never the other way round."""
    key = Window.partitionBy("key")
    shared = dealt.withColumns({"l": F.min(root).over(key), "h": F.max(root).over(key)}).filter("sure or l < h")
    return shared.select(F.when(F.col("sure"), F.col("key")).otherwise(F.col("other")).alias("content"), F.when(F.col("sure"), F.col("other")).otherwise(F.col("key")).alias("token"), "need")


def candidate_pairs(held: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, la, lb) of texts of different components that can be similar, all of them, from held (content, root, n, shingles)."""
    tokens = held.select("content", "root", "n", F.explode("shingles").alias("token"))
    times = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("root").alias("l"), F.max("root").alias("h"))
    times = scratch.put(times.filter("l < h").select("token", "times"), "times")
    found = sized_join(tokens, times, ["token"]).groupBy("content", "root", "n").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("found"))
    least = _required(F.col("n"), similarity).cast("int")
    found = found.withColumn("least", least).filter(F.size("found") >= F.col("least"))
    prefix = F.slice("found", F.lit(1), F.size("found") - F.col("least") + 1)
    # of the ordered set, those that only this component has come first; rest: how many come from this token on
    met = found.select("content", "root", "n", F.size("found").alias("rest"), F.posexplode(prefix).alias("i", "t"))
    met = scratch.put(met.select("content", "root", "n", (F.col("rest") - F.col("i")).alias("rest"), F.col("t.token").alias("token")), "prefix")
    size = met.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("m"))
    others = F.col("all") - F.col("m.c")
    size = scratch.put(size.filter(others > 0).select("token", F.col("m.root").alias("main"), F.ceil(others * F.col("all") / PIECE_PAIRS).cast("int").alias("pieces")), "meetings")
    met = scratch.put(sized_join(met, size, ["token"]), "meeting")
    # all but the largest component of a meeting against all of it
    right = met.select("token", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("content").alias("a"), F.col("root").alias("la"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    left = met.filter("root <> main").select("token", F.pmod(F.xxhash64("content"), F.col("pieces")).cast("int").alias("piece"), F.col("content").alias("b"), F.col("root").alias("lb"), "n", "rest", "main")
    both = left.join(right, ["token", "piece"]).filter((F.col("la") != F.col("lb")) & ((F.col("la") == F.col("main")) | (F.col("a") < F.col("b"))))
    fits = F.least("rest", "ra") >= _required((F.col("n") + F.col("na")) / (1 + similarity), similarity)
    return scratch.put(both.filter(fits).select("a", "b", "la", "lb").distinct(), "pairs")


def exact_links(rows: DataFrame, rooted: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components: one for each two that hold similar texts, none is missed. rooted, written, has (rid, content,
    root, known) of all texts of rows (rid, text); known is the root, but null where a text is the only one of its component."""
    bound_batches(rows.sparkSession)
    slim = lambda it: (b.select(["key", "other", "need", "sure"]) for b in it)
    made = rows.mapInArrow(lambda it: slim(_dealt(_prefixes(it, shingle, similarity))), "key long, other long, need long, sure boolean")
    # each text is its own root here, components are told apart below, on the few tokens that are left
    shared = shared_tokens(made, "other").groupBy("content").agg(F.max("need").alias("need"), F.collect_set("token").alias("tokens"))
    laid = scratch.put(shared.filter(F.size("tokens") >= F.col("need")).join(rooted.select("content", "known"), "content"), "laid")
    tokens = laid.select("content", "known", F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.min("known").alias("l"), F.max("known").alias("h"), F.count(F.lit(1)).alias("all"), F.count("known").alias("some"))
    common = scratch.put(held.filter("l < h or (some < all and all > 1)").select("token"), "common")
    found = sized_join(tokens.select("content", "token"), common, ["token"], how="left_semi").groupBy("content").agg(F.count(F.lit(1)).alias("c"))
    found = scratch.put(found, "found")
    alive = scratch.put(sized_join(laid.select("content", "need"), found, ["content"]).filter("c >= need").select("content").distinct(), "alive")
    scratch.drop("laid", "common", "found")
    wanted = scratch.put(sized_join(rooted.select("rid", "content", "root"), alive, ["content"]), "wanted")
    whole = sized_join(rows, wanted, ["rid"]).select("content", "root", "text")
    whole = whole.mapInArrow(lambda it: _dealt(_whole(it, shingle, similarity)), "key long, other long, root long, need long, sure boolean")
    # repeated rows may count more than once, so a few texts too many go on
    near = shared_tokens(whole, "root").groupBy("content").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
    near = scratch.put(near.filter("c >= need").select("content"), "near")
    wanted = scratch.put(sized_join(wanted, near, ["content"]), "nearer")
    sets = scratch.put(sized_join(shingle_sets(rows, wanted.select("rid", "content"), shingle), wanted.select("content", "root"), ["content"]), "whole")
    if sets.count() > wanted.count():
        sets = scratch.put(sets.dropDuplicates(["content"]), "whole-once")
    pairs = candidate_pairs(sets, similarity, scratch)
    scratch.drop("alive", "wanted", "near", "nearer", "times", "prefix", "meetings", "meeting")
    return scratch.put(close_pairs(pairs, sets, similarity, scratch).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "exact")


def _onward(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, root) of roots and of merged, where what was joined before goes where its root goes now."""
    later = merged.toDF("root", "last")
    own = merged.join(roots.select("node"), "node", "left_anti")
    return roots.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")).unionByName(own)


def similar_labels(rows: DataFrame, texts: DataFrame, edges: DataFrame, components: Callable[[DataFrame], DataFrame], *, shingle: int = SHINGLE,
                   similarity: float = SIMILARITY, levels: int = LEVELS) -> DataFrame:
    """(node, root) that joins the labels of texts (content, rid, label, bands; unique content) over similar texts and over the
    written edges (a, b) between labels that are known already.

    rows (rid, text) holds the texts; rid names a row that has the content.
    """
    scratch = Scratch(rows.sparkSession, "similar")
    entries = texts.select("content", "label", F.explode("bands").alias("bucket"))
    shared = scratch.put(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("bucket", "size"), "shared")
    # two shuffles of narrow entries at every size; a bucket that fills more than a partition is split as it is joined (adaptive execution)
    entries = scratch.put(entries.select("content", "bucket").join(shared.hint("merge"), "bucket"), "entries")
    members = entries.groupBy("content").agg(F.sum("size").alias("spread"))
    members = scratch.put(texts.select("content", "rid", "label").join(members, "content"), "members")
    sets = scratch.put(shingle_sets(rows, members.select("rid", "content"), shingle), "sets")
    if sets.count() > members.count():
        sets = scratch.put(sets.dropDuplicates(["content"]), "sets-once")
    sized = scratch.put(members.join(sets.select("content", "n"), "content").select("content", "label", "spread", "n"), "sized")
    left = scratch.put(sized_join(entries.select("content", "bucket"), sized, ["content"]), "left-0")
    scratch.drop("shared", "entries", "members", "sized")
    roots = None
    for k in range(levels):
        middle = F.max(F.struct("spread", "content", "n", "label"))
        buckets = left.groupBy("bucket").agg(middle.alias("p"), F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h")
        pivots = scratch.put(buckets.select("bucket", F.col("p.content").alias("pivot"), F.col("p.n").alias("m"), F.col("p.label").alias("other")), f"pivots-{k}")
        met = scratch.put(sized_join(left, pivots, ["bucket"], ["content"]).filter("content <> pivot"), f"met-{k}")
        apart = met.filter((F.col("label") != F.col("other")) & (F.least("n", "m") >= similarity * F.greatest("n", "m")))
        pairs = scratch.put(apart.select(F.col("content").alias("a"), F.col("pivot").alias("b"), F.col("label").alias("la"), F.col("other").alias("lb")).distinct(), f"pairs-{k}")
        close = scratch.put(close_pairs(pairs, sets, similarity, scratch).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), f"close-{k}")
        scratch.drop(f"left-{k}", f"pivots-{k}", f"pairs-{k}")
        found = not close.isEmpty()
        met = met.select("bucket", "content", "label", "spread", "n")
        if found or not k:
            merged = scratch.put(components(close if k else close.unionByName(edges)), f"merged-{k}")
            moved = merged.toDF("label", "root")
            labels = scratch.put(met.select("label").distinct().join(moved, "label", "left").select("label", F.coalesce("root", "label").alias("root")), f"labels-{k}")
            met = sized_join(met, labels, ["label"], ["content"]).select("bucket", "content", F.col("root").alias("label"), "spread", "n")
            if roots is None:
                roots = merged
            else:
                roots = scratch.put(_onward(roots, merged), f"roots-{k}")
        elif k:
            break
        open_ = scratch.put(met.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("bucket"), f"open-{k}")
        if open_.isEmpty():
            break
        still = sized_join(met, open_, ["bucket"], ["content"])
        own = scratch.put(still.groupBy("content").agg(F.collect_list("bucket").alias("buckets"), F.first("label").alias("label"), F.first("spread").alias("spread"), F.first("n").alias("n")), f"own-{k}")
        held = sized_join(sets.select("content", "shingles"), own.select("content"), ["content"], how="left_semi")
        finer = own.select("content", "buckets").join(held, "content").mapInArrow(lambda it, k=k: _finer(it, k), "content long, bucket long")
        left = scratch.put(finer.join(own.drop("buckets"), "content"), f"left-{k + 1}")
        scratch.drop(f"met-{k}", f"open-{k}", f"own-{k}", f"labels-{k}", f"close-{k}")
    scratch.keep(*[n for n in scratch.names if n.startswith(("roots-", "merged-"))])
    rooted = texts.select("rid", "content", "label").join(roots.toDF("label", "root"), "label", "left").select("rid", "content", F.coalesce("root", "label").alias("root"))
    rooted = scratch.put(rooted, "bare")
    several = scratch.put(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("root", F.col("root").alias("known")), "several")
    rooted = scratch.put(sized_join(rooted, several, ["root"], how="left").select("rid", "content", "root", "known"), "rooted")
    rest = exact_links(rows, rooted, shingle, similarity, scratch)
    if not rest.isEmpty():
        roots = scratch.put(_onward(roots, scratch.put(components(rest), "merged-last")), "roots-last")
    scratch.keep(*[n for n in scratch.names if n.startswith(("roots-", "merged-"))])
    return roots
