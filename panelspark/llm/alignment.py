"""Cross-tokenizer alignment: where the tokens of a byte-level BPE (A) and of a piece BPE with byte fallback (B) end together.

Both encode space + text without special tokens (B adds its own space). The spans of the libraries, character offsets of A and
the byte spans of B's offset mapping (which took the place of its immutable proto), are the coarse cuts; a token whose span
doesn't end with its decoded bytes (a part of a character, a byte-fallback token) is cut by those bytes. Byte offsets where a
token of each ends cut both into groups.

Texts are split at single spaces between other characters, where neither tokenizer ever joins what is left and right (this is
read off the models; if it isn't so, a text is one piece). The distinct pieces of a batch are laid end to end, encoded in blobs of
BLOB_BYTES and aligned in numpy, and the documents are put together from pieces. A worker remembers short pieces.

align() returns the spans. linked() also weighs each link (A token, B token that share bytes) by the number of documents of the
corpus that hold its pair of ids linked. SLICE_BYTES of texts (or one longer text) become one row of arrays: their distinct
pairs, and each document's pairs as places among those. The pairs of the slices are counted over the corpus. Up to BROADCAST_ROWS
counts go to all tasks; more of them go back by slice and pair, and meet the row of their slice in a group that Python reads as a
stream. Each slice adds them up for its documents. So a pair is shuffled once a slice and not once a document. A row has about 1 MB,
and a Parquet row group few of them, as a reader unpacks a whole group at once.

Nulls and such: null and empty texts, and those that a tokenizer doesn't give back byte by byte (B reads U+2581 as a space),
have no tokens: zeros and an empty digest. Very long texts are encoded whole. Repeated rows and null ids count one by one. An
empty table gives no rows. Only id and text are read, so clashing names don't matter. Ids come back in their own type.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import bound_batches, new_folder
from panelspark.operators import spread

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of distinct pieces that are encoded at once; pieces that a worker remembers from batch to batch, and their most bytes.
BLOB_BYTES, KNOWN, KNOWN_BYTES = 1 << 17, 300_000, 32
#: Bytes of texts that make a row of arrays.
SLICE_BYTES = 1 << 20
#: Parquet row groups of few wide rows: packed they tell little of what a reader holds, and the writer would first look at their
#: size after 100 rows.
GROUP = {"parquet.block.size": 16 << 20, "parquet.block.row.count.limit": 16, "parquet.page.size.row.check.min": 1}


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: a span that doesn't end where the bytes of the tokens so far end is cut by those."""
    by_bytes = np.cumsum(sizes)
    return np.where(coarse == by_bytes, coarse, by_bytes)


@dataclass
class Tokens:
    """The tokens of distinct pieces laid end to end, each piece with its leading space: ids and byte ends of both tokenizers, the
    byte end of each piece, and the pieces that are not given back (they have no tokens)."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray
    ends: np.ndarray
    bad: np.ndarray


def _stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first[i] to first[i] + size[i] - 1 for all i, in a row."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Known:
    """Tokens of pieces that were met before, flat: ids and byte ends within the piece, of both tokenizers."""

    def __init__(self):
        self.of: dict[bytes, int] = {}
        self.values = [np.zeros(0, np.int32) for _ in range(4)]
        self.n = [np.zeros(0, np.int32) for _ in range(2)]
        self.first = [np.zeros(0, np.int64) for _ in range(2)]
        self.sizes = np.zeros(0, np.int64)

    def add(self, pieces: list[bytes], t: Tokens) -> None:
        """As many of the pieces as there is room for, with their tokens t."""
        starts = np.concatenate([[0], t.ends[:-1]]) if len(t.ends) else t.ends
        room = KNOWN - len(self.of)
        fit = np.flatnonzero(~t.bad & (t.ends - starts <= KNOWN_BYTES))[: max(0, room)]
        if not len(fit):
            return
        self.of |= {pieces[i]: len(self.of) + k for k, i in enumerate(fit.tolist())}
        for side, (ids, ends) in enumerate(((t.a_ids, t.a_ends), (t.b_ids, t.b_ends))):
            a, b = np.searchsorted(ends, starts[fit], "right"), np.searchsorted(ends, t.ends[fit], "right")
            at = _stretches(a, b - a)
            self.first[side] = np.concatenate([self.first[side], len(self.values[2 * side]) + np.cumsum(b - a) - (b - a)])
            self.n[side] = np.concatenate([self.n[side], (b - a).astype(np.int32)])
            self.values[2 * side] = np.concatenate([self.values[2 * side], ids[at].astype(np.int32)])
            self.values[2 * side + 1] = np.concatenate([self.values[2 * side + 1], (ends[at] - np.repeat(starts[fit], b - a)).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, (t.ends - starts)[fit]])

    def tokens(self, codes: np.ndarray) -> Tokens:
        ends = np.cumsum(self.sizes[codes])
        parts = []
        for side in (0, 1):
            n = self.n[side][codes].astype(np.int64)
            at = _stretches(self.first[side][codes], n)
            parts += [self.values[2 * side][at].astype(np.int64), self.values[2 * side + 1][at] + np.repeat(ends - self.sizes[codes], n)]
        return Tokens(*parts, ends, np.zeros(len(codes), bool))


class Vocabulary:
    """Bytes of all tokens of a vocabulary, flat."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_stretches(self.first[ids], self.size[ids])]


class Tokenizers:
    """Both tokenizers, opened in a task from the contents of their files."""

    def __init__(self, a_json: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), SentencePieceProcessor()
        self.a.encode_special_tokens = True
        self.b.LoadFromSerializedProto(b_model)
        of, by_id = _byte_of_char(), {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        entry = lambda t: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        self.a_tokens = Vocabulary([entry(by_id.get(i, "")) for i in range(max(by_id) + 1)])
        model = ModelProto.FromString(b_model)
        self.b_tokens = Vocabulary([bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces])
        spec, before = json.loads(a_json), json.loads(a_json).get("pre_tokenizer") or {}
        self.splits = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
            and model.normalizer_spec.name == "identity" and model.normalizer_spec.add_dummy_prefix and not model.normalizer_spec.remove_extra_whitespaces
            and not any("▁" in p.piece.lstrip("▁") for p in model.pieces))

        self.known = Known()

    def tokens(self, pieces: list[bytes]) -> tuple[Tokens, np.ndarray]:
        """The tokens of the pieces, and the place of each piece among those: pieces that were met before come first."""
        code = np.fromiter((self.known.of.get(p, -1) for p in pieces), np.int64, len(pieces))
        met, new = np.flatnonzero(code >= 0), np.flatnonzero(code < 0)
        old, names = self.known.tokens(code[met]), [pieces[i] for i in new.tolist()]
        fresh = self.encoded(names)
        base = int(old.ends[-1]) if len(met) else 0
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate([met, new])] = np.arange(len(pieces))
        self.known.add(names, fresh)
        return Tokens(*[np.concatenate([getattr(old, k), getattr(fresh, k) + (base if "ends" in k else 0)]) for k in ("a_ids", "a_ends", "b_ids", "b_ends", "ends")],
                      np.concatenate([old.bad, fresh.bad])), place

    def encoded(self, pieces: list[bytes]) -> Tokens:
        """Pieces are encoded many at a time, with the spaces between them at which texts were cut; those that begin or end so that
        a neighbour could matter are encoded alone."""
        sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        alone = np.array([not self.splits or not _AFTER[p[0]] or p[-1] == 0x20 for p in pieces], bool)
        found: list[tuple[int, tuple]] = []
        bad = np.zeros(len(pieces), bool)
        start = 0
        while start < len(pieces):
            stop = start + 1
            if not alone[start]:
                most = int(np.searchsorted(ends, ends[start] + BLOB_BYTES, "right"))
                odd = np.flatnonzero(alone[start:most])
                stop = max(stop, start + int(odd[0]) if len(odd) else most)
            self._encode(pieces, start, stop, int(ends[start] - sizes[start]), found, bad)
            start = stop
        parts = [np.concatenate([np.zeros(0, np.int64), *[one[k] for one in found]]) for k in range(4)]
        return Tokens(*parts, ends, bad)

    def _encode(self, pieces: list[bytes], start: int, stop: int, base: int, found: list, bad: np.ndarray) -> None:
        blob = b" ".join(pieces[start:stop])
        raw = np.frombuffer(b" " + blob, np.uint8)
        a = self.a.encode(raw.tobytes().decode(), add_special_tokens=False)
        b = self.b.encode(blob, return_type="offset_mapping")
        a_ids, b_ids = np.array(a.ids, np.int64), np.array(b["ids"], np.int64)
        if not np.array_equal(self.a_tokens.joined(a_ids), raw) or not np.array_equal(self.b_tokens.joined(b_ids), raw):
            if stop == start + 1:
                bad[start] = True
                return
            middle = (start + stop) // 2
            self._encode(pieces, start, middle, base, found, bad)
            return self._encode(pieces, middle, stop, base + sum(len(p) + 1 for p in pieces[start:middle]), found, bad)
        # A's spans are characters of space + text; B's are bytes of the text without the space that it adds
        char_ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        a_spans = char_ends[np.array([e for _, e in a.offsets], np.int64)]
        b_spans = np.array([e for _, e in b["offsets"]], np.int64) + 1
        found.append((a_ids, base + _refined(a_spans, self.a_tokens.size[a_ids]), b_ids, base + _refined(b_spans, self.b_tokens.size[b_ids])))


_open: dict[str, Tokenizers] = {}


def _opened(files: tuple[str, bytes]) -> Tokenizers:
    """The tokenizers of this worker, opened once."""
    key = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    if key not in _open:
        _open.clear()
        _open[key] = Tokenizers(*files)
    return _open[key]


#: A space is a cut if the byte after it is one of these: no white space or control, and no lead byte of wider white space.
_AFTER = np.ones(256, bool)
_AFTER[:0x21] = False
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def _split(texts: pa.Array, splits: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of each piece, number of pieces of each text, the distinct pieces); null and empty texts have no piece."""
    values = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    cut = np.zeros(len(raw), bool)
    if splits and len(raw) > 2:
        cut[1:-1] = (raw[1:-1] == 0x20) & (raw[:-2] != 0x20) & _AFTER[raw[2:]]
        inner = off[off < len(raw)]
        cut[inner] = False  # a text that begins with a space
        cut[off[off > 0] - 1] = False  # or ends with one
    kept = raw[~cut]
    gone = np.concatenate([[0], np.cumsum(cut)])
    full = off[:-1][off[1:] > off[:-1]]
    places = np.flatnonzero(cut)
    starts = np.sort(np.concatenate([full - gone[full], places + 1 - gone[places + 1]]))
    n = np.where(off[1:] > off[:-1], 1 + gone[off[1:]] - gone[off[:-1]], 0)
    bounds = np.concatenate([starts, [len(kept)]]).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    return np.asarray(pieces.indices, np.int64), n.astype(np.int64), pieces.dictionary.to_pylist()


def _files(spark: SparkSession, a_path: str, b_path: str):
    """The two vocabularies, some 2 MB whatever the corpus, read here and sent to the tasks."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


# ---------------------------------------------------------------- spans


def align(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """A row per document: doc_id, a_ids, a_ends, b_ids, b_ends (arrays; ends are bytes of space + text) and cuts, the ends of
    the groups."""
    bound_batches(documents.sparkSession)
    files = _files(documents.sparkSession, a_path, b_path)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = ["a_ids", "a_ends", "b_ids", "b_ends", "cuts"]
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in names]])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _opened(files.value)
        for batch in batches:
            codes, n, pieces = _split(batch.column(1), both.splits)
            t, place = both.tokens(pieces)
            codes = place[codes]
            starts = np.concatenate([[0], t.ends[:-1]]) if len(t.ends) else t.ends
            out: list[list] = [[] for _ in names]
            at = 0
            for k in n.tolist():
                mine = codes[at : at + k]
                at += k
                lists = [np.zeros(0, np.int64)] * len(names)
                if k and not t.bad[mine].any():
                    base = np.cumsum(t.ends[mine] - starts[mine]) - t.ends[mine]
                    for side, (ids, ends) in enumerate(((t.a_ids, t.a_ends), (t.b_ids, t.b_ends))):
                        first, last = np.searchsorted(ends, starts[mine], "right"), np.searchsorted(ends, t.ends[mine], "right")
                        size = last - first
                        token = _stretches(first, size)
                        lists[2 * side], lists[2 * side + 1] = ids[token], ends[token] + np.repeat(base, size)
                    lists[4] = np.intersect1d(lists[1], lists[3])
                for column, values in zip(out, lists):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.list_(pa.int32())) for c in out]], names=["doc_id", *names])

    return rows.mapInArrow(tasks, schema)


# ---------------------------------------------------------------- links


def _spelled(t: Tokens, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all pieces as `a1,a2|b1;` in one buffer, and the group of each of its bytes."""
    ids, group = np.concatenate([t.a_ids, t.b_ids]), np.concatenate([a_group, b_group])
    side = np.repeat([0, 1], [len(t.a_ids), len(t.b_ids)])
    order = np.argsort(2 * group + side, kind="stable")
    ids, group, side = ids[order], group[order], side[order]
    last = np.ones(len(ids), bool)
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(digits + 1)
    text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text[ends - 1] = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
    for k in range(int(digits.max()) if len(ids) else 0):
        on = digits > k
        text[ends[on] - 2 - k] = ord("0") + ids[on] // 10**k % 10
    return text, np.repeat(group, digits + 1)


_LISTS = {"pairs": pa.int64(), "docs": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
          "groups_sha256": pa.string(), "sizes": pa.int64(), "place": pa.int32(), "times": pa.int32()}


def _batch_row(batch: pa.RecordBatch, both: Tokenizers) -> dict:
    """The arrays of a batch: `pairs` and in how many documents each is, and for each document its figures and the `sizes` of its
    stretch of `place` (among pairs) and `times`."""
    codes, n, pieces = _split(batch.column(1), both.splits)
    t, place = both.tokens(pieces)
    codes = place[codes]
    within = lambda ends: np.diff(np.searchsorted(ends, np.concatenate([[0], t.ends]), "right"))
    n_a, n_b = within(t.a_ends), within(t.b_ends)
    # tokens that share bytes end a link at each end of either; groups end where both end
    at = np.searchsorted(t.a_ends, t.b_ends)
    same = t.a_ends[np.minimum(at, len(t.a_ends) - 1)] == t.b_ends if len(t.a_ends) else np.zeros(len(t.b_ends), bool)
    shared, both_ends = t.b_ends[same], np.sort(np.concatenate([t.a_ends, t.b_ends[~same]]), kind="stable")
    flat = t.a_ids[np.searchsorted(t.a_ends, both_ends)] << 32 | t.b_ids[np.searchsorted(t.b_ends, both_ends)]
    n_links, n_groups = within(both_ends), within(shared)
    text, group = _spelled(t, np.searchsorted(shared, t.a_ends), np.searchsorted(shared, t.b_ends))
    text_ends = np.searchsorted(group, np.cumsum(n_groups)).tolist()
    raw = text.tobytes()
    spelled = [raw[x:y] for x, y in zip([0, *text_ends], text_ends)]
    doc_of = np.repeat(np.arange(len(n)), n)
    bad = np.bincount(doc_of, weights=t.bad[codes], minlength=len(n)) > 0
    keep = ~bad[doc_of]
    codes, doc_of = codes[keep], doc_of[keep]
    total = lambda x: np.bincount(doc_of, weights=x[codes], minlength=len(n)).astype(np.int64)
    pairs, pair_of = np.unique(flat, return_inverse=True)
    many = n_links[codes]
    pair = pair_of[_stretches((np.cumsum(n_links) - n_links)[codes], many)]
    key, times = np.unique(np.repeat(doc_of, many) * max(len(pairs), 1) + pair, return_counts=True)
    doc, place = key // max(len(pairs), 1), key % max(len(pairs), 1)
    docs = np.bincount(place, minlength=len(pairs))
    used = np.cumsum(docs > 0) - 1  # pairs of texts without tokens only go
    ends = np.cumsum(np.where(bad, 0, n))
    code_list = codes.tolist()
    starts = ends - np.where(bad, 0, n)
    sha = [hashlib.sha256(b"".join([spelled[c] for c in code_list[a:b]])[:-1]).hexdigest() if b > a else "" for a, b in zip(starts.tolist(), ends.tolist())]
    return {"doc_id": batch.column(0), "pairs": pairs[docs > 0], "docs": docs[docs > 0], "n_a": total(n_a), "n_b": total(n_b), "n_groups": total(n_groups),
            "n_links": total(n_links), "groups_sha256": sha, "sizes": np.bincount(doc, minlength=len(n)), "place": used[place].astype(np.int32), "times": times.astype(np.int32)}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the rows of a batch with SLICE_BYTES of text at most; a longer text is taken alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] - size[row] + SLICE_BYTES, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def _batch_rows(batches: Iterator[pa.RecordBatch], files) -> Iterator[pa.RecordBatch]:
    both, task = _opened(files.value), TaskContext.get().partitionId()
    for k, batch in enumerate(_slices(batches)):
        row = _batch_row(batch, both)
        ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), row["doc_id"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | k], pa.int64()), ids, *[pa.array([row[c]], pa.list_(t)) for c, t in _LISTS.items()]], names=["batch", "doc_id", *_LISTS])


def _figures(cell, counts: np.ndarray, best: np.ndarray) -> dict:
    """Columns of the documents of a slice from its lists, cell(name), and the counts of its pairs."""
    array = lambda name: cell(name).to_numpy(zero_copy_only=False)
    sizes, place, times = array("sizes"), array("place"), array("times").astype(np.int64)
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    np.add.at(n_best, doc_of, times * best[place])
    np.add.at(count_sum, doc_of, times * counts[place])
    return {**{c: cell(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": cell("groups_sha256")}


def _figures_of_all(batches: Iterator[pa.RecordBatch], counted) -> Iterator[pa.RecordBatch]:
    """Rows of documents from rows of slices, with the counts of all pairs at hand."""
    pairs, counts, best = counted.value
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name: batch.column(batch.schema.get_field_index(name))[i].values  # noqa: B023, E731
            at = np.searchsorted(pairs, cell("pairs").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict(_figures(cell, counts[at], best[at]))


def _figures_of_slice(row: pa.Table, counted: pa.Table) -> pa.Table:
    """Rows of documents from the row of a slice and the counts of its pairs."""
    column = lambda name: counted[name].to_numpy()
    order = np.argsort(column("pair"))  # pairs are sorted within a slice, so their order is that of their places
    return pa.table(_figures(lambda name: row[name][0].values, column("count")[order].astype(np.int64), column("best")[order].astype(bool)))


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, count, best) from (pair, docs): the documents that hold a pair, and whether no pair of its A id has more."""
    counts = postings.groupBy("pair").agg(F.sum("docs").alias("count"))
    # at most a row for each id of A's vocabulary
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("top"))
    return counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def linked(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in the most documents of the pairs of its
    A id), count_sum (documents that hold the pair, summed over links), groups_sha256 (of the groups of align(), spelled
    `a1,a2|b1;a3|b2,b3`)."""
    spark = documents.sparkSession
    bound_batches(spark)
    files = _files(spark, a_path, b_path)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.string(): T.StringType()}
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("doc_id", T.ArrayType(rows.schema["doc_id"].dataType)),
                           *[T.StructField(c, T.ArrayType(kinds[t], False)) for c, t in _LISTS.items()]])
    path = new_folder(spark, "alignment")
    rows.mapInArrow(lambda it: _batch_rows(it, files), schema).write.options(**GROUP).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    postings = table.select("batch", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("batch", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts_path = new_folder(spark, "alignment-pairs")
    pair_counts(postings).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    figures = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(figures)])
    if counts.count() <= spread.BROADCAST_ROWS:
        known = counts.orderBy("pair").toArrow()
        counted = spark.sparkContext.broadcast((known["pair"].to_numpy(), known["count"].to_numpy(), known["best"].to_numpy()))
        return table.drop("docs").mapInArrow(lambda it: _figures_of_all(it, counted), out)
    back = spread.spread_join(postings.select("batch", "pair"), counts, ["pair"], by=["batch"])
    again = spark.read.schema(schema).parquet(path).drop("pairs", "docs")  # Spark can't tell the columns of two uses of a table apart here
    return again.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_figures_of_slice, out)
