"""Chat formatting by columnar byte assembly.

Template, a turn: `<|` role `|>` newline text `</s>` newline. In roles and texts the bytes of `<`, `[`, `|` and `\\` are
written as `\\l`, `\\b`, `\\p` and `\\\\`, so that no control string (`<|`, `|>`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`)
can come from a text, and the text can be had again exactly. The loss mask covers the text of assistant turns.

Assembly: lengths of all segments of a batch (marks, roles, contents) are known from column offsets and counts of escaped
bytes; cumulative sums give each segment's place; bytes are scattered into one buffer, which is the data of the Arrow column
as it stands. Offsets cut it into parts, and loss ranges are cut from the same offsets.

Rows are range-partitioned by (conversation, turn, role, beginning of the text) and sorted, so a conversation with a third of
all rows is formatted by as many tasks as it fills. A conversation comes out in parts of about `part_bytes` (cut between
turns, and where a batch or partition ends), numbered in order: its length is no matter of memory, and readers take parts in
order. Only the two digests of a conversation are made in one stream, as they must be.

Defined results: null roles and texts are empty; null turns come last; equal turns go by role, then text; rows repeat as
they are; very long texts are parts of their own; a null conversation id is a conversation; an empty table has none. Other
columns are not read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches

PARTS = "conv_id long, part long, formatted binary, loss array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
PART_BYTES = 4 << 20
OPEN, HEAD, CLOSE = b"<|", b"|>\n", b"</s>\n"
_ESCAPED = {0x3C: b"l", 0x5B: b"b", 0x7C: b"p", 0x5C: b"\\"}
_CODE = np.zeros(256, np.uint8)
for _byte, _letter in _ESCAPED.items():
    _CODE[_byte] = _letter[0]


def _column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def escape(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and their offsets."""
    special = _CODE[data] != 0
    shift = np.concatenate([[0], np.cumsum(special)])
    out = np.empty(len(data) + int(shift[-1]), np.uint8)
    place = np.arange(len(data)) + shift[:-1]
    out[place] = np.where(special, 0x5C, data)
    out[place[special] + 1] = _CODE[data[special]]
    return out, off + shift[off]


def _unescape(data: bytes) -> bytes:
    pieces = data.split(b"\\\\")
    return b"\\".join(p.replace(b"\\l", b"<").replace(b"\\b", b"[").replace(b"\\p", b"|") for p in pieces)


def _assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns, the turns' offsets in it, and where each content starts in it."""
    n = len(roles[1]) - 1
    const = lambda b: (np.tile(np.frombuffer(b, np.uint8), n), np.arange(n + 1) * len(b))
    segments = [const(OPEN), roles, const(HEAD), texts, const(CLOSE)]
    lengths = np.stack([np.diff(o) for _, o in segments], axis=1)
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(int(starts[-1]), np.uint8)
    begin = starts[:-1].reshape(n, len(segments))
    for k, (data, off) in enumerate(segments):
        out[np.arange(len(data)) + np.repeat(begin[:, k] - off[:-1], lengths[:, k])] = data
    return out, np.concatenate([begin[:, 0], starts[-1:]]) if n else np.zeros(1, np.int64), begin[:, 3]


def _format(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    # partitions are in the order of conversations, so these numbers rise along each conversation
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = escape(*_column(batch.column(2)))
        out, off, content = _assemble(escape(*_column(batch.column(1))), texts)
        ids = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        new = np.r_[True, (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])]
        begin = off[:-1][new][np.cumsum(new) - 1]  # where each turn's conversation begins
        piece = (off[:-1] - begin) // part_bytes
        new |= np.r_[True, piece[1:] != piece[:-1]]
        first = np.flatnonzero(new)
        cuts = np.r_[off[:-1][first], off[-1]]
        learned = pc.fill_null(pc.equal(batch.column(1), "assistant"), False).to_numpy(zero_copy_only=False)
        start = content - cuts[:-1][np.cumsum(new) - 1]
        ranges = np.stack([start, start + np.diff(texts[1])], axis=1)[learned].ravel()
        lists = np.r_[0, 2 * np.cumsum(learned)][np.r_[first, n]]
        formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])
        loss = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(ranges, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(number + np.arange(len(first))), formatted, loss], names=["conv_id", "part", "formatted", "loss"])
        number += len(first)


def format_conversations(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, formatted, loss): formatted is UTF-8, loss the byte ranges of it that are trained on."""
    spark = conversations.sparkSession
    bound_batches(spark)
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), F.col(turn).alias("turn"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(parts, *order, F.substring("text", 1, 32).asc_nulls_first()).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("conv_id", "role", "text")
    return rows.mapInArrow(lambda it: _format(it, part_bytes), PARTS)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn."""
    turns = formatted.split(CLOSE)
    if turns.pop() != b"":
        raise ValueError("the last turn has no end")
    out = []
    for t in turns:
        head, mark, body = t.partition(HEAD)
        if not head.startswith(OPEN) or not mark:
            raise ValueError("a turn has no head")
        out.append((_unescape(head[len(OPEN) :]), _unescape(body)))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    conv, started, state = None, False, None

    def fresh():
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def closed():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    names = [x.split()[0] for x in DIGESTS.split(", ")]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    for batch in batches:
        for conv_id, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            if started and conv_id != conv:
                rows.append(closed())
                started = False
            if not started:
                conv, started, state = conv_id, True, fresh()
            data = formatted.as_buffer().to_pybytes()
            for role, text in parse(data):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for a, b in zip(loss[::2], loss[1::2]):
                learned = _unescape(data[a:b])
                state[2] += len(learned.decode())
                state[3].update(learned)
            state[4] += len(data.decode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
            rows = []
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(closed(), schema)], schema=schema)


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted parts: turns, digest of turns, and length and digest of the text under the loss mask."""
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_digest, DIGESTS)
