"""URL filters: glob rules as a bit-parallel Shift-And automaton in several 64-bit words, all rules at once.

The canonical form of a url is `.host<FF>path`: the host after the first `://` up to `/ ? #`, A-Z lower-cased; the path up to
`?` or `#`; the byte FF, which no UTF-8 text holds, stands between. A rule `net/en/` becomes the glob `*.net<FF>/en/*`, so it
fits the host, its subdomains, and paths that start with `/en/`; of the rules that fit, the longest wins (of equal
lengths the longer host, then the smaller text). Urls that no rule fits are judged by globs over the same form (`*` any
bytes, `?` any one byte): an allow glob that fits wins over block globs; with neither the url is allowed.

Automaton: each glob takes a bit per literal byte or `?` and one before them; a state word set is shifted by one with the
carry between words, and-ed with the mask of the byte met, and bits whose position follows a `*` stay set. A batch of
urls goes through together in numpy, a byte position a step; the few longest urls of a batch end their way one by one, the
same words being one Python integer then, so a very long url costs its own bytes only. No step looks at a rule.

Defined results: null or no `://`: host and path are empty, no rule fits and the globs see `.<FF>`. Repeated rows get equal
verdicts; ties between rules end with the smaller text; a very long url is judged whole; rows keep their other columns, whatever
their names (host, path, rule and verdict are replaced); an empty rule list allows all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import numbered, text_slices

#: Between host and path; no byte of UTF-8.
BORDER = b"\xff"
#: So many texts or fewer are no longer worth a numpy step a byte.
LAST_ROWS = 4


@dataclass(frozen=True)
class Rule:
    """host and path prefix, as in `net/` or `example.net/en/`."""

    text: str
    allow: bool

    def glob(self) -> bytes:
        host, slash, path = self.text.partition("/")
        return b"*." + host.encode() + BORDER + (slash + path).encode() + b"*"


class Automaton:
    """All globs at once; run() tells for each text which of them fit."""

    def __init__(self, globs: list[bytes]):
        bit, self.finals, starts, stay, steps = 0, [], [], [], []
        for glob in globs:
            starts.append(bit)
            at = bit
            for c in glob:
                if c == 0x2A:
                    stay.append(at)
                else:
                    at += 1
                    steps.append((at, c))
            self.finals.append(at)
            bit = at + 1
        self.words = max(1, (bit + 63) // 64)
        self.start = self._mask(starts)
        self.stay = self._mask(stay)
        self.masks = np.zeros((256, self.words), np.uint64)
        for at, c in steps:
            rows = slice(None) if c == 0x3F else c
            self.masks[rows, at // 64] |= np.uint64(1 << (at % 64))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def run(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """States after each text; the texts are data[off[i]:off[i + 1]]."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")  # at step j the first rows are those that have a byte j
        state = np.tile(self.start, (len(size), 1))
        first, sizes = off[:-1][order], -size[order]
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(size.max()) if len(size) else 0):
            n = int(np.searchsorted(sizes, -j, "left"))
            if n <= LAST_ROWS:
                for r in range(n):
                    state[r] = self._alone(state[r], data[first[r] + j : first[r] - sizes[r]].tobytes())
                break
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.masks[data[first[:n] + j]]) | (now & self.stay)
        out = np.empty_like(state)
        out[order] = state
        return out

    def _alone(self, state: np.ndarray, rest: bytes) -> np.ndarray:
        """The state after the rest of one text, its words as one integer."""
        number = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        masks, stay, now = [number(m) for m in self.masks], number(self.stay), number(state)
        for c in rest:
            now = ((now << 1) & masks[c]) | (now & stay)
        return np.frombuffer(now.to_bytes(8 * self.words, "little"), "<u8").astype(np.uint64)

    def fits(self, states: np.ndarray) -> np.ndarray:
        """One boolean column a glob."""
        return np.stack([(states[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) for f in self.finals], axis=1).astype(bool) if self.finals else np.zeros((len(states), 0), bool)


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path as columns; empty where there is no `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, ascii_lower).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def _judge(batches: Iterator[pa.RecordBatch], rules: list[Rule], block: list[bytes], allow: list[bytes]) -> Iterator[pa.RecordBatch]:
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.text.partition("/")[0]), r.text))
    machine = Automaton([r.glob() for r in ranked] + allow + block)
    names = np.array([r.text for r in ranked] + [None], object)
    says = np.array([r.allow for r in ranked] + [False], bool)
    for batch in batches:
        host, path = (batch.column(batch.schema.get_field_index(c)).cast(pa.large_binary()) for c in ("host", "path"))
        mark = lambda b: pa.scalar(b, pa.large_binary())
        texts = pc.binary_join_element_wise(mark(b"."), host, mark(BORDER), path, mark(b""))
        ruled, fine = [], []
        for _, _, data, off in text_slices(pa.RecordBatch.from_arrays([texts.view(pa.large_string())], names=["x"]), "x"):
            fit = machine.fits(machine.run(data, off))
            own = fit[:, : len(ranked)]
            best = np.where(own.any(axis=1), own.argmax(axis=1) if len(ranked) else 0, len(ranked))
            globs = fit[:, len(ranked) :]
            free = globs[:, : len(allow)].any(axis=1) | ~globs[:, len(allow) :].any(axis=1)
            ruled.append(best)
            fine.append(np.where(best < len(ranked), says[best], free))
        best = np.concatenate(ruled) if ruled else np.zeros(0, np.int64)
        ok = np.concatenate(fine) if fine else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.where(ok, "allow", "block").tolist(), pa.string())],
            names=[*batch.schema.names, "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: list[Rule], *, block_globs: list[str] = (), allow_globs: list[str] = (), url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names that pages has already are replaced.

    In a glob the border of host and path is written as a space: `*casino* *` is a host with `casino` in it.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rows, (url,) = numbered(pages, url)
    host, path = canonical(F.col(url))
    rows = rows.withColumns({"host": host, "path": path})
    coded = [[g.encode().replace(b" ", BORDER) for g in globs] for globs in (block_globs, allow_globs)]
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("rule string, verdict string")])
    return rows.mapInArrow(lambda it: _judge(it, list(rules), *coded), schema).toDF(*pages.columns, "host", "path", "rule", "verdict")
