"""License scan: a positional index of rare licence words, then alignment and mandatory phrases.

Words are runs of `[0-9a-z]` and non-ASCII characters after lower-casing A-Z. The vocabulary is the words of the licence templates;
its document frequencies are counted over all documents (one row a word comes to the driver). For each file and template the
ANCHORS words of the highest IDF that the file has are looked up in the template's postings; each place of such a word votes
for the relative position (place in the file - place in the template). Votes no more than SLACK apart form a run, and a run with at
least half of the anchors is a candidate. It is verified: every mandatory phrase of the template must stand within the run, and the
words of the template that stand at their place in it, give or take SLACK words, must have SHARE of its IDF weight.

Files are ruled out beforehand only where all their words together can't reach SHARE of a template, so nothing is lost by that. The
templates are a parameter; their index is some hundred words, sent to the tasks.

Fixed phrases (`phrases`) are found wherever their words stand consecutively, whatever the templates say.

Nulls and such: a null text has no words, score 0, no label. Very long texts are scanned whole, alone in their slice. Words of equal
IDF go by the word. Repeated rows agree. An empty table gives no rows. Only id and text are read, so clashing names don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import ALNUM, LOWER, bound_batches, text_slices, word_spans

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Rare words of a file that are looked up for a template, words that a place may be off, and the share of weight to be found.
ANCHORS, SLACK, SHARE = 12, 16, 0.6

#: Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    must: tuple[str, ...]


# Notices as their publishers give them, with phrases that no copy may lack.
TEMPLATES = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""", ("permission is hereby granted free of charge", "without restriction")),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""", ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""", ("permission to use copy modify", "with or without fee")),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""", ("except in compliance with the license",)),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details.""", ("under the terms of the gnu general public license",)),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", ("gnu lesser general public license",)),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means.""", ("free and unencumbered software", "public domain")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    Template("gpl", "licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
)


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Index:
    """Vocabulary, postings and phrases as ids; weights come with weigh()."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str]):
        texts = [words_of(t.text) for t in templates]
        must = [[words_of(p) for p in t.must] for t in templates]
        fixed = [(words_of(p), label) for p, label in phrases.items()]
        self.vocabulary = sorted({w for ws in [*texts, *(p for ps in must for p in ps), *(p for p, _ in fixed)] for w in ws})
        of = {w: i for i, w in enumerate(self.vocabulary)}
        ids = lambda ws: np.array([of[w] for w in ws], np.int64)
        self.labels = [t.label for t in templates]
        self.words, self.must = [ids(ws) for ws in texts], [[ids(p) for p in ps] for ps in must]
        self.phrases = [(ids(p), label) for p, label in fixed]

    def weigh(self, rows: int, docs: dict[int, int]) -> None:
        """IDF of each word, its rank (the rarest first, then by the word), and each word's part of each template."""
        self.idf = np.array([math.log(1 + (rows + 1) / (docs.get(i, 0) + 1)) for i in range(len(self.vocabulary))])
        self.rank = np.empty(len(self.idf), np.int64)
        self.rank[np.lexsort([np.arange(len(self.idf)), -self.idf])] = np.arange(len(self.idf))
        self.part = np.zeros((len(self.idf), len(self.words)))
        for t, ws in enumerate(self.words):
            np.add.at(self.part[:, t], ws, self.idf[ws] / self.idf[ws].sum())


def _coded(data: np.ndarray, off: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary id of each word (-1: none), and the first word of each text."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, off, ALNUM)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low[ALNUM[low]])]).dictionary_encode()
    ids = np.asarray(pc.fill_null(pc.index_in(words.dictionary, value_set=vocabulary), -1), np.int64)
    return (ids[np.asarray(words.indices, np.int64)] if len(starts) else np.zeros(0, np.int64)), first


def _count_batches(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    vocabulary = pa.array(words, pa.large_string())
    for batch in batches:
        docs = np.zeros(len(words), np.int64)
        for row, end, data, off in text_slices(batch, "text"):
            ids, first = _coded(data, off, vocabulary)
            seen = np.unique(np.repeat(np.arange(end - row), np.diff(first))[ids >= 0] * len(words) + ids[ids >= 0])
            docs += np.bincount(seen % max(len(words), 1), minlength=len(words))
        # one more entry counts the rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(words))), pa.array(np.concatenate([[batch.num_rows], docs]))], names=["word", "docs"])


def _places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Starts of a phrase."""
    at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


def _runs(ids: np.ndarray, index: Index, t: int) -> list[tuple[int, int, float, bool]]:
    """(first place, end, share, verified) of each candidate run of a template in a file."""
    words = index.words[t]
    have = np.intersect1d(words, ids)
    anchors = have[np.argsort(index.rank[have])][:ANCHORS]
    at = np.flatnonzero(np.isin(ids, anchors))
    votes = [(at[ids[at] == a][:, None] - np.flatnonzero(words == a)[None, :]).ravel() for a in anchors]
    offset = np.concatenate(votes)
    owner = np.repeat(np.arange(len(anchors)), [len(v) for v in votes])
    order = np.argsort(offset, kind="stable")
    offset, owner = offset[order], owner[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(offset) > SLACK) + 1, [len(offset)]])
    run_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    seen = np.bincount(np.unique(run_of * len(anchors) + owner) // len(anchors))
    n = len(ids) + 1
    keys = np.sort(ids * n + np.arange(len(ids)))[np.count_nonzero(ids < 0) :]
    places = [_places(ids, p) for p in index.must[t]]
    j, out = np.arange(len(words)), []
    for r in np.flatnonzero(2 * seen >= len(anchors)).tolist():
        lo, hi = int(offset[edges[r]]), int(offset[edges[r + 1] - 1])
        first, last = np.clip(lo + j - SLACK, 0, n - 1), np.clip(hi + j + SLACK, -1, n - 1)
        k = np.searchsorted(keys, words * n + first)
        hit = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] <= words * n + last) & (last >= first)
        share = float(index.idf[words[hit]].sum() / index.idf[words].sum())
        a, b = max(0, lo - SLACK), min(len(ids), hi + len(words) + SLACK)
        whole = all(np.any((p >= a) & (p + len(index.must[t][i]) <= b)) for i, p in enumerate(places))
        out.append((max(0, lo), min(len(ids), hi + len(words)), min(1.0, share), whole and share >= SHARE))
    return out


def _scan(batches: Iterator[pa.RecordBatch], index: Index, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    vocabulary = pa.array(index.vocabulary, pa.large_string())
    for batch in batches:
        n_words = np.zeros(batch.num_rows, np.int64)
        fixed: list[list] = [[] for _ in range(batch.num_rows)]
        matches: list[list] = [[] for _ in range(batch.num_rows)]
        score = np.zeros(batch.num_rows)
        for row, end, data, off in text_slices(batch, "text"):
            ids, first = _coded(data, off, vocabulary)
            n_words[row:end] = np.diff(first)
            text_of = np.repeat(np.arange(end - row), np.diff(first))
            for phrase, label in index.phrases:
                at = _places(ids, phrase)
                at = at[text_of[at] == text_of[at + len(phrase) - 1]]
                for d, p in zip(text_of[at].tolist(), (at - first[text_of[at]]).tolist()):
                    fixed[row + d].append({"start": p, "label": label})
            has = np.zeros((end - row, len(index.vocabulary)), bool)
            has[text_of[ids >= 0], ids[ids >= 0]] = True
            for d, t in np.argwhere(has @ index.part >= SHARE - 1e-9).tolist():
                for a, b, share, verified in _runs(ids[first[d] : first[d + 1]], index, t):
                    score[row + d] = max(score[row + d], share)
                    if verified:
                        matches[row + d].append({"start": a, "end": b, "label": index.labels[t], "share": share})
        for found in (*fixed, *matches):
            found.sort(key=lambda x: (x["start"], x["label"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(fixed, schema.field("phrases").type), pa.array(matches, schema.field("matches").type), pa.array(score)], names=["doc_id", "n_words", "phrases", "matches", "score"])


def scan(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, phrases (start word and label of each place of a fixed phrase), matches (first word, end,
    label and share of each verified run), score (the highest share of any candidate run, else 0)."""
    spark = documents.sparkSession
    bound_batches(spark)
    index = Index(templates, PHRASES if phrases is None else phrases)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    words = index.vocabulary
    counted = rows.select("text").mapInArrow(lambda it: _count_batches(it, words), "word long, docs long").groupBy("word").agg(F.sum("docs"))
    docs = {r[0]: r[1] for r in counted.collect()}  # a row for each word of the templates
    index.weigh(docs.get(-1, 0), docs)
    place = [("start", pa.int64())]
    kinds = {"phrases": pa.list_(pa.struct([*place, ("label", pa.string())])), "matches": pa.list_(pa.struct([*place, ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))}
    arrow = pa.schema(list(kinds.items()))
    ddl = "n_words long, phrases array<struct<start: long, label: string>>, matches array<struct<start: long, `end`: long, label: string, share: double>>, score double"
    return rows.mapInArrow(lambda it: _scan(it, index, arrow), T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(ddl)]))
