"""License scan by an exact set-similarity join of text blocks with notice templates.

Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII. The blocks of a template are overlapping windows of
words, twice as long as the template and starting every template length, so any place of its notice lies whole in one block. A template
is contained in a block to the share of its distinct words that the block holds; every block that holds at least
``threshold`` of its template is found:

- tokens are ordered by their count in all documents, rarest first;
- prefix filter: a block that misses all of the first ``n - need + 1`` tokens of a template cannot hold ``need`` of its ``n``;
- length filter: a block with fewer than ``need`` distinct words of any template cannot hold them;
- positional filter: after a first common token at place ``k`` of the template and ``j`` of the block's ordered tokens, at most
  ``n - k - 1`` and ``m - j - 1`` others are common;
- what is left is compared exactly.

The templates and their words are fixed and few, so the index on their prefixes is broadcast; texts are only read, twice (once
for the counts). Base labels come from places where the words of a phrase stand one after another.

Defined results: null or empty text has no words, no labels and score 0; null and repeated ids are rows like any other; equal counts
are ordered by the word; very long texts are scanned whole; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.blocks import Words, buffer_of, slices
from groundwell.llm.shared import id_and_text, schema_with_id

# Phrases and their labels, and notices in common use as they are published, whole or as a short reference.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_AS_IS = "including but not limited to procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (' + _AS_IS
_GPL = "as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl", "this work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + _GPL.format(version="2", work="program", name="General Public License")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + _GPL.format(version="3", work="program", name="General Public License")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _GPL.format(version="2.1", work="library", name="Lesser General Public License")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", _BSD_START + _BSD_END),
    ("bsd", _BSD_START + _BSD_NAMES + _BSD_END),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def template_words(text: str) -> list[str]:
    """The words of a phrase or template, by the rule for texts."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Vocabulary:
    """Numbers of the words of phrases and templates."""

    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]):
        split = [(label, template_words(x)) for label, x in templates]
        self.words = sorted({w for x in phrases for w in template_words(x)} | {w for _, x in split for w in x})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.phrases = [([self.number[w] for w in template_words(x)], label) for x, label in phrases.items()]
        #: Label, distinct words and length in words of each template.
        self.templates = [(label, sorted({self.number[w] for w in x}), len(x)) for label, x in split]

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of every word its number, -1 if it has none; and the bounds of each row's words."""
        data, offsets = buffer_of(column)
        data = _LOWER[data]
        words = Words(data, offsets, _IN_WORD[data])
        found = pc.index_in(words.array(), value_set=pa.array([w.encode() for w in self.words], pa.large_binary()))
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int32), words.rows


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> list[int]:
    """How often each word of the vocabulary stands in all documents; a row a word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch in slices(batches, "text", 8 << 20):
            total += np.bincount(vocabulary.numbers(batch.column("text"))[0] + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary.words))), pa.array(total[1:])], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = [0] * len(vocabulary.words)
    for r in found:
        counts[r["word"]] = r["n"]
    return counts


class PrefixIndex:
    """Finds, for the words of one document, the blocks that hold enough of a template."""

    def __init__(self, vocabulary: Vocabulary, counts: list[int], threshold: float):
        order = sorted(range(len(counts)), key=lambda w: (counts[w], vocabulary.words[w]))
        self.place = np.empty(len(counts), np.int64)
        self.place[order] = np.arange(len(counts))
        self.labels, self.tokens, self.lengths, self.need = [], [], [], []
        #: Word -> (template, place in its rarest-first tokens), only for words in the prefix.
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for label, words, length in vocabulary.templates:
            tokens = np.array(sorted(words, key=self.place.__getitem__))
            need = int(np.ceil(threshold * len(tokens) - 1e-9))
            for k, w in enumerate(tokens[: len(tokens) - need + 1].tolist()):
                self.prefix.setdefault(w, []).append((len(self.labels), k))
            self.labels.append(label)
            self.tokens.append(tokens)
            self.lengths.append(length)
            self.need.append(need)
        self.in_prefix = np.zeros(len(counts) + 1, bool)
        self.in_prefix[list(self.prefix)] = True

    def matches(self, numbers: np.ndarray) -> Iterator[tuple[str, int, float]]:
        """(label, first word of the block, containment) of one document."""
        first: dict[tuple[int, int], int] = {}
        for p in np.flatnonzero(self.in_prefix[numbers]).tolist():
            for template, k in self.prefix[int(numbers[p])]:
                block = p // self.lengths[template]
                for at in (block - 1, block) if block else (block,):
                    first[template, at] = min(k, first.get((template, at), k))
        for (template, block), k in sorted(first.items()):
            tokens, need, length = self.tokens[template], self.need[template], self.lengths[template]
            held = numbers[block * length : (block + 2) * length]
            known = np.unique(held[held >= 0])
            if len(known) < need:
                continue
            later = int((self.place[known] > self.place[tokens[k]]).sum())
            if 1 + min(len(tokens) - k - 1, later) < need:
                continue
            common = int(np.isin(tokens, known, assume_unique=True).sum())
            if common >= need:
                yield self.labels[template], block * length, common / len(tokens)


def _phrase_places(numbers: np.ndarray, rows: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where all words of a phrase stand in order within one row."""
    n = len(phrase)
    if len(numbers) < n:
        return np.zeros(0, np.int64)
    hit = np.ones(len(numbers) - n + 1, bool)
    for k, w in enumerate(phrase):
        hit &= numbers[k : k + len(hit)] == w
    at = np.flatnonzero(hit)
    row = np.searchsorted(rows, at, "right") - 1
    return at[at + n <= rows[row + 1]]


def scan(df: DataFrame, threshold: float = 0.9, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: counts, places and labels of phrases, all labels, and ``matches``.

    ``matches`` lists template label, first word of the block and containment; ``score`` is the largest containment, 1 where a
    whole phrase stands.
    """
    vocabulary = Vocabulary(PHRASES if phrases is None else phrases, templates)
    docs = id_and_text(df, id_col, text_col)
    index = PrefixIndex(vocabulary, word_counts(docs, vocabulary), threshold)
    out = schema_with_id(docs, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label: string, block_start: bigint, containment: double>>")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            numbers, rows = vocabulary.numbers(batch.column("text"))
            base: dict[int, list[tuple[int, str]]] = {}
            for phrase, label in vocabulary.phrases:
                at = _phrase_places(numbers, rows, phrase)
                for place, row in zip(at.tolist(), (np.searchsorted(rows, at, "right") - 1).tolist(), strict=True):
                    base.setdefault(row, []).append((place - int(rows[row]), label))
            hits = np.unique(np.searchsorted(rows, np.flatnonzero(index.in_prefix[numbers]), "right") - 1)
            found = {row: list(index.matches(numbers[rows[row] : rows[row + 1]])) for row in hits.tolist()}
            columns: list[list] = [[] for _ in range(7)]
            for row in range(batch.num_rows):
                places, matched = base.get(row, []), found.get(row, [])
                own = {x[1] for x in places}
                starts = [x[0] for x in places]
                values = (len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in matched})), 1.0 if places else max((x[2] for x in matched), default=0.0), [{"label": a, "block_start": b, "containment": c} for a, b, c in matched])
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(rows).astype(np.int64)), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return docs.mapInArrow(run, out).withColumnRenamed("id", id_col)
