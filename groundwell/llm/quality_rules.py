"""Quality rules as a short-circuit cascade.

A rule rejects documents by counts over their words and lines. Its cost (seconds a document) and selectivity (rejected
share) are measured on a sample; the rules then run in descending order of rejection per cost, each over the documents
that all rules before it kept. The order changes the work, never the verdict: a document is kept if no rule rejects it.

Words are runs of characters outside space and the controls 9 to 13. A document is rejected if
- ``short``: it has fewer than 50 words,
- ``repeats``: over half of its words stand in 3-word windows that occur twice or more in it,
- ``symbols``: it has more than one of the characters ``#*$%&|<>`` in ten words,
- ``capitals``: over half of its ASCII letters are capitals,
- ``lines``: over half of its lines with a word repeat an earlier line,
- ``word_length``: its mean word is shorter than 2 or longer than 20 characters.

Defined results: null or empty text has no words and is rejected as short; null and repeated ids are rows like any other; an
empty table gives an empty result; other columns pass through :func:`keep_good` unchanged and are ignored elsewhere.
Counts cover whole texts of any length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from groundwell.llm.blocks import IS_SPACE, Words, binary_array, buffer_of, row_numbers, slices, sums
from groundwell.llm.shared import bound_batches, id_and_text, schema_with_id, text_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SMALL = np.zeros(256, bool)
_SMALL[ord("a") : ord("z") + 1] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


class Texts:
    """A block of texts; every count is made when it is first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> Texts:
        kept = np.zeros(len(self), bool)
        kept[rows] = True
        lengths = np.diff(self.offsets)
        return Texts(self.data[np.repeat(kept, lengths)], np.concatenate([[0], np.cumsum(lengths[kept])]))

    @cached_property
    def words(self) -> Words:
        return Words(self.data, self.offsets, ~IS_SPACE[self.data])

    @property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        return sums(~(IS_SPACE | _CONTINUES)[self.data], self.offsets)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return sums(_SYMBOL[self.data], self.offsets)

    @cached_property
    def capitals(self) -> tuple[np.ndarray, np.ndarray]:
        return sums(_CAPITAL[self.data], self.offsets), sums(_SMALL[self.data], self.offsets)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: its lines with a word, and those of them that equal an earlier line."""
        feed = self.data == 0x0A
        #: a line begins at each row, also an empty one, and after each feed within the row
        begins = np.sort(np.concatenate([self.offsets[:-1], np.flatnonzero(feed) + 1]))
        of_row = np.searchsorted(self.offsets[1:-1], begins, "right") if len(self) > 1 else np.zeros(len(begins), np.int64)
        if len(feed):  # what begins after a feed belongs to the row of the feed, even at its end
            after = np.concatenate([np.zeros(len(self), bool), np.ones(int(feed.sum()), bool)])
            rows = np.concatenate([np.arange(len(self)), np.searchsorted(self.offsets, np.flatnonzero(feed), "right") - 1])
            order = np.lexsort((after, np.concatenate([self.offsets[:-1], np.flatnonzero(feed) + 1]), rows))
            begins, of_row = np.concatenate([self.offsets[:-1], np.flatnonzero(feed) + 1])[order], rows[order]
        ends = np.append(begins[1:], len(self.data))
        worded = np.searchsorted(self.words.starts, ends) > np.searchsorted(self.words.starts, begins)
        solid = np.concatenate([[0], np.cumsum(~feed)])
        bounds = np.append(solid[begins], solid[-1])
        same = binary_array(self.data[~feed], bounds).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.flatnonzero(worded)
        key = of_row[place] * (len(same) + 1) + same[place]
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(place), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return np.bincount(of_row[place], minlength=len(self)), np.bincount(of_row[place[again]], minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        ids, rows = self.words.ids(), self.words.rows
        of_row = row_numbers(rows)
        marked = np.zeros(len(ids), bool)
        if len(ids) >= 3:
            at = np.flatnonzero(of_row[:-2] == of_row[2:])
            distinct = int(ids.max()) + 1
            if distinct <= 1 << 21:
                key = ids[at] << 42 | ids[at + 1] << 21 | ids[at + 2]
            else:  # pairs are numbered first, so that three words always fit
                pair = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)[1]
                key = pair << 32 | ids[at + 2]
            order = np.argsort(key, kind="stable")
            same = (key[order[1:]] == key[order[:-1]]) & (of_row[at[order[1:]]] == of_row[at[order[:-1]]])
            twice = np.zeros(len(at), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            for step in range(3):
                marked[at[twice] + step] = True
        return sums(marked, rows)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def _mean_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)


RULES = (
    Rule("short", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: t.capitals[0] > t.capitals[1]),
    Rule("lines", lambda t: 2 * t.lines[1] > t.lines[0]),
    Rule("word_length", _mean_length),
)


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Whether each text is kept. A rule sees only what the rules before it kept."""
    alive = np.arange(len(texts))
    for rule in rules:
        bad = rule.rejects(texts)
        if bad.any():
            alive, texts = alive[~bad], texts.take(np.flatnonzero(~bad))
        if not len(alive):
            break
    return alive


def measured_order(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 17, text_col: str = "text") -> tuple[Rule, ...]:
    """Rules by rejection per cost on a random sample of about ``sample_rows`` rows; each is timed with nothing counted before."""
    total = df.count()
    sample = df.select(text_of(text_col).alias("text")).sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            for k, rule in enumerate(rules):
                texts = Texts(*buffer_of(batch.column("text")))
                began = time.thread_time()
                bad = int(rule.rejects(texts).sum())
                yield pa.RecordBatch.from_pydict({"rule": [k], "rejected": [bad], "seconds": [time.thread_time() - began]})

    found = sample.mapInArrow(run, "rule bigint, rejected bigint, seconds double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    value = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in found.collect()}  # a row for each rule
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-value.get(k, 0.0), k)))


def score_rules(df: DataFrame, rules: tuple[Rule, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word and line counts of every row, whether the first two rules reject it, and the cascade's verdict."""
    rules = rules or measured_order(df, text_col=text_col)
    docs = id_and_text(df, id_col, text_col)
    out = schema_with_id(docs, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = Texts(*buffer_of(batch.column("text")))
            kept = np.zeros(len(texts), bool)
            kept[cascade(texts, rules)] = True
            failed = (texts.n_words < 50) | (100 * texts.n_repeat_words > 50 * texts.n_words)
            counts = (texts.n_words, texts.word_chars, texts.n_symbols, texts.lines[1], texts.n_repeat_words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x.astype(np.int64)) for x in counts), pa.array(failed), pa.array(kept & ~failed)], out.names)

    return docs.mapInArrow(run, out).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, rules: tuple[Rule, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the cascade keeps, with all their columns; rejected rows stop at the first rule that rejects them."""
    bound_batches(df.sparkSession)
    rules = rules or measured_order(df, text_col=text_col)
    schema, own = df.schema, text_col
    if not isinstance(schema[text_col].dataType, StringType):  # judged as text, passed on as it is
        while own in df.columns:
            own += "_"
        df = df.withColumn(own, text_of(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, own, 2 << 20):
            kept = cascade(Texts(*buffer_of(batch.column(own))), rules)
            if len(kept):
                yield batch.select(schema.names).take(pa.array(kept))

    return df.mapInArrow(run, schema)
