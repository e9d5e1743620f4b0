"""Hierarchical multi-length packing.

Documents become token ids plus an end id and are routed to context-size tiers (powers of two up to the longest
window): a document longer than the longest window first gives whole windows, and what remains goes to the smallest
tier that holds it. Windows of the long tiers are opened by the pieces routed there; their gaps are filled with whole
pieces of shorter tiers, the longest that fits first, and a last gap with the head of a cut piece; pieces that are left are
packed in the windows of their own tier alike, longest tier first. The windows of each tier in a batch are then dealt into step
groups of about equal attention cost (the sum of squared piece lengths).

Every window is exactly full: documents may be cut anywhere, and the last tokens of a task, under one longest window, are divided
into windows whose sizes are powers of two, so no padding is written. Packing is a map over input partitions: nothing is shuffled, no document
leaves its task, and memory is bounded by one block of texts plus the open pieces of one batch of windows.

Defined results: null or empty text is one piece, the end id alone; null and repeated ids are packed like any other row;
an empty table gives no pieces; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from groundwell.llm.blocks import slices
from groundwell.llm.shared import id_and_text, schema_with_id
from groundwell.llm.token_blocks import byte_level_encoder

_FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


class TierPacker:
    """Packs pieces (document, start, length) of one task. ``flush`` returns windows, each a list of pieces."""

    def __init__(self, longest: int):
        assert longest & (longest - 1) == 0, "the longest window is a power of two"
        self.longest = longest
        self.tiers = [1 << k for k in range(longest.bit_length())]
        #: By length: the pieces that wait, last in first out.
        self.waiting: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        #: By tier: how many tokens wait.
        self.held = dict.fromkeys(self.tiers, 0)
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def tier_of(self, length: int) -> int:
        return 1 << (length - 1).bit_length()

    def add(self, doc: int, tokens: int) -> None:
        whole = tokens // self.longest * self.longest
        for start in range(0, whole, self.longest):
            self.windows.append((self.longest, [(doc, start, self.longest)]))
        if tokens > whole:
            self._wait(doc, whole, tokens - whole)

    def _wait(self, doc: int, start: int, length: int) -> None:
        if not self.waiting.get(length):
            self.waiting[length] = []
            self.lengths.insert(bisect_right(self.lengths, length), length)
        self.waiting[length].append((doc, start))
        self.held[self.tier_of(length)] += length

    def _take(self, at: int) -> tuple[int, int, int]:
        length = self.lengths[at]
        doc, start = self.waiting[length].pop()
        self.held[self.tier_of(length)] -= length
        if not self.waiting[length]:
            del self.waiting[length]
            del self.lengths[at]
        return doc, start, length

    def _fill(self, window: int) -> None:
        """One window: the longest piece that waits, then whole pieces into the gap, then the head of a cut one."""
        pieces, gap = [], window
        while gap:
            at = bisect_right(self.lengths, gap) - 1
            if at >= 0:
                doc, start, length = self._take(at)
            else:
                doc, start, whole = self._take(0)
                length = gap
                self._wait(doc, start + length, whole - length)
            pieces.append((doc, start, length))
            gap -= length
        self.windows.append((window, pieces))

    def flush(self, last: bool) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Windows of each tier while a piece of it waits and the tokens of its and shorter tiers fill one; at last all that is left."""
        for tier in reversed(self.tiers):
            while self.held[tier] and sum(self.held[x] for x in self.tiers if x <= tier) >= tier:
                self._fill(tier)
        left = sum(self.held.values())  # less than one longest window
        for tier in reversed(self.tiers[:-1]) if last else ():
            if left & tier:
                self._fill(tier)
        windows, self.windows = self.windows, []
        return windows


def step_groups(windows: list, group_size: int) -> list[int]:
    """The group of each window: windows in descending order of cost are dealt to and fro over the groups."""
    cost = np.array([sum(x[2] ** 2 for x in pieces) for _, pieces in windows])
    groups = -(-len(windows) // group_size)
    rank = np.empty(len(windows), np.int64)
    rank[np.argsort(-cost, kind="stable")] = np.arange(len(windows))
    turn, place = np.divmod(rank, max(groups, 1))
    return np.where(turn % 2, groups - 1 - place, place).tolist()


def tier_groups(windows: list, group_size: int) -> list[int]:
    """The step group of each window; a group holds windows of one tier."""
    groups, used = [0] * len(windows), 0
    for tier in sorted({tier for tier, _ in windows}, reverse=True):
        own = [k for k, (t, _) in enumerate(windows) if t == tier]
        dealt = step_groups([windows[k] for k in own], group_size)
        for k, g in zip(own, dealt, strict=True):
            groups[k] = used + g
        used += max(dealt) + 1
    return groups


def pack(df: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, group_size: int = 64, batch_tokens: int = 1_000_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the document, its place there and in its sequence, and optionally the ids themselves.

    ``tier`` is the window size of the sequence, ``step_group`` the training step it was dealt to. Sequence and group
    numbers are unique over all tasks. ``batch_tokens`` bounds the windows that are dealt to groups at once.
    """
    docs = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = byte_level_encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        packer, sequence, group, pending = TierPacker(window), base, base, 0
        open_docs: dict[int, tuple] = {}
        number = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal sequence, group
            windows = packer.flush(last)
            dealt = tier_groups(windows, group_size)
            rows: list[list] = [[] for _ in range(9)]
            parts = []
            for (tier, pieces), own in zip(windows, dealt, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    key, ids = open_docs[doc]
                    part = ids[start : start + length]
                    for column, value in zip(rows, (key, start, length, zlib.crc32(part), len(ids), sequence, offset, tier, group + own), strict=True):
                        column.append(value)
                    if with_ids:
                        parts.append(part)
                    offset += length
                sequence += 1
            group += max(dealt, default=-1) + 1
            waits = {doc for x in packer.waiting.values() for doc, _ in x}
            for doc in [x for x in open_docs if x not in waits]:
                del open_docs[doc]
            for doc in waits:  # else a waiting tail keeps the ids of its whole block
                open_docs[doc] = (open_docs[doc][0], open_docs[doc][1].copy())
            columns = [pa.array(x, f.type) for x, f in zip(rows, schema, strict=False)]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(rows[2], dtype=np.int64)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in slices(batches, "text", 2 << 20):
            ids, offsets = encoder.encode(batch.column("text"), end_id)
            for key, a, b in zip(batch.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                open_docs[number] = (key, ids[a:b])
                packer.add(number, b - a)
                number += 1
                pending += b - a
            if pending >= batch_tokens:
                yield emit(False)
                pending = 0
        yield emit(True)

    out = schema_with_id(docs, _FIELDS + (", ids array<int>" if with_ids else ""))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    return docs.mapInArrow(run, out).withColumnRenamed("id", id_col)
