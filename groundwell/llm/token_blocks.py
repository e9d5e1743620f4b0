"""Byte-level BPE of whole texts through a table of distinct chunks.

A text is cut only where the pre-tokenizer's pattern ends a piece whatever stands around it, so the ids of a text
are the ids of its chunks in order. Each distinct chunk of a block goes through the tokenizers library at most once
and, as long as the table has room, once in the life of a Python worker.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from groundwell.llm.blocks import binary_array, buffer_of

#: What a byte can be, one bit each. Not solid: controls, space, and the lead bytes of the white space at U+0085, U+00A0, U+1680, U+2000-U+205F and U+3000.
_SOLID, _PRINTABLE, _PUNCTUATION, _LETTER, _SPACE, _FEED = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:] |= _SOLID
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 0
_KIND[0x21:0x7F] |= _PRINTABLE
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] |= _PUNCTUATION
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_KIND[0x20] |= _SPACE
_KIND[0x0A] |= _FEED


class ChunkTable:
    """Distinct chunk -> bytes made from it by ``encode_many``; keeps at most ``room`` entries between blocks."""

    def __init__(self, encode_many, room: int):
        self.encode_many, self.room, self.known = encode_many, room, {}

    def values(self, distinct: list[str]) -> list[bytes]:
        known = self.known
        found = [known.get(x) for x in distinct]
        missing = [i for i, x in enumerate(found) if x is None]
        for i, value in zip(missing, self.encode_many([distinct[i] for i in missing]), strict=True):
            found[i] = value
            if len(known) < self.room:
                known[distinct[i]] = value
        return found


class ByteLevelEncoder:
    """``encode(column)`` gives the ids of all rows end to end and the offsets of each row."""

    def __init__(self, path: str, room: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        self.cuttable = (
            parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and parts.get("truncation") is None
        )
        self.added = [x["content"].encode() for x in parts.get("added_tokens") or []]
        self.width = np.dtype("<u4")
        self.table = ChunkTable(self._encode_many, room)

    def _encode_many(self, chunks: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        if sys.byteorder == "little":  # twice as fast
            return [array("I", x.ids).tobytes() for x in encoded]
        return [np.array(x.ids, self.width).tobytes() for x in encoded]

    def chunk_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where a chunk begins: at rows, and at cuts that no pre-token can span.

        A space before a byte that cannot be white space belongs to what follows; a line feed between a printable
        ASCII byte and a byte that cannot be white space stands alone; an ASCII letter never shares a pre-token with
        punctuation after it. Rows that hold an added token are not cut.
        """
        starts = np.zeros(len(data) + 1, bool)
        if self.cuttable and len(data) > 1:
            kind = _KIND[data]
            before_solid = np.flatnonzero(((kind[:-1] & (_SPACE | _FEED)) != 0) & ((kind[1:] & _SOLID) != 0))
            starts[before_solid[data[before_solid] == 0x20]] = True
            feeds = before_solid[data[before_solid] == 0x0A]
            feeds = feeds[(feeds > 0) & ((kind[feeds - 1] & _PRINTABLE) != 0)]
            starts[feeds] = starts[feeds + 1] = True
            starts[1:-1] |= ((kind[1:] & _PUNCTUATION) != 0) & ((kind[:-1] & _LETTER) != 0)
            whole = data.tobytes() if self.added else b""
            for token in self.added:
                at = whole.find(token)
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    starts[offsets[row] : offsets[row + 1]] = False
                    at = whole.find(token, int(offsets[row + 1]))
        starts[offsets] = True
        starts[len(data)] = False
        return np.flatnonzero(starts)

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = buffer_of(column)
        starts = self.chunk_starts(data, offsets)
        chunks = binary_array(data, np.append(starts, len(data))).view(pa.large_string()).dictionary_encode()
        values = pa.array(self.table.values(chunks.dictionary.to_pylist()), pa.large_binary())
        taken = values.take(chunks.indices)
        ids = np.frombuffer(taken.buffers()[2] or b"", self.width)
        after = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // self.width.itemsize if len(taken) else np.zeros(1, np.int64)
        rows = after[np.searchsorted(starts, offsets)]
        ids = ids[: rows[-1]]
        if end_id is not None:
            ids, rows = np.insert(ids, rows[1:], end_id), rows + np.arange(len(rows))
        return ids, rows


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One encoder for each Python worker, so that its table outlives a task."""
    return ByteLevelEncoder(path)
