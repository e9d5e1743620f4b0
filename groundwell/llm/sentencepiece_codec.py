"""SentencePiece encoding and decoding through a table of distinct marked words.

The library turns spaces into the marker U+2581 and puts one before the text. Where no piece of a model holds the
marker after another character, no merge crosses the place before a run of markers that follows a word. A text is cut
there; each distinct marked word (its run of markers and the characters up to the next run) is segmented and decoded
once, and the results are joined back by position with one gather per block.

The table belongs to a Python worker and holds a bounded number of words; words beyond it are segmented once per block.
A single table for the whole corpus would need every occurrence of every word to be shuffled to it and back, many
times the size of the texts, so words are joined where the texts are. A model that does not meet the conditions
(checked when it is loaded) encodes whole texts instead.

Defined results: null or empty text has no ids and decodes to the empty text; null and repeated ids are rows like any
other; very long texts are encoded whole, in a block of their own; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from groundwell.llm.blocks import binary_array, buffer_of, slices
from groundwell.llm.shared import id_and_text, schema_with_id

MARKER = "▁"


class PieceEncoder:
    def __init__(self, path: str, room: int = 600_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cuttable = self._keeps_words_apart()
        self.room = room
        #: Marked word without its first marker -> ids, their decimal text with a comma after each, and the decoded word.
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _keeps_words_apart(self) -> bool:
        """No piece with a marker after another character, a marker before the text, and no change to characters or spaces."""
        model = self.model
        if any(MARKER in model.id_to_piece(i).lstrip(MARKER) for i in range(model.get_piece_size())):
            return False
        probes = ("a", " a", "a  b ", " ", "ﬁ①Ａé 　x\t\r\n\ny")
        return all(model.decode(model.encode(x)) == x and not model.encode(x, out_type=str)[0].lstrip(MARKER) == model.encode(x, out_type=str)[0] for x in probes)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of marked words in rows that begin with one more space: rows, and spaces after a byte that ends no space or marker, but for a last byte."""
        starts = np.zeros(len(data) + 1, bool)
        if self.cuttable and len(data) > 1:
            starts[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)
        starts[np.maximum(offsets - 1, 0)] = False  # one space at the end of a row is no word of its own
        starts[offsets] = True
        starts[len(data)] = False
        return np.flatnonzero(starts)

    def entries(self, words: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        known = self.known
        found = [known.get(x) for x in words]
        missing = [i for i, x in enumerate(found) if x is None]
        encoded = self.model.encode([words[i] for i in missing], num_threads=1) if missing else []
        for i, ids, back in zip(missing, encoded, self.model.decode(encoded) if encoded else [], strict=True):
            entry = found[i] = (np.array(ids, "<u4").tobytes(), "".join(f"{x}," for x in ids).encode(), back.encode())
            if len(known) < self.room:
                known[words[i]] = entry
        return found

    def encode(self, column: pa.Array) -> tuple[list[np.ndarray], list[bytes], list[bytes]]:
        """For each row its ids, their decimal text, and the decoded text in UTF-8."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(column, "").cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, offsets = buffer_of(spaced)
        if not len(data):
            return [], [], []
        starts = self.cuts(data, offsets)
        table = binary_array(data, np.append(starts, len(data))).view(pa.large_string()).dictionary_encode()
        words = [x[1:] for x in table.dictionary.to_pylist()]
        entries = self.entries(words)
        rows = np.searchsorted(starts, offsets)
        parts = []
        for k in range(3):
            values = [x[k] for x in entries]
            if k == 2:  # a decoded text is its words with a space before each but the first
                values = [b" " + x for x in values]
            taken = pa.array(values, pa.large_binary()).take(table.indices)
            parts.append((memoryview(taken.buffers()[2] or b""), np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][rows].tolist()))
        (ids, a), (decimal, b), (decoded, c) = parts
        n = range(len(rows) - 1)
        return (
            [np.frombuffer(ids[a[i] : a[i + 1]], "<u4") for i in n],
            [bytes(decimal[b[i] : max(b[i], b[i + 1] - 1)]) for i in n],
            [bytes(decoded[c[i] + 1 : c[i + 1]]) for i in n],
        )


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_pieces(df: DataFrame, model_path: str, with_ids: bool = False, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the number of ids and digests of the ids and of the decoded text; optionally both themselves."""
    docs = id_and_text(df, id_col, text_col)
    out = schema_with_id(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        for batch in slices(batches, "text", 8 << 20):
            ids, decimal, decoded = encoder.encode(batch.column("text"))
            columns = [batch.column("id"), pa.array([len(x) for x in ids], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in texts]) for texts in (decimal, decoded)]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            if with_text:
                columns.append(pa.array([x.decode() for x in decoded]))
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return docs.mapInArrow(run, out).withColumnRenamed("id", id_col)
