"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file: the stream format plus a footer, so any batch of a memory-mapped file is reached at once
and its buffers are used in place. Each row is one sequence: ``ids``, a fixed-size list of 16-bit ids (32-bit beyond
65,536 ids), and ``mask``, a fixed-size list of booleans that is false on padding. Documents run through the rows of a file
one after another in ascending id order, each with an end id; only the last row of a file is padded. Beside it,
``.docs`` holds the documents' ids, starts and lengths.

Records are range-partitioned by id, so every task writes one file of a contiguous range. A task writes under a
temporary name and renames the file when it is whole; a repeated task writes the same bytes to the same name. The
manifest is a table written after all files: a file that it does not list does not count.

Defined results: null or empty text is the end id alone; null ids come first; equal ids are ordered by their text; an empty
table gives no files and an empty manifest; very long texts run over as many rows as they need, and a single one beyond a block
is encoded whole; columns other than id and text are ignored.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groundwell.llm.blocks import slices
from groundwell.llm.shared import id_and_text
from groundwell.llm.token_blocks import byte_level_encoder

_MANIFEST = "file_no bigint, path string, n_docs bigint, n_tokens bigint, seq_len int"


class SequenceWriter:
    """One file of sequences. ``close`` gives it and its document table their final names."""

    def __init__(self, folder: str, name: str, attempt: str, seq_len: int, wide: bool, batch_rows: int, id_type: pa.DataType):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.attempt, self.seq_len, self.rows = name, attempt, seq_len, batch_rows
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.schema = pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.docs_schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.fs.open_output_stream(self._temporary(""))
        self.docs_sink = self.fs.open_output_stream(self._temporary(".docs"))
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.docs_writer = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.left, self.n_left, self.n_tokens, self.n_docs = [], 0, 0, 0

    def _temporary(self, kind: str) -> str:
        return posixpath.join(self.folder, f"_{self.name}{kind}.{self.attempt}")

    def add(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs_writer.write_batch(pa.record_batch([keys, pa.array(offsets[:-1] + self.n_tokens), pa.array(np.diff(offsets))], schema=self.docs_schema))
        self.left.append(ids.astype(self.dtype))
        self.n_left += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += len(keys)
        if self.n_left >= self.rows * self.seq_len:
            self._write(self.n_left // (self.rows * self.seq_len) * self.rows)

    def _write(self, rows: int, padded: int = 0) -> None:
        ids = np.concatenate([*self.left, np.zeros(padded, self.dtype)])
        n = rows * self.seq_len
        mask = np.ones(n, bool)
        mask[n - padded :] = False
        for a in range(0, rows, self.rows):
            cut = slice(a * self.seq_len, min(a + self.rows, rows) * self.seq_len)
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids[cut]), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), self.seq_len)], schema=self.schema))
        self.left, self.n_left = [ids[n:].copy()], len(ids) - n

    def close(self) -> str:
        if self.n_left:
            rows = -(-self.n_left // self.seq_len)
            self._write(rows, rows * self.seq_len - self.n_left)
        for writer, sink in ((self.docs_writer, self.docs_sink), (self.writer, self.sink)):
            writer.close()
            sink.close()
        for kind in (".docs", ""):
            self.fs.move(self._temporary(kind), posixpath.join(self.folder, self.name + kind))
        return self.name


def write_sequences(df: DataFrame, folder: str, tokenizer_path: str, seq_len: int = 1024, end_id: int = 2, batch_rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents below ``folder`` and returns the manifest, one row for each file.

    ``base`` is the number of ids in the files before it, ``path`` is relative to ``folder``.
    """
    spark = df.sparkSession
    docs = id_and_text(df, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = byte_level_encoder(tokenizer_path), TaskContext.get()
        out = None
        for batch in slices(batches, "text", 8 << 20):
            out = out or SequenceWriter(f"{folder}/data", f"part-{task.partitionId():06d}.arrow", f"{task.taskAttemptId()}.tmp", seq_len, encoder.tokenizer.get_vocab_size() > 1 << 16, batch_rows, batch.schema.field("id").type)
            out.add(batch.column("id"), *encoder.encode(batch.column("text"), end_id))
        if out:
            yield pa.RecordBatch.from_pydict({"file_no": [task.partitionId()], "path": [f"data/{out.close()}"], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens], "seq_len": [seq_len]}, pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("seq_len", pa.int32())]))

    docs.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_sequences(folder: str, path: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.ipc.RecordBatchFileReader]:
    """The sequences and the documents of one file, memory-mapped where the folder is on a local or mounted disk."""
    fs, root = pafs.FileSystem.from_uri(folder)

    def reader(name: str) -> pa.ipc.RecordBatchFileReader:
        at = posixpath.join(root, name)
        return pa.ipc.open_file(pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at))

    return reader(path), reader(f"{path}.docs")


def file_ids(sequences: pa.ipc.RecordBatchFileReader, batch: int) -> np.ndarray:
    """The ids of one batch as they lie in the file, padding included."""
    rows = sequences.get_batch(batch).column("ids")
    return rows.flatten().to_numpy(zero_copy_only=True)


def read_documents(spark: SparkSession, folder: str, id_type: T.DataType, with_ids: bool = False) -> DataFrame:
    """One row for each document of the manifest's files: id, start over all files, length, checksum, optionally the ids."""
    files = read_manifest(spark, folder)
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for manifest in batches:
            for entry in manifest.to_pylist():
                sequences, docs = open_sequences(folder, entry["path"])
                at, batch, held, held_from = 0, 0, np.zeros(0, np.uint32), 0
                for k in range(docs.num_record_batches):
                    rows = docs.get_batch(k)
                    crcs, all_ids = [], []
                    for length in rows.column("n_tokens").to_pylist():
                        crc, parts, left = 0, [], length
                        while left:
                            if at == held_from + len(held):
                                held_from += len(held)
                                held = file_ids(sequences, batch).astype("<u4")
                                batch += 1
                            part = held[at - held_from : at - held_from + left]
                            crc = zlib.crc32(part, crc)
                            if with_ids:
                                parts.append(part)
                            at += len(part)
                            left -= len(part)
                        crcs.append(crc)
                        if with_ids:
                            all_ids.append(np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int32))
                    columns = [rows.column("id"), pa.array(rows.column("start").to_numpy() + entry["base"]), rows.column("n_tokens"), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    out = T.StructType([T.StructField("id", id_type)] + T._parse_datatype_string("start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids).fields)
    return files.select("file_no", "path", "base").repartitionByRange(n, "file_no").mapInArrow(run, out)
