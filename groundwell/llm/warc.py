"""A deterministic sharded WARC writer, and a reader.

Records are range-sorted by their id over shards. A shard is a run of files ``shard-00000-000.warc.gz`` of gzip members, one for
each record; a file is closed once it holds ``roll_bytes`` of compressed data. All headers are regenerated: record ids from the
ids of the rows, digests (SHA-1) of payload and block, lengths, a given date. A file is written under a temporary name with
the number of the task attempt and renamed when whole; a repeated task writes the same bytes to the same names. The manifest, a
table of shards, files, records and bytes, is written last, and readers read only what it lists.

Of records whose payloads of at least ``min_revisit_bytes`` are equal, the one with the largest id is a response and the
others are revisits that refer to it. Digests alone are compared and moved to find them; payloads are shuffled once, by the range
sort, together with the decisions.

Defined results: null html is an empty payload; null url is ``urn:unknown``, and characters that a header cannot carry are
percent-encoded; null ids come first and are never referred to unless all of their group are null; rows that share the largest id are all responses; repeated rows
are records of their own; very long pages are one record, larger than a file may be by itself if need be; an empty table gives no files and an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.shared import bound_batches

_MANIFEST = "shard bigint, file int, path string, n_records bigint, n_bytes bigint"
_ORIGIN = "urn:x-page:"


def _urn(page: object) -> str:
    """The record id of a row's id: nothing for null, numbers as they are, other text percent-encoded (a bare ``%`` if it is empty)."""
    return f"<{_ORIGIN}{'' if page is None else quote(str(page), safe='') or '%'}>"


def _id_of(urn: str) -> str | None:
    tail = urn.strip("<>").removeprefix(_ORIGIN)
    return None if not tail else "" if tail == "%" else unquote(tail)


def _record(page: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; the block of a revisit is the HTTP header alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:unknown")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class ShardWriter:
    def __init__(self, folder: str, shard: int, attempt: int, roll_bytes: int, level: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.shard, self.attempt, self.roll_bytes, self.level = shard, attempt, roll_bytes, level
        self.files: list[tuple[int, str, int, int]] = []
        self.sink, self.records, self.bytes = None, 0, 0

    def _name(self) -> str:
        return f"shard-{self.shard:05d}-{len(self.files):03d}.warc.gz"

    def add(self, record: bytes) -> None:
        if not self.sink:
            self.sink = self.fs.open_output_stream(posixpath.join(self.folder, f"_{self._name()}.{self.attempt}.tmp"), compression=None)
        member = gzip.compress(record, self.level, mtime=0)
        self.sink.write(member)
        self.records += 1
        self.bytes += len(member)
        if self.bytes >= self.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if self.sink:
            self.sink.close()
            name = self._name()
            self.fs.move(posixpath.join(self.folder, f"_{name}.{self.attempt}.tmp"), posixpath.join(self.folder, name))
            self.files.append((len(self.files), name, self.records, self.bytes))
            self.sink, self.records, self.bytes = None, 0, 0


def revisits(pages: DataFrame, min_revisit_bytes: int, salts: int) -> DataFrame:
    """``id``, ``sha1`` and ``refers_to`` of the rows that repeat a larger row's payload.

    Groups are counted per digest after a partial aggregation; only groups of several rows go on, once for each salt, so
    that the rows of a large group meet their group in as many tasks.
    """
    digests = pages.select("id", F.sha1("payload").alias("sha1"), F.length("payload").alias("n")).where(F.col("n") >= min_revisit_bytes)
    groups = digests.groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    salted = groups.select("sha1", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = digests.select("id", "sha1", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    return rows.join(salted, ["sha1", "salt"]).where("not (id <=> refers_to)").select("id", "sha1", "refers_to").distinct()


def write_warc(df: DataFrame, folder: str, roll_bytes: int = 64 << 20, min_revisit_bytes: int = 1000, level: int = 6, date: str = "2026-01-01T00:00:00Z", salts: int = 32, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all rows below ``folder`` and returns the manifest. Ids may be of any type that has an order and a text form."""
    bound_batches(df.sparkSession)
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    decided = revisits(pages, min_revisit_bytes, salts)
    # decisions sort before the record of the same id and payload, so one shuffle brings both to the writer
    both = pages.select("id", F.lit(1).alias("kind"), F.sha1("payload").alias("sha1"), "url", "payload", F.lit(None).cast(pages.schema["id"].dataType).alias("refers_to")).unionByName(decided.select("id", F.lit(0).alias("kind"), "sha1", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to"))
    both = both.repartitionByRange("id").sortWithinPartitions("id", "sha1", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, decision = None, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("id", "kind", "sha1", "url", "payload", "refers_to")), strict=True):
                page, kind, digest, url, payload, refers_to = row
                if kind == 0:
                    decision = (page, digest, refers_to)
                    continue
                out = out or ShardWriter(f"{folder}/warc", task.partitionId(), task.taskAttemptId(), roll_bytes, level)
                revisit = decision is not None and decision[:2] == (page, digest)
                out.add(_record(page, url, payload, decision[2] if revisit else None, revisit, date))
        if out:
            out.roll()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(out.shard, *f) for f in out.files], strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "file", "path", "n_records", "n_bytes"])

    both.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file of gzip members, read piece by piece."""
    inflate, text, data = zlib.decompressobj(31), bytearray(), b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        text += inflate.decompress(data)
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            head, _, rest = bytes(text).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            inflate, text = zlib.decompressobj(31), bytearray()


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False, id_type: str = "bigint") -> DataFrame:
    """One row for each record of the manifest's files.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: recomputed for responses, from the headers for revisits.
    A record whose block does not have the digest in its header stops the read.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(posixpath.join(root, "warc", name), compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
                            raise ValueError(f"{name}: block digest of {fields['WARC-Record-ID']}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["WARC-Type"] == "revisit"
                        length = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
                        rows.append((_id_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], _id_of(fields["WARC-Refers-To"]) if revisit else None, payload if with_payload and not revisit else None))
                        held += len(payload) if with_payload else 100
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = ("id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        k = 7 if with_payload else 6
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True))[:k], types[:k], strict=True)], list(names[:k]))

    found = manifest.select("shard", "file", "path").repartitionByRange(n, "shard", "file").mapInArrow(run, "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)
    return found.withColumns({"id": F.col("id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
