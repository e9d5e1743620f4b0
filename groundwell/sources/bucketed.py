"""The document store in buckets: a change writes the buckets it touches, and a manifest says which folder holds each bucket.

Documents and their chunks lie in buckets by a hash of ``doc_id``, both tables of a change in one folder of its own. A version is one manifest, a small file that
names the folder of every bucket; readers take the newest and so see whole versions, and old folders stay readable until :meth:`BucketedStore.vacuum`.
Writers are optimistic: a manifest is put in place by a rename that fails if its number is taken. Then the change is put on top of the newer version if
that changed other buckets, and refused if it changed one of the same.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.sources.store import replace_chunks, upsert
from groundwell.sources.tables import stored


class ConflictError(OSError):
    """Another writer changed the same bucket meanwhile."""


def buckets_for(n_documents: int, least: int = 128, held: int = 256) -> int:
    """Buckets of about ``held`` documents: what a change writes then grows with the change and not with the store."""
    return max(least, -(-n_documents // held))


@dataclass(frozen=True)
class Version:
    """``number`` and the folder of each bucket that has one."""

    number: int
    folders: dict[int, str]


class BucketedStore:
    """``documents`` and ``chunks`` by ``doc_id``; no manifest has more entries than there are buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, protected: bool = False):
        self.spark, self.path, self.buckets, self.protected = spark, path.rstrip("/"), buckets, protected

    # Manifests

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()) if fs.exists(folder) else []

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that one; number 0 without folders before the first write."""
        numbers = self.numbers()
        number = number if number is not None else (numbers[-1] if numbers else 0)
        if number == 0:
            return Version(0, {})
        stream = self._fs().open(self._path(f"manifests/{number:010d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, {int(k): v for k, v in json.loads(text).items()})

    def _commit(self, base: Version, folders: dict[int, str | None]) -> Version:
        """A version with the changed buckets in their new folders (none: the bucket is empty) on top of the newest one."""
        while True:
            latest = self.version()
            taken = [b for b in folders if latest.folders.get(b) != base.folders.get(b)]
            if taken:
                raise ConflictError(f"buckets {taken} of {self.path} changed after version {base.number}")
            made = {b: f for b, f in (latest.folders | folders).items() if f}
            staged, target = self._path(f"_staged-{uuid.uuid4().hex}"), self._path(f"manifests/{latest.number + 1:010d}")
            fs = self._fs()
            fs.mkdirs(self._path("manifests"))
            out = fs.create(staged)
            out.write(bytearray(json.dumps(made, sort_keys=True).encode()))
            out.close()
            if not fs.exists(target) and fs.rename(staged, target):
                return Version(latest.number + 1, made)
            fs.delete(staged, False)  # another writer was first

    # Tables

    def bucket(self, key: Column | str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, name: str, schema, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of the newest version, or of another one, or its rows of some buckets."""
        version = version or self.version()
        wanted = version.folders if buckets is None else {b: version.folders[b] for b in buckets if b in version.folders}
        there = {folder: self._held(folder, name) for folder in set(wanted.values())}
        paths = [f"{self.path}/data/{folder}/{name}/bucket={b}" for b, folder in sorted(wanted.items()) if b in there[folder]]  # a bucket may have documents and no chunks
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, base: Version, touched: list[int], documents: DataFrame, chunks: DataFrame) -> Version:
        if self.protected:
            raise PermissionError(f"{self.path} is protected; write to a copy")
        folder = uuid.uuid4().hex
        for name, df in (("documents", documents), ("chunks", chunks)):
            rows = df.withColumn("bucket", self.bucket())
            rows.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}/{name}")
        held = self._held(folder, "documents")
        return self._commit(base, {b: folder if b in held else None for b in touched})

    def _held(self, folder: str, name: str) -> set[int]:
        """The buckets that a folder has of a table, by one listing."""
        fs, path = self._fs(), self._path(f"data/{folder}/{name}")
        names = (x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else ()
        return {int(x.split("=")[1]) for x in names if x.startswith("bucket=")}

    def apply(self, documents: DataFrame, chunks: DataFrame, kept: DataFrame) -> Version:
        """Puts new rows in place of those of the same documents: ``kept`` are the new documents that gave chunks."""
        base, kept = self.version(), stored(kept, "kept")
        touched = self._buckets_of(kept)
        if not touched:
            return base
        own = chunks.where(self.bucket().isin(touched))
        old_docs, old_chunks = (self.read(name, df.schema, base, touched) for name, df in (("documents", documents), ("chunks", chunks)))
        return self._write(base, touched, upsert(old_docs, kept), replace_chunks(old_chunks, own, kept))

    def remove(self, gone: DataFrame, documents_schema, chunks_schema) -> Version:
        """Takes out the documents of ``gone`` (``source_uri``) and their chunks."""
        base = self.version()
        ids = stored(gone.select(F.sha2("source_uri", 256).alias("doc_id")).distinct(), "gone")
        there = self._buckets_of(ids)
        touched = self._buckets_of(self.read("documents", documents_schema, base, there).join(ids, "doc_id", "left_semi"))
        if not touched:
            return base
        left = (self.read(name, schema, base, touched).join(ids, "doc_id", "left_anti") for name, schema in (("documents", documents_schema), ("chunks", chunks_schema)))
        return self._write(base, touched, *left)

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())  # no more than there are buckets

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last ``keep`` versions names, and older manifests; returns how many folders went. No writer may be at work."""
        fs, numbers = self._fs(), self.numbers()
        used = {f for n in numbers[-keep:] for f in self.version(n).folders.values()}
        old = [x.getPath() for x in fs.listStatus(self._path("data")) if x.getPath().getName() not in used] if fs.exists(self._path("data")) else []
        for path in [*(self._path(f"manifests/{n:010d}") for n in numbers[:-keep]), *old]:
            fs.delete(path, True)
        return len(old)
