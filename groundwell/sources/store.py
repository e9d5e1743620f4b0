"""The document and chunk store: keyed replacement, reconciliation, constraint checks, and table writes that swap in whole versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, key: str = "source_uri") -> DataFrame:
    """Rows of ``new`` in place of those with the same key; of new rows that share one, one stays (the least of them)."""
    others = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*others)).alias("row")).select(key, "row.*").select(*new.columns) if others else new.distinct()
    return current.join(one.select(key), key, "left_anti").unionByName(one)


def replace_chunks(current: DataFrame, new: DataFrame, ingested: DataFrame) -> DataFrame:
    """All chunks of ingested documents are those of ``new``; a document that gave none keeps its old ones."""
    done = ingested.join(new.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
    return current.join(done, "doc_id", "left_anti").unionByName(new)


def cascade(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose document exists."""
    return chunks.join(docs.select("doc_id"), "doc_id", "left_semi")


def missing_on_disk(registry: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """Registered documents below ``prefix`` that are no longer among ``files``."""
    return registry.where(F.col("source_uri").startswith(prefix)).join(files.select("source_uri"), "source_uri", "left_anti")


def cache_misses(pages: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    return pages.join(cache.select(key), key, "left_anti")


def violations(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rule`` and ``key`` of rows that break a constraint: unique URI, some department, an existing document."""
    twice = docs.groupBy("source_uri").count().where("count > 1").select(F.lit("unique_source_uri").alias("rule"), F.col("source_uri").alias("key"))
    closed = docs.where("allowed_depts is null or size(allowed_depts) = 0").select(F.lit("allowed_depts"), "source_uri")
    alone = chunks.join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit("chunk_document"), "chunk_id")
    return twice.union(closed).union(alone)


def ingest_status(docs: DataFrame, chunks: DataFrame, dry_run: bool = False) -> DataFrame:
    """``doc_id``, ``chunks_count`` and ``status`` of each parsed document."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_count"))
    out = docs.select("doc_id").join(counts, "doc_id", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0).cast("bigint")))
    return out.withColumn("status", F.when(F.col("chunks_count") == 0, "skipped_empty").otherwise("dry_run" if dry_run else "ingested"))


class VersionedTables:
    """Parquet tables that change together: a version is one folder with all of them, which counts once its marker is there.

    Readers see the last version that is whole, never one table of it without the others, also where a rename is not one step.
    """

    def __init__(self, spark: SparkSession, path: str, protected: bool = False):
        self.spark, self.path, self.protected = spark, path.rstrip("/"), protected

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_WHOLE")))

    def read(self, name: str, schema) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{versions[-1]}/{name}") if versions else self.spark.createDataFrame([], schema)

    def next_version(self) -> int:
        return (self._versions() or [0])[-1] + 1

    def paths(self, name: str, since: str | None = None) -> list[str]:
        """The folders of a table in all versions that have it, from the last one with the table ``since`` on if there is one."""
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = lambda v, table: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}/{table}"))
        versions = self._versions()
        first = max((v for v in versions if since and there(v, since)), default=0)
        return [f"{self.path}/v{v}/{name}" for v in versions if v >= first and there(v, name)]

    def write(self, expected: int | None = None, **tables: DataFrame | DataFrameWriter) -> int:
        """A new version of tables, or of writers with settings of their own; refused if it is not the ``expected`` one."""
        if self.protected:
            raise PermissionError(f"{self.path} is protected; write to a copy")
        jvm = self.spark._jvm
        version = self.next_version()
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        for name, table in tables.items():
            (table if isinstance(table, DataFrameWriter) else table.write).parquet(f"{staged}/{name}")
        if expected not in (None, self.next_version()):
            raise OSError(f"{self.path} has changed since version {expected - 1}")
        path, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, f"{self.path}/v{version}"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(target) or not fs.rename(path, target):
            raise OSError(f"version {version} of {self.path} could not be put in place")
        fs.create(jvm.org.apache.hadoop.fs.Path(target, "_WHOLE")).close()
        return version


    def apply(self, documents: DataFrame, chunks: DataFrame, kept: DataFrame) -> int:
        """Puts new rows in place of those of the same documents: ``kept`` are the new documents that gave chunks."""
        return self.write(documents=upsert(self.read("documents", documents.schema), kept), chunks=replace_chunks(self.read("chunks", chunks.schema), chunks, kept))


class VersionedTable:
    """One table of its own that is written in whole versions, or grows by segments."""

    def __init__(self, spark: SparkSession, path: str, protected: bool = False):
        self.spark, self._tables = spark, VersionedTables(spark, path, protected)

    def _versions(self) -> list[int]:
        return self._tables._versions()

    def read(self, schema) -> DataFrame:
        return self._tables.read("rows", schema)

    def write(self, df: DataFrame) -> int:
        return self._tables.write(rows=df)

    def segments(self, schema) -> DataFrame:
        """All rows since the last time that segments were made one."""
        paths = self._tables.paths("rows", since="base")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, df: DataFrame, fresh: bool = False) -> int:
        """Adds a segment; a ``fresh`` one takes the place of all before it."""
        return self._tables.write(rows=df, **({"base": self.spark.range(1)} if fresh else {}))

    def compact(self, schema, key: str, most: int = 16) -> bool:
        """Makes one segment, with one row for each ``key``, of more than ``most``."""
        if len(self._tables.paths("rows", since="base")) <= most:
            return False
        self.append(self.segments(schema).dropDuplicates([key]), fresh=True)
        return True


class Store(Protocol):
    """What documents are ingested into: whole versions (:class:`VersionedTables`) or buckets (:class:`~groundwell.sources.bucketed.BucketedStore`)."""

    spark: SparkSession
    path: str

    def apply(self, documents: DataFrame, chunks: DataFrame, kept: DataFrame) -> object: ...


def ingest(files: DataFrame, store: Store, allowed_depts: list[str], dry_run: bool = False, max_chars: int = 1500, overlap: int = 200, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Parses and chunks files and replaces their ``documents`` and ``chunks`` in one version; the status of each is returned.

    Files are read and parsed once. Running it again changes nothing; a file that gives no chunk keeps what it had. ``embed``, if given,
    adds a vector to each chunk.
    """
    from groundwell.operators.chunking import chunk_documents
    from groundwell.sources.parse import parse

    def made(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
        docs = parsed.select(F.sha2("source_uri", 256).alias("doc_id"), "source_uri", F.array(*map(F.lit, allowed_depts)).alias("allowed_depts"), "title")
        return docs, chunk_documents(parsed, max_chars, overlap)

    parsed = parse(files).select("source_uri", "title", "sections")
    if dry_run:
        return ingest_status(*made(parsed), True)
    # what was parsed goes into a table of its own, from which the next version and the status are made
    staged = VersionedTable(store.spark, f"{store.path}/_parsed-{uuid.uuid4().hex}")
    staged.write(parsed)
    new_docs, new_chunks = made(staged.read(parsed.schema))
    new_chunks = embed(new_chunks) if embed else new_chunks
    status = ingest_status(new_docs, new_chunks)
    kept = new_docs.join(status.where("status = 'ingested'").select("doc_id"), "doc_id", "left_semi")
    store.apply(new_docs, new_chunks, kept)
    return status


def purge(store: VersionedTables, gone: DataFrame, docs_schema, chunks_schema) -> int:
    """A version without the documents of ``gone`` (``source_uri``) and their chunks."""
    docs = store.read("documents", docs_schema).join(gone.select("source_uri"), "source_uri", "left_anti").select(*[f.split()[0] for f in docs_schema.split(", ")] if isinstance(docs_schema, str) else docs_schema.names)
    return store.write(documents=docs, chunks=cascade(store.read("chunks", chunks_schema), docs))
