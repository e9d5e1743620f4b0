"""Tables of files, spread over the cores even where a file is too small to be split, and rows held in memory."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

CHUNK_ROWS = "chunk_id string, doc_id string, source_uri string, chunk_text string, context_prefix string, loc string, metadata map<string,string>"


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table. One with fewer splits than cores is dealt anew by ``key``; larger ones are left where they are."""
    df = spark.read.parquet(path)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if size < cores * min(split, 8 << 20) else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session (``spark.checkpoint.dir``).

    Only a session without that setting, as in tests, gets a temporary folder of this machine; a cluster of several machines needs it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = context._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="groundwell-")
        context.setCheckpointDir(base)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/groundwell/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def memory_chunks(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Chunks held by the caller as a table: what is missing is null, ids are numbered."""
    names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
    made = [tuple(({"chunk_id": str(k), "doc_id": r.get("source_uri")} | r).get(n) for n in names) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, CHUNK_ROWS)


class PageSupplier:
    """Pages given as a table or by a function that is called once, when they are first asked for."""

    def __init__(self, pages: DataFrame | Callable[[], DataFrame]):
        self._pages = pages

    def __call__(self) -> DataFrame:
        if not isinstance(self._pages, DataFrame):
            self._pages = self._pages()
        return self._pages
