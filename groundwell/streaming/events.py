"""Streams: change batches into re-ingestion, signed web hooks, and event-time windows (the last beyond the original scope)."""

from __future__ import annotations

import hashlib
import hmac
import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.sources.store import VersionedTables, ingest


@dataclass(frozen=True)
class IndexOutcome:
    ok: bool
    status: str


class Indexer(Protocol):
    """Indexes a batch of changed files (``source_uri`` or ``path``, ``content``) and tells how it went."""

    def __call__(self, batch: DataFrame) -> IndexOutcome: ...


def store_indexer(store: VersionedTables, allowed_depts: list[str]) -> Indexer:
    """Parses a batch into the store; a failure is an outcome, not an error."""

    def index(batch: DataFrame) -> IndexOutcome:
        files = batch if "source_uri" in batch.columns else batch.withColumnRenamed("path", "source_uri")
        try:
            n = ingest(files, store, allowed_depts).count()
        except (PySparkException, Py4JError, OSError) as error:
            return IndexOutcome(False, f"error: {error}")
        return IndexOutcome(True, f"ingested_{n}_files")

    return index


def http_indexer(base_url: str, timeout: float = 3600.0) -> Indexer:
    """Asks a service to index all its files: a POST of ``{}`` to ``/index``, whose ``status`` is ``indexed`` if it did."""

    def index(batch: DataFrame) -> IndexOutcome:
        request = urllib.request.Request(f"{base_url}/index", data=b"{}", headers={"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            status = str(json.load(answer).get("status", ""))
        return IndexOutcome(status == "indexed", status)

    return index


def sync_once(indexer: Indexer, batch: DataFrame, after: Callable[[], None] | None = None) -> IndexOutcome:
    """Indexes a batch; ``after`` follows only if that went well."""
    outcome = indexer(batch)
    if outcome.ok and after:
        after()
    return outcome


def watch(spark: SparkSession, on_batch: Callable[[DataFrame], bool], checkpoint: str, changes: DataFrame | None = None, path: str | None = None, after: Callable[[], None] | None = None) -> int:
    """One call of ``on_batch`` for each batch of changes that is there; ``after`` follows only those that succeed. Returns the number of batches."""
    if changes is None and path is None:
        raise ValueError("either changes or a path is needed")
    source = changes if changes is not None else spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    handled = []

    def one(batch: DataFrame, number: int) -> None:
        ok = on_batch(batch)
        handled.append(number)
        if ok and after:
            after()

    query = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(handled)


def signature_valid(body: Column | str, signature: Column | str, secret: bytes) -> Column:
    """Whether a signature (with or without ``sha256=``) is the HMAC-SHA256 of the body, compared in constant time."""

    @F.pandas_udf("boolean")
    def check(bodies: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([hmac.compare_digest((s or "").removeprefix("sha256=").encode(), hmac.new(secret, (b or "").encode(), hashlib.sha256).hexdigest().encode()) for b, s in zip(bodies, given, strict=True)])

    return check(body, signature)


def hook_status(body: Column, signature: Column, event: Column, valid: Column, branch: str = "main") -> Column:
    """``missing_signature``, ``invalid_signature``, ``pong``, ``skipped`` (another branch) or ``queued``; a body that is no JSON is queued."""
    ref = F.coalesce(F.get_json_object(body, "$.ref"), F.lit(""))
    wanted = (ref == "") | (ref == f"refs/heads/{branch}") | ref.endswith(f"/{branch}")
    bare = F.regexp_replace(F.coalesce(signature, F.lit("")), "^sha256=", "")
    return F.when(bare == "", "missing_signature").when(~valid, "invalid_signature").when(F.coalesce(event, F.lit("push")) == "ping", "pong").when(~wanted, "skipped").otherwise("queued")


def classify_hooks(hooks: DataFrame, secret: bytes, branch: str = "main") -> DataFrame:
    """Adds ``status`` to rows of ``body``, ``signature`` and ``event``; works on streams and tables."""
    return hooks.withColumn("status", hook_status(F.col("body"), F.col("signature"), F.col("event"), signature_valid("body", "signature", secret), branch))


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; on a stream with a watermark of ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user that end after a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), "user_id", "n")


def deduplicated(events: DataFrame, late: str | None = None) -> DataFrame:
    """One row for each event id; on a stream within the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if late else rows.dropDuplicates(["event_id"])
