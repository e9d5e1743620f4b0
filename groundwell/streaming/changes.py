"""Changes of files from observations of them: quick edits become one change, repeats and redelivered notices none, and removals are seen.

An observation is a row of ``path``, ``seen`` (a timestamp), ``digest`` (of the content; null if the file is gone) and perhaps ``delivery`` (the id of a notice). A path is
settled by an observation that none follows within ``quiet``; if its digest is not the one it was settled at before, that is a change: ``added``, ``changed``
or ``deleted``. :func:`settled` takes a table, where windows find the changes, or a stream, where they come from state keyed by path and event-time timers; both give the
same rows, but that a stream holds back what its watermark has not passed.

Defined results: null paths are left out; observations of one time count in the order of their digests, null first; on a stream those older than what their path was last
seen at are dropped, and so are deliveries that were seen within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "path string, kind string, digest string, at timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _kind(before: str | None, after: str | None) -> str | None:
    if before == after:
        return None
    return "added" if before is None else "deleted" if after is None else "changed"


class _Settling(StatefulProcessor):
    """State of a path: the digest it was settled at, the pending one, and when that was seen (microseconds, which timers round up)."""

    def __init__(self, quiet_us: int):
        self.quiet_us = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("path", "settled string, digest string, seen bigint, pending boolean")

    def _timer(self, seen: int) -> int:
        return -(-(seen + self.quiet_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        settled, digest, seen, pending = self.state.get() if self.state.exists() else (None, None, None, False)
        timer = self._timer(seen) if pending else None
        for r in sorted(rows, key=lambda r: (r.us, r.digest is not None, r.digest or "")):
            if seen is not None and r.us < seen:
                continue
            if pending and r.us - seen >= self.quiet_us:
                if kind := _kind(settled, digest):
                    yield Row(path=key[0], kind=kind, digest=digest, us=seen)
                settled = digest
            digest, seen, pending = r.digest, r.us, True
        if pending:
            if timer is not None and timer != self._timer(seen):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._timer(seen))
        self.state.update((settled, digest, seen, pending))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        settled, digest, seen, pending = self.state.get()
        if pending and self._timer(seen) == expiredTimerInfo.getExpiryTimeInMs():
            if kind := _kind(settled, digest):
                yield Row(path=key[0], kind=kind, digest=digest, us=seen)
            self.state.update((digest, digest, seen, False))

    def close(self) -> None:
        pass


def settled(observations: DataFrame, quiet_seconds: float = 2.0, late: str = "10 seconds") -> DataFrame:
    """``path``, ``kind``, ``digest`` and ``at`` of every change."""
    quiet_us = int(quiet_seconds * 1e6)
    delivered = "delivery" in observations.columns
    rows = observations.where("path is not null").withColumn("seen", F.col("seen").cast("timestamp"))
    if rows.isStreaming:
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # timers need it
        rows = rows.withWatermark("seen", late)
        rows = rows.dropDuplicatesWithinWatermark(["delivery"]) if delivered else rows
        keyed = rows.select("path", "seen", "digest", F.unix_micros("seen").alias("us")).groupBy("path")
        found = keyed.transformWithState(_Settling(quiet_us), "path string, kind string, digest string, us bigint", "Append", "EventTime")
        return found.select("path", "kind", "digest", F.timestamp_micros("us").alias("at"))
    if delivered:  # of notices delivered again the first counts
        first = F.row_number().over(Window.partitionBy("delivery").orderBy("seen", "path", "digest"))
        rows = rows.withColumn("__nth", first).where("__nth = 1")
    order = Window.partitionBy("path").orderBy("us", F.asc_nulls_first("digest"))
    rows = rows.select("path", "digest", F.unix_micros("seen").alias("us"))
    rows = rows.withColumn("next", F.lead("us").over(order)).where(F.col("next").isNull() | (F.col("next") - F.col("us") >= quiet_us))
    rows = rows.withColumn("before", F.lag("digest").over(order)).where(~F.col("before").eqNullSafe(F.col("digest")))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("digest").isNull(), "deleted").otherwise("changed")
    return rows.select("path", kind.alias("kind"), "digest", F.timestamp_micros("us").alias("at"))


def follow(observations: DataFrame, on_changes: Callable[[DataFrame], bool], checkpoint: str, after: Callable[[], None] | None = None, quiet_seconds: float = 2.0, late: str = "10 seconds") -> int:
    """One call of ``on_changes`` for each batch of a stream in which paths settled; ``after`` follows those that succeed. Returns the number of calls.

    A checkpoint belongs to one query at a time, so two syncs of one checkpoint never run side by side.
    """
    calls = []

    def one(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            if kept.limit(1).count():
                calls.append(number)
                if on_changes(kept) and after:
                    after()
        finally:
            kept.unpersist()

    query = settled(observations, quiet_seconds, late).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(calls)
