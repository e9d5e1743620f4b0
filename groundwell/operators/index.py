"""The search index of pages: vectors cached by content, and postings."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import content_hash
from groundwell.operators.lexical import postings
from groundwell.sources.store import VersionedTable, cache_misses

CACHE = "content_hash string, embedding array<double>"


def read_cache(cache: VersionedTable) -> DataFrame:
    """The cached vectors; a cache that is not there or cannot be read is empty."""
    try:
        found = cache.segments(CACHE)
        found.count()  # reads the footers of all files
        return found
    except (PySparkException, Py4JError):
        return cache.spark.createDataFrame([], CACHE)


def _append(cache: VersionedTable, new: DataFrame) -> None:
    """A segment of new vectors; beside segments that cannot be read it starts the cache anew."""
    try:
        cache.segments(CACHE).count()
        fresh = False
    except (PySparkException, Py4JError):
        fresh = True
    cache.append(new, fresh)


def build_index(pages: DataFrame, cache: VersionedTable, embed: Callable[[DataFrame], DataFrame], summary: str = "summary", entities: str = "entities") -> DataFrame:
    """Pages with ``content_hash`` and ``embedding``. Only pages whose hash is not in the cache are embedded, each hash once.

    ``embed`` takes ``content_hash`` and ``text`` (the summary) and gives ``content_hash`` and ``embedding``. New vectors are written to the cache
    before they are used, as a segment beside the others, so a build writes what is new and a failed one leaves the cache as it was; many segments are made one.
    """
    hashed = pages.withColumn("content_hash", content_hash(F.coalesce(F.col(summary), F.lit("")), F.coalesce(F.col(entities), F.array().cast("array<string>"))))
    known = read_cache(cache)
    missing = cache_misses(hashed.select("content_hash", F.coalesce(F.col(summary), F.lit("")).alias("text")), known).groupBy("content_hash").agg(F.min("text").alias("text"))
    if missing.limit(1).count():
        _append(cache, embed(missing).select("content_hash", F.col("embedding").cast("array<double>")))
        cache.compact(CACHE, "content_hash")
        known = cache.segments(CACHE).dropDuplicates(["content_hash"])  # two builds at a time may both add a hash
    return hashed.join(known, "content_hash", "left")


def index_postings(pages: DataFrame, id_col: str, fields: tuple[str, ...] = ("title", "summary", "entities")) -> DataFrame:
    """Postings over all searched fields, made from the pages as they are, so none is stale."""
    from groundwell.functions.text import tokens

    whole: list[Column] = [F.coalesce(F.array_join(F.col(f), " ") if f == "entities" else F.col(f), F.lit("")) for f in fields]
    return postings(pages, id_col, tokens(F.concat_ws(" ", *whole)))
