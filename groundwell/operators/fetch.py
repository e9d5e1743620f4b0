"""Fetching verbatim passages of addressed files, and two-layer answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import normalize_path

RESULT = "array<struct<text: string, file_path: string, loc: string>>"


def post_filter(hits: DataFrame, path: Column | str = "path") -> DataFrame:
    """Hits from the addressed file only, whatever the search returned."""
    return hits.where(normalize_path("file_path") == normalize_path(path))


def fetch_many(addresses: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """One row for each address (``ord``, ``path``, ``hint``, ``loc``) in one job: status, context and citations.

    ``hits`` has ``ord``, ``chunk_id``, ``text``, ``file_path``, ``score`` and ``loc``, at most some k a query. A hit without a place takes that of the address.
    No hit from the addressed file gives ``no_source`` and empty lists.
    """
    own = hits.join(addresses.select("ord", "path", F.col("loc").alias("address_loc")), "ord")
    own = post_filter(own).withColumn("loc", F.coalesce(F.nullif("loc", F.lit("")), "address_loc"))
    order = F.struct(-F.round("score", 9), F.col("chunk_id"), F.struct("text", "file_path", "loc").alias("piece"), F.struct("file_path", "loc", F.round("score", 6).alias("score")).alias("citation"))
    lists = own.groupBy("ord").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("hits"))
    found = addresses.join(lists, "ord", "left").withColumn("hits", F.coalesce("hits", F.array()))
    return found.select("ord", "path", "hint", F.when(F.size("hits") > 0, "ok").otherwise("no_source").alias("status"), F.col("hits.piece").alias("context"), F.col("hits.citation").alias("citations"))


def addresses_of(pages: DataFrame) -> DataFrame:
    """Well-formed addresses of pages in order: ``slug``, ``ord``, ``path``, ``hint``, ``loc``."""
    rows = pages.select("slug", F.posexplode("sources").alias("ord", "s")).select("slug", "ord", "s.path", "s.hint", "s.loc")
    return rows.where((F.coalesce("path", F.lit("")) != "") & (F.coalesce("hint", F.lit("")) != ""))


@dataclass(frozen=True)
class Answer:
    status: str
    page: str | None = None
    summary: str | None = None
    results: DataFrame | None = None


def answer(search: Callable[[str, int], DataFrame], pages: DataFrame, retrieve: Callable[[DataFrame], DataFrame], query: str, need_rag: bool | Callable[[dict], bool] = False, k: int = 5) -> Answer:
    """Page search first; the second layer is planned and run only if the page does not suffice.

    ``search(query, k)`` gives ``id`` and ``rank``, ``retrieve(addresses)`` gives hits for :func:`fetch_many`.
    """
    top = search(query, k).orderBy("rank").limit(1).collect()
    if not top:
        return Answer("no_page")
    page = pages.where(F.col("slug") == top[0]["id"]).limit(1)
    row = page.collect()[0].asDict(recursive=True)
    if not (need_rag(row) if callable(need_rag) else need_rag):
        return Answer("page_only", row["slug"], row.get("summary"))
    addresses = addresses_of(page)
    results = fetch_many(addresses, retrieve(addresses)).orderBy("ord")
    ok = results.where("status = 'ok'").limit(1).count()
    return Answer("with_sources" if ok else "no_source", row["slug"], row.get("summary"), results)


def answer_many(questions: DataFrame, pages_found: DataFrame, pages: DataFrame, retrieve: Callable[[DataFrame], DataFrame], need_sources: Column, k: int = 10) -> DataFrame:
    """Two-layer answers of many questions in one plan: ``qid``, ``status``, ``slug``, ``summary`` and ``results``, an array for each address of the page in order.

    ``pages_found`` (``qid``, ``id``, ``rank``) is what page search gave; the best page of each question counts. ``need_sources``, over the columns of the question and its
    page, says whether the page does not suffice. Only addresses of those that need sources reach ``retrieve``, which takes ``ord`` (of question and place),
    ``path``, ``hint`` and ``loc`` and gives hits for :func:`fetch_many`. Statuses are ``no_page``, ``page_only``, ``with_sources`` and ``no_source``.
    """
    best = pages_found.groupBy("qid").agg(F.min(F.struct("rank", "id"))["id"].alias("slug"))
    asked = questions.join(best, "qid", "left").join(pages.withColumn("__there", F.lit(True)), "slug", "left")
    there = F.coalesce("__there", F.lit(False))
    asked = asked.withColumn("__deep", there & F.coalesce(need_sources, F.lit(False)))
    deep = asked.where("__deep")
    listed = addresses_of(deep.select(F.struct("qid", "slug").alias("slug"), "sources"))
    addresses = listed.select(F.struct(F.col("slug.qid").alias("qid"), F.col("ord").alias("place")).alias("ord"), "path", "hint", "loc")
    results = fetch_many(addresses, retrieve(addresses), k)
    own = results.groupBy(F.col("ord.qid").alias("qid")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord.place").alias("ord"), "path", "hint", "status", "context", "citations"))).alias("results"))
    out = asked.select("qid", "slug", "summary", there.alias("there"), "__deep").join(own, "qid", "left")
    ok = F.exists(F.coalesce("results", F.array()), lambda r: r["status"] == "ok")
    status = F.when(~F.col("there"), "no_page").when(~F.col("__deep"), "page_only").when(ok, "with_sources").otherwise("no_source")
    return out.select("qid", status.alias("status"), F.when(F.col("there"), F.col("slug")).alias("slug"), "summary", F.coalesce("results", F.array()).alias("results"))


def fetch_one(path: str, hint: str, retrieve: Callable[[DataFrame], DataFrame], spark, loc: str | None = None) -> dict:
    """A single address as a dictionary of status, context and citations, and nothing else that a caller could act on."""
    address = spark.createDataFrame([(0, path, hint, loc)], "ord int, path string, hint string, loc string")
    row = fetch_many(address, retrieve(address)).first().asDict(recursive=True)
    return {name: row[name] for name in ("status", "context", "citations")}
