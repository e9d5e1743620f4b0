"""Vector, keyword, hybrid, page and overlap search. Every search takes a batch of queries; one query is a batch of one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groundwell.functions.text import normalize_path, strip
from groundwell.functions.vectors import cosine, rrf, unit, unit_cosine
from groundwell.operators.best import Best, strips
from groundwell.operators.lexical import bm25, holds_phrases, phrases, ranked, text_rank
from groundwell.operators.security import Scope, secured
from groundwell.sources.tables import stored


def unit_matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length as one matrix, padded with zeros, and how long each row was; null counts as empty."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(length), max(length.max(initial=0), 1)))
    flat = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1.0)[:, None], length


def vector_topk(df: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str = "embedding", query_vector: str = "query_vector", where: Column | None = None, min_similarity: float | None = None, max_queries: int | None = None, block: int = 10_000) -> DataFrame:
    """``qid``, ``id``, ``score`` (cosine; 0 for vectors that are null, zero or of another length) and ``rank`` of the k best rows of each query.

    Queries go to the rows in blocks of about ``block``, whole queries by the hash of ``qid``: products are matrix products over Arrow
    batches, and of each task only the k best rows of a query are shuffled. ``where`` is applied before ranking. More than
    ``max_queries``, if given, are refused.
    """
    n = queries.count()
    if max_queries is not None and n > max_queries:
        raise ValueError(f"more than {max_queries} queries in a batch")
    rows = (df if where is None else df.where(where)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    asked, blocks = queries.select("qid", F.col(query_vector).cast("array<double>").alias("v")), max(1, -(-n // block))
    out = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def best(own: DataFrame) -> DataFrame:
        held = own.toArrow()  # a block of queries
        names, (wanted, wanted_length) = held.column("qid").combine_chunks(), unit_matrix(held.column("v").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Best(k, len(names))
            for batch in batches:
                for at, n_rows in strips(batch.num_rows, len(names)):
                    part = batch.slice(at, n_rows)
                    vectors, length = unit_matrix(part.column("v"))
                    width = min(vectors.shape[1], wanted.shape[1])
                    scores = np.where(length[:, None] == wanted_length[None, :], vectors[:, :width] @ wanted[:, :width].T, 0.0)
                    found.add(part.column("id"), scores, None if min_similarity is None else scores >= min_similarity)
            yield from found.batches(names)

        return ranked(rows.mapInArrow(run, out), k)

    if k <= 0:
        return df.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(0))
    if blocks == 1:
        return best(asked)
    of = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    return reduce(DataFrame.unionAll, (best(asked.where(of == b)) for b in range(blocks)))


def fuse(vector: DataFrame, text: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of 1-based ranks over a full outer join; a missing rank adds nothing."""
    both = vector.select("qid", "id", F.col("rank").alias("v_rank")).join(text.select("qid", "id", F.col("rank").alias("t_rank")), ["qid", "id"], "full_outer")
    return ranked(both.withColumn("score", rrf("v_rank", rrf_k) + rrf("t_rank", rrf_k)), k)


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int, id_col: str, doc_words: Column, query_words: Column, vector: str = "embedding", query_vector: str = "query_vector") -> DataFrame:
    """Vector and keyword candidates, ``max(20, 2k)`` of each, fused to the k best of each query.

    Rows must already be what the caller may see (see ``security.secured``). Blank queries find nothing.
    """
    candidates = max(20, 2 * k)
    asked = queries.where(F.trim("hint") != "")
    v = vector_topk(chunks, asked.select("qid", query_vector), candidates, id_col, vector, query_vector)
    t = ranked(bm25(chunks, asked, id_col, doc_words, query_words), candidates)
    return fuse(v, t, k)


def retrieve(chunks: DataFrame, docs: DataFrame, queries: DataFrame, k: int, scope: Scope | None, vector: str = "embedding", query_vector: str = "query_vector", embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Secured hybrid retrieval: ``qid``, the chunk, ``file_path``, ``loc``, ``score`` and ``rank`` of the k best chunks of each query.

    ``chunks`` have ``chunk_id``, ``doc_id``, ``chunk_text``, ``context_prefix``, ``metadata`` and a vector; ``docs`` have ``doc_id``, ``source_uri`` and
    ``allowed_depts``. What the scope may not see is gone before anything is ranked. A query (``qid``, ``hint``, a vector, and perhaps a
    ``path``) with a path meets only the chunks of that file, by an equi-join; the others meet all chunks. Candidates by vector and by words
    (all stemmed words, in the chunk or its context), ``max(20, 2k)`` of each, are fused by rank. Blank hints find nothing.

    ``embed``, if given, makes the vectors of chunks that have none (it keeps ``chunk_id`` and ``__path``): only the search by vector asks it.
    Chunks pass where they are; what is shuffled are scores, and the chunks join the k best of each query, which are written first.
    """
    candidates = max(20, 2 * k)
    own = chunks if "source_uri" in chunks.columns else chunks.join(docs.select("doc_id", "source_uri"), "doc_id")
    own, vectors = secured(own, docs, scope), embed or (lambda rows: rows)
    asked = queries.where(strip("hint") != "")
    has_path = F.col("path").isNotNull() if "path" in queries.columns else F.lit(False)
    searched = F.concat_ws(" ", F.coalesce("context_prefix", F.lit("")), "chunk_text")
    legs = []
    if "path" in queries.columns:
        addressed = asked.where(has_path).withColumn("__path", normalize_path("path"))
        within = own.withColumn("__path", normalize_path("source_uri")).join(addressed.select("__path").distinct(), "__path", "left_semi")
        scored = vectors(within).select(F.col("chunk_id").alias("id"), "__path", unit(vector).alias("__v")).join(addressed.select("qid", "__path", unit(query_vector).alias("__q")), "__path")
        legs.append((scored.select("qid", "id", unit_cosine("__v", "__q").alias("score")), text_rank(within, addressed, "chunk_id", searched, path_col="__path")))
    free = asked.where(~has_path)
    if not legs or free.limit(1).count():  # queries without a path meet every chunk: no pass over them for none
        legs.append((vector_topk(vectors(own), free, candidates, "chunk_id", vector, query_vector).select("qid", "id", "score"), text_rank(own, free, "chunk_id", searched)))
    v, t = (ranked(reduce(DataFrame.unionByName, side), candidates) for side in zip(*legs, strict=True))
    top = stored(fuse(v, t, k).select("qid", F.col("id").alias("chunk_id"), "score", "rank"), "best-chunks")
    return own.join(top, "chunk_id").select("qid", "chunk_id", F.col("chunk_text").alias("text"), F.col("source_uri").alias("file_path"), F.col("metadata")["loc"].alias("loc"), "metadata", "score", "rank")


def vector_ranks(df: DataFrame, queries: DataFrame, targets: DataFrame, id_col: str, vector: str = "embedding", query_vector: str = "query_vector", block: int = 10_000, descending: bool = False) -> DataFrame:
    """``qid``, ``id`` and the 0-based ``v_rank`` of each row of ``targets`` (``qid``, ``id``; a few for each query) among all rows; ties by id, upwards or ``descending``.

    A rank is the number of rows before: each Arrow batch counts its own, and counts are added up, so no pair of a row and a query
    is ever written. Targets go to the rows in blocks of queries.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    asked = queries.select("qid", F.col(query_vector).cast("array<double>").alias("q"))
    known = targets.select("qid", "id").join(rows, "id").join(asked, "qid").select("qid", "id", F.round(cosine("v", "q"), 9).alias("at"))
    blocks = max(1, -(-queries.count() // block))
    out = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("before", T.LongType())])

    def counted(own: DataFrame, wanted_rows: DataFrame) -> DataFrame:
        # of a block: each query's vector once, and some targets for each query as two numbers and an id
        vectors = wanted_rows.toArrow()
        names, (wanted, wanted_length) = vectors.column("qid").combine_chunks(), unit_matrix(vectors.column("q").combine_chunks())
        held = own.toArrow()
        place = pc.index_in(held.column("qid"), value_set=names).to_numpy()
        held = held.take(pa.array(np.argsort(place, kind="stable")))
        qid, target, at = (held.column(x).combine_chunks() for x in ("qid", "id", "at"))
        target_at, begins = at.to_numpy(zero_copy_only=False), np.searchsorted(np.sort(place), np.arange(len(names) + 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(target), np.int64)
            for batch in batches:
                ids = batch.column("id")
                vectors, length = unit_matrix(batch.column("v"))
                width = min(vectors.shape[1], wanted.shape[1])
                for j in np.flatnonzero(np.diff(begins)).tolist():
                    order = np.round(np.where(length == wanted_length[j], vectors[:, :width] @ wanted[j, :width], 0.0), 9)
                    own_at, ranked_order = target_at[begins[j] : begins[j + 1]], np.sort(order)
                    total[begins[j] : begins[j + 1]] += len(order) - np.searchsorted(ranked_order, own_at, "right")
                    for h in (begins[j] + np.flatnonzero(np.searchsorted(ranked_order, own_at, "left") < np.searchsorted(ranked_order, own_at, "right"))).tolist():
                        tied = ids.take(pa.array(np.flatnonzero(order == target_at[h])))
                        total[h] += pc.sum((pc.greater if descending else pc.less)(tied, target[h])).as_py() or 0
            yield pa.RecordBatch.from_arrays([qid, target, pa.array(total)], ["qid", "id", "before"])

        return rows.mapInArrow(run, out)

    of = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    parts = [counted(known, asked) if blocks == 1 else counted(known.where(of == b), asked.where(of == b)) for b in range(blocks)]
    return reduce(DataFrame.unionAll, parts).groupBy("qid", "id").agg(F.sum("before").alias("v_rank"))


def wiki_search(pages: DataFrame, queries: DataFrame, k: int, id_col: str, doc_words: Column, query_words: Column, vector: str = "embedding", query_vector: str = "query_vector", rrf_k: int = 60, miss: int = 1000, keyword_limit: int = 50) -> DataFrame:
    """Pages by 0-based vector rank over all pages and 0-based keyword rank; a page without one counts as rank ``miss``.

    Of the pages without a keyword rank only the k best by vector can be among the k best at all, so ranks are needed of those and of
    the keyword hits alone (see :func:`vector_ranks`).
    """
    if k <= 0:
        return pages.select(F.lit(0).alias("qid"), F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    found = stored(bm25(pages, queries, id_col, doc_words, query_words), "page-matches")
    if "hint" in queries.columns:  # a term of several words must stand in the page as it is
        strict = queries.select("qid", phrases("hint").alias("phrases")).where("size(phrases) > 0")
        broken = found.join(strict, "qid").join(pages.select(F.col(id_col).alias("id"), doc_words.alias("words")), "id").where(~holds_phrases(F.col("words"), F.col("phrases")))
        found = found.join(broken.select("qid", "id"), ["qid", "id"], "left_anti")
    t = ranked(found, keyword_limit, first=0).select("qid", "id", F.col("rank").alias("t_rank"))
    best = vector_topk(pages, queries, k + keyword_limit, id_col, vector, query_vector).select("qid", "id", (F.col("rank") - 1).cast("bigint").alias("v_rank"))
    deep = vector_ranks(pages, queries, t.join(best, ["qid", "id"], "left_anti"), id_col, vector, query_vector)
    both = best.unionByName(deep).join(t, ["qid", "id"], "left").withColumn("score", rrf("v_rank", rrf_k) + rrf(F.coalesce("t_rank", F.lit(miss)), rrf_k))
    return ranked(both, k)


def first_pages(pages: DataFrame, k: int, id_col: str) -> DataFrame:
    """What an empty query finds: the first k pages at score 0.1."""
    return pages.select(F.col(id_col).alias("id"), F.lit(0.1).alias("score")).orderBy("id").limit(max(k, 0))


def overlap_search(df: DataFrame, queries: DataFrame, k: int, id_col: str, doc_words: Column, query_words: Column, base: Column | None = None) -> DataFrame:
    """Rows by the number of distinct query words they share, plus a base score; rows that share none are not ranked.

    Words meet by a join on the word, so no row is compared with a query that it shares nothing with.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(query_words)).alias("term"))
    rows = df.select(F.col(id_col).alias("id"), (F.lit(0.0) if base is None else base).alias("base"), F.explode_outer(F.array_distinct(doc_words)).alias("term"))
    scored = rows.join(asked, "term").groupBy("qid", "id").agg((F.first("base") + F.count("*")).alias("score"))
    return ranked(scored, k)


def read_page(pages: DataFrame, path: str) -> DataFrame:
    """The page with that slug or normalised path."""
    from groundwell.functions.text import normalize_path

    wanted = normalize_path(F.lit(path))
    return pages.where((F.col("slug") == path) | (normalize_path("rel") == wanted)).limit(1)


def fallback_hits(hits: DataFrame, text: Column | str = "text") -> DataFrame:
    """What page search gives where there are no pages: retrieved chunks, each summed up by its first 200 characters."""
    from groundwell.functions.text import snippet, stem

    return hits.select("qid", stem("file_path").alias("id"), F.col("file_path").alias("path"), "score", snippet(text).alias("summary"))
