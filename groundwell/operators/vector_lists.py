"""Inverted vector lists: rows by their nearest centroid, searched in the nearest lists or, by the triangle inequality, exactly.

Centroids are fitted on a bounded sample (``sample_rows`` rows, drawn by hash of the id) by spherical k-means; every row is then put into the list of its nearest one.
Lists are stored as blocks of up to ``block_rows`` unit vectors with their distances to the centroid, ordered by list, beside a table of the lists' sizes and radii.
A search sends each query to its ``probes`` nearest lists. An exact search then takes the k-th best distance found, and visits only lists that
may hold something nearer: no vector is nearer to a query than the query's distance to the centroid less the list's radius.

The blocks of a list meet the queries of that list in blocks as well, as matrix products; of each product only the k best of a query are shuffled. Cosines of unit
vectors and their distances order alike. Vectors that are null, zero or of another length than most are in a list of their own and score 0, as
:func:`~groundwell.operators.search.vector_topk` has it; queries of that kind find the first ids at 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.operators.lexical import ranked
from groundwell.operators.search import unit_matrix
from groundwell.sources.store import VersionedTables
from groundwell.sources.tables import stored

#: Distances are taken from rounded products.
_SLACK = 1e-6


def spherical_kmeans(rows: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """``n`` unit centroids of unit ``rows``; empty ones start again at the rows that fit worst."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(n, len(rows)), replace=False)]
    for _ in range(rounds):
        scores = rows @ centroids.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = rows[np.argsort(scores.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def distance(cosine: np.ndarray) -> np.ndarray:
    """Of unit vectors with that cosine."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


class VectorLists:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._tables = spark, VersionedTables(spark, path)

    def build(self, df: DataFrame, id_col: str, vector: str = "embedding", lists: int = 64, sample_rows: int = 20_000, block_rows: int = 1024) -> int:
        """Fits centroids and stores every row; a new version takes the place of the last one. Ids must not repeat."""
        rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        most = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
        d = most.d if most else 1
        proper = F.coalesce((F.size("v") == d) & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
        rows = stored(rows.withColumn("proper", proper), "vectors")
        sample = rows.where("proper").orderBy(F.xxhash64("id")).limit(sample_rows).select("v").toArrow()
        fitted = unit_matrix(sample.column("v").combine_chunks())[0] if len(sample) else np.eye(1, d)
        centroids = spherical_kmeans(fitted, lists)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, _ = unit_matrix(batch.column("v"))
                cosines = unit @ centroids.T
                own = cosines.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.int32()), pa.array(distance(cosines[np.arange(len(own)), own])), pa.array(list(unit), pa.list_(pa.float64()))], ["id", "list", "at", "v"])

        schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("list int, at double, v array<double>").fields])
        placed = stored(rows.where("proper").select("id", "v").mapInArrow(assign, schema), "placed")
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("at").alias("radius"))
        table = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>").join(sizes, "list")
        parts = F.broadcast(sizes.select("list", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")))  # one row a list
        blocks = placed.join(parts, "list").groupBy("list", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "id", "v"))).alias("held"))
        blocks = blocks.select("list", F.col("held.id").alias("ids"), F.col("held.at").alias("at"), F.flatten("held.v").alias("vectors"))
        return self._tables.write(lists=table, blocks=blocks.repartitionByRange("list").sortWithinPartitions("list"), flat=rows.where("not proper").select("id"))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._tables.paths(name)[-1])

    def tuned_probes(self, queries: DataFrame, k: int, target: float = 0.95, sample_queries: int = 256) -> int:
        """How many lists a query has to visit so that ``target`` of the k best are found: measured on a bounded sample of queries, drawn by hash, against the exact search."""
        sample = stored(queries.where("query_vector is not null").orderBy(F.xxhash64("qid", F.lit(3))).limit(sample_queries), "sample-queries")
        wanted, lists, probes = stored(self.search(sample, k), "sample-found"), self._read("lists").count(), 4
        while probes < lists and recall(self.search(sample, k, probes, exact=False), wanted) < target:
            probes += max(1, probes // 2)
        return min(probes, max(lists, 1))

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
        """``qid``, ``id``, ``score`` and ``rank`` of the k best rows of each query (``qid``, ``query_vector``): among its nearest lists, or ``exact``."""
        return self.passes(queries, k, probes, exact)[0]

    def passes(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, query_block: int = 256) -> tuple[DataFrame, DataFrame]:
        """:meth:`search` and the (``qid``, ``list``) that it visited."""
        lists = self._read("lists").orderBy("list").toArrow()  # the bounded table of lists
        numbers, radius = lists.column("list").to_numpy(), lists.column("radius").to_numpy()
        centroids = unit_matrix(lists.column("centroid").combine_chunks())[0] if len(lists) else np.zeros((0, 1))
        d = centroids.shape[1]
        asked = queries.select("qid", F.col("query_vector").cast("array<double>").alias("v"))
        proper = F.coalesce((F.size("v") == d) & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull()), F.lit(False)) & F.lit(len(lists) > 0)
        asked = stored(asked.withColumn("proper", proper), "asked")
        aimed = asked.where("proper").select("qid", "v")
        schema = T.StructType([asked.schema["qid"], *T._parse_datatype_string("v array<double>, list int").fields])

        def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The nearest lists, or those with a bound within ``least``."""
            for batch in batches:
                unit, _ = unit_matrix(batch.column("v"))
                away = distance(unit @ centroids.T)
                nearest = np.zeros(away.shape, bool)
                np.put_along_axis(nearest, np.argsort(away, axis=1, kind="stable")[:, :probes], True, axis=1)
                if "least" in batch.schema.names:
                    nearest = ~nearest & (away - radius <= distance(np.asarray(batch.column("least")))[:, None] + _SLACK)
                i, j = np.nonzero(nearest)
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(i)), pa.array(list(unit), pa.list_(pa.float64())).take(pa.array(i)), pa.array(numbers[j], pa.int32())], ["qid", "v", "list"])

        first = stored(aimed.mapInArrow(to_lists, schema), "probes")
        found, visited = self._scored(first, k, d, query_block), first.select("qid", "list")
        if exact:
            found = stored(ranked(found, k), "first-found")
            least = aimed.join(found.where(F.col("rank") == k).select("qid", F.col("score").alias("least")), "qid", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
            second = stored(least.mapInArrow(to_lists, schema), "second-lists")
            found, visited = found.drop("rank").union(self._scored(second, k, d, query_block)), visited.union(second.select("qid", "list"))
        # rows and queries without a direction score 0: of many equal scores the first k ids count
        firsts = self._read("flat").orderBy("id").limit(k).select("id", F.lit(0.0).alias("score"))
        every = self._read("blocks").select(F.explode("ids").alias("id")).union(self._read("flat")).orderBy("id").limit(k).select("id", F.lit(0.0).alias("score"))
        zero = asked.where("proper").select("qid").join(F.broadcast(firsts), how="cross").union(asked.where("not proper").select("qid").join(F.broadcast(every), how="cross"))  # k rows
        return ranked(found.union(zero), k), visited

    def _scored(self, asked: DataFrame, k: int, d: int, query_block: int) -> DataFrame:
        """``qid``, ``id`` and ``score`` of the k best of each block of a list, and their ties, for the queries sent to it."""
        wanted = [r.list for r in asked.select("list").distinct().collect()]  # no more than there are lists
        parts = F.ceil(F.count("*") / query_block).cast("int")
        dealt = asked.join(F.broadcast(asked.groupBy("list").agg(parts.alias("parts"))), "list")  # one row a list
        held = dealt.groupBy("list", F.pmod(F.xxhash64("qid"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("qid", "v")).alias("held")).select("list", F.col("held.qid").alias("qids"), F.flatten("held.v").alias("asked"))
        blocks = self._read("blocks").where(F.col("list").isin(wanted))
        out = T.StructType([asked.schema["qid"], T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    ids, rows, qids, own = (batch.column(c).slice(n, 1).flatten() for c in ("ids", "vectors", "qids", "asked"))
                    scores = np.asarray(own).reshape(-1, d) @ np.asarray(rows).reshape(-1, d).T
                    order = np.round(scores, 9)
                    keep = order >= np.partition(order, order.shape[1] - k, axis=1)[:, order.shape[1] - k, None] if order.shape[1] > k else np.ones(order.shape, bool)
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(scores[i, j])], ["qid", "id", "score"])

        return blocks.join(held, "list").select("ids", "vectors", "qids", "asked").mapInArrow(run, out)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of ``wanted`` (``qid``, ``id``) that is ``found``; 1 if nothing is wanted."""
    n = wanted.count()
    return wanted.join(found.select("qid", "id"), ["qid", "id"], "left_semi").count() / n if n else 1.0
