"""Retrieval quality: recall, reciprocal rank, needles, hard negatives, and token economy."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.vectors import cosine
from groundwell.operators.search import vector_ranks


def first_ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``qid`` and the best 1-based rank among acceptable targets, null if none is ranked."""
    wanted = questions.select("qid", F.explode("targets").alias("id"))
    return questions.select("qid").join(wanted.join(hits, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return ranks.agg(*(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 3).alias(f"recall_at_{k}") for k in ks), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def questions_of(spark: SparkSession, text: str) -> DataFrame:
    """A test set in YAML (``questions`` of ``q``, ``target``, perhaps ``also_acceptable`` and ``paraphrase``) as ``qid``, ``hint``, ``targets``, ``paraphrase``."""
    import yaml

    rows = [(k, x["q"], list(dict.fromkeys([x["target"], *(x.get("also_acceptable") or [])])), bool(x.get("paraphrase")), x["target"]) for k, x in enumerate(yaml.safe_load(text)["questions"])]
    return spark.createDataFrame(rows, "qid int, hint string, targets array<string>, paraphrase boolean, target string")


def unknown_targets(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets that are no page: a test set that has any must not be used."""
    return questions.select("target").distinct().join(pages.select(F.col("slug").alias("target")), "target", "left_anti")


def ranked_pages(pages: DataFrame, questions: DataFrame, vector: str = "embedding", query_vector: str = "query_vector") -> DataFrame:
    """``qid``, ``id``, ``rank`` of the acceptable pages of each question among all pages by similarity, ties by slug descending."""
    wanted = questions.select("qid", F.explode("targets").alias("id"))
    at = questions.select("qid", F.col(query_vector).alias("__q"))
    targets = wanted.join(pages.select(F.col("slug").alias("id"), F.col(vector).alias("__t")), "id").join(at, "qid").select("qid", "id", F.round(cosine("__t", "__q"), 9).alias("__at"))
    best = targets.groupBy("qid").agg(F.max(F.struct("__at", "id")).alias("best"))
    ranks = vector_ranks(pages, questions.select("qid", query_vector), best.select("qid", F.col("best.id").alias("id")), "slug", vector, query_vector, descending=True)
    return ranks.select("qid", "id", (F.col("v_rank") + 1).alias("rank"))


def recall_by_paraphrase(questions: DataFrame, ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall of all questions and of the paraphrases alone (null if there are none), to three places."""
    both = questions.select("qid", "paraphrase").join(ranks.select("qid", "rank"), "qid", "left")
    hit = lambda k: F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    return both.agg(
        F.count("*").alias("n_questions"),
        F.count(F.when(F.col("paraphrase"), 1)).alias("n_paraphrase"),
        *(F.round(F.avg(hit(k)), 3).alias(f"recall_at_{k}") for k in ks),
        *(F.round(F.avg(F.when(F.col("paraphrase"), hit(k))), 3).alias(f"paraphrase_recall_at_{k}") for k in ks),
    )


def write_transcript(rows: DataFrame, path: str) -> bool:
    """Writes rows as JSON; a place that cannot be written to is told by ``False``, not by an error."""
    try:
        rows.write.mode("overwrite").json(path)
        return True
    except (PySparkException, Py4JError):
        return False


def needle_found(hits: DataFrame, text: str, needle: str, by: str) -> DataFrame:
    return hits.groupBy(by).agg(F.bool_or(F.contains(F.col(text), F.col(needle))).alias("passed"))


def hard_negative(hits: DataFrame, true_id: Column, negative_id: Column) -> DataFrame:
    """Per query: the true document ranks before the negative one, or the negative one is absent."""
    ranks = hits.groupBy("qid").agg(F.min(F.when(F.col("id") == true_id, F.col("rank"))).alias("t"), F.min(F.when(F.col("id") == negative_id, F.col("rank"))).alias("n"))
    return ranks.select("qid", F.coalesce((F.col("t") < F.col("n")) | (F.col("t").isNotNull() & F.col("n").isNull()), F.lit(False)).alias("passed"))


def token_measurement(pages: DataFrame, index: DataFrame, count: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """One row of what a reader of pages (``rel``, ``summary``, ``text``) is given: ``n_pages``, the tokens of the ``index`` (``line``), of the payload of the first ``k`` pages
    by path, of the longest page, of payload and page together, and of a dump of index and all pages."""
    first = pages.orderBy("rel").limit(k).agg(F.sum(count(F.concat_ws("\n", "rel", F.coalesce("summary", F.lit(""))))).alias("topk_payload_tokens"))
    whole = pages.agg(F.count("*").alias("n_pages"), F.max(count(F.col("text"))).alias("one_page_tokens"), F.sum(count(F.col("text"))).alias("page_tokens"))
    rows = whole.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(index.agg(F.sum(count(F.col("line"))).alias("index_tokens"))))  # one row each
    rows = rows.fillna(0)
    return rows.select("n_pages", "index_tokens", "topk_payload_tokens", "one_page_tokens", (F.col("topk_payload_tokens") + F.col("one_page_tokens")).alias("agent_context_tokens"), (F.col("index_tokens") + F.col("page_tokens")).alias("naive_dump_tokens"))


def token_economy(docs: DataFrame, tokens: Column, context: Column, pages: int = 300) -> DataFrame:
    """All tokens, those of the context alone, what is saved, and the total projected to ``pages`` documents (rounded half to even)."""
    sums = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(tokens), F.lit(0)).alias("naive_tokens"), F.coalesce(F.sum(context), F.lit(0)).alias("context_tokens"), F.coalesce(F.max(context), F.lit(0)).alias("max_context"))
    return sums.withColumns({"saved": F.round(1 - F.col("context_tokens") / F.col("naive_tokens"), 6), "projected": F.bround(F.col("naive_tokens") / F.col("n_docs") * pages).cast("bigint")})
