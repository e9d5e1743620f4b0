"""Documents to located, context-prefixed, overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import context_header, contextual_text, strip


def windows(df: DataFrame, text: str, max_chars: int = 1500, overlap: int = 200) -> DataFrame:
    """``start`` and ``chunk_text`` of each window over ``text``: whole if it fits, else every ``max_chars - overlap`` characters.

    Windows are stripped, empty ones dropped; a last one that lies in the one before it stays.
    """
    step = max(1, max_chars - overlap)
    n = F.length("__text")
    starts = F.when(n <= max_chars, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = df.withColumn("__text", strip(text)).where("__text <> ''").withColumn("start", F.explode(starts))
    return cut.withColumn("chunk_text", strip(F.substring("__text", F.col("start") + 1, F.lit(max_chars)))).drop("__text").where("chunk_text <> ''")


def chunk_documents(docs: DataFrame, max_chars: int = 1500, overlap: int = 200) -> DataFrame:
    """Chunks of documents with ``source_uri``, ``title`` and ``sections`` (array of loc, text, metadata).

    Chunks are numbered from 0 over all sections of a document; numbers are made within the document's own row, so nothing is
    shuffled. Metadata of a section wins over the document's title. ``allowed_depts``, if the documents have it, goes with every chunk.
    """
    from groundwell.functions.text import merge_maps

    step = max(1, max_chars - overlap)

    def cut(s):
        text = strip(s["text"])
        n = F.length(text)
        starts = F.when(n == 0, F.array().cast("array<int>")).when(n <= max_chars, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
        return F.transform(starts, lambda at: F.struct(strip(F.substring(text, at + 1, F.lit(max_chars))).alias("chunk_text"), s["loc"].alias("loc"), s["metadata"].alias("metadata")))

    pieces = F.filter(F.flatten(F.transform("sections", cut)), lambda c: c["chunk_text"] != "")
    depts = [c for c in ("allowed_depts",) if c in docs.columns]
    rows = docs.select(F.sha2("source_uri", 256).alias("doc_id"), "source_uri", "title", *depts, F.posexplode_outer(pieces).alias("chunk_index", "c")).where("chunk_index is not null")  # outer: an inner one is filtered first, which cuts texts again
    own = F.create_map(F.lit("title"), F.col("title"), F.lit("loc"), F.col("c.loc"))
    out = rows.select("doc_id", F.concat_ws("#", "doc_id", "chunk_index").alias("chunk_id"), "source_uri", "chunk_index", F.col("c.chunk_text").alias("chunk_text"), context_header("title", "source_uri", "c.loc").alias("context_prefix"), F.col("c.loc").alias("loc"), merge_maps(own, F.coalesce(F.col("c.metadata"), F.create_map().cast("map<string,string>"))).alias("metadata"), *depts)
    return out.withColumn("contextual_text", contextual_text("context_prefix", "chunk_text"))
