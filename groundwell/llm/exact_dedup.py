"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

White space is normalised and each text is cut where its own characters say so, so equal texts are cut alike. A chunk's
identifier is the XXH64 of its bytes, verified by its SHA-256: an identifier under which chunks of different SHA-256 are
found is replaced by it in the recipes that hold it. Two texts are equal when their ordered lists of verified identifiers
are. Texts are read once and never moved: distinct (identifier, SHA-256) pairs meet for the verification, and recipes, 8 bytes
a chunk, for the comparison.

Cuts come after a character outside a class followed by eight inside it (code points of 1 or 2 modulo 4), about every few
hundred characters of prose, and after ``max_chunk`` characters at the latest.

Defined results: null text counts as empty, and all empty texts are equal; of equal texts the row with the smallest id stays, a null
id only if no other has one; rows are told apart by id and text, and of rows that repeat both, which :func:`duplicates` marks alike,
:func:`keep_first` keeps one; an empty table gives an empty result; other columns are ignored by :func:`duplicates` and pass through
:func:`keep_first` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.shared import id_and_text, stored, text_of, without_copies

#: Every ASCII and Latin-1 character whose code point is 1 or 2 modulo 4; spaces are outside it.
_INSIDE = "".join(f"\\x{c:02x}" for c in range(0x21, 0x100) if c % 4 in (1, 2))


def squeezed(text: Column) -> Column:
    """Each run of spaces and controls 9 to 13 in the text as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0d]{2,}|[\x09-\x0d]", " ")


def normalised(docs: DataFrame, name: str = "text") -> DataFrame:
    """:func:`squeezed` by plain replacements where that will do, since runs are rare."""
    text = F.col(name)
    for control in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(control), F.lit(" "))
    docs = docs.withColumn(name, text)
    return docs.withColumn(name, F.when(F.contains(F.col(name), F.lit("  ")), F.regexp_replace(name, " {2,}", " ")).otherwise(F.col(name)))


def chunks(text: Column, max_chunk: int) -> Column:
    """The pieces of a text in order; joined they are the text, and the empty text has none."""
    cut = f"(?s).{{0,{max_chunk - 9}}}?[^{_INSIDE}][{_INSIDE}]{{8}}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(df: DataFrame, max_chunk: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_sha256`` of the normalised text, and ``recipe``, its ordered verified chunk identifiers."""
    docs = normalised(id_and_text(df, id_col, text_col))
    parts = F.transform(chunks(F.col("text"), max_chunk), lambda x: F.struct(F.xxhash64(x).alias("h"), F.unhex(F.sha2(x, 256)).alias("digest")))
    own = stored(docs.select("id", F.sha2("text", 256).alias("text_sha256"), parts.alias("parts")), "recipes")
    table = own.select(F.explode("parts").alias("part")).select("part.h", "part.digest").distinct()
    shared = stored(table.groupBy("h").count().where("count > 1").select("h"), "shared-identifiers")
    plain = own.select("id", "text_sha256", F.col("parts.h").alias("recipe"))
    if not shared.limit(1).count():
        return plain
    return verified(own, shared)


def verified(own: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes in which an identifier in ``shared`` gives way to the SHA-256 of its chunk, as four numbers behind it."""
    held = own.select(F.explode("parts.h").alias("h"), "text_sha256").join(shared, "h", "left_semi")
    unclear = held.groupBy("text_sha256").agg(F.collect_set("h").alias("bad"))  # at most the chunks of one text
    exact = own.join(unclear, "text_sha256", "left")
    full = F.flatten(F.transform("parts", lambda x: F.when(F.array_contains("bad", x["h"]), F.concat(F.array(x["h"]), _quarters(x["digest"]))).otherwise(F.array(x["h"]))))
    return exact.select("id", "text_sha256", F.when(F.col("bad").isNull(), F.col("parts.h")).otherwise(full).alias("recipe"))


def _quarters(digest: Column) -> Column:
    return F.array(*(F.conv(F.hex(F.substring(digest, 8 * k + 1, 8)), 16, -10).cast("bigint") for k in range(4)))


def duplicates(df: DataFrame, max_chunk: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Groups are counted after a partial aggregation. Only groups of several rows, a table of their own, are joined back, so the
    rows of a large group are a skewed partition of the join alone, which adaptive execution splits.
    """
    own = recipes(df, max_chunk, id_col, text_col)
    groups = own.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    joined = own.join(stored(groups, "groups"), "recipe", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_first(df: DataFrame, max_chunk: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    found = duplicates(id_and_text(df, id_col, text_col), max_chunk, "id", "text")
    # repeated rows are in one group with equal ids, so other rows need not be counted
    marks = found.where("group_size > 1").groupBy("id", F.col("text_sha256").alias("sha")).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    return without_copies(df, marks, id_col, F.sha2(squeezed(text_of(text_col)), 256))
