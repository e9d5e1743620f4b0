"""What the corpus operators share: inputs by id and text, bounded batches, removal of copies, schemas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwell.sources.tables import shared_folder, stored

__all__ = ["bitmap", "bound_batches", "id_and_text", "may_hold", "quoted", "schema_with_id", "shared_folder", "stored", "text_of", "with_maybe", "without_copies"]


#: Bytes of an Arrow batch between the JVM and Python; both sides hold a few at a time in each task.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers the session's Arrow batches to ``most`` bytes, so that long rows cannot fill the memory beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, f"{most}b")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``id`` and ``text``, null text as empty: other columns of the input cannot clash with anything."""
    bound_batches(df.sparkSession)
    return df.select(F.col(quoted(id_col)).alias("id"), text_of(text_col).alias("text"))


def without_copies(df: DataFrame, marks: DataFrame, id_col: str, sha: Column) -> DataFrame:
    """The rows of ``df`` but for those that ``marks`` (``id``, ``sha``, ``kept``, ``n``) does not keep; of ``n`` equal rows that it keeps, one.

    Rows are named by id, null-safe, and by ``sha``, an expression over ``df``. They travel as one struct, so no name of theirs can clash.
    Only rows that a bounded bitmap of the copies does not rule out are sorted and merged with them, the others stay where they are.
    """
    copies = stored(marks.where("not kept or n > 1").withColumn("h", F.xxhash64("id", "sha")), "copies")
    own = with_maybe(df.select(F.struct("*").alias("row"), F.col(quoted(id_col)).alias("id"), sha.alias("sha")), F.xxhash64("id", "sha"), copies.select("h"))
    clear, own, copies = own.where("not maybe").select("row.*"), own.where("maybe").alias("own"), copies.alias("copies").hint("merge")
    same = F.col("own.id").eqNullSafe(F.col("copies.id")) & (F.col("own.sha") == F.col("copies.sha"))
    kept = clear.union(own.join(copies, same, "left_anti").select("row.*"))
    if not copies.where("kept").limit(1).count():
        return kept
    again = own.join(copies.where("kept"), same, "left_semi").dropDuplicates(["id", "sha"])
    return kept.union(again.select("row.*"))


#: A bitmap has eight bits for each value, 2 to the power of 27 (16 MB) at most.
LARGEST_BITMAP = 27


def _bitmap_words(values: DataFrame) -> tuple[DataFrame, int]:
    """``word`` and ``bits`` of a bitmap of the first column of ``values``, and the logarithm of its size, which follows their number up to a fixed bound."""
    room = min(LARGEST_BITMAP, max(16, (8 * values.count()).bit_length()))
    place = values.select(F.shiftrightunsigned(F.col(values.columns[0]), 64 - room).alias("place"))
    return place.groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")), room


def bitmap(values: DataFrame) -> np.ndarray:
    """A filter for the first column of ``values``, 64-bit hashes: one that is in it always passes :func:`may_hold`.

    Its size has a bound, so tasks can take it along however large the input is; beyond about 16 million values it lets more of the others pass. Bits
    are put together before they reach the driver.
    """
    words, room = _bitmap_words(values)
    found = words.toArrow()
    out = np.zeros(1 << (room - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def with_maybe(df: DataFrame, h: Column, values: DataFrame) -> DataFrame:
    """``df`` with ``maybe``: false only where the hash ``h`` is not among ``values``. The bitmap is a broadcast table of bounded size (32 MB at most)."""
    words, room = _bitmap_words(values)
    place = F.shiftrightunsigned(h, 64 - room)
    met = df.withColumn("__place", place).withColumn("__word", F.shiftrightunsigned("__place", 6))
    met = met.join(F.broadcast(words.withColumnRenamed("word", "__word")), "__word", "left")
    return met.withColumn("maybe", F.expr("coalesce(shiftrightunsigned(bits, cast(__place & 63 AS int)) & 1L, 0L) = 1L")).drop("__place", "__word", "bits")


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``hashes`` a :func:`bitmap` may hold."""
    place = hashes >> np.uint64(64 - (6 + (len(bits) - 1).bit_length()))
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def schema_with_id(df: DataFrame, rest: str) -> T.StructType:
    """A schema of ``id``, with the type it has in ``df``, and of the fields in the DDL ``rest``."""
    fields = T.StructType([T.StructField("id", df.schema["id"].dataType)])
    return T.StructType(fields.fields + T._parse_datatype_string(rest).fields)
