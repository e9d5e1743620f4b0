"""Table files larger than a row: sections of their rows, read by many tasks.

:func:`~groundwell.sources.parse.table_sections` has each file in one cell; here a file is read as lines of byte ranges, as Spark splits it. A line end inside quotes is no record's
end, so records are repaired: a range knows whether it begins inside quotes from the number of quotes in the ranges before it, and the same sums number
the records. Ranges are few; what is ordered within one is a range's lines.

Quotes stand around whole fields, doubled inside; a quote elsewhere is taken for one around a field. Files end sections like those of small ones: blocks of
20 rows under a line with the columns, ``All Rows`` for a file of one record, nothing for an empty file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions.text import strip
from groundwell.sources.parse import ROWS_PER_SECTION
from groundwell.sources.tables import stored


def records(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".tsv")) -> DataFrame:
    """``file``, ``n`` (from 0) and ``record`` of the table files at or below ``path``."""
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    named = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")
    named = named.where(F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1)).isin(*suffixes))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    lines = stored(named.withColumn("at", F.monotonically_increasing_id()).withColumn("odd", odd), "lines")

    def before(rows: DataFrame, value: str, name: str) -> DataFrame:
        """The sum of ``value`` over a file's ranges that come before."""
        earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("file", "range").agg(F.sum(value).alias(name))  # a row for each range
        return sums.withColumn(name, F.coalesce(F.sum(name).over(earlier), F.lit(0)))

    within = Window.partitionBy("file", "range").orderBy("at")
    marked = lines.join(before(lines, "odd", "open"), ["file", "range"])
    inside = F.col("open") + F.coalesce(F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = stored(marked.withColumn("starts", F.when(inside % 2 == 0, 1).otherwise(0)).drop("open", "odd"), "record-lines")
    number = F.col("first") + F.sum("starts").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    numbered = marked.join(before(marked, "starts", "first"), ["file", "range"]).select("file", number.alias("n"), "range", "at", "value")
    whole = numbered.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("range", "at", "value"))).alias("lines"))
    return whole.select("file", "n", F.regexp_replace(F.array_join("lines.value", "\n"), r"\r\z", "").alias("record"))


def fields(record: Column, delimiter: Column) -> Column:
    """The fields of a record, without quotes; none of an empty one."""
    pattern = F.concat(delimiter, F.lit('("(?:[^"]|"")*"|[^'), delimiter, F.lit("]*)"))
    found = F.regexp_extract_all(F.concat(delimiter, record), pattern, F.lit(1))
    plain = F.transform(found, lambda x: F.when(x.startswith('"') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(record == "", F.array().cast("array<string>")).otherwise(plain)


def table_sections(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``section`` (from 0), ``loc`` and ``text`` of every block of rows."""
    rows = stored(records(spark, path), "records")
    delimiter = F.when(F.lower("file").endswith(".tsv"), F.lit("\t")).otherwise(F.lit(","))
    rows = rows.withColumn("fields", fields(F.col("record"), delimiter))
    head = rows.where("n = 0").select("file", F.col("fields").alias("head"), F.col("record").alias("first"))
    body = rows.where("n > 0").join(head.select("file", "head"), "file")
    width = F.least(F.size("head"), F.size("fields"))
    cells = F.zip_with(F.slice("head", 1, width), F.slice("fields", 1, width), lambda c, v: F.concat(c, F.lit(": "), v))
    line = F.concat(F.lit("Row "), F.col("n").cast("string"), F.lit(": "), F.array_join(cells, " | "))
    section = F.floor((F.col("n") - 1) / ROWS_PER_SECTION).alias("section")
    grouped = body.select("file", "head", section, "n", line.alias("line")).groupBy("file", "head", "section").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows"))
    loc = F.concat(F.lit("Rows "), F.col("rows")[0]["n"].cast("string"), F.lit("-"), F.element_at("rows", -1)["n"].cast("string"))
    text = F.concat(F.lit("Columns: "), F.array_join("head", ", "), F.lit("\n"), F.array_join("rows.line", "\n"))
    alone = head.join(body.select("file").distinct(), "file", "left_anti").select("file", F.lit(0).cast("bigint").alias("section"), F.lit("All Rows").alias("loc"), strip("first").alias("text"))
    return grouped.select("file", "section", loc.alias("loc"), text.alias("text")).unionByName(alone)
