"""The page index written in ordered parts: refused while pages have errors, checked by digest without being rendered.

What :func:`~groundwell.operators.governance.render_index` puts into one text for people is written here as lines, sorted by ranges of kind, title and path, so a part is
a task's work and no row holds more than a page's line. A manifest, committed last, names the folder of the parts and holds the number of pages and a digest of all
lines; a line's digest covers its place, so they can be added up in any order. The parts, one after another, are the rendered text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.text import title_case
from groundwell.operators.governance import NAVIGATIONAL, TYPE_HEADING
from groundwell.sources.store import VersionedTables
from groundwell.sources.tables import stored

_ORDER = ("place", "type", "key", "rel", "line")


class LintError(ValueError):
    """Pages have findings of severity ``error``."""


def index_lines(pages: DataFrame) -> DataFrame:
    """``place``, ``type``, ``heading``, ``key`` (lower-cased title), ``rel`` and ``line`` of every page but for navigation."""
    kinds = F.array(*map(F.lit, TYPE_HEADING))
    heading = F.create_map(*(F.lit(x) for pair in TYPE_HEADING.items() for x in pair))
    rows = pages.where(~F.col("slug").isin(*NAVIGATIONAL)).select(F.coalesce("type", F.lit("concept")).alias("type"), F.coalesce("title", "slug").alias("title"), F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), "rel")
    known = F.array_contains(kinds, F.col("type"))
    place = F.when(known, F.array_position(kinds, F.col("type"))).otherwise(1000).cast("int")
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "rel", F.lit(") — "), "summary")
    return rows.select(place.alias("place"), "type", F.when(known, heading[F.col("type")]).otherwise(title_case("type")).alias("heading"), F.lower("title").alias("key"), "rel", line.alias("line"))


def digest(lines: DataFrame) -> DataFrame:
    """One row: ``n`` lines and their ``digest``."""
    own = F.conv(F.left(F.sha2(F.to_json(F.struct(*_ORDER, "heading")), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(own), F.lit(0)).cast("string").alias("digest"))


def write_index(pages: DataFrame, findings: DataFrame, path: str, lines_per_part: int = 100_000) -> int:
    """Writes the parts and commits their manifest; raises :class:`LintError`, and writes nothing, if ``findings`` (of ``governance.lint``) hold an error."""
    wrong = findings.where("severity = 'error'").limit(1).collect()
    if wrong:
        raise LintError(f"{wrong[0]['page']}: {wrong[0]['rule']} {wrong[0]['detail']}")
    spark, lines = pages.sparkSession, stored(index_lines(pages), "index-lines")
    total = digest(lines).first()
    # where headings come: before the first line of each kind; the first of all follows the title
    firsts = lines.groupBy("place", "type").agg(F.min(F.struct("key", "rel", "line")).alias("first"))
    least = firsts.agg(F.min(F.struct("place", "type")).alias("least"))
    firsts = firsts.crossJoin(F.broadcast(least)).select("place", "type", "first", (F.struct("place", "type") == F.col("least")).alias("top"))  # one row
    parts = max(1, -(-total.n // lines_per_part))
    rows = lines.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows, "sorted-lines")
    # of equal lines only one may carry the heading
    heads = rows.join(firsts, ["place", "type"]).where(F.struct("key", "rel", "line") == F.col("first")).groupBy("place", "type", "top").agg(F.min("at").alias("at"))
    title = F.array(F.lit("# Index"), F.lit(""), F.lit(f"_{total.n} pages_"), F.lit(""))
    text = rows.join(heads.select("at", "top"), "at", "left")
    block = F.array(F.concat(F.lit("## "), "heading"), F.lit(""), F.col("line"))
    text = text.select("at", F.when(F.col("top").isNull(), F.array("line")).when(F.col("top"), F.concat(title, block)).otherwise(F.concat(F.array(F.lit("")), block)).alias("lines"))
    if not total.n:
        text = spark.range(1).select(F.col("id").alias("at"), F.array(F.lit("# Index"), F.lit(""), F.lit("_0 pages_"), F.lit(""), F.lit("")).alias("lines"))
    folder = f"{path.rstrip('/')}/parts-{uuid.uuid4().hex}"
    text.repartitionByRange(parts, "at").sortWithinPartitions("at").select(F.explode("lines").alias("value")).write.text(folder)
    manifest = spark.createDataFrame([(folder, parts, total.n, total.digest)], "folder string, parts int, n bigint, digest string")
    return VersionedTables(spark, path).write(manifest=manifest)


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    found = VersionedTables(spark, path).paths("manifest")
    return spark.read.parquet(found[-1]) if found else None


def check_index(pages: DataFrame, path: str) -> str:
    """``ok``, ``stale`` (the pages give other lines) or ``missing``."""
    manifest = _manifest(pages.sparkSession, path)
    if manifest is None:
        return "missing"
    kept, now = manifest.first(), digest(index_lines(pages)).first()
    return "ok" if (kept.n, kept.digest) == (now.n, now.digest) else "stale"


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """``part`` (its file's name, by which parts are ordered) and ``content`` of the last index."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no index at {path}")
    parts = spark.read.text(manifest.first().folder, wholetext=True)
    return parts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"), F.col("value").alias("content"))
