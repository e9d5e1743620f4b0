"""Lint, link graph, address verification, minting of hints, healing, and the page index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.functions.text import link_target, normalize_path, title_case, wikilinks
from groundwell.sources.tables import stored

# Fields that a page must have, entries of its tree, pages that only navigate, parts of a source, and kinds in order with their headings.
REQUIRED = ("type", "title", "summary", "entities", "department", "sources", "last_compiled")
TREE = ("index.md", "archive.md", "log.md", "techniques", "entities", "playbooks", "concepts")
NAVIGATIONAL = ("index", "archive", "log")
SOURCE_KEYS = ("path", "loc", "hint")
TYPE_HEADING = {"technique": "Techniques", "playbook": "Playbooks", "concept": "Concepts", "entity": "Entities"}


def edges(pages: DataFrame, body: str = "body") -> DataFrame:
    """``src`` and ``dst`` of every link, repeats included."""
    return pages.select(F.col("slug").alias("src"), F.explode(wikilinks(body)).alias("link")).select("src", link_target("link").alias("dst"))


def unresolved(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages.select(F.col("slug").alias("dst")), "dst", "left_anti").distinct()


def inbound(links: DataFrame) -> DataFrame:
    """How many links from other pages each target has."""
    return links.where("src <> dst").groupBy("dst").agg(F.count("*").alias("n_links"))


def orphans(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that no other page links to, but for navigation."""
    return pages.where(~F.col("slug").isin(*NAVIGATIONAL)).select("slug").join(inbound(links).select(F.col("dst").alias("slug")), "slug", "left_anti")


def reachable(links: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """``slug`` and the least number of ``hops`` to it, up to a bound."""
    steps = links.select("src", "dst").distinct()
    seen = start.select("slug").distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(steps, front.slug == steps.src).select(F.col("dst").alias("slug")).distinct().join(seen, "slug", "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def missing_fields(pages: DataFrame, present: Column, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A row for each required field that a page lacks; ``present`` is the array of names it has."""
    return pages.select("slug", F.explode(F.array_except(F.array(*map(F.lit, required)), present)).alias("field"))


def missing_sources(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose file, or its placeholder, is not among ``files`` (``path``)."""
    named = pages.select("slug", F.explode("sources").alias("s")).select("slug", F.col("s.path").alias("path")).where("path <> ''")
    known = files.select(normalize_path(F.regexp_replace("path", r"\.placeholder\.md$", "")).alias("__file")).union(files.select(normalize_path("path"))).distinct()
    return named.join(known, normalize_path("path") == F.col("__file"), "left_anti")


def missing_entries(tree: DataFrame) -> DataFrame:
    """Required entries of a page tree that are not among its ``entry`` values."""
    return tree.sparkSession.createDataFrame([(x,) for x in TREE], "entry string").join(tree.select("entry"), "entry", "left_anti")


def missing_source_keys(pages: DataFrame) -> DataFrame:
    """``slug``, ``n`` (place in the list) and ``key`` for each part that a source lacks.

    A key counts as present if ``source_keys`` (the keys of each source, as pages are loaded) has it, whatever its value; pages without that
    column can only be judged by null values.
    """
    if "source_keys" in pages.columns:
        lacking = pages.select("slug", F.posexplode("source_keys").alias("n", "keys")).select("slug", "n", F.explode(F.array_except(F.array(*map(F.lit, SOURCE_KEYS)), "keys")).alias("key"))
    else:
        place = pages.select("slug", F.posexplode("sources").alias("n", "s"))
        lacking = place.select("slug", "n", F.explode(F.array_compact(F.array(*(F.when(F.col(f"s.{k}").isNull(), k) for k in ("path", "hint"))))).alias("key"))
    return lacking


def lint(pages: DataFrame, files: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """``severity``, ``page``, ``rule``, ``detail`` of all checks. Pages have ``slug``, ``body``, ``present`` and ``sources``."""
    links = edges(pages)
    found = [
        missing_fields(pages, F.col("present")).select(F.lit("error"), "slug", F.lit("missing_field"), "field"),
        pages.where(F.array_contains("present", "related")).select(F.lit("error"), "slug", F.lit("forbidden_field"), F.lit("related")),
        missing_source_keys(pages).select(F.lit("error"), "slug", F.lit("source_field"), F.concat_ws(".", "n", "key")),
        missing_sources(pages, files).select(F.lit("error"), "slug", F.lit("source_file"), "path"),
        unresolved(links, pages).select(F.lit("warning"), "src", F.lit("unresolved_link"), "dst"),
        orphans(links, pages).select(F.lit("warning"), "slug", F.lit("orphan"), F.lit("")),
    ]
    if tree is not None:
        found.append(missing_entries(tree).select(F.lit("error"), F.lit(""), F.lit("tree"), "entry"))
    return reduce(DataFrame.union, found).toDF("severity", "page", "rule", "detail")


def verify(addresses: DataFrame, hits: DataFrame) -> DataFrame:
    """``pass`` if a hit comes from the addressed file, ``drift`` if hits come only from others, else ``fail``; with the files that were hit.

    Hits have ``ord`` and ``file_path`` and were searched without a path, so drift can show.
    """
    found = hits.groupBy("ord").agg(F.array_sort(F.collect_set(normalize_path("file_path"))).alias("matched_files"))
    out = addresses.join(found, "ord", "left").withColumn("matched_files", F.coalesce("matched_files", F.array().cast("array<string>")))
    status = F.when(F.size("matched_files") == 0, "fail").when(F.array_contains("matched_files", normalize_path("path")), "pass").otherwise("drift")
    return out.select("ord", "path", "hint", status.alias("status"), "matched_files")


def mint(candidates: DataFrame) -> DataFrame:
    """For each ``path`` the first candidate (``ord``, ``hint``, ``status``) that passes, and what was tried up to it."""
    first = candidates.groupBy("path").agg(F.min(F.when(F.col("status") == "pass", F.col("ord"))).alias("first"))
    trail = candidates.join(first, "path").where("first is null or ord <= first")
    tried = F.array_sort(F.collect_list(F.struct("ord", "hint", "status")))
    out = trail.groupBy("path", "first").agg(tried.alias("tried"))
    minted = F.when(F.col("first").isNotNull(), F.element_at("tried", -1)["hint"])
    return out.select("path", minted.alias("hint"), F.when(F.col("first").isNull(), "no_hint_works").otherwise("minted").alias("status"), F.col("tried.status").alias("trail"))


def heal_candidates(pages: DataFrame) -> DataFrame:
    """Hints to try for a page: title, first 50 characters of the summary, summary, entities; blanks left out."""
    hints = F.concat(F.array("title", F.left("summary", F.lit(50)), "summary"), "entities")
    return pages.select("slug", F.posexplode(F.filter(hints, lambda h: F.trim(F.coalesce(h, F.lit(""))) != "")).alias("ord", "hint"))


#: A line that gives a hint: what stands before its value, the value, and blanks behind it.
_HINT_LINE = r"^([ \t]*(?:- +)?hint:[ \t]*)(.*?)([ \t\r]*)$"


def hint_of(line: Column) -> Column:
    """The hint that a line gives, without quotes around it; null for other lines."""
    value = F.regexp_extract(line, _HINT_LINE, 2)
    mark = F.left(value, F.lit(1))
    enclosed = mark.isin("'", '"') & (F.length(value) > 1) & (F.right(value, F.lit(1)) == mark)
    return F.when(line.rlike(_HINT_LINE), F.when(enclosed, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def _with_hint(lines: Column, old: Column, new: Column) -> Column:
    """The lines with the first that gives the old hint giving the new one, in double quotes; null if none gives it."""
    written = F.concat(F.lit('"'), F.replace(new, F.lit('"'), F.lit('\\"')), F.lit('"'))
    place = lambda found: F.array_position(found, F.lit(True)).cast("int") - 1
    given = F.transform(lines, lambda line: F.coalesce(hint_of(line) == old, F.lit(False)))
    spliced = lambda line: F.concat(F.regexp_extract(line, _HINT_LINE, 1), written, F.regexp_extract(line, _HINT_LINE, 3))
    edit = lambda at: F.when(at >= 0, F.transform(lines, lambda line, k: F.when(k == at, spliced(line)).otherwise(line)))
    return F.element_at(F.transform(F.array(place(given)), edit), 1)


def heal_edit(df: DataFrame, text: str, old: str, new: str, out: str = "healed") -> DataFrame:
    """Sets the first line with the old hint, quoted or not, to the new one in double quotes; other texts stay."""
    healed = _with_hint(F.split(F.col(text), "\n", -1), F.col(old), F.col(new))
    return df.withColumn(out, F.coalesce(F.array_join(healed, "\n"), F.col(text)))


def apply_heals(pages: DataFrame, heals: DataFrame, text: str = "text") -> DataFrame:
    """``slug``, the ``text`` after all its heals (``old``, ``new``) in order of the old hints, and how many of them found their hint."""
    listed = heals.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("heals"))
    start = F.struct(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines"), F.lit(0).alias("applied"))

    def step(state: Column, heal: Column) -> Column:
        after = F.array(_with_hint(state["lines"], heal["old"], heal["new"]))
        return F.element_at(F.transform(after, lambda lines: F.when(lines.isNotNull(), F.struct(lines.alias("lines"), (state["applied"] + 1).alias("applied"))).otherwise(state)), 1)

    healed = pages.join(listed, "slug").withColumn("h", F.aggregate("heals", start, step))
    return healed.select("slug", F.array_join("h.lines", "\n").alias("text"), F.col("h.applied").alias("applied"))


def by_kind(pages: DataFrame) -> DataFrame:
    """``type`` (``concept`` where there is none), its ``place`` and ``heading``, ``n`` pages and their sorted ``lines``, but for navigation.

    Known kinds come first in their order, the others by name; pages are sorted by title, whatever its case, then by ``rel``.
    """
    kinds = F.array(*map(F.lit, TYPE_HEADING))
    heading = F.create_map(*(F.lit(x) for pair in TYPE_HEADING.items() for x in pair))
    rows = pages.where(~F.col("slug").isin(*NAVIGATIONAL)).select(F.coalesce("type", F.lit("concept")).alias("type"), F.coalesce("title", "slug").alias("title"), F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), "rel")
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "rel", F.lit(") — "), "summary")
    grouped = rows.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.lower("title"), "rel", line.alias("line")))).alias("lines"))
    known = F.array_contains(kinds, F.col("type"))
    return grouped.select("type", F.when(known, F.array_position(kinds, F.col("type"))).otherwise(1000).cast("int").alias("place"), F.when(known, heading[F.col("type")]).otherwise(title_case("type")).alias("heading"), "n", F.col("lines.line").alias("lines"))


def render_index(pages: DataFrame) -> DataFrame:
    """One row: the index of all pages by kind and title, free of dates. A page of text for people: it is put together in one task."""
    block = F.concat(F.lit("## "), "heading", F.lit("\n\n"), F.array_join("lines", "\n"))
    blocks = by_kind(pages).select("n", F.struct("place", "type", block.alias("block")).alias("b"))
    whole = blocks.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("b")).alias("b"))
    return whole.select(F.concat(F.lit("# Index\n\n_"), F.coalesce("n", F.lit(0)), F.lit(" pages_\n\n"), F.array_join(F.col("b.block"), "\n\n"), F.lit("\n")).alias("content"))


def round_trips(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages whose list of sources is the same, whatever its order, before and after."""
    form = lambda df, name: df.select("slug", F.to_json(F.array_sort("sources")).alias(name))
    return form(before, "a").join(form(after, "b"), "slug").select("slug", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def first_source_page(addresses: DataFrame) -> DataFrame:
    """The page that names an address last, for each (path, hint)."""
    last = Window.partitionBy("path", "hint").orderBy(F.col("slug").desc(), F.col("ord").desc())
    return addresses.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def broken(reports: DataFrame) -> DataFrame:
    """Reports that ask for a new hint."""
    return reports.where(F.col("status").isin("drift", "fail"))


def verify_and_heal(pages: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``slug``, ``path``, ``old``, ``new``, ``loc`` and ``trigger`` of every heal that is proposed; nothing is changed.

    Every address of every page is verified; a broken one takes the place of the first address with its path and hint, and the page
    that names this last gives the hints to try. ``retrieve`` gives hits for rows of ``ord`` and ``hint`` without looking at paths; it is asked
    twice in all, once for the addresses and once for all candidates together. The proposal is the first candidate that passes.
    """
    from groundwell.operators.fetch import addresses_of

    named = addresses_of(pages).withColumnRenamed("ord", "place").withColumn("loc", F.nullif("loc", F.lit("")))
    order = Window.partitionBy("path", "hint").orderBy("slug", "place")
    first = named.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("path", "hint", "loc")
    # the page that holds the very same address (place included) last
    holder = named.withColumnRenamed("loc", "own_loc").join(first, ["path", "hint"]).where(F.col("own_loc").eqNullSafe(F.col("loc"))).groupBy("path", "hint").agg(F.max("slug").alias("slug"))
    addresses = stored(first.join(holder, ["path", "hint"]).withColumn("ord", F.sha2(F.concat_ws("\0", "path", "hint"), 256)), "addresses")
    reports = broken(verify(addresses.select("ord", "path", "hint"), retrieve(addresses.select("ord", "hint")))).select("ord", "status")
    asked = addresses.join(reports.withColumnRenamed("status", "trigger"), "ord").withColumnRenamed("ord", "address").withColumnRenamed("hint", "old")
    tries = stored(asked.join(heal_candidates(pages), "slug").withColumn("tried", F.concat_ws("#", "address", "ord")), "heal-candidates")
    tested = verify(tries.select(F.col("tried").alias("ord"), "path", "hint"), retrieve(tries.select(F.col("tried").alias("ord"), "hint")))
    passed = tested.where("status = 'pass'").select(F.col("ord").alias("tried"))
    best = Window.partitionBy("address").orderBy("ord")
    good = tries.join(passed, "tried").withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return good.select("slug", "path", "old", F.col("hint").alias("new"), "loc", "trigger")


def index_is_stale(rendered: DataFrame, stored: str | None) -> bool:
    """Whether a stored index differs from the rendered one."""
    return rendered.first()["content"] != stored


def compile_page(notes: DataFrame, today: str) -> DataFrame:
    """``rel`` and ``text`` of a page for each note (``title``, ``category``, ``summary``, ``path``, ``hint``); the summary comes from the caller, the date is given."""
    from groundwell.functions.text import note_file_name, source_block, yaml_scalar

    front = F.format_string("---\ntype: %s\ntitle: %s\nsummary: %s\nentities: []\ndepartment: all\nlast_compiled: %s\nsources:\n", yaml_scalar("category"), yaml_scalar("title"), yaml_scalar("summary"), F.lit(today))
    body = F.concat(F.lit("---\n\n# "), "title", F.lit("\n\n## Summary\n\n"), "summary", F.lit("\n"))
    return notes.select(F.concat("category", F.lit("/"), note_file_name("title")).alias("rel"), F.concat(front, source_block("path", "hint", F.lit("")), body).alias("text"))


def heal_log(heals: DataFrame, at: str) -> DataFrame:
    """A line for each heal (``slug``, ``old``, ``new``, ``trigger``) for an append-only log."""
    return heals.select(F.format_string("- [%s] heal (%s): %s: %s -> %s", F.lit(at), F.col("trigger"), F.col("slug"), F.col("old"), F.col("new")).alias("value"))


def append_heal_log(heals: DataFrame, at: str, path: str) -> None:
    """Adds the lines of :func:`heal_log` to the log at ``path``, a folder of text files; lines that are there stay."""
    heal_log(heals, at).write.mode("append").text(path)
