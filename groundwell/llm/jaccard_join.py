"""Exact Jaccard self-join of shingle sets in metric space: pivots, Voronoi cells, windows by the triangle inequality, recursion.

The Jaccard distance is a metric, but two unrelated texts are at a distance of about 1 from each other and from any pivot: cells of the whole
corpus would be replicated into each other whole. So the space is halved first, exactly: if two sets are similar enough, then so are their parts in
at least one half of all shingles (a mean is not above both its parts). Halving goes on, by the bits of the shingles' hashes, until parts
are so small that only equal ones are similar enough. Sets that share such a part (:func:`part_keys`) form a region; its pivot is its smallest set.

In each region the exact distance of every set to the pivot is taken once. Sets within the threshold are linked to the pivot. The others are the
region's home sets; near ones matter to them only within the window that the triangle inequality leaves. A region of many home sets
becomes Voronoi cells around pivots of its own: a set belongs to the nearest pivot and is copied as a boundary set into each cell whose pivot
is at most twice the threshold farther, so a linked pair always meets in the cell of one of its two. Cells are split again until they are small or a
split no longer halves their work; then they are compared in blocks, dealt out by pair of blocks, under size, window and bitmap bounds and by exact intersection.

Texts stay where they are: what is shuffled are part keys (about one for five shingles), and the sets of the texts that share a part, which
are read again through a bounded bitmap.

Defined results: null text counts as empty; a text without words has no set and is linked with nothing; fewer words than a shingle give one
shingle of all of them; texts of equal sets and repeated rows are linked; rows with a null id get the smallest id of their component, or null if
it has none; very long texts are whole, their sets as large as they are; an empty table gives an empty result; other columns are ignored. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.blocks import buffer_of, slices
from groundwell.llm.shared import bitmap, id_and_text, may_hold, schema_with_id, stored, with_maybe
from groundwell.llm.simhash import connected, distinct_shingles, shingle_hashes

#: Bits of the bitmaps that bound a symmetric difference from below.
_BITS = 1024
#: Distances are quotients of whole numbers; windows are wider by more than their rounding.
_SLACK = 1e-9
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def part_sizes(percent: int) -> tuple[int, int]:
    """The largest union of which only equal sets are similar enough, and the least size of both sets of a larger one."""
    assert 50 <= percent <= 99, "percent must be from 50 to 99"
    most = max(k for k in range(1, 101) if percent * k > 100 * (k - 1))
    return most, -(-percent * (most + 1) // 100)


def part_keys(values: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of parts of each row's set, and how many each row has; two rows similar to ``percent`` have one in common.

    ``values`` are the rows' sorted distinct hashes end to end, ``n`` their numbers. A part is what a row holds of the hashes with some first bits.
    One of ``most`` hashes or fewer gives a key; one of ``least`` or more is halved by the next bit, as a similar part may be larger.
    """
    most, least = part_sizes(percent)
    mixed = (values ^ (values >> np.uint64(32))) * _MIX[0]
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    end = np.cumsum(n)
    start, row = end - n, np.arange(len(n))
    rows, keys = [], []
    for depth in range(64):
        size = end - start
        small = (size > 0) & (size <= most)
        rows.append(row[small])
        keys.append((total[end[small]] - total[start[small]]) * _MIX[1])
        large = size >= least
        if not large.any():
            break
        start, end, row = start[large], end[large], row[large]
        zeros = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1) == 0)])
        middle = start + zeros[end] - zeros[start]
        start, end, row = np.concatenate([start, middle]), np.concatenate([middle, end]), np.concatenate([row, row])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    keys ^= keys >> np.uint64(31)
    return keys[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(n))


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sorted distinct hashes of all rows end to end, their numbers, and a digest of each row's set."""
    sets = distinct_shingles(*shingle_hashes(*buffer_of(batch.column("text")), shingle))
    digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64), digests


def _list_array(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))


def prints(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``id``, ``h`` (a hash of id and text), ``size``, ``digest`` and part ``keys`` of every row of ``docs`` (``id``, ``h``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            values, n, digests = _sets(batch, shingle)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n), digests, _list_array(*part_keys(values, n, percent))], out.names)

    out = schema_with_id(docs, "h bigint, size bigint, digest binary, keys array<bigint>")
    return docs.mapInArrow(run, out)


def pivot_pairs(units: DataFrame) -> DataFrame:
    """Distinct (``node``, ``pivot``): the pivot is the smallest node that has a part of ``node`` in common.

    A large group has as many keys as its sets have parts, so no key holds more than a small share of the rows.
    """
    keyed = units.select("node", F.explode("keys").alias("key"))
    return keyed.select("node", F.min("node").over(Window.partitionBy("key")).alias("pivot")).where("node <> pivot").distinct()


def sets_of(docs: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """``node``, ``size`` and ``shingles`` of the texts that ``named`` (``node``, ``h``, ``digest``) names."""
    bits = bitmap(named.select("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            held = may_hold(bits, np.asarray(batch.column("h")).view(np.uint64))
            if held.any():
                batch = batch.filter(pa.array(held))
                values, n, digests = _sets(batch, shingle)
                yield pa.RecordBatch.from_arrays([batch.column("h"), digests, pa.array(n), _list_array(values, n)], ["h", "digest", "size", "shingles"])

    found = docs.select("h", "text").mapInArrow(run, "h bigint, digest binary, size bigint, shingles array<bigint>")
    once = found.groupBy("h", "digest").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    return once.join(named, ["h", "digest"]).select("node", "size", "shingles")


def asked_sets(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``sets`` those that ``nodes`` (``node``) may name: the others stay where they are when sets are moved to a join."""
    return with_maybe(sets, F.xxhash64("node"), nodes.select(F.xxhash64("node"))).where("maybe").drop("maybe")


def distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node``, ``pivot``, ``near`` (within the threshold) and ``at``, the Jaccard distance of the two, for every pair."""
    heads = asked_sets(sets, pairs.select(F.col("pivot").alias("node")).distinct())
    pivots = heads.select(F.col("node").alias("pivot"), F.col("size").alias("p_size"), F.col("shingles").alias("p_shingles"))
    met = pairs.join(asked_sets(sets, pairs), "node").join(pivots, "pivot").select("node", "pivot", F.size(F.array_intersect("shingles", "p_shingles")).cast("bigint").alias("both"), (F.col("size") + F.col("p_size")).alias("sum"))
    union = F.col("sum") - F.col("both")
    return met.select("node", "pivot", (100 * F.col("both") >= percent * union).alias("near"), (1 - F.col("both") / union).alias("at"))


def open_cells(judged: DataFrame, width: float) -> DataFrame:
    """Cells (``cell``, ``node``, ``home``, ``at``) of the regions in which sets are left that the pivot does not decide."""
    left = judged.where("not near").groupBy("pivot").agg(F.min("at").alias("least"))
    rows = judged.join(left, "pivot").where(~F.col("near") | (F.col("at") >= F.col("least") - width - _SLACK))
    return rows.select(F.col("pivot").cast("string").alias("cell"), "node", (~F.col("near")).alias("home"), "at")


def voronoi(cells: DataFrame, sets: DataFrame, width: float, n_pivots: int) -> DataFrame:
    """``cells`` split around ``n_pivots`` of their home sets: ``parent`` and the columns of cells.

    A home set stays one in the cell of its nearest pivot and is copied into earlier cells whose pivots are at most ``2 * width`` farther;
    a boundary set is copied into all such cells.
    """
    drawn = cells.where("home").select("cell", "node", F.xxhash64("node", "cell").alias("draw"))
    chosen = drawn.groupBy("cell", F.pmod("draw", F.lit(n_pivots)).cast("int").alias("k")).agg(F.min(F.struct("draw", "node"))["node"].alias("node"))
    sets = asked_sets(sets, cells)
    held = chosen.join(sets, "node").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "size", "shingles"))).alias("pivots"))  # n_pivots at most

    def distance(p):
        both = F.size(F.array_intersect(p["shingles"], F.col("shingles")))
        return F.struct((1 - both / (p["size"] + F.col("size") - both)).alias("at"), p["k"].alias("k"))

    met = cells.join(sets, "node").join(held, "cell").select("cell", "node", "home", F.transform("pivots", distance).alias("all"))
    met = met.withColumn("own", F.array_min("all"))
    within = lambda p: (p["at"] <= F.col("own.at") + 2 * width + _SLACK) & (~F.col("home") | (p["k"] <= F.col("own.k")))
    met = met.select("cell", "node", "home", "own", F.explode(F.filter("all", within)).alias("p"))
    return met.select(F.col("cell").alias("parent"), F.concat_ws("/", "cell", F.col("p.k").cast("string")).alias("cell"), "node", (F.col("home") & (F.col("p.k") == F.col("own.k"))).alias("home"), F.col("p.at").alias("at"))


def _work(cells: DataFrame, by: str = "cell") -> DataFrame:
    sizes = cells.groupBy(*dict.fromkeys((by, "cell"))).agg(F.count_if("home").cast("double").alias("homes"), F.count("*").alias("n"))
    return sizes.groupBy(by).agg(F.max("homes").alias("homes"), F.sum(F.col("homes") * F.col("n")).alias("work"))


def small_cells(cells: DataFrame, sets: DataFrame, width: float, block_rows: int, n_pivots: int) -> DataFrame:
    """``cells`` split by :func:`voronoi`, again and again while one holds over ``block_rows`` home sets and a split halves its work."""
    done, cells = None, stored(cells, "cells")
    while True:
        large = stored(_work(cells).where(F.col("homes") > block_rows), "large-cells")
        if not large.limit(1).count():
            return cells if done is None else done.union(cells)
        split = stored(voronoi(cells.join(large, "cell", "left_semi"), sets, width, n_pivots), "voronoi")
        better = stored(_work(split, "parent").withColumnRenamed("work", "after").join(large.select(F.col("cell").alias("parent"), "work"), "parent").where("after <= work / 2").select("parent"), "halved")
        stay = cells.join(better.select(F.col("parent").alias("cell")), "cell", "left_anti")
        done = stay if done is None else done.union(stay)
        cells = split.join(better, "parent", "left_semi").drop("parent")


def block_links(cells: DataFrame, sets: DataFrame, percent: int, block_rows: int, block_shingles: int) -> DataFrame:
    """Edges (a, b) that connect, in each cell, home sets with all sets that are similar enough, by exact intersection.

    Rows are dealt into blocks of home and of boundary sets; pairs of blocks are listed first and dealt out by pair.
    """
    sized = cells.join(sets.select("node", "size"), "node")
    parts = lambda flag: F.ceil(F.greatest(F.count_if(flag) / block_rows, F.sum(F.when(flag, F.col("size")).otherwise(0)) / block_shingles)).cast("int")
    counts = stored(sized.groupBy("cell").agg(F.count("*").alias("n"), parts(F.col("home")).alias("homes"), parts(~F.col("home")).alias("others")).where("homes > 0 and n > 1").drop("n"), "cell-blocks")
    dealt = sized.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("others"))).cast("int"))
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda across, low, high: F.struct(F.lit(across).alias("across"), low.alias("low"), high.alias("high"))
    own = F.transform(every("homes"), lambda q: place(False, F.least("part", q), F.greatest("part", q)))
    out = F.transform(every("others"), lambda q: place(True, F.col("part"), q))
    back = F.transform(every("homes"), lambda p: place(True, p, F.col("part")))
    dealt = dealt.select("cell", "node", "home", "part", "at", F.explode(F.when(F.col("home"), F.concat(own, out)).otherwise(back)).alias("pair"))
    rows = dealt.join(asked_sets(sets, sized.join(counts, "cell", "left_semi")), "node").groupBy("cell", "pair").agg(F.collect_list(F.struct("node", "home", "part", "at", "size", "shingles")).alias("rows")).where("size(rows) > 1").select("pair.across", "pair.low", "pair.high", "rows")
    width = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, rows = [], batch.column("rows")
            ends, (node, home, part, at, size, shingles) = rows.offsets.to_numpy(), rows.values.flatten()
            node, home, part, at, size = (np.asarray(x) for x in (node, home, part, at, size))
            begins, hashes = shingles.offsets.to_numpy(), np.asarray(shingles.values).view(np.uint64)
            for k, (across, low, high) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("across", "low", "high")), strict=True)):
                own = slice(ends[k], ends[k + 1])
                first = home[own] if across else part[own] == low
                if first.any() and (low == high and not across or not first.all()):
                    sets = [hashes[begins[r] : begins[r + 1]] for r in range(ends[k], ends[k + 1])]
                    edges += linked(node[own], first, at[own], size[own], sets, percent, width)
            edges = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def linked(node: np.ndarray, first: np.ndarray, at: np.ndarray, size: np.ndarray, sets: list[np.ndarray], percent: int, width: float) -> list[tuple[int, int]]:
    """Edges that connect what similar pairs of the sets connect: pairs across the two sides of ``first``, or all pairs if there is one side.

    Bounds come first: sizes, distances to the cell's pivot, and bits that differ in bitmaps of parities, of which there are no more than
    hashes that differ. Pairs that earlier ones connect are not intersected.
    """
    bits = np.stack([np.packbits(np.bincount((x % np.uint64(_BITS)).astype(np.int64), minlength=_BITS).astype(np.uint8) & 1).view(np.uint64) for x in sets])
    left = np.flatnonzero(first)
    right = left if first.all() else np.flatnonzero(~first)
    label, edges = np.arange(len(node)), []
    for i in left.tolist():
        other = right[(label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i])) & (np.abs(at[right] - at[i]) <= width + _SLACK)]
        apart = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for j in other[(100 + percent) * apart <= (100 - percent) * (size[other] + size[i])].tolist():
            if label[i] != label[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    edges.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
    return [(a, b) for a, b in edges if a != b]


def links(docs: DataFrame, units: DataFrame, shingle: int, percent: int, block_rows: int, block_shingles: int, n_pivots: int) -> DataFrame:
    """Edges (a, b) between nodes of ``units`` (``node``, ``least``, ``digest``, ``keys``) that connect all similar pairs."""
    pairs = stored(pivot_pairs(units), "pivot-pairs")
    met = pairs.select("node").union(pairs.select(F.col("pivot").alias("node"))).distinct()
    named = stored(units.select("node", "least.h", "digest").join(met, "node"), "sharing")
    sets = stored(sets_of(docs, named, shingle), "sets")
    judged = stored(distances(pairs, sets, percent), "pivot-distances")
    width = 1 - percent / 100
    cells = small_cells(open_cells(judged, width), sets, width, block_rows, n_pivots)
    return judged.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(block_links(cells, sets, percent, block_rows, block_shingles))


def components(df: DataFrame, shingle: int = 3, percent: int = 90, block_rows: int = 512, block_shingles: int = 1 << 19, n_pivots: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is ``percent`` per cent or more.
    """
    docs = id_and_text(df, id_col, text_col).withColumn("h", F.xxhash64("id", "text"))
    own = stored(prints(docs, shingle, percent), "set-prints")
    units = own.where("size > 0").groupBy("size", "digest").agg(F.min(F.struct("id", "h")).alias("least"), F.min("id").alias("first_id"), F.first("keys").alias("keys"))
    units = stored(units.withColumn("node", F.monotonically_increasing_id()), "set-units")
    labels = connected(links(docs, units, shingle, percent, block_rows, block_shingles, n_pivots))
    rooted = units.select("node", "size", "digest", "first_id").join(labels, "node", "left").withColumn("root", F.coalesce("label", "node"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = rooted.join(first, "root").select("size", "digest", "component_id")
    found = own.select("id", "size", "digest").join(of_set, ["size", "digest"], "left")
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
