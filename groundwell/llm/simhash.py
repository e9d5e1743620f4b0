"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is the bitwise majority over the XXH64 (seed 42) of a text's word shingles. Distinct fingerprints are put
into tiles that share the population counts of their four 16-bit quarters. Two fingerprints that differ in at most
``radius`` bits have quarter counts that differ by at most ``radius`` in sum, so all other tile pairs are skipped; the
others are compared exactly, every fingerprint of one tile against every one of the other, by exclusive-or and bit counts.
A tile holds about ``tile_size`` fingerprints at most, however many share its counts, so no task holds more than two tiles.

Of the links of a tile pair only a spanning forest leaves the task: a dense group of near copies gives as many
edges as it has members, not all its pairs, and no link between different fingerprints is lost to connectivity. Components
come from distributed minimum-label propagation with shortcuts; its state goes through the shared checkpoint folder.

Defined results: a text without words has fingerprint zero, linked like any other; fewer words than a shingle give one
shingle of all of them; null text counts as empty; repeated rows share a component; rows with a null id get
the smallest id of their component, or null if it has none; very long texts are hashed whole; an empty table gives an empty result; other columns are ignored
by :func:`components` and pass through :func:`keep_one` unchanged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.blocks import IS_SPACE, Words, buffer_of, slices
from groundwell.llm.shared import id_and_text, schema_with_id, stored, text_of, with_maybe, without_copies

_QUARTERS = 4
#: 26 letters move 32 places up.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every row, and how many each row has."""
    data = _LOWER[data]
    words = Words(data, offsets, ~IS_SPACE[data])
    # one space after each word: shingles are then slices
    length = words.ends - words.starts
    at = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)
    gaps = np.ones(at[-1], bool)
    gaps[at[1:] - 1] = False
    joined[gaps] = data[words._keep]
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.repeat(words.rows[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    last = np.minimum(first + size, np.repeat(words.rows[1:], n))
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], 42) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)]
    return np.array(hashes, np.uint64), n


def fingerprint_rows(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits set in over half of each row's hashes; zero for a row without any."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        begins = np.concatenate([[0], np.cumsum(n[full])])
        for a in range(0, len(full), 4096):
            b = min(a + 4096, len(full))
            own = hashes[begins[a] : begins[b]]
            bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts = np.add.reduceat(bits, begins[a:b] - begins[a], axis=0, dtype=np.int32)
            out[full[a:b]] = np.packbits(2 * counts > n[full[a:b], None], axis=1).view(">u8").ravel()
    return out


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the signed 64-bit ``fp`` of every row."""
    docs = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            fp = fingerprint_rows(*shingle_hashes(*buffer_of(batch.column("text")), shingle))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(run, schema_with_id(docs, "fp bigint"))


def _tile_key(fp: Column) -> Column:
    """Quarter counts, five bits each, moved up by the room that offsets need."""
    key = F.lit(0)
    for q in range(_QUARTERS):
        count = F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF)))
        key = key + (count.cast("int") + 8) * (1 << (5 * q))
    return key


def _offsets(radius: int) -> list[int]:
    """Differences of tile keys within the radius, one of each opposite pair."""
    near = [v for v in itertools.product(range(-radius, radius + 1), repeat=_QUARTERS) if sum(map(abs, v)) <= radius]
    return [sum(x << (5 * q) for q, x in enumerate(v)) for v in near if v >= (0,) * _QUARTERS]


def forest(left: np.ndarray, right: np.ndarray, near, strip: int = 256) -> list[tuple[int, int]]:
    """Edges that connect what the links between two tiles connect, at most one for each member.

    ``left`` and ``right`` are the members' names; ``near(a, b)`` tells which of the members ``left[a:b]`` are linked to which of ``right``.
    """
    found = [(i + a, j) for a in range(0, len(left), strip) for i, j in (np.nonzero(near(a, min(a + strip, len(left)))),)]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    unlike = left[i] != right[j]
    i, j = i[unlike], j[unlike]
    if len(i) <= len(left) + len(right):
        return list(zip(left[i].tolist(), right[j].tolist(), strict=True))
    values, node = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = node[i], node[len(left) + j]
    label = np.arange(len(values))
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (before == label).all():
            break
    inner = np.flatnonzero(label != np.arange(len(values)))
    return list(zip(values[inner].tolist(), values[label[inner]].tolist(), strict=True))


#: Comparisons of two members that a task makes at most, about a second's, and at least if there are cores without any.
_MOST, _LEAST = 1 << 28, 1 << 21


def meeting(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``fps`` and ``other_fps`` of each pair of blocks.

    ``blocks`` have ``at``, which names them, and ``fps``; ``pairs`` have ``low`` and ``high``, names of blocks that are to be compared. Pairs are listed
    before any array moves, and each is dealt out on its own, over as many tasks as all products of sizes ask for: neither a large tile nor a tile with
    many neighbours meets all of them in one place.
    """
    pairs, sizes = stored(pairs, "pairs"), blocks.select("at", F.size("fps").alias("n"))
    products = pairs.join(sizes.withColumnsRenamed({"at": "low", "n": "a"}), "low").join(sizes.withColumnsRenamed({"at": "high", "n": "b"}), "high")
    total = products.agg(F.coalesce(F.sum(F.col("a").cast("bigint") * F.col("b")), F.lit(0))).first()[0]
    tasks = max(-(-total // _MOST), min(blocks.sparkSession.sparkContext.defaultParallelism, -(-total // _LEAST)), 1)
    pair = F.struct("low", "high").alias("pair")
    sides = pairs.select(F.col("low").alias("at"), pair, F.lit(True).alias("first")).union(pairs.select(F.col("high").alias("at"), pair, F.lit(False).alias("first")))
    met = blocks.join(sides, "at").select("pair", "first", "fps").repartition(int(tasks), "pair")
    own = lambda first: F.first(F.when(F.col("first") == first, F.col("fps")), ignorenulls=True)
    return met.groupBy("pair").agg(own(True).alias("fps"), own(False).alias("other_fps")).where("fps is not null and other_fps is not null").select("fps", "other_fps")


def tile_pairs(keyed: DataFrame, offsets: list[int], tile_size: int) -> DataFrame:
    """Pairs of tiles whose keys differ by one of ``offsets``: ``fps`` and ``other_fps``, arrays of ``fp``.

    ``keyed`` has ``tile`` and distinct ``fp``. Tile keys must be few whatever the input (counts of bits: at most 17 to the
    power of ``_QUARTERS``): their sizes are broadcast. Neighbours are found by key first, see :func:`meeting` for the arrays.
    """
    sizes = keyed.groupBy("tile").agg(F.count("*").alias("n"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("n") / tile_size).cast("int")), "tile-sizes")
    at = F.struct("tile", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")).alias("at")
    tiles = stored(keyed.join(F.broadcast(sizes), "tile").select(at, "fp").groupBy("at").agg(F.collect_list("fp").alias("fps")), "tiles")
    beside = sizes.select(F.col("tile").alias("own"), F.col("parts").alias("own_parts"), F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("tile", F.col("own") + F.col("offset"))
    beside = beside.join(F.broadcast(sizes.select("tile", "parts")), "tile")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    listed = beside.select("own", "tile", "parts", every("own_parts").alias("own_part")).select("own", "tile", "own_part", every("parts").alias("part"))
    listed = listed.where("own <> tile or own_part <= part")
    place = lambda tile, part: F.struct(F.col(tile).alias("tile"), F.col(part).alias("part"))
    return meeting(tiles, listed.select(place("own", "own_part").alias("low"), place("tile", "part").alias("high")))


def links(fps: DataFrame, radius: int = 3, tile_size: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct values of ``fp`` that connect all pairs within the radius."""
    assert radius < 8, "tile keys leave room for offsets under 8"
    pairs = tile_pairs(fps.select("fp").distinct().withColumn("tile", _tile_key(F.col("fp"))), _offsets(radius), tile_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            (a, x), (b, y) = (_lists(batch.column(k)) for k in (0, 1))
            for k in range(batch.num_rows):
                left, right = x[a[k] : a[k + 1]], y[b[k] : b[k + 1]]
                edges += forest(left, right, lambda p, q, left=left, right=right: np.bitwise_count(left[p:q, None] ^ right[None, :]) <= radius)
            yield _edge_batch(edges)

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    edges = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node of ``edges`` (a, b).

    In a round every node takes the smallest of itself and its neighbours, which makes trees; each becomes one node, named by its root, and only edges
    between different trees go on. A node that nothing joins in a round has a smaller neighbour in the next, so two rounds halve the nodes at least; and
    a dense group's edges meet its labels once, not once in each round. Minima are partial before they are shuffled, and both sides of every join are
    tables in the shared folder: a node of very many edges, or a label of very many nodes, is a skewed partition that adaptive execution splits.
    """
    # written before it is turned round: a spanning forest made twice may be another one each time, and links would be lost
    once = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        least = once.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")).union(once.select(F.col("a").alias("node"), F.col("a").alias("label")))
        own = stored(least.groupBy("node").agg(F.min("label").alias("label")), "labels")
        while True:
            roots = own.select(F.col("node").alias("label"), F.col("label").alias("root"))
            own = stored(own.join(roots, "label").select("node", F.col("root").alias("label"), F.col("label").alias("before")), "roots")
            moved = own.where("label <> before").limit(1).count()
            own = own.select("node", "label")
            if not moved:
                break
        if labels is None:
            labels = own
        else:
            labels = stored(labels.join(own.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        of = lambda side: own.select(F.col("node").alias(side), F.col("label").alias(f"root_{side}"))
        roots = once.join(of("a"), "a").join(of("b"), "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        once = stored(roots.where("a <> b").distinct(), "edges")
        if not once.limit(1).count():
            return labels


def components(df: DataFrame, shingle: int = 3, radius: int = 3, tile_size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (the smallest id that links reach)."""
    fps = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    labels = connected(links(fps, radius, tile_size))
    own = fps.groupBy("fp").agg(F.min("id").alias("first_id"))
    rooted = own.join(labels.select(F.col("node").alias("fp"), F.col("label").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(first, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_WIDE = 4
_NAMES = [f"w{k}" for k in range(_WIDE)]
#: Odd multipliers that make three more hashes of a shingle's hash.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: A band holds four minima: of two sets of similarity 0.8 one of 20 bands is equal but for 27 pairs in a million.
_BANDS, _BAND_ROWS = 20, 4
_XOR, _ODD = np.random.default_rng(7).integers(0, 1 << 63, (2, _BANDS * _BAND_ROWS), np.uint64)
_ODD = 2 * _ODD + np.uint64(1)
#: Sets below this size have more bits apart than the law of large sets says.
_FEW = 16


def distinct_shingles(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row."""
    ends = np.cumsum(n)
    return [np.unique(hashes[b - k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]


def wide_fingerprints(distinct: np.ndarray, size: np.ndarray) -> np.ndarray:
    """256 bits over each row's distinct shingles, as four words."""
    words = [fingerprint_rows(distinct, size)]
    for odd in _MIX:
        mixed = distinct * np.uint64(odd)
        mixed ^= mixed >> np.uint64(29)
        words.append(fingerprint_rows(mixed * np.uint64(_MIX[0]), size))
    return np.stack(words, axis=1)


def band_keys(distinct: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key for each band of each row: equal for two rows if the band's minima over their shingles are."""
    out = np.zeros((len(size), _BANDS), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        begins = (np.cumsum(size) - size)[full]
        for band in range(_BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for k in range(band * _BAND_ROWS, (band + 1) * _BAND_ROWS):
                key = (key ^ np.minimum.reduceat((distinct ^ _XOR[k]) * _ODD[k], begins)) * np.uint64(_MIX[1])
                key ^= key >> np.uint64(31)
            out[full, band] = key
    return out


def _may_be_similar(bits, a, b, similarity: float, few, cos=np.cos, sqrt=np.sqrt, where=np.where):
    """Whether ``bits`` of difference allow that similarity: the estimate may fall 0.23 short of it, 0.4 where sets are small."""
    common = cos(bits * (np.pi / (64 * _WIDE))) * sqrt(a * b)
    return common >= (a + b - common) * where(few, similarity - 0.4, similarity - 0.23)


def candidates(left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose fingerprints and sizes allow that Jaccard similarity."""
    bits = np.zeros((len(left), len(right)), np.int64)
    for k in range(left.shape[1]):
        bits += np.bitwise_count(left[:, None, k] ^ right[None, :, k])
    a, b = left_size[:, None].astype(float), right_size[None, :].astype(float)
    return _may_be_similar(bits, a, b, similarity, np.minimum(a, b) < _FEW)


def _near_head(similarity: float) -> Column:
    """:func:`candidates` of a row and its head (``h_`` columns) as an expression."""
    bits = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"h_{k}"))) for k in _NAMES[1:]), F.bit_count(F.col("w0").bitwiseXOR(F.col("h_w0"))))
    a, b = F.col("size").cast("double"), F.col("h_size").cast("double")
    return _may_be_similar(bits, a, b, similarity, F.least(a, b) < _FEW, F.cos, F.sqrt, lambda few, x, y: F.when(few, x).otherwise(y))


def exact_forest(ids: np.ndarray, side: np.ndarray, label: np.ndarray, size: np.ndarray, words: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what exact Jaccard similarity of the candidates connects; of two sides only pairs across are compared.

    Members that share a ``label`` are connected already.
    """
    first = side == side.min()
    left = np.flatnonzero(first)
    right = left if first.all() else np.flatnonzero(~first)
    label, edges, strip = label.copy(), [], 256
    for a in range(0, len(left), strip):
        rows = left[a : a + strip]
        near = candidates(words[rows], words[right], size[rows], size[right], similarity)
        for i, own in zip(rows.tolist(), near, strict=True):
            other = right[own]
            other = other[(label[other] != label[i]) & (np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i]) - 1e-9)]
            for j in other.tolist():
                if label[j] == label[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common / (size[i] + size[j] - common) >= similarity:
                    edges.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
    return [(a, b) for a, b in edges if a != b]


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column).view(np.uint64)


def proposals(units: DataFrame, similarity: float, tile_size: int) -> DataFrame:
    """Edges (a, b) between ``node`` values of ``units`` that connect all pairs which share a band and may be that similar.

    In each band bucket every member is first compared with the smallest one, its head; that is linear, and members near the
    head need not be compared with each other. Only buckets with members that are not go on: those members are put into tiles
    and compared with all tiles of their bucket by exclusive-or and bit counts.
    """
    prints = units.select("node", "size", *_NAMES)
    banded = units.select("node", F.explode("bands").alias("band"))
    heads = stored(banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "band-heads")
    met = stored(banded.join(heads, "band").where("node <> head"), "band-members")
    pairs = met.select("node", "head").distinct().join(prints, "node").join(prints.select(F.col("node").alias("head"), *(F.col(k).alias(f"h_{k}") for k in ("size", *_NAMES))), "head")
    judged = stored(pairs.select("node", "head", _near_head(similarity).alias("near")), "near-heads")
    by_head = judged.where("near").select(F.col("head").alias("a"), F.col("node").alias("b"))
    flagged = stored(met.where("n > 2").select("band", "node", "head").join(judged, ["node", "head"]).select("band", "node", "near"), "band-flags")
    parts = lambda flag: F.ceil(F.count(F.when(flag, 1)) / tile_size).cast("int")
    open_bands = stored(flagged.groupBy("band").agg(parts(F.col("near")).alias("near_parts"), parts(~F.col("near")).alias("far_parts")).where("far_parts > 0"), "open-bands")
    dealt = flagged.join(open_bands, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("near_parts")).otherwise(F.col("far_parts"))).cast("int"))
    at = F.struct("band", "near", "part").alias("at")
    tiles = stored(dealt.join(prints, "node").groupBy(at).agg(F.collect_list(F.struct("node", "size", *_NAMES)).alias("fps")), "band-tiles")
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    side = lambda near, part: F.struct(F.col("band"), F.lit(near).alias("near"), part.alias("part"))
    across = open_bands.select("band", F.explode(every("far_parts")).alias("low"), "near_parts").select("band", "low", F.explode(every("near_parts")).alias("high"))
    own = open_bands.select("band", F.explode(every("far_parts")).alias("low"), "far_parts").select("band", "low", F.explode(every("far_parts")).alias("high")).where("low <= high")
    listed = across.select(side(False, F.col("low")).alias("low"), side(True, F.col("high")).alias("high")).union(own.select(side(False, F.col("low")).alias("low"), side(False, F.col("high")).alias("high")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, sides = [], []
            for column in batch.columns:
                node, size, *words = column.values.flatten()
                sides.append((column.offsets.to_numpy(), np.asarray(node), np.asarray(size), np.stack([_numbers(x) for x in words], axis=1)))
            for k in range(batch.num_rows):
                (left, left_size, left_words), (right, right_size, right_words) = ((n[o[k] : o[k + 1]], s[o[k] : o[k + 1]], w[o[k] : o[k + 1]]) for o, n, s, w in sides)
                edges += forest(left, right, lambda p, q, lw=left_words, rw=right_words, ls=left_size, rs=right_size: candidates(lw[p:q], rw, ls[p:q], rs, similarity))
            yield _id_edges(edges)

    return by_head.union(meeting(tiles, listed).mapInArrow(compare, "a bigint, b bigint"))


def decided(members: DataFrame, similarity: float, block_rows: int, block_shingles: int) -> DataFrame:
    """Edges (a, b) that connect, within each ``label``, all members whose exact Jaccard similarity is ``similarity`` or more.

    Every member is first compared with the head of its group, the member that the label names; that is linear in the group.
    Members that are not similar to it are dealt into blocks, which meet each other and the blocks of the others once.
    """
    heads = members.where("node = label").select("label", F.col("size").alias("h_size"), F.col("shingles").alias("h_shingles"))
    common = F.size(F.array_intersect("shingles", "h_shingles"))
    judged = stored(members.where("node <> label").join(heads, "label").select("label", "node", "size", (common / (F.col("size") + F.col("h_size") - common) >= similarity).alias("like")), "head-links")
    by_head = judged.where("like").select(F.col("label").alias("a"), F.col("node").alias("b"))
    count = lambda flag: F.ceil(F.greatest(F.count(F.when(flag, 1)) / block_rows, F.sum(F.when(flag, F.col("size")).otherwise(0)) / block_shingles)).cast("int")
    open_groups = judged.groupBy("label").agg(F.count("*").alias("n"), count(F.col("like")).alias("like_parts"), count(~F.col("like")).alias("other_parts")).where("other_parts > 0 and n > 1")
    dealt = judged.select("label", "node", "like").join(stored(open_groups.drop("n"), "open-groups"), "label")
    part = F.pmod(F.xxhash64("node"), F.when(F.col("like"), F.col("like_parts")).otherwise(F.col("other_parts"))).cast("int")
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda across, low, high: F.struct(F.lit(across).alias("across"), low.alias("low"), high.alias("high"))
    own = F.transform(every("other_parts"), lambda q: place(False, F.least("part", q), F.greatest("part", q)))
    to_like = F.transform(every("like_parts"), lambda q: place(True, F.col("part"), q))
    from_like = F.transform(every("other_parts"), lambda p: place(True, p, F.col("part")))
    dealt = dealt.withColumn("part", part).select("node", "like", "part", F.explode(F.when(F.col("like"), from_like).otherwise(F.concat(own, to_like))).alias("at"))
    rows = dealt.join(members, "node").groupBy("label", "at").agg(F.collect_list(F.struct("node", "like", "part", "size", *_NAMES, "shingles")).alias("rows")).where("size(rows) > 1").select("at.across", "at.low", "at.high", "rows")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, rows = [], batch.column("rows")
            ends, fields = rows.offsets.to_numpy(), rows.values.flatten()
            node, like, part, size = (np.asarray(x) for x in fields[:4])
            words = np.stack([_numbers(x) for x in fields[4:-1]], axis=1)
            at, hashes = fields[-1].offsets.to_numpy(), _numbers(fields[-1].values)
            for k, (across, low, high) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("across", "low", "high")), strict=True)):
                own = slice(ends[k], ends[k + 1])
                side = like[own] if across else part[own]
                if len(np.unique(side)) == 2 or not (across or low != high):
                    label = np.where(like[own], -1, np.arange(ends[k + 1] - ends[k]))
                    edges += exact_forest(node[own], side, label, size[own], words[own], [hashes[at[r] : at[r + 1]] for r in range(ends[k], ends[k + 1])], similarity)
            yield _id_edges(edges)

    return by_head.union(rows.mapInArrow(decide, "a bigint, b bigint"))


def keep_one(df: DataFrame, shingle: int = 5, similarity: float = 0.8, tile_size: int = 512, block_rows: int = 256, block_shingles: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` but for near copies: of each group linked by word-shingle similarity, the row with the smallest id stays.

    Two texts are linked if the Jaccard similarity of their sets of shingles (by 64-bit hash) is ``similarity`` or more. Pairs are
    proposed if they share one of 20 bands of minima and their 256-bit fingerprints allow the similarity (the estimate's
    standard error at 0.8 is 0.052, and it may fall 0.23 short), see :func:`proposals`; texts of proposed pairs are read again, and
    groups are decided by exact similarity, see :func:`decided`. The work grows with the number of texts and of proposed pairs.

    Ids may be of any type that has an order. Rows are told apart by id and text: of linked rows that repeat the smallest id, the one
    whose text has the smallest SHA-256 stays, and of rows that repeat both, one. Texts without words and rows with a null id stay. An
    empty table gives an empty result; other columns pass through unchanged, whatever their names.
    """
    docs = id_and_text(df, id_col, text_col).withColumn("sha", F.unhex(F.sha2("text", 256)))

    def sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        sets = distinct_shingles(*shingle_hashes(*buffer_of(batch.column("text")), shingle))
        return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64), sets

    def words_of(distinct: np.ndarray, size: np.ndarray) -> list[pa.Array]:
        words = wide_fingerprints(distinct, size).view(np.int64)
        return [pa.array(size), *(pa.array(words[:, k].copy()) for k in range(_WIDE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            distinct, size, sets = sets_of(batch)
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * _BANDS), pa.array(band_keys(distinct, size).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), *words_of(distinct, size), digests, bands], out.names)

    fields = "size bigint, " + ", ".join(f"{k} bigint" for k in _NAMES)
    out = schema_with_id(docs, f"sha binary, {fields}, digest binary, bands array<bigint>")
    prints = stored(docs.mapInArrow(run, out), "wide-fingerprints").where("size > 0 and id is not null")
    # equal sets are one unit
    key = ["size", "digest", *_NAMES]
    units = prints.groupBy(*key).agg(F.min(F.struct("id", "sha")).alias("least"), F.count("*").alias("n_rows"), F.first("bands").alias("bands"))
    units = stored(units.withColumn("node", F.monotonically_increasing_id()), "units")
    proposed = connected(proposals(units, similarity, tile_size))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            distinct, size, _ = sets_of(batch)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), *words_of(distinct, size), pa.ListArray.from_arrays(pa.array(ends), pa.array(distinct.view(np.int64)))], ["node", "label", "size", *_NAMES, "shingles"])

    named = stored(units.select("node", "least.id", "least.sha").join(proposed, "node"), "named")
    # texts that no proposed pair has are ruled out where they are
    asked = with_maybe(docs, F.xxhash64("id", "sha"), named.select(F.xxhash64("id", "sha"))).where("maybe").drop("maybe")
    texts = asked.join(named.hint("merge"), ["id", "sha"]).dropDuplicates(["id", "sha"]).select("node", "label", "text")
    members = stored(texts.mapInArrow(with_sets, f"node bigint, label bigint, {fields}, shingles array<bigint>"), "proposed")
    labels = connected(decided(members, similarity, block_rows, block_shingles))
    linked = units.join(labels, "node", "left").where("label is not null or n_rows > 1").select("label", "least", *key)
    best = stored(linked.where("label is not null").groupBy("label").agg(F.min("least").alias("best")), "stays")
    marks = prints.select("id", "sha", *key).join(linked.join(best, "label", "left").select(F.coalesce("best", "least").alias("best"), *key), key)
    marks = marks.groupBy("id", "sha").agg(F.bool_or((F.col("id") == F.col("best.id")) & (F.col("sha") == F.col("best.sha"))).alias("kept"), F.count("*").alias("n"))
    return without_copies(df, marks, id_col, F.unhex(F.sha2(text_of(text_col), 256)))


def _id_edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    edges = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])
