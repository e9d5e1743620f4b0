"""Whitening, the Jaccard join and collocations against plain versions."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwell.llm import collocations as co
from groundwell.llm import jaccard_join as jj
from groundwell.llm import whitening as wh
from groundwell.llm.queries import QUERIES
from groundwell.llm.shared import bitmap, may_hold

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# Shared


def test_a_bitmap_holds_what_it_was_made_of(spark):
    held = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = bitmap(held)
    own = held.toArrow().column("h").to_numpy().view(np.uint64)
    other = spark.range(5000, 10_000).select(F.xxhash64("id").alias("h")).toArrow().column("h").to_numpy().view(np.uint64)
    assert may_hold(bits, own).all()
    assert may_hold(bits, other).mean() < 0.2
    assert not may_hold(bitmap(held.limit(0)), own).any()


# Whitening


def plain_whitening(rows, components=4, scale=256):
    """By exact fractions for counts, deviations and the matrix, and a plain eigen-solve."""
    grid = [(k, tuple(int(np.floor(scale * float(c))) for c in v)) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in grid})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    out = {}
    for k, x in grid:
        off = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        for c, at in enumerate(order.tolist()):
            out.setdefault((k, c + 1), []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), off @ vectors[:, at] / np.sqrt(values[at]), values[at] / np.trace(cov)))
    return out


def same_whitening(found, wanted):
    assert len(found) == sum(map(len, wanted.values()))
    signs = defaultdict(set)
    for r in found:
        n, deviation, whitened, explained = wanted[r[0], r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(whitened), abs=1e-8)
        assert r.identity_error < 1e-9
        if abs(whitened) > 1e-6:
            signs[r.component].add(np.sign(whitened) == np.sign(r.whitened))
    assert all(len(x) == 1 for x in signs.values())


def test_op11_against_fractions(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").limit(60).collect()]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same_whitening(wh.whiten(few).collect(), plain_whitening([(k, [float(np.float32(c)) for c in v]) for k, v in rows]))
    whole = QUERIES["op11_whitening"](spark, data)
    assert dict(whole.dtypes)["deviation"] == "bigint"
    assert whole.count() == 4 * spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert whole.agg(F.max("identity_error")).first()[0] < 1e-9


def test_op11_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 7, -k / 3, (k * k % 11) / 5]) for k in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 1.0, 1.0]), (54, [inf, 1.0, 1.0]), (55, [1.0]), (56, [-0.0, 0.0, -0.001]), (None, good[3][1]), (3, good[3][1])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in good + odd], "vec_id long, embedding array<double>, n int, id string")
    kept = good + [odd[6], odd[7], odd[8]]
    found = wh.whiten(df).collect()
    same_whitening(found, plain_whitening(kept))
    assert {r.component for r in found} == {1, 2, 3}
    assert wh.whiten(df.limit(0)).collect() == []
    assert wh.whiten(df.where("vec_id >= 50 and vec_id < 55")).collect() == []
    alike = wh.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in alike] == [(None, None, None, 0)] * 6
    flat = wh.whiten(spark.createDataFrame([(k, [float(k), 2.0]) for k in range(3)], "vec_id long, embedding array<double>")).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True] * 3


def test_op11_large_values_are_exact(spark):
    rows = [(k, [1e14 + k, 3e14 - 2.5 * k * k]) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same_whitening(wh.whiten(df, components=1).collect(), plain_whitening(rows, 1))
    huge = wh.whiten(spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.n for r in huge} == {3}


def test_compensated_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5)) * np.array([1e8, 1.0, 1e-6, 1e3, 1.0])
    hi, lo = x, rng.normal(size=x.shape) * np.spacing(x) / 3
    total_hi = total_lo = np.zeros((5, 5))
    for p in wh.outer_products(hi, lo):
        total_hi, total_lo = wh.dd_add(total_hi, total_lo, p)
    rows = [[Fraction(a) + Fraction(b) for a, b in zip(r, s, strict=True)] for r, s in zip(hi.tolist(), lo.tolist(), strict=True)]
    for i, j in itertools.product(range(5), repeat=2):
        exact = sum(r[i] * r[j] for r in rows)
        scale = Fraction(float(np.abs(x[:, i]).max())) * Fraction(float(np.abs(x[:, j]).max()))
        assert abs(Fraction(float(total_hi[i, j])) + Fraction(float(total_lo[i, j])) - exact) <= scale * Fraction(1, 2**90)


# Jaccard join


def plain_join(rows, size=3, percent=90):
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for _, text in rows:
        w = words.findall((text or "").encode().translate(LOWER))
        sets.append({b" ".join(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    both = Counter(p for v in where.values() for p in itertools.combinations(v, 2))
    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            parent[root(a)] = root(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root(k)] = min(first.get(root(k), i), i)
    return sorted(((i, len(sets[k]), first.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def test_op12_against_all_pairs(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_jaccard_join"](spark, data)) == plain_join(rows)


@pytest.mark.parametrize("percent", [90, 75])
def test_op12_clouds_of_copies_through_every_path(spark, percent):
    """Groups around each threshold, in which pairs, windows, cells and blocks all decide."""
    rnd = random.Random(percent)
    rows = []
    for size in (2, 3, 11, 40, 160):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 4) for _ in range(size)]
        for _ in range(45):
            own = list(base)
            for _ in range(rnd.randrange(2 + size // 12)):
                own[rnd.randrange(size)] = f"w{rnd.randrange(300)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain_join(rows, 3, percent)
    assert len({r[2] for r in wanted}) < len(rows) - 20
    for options in ({}, {"block_rows": 4, "n_pivots": 3}, {"block_rows": 8, "n_pivots": 2, "block_shingles": 300}):
        assert rows_of(jj.components(df, percent=percent, **options)) == wanted


def test_op12_voronoi_cells_lose_no_pair(spark):
    """Two far clusters under one pivot: cells halve the work, and linked pairs stay together in one of them."""
    rnd = random.Random(8)
    rows, shared = [], [f"s{k}" for k in range(12)]
    for c in range(2):
        base = [f"c{c}x{k}" for k in range(60)]
        for _ in range(30):
            own = list(base)
            own[rnd.randrange(60)] = f"e{rnd.randrange(500)}"
            rows.append((len(rows), sorted(xx_hash(w) for w in set(own + shared))))
    sets = spark.createDataFrame([(k, len(s), s) for k, s in rows], "node long, size long, shingles array<bigint>")
    cells = sets.select(F.lit("r").alias("cell"), "node", F.lit(True).alias("home"), F.lit(0.5).alias("at"))
    split = jj.small_cells(cells, sets, 0.1, block_rows=8, n_pivots=4)
    together = {(a, b) for cell in by_cell(split).values() for a, home in cell for b, _ in cell if home and a != b}
    near = {(a, b) for (a, s), (b, t) in itertools.permutations(rows, 2) if 100 * len({*s} & {*t}) >= 90 * len({*s} | {*t})}
    assert near and all(p in together or p[::-1] in together for p in near)
    assert len(by_cell(split)) > 1


def xx_hash(word):
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 1


def by_cell(cells):
    out = defaultdict(list)
    for r in cells.collect():
        out[r.cell].append((r.node, r.home))
    return out


def test_op12_similar_sets_share_a_part():
    rng = np.random.default_rng(4)
    for percent in (60, 75, 80, 90, 95):
        for n in (1, 2, 5, 9, 10, 11, 19, 20, 50, 300):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            for drop in range(n):
                b = a[drop:]
                extra = rng.integers(0, 1 << 63, max(0, drop // 2), np.uint64)
                b = np.unique(np.concatenate([b, extra]))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both):
                    break
                keys, counts = jj.part_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), percent)
                assert {*keys[: counts[0]].tolist()} & {*keys[counts[0] :].tolist()}


def test_op12_awkward_rows(spark, odd, odd_texts, none):
    assert rows_of(jj.components(odd)) == plain_join(odd_texts)
    assert jj.components(none).collect() == []


# Collocations


def plain_collocations(rows, longest=3, least=10, share=50, most=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in phrases.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in phrases.items():
            if 100 * inside[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def test_op13_against_plain_counts(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect()]
    assert rows_of(QUERIES["op13_collocations"](spark, data)) == plain_collocations(rows)


@pytest.mark.parametrize("heavy", [4096, 10])
def test_op13_longer_phrases_heavy_prefixes_and_small_blocks(spark, monkeypatch, heavy):
    """Heavy prefixes are dealt over several tasks; batches and blocks cut runs."""
    rnd = random.Random(2)
    rows = [(" ".join(rnd.choice(["the the of", "a b c d e", "x", "the", "q r s!", "É é;", "of the\tend"]) for _ in range(rnd.randrange(60))), rnd.choice(["en", "de", None, "und"])) for _ in range(150)]
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(co, "_BLOCK", 300)
    monkeypatch.setattr(co, "_ROWS", 7)
    monkeypatch.setattr(co, "_BATCH", 3)
    monkeypatch.setattr(co, "_HEAVY", heavy)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for longest in (2, 3, 5):
            assert rows_of(co.collocations(df, longest=longest, least=4, most=30)) == plain_collocations(rows, longest, 4, 50, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op13_words_under_one_hash_change_the_seed(spark, monkeypatch):
    df = spark.createDataFrame([("one two " * 20, "en")], "text string, lang string")
    texts = co._texts(df, "text", "lang")
    clashing = spark.createDataFrame([(5, "en", "one", 20, True)], "h long, lang string, word string, n long, clash boolean")
    plain = co.word_counts
    monkeypatch.setattr(co, "word_counts", lambda t, least, seed: clashing if seed == 0 else plain(t, least, seed))
    assert co.verified_words(texts, 10)[1] == 1


def test_op13_awkward_rows(spark, odd_texts, none):
    df = spark.createDataFrame([(t, None, 1, 2, "p") for _, t in odd_texts], "text string, lang string, n int, a int, phrase string")
    assert rows_of(co.collocations(df)) == plain_collocations([(t, None) for _, t in odd_texts])
    assert co.collocations(none.selectExpr("text", "label AS lang")).collect() == []
    assert pa.types.is_string(co.collocations(df).limit(1).toArrow().schema.field("phrase").type)


def test_only_asked_sets_are_moved(spark):
    sets = spark.range(4000).selectExpr("id AS node", "3L AS size", "array(id, id + 1, id + 2) AS shingles")
    nodes = spark.range(0, 4000, 40).withColumnRenamed("id", "node")
    held = {r.node for r in jj.asked_sets(sets, nodes).collect()}
    assert held >= set(range(0, 4000, 40)) and len(held) < 400
    # 3,000 sets each meet one of five pivots: the pivots' side is as good as empty of others
    pairs = spark.range(5, 3005).selectExpr("id AS node", "id % 5 AS pivot")
    plan = jj.distances(pairs, sets, 90)
    assert plan.count() == 3000 and plan._jdf.queryExecution().optimizedPlan().toString().count("__word") > 0
