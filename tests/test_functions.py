"""Scalar expressions on literals."""

import hashlib
import math
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from groundwell.functions import text as tx
from groundwell.functions import vectors as vx
from groundwell.operators import lexical


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize("path", ["a/b", " a\\b ", "./a", "a/./b", "a//b/", "/a/b", "//a", "///a", "", ".", "..", "a/../b", "/", "a\\\\b", "\ta\n"])
def test_normalize_path(spark, path):
    assert one(spark, tx.normalize_path("p"), p=path) == PurePosixPath(path.strip().replace("\\", "/")).as_posix()


@pytest.mark.parametrize(("title", "slug"), [("Hello, World!", "hello-world"), ("--", "page"), ("", "page"), ("Été à la mer", "été-à-la-mer"), ("x" * 60, "x" * 40)])
def test_slugify(spark, title, slug):
    assert one(spark, tx.slugify("t"), t=title) == slug


def test_names(spark):
    assert one(spark, tx.title_case("t"), t="llm_slo report's x1y") == "llm_slo report's x1y".title()
    assert one(spark, tx.stem("p"), p="a/b.c.md") == "b.c" and one(spark, tx.suffix("p"), p="a/B.MD") == ".md"
    assert one(spark, tx.stem("p"), p="a/.env") == ".env" and one(spark, tx.suffix("p"), p="a/.env") == ""
    assert one(spark, tx.note_file_name("t"), t="My Note") == "my-note.md"


def test_links_and_terms(spark):
    links = one(spark, F.transform(tx.wikilinks("b"), tx.link_target), b="[[a]] [[b|B]] [[c#d]] [[ e ]] [x]")
    assert links == ["a", "b", "c", "e"]
    assert one(spark, tx.query_terms("q"), q='  "paged attention"  cache ') == ["paged", "attention", "cache"]
    assert one(spark, tx.snippet("t"), t="x" * 201) == "x" * 200 + "..." and one(spark, tx.snippet("t"), t="x" * 200) == "x" * 200


def test_maps_and_blocks(spark):
    assert one(spark, tx.string_map("j"), j='{"a": 1, "b": "x"}') == {"a": "1", "b": "x"} and one(spark, tx.string_map("j"), j="oops") == {}
    merged = tx.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert one(spark, merged) == {"a": "1", "b": "3"}
    assert one(spark, tx.source_block("p", "h", "l"), p="raw/x", h="hint", l="p. 3") == "  - path: raw/x\n    hint: hint\n    loc: p. 3\n"
    assert one(spark, tx.departments("d"), d="") is None and one(spark, tx.departments("d"), d="a,b") == ["a", "b"]
    assert one(spark, tx.contextual_text("h", "t"), h="", t="x") == "x" and one(spark, tx.contextual_text("h", "t"), h="h", t="x") == "h\n\nx"


@pytest.mark.parametrize(("a", "b", "expected"), [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0)])
def test_cosine(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(vx.cosine("a", "b")).first()[0] == pytest.approx(expected)


def test_embedders(spark):
    counts = [0.0] * 64
    for w in "the cat the Hat".lower().split():
        counts[int(hashlib.sha1(w.encode()).hexdigest(), 16) % 64] += 1
    assert one(spark, vx.hash_embed("t"), t="  the cat\nthe Hat ") == counts and one(spark, vx.hash_embed("t"), t="") == [0.0] * 64
    raw = [((ord(c) * 31 + k) % 100) / 100 for k, c in enumerate("né😀x")] + [0.0] * 4
    norm = math.sqrt(sum(x * x for x in raw))
    assert one(spark, vx.char_embed("t", 8), t="né😀x") == pytest.approx([x / norm for x in raw])
    assert one(spark, vx.char_embed("t", 4), t="") == [0.0] * 4


def test_embedder_fallback_is_visible(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string")

    def broken(texts):
        raise OSError

    assert {r.embedder_used for r in vx.embed(df, "t", broken, 4).collect()} == {"characters"}
    good = vx.embed(df, "t", lambda texts: [[1.0, 2.0] for _ in texts], 4).collect()
    assert all(r.embedding == [1.0, 2.0, 0.0, 0.0] and r.embedder_used == "embedder" for r in good)


def test_rrf(spark):
    assert one(spark, vx.rrf("r"), r=1) == 1 / 61
    both = vx.rrf(F.lit(0)) + vx.rrf(F.lit(1000))
    assert round(one(spark, both), 5) == 0.01761
    assert one(spark, vx.rrf(F.lit(None).cast("int"))) == 0.0


def test_lexemes_and_cover_rank(spark):
    assert one(spark, lexical.lexemes("t"), t="The caches are cached; passes, policies and running") == ["cache", "cach", "pass", "policy", "runn"]
    near = one(spark, lexical.cover_rank(F.array(F.lit(1)), F.array(F.lit(2))))
    far = one(spark, lexical.cover_rank(F.array(F.lit(1)), F.array(F.lit(20))))
    assert 0 < far < near < 0.1


def test_rate_beyond_ten_digits(spark):
    rows = spark.createDataFrame([(1, 1490, 0.01), (2, 5, 0.0), (3, 1490, 1e-9), (4, 5, float("nan")), (5, 7, 5e-324)], "id int, n bigint, ms double")
    found = {r.id: r.rate for r in rows.select("id", tx.tokens_per_second(F.col("n"), F.col("ms")).cast("double").alias("rate")).collect()}
    assert found == {1: 149000000.0, 2: 0.0, 3: 1.49e15, 4: None, 5: None}
