"""Vector search answers every query, however many there are."""

from pyspark.sql import functions as F

from groundwell.operators import search


def test_queries_beyond_one_block(spark):
    rows = spark.range(40).select("id", F.array(F.cos("id"), F.sin("id"), F.lit(0.1)).alias("embedding"))
    asked = spark.range(10_050).select(F.col("id").alias("qid"), F.array(F.cos("id"), F.sin("id"), F.lit(0.1)).alias("query_vector"))
    best = search.vector_topk(rows, asked, 1, "id")
    assert best.count() == best.select("qid").distinct().count() == 10_050
    few = asked.where("qid < 30")
    found = search.vector_topk(rows, few, 3, "id", block=4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.vector_topk(rows, few, 3, "id").collect()))
    assert {(r.qid, r.id) for r in found.where("rank = 1").collect()} == {(k, k) for k in range(30)}


def test_best_of_any_terms_equals_all_matches(spark):
    """The best rows kept by tasks are those of a ranking of all matches; only they are shuffled."""
    from groundwell.functions.text import tokens
    from groundwell.operators import lexical

    words = "alpha beta gamma delta eps zeta".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 6] for j in range(1, 2 + i % 7))) for i in range(300)], "doc_id int, text string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "zeta nowhere"), (3, "beta delta eps"), (4, "missing")], "qid int, hint string")
    found = lexical.bm25_best(docs, asked, "doc_id", tokens("text"), tokens("hint"), 5)
    whole = lexical.ranked(lexical.bm25(docs, asked, "doc_id", tokens("text"), tokens("hint"), match_all=False), 5)
    rows = lambda df: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(whole) and {r[0] for r in rows(found)} == {1, 2, 3}


def test_a_text_meets_queries_once_for_their_rarest_words(spark):
    """A long text is repeated for the rarest words of queries that it holds, not for each of its words."""
    from pyspark.sql import functions as F

    from groundwell.operators import lexical

    rows = spark.createDataFrame([(1, [f"w{i}" for i in range(500)]), (2, ["w1"])], "id int, words array<string>")
    keys = spark.createDataFrame([(7, "w1", [("w1",)]), (8, "x", [("x",)])], "qid int, term string, terms array<struct<term:string>>")
    met = lexical._meeting(rows, keys, ["term"], "words")
    assert sorted((r.id, r.qid) for r in met.select("id", "qid").collect()) == [(1, 7), (2, 7)]
    assert "array_intersect" in met._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_with_departments_are_judged_where_they_are(spark):
    from groundwell.operators.security import Scope, secured

    chunks = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, None)], "doc_id int, allowed_depts array<string>")
    seen = secured(chunks, chunks.select("doc_id", "allowed_depts"), Scope(frozenset({"a"})))
    assert [r.doc_id for r in seen.collect()] == [1]
    assert "Join" not in seen._jdf.queryExecution().optimizedPlan().toString()
