"""The stored keyword index and the vector lists find what a pass over everything finds."""

import random

import pytest
from pyspark.sql import functions as F

from groundwell.functions.text import tokens
from groundwell.operators import lexical, search
from groundwell.operators.stored_index import KeywordIndex
from groundwell.operators.vector_lists import VectorLists, recall


def rows(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())


def ranking(docs, asked, k, match_all):
    return rows(lexical.ranked(lexical.bm25(docs, asked, "id", tokens("text"), tokens("hint"), match_all=match_all), k).select("qid", "id", "score", "rank"))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    return [(k, " ".join(words[min(59, int(r.expovariate(0.08)))] for _ in range(r.choice((0, 3, 12, 40, 150))))) for k in range(600)]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w1"), (2, "w2 w3"), (3, "w40 w1"), (4, "w1 w2 w3 w5 w8"), (5, "nothing"), (6, ""), (7, "w59 w58"), (8, "w2 w2 w3")], "qid int, hint string")


def test_searches_of_the_index_are_those_of_the_texts(spark, tmp_path, texts, asked):
    docs = spark.createDataFrame(texts, "id long, text string")
    made = KeywordIndex(spark, f"file://{tmp_path}/kw", buckets=8, slice_docs=8)
    assert made.add(docs, "id", tokens("text")) == 1
    for match_all in (True, False):
        passes = made.passes(asked, tokens("hint"), 5, match_all, seeds=2)
        assert rows(passes.found.select("qid", "id", "score", "rank")) == ranking(docs, asked, 5, match_all)
        assert passes.skipped() > 0.05 or match_all
    assert rows(made.and_match(asked, tokens("hint"))) == rows(lexical.and_match(docs, asked.where("hint <> ''"), "id", tokens("text"), tokens("hint")))
    found = rows(made.phrase_match(asked, tokens("hint")))
    phrase = {q: h.split() for q, h in asked.collect()}
    wanted = []
    for q, p in phrase.items():
        for k, text in texts:
            w = text.split()
            times = sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1)) if p else 0
            wanted += [(q, k, times)] if times else []
    assert found == sorted(wanted)
    # only directories of asked terms are in the plan
    plan = made._asked_blocks("blocks", made._asked_buckets(asked.where("qid = 1").select(F.lit("w1").alias("term"))))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_changes_of_the_index(spark, tmp_path, texts, asked):
    docs = spark.createDataFrame(texts, "id long, text string")
    made = KeywordIndex(spark, f"file://{tmp_path}/kw", buckets=4, slice_docs=16)
    made.add(docs.where("id < 400"), "id", tokens("text"))
    made.add(docs.where("id >= 400"), "id", tokens("text"))
    made.remove(docs.where("id % 5 = 0").select("id"))
    made.remove(spark.createDataFrame([(5,), (10**9,)], "id long"))  # gone already, never there
    longer = docs.where("id % 7 = 1").withColumn("text", F.concat("text", F.lit(" w1 w1 w59")))
    made.add(longer, "id", tokens("text"))
    made.add(docs.where("id = 5"), "id", tokens("text"))  # back again
    made.add(docs.where("id = 6").withColumn("text", F.lit(None).cast("string")), "id", tokens("text"))
    now = docs.where("id % 5 <> 0 and id % 7 <> 1 and id <> 6").union(longer).union(docs.where("id = 5")).union(docs.where("id = 6").withColumn("text", F.lit("")))
    assert longer.where("id % 5 = 0").count() > 0  # removed ones among them are back too
    for _ in range(2):
        for match_all in (True, False):
            assert rows(made.search(asked, tokens("hint"), 6, match_all).select("qid", "id", "score", "rank")) == ranking(now, asked, 6, match_all)
        made.compact()
    assert made.table("gone").count() == 0 and made.live_docs().count() == now.count()
    with pytest.raises(OSError):
        made._versions.write(expected=2, docs=made.live_docs())


def test_no_posting_of_the_index_is_a_row(spark, tmp_path):
    """Texts that hold every asked word: what is shuffled follows the blocks of a term, not documents by queries by words."""
    words = [f"w{k}" for k in range(40)]
    docs = spark.range(3000).select("id", F.lit(" ".join(words)).alias("text"))
    made = KeywordIndex(spark, f"file://{tmp_path}/kw", buckets=4)
    status, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled(run):
        stages = lambda: (lambda seq: [seq.apply(k) for k in range(seq.size())])(status.stageList(None, False, False, none, None))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        before = {s.stageId() for s in stages()}
        out = run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return out, sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)

    assert shuffled(lambda: made.add(docs, "id", tokens("text")))[1] < 3 * 3000  # 120,000 postings
    asked = spark.range(30).select(F.struct("id").alias("qid"), F.lit(" ".join(words[:20])).alias("hint"))
    found, moved = shuffled(lambda: made.and_match(asked, tokens("hint")).count())
    assert found == 90_000 and moved < 60_000  # 1,800,000 postings
    found, moved = shuffled(lambda: rows(made.search(asked, tokens("hint"), 2, match_all=False).selectExpr("qid.id AS qid", "id", "rank")))
    assert found == [(q, r, r + 1) for q in range(30) for r in range(2)] and moved < 120_000
    found, moved = shuffled(lambda: made.phrase_match(asked, F.slice(tokens("hint"), 3, 4)).agg(F.count("*"), F.sum("times")).first())
    assert tuple(found) == (90_000, 90_000) and moved < 60_000


def test_an_index_of_nothing(spark, tmp_path, asked):
    made = KeywordIndex(spark, f"file://{tmp_path}/kw")
    with pytest.raises(ValueError):
        made.search(asked, tokens("hint"), 3)
    made.add(spark.createDataFrame([], "id string, text string"), "id", tokens("text"))
    assert made.search(asked, tokens("hint"), 3).collect() == []
    made.add(spark.createDataFrame([("a", "w1 w2"), ("b", None)], "id string, text string"), "id", tokens("text"))
    assert [(r.qid, r.id) for r in made.search(asked, tokens("hint"), 3).collect()] == [(1, "a")]


def test_vector_lists(spark, tmp_path):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    vectors = [(k, [x + r.gauss(0, 0.15) for x in centres[k % 15]]) for k in range(900)]
    vectors += [(900, None), (901, [0.0] * 12), (902, [1.0, 2.0]), (903, list(vectors[3][1])), (904, [float("nan")] + [1.0] * 11)]
    df = spark.createDataFrame(vectors, "id long, embedding array<double>")
    asked = spark.createDataFrame([(k, v) for k, v in vectors[:900:9]] + [(2000, None), (2001, [0.0] * 12)], "qid long, query_vector array<double>")
    lists = VectorLists(spark, f"file://{tmp_path}/lists")
    lists.build(df, "id", lists=15, block_rows=64)
    found, visited = lists.passes(asked, 7, probes=2, query_block=5)
    wanted = rows(search.vector_topk(df.where("id <> 904"), asked, 7, "id").select("qid", "id", "score", "rank"))
    assert rows(found.select("qid", "id", "score", "rank")) == wanted
    assert visited.count() < 0.5 * 15 * 100
    near = lists.search(asked.where("qid < 2000"), 7, probes=2, exact=False)
    assert recall(near, found.where("qid < 2000")) > 0.9
    assert lists.tuned_probes(asked, 7, 0.95) <= 6
    lists.build(df.limit(0), "id")
    assert lists.search(asked, 3).collect() == []


# The store in buckets, the growing cache, answers in batch


DOCS, CHUNKS = "doc_id string, source_uri string, allowed_depts array<string>, title string", "doc_id string, chunk_id string, chunk_index int, chunk_text string"


def files(spark, names, text="words of {}"):
    return spark.createDataFrame([(n, text.format(n).encode()) for n in names], "source_uri string, content binary")


def state(vault, version=None):
    docs, chunks = vault.read("documents", DOCS, version), vault.read("chunks", CHUNKS, version)
    return {(r.source_uri, tuple(r.allowed_depts), r.chunk_text) for r in docs.join(chunks, "doc_id", "left").collect()}


def test_changes_write_the_buckets_they_touch(spark, tmp_path):
    from groundwell.sources import bucketed, store

    vault = bucketed.BucketedStore(spark, f"file://{tmp_path}/vault", buckets=16)
    names = [f"n{k}.txt" for k in range(60)]
    assert vault.read("documents", DOCS).count() == 0
    assert store.ingest(files(spark, names), vault, ["all"]).where("status = 'ingested'").count() == 60
    first = vault.version()
    assert first.number == 1 and len(first.folders) == 16
    store.ingest(files(spark, names[:1], "other {}"), vault, ["net"])
    second = vault.version()
    changed = [b for b in second.folders if second.folders[b] != first.folders[b]]
    assert len(changed) == 1
    assert state(vault) == {(n, ("all",), f"words of {n}") for n in names[1:]} | {(names[0], ("net",), f"other {names[0]}")}
    assert state(vault, first) == {(n, ("all",), f"words of {n}") for n in names}
    # the same again changes rows of one bucket to what they were; an empty file keeps what it had
    store.ingest(files(spark, names[:1], "other {}"), vault, ["net"])
    before = vault.version()
    store.ingest(files(spark, names[3:4], " "), vault, ["net"])
    assert vault.version() == before and len(state(vault)) == 60
    # removal: documents and chunks go, unknown ones change nothing
    vault.remove(spark.createDataFrame([(names[1],), ("none",)], "source_uri string"), DOCS, CHUNKS)
    assert len(state(vault)) == 59 and not any(r[0] == names[1] for r in state(vault))
    after = vault.version()
    assert vault.remove(spark.createDataFrame([("none",)], "source_uri string"), DOCS, CHUNKS) == after
    vault.remove(spark.createDataFrame([(n,) for n in names], "source_uri string"), DOCS, CHUNKS)
    assert state(vault) == set() and vault.version().folders == {}
    assert vault.vacuum(1) > 0 and state(vault) == set() and vault.numbers() == [vault.version().number]


def test_writers_conflict_by_bucket(spark, tmp_path):
    from groundwell.sources import bucketed, store

    vault = bucketed.BucketedStore(spark, f"file://{tmp_path}/vault", buckets=8)
    store.ingest(files(spark, [f"n{k}.txt" for k in range(20)]), vault, ["all"])
    base = vault.version()
    assert vault._commit(base, {1: "x"}).number == 2
    with pytest.raises(bucketed.ConflictError):
        vault._commit(base, {1: "y", 2: "y"})
    made = vault._commit(base, {2: "z"})  # another bucket: on top of the newer version
    assert made.number == 3 and made.folders[1] == "x" and made.folders[2] == "z" and made.folders[3] == base.folders[3]
    with pytest.raises(PermissionError):
        store.ingest(files(spark, ["a.txt"]), bucketed.BucketedStore(spark, vault.path, buckets=8, protected=True), ["all"])


def test_a_build_with_one_new_page_writes_one_vector(spark, tmp_path):
    from groundwell.functions import vectors as vx
    from groundwell.operators import index
    from groundwell.sources.store import VersionedTable

    cache = VersionedTable(spark, f"file://{tmp_path}/cache")
    embed = lambda rows: rows.select("content_hash", vx.hash_embed("text").alias("embedding"))
    pages = spark.createDataFrame([(k, f"page {k}", ["e"]) for k in range(6)], "id int, summary string, entities array<string>")
    for n in (5, 6):
        assert index.build_index(pages.limit(n), cache, embed).where("embedding is null").count() == 0
    sizes = [spark.read.parquet(f"{tmp_path}/cache/v{v}/rows").count() for v in cache._versions()]
    assert sizes == [5, 1]
    assert cache.compact(index.CACHE, "content_hash", most=1) and cache.segments(index.CACHE).count() == 6
    (tmp_path / "cache" / f"v{cache._versions()[-1]}" / "rows" / "part-x.parquet").write_bytes(b"no parquet")
    assert index.read_cache(cache).count() == 0
    assert index.build_index(pages, cache, embed).where("embedding is null").count() == 0 and index.read_cache(cache).count() == 6


def test_answers_in_batch(spark):
    from groundwell.operators import fetch

    pages = spark.createDataFrame([("a", "A", True, [("raw/a", "h", None), ("", "h", None), ("raw/b", "h", "p. 2")]), ("b", "B", False, [("raw/b", "h", None)]), ("c", "C", True, []), ("d", "D", True, [("raw/gone", "h", None)]), ("e", "E", None, None)], "slug string, summary string, need boolean, sources array<struct<path: string, hint: string, loc: string>>")
    questions = spark.createDataFrame([(k,) for k in range(1, 9)], "qid int")
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (3, "c", 1), (4, "d", 1), (6, "a", 3), (7, "e", 1), (8, "unknown", 1)], "qid int, id string, rank int")
    seen = []

    def retrieve(addresses):
        seen.extend(r.path for r in addresses.collect())
        return addresses.where("path <> 'raw/gone'").select("ord", F.lit("c").alias("chunk_id"), F.concat(F.lit("text of "), "path").alias("text"), F.col("path").alias("file_path"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("loc"))

    got = {r.qid: r for r in fetch.answer_many(questions, found, pages, retrieve, F.col("need")).collect()}
    assert {q: r.status for q, r in got.items()} == {1: "with_sources", 2: "page_only", 3: "no_source", 4: "no_source", 5: "no_page", 6: "with_sources", 7: "page_only", 8: "no_page"}
    assert sorted(seen) == ["raw/a", "raw/a", "raw/b", "raw/b", "raw/gone"]  # nothing is retrieved for a page that suffices
    assert [(r.ord, r.path, r.status, [c.text for c in r.context], [c.loc for c in r.context]) for r in got[1].results] == [(0, "raw/a", "ok", ["text of raw/a"], [None]), (2, "raw/b", "ok", ["text of raw/b"], ["p. 2"])]
    assert got[2].results == [] and got[2].summary == "B" and got[5].slug is None and got[8].slug is None
    none = fetch.answer_many(questions.limit(0), found, pages, retrieve, F.col("need"))
    assert none.collect() == []


def test_the_index_in_parts_is_the_rendered_one(spark, tmp_path):
    from groundwell.operators import governance, index_parts

    r = random.Random(1)
    kinds = ["concept", "entity", "zebra", "apple pie", None]
    made = [(f"s{k}", r.choice(["Same", "Äther", f"Title {k % 37}", None]), r.choice(kinds), r.choice(["", " about it ", None]), f"p/{k % 190}.md") for k in range(200)]
    pages = spark.createDataFrame(made + [made[4], ("index", "I", "concept", "x", "index.md")], "slug string, title string, type string, summary string, rel string")
    clean = spark.createDataFrame([("warning", "a", "orphan", "")], "severity string, page string, rule string, detail string")
    path = f"file://{tmp_path}/index"
    assert index_parts.check_index(pages, path) == "missing"
    index_parts.write_index(pages, clean, path, lines_per_part=40)
    parts = index_parts.read_parts(spark, path).orderBy("part").collect()
    assert len(parts) > 3 and "".join(p.content for p in parts) == governance.render_index(pages).first().content
    assert index_parts.check_index(pages.repartition(3), path) == "ok"
    assert index_parts.check_index(pages.withColumn("summary", F.lit("new")), path) == "stale" and index_parts.check_index(pages.limit(100), path) == "stale"
    with pytest.raises(index_parts.LintError):
        index_parts.write_index(pages.limit(3), clean.union(spark.createDataFrame([("error", "s1", "tree", "log.md")], clean.schema)), path)
    assert index_parts.check_index(pages, path) == "ok"  # the refused one left no trace
    index_parts.write_index(pages.limit(0), clean, path)
    assert "".join(p.content for p in index_parts.read_parts(spark, path).collect()) == governance.render_index(pages.limit(0)).first().content


# What is small


def test_a_gateway_embeds_in_batches(spark):
    import http.server
    import json
    import threading

    from groundwell.functions import vectors as vx

    class Gateway(http.server.BaseHTTPRequestHandler):
        sizes: list = []

        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.sizes.append((len(asked["input"]), asked["model"], self.headers.get("Authorization")))
            rows = [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(asked["input"])]
            rows = rows[1:] if "lost" in asked["input"] else rows[::-1]
            body = json.dumps({"data": rows}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Gateway)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = vx.GatewayEmbedder(f"http://127.0.0.1:{server.server_port}/v1", "small", "k", batch=3)
    assert client(["a", "bb", "ccc", "dddd"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0], [4.0, 1.0]] and client([]) == []
    assert [x[:2] for x in Gateway.sizes] == [(3, "small"), (1, "small")] and Gateway.sizes[0][2] == "Bearer k"
    with pytest.raises(ValueError):
        client(["lost", "x"])
    df = spark.createDataFrame([("abc",), (None,)], "text string").coalesce(1)
    assert sorted((r.embedder_used, r.embedding[:2]) for r in vx.embed(df, "text", client, dims=4).collect()) == [("embedder", [0.0, 1.0]), ("embedder", [3.0, 1.0])]
    server.shutdown()
    server.server_close()
    assert {r.embedder_used for r in vx.embed(df, "text", client, dims=4).collect()} == {"characters"}


def test_log_counts_and_ranks(spark, tmp_path):
    from groundwell.functions.text import token_count
    from groundwell.functions import vectors as vx
    from groundwell.operators import governance

    heals = spark.createDataFrame([("a", "old", "new", "drift")], "slug string, old string, new string, trigger string")
    for at in ("one", "two"):
        governance.append_heal_log(heals, at, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["- [one] heal (drift): a: old -> new", "- [two] heal (drift): a: old -> new"]
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert sorted(r[0] for r in df.select(token_count("t", encode_batch=lambda texts: [t.split() for t in texts])).collect()) == [0, 2]
    texts = spark.createDataFrame([(1, "Ein Wort  ein\tWORT ß"), (2, ""), (3, None), (4, " x ")], "id int, text string")
    same = vx.hash_embedded(texts, F.col("text"), 32).withColumn("plain", vx.hash_embed(F.coalesce("text", F.lit("")), 32))
    assert all(r.embedding == r.plain for r in same.collect())
    rows = spark.range(40).select("id", F.array(F.cos(F.col("id") % 8), F.sin(F.col("id") % 8)).alias("embedding"))
    asked = rows.where("id < 12").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    targets = asked.select("qid", F.explode(F.array(F.lit(3).cast("bigint"), F.lit(17).cast("bigint"), F.col("qid"))).alias("id")).distinct()
    got = {(r.qid, r.id): r.v_rank for r in search.vector_ranks(rows, asked, targets, "id", block=5).collect()}
    every = {(r.qid, r.id): r["rank"] - 1 for r in search.vector_topk(rows, asked, 40, "id").collect()}
    assert len(got) == targets.count() and all(every[k] == v for k, v in got.items())
    down = {(r.qid, r.id): r.v_rank for r in search.vector_ranks(rows, asked, targets, "id", descending=True).collect()}
    turned = {(r.qid, -r.id): r["rank"] - 1 for r in search.vector_topk(rows.withColumn("id", -F.col("id")), asked, 40, "id").collect()}
    assert all(turned[k] == v for k, v in down.items()) and down != got


def test_table_files_are_read_by_ranges(spark, tmp_path):
    from groundwell.sources import large_tables, parse

    r = random.Random(9)
    cell = lambda: r.choice(["plain", "", "7", '"a, b"', '"two\nlines"', '"a ""quoted"" word"', '"\r\n,"', "é"])
    made = {
        "big.csv": "a,b,c\n" + "".join(",".join(cell() for _ in range(r.choice((2, 3, 3, 4)))) + r.choice(("\n", "\r\n")) for _ in range(700)),
        "tabs.TSV": "x\ty\n" + "".join(f'{k}\t"q\t{k}\n"\n' for k in range(45)),
        "head.csv": " only,head \n",
        "rows.csv": "h\n\n1\n\n2",
        "empty.csv": "",
        "other.txt": "no,table\n",
    }
    for name, text in made.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = large_tables.table_sections(spark, str(tmp_path)).collect()
        assert large_tables.records(spark, str(tmp_path / "big.csv")).agg(F.max("n")).first()[0] == 700
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(x.file.rsplit("/", 1)[1], x.section): (x.loc, x.text) for x in rows}
    wanted = {}
    for x in parse.parse(parse.scan_directory(spark, str(tmp_path)).where("source_uri not in ('other.txt', 'empty.csv')")).collect():
        wanted |= {(x.source_uri, k): (s.loc, s.text) for k, s in enumerate(x.sections)}
    assert got == wanted and len(got) > 36


def test_buckets_follow_the_store(spark, tmp_path):
    """A hundredth of the documents, changed, leaves some buckets as they are however large the store is."""
    from groundwell.sources import bucketed

    for n in (1_000, 51_282, 512_820):
        vault = bucketed.BucketedStore(spark, f"file://{tmp_path}/grown", buckets=bucketed.buckets_for(n))
        changed = spark.range(7, n, 100).select(F.sha2(F.concat(F.lit("raw/"), "id", F.lit(".bin")), 256).alias("doc_id"))
        touched = changed.select(vault.bucket()).distinct().count()
        assert touched <= min(vault.buckets - 1, changed.count())
