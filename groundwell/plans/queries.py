"""Registered queries over the driver's tables, each beside the SQL that must give the same rows.

Documents play the raw corpus (path from source and id, departments from language and source), ``benchmark`` the hints, ``pages`` the
curated pages (slug and title from the HTML, links from its anchors), ``embeddings`` the vectors, ``events`` telemetry and hooks.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import text as tx
from groundwell.functions import vectors as vx
from groundwell.operators import chunking, evaluation, fetch, governance, index, index_parts, lexical, search, security
from groundwell.operators.stored_index import KeywordIndex
from groundwell.operators.vector_lists import VectorLists, recall
from groundwell.sources import bucketed, parse, store
from groundwell.sources.tables import read_table, shared_folder, stored
from groundwell.streaming import changes
from groundwell.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "events": "event_id", "benchmark": "item_id", "labels": "doc_id"}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", _KEYS[name])


_BUILT: dict = {}


def _once(spark: SparkSession, sf: str, table: str, kind: str, build):
    """What ``build`` stores for a table, once for each application and state of its files; later queries read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{table}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [path] if files.getFileStatus(path).isFile() else [x.getPath() for x in files.listStatus(path)]
    state = tuple(sorted((f.toString(), files.getFileStatus(f).getModificationTime(), files.getFileStatus(f).getLen()) for f in listed))
    key = (spark.sparkContext.applicationId, kind, state)
    if key not in _BUILT:
        _BUILT[key] = build(shared_folder(spark, kind))
    return _BUILT[key]


def _keyword_index(spark: SparkSession, sf: str) -> KeywordIndex:
    """The stored keyword index of the documents."""

    def build(path: str) -> KeywordIndex:
        made = KeywordIndex(spark, path, buckets=16)
        made.add(_t(spark, sf, "documents"), "doc_id", _words())
        return made

    return _once(spark, sf, "documents", "keyword-index", build)


def _vector_lists(spark: SparkSession, sf: str) -> VectorLists:
    """The stored lists of the vectors."""

    def build(path: str) -> VectorLists:
        made = VectorLists(spark, path)
        made.build(_t(spark, sf, "embeddings"), "vec_id")
        return made

    return _once(spark, sf, "embeddings", "vector-lists", build)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    depts = F.when(F.col("lang") == "en", F.array("lang", "source", F.lit("all"))).otherwise(F.array("lang", "source"))
    return docs.select("doc_id", "text", "lang", "source", F.concat(F.lit("raw/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("source_uri"), F.col("source").alias("title"), depts.alias("allowed_depts"))


_CORPUS = """corpus AS (SELECT doc_id, text, lang, source, 'raw/' || source || '/' || doc_id || '.txt' AS source_uri, source AS title,
  CASE WHEN lang = 'en' THEN [lang, source, 'all'] ELSE [lang, source] END AS allowed_depts FROM documents)"""


def hints(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("hint"))


def wiki(spark: SparkSession, sf: str) -> DataFrame:
    """Every page: its slug is the first word of its title (``page`` without one), with the page's id behind it but for the first page of a word."""
    pages = _t(spark, sf, "pages").select("page_id", "url", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))
    word = F.lower(F.split_part(F.trim("title"), F.lit(" "), F.lit(1)))
    pages = pages.withColumn("word", F.when(word == "", "page").otherwise(word))
    first = pages.groupBy("word").agg(F.min("page_id").alias("page_id")).select("page_id", F.lit(True).alias("first"))
    slug = F.when(F.col("first"), F.col("word")).otherwise(F.concat_ws("-", "word", "page_id"))
    # four known kinds, one unknown, and pages without a kind
    kind = F.element_at(F.array(*map(F.lit, ("concept", "technique", "zone", "entity", "playbook"))), F.col("page_id").cast("int") % 6 + 1)
    rows = pages.join(first, "page_id", "left").select("page_id", slug.alias("slug"), "title", F.when(F.col("page_id") % 6 < 5, kind).alias("type"), "lang", "url", "html")
    body = F.regexp_replace("html", '<a href="/([^"]*)">', "[[$1]]")
    return rows.select("page_id", "slug", "title", "type", "lang", "url", F.concat(F.lit("wiki/"), "slug", F.lit(".md")).alias("rel"), F.lower(body).alias("body"))


_WIKI = r"""p0 AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages),
p1 AS (SELECT *, CASE WHEN lower(split_part(trim(title), ' ', 1)) = '' THEN 'page' ELSE lower(split_part(trim(title), ' ', 1)) END AS word FROM p0),
p2 AS (SELECT *, CASE WHEN page_id = min(page_id) OVER (PARTITION BY word) THEN word ELSE word || '-' || page_id END AS slug FROM p1),
wiki AS (SELECT page_id, slug, title, CASE WHEN page_id % 6 < 5 THEN ['concept', 'technique', 'zone', 'entity', 'playbook'][page_id % 6 + 1] END AS type, lang, url, 'wiki/' || slug || '.md' AS rel, lower(regexp_replace(html, '<a href="/([^"]*)">', '[[\1]]', 'g')) AS body FROM p2),
links AS (SELECT slug AS src, trim(split_part(split_part(l, '|', 1), '#', 1)) AS dst FROM (SELECT slug, unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)) AS l FROM wiki))"""


# Scalars


@query(r"""WITH x AS (SELECT page_id, ' .\' || replace(replace(url, '//', '//./'), '/', '\') || '\ ' AS p FROM pages)
SELECT page_id, array_to_string(list_filter(string_split(replace(trim(p), '\', '/'), '/'), lambda q: q <> '' AND q <> '.'), '/') AS path FROM x""")
def normalize_path(spark, sf):
    raw = F.concat(F.lit(" .\\"), F.translate(F.replace("url", F.lit("//"), F.lit("//./")), "/", "\\"), F.lit("\\ "))
    return _t(spark, sf, "pages").select("page_id", tx.normalize_path(raw).alias("path"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'page' ELSE s END AS slug FROM (SELECT page_id, left(trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\p{L}\p{N}]+', '-', 'g'), '-'), 40) AS s FROM pages)""")
def slugify_titles(spark, sf):
    return _t(spark, sf, "pages").select("page_id", tx.slugify(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("SELECT item_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet, '  - path: raw/' || item_id || '.txt' || chr(10) || '    hint: ' || text || chr(10) AS block FROM benchmark")
def snippets_and_blocks(spark, sf):
    path = F.concat(F.lit("raw/"), "item_id", F.lit(".txt"))
    return _t(spark, sf, "benchmark").select("item_id", tx.snippet("text").alias("snippet"), tx.source_block(path, "text", F.lit("")).alias("block"))


@query("SELECT doc_id, '[Document: ' || source || ' | Source: raw/' || source || '/' || doc_id || '.txt | Context: ' || lang || ']' AS header FROM documents")
def context_header(spark, sf):
    return corpus(spark, sf).select("doc_id", tx.context_header("title", "source_uri", "lang").alias("header"))


@query("SELECT item_id, sha256(text || '::' || array_to_string(list_sort(string_split(text, ' ')), ',')) AS content_hash FROM benchmark")
def content_hash(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", tx.content_hash("text", F.split("text", " ")).alias("content_hash"))


@query("SELECT event_id, len(json_keys(props)) AS n_keys, json_extract_string(props, '$.k') AS k FROM events")
def json_map(spark, sf):
    found = tx.string_map("props")
    return _t(spark, sf, "events").select("event_id", F.size(found).cast("bigint").alias("n_keys"), found["k"].alias("k"))


@query("SELECT event_id, (CASE WHEN value > 0 THEN round(user_id / (value / 1000), 2) ELSE 0 END)::DECIMAL(10, 2)::DOUBLE AS tokens_per_sec FROM events")
def telemetry_generated(spark, sf):
    rate = tx.tokens_per_second(F.col("user_id"), F.col("value"))
    return _t(spark, sf, "events").select("event_id", rate.cast("double").alias("tokens_per_sec"))


# Vectors


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS t FROM documents)
SELECT doc_id, ('0x' || right(sha1(t), 3))::INT % 64 AS bucket, count(*) AS n FROM w GROUP BY 1, 2""")
def hash_embed(spark, sf):
    made = vx.hash_embedded(_t(spark, sf, "documents"), F.col("text"), keep=["doc_id"])
    counts = made.select("doc_id", F.posexplode("embedding").alias("bucket", "n"))
    return counts.where("n > 0").select("doc_id", "bucket", F.col("n").cast("bigint").alias("n"))


@query("""WITH v AS (SELECT item_id, [((unicode(substr(text, i + 1, 1)) * 31 + i) % 100) / 100.0 for i in range(0, least(length(text), 1024))] AS a FROM benchmark)
SELECT item_id, round(list_sum([a[i] * i for i in range(1, len(a) + 1)]) / sqrt(list_sum([x * x for x in a])), 4) AS weighted FROM v""")
def char_embed(spark, sf):
    vectors = _t(spark, sf, "benchmark").select("item_id", F.posexplode(vx.char_embed("text")).alias("i", "x"))
    return vectors.groupBy("item_id").agg(F.round(F.sum(F.col("x") * (F.col("i") + 1)), 4).alias("weighted"))


@query("SELECT vec_id, list_concat(list_transform(embedding, lambda x: x::DOUBLE), list_transform(range(8), lambda x: 0.0::DOUBLE)) AS padded, list_transform(embedding, lambda x: x::DOUBLE)[1:48] AS cut FROM embeddings")
def vector_fit(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", vx.fit("embedding", 72).alias("padded"), vx.fit("embedding", 48).alias("cut"))


_TOPK = """scored AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
topk AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM scored QUALIFY rank <= 10)"""


def _vector_hits(spark, sf, k=10):
    vectors = _t(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    return search.vector_topk(vectors, asked, k, "vec_id")


@query(f"WITH {_TOPK} SELECT qid, id, round(s, 6) AS score, rank FROM topk")
def cosine_topk(spark, sf):
    return _vector_hits(spark, sf).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_TOPK} SELECT qid, id, round(s, 6) AS score, rank FROM topk")
def vector_lists_exact(spark, sf):
    """From the stored lists; lists that cannot hold anything nearer are left out."""
    vectors = _t(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    found = _vector_lists(spark, sf).search(asked, 10)
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_lists_recall(spark, sf):
    """The nearest lists alone, as many as were found to be needed: whether nine tenths of the exact ten are found."""
    vectors = _t(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    lists = _vector_lists(spark, sf)
    found = lists.search(asked, 10, lists.tuned_probes(vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector")), 10), exact=False)
    share = recall(found, _vector_hits(spark, sf))
    return asked.agg(F.count("*").alias("n_queries")).withColumn("reached", F.lit(share >= 0.9))


@query(f"""WITH {_TOPK}, r AS (SELECT q.vec_id AS qid, min(rank) FILTER (WHERE e.label = q.label AND e.vec_id <> q.vec_id) AS rank FROM embeddings q LEFT JOIN topk t ON t.qid = q.vec_id LEFT JOIN embeddings e ON e.vec_id = t.id WHERE q.vec_id % 50 = 0 GROUP BY 1)
SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r""")
def recall_and_mrr(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    own = _vector_hits(spark, sf).join(vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("found")), "id").join(asked, "qid")
    best = own.where("found = label and id <> qid").groupBy("qid").agg(F.min("rank").alias("rank"))
    return evaluation.recall_at(asked.select("qid").join(best, "qid", "left"))


# Chunks and access

_CHUNKS = r"""x AS (SELECT doc_id, lang, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
y AS (SELECT doc_id, lang, source, t, unnest(CASE WHEN length(t) <= 1500 THEN [0] ELSE range(0, length(t), 1300) END) AS start FROM x WHERE t <> ''),
chunks AS (SELECT doc_id, lang, source, start, regexp_replace(substr(t, start + 1, 1500), '^\s+|\s+$', '', 'g') AS chunk_text FROM y WHERE regexp_replace(substr(t, start + 1, 1500), '^\s+|\s+$', '', 'g') <> '')"""


def _chunks(spark, sf):
    return chunking.windows(corpus(spark, sf), "text")


@query(f"WITH {_CHUNKS} SELECT doc_id, start, chunk_text FROM chunks")
def chunk_windows(spark, sf):
    return _chunks(spark, sf).select("doc_id", F.col("start").cast("bigint").alias("start"), "chunk_text")


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks_count FROM chunks GROUP BY 1")
def chunk_counts(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("chunks_count"))


_NUMBERED = """numbered AS (SELECT sha256('raw/' || source || '/' || doc_id || '.txt') || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1) AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index,
  doc_id, 'raw/' || source || '/' || doc_id || '.txt' AS source_uri, lang, source, '[Document: ' || source || ' | Source: raw/' || source || '/' || doc_id || '.txt | Context: ' || lang || ']' AS context_prefix, chunk_text FROM chunks)"""


def _located_chunks(spark, sf, docs=None):
    docs = (corpus(spark, sf) if docs is None else docs).select("source_uri", "title", "allowed_depts", F.array(F.struct(F.col("lang").alias("loc"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))).alias("sections"))
    return chunking.chunk_documents(docs)


@query(f"WITH {_CHUNKS}, {_NUMBERED} SELECT chunk_id, chunk_index, source_uri, context_prefix, chunk_text, lang AS loc, sha256(context_prefix || chr(10) || chr(10) || chunk_text) AS contextual_sha256 FROM numbered")
def contextual_chunks(spark, sf):
    return _located_chunks(spark, sf).select("chunk_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "source_uri", "context_prefix", "chunk_text", "loc", F.sha2("contextual_text", 256).alias("contextual_sha256"))


@query(f"WITH {_CHUNKS}, {_CORPUS} SELECT c.doc_id, c.start FROM chunks c JOIN corpus d USING (doc_id) WHERE list_has_any(d.allowed_depts, ['de', 'src1'])")
def rls_visible(spark, sf):
    scope = security.Scope(frozenset({"de"}), team="src1")
    return security.secured(_chunks(spark, sf), corpus(spark, sf), scope).select("doc_id", F.col("start").cast("bigint").alias("start"))


@query("SELECT doc_id FROM documents WHERE false")
def rls_denied_empty(spark, sf):
    docs = corpus(spark, sf)
    return security.secured(docs.select("doc_id"), docs, None).union(security.secured(docs.select("doc_id"), docs, security.Scope()))


# Keywords

_WORDS = r"""dw AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
dl AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS len FROM documents),
qt AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
qn AS (SELECT qid, count(*) AS n_terms FROM qt GROUP BY 1),
tf AS (SELECT id, term, count(*) AS tf FROM dw WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), cn AS (SELECT count(*) AS n, avg(len) AS avg_len FROM dl),
bm AS (SELECT qid, id, count(*) AS matched, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))) AS s
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), cn GROUP BY 1, 2),
am AS (SELECT qid, id, s FROM bm JOIN qn USING (qid) WHERE matched = n_terms)"""


def _words(column="text"):
    return tx.tokens(column)


@query(f"WITH {_WORDS}, r AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 10) SELECT qid, id, round(s, 6) AS score, rank FROM r")
def bm25_topk(spark, sf):
    found = lexical.bm25_best(_t(spark, sf, "documents"), hints(spark, sf), "doc_id", _words(), _words("hint"), 10)
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_WORDS}, r AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 10) SELECT qid, id, round(s, 6) AS score, rank FROM r")
def indexed_bm25(spark, sf):
    """From the stored index, with early ending."""
    found = _keyword_index(spark, sf).search(hints(spark, sf), _words("hint"), 10, match_all=False)
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_WORDS}, r AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM am QUALIFY rank <= 10) SELECT qid, id, round(s, 6) AS score, rank FROM r")
def indexed_bm25_all(spark, sf):
    """Matches of every word, from the stored index."""
    found = _keyword_index(spark, sf).search(hints(spark, sf), _words("hint"), 10)
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_WORDS} SELECT qid, id FROM am")
def and_match(spark, sf):
    return lexical.and_match(_t(spark, sf, "documents"), hints(spark, sf), "doc_id", _words(), _words("hint"))


@query(f"WITH {_WORDS} SELECT qid, id FROM am")
def indexed_and_match(spark, sf):
    return _keyword_index(spark, sf).and_match(hints(spark, sf), _words("hint"))


@query(r"""WITH q AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:4] AS w FROM benchmark), d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d), h AS (SELECT id, w[i] AS a, w[i:i + 3] AS p FROM g)
SELECT qid, id, count(*) AS times FROM q JOIN h ON h.a = q.w[1] AND h.p[1:len(q.w)] = q.w GROUP BY 1, 2""")
def phrase_places(spark, sf):
    """Documents in which the first four words of a hint stand one after another, by the places in the index."""
    return _keyword_index(spark, sf).phrase_match(hints(spark, sf), F.slice(_words("hint"), 1, 4))


_CHANGED = r"""now AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 10 <> 1 UNION ALL SELECT doc_id, text || ' ' || (SELECT min(text) FROM benchmark) FROM documents WHERE doc_id % 10 = 1),
dw AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM now), dl AS (SELECT id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS len FROM now)"""


@query(f"WITH {_CHANGED}, {_WORDS[_WORDS.index("qt AS"):]}, r AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 10) SELECT qid, id, round(s, 6) AS score, rank FROM r")
def index_after_changes(spark, sf):
    """The index after a seventh of the documents is removed and a tenth is replaced by longer texts, made one again at last."""
    docs = _t(spark, sf, "documents")
    made = KeywordIndex(spark, shared_folder(spark, "changed-index"))
    made.add(docs, "doc_id", _words())
    made.remove(docs.where("doc_id % 7 = 3").select(F.col("doc_id").alias("id")))
    more = hints(spark, sf).agg(F.min("hint").alias("hint"))
    made.add(docs.where("doc_id % 10 = 1").crossJoin(F.broadcast(more)).withColumn("text", F.concat_ws(" ", "text", "hint")), "doc_id", _words())  # one row
    made.compact()
    found = made.search(hints(spark, sf), _words("hint"), 10, match_all=False)
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_WORDS}, o AS (SELECT qid, id, count(*) AS s FROM qt JOIN tf USING (term) GROUP BY 1, 2), r AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM o QUALIFY rank <= 10) SELECT qid, id, s::DOUBLE AS score, rank FROM r""")
def overlap_topk(spark, sf):
    found = search.overlap_search(_t(spark, sf, "documents"), hints(spark, sf), 10, "doc_id", _words(), _words("hint"))
    return found.select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


# Hybrid search and what stands on it

_EMBED = r"""hd AS (SELECT doc_id AS id, ('0x' || right(sha1(t), 3))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS t FROM documents) GROUP BY 1, 2),
hq AS (SELECT item_id AS qid, ('0x' || right(sha1(t), 3))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS t FROM benchmark) GROUP BY 1, 2),
nd AS (SELECT id, sqrt(sum(n * n)) AS norm FROM hd GROUP BY 1), nq AS (SELECT qid, sqrt(sum(n * n)) AS norm FROM hq GROUP BY 1),
dots AS (SELECT hq.qid, hd.id, sum(hd.n * hq.n) AS dot FROM hd JOIN hq USING (b) GROUP BY 1, 2),
vs AS (SELECT q.item_id AS qid, d.doc_id AS id, coalesce(dot / (nd.norm * nq.norm), 0) AS s FROM benchmark q CROSS JOIN documents d LEFT JOIN dots ON dots.qid = q.item_id AND dots.id = d.doc_id LEFT JOIN nd ON nd.id = d.doc_id LEFT JOIN nq ON nq.qid = q.item_id),
vr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM vs QUALIFY rank <= 20),
tr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM am QUALIFY rank <= 20),
fu AS (SELECT coalesce(vr.qid, tr.qid) AS qid, coalesce(vr.id, tr.id) AS id, coalesce(1.0::DOUBLE / (60 + vr.rank), 0) + coalesce(1.0::DOUBLE / (60 + tr.rank), 0) AS s FROM vr FULL OUTER JOIN tr ON vr.qid = tr.qid AND vr.id = tr.id),
hy AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM fu QUALIFY rank <= 10)"""


def _hybrid(spark, sf, k=10):
    docs = _t(spark, sf, "documents")
    asked = hints(spark, sf).withColumn("query_vector", vx.hash_embed("hint"))
    vectors = vx.hash_embeddings(docs, "doc_id", F.col("text"))
    candidates = max(20, 2 * k)
    v = search.vector_topk(vectors, asked, candidates, "id")
    t = lexical.ranked(lexical.bm25(docs, asked, "doc_id", _words(), _words("hint")), candidates)
    return search.fuse(v, t, k)


@query(f"WITH {_WORDS}, {_EMBED} SELECT qid, id, round(s, 6) AS score, rank FROM hy")
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# Secured retrieval over chunks and what stands on it

_STOP = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)


def _stem_sql(t: str) -> str:
    rules = (("^(.{2,})sses$", "\\1ss"), ("^(.{2,})ies$", "\\1y"), ("^(.{3,})ing$", "\\1"), ("^(.{3,})ed$", "\\1"), ("^(.{2,}[^su])s$", "\\1"))
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN regexp_replace({t}, '{p}', '{by}')" for p, by in rules) + f" ELSE {t} END"


def _retrieval_sql(scope: tuple[str, ...], k: int, on: str = "true") -> str:
    """CTEs from ``asked`` (qid, hint, path) to ``hits`` (qid, id, s, rank, chunk_text, source_uri); ``on`` joins a query ``a`` with the chunks ``v`` it may meet."""
    names = ", ".join(f"'{x}'" for x in scope)
    bucket = "('0x' || right(sha1(t), 3))::INT % 64"
    return rf"""vis AS (SELECT n.* FROM numbered n JOIN corpus d USING (doc_id) WHERE list_has_any(d.allowed_depts, [{names}])),
hd AS (SELECT chunk_id, {bucket} AS b, count(*)::DOUBLE AS n FROM (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(context_prefix || chr(10) || chr(10) || chunk_text), '\s+'), lambda x: x <> '')) AS t FROM vis) GROUP BY 1, 2),
hq AS (SELECT qid, {bucket} AS b, count(*)::DOUBLE AS n FROM (SELECT qid, unnest(list_filter(string_split_regex(lower(hint), '\s+'), lambda x: x <> '')) AS t FROM asked) GROUP BY 1, 2),
nd AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM hd GROUP BY 1), nq AS (SELECT qid, sqrt(sum(n * n)) AS norm FROM hq GROUP BY 1),
dots AS (SELECT hq.qid, hd.chunk_id, sum(hd.n * hq.n) AS dot FROM hd JOIN hq USING (b) GROUP BY 1, 2),
vr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM (SELECT a.qid, v.chunk_id AS id, coalesce(dot / (nd.norm * nq.norm), 0) AS s FROM asked a JOIN vis v ON {on} LEFT JOIN dots ON dots.qid = a.qid AND dots.chunk_id = v.chunk_id LEFT JOIN nd ON nd.chunk_id = v.chunk_id LEFT JOIN nq ON nq.qid = a.qid WHERE trim(a.hint) <> '') QUALIFY rank <= {max(20, 2 * k)}),
lx AS (SELECT chunk_id, {_stem_sql('t')} AS term, pos FROM (SELECT chunk_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(context_prefix || ' ' || chunk_text), '[\p{{L}}\p{{N}}]+') AS w FROM vis)) WHERE t NOT IN ({_STOP})),
qx AS (SELECT DISTINCT qid, {_stem_sql('t')} AS term FROM (SELECT qid, unnest(regexp_extract_all(lower(hint), '[\p{{L}}\p{{N}}]+')) AS t FROM asked) WHERE t NOT IN ({_STOP})),
qc AS (SELECT qid, count(*) AS n_terms FROM qx GROUP BY 1),
mt AS (SELECT qx.qid, x.chunk_id, any_value(n_terms) AS n_terms FROM qx JOIN qc USING (qid) JOIN (SELECT DISTINCT chunk_id, term FROM lx) x USING (term) JOIN vis v ON v.chunk_id = x.chunk_id JOIN asked a ON a.qid = qx.qid AND {on} GROUP BY 1, 2 HAVING count(*) = any_value(n_terms)),
held AS (SELECT mt.qid, mt.chunk_id, mt.n_terms, lx.term, lx.pos, row_number() OVER (PARTITION BY mt.qid, mt.chunk_id, lx.term ORDER BY lx.pos) AS j FROM mt JOIN qx ON qx.qid = mt.qid JOIN lx ON lx.chunk_id = mt.chunk_id AND lx.term = qx.term),
rk AS (SELECT a.qid, a.chunk_id AS id, 1 - product(1 - 0.1 * sqrt(CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END)) AS s FROM held a JOIN held b ON b.qid = a.qid AND b.chunk_id = a.chunk_id AND b.term < a.term GROUP BY 1, 2
  UNION ALL SELECT qid, chunk_id, sum(0.1 / (j * j)) / 1.64493406685 FROM held WHERE n_terms = 1 GROUP BY 1, 2),
tr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM rk QUALIFY rank <= {max(20, 2 * k)}),
fu AS (SELECT coalesce(vr.qid, tr.qid) AS qid, coalesce(vr.id, tr.id) AS id, coalesce(1.0::DOUBLE / (60 + vr.rank), 0) + coalesce(1.0::DOUBLE / (60 + tr.rank), 0) AS s FROM vr FULL OUTER JOIN tr ON vr.qid = tr.qid AND vr.id = tr.id),
hits AS (SELECT f.qid, f.id, f.s, f.rank, v.chunk_text, v.source_uri FROM (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM fu QUALIFY rank <= {k}) f JOIN vis v ON v.chunk_id = f.id)"""


def _store(spark, sf, docs=None):
    """Chunks of documents with the departments of these, and the registry of all documents."""
    chunks = _located_chunks(spark, sf, docs).drop("contextual_text")
    docs = corpus(spark, sf).select(F.sha2("source_uri", 256).alias("doc_id"), "source_uri", "allowed_depts")
    return chunks, docs


def _embed(chunks):
    """Vectors of the chunks' text in its context."""
    return vx.hash_embedded(chunks, tx.contextual_text("context_prefix", "chunk_text"), keep=[c for c in ("chunk_id", "__path") if c in chunks.columns])


def _asked(queries):
    return queries.withColumn("query_vector", vx.hash_embed("hint"))


_SCOPE = ("all", "de", "src1")
_BASE = f"{_CHUNKS}, {_CORPUS}, {_NUMBERED}"


def _retrieve(spark, sf, asked, k, docs=None):
    """What a caller with the scope of :data:`_SCOPE` finds."""
    return search.retrieve(*_store(spark, sf, docs), _asked(asked), k, security.Scope(frozenset({"all", "de"}), team="src1"), embed=_embed)


@query(f"WITH {_BASE}, asked AS (SELECT item_id AS qid, text AS hint FROM benchmark), {_retrieval_sql(_SCOPE, 10)} SELECT qid, id AS chunk_id, round(s, 6) AS score, rank, source_uri AS file_path FROM hits")
def secured_hybrid(spark, sf):
    found = _retrieve(spark, sf, hints(spark, sf), 10)
    return found.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), "file_path")


#: The address of a hint: for even items the first document that holds all its words, for odd ones some other document; else a file that is not there.
_ADDRESS = """ad AS (SELECT item_id AS ord, text AS hint, coalesce((SELECT 'raw/' || source || '/' || doc_id || '.txt' FROM documents WHERE doc_id = CASE WHEN item_id % 2 = 0 THEN (SELECT min(id) FROM am WHERE qid = item_id) ELSE 3 * item_id END), 'raw/none/0.txt') AS path FROM benchmark)"""


def _addresses(spark, sf):
    asked, docs = hints(spark, sf), corpus(spark, sf)
    first = and_match(spark, sf).groupBy("qid").agg(F.min("id").alias("doc_id"))
    target = asked.join(first, "qid", "left").withColumn("doc_id", F.when(F.col("qid") % 2 == 0, F.col("doc_id")).otherwise(3 * F.col("qid")))
    named = target.join(docs.select("doc_id", F.col("source_uri").alias("path")), "doc_id", "left")
    return named.select(F.col("qid").alias("ord"), F.coalesce("path", F.lit("raw/none/0.txt")).alias("path"), "hint", F.lit(None).cast("string").alias("loc"))


_PATHED = f"WITH {_WORDS}, {_BASE}, {_ADDRESS}, asked AS (SELECT ord AS qid, hint, path FROM ad), {_retrieval_sql(_SCOPE, 10, 'a.path = v.source_uri')}"


@query(f"{_PATHED} SELECT ad.ord, ad.path, CASE WHEN count(h.id) > 0 THEN 'ok' ELSE 'no_source' END AS status, count(h.id) AS n_context, sha256(coalesce(string_agg(h.chunk_text, chr(10) ORDER BY round(h.s, 9) DESC, h.id), '')) AS context_sha256, max(round(h.s, 6)) AS best FROM ad LEFT JOIN hits h ON h.qid = ad.ord GROUP BY 1, 2")
def fetch_many(spark, sf):
    addresses = stored(_addresses(spark, sf), "addresses")
    named = corpus(spark, sf).join(addresses.select(F.col("path").alias("source_uri")), "source_uri", "left_semi")  # only addressed files are cut and embedded
    hits = _retrieve(spark, sf, addresses.withColumnRenamed("ord", "qid"), 10, named)
    found = fetch.fetch_many(addresses, hits.withColumnRenamed("qid", "ord"))
    return found.select("ord", "path", "status", F.size("context").cast("bigint").alias("n_context"), F.sha2(F.array_join("context.text", "\n"), 256).alias("context_sha256"), F.array_max("citations.score").alias("best"))


_FREE = f"WITH {_WORDS}, {_BASE}, {_ADDRESS}, asked AS (SELECT ord AS qid, hint, path FROM ad), {_retrieval_sql(('all',), 5)}, ve AS (SELECT ad.ord, ad.path, ad.hint, CASE WHEN count(h.id) = 0 THEN 'fail' WHEN bool_or(h.source_uri = ad.path) THEN 'pass' ELSE 'drift' END AS status, count(DISTINCT h.source_uri) AS n_files, list_sort(list(DISTINCT h.source_uri) FILTER (WHERE h.id IS NOT NULL)) AS files FROM ad LEFT JOIN hits h ON h.qid = ad.ord GROUP BY 1, 2, 3)"


@query(rf"""WITH {_WORDS}, {_CORPUS}, {_ADDRESS}, {_WIKI}, tk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM am QUALIFY rank <= 10),
a AS (SELECT ad.ord AS qid, w.slug, w.title AS summary, coalesce(w.type IN ('concept', 'technique', 'zone'), false) AS deep, ad.path FROM ad LEFT JOIN wiki w ON w.page_id = ad.ord AND ad.ord % 4 <> 0),
h AS (SELECT ad.ord AS qid, c.text FROM tk JOIN corpus c ON c.doc_id = tk.id JOIN ad ON ad.ord = tk.qid AND ad.path = c.source_uri)
SELECT a.qid, CASE WHEN slug IS NULL THEN 'no_page' WHEN NOT deep THEN 'page_only' WHEN h.qid IS NOT NULL THEN 'with_sources' ELSE 'no_source' END AS status, slug, summary, CASE WHEN slug IS NOT NULL AND deep THEN 1 ELSE 0 END AS n_results, CASE WHEN slug IS NOT NULL AND deep THEN sha256(h.text) END AS context_sha256 FROM a LEFT JOIN h USING (qid)""")
def two_layer_answers(spark, sf):
    """Every hint is a question; three in four have a page, and pages of half of the kinds do not suffice: their address is asked for."""
    addresses = stored(_addresses(spark, sf), "addresses")
    pages = wiki(spark, sf).join(addresses, F.col("page_id") == F.col("ord")).select("page_id", "slug", F.col("title").alias("summary"), "type", F.array(F.struct("path", "hint", "loc")).alias("sources"))
    found = pages.where("page_id % 4 <> 0").select(F.col("page_id").alias("qid"), F.col("slug").alias("id"), F.lit(1).alias("rank"))

    def retrieve(asked):
        best = _keyword_index(spark, sf).search(asked.select(F.col("ord").alias("qid"), "hint"), _words("hint"), 10)
        texts = corpus(spark, sf).select(F.col("doc_id").alias("id"), "text", F.col("source_uri").alias("file_path"))
        return best.join(texts, "id").select(F.col("qid").alias("ord"), F.col("id").cast("string").alias("chunk_id"), "text", "file_path", "score", F.lit(None).cast("string").alias("loc"))

    answers = fetch.answer_many(hints(spark, sf), found, pages.drop("page_id"), retrieve, F.col("type").isin("concept", "technique", "zone"))
    context = F.flatten(F.transform("results", lambda r: r["context"]["text"]))
    return answers.select("qid", "status", "slug", "summary", F.size("results").cast("bigint").alias("n_results"), F.when(F.size(context) > 0, F.sha2(F.array_join(context, "\n"), 256)).alias("context_sha256"))


def _everyone(chunks, docs):
    """Searches without a path for rows of ``ord`` and ``hint``, as verification asks for."""
    return lambda rows: search.retrieve(chunks, docs, _asked(rows.select(F.col("ord").alias("qid"), "hint")), 5, security.Scope(frozenset({"all"})), embed=_embed).withColumnRenamed("qid", "ord")


def _verified(spark, sf):
    addresses = stored(_addresses(spark, sf), "addresses")
    return governance.verify(addresses, _everyone(*_store(spark, sf))(addresses))


@query(f"{_FREE} SELECT ord, path, status, n_files, coalesce(array_to_string(files, ','), '') AS files FROM ve")
def verify_status(spark, sf):
    return _verified(spark, sf).select("ord", "path", "status", F.size("matched_files").cast("bigint").alias("n_files"), F.array_join("matched_files", ",").alias("files"))


@query(f"{_FREE} SELECT status, count(*) AS n FROM ve GROUP BY 1")
def verify_counts(spark, sf):
    return _verified(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_FREE}, f AS (SELECT path, min(ord) FILTER (WHERE status = 'pass') AS first FROM ve GROUP BY 1) SELECT c.path, max(CASE WHEN ord = first THEN hint END) AS hint, CASE WHEN min(first) IS NULL THEN 'no_hint_works' ELSE 'minted' END AS status, count(*) AS n_tried FROM ve c JOIN f USING (path) WHERE first IS NULL OR ord <= first GROUP BY 1")
def mint_first_pass(spark, sf):
    return governance.mint(_verified(spark, sf).select("path", "ord", "hint", "status")).select("path", "hint", "status", F.size("trail").cast("bigint").alias("n_tried"))


#: A page for each item: it names the next item's text as the hint of its own file, so most addresses are broken; every third title is of no use.
_HEAL_PAGES = """hp AS (SELECT 'item-' || ord AS slug, CASE WHEN ord % 3 = 0 THEN 'zzz qqq' ELSE hint END AS title, hint AS summary, path, lead(hint, 1, 'zzz') OVER (ORDER BY ord) AS old FROM ad),
ha AS (SELECT path, old, max(slug) AS slug FROM hp GROUP BY 1, 2),
hc AS (SELECT slug, unnest(range(len(l))) AS ord, unnest(l) AS hint FROM (SELECT slug, list_filter([title, left(summary, 50), summary], lambda x: trim(x) <> '') AS l FROM hp)),
asked AS (SELECT 'a' || path || old AS qid, old AS hint FROM ha UNION ALL SELECT 't' || ha.path || ha.old || hc.ord, hc.hint FROM ha JOIN hc USING (slug))"""


@query(f"WITH {_WORDS}, {_BASE}, {_ADDRESS}, {_HEAL_PAGES}, {_retrieval_sql(('all',), 5)}, ap AS (SELECT 'a' || path || old AS qid, path FROM ha UNION ALL SELECT 't' || path || old || ord, path FROM ha JOIN hc USING (slug)), st AS (SELECT ap.qid, count(h.id) AS n, coalesce(bool_or(h.source_uri = ap.path), false) AS own FROM ap LEFT JOIN hits h ON h.qid = ap.qid GROUP BY 1), good AS (SELECT slug, path, old, hint AS new, CASE WHEN sa.n = 0 THEN 'fail' ELSE 'drift' END AS trigger, row_number() OVER (PARTITION BY path, old ORDER BY hc.ord) AS nth FROM ha JOIN st sa ON sa.qid = 'a' || path || old JOIN hc USING (slug) JOIN st ct ON ct.qid = 't' || path || old || hc.ord WHERE NOT sa.own AND ct.own) SELECT slug, path, old, new, trigger FROM good WHERE nth = 1")
def verify_and_heal(spark, sf):
    addresses = stored(_addresses(spark, sf), "addresses")
    after = addresses.select((F.col("ord") - 1).alias("ord"), F.col("hint").alias("next"))
    rows = addresses.join(after, "ord", "left").withColumn("next", F.coalesce("next", F.lit("zzz")))
    pages = rows.select(F.concat(F.lit("item-"), "ord").alias("slug"), F.when(F.col("ord") % 3 == 0, "zzz qqq").otherwise(F.col("hint")).alias("title"), F.col("hint").alias("summary"), F.array().cast("array<string>").alias("entities"), F.array(F.struct("path", F.col("next").alias("hint"), F.lit(None).cast("string").alias("loc"))).alias("sources"))
    chunks, docs = _store(spark, sf)
    return governance.verify_and_heal(pages, _everyone(stored(chunks, "chunks"), docs)).select("slug", "path", "old", "new", "trigger")


@query(f"WITH {_BASE}, asked AS (SELECT item_id AS qid, text AS hint FROM benchmark), {_retrieval_sql(_SCOPE, 3)} SELECT h.qid AS item_id, bool_or(contains(h.chunk_text, b.text)) AS passed FROM hits h JOIN benchmark b ON b.item_id = h.qid GROUP BY 1")
def niah_any(spark, sf):
    asked = hints(spark, sf)
    return evaluation.needle_found(_retrieve(spark, sf, asked, 3).join(asked, "qid"), "text", "hint", "qid").withColumnRenamed("qid", "item_id")


@query(f"WITH {_WORDS}, {_EMBED}, m AS (SELECT qid, min(id) AS t, max(id) AS n FROM am GROUP BY 1), r AS (SELECT hy.qid, min(rank) FILTER (WHERE id = t) AS t, min(rank) FILTER (WHERE id = n) AS n FROM hy JOIN m USING (qid) GROUP BY 1) SELECT qid, coalesce(t < n OR (t IS NOT NULL AND n IS NULL), false) AS passed FROM r")
def hard_negative_order(spark, sf):
    ends = and_match(spark, sf).groupBy("qid").agg(F.min("id").alias("true_id"), F.max("id").alias("negative_id"))
    return evaluation.hard_negative(_hybrid(spark, sf).join(ends, "qid"), F.col("true_id"), F.col("negative_id"))


def _page_search_sql(asked: str) -> str:
    """Page search by title for ``asked`` (qid, hint): vector ranks over all pages, keyword ranks of those that hold every word and phrase."""
    return rf"""WITH {_WIKI}, asked AS ({asked}), dl AS (SELECT page_id AS id, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS w FROM wiki), cn AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM dl),
qt AS (SELECT qid, unnest(list_distinct(regexp_extract_all(lower(hint), '[\p{{L}}\p{{N}}]+'))) AS term FROM asked), qn AS (SELECT qid, count(*) AS n_terms FROM qt GROUP BY 1),
qp AS (SELECT qid, list_filter(list_transform(string_split_regex(trim(replace(replace(hint, chr(34), ''), chr(39), '')), '\s+'), lambda t: array_to_string(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), ' ')), lambda p: contains(p, ' ')) AS phrases FROM asked),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM dl) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT qid, id, count(*) AS matched, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / avg_len))) AS s FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), cn GROUP BY 1, 2),
am AS (SELECT bm.qid, bm.id, s FROM bm JOIN qn USING (qid) JOIN qp USING (qid) JOIN dl USING (id) WHERE matched = n_terms AND len(list_filter(phrases, lambda p: NOT contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' '))) = 0),
hd AS (SELECT page_id AS id, ('0x' || right(sha1(t), 3))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT page_id, unnest(list_filter(string_split_regex(lower(title), '\s+'), lambda x: x <> '')) AS t FROM wiki) GROUP BY 1, 2),
hq AS (SELECT qid, ('0x' || right(sha1(t), 3))::INT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT qid, unnest(list_filter(string_split_regex(lower(hint), '\s+'), lambda x: x <> '')) AS t FROM asked) GROUP BY 1, 2),
nd AS (SELECT id, sqrt(sum(n * n)) AS norm FROM hd GROUP BY 1), nq AS (SELECT qid, sqrt(sum(n * n)) AS norm FROM hq GROUP BY 1),
dots AS (SELECT hq.qid, hd.id, sum(hd.n * hq.n) AS dot FROM hd JOIN hq USING (b) GROUP BY 1, 2),
vr AS (SELECT q.qid, d.page_id AS id, row_number() OVER (PARTITION BY q.qid ORDER BY round(coalesce(dot / (nd.norm * nq.norm), 0), 9) DESC, d.page_id) - 1 AS rank FROM asked q CROSS JOIN wiki d LEFT JOIN dots ON dots.qid = q.qid AND dots.id = d.page_id LEFT JOIN nd ON nd.id = d.page_id LEFT JOIN nq ON nq.qid = q.qid),
tr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) - 1 AS rank FROM am QUALIFY rank < 50),
fu AS (SELECT vr.qid, vr.id, 1.0::DOUBLE / (60 + vr.rank) + 1.0::DOUBLE / (60 + coalesce(tr.rank, 1000)) AS s FROM vr LEFT JOIN tr ON vr.qid = tr.qid AND vr.id = tr.id),
r AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM fu QUALIFY rank <= 5) SELECT qid, id, round(s, 6) AS score, rank FROM r"""


def _page_search(pages, asked):
    pages = pages.withColumn("embedding", vx.hash_embed("title"))
    found = search.wiki_search(pages, _asked(asked), 5, "page_id", _words("title"), _words("hint"))
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_page_search_sql("SELECT item_id AS qid, text AS hint FROM benchmark"))
def wiki_rrf(spark, sf):
    return _page_search(wiki(spark, sf), hints(spark, sf))


@query(_page_search_sql("SELECT page_id AS qid, title AS hint FROM wiki WHERE page_id % 50 = 0"))
def page_search(spark, sf):
    pages = wiki(spark, sf)
    return _page_search(pages, pages.where("page_id % 50 = 0").select(F.col("page_id").alias("qid"), F.col("title").alias("hint")))


# Pages and links


@query(f"WITH {_WIKI} SELECT dst, count(*) AS n_links FROM links WHERE src <> dst GROUP BY 1")
def inbound_links(spark, sf):
    return governance.inbound(governance.edges(wiki(spark, sf)))


@query(f"WITH {_WIKI} SELECT DISTINCT src, dst FROM links WHERE dst NOT IN (SELECT slug FROM wiki)")
def unresolved_links(spark, sf):
    pages = wiki(spark, sf)
    return governance.unresolved(governance.edges(pages), pages)


@query(f"WITH {_WIKI} SELECT slug FROM wiki WHERE slug NOT IN ('index', 'archive', 'log') AND slug NOT IN (SELECT dst FROM links WHERE src <> dst)")
def orphan_pages(spark, sf):
    pages = wiki(spark, sf)
    return governance.orphans(governance.edges(pages), pages)


@query(f"WITH RECURSIVE {_WIKI}, st AS (SELECT min(slug) AS slug, 0 AS hops FROM wiki), walk AS (SELECT slug, hops FROM st UNION SELECT links.dst, walk.hops + 1 FROM walk JOIN links ON links.src = walk.slug WHERE walk.hops < 3) SELECT slug, min(hops) AS hops FROM walk GROUP BY 1")
def reachable_pages(spark, sf):
    pages = wiki(spark, sf)
    return governance.reachable(governance.edges(pages), pages.agg(F.min("slug").alias("slug")))


@query(f"WITH {_WIKI}, f AS (SELECT slug, unnest(CASE WHEN contains(body, '<h2') THEN ['summary', 'entities', 'department', 'sources', 'last_compiled'] ELSE ['entities', 'department', 'sources', 'last_compiled'] END) AS field FROM wiki) SELECT slug, field FROM f")
def lint_missing_fields(spark, sf):
    has = F.when(F.contains(F.col("body"), F.lit("<h2")), F.array(F.lit("type"), F.lit("title"))).otherwise(F.array(F.lit("type"), F.lit("title"), F.lit("summary")))
    return governance.missing_fields(wiki(spark, sf), has)


_PLACE = "CASE coalesce(type, 'concept') WHEN 'technique' THEN 1 WHEN 'playbook' THEN 2 WHEN 'concept' THEN 3 WHEN 'entity' THEN 4 ELSE 1000 END"
_HEADING = "CASE coalesce(type, 'concept') WHEN 'technique' THEN 'Techniques' WHEN 'playbook' THEN 'Playbooks' WHEN 'concept' THEN 'Concepts' WHEN 'entity' THEN 'Entities' ELSE upper(left(type, 1)) || lower(substr(type, 2)) END"
_INDEX = f"r AS (SELECT coalesce(type, 'concept') AS type, {_PLACE} AS place, {_HEADING} AS heading, title, rel, '- [' || title || '](' || rel || ') — ' || trim(url) AS line FROM wiki WHERE slug NOT IN ('index', 'archive', 'log'))"


@query(f"WITH {_WIKI}, {_INDEX} SELECT type, place, heading, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY lower(title), rel)) AS lines_sha256 FROM r GROUP BY 1, 2, 3")
def index_by_type(spark, sf):
    kinds = governance.by_kind(wiki(spark, sf).withColumn("summary", F.col("url")))
    return kinds.select("type", "place", "heading", "n", F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


@query(f"""WITH {_WIKI}, {_INDEX}, g AS (SELECT type, place, count(*) AS n, '## ' || heading || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY lower(title), rel) AS block FROM r GROUP BY type, place, heading)
SELECT '# Index' || chr(10) || chr(10) || '_' || sum(n) || ' pages_' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY place, type) || chr(10) AS content FROM g""")
def render_index(spark, sf):
    return governance.render_index(wiki(spark, sf).withColumn("summary", F.col("url")))


@query(f"WITH {_WIKI} SELECT entry FROM (VALUES ('index.md'), ('archive.md'), ('log.md'), ('techniques'), ('entities'), ('playbooks'), ('concepts')) AS t(entry) WHERE entry NOT IN (SELECT CASE type WHEN 'concept' THEN 'concepts' WHEN 'entity' THEN 'entities' ELSE slug || '.md' END FROM wiki)")
def lint_tree(spark, sf):
    there = F.when(F.col("type") == "concept", "concepts").when(F.col("type") == "entity", "entities").otherwise(F.concat("slug", F.lit(".md")))
    return governance.missing_entries(wiki(spark, sf).select(there.alias("entry")))


_LINT = """lp AS (SELECT *, list_concat(['type', 'title', 'summary', 'sources'], CASE WHEN page_id % 2 = 0 THEN ['entities', 'department', 'last_compiled'] ELSE ['related'] END) AS present,
  CASE page_id % 3 WHEN 0 THEN ['path', 'loc', 'hint'] WHEN 1 THEN ['path', 'hint'] ELSE ['loc'] END AS keys FROM wiki)"""


@query(f"""WITH {_WIKI}, {_LINT}
SELECT 'error' AS severity, slug AS page, 'missing_field' AS rule, field AS detail FROM (SELECT slug, unnest(list_filter(['type', 'title', 'summary', 'entities', 'department', 'sources', 'last_compiled'], lambda f: NOT list_contains(present, f))) AS field FROM lp)
UNION ALL SELECT 'error', slug, 'forbidden_field', 'related' FROM lp WHERE list_contains(present, 'related')
UNION ALL SELECT 'error', slug, 'source_field', '0.' || k FROM (SELECT slug, unnest(list_filter(['path', 'loc', 'hint'], lambda k: NOT list_contains(keys, k))) AS k FROM lp)
UNION ALL SELECT 'error', slug, 'source_file', 'raw/' || page_id FROM lp WHERE page_id % 4 = 3
UNION ALL SELECT DISTINCT 'warning', src, 'unresolved_link', dst FROM links WHERE dst NOT IN (SELECT slug FROM wiki)
UNION ALL SELECT 'warning', slug, 'orphan', '' FROM wiki WHERE slug NOT IN ('index', 'archive', 'log') AND slug NOT IN (SELECT dst FROM links WHERE src <> dst)
UNION ALL SELECT 'error', '', 'tree', entry FROM (VALUES ('archive.md'), ('log.md'), ('techniques'), ('entities'), ('playbooks')) AS t(entry)""")
def lint_report(spark, sf):
    """Half of the pages lack three fields and have a forbidden one; sources lack keys by thirds; a quarter of the files is missing, another one a placeholder."""
    names = lambda *xs: F.array(*map(F.lit, xs))
    even, third, path = F.col("page_id") % 2 == 0, F.col("page_id") % 3, F.concat(F.lit("raw/"), "page_id")
    present = F.concat(names("type", "title", "summary", "sources"), F.when(even, names("entities", "department", "last_compiled")).otherwise(names("related")))
    keys = F.array(F.when(third == 0, names("path", "loc", "hint")).when(third == 1, names("path", "hint")).otherwise(names("loc")))
    pages = wiki(spark, sf).withColumns({"present": present, "source_keys": keys, "sources": F.array(F.struct(path.alias("path"), F.lit(None).cast("string").alias("loc"), F.col("title").alias("hint")))})
    files = pages.where("page_id % 4 <> 3").select(F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("./"), path, F.lit(".placeholder.md"))).otherwise(path).alias("path"))
    return governance.lint(pages, files, spark.createDataFrame([("index.md",), ("concepts",)], "entry string"))


@query(f"WITH {_WIKI} SELECT slug, unnest(range(len(l))) AS ord, unnest(l) AS hint FROM (SELECT slug, list_filter([title, left(url, 50), url, lang, title], lambda x: trim(x) <> '') AS l FROM wiki)")
def heal_candidates(spark, sf):
    pages = wiki(spark, sf).withColumns({"summary": F.col("url"), "entities": F.array("lang", F.lit(" "), F.col("title"))})
    return governance.heal_candidates(pages).withColumn("ord", F.col("ord").cast("bigint"))


@query(f"WITH {_WIKI} SELECT slug, url AS path, title AS hint FROM wiki WHERE url <> '' AND title <> ''")
def source_explode(spark, sf):
    sources = F.array(F.struct(F.col("url").alias("path"), F.col("title").alias("hint"), F.lit(None).cast("string").alias("loc")), F.struct(F.lit("").alias("path"), F.col("title").alias("hint"), F.lit("x").alias("loc")))
    return fetch.addresses_of(wiki(spark, sf).withColumn("sources", sources)).select("slug", "path", "hint")


@query(r"SELECT page_id, sha256(regexp_replace(html, '^\s+', '')) AS body_sha256, 2 + page_id % 3 AS n_lines FROM pages")
def frontmatter_split(spark, sf):
    more = F.expr(r"repeat('tag: t\n', cast(page_id % 3 as int))")
    made = _t(spark, sf, "pages").select("page_id", F.concat(F.lit("---\ntitle: x\n"), more, F.lit("url: y\n---\n"), F.regexp_replace("html", r"^\s+", "")).alias("text"))
    block, body = parse.split_frontmatter("text")
    return made.select("page_id", F.sha2(body, 256).alias("body_sha256"), F.size(F.split(block, "\n")).cast("bigint").alias("n_lines"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
h AS (SELECT doc_id, n, regexp_replace(split_part(line, chr(13), 1), '^\s+|\s+$', '', 'g') AS name FROM l)
SELECT doc_id, count(*) AS n_sections, sha256(string_agg('Section ' || CASE WHEN name = '' THEN 'Section' ELSE name END, '|' ORDER BY n)) AS heads_sha256 FROM h GROUP BY 1""")
def markdown_sections(spark, sf):
    marked = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    docs = _t(spark, sf, "documents").select("doc_id", parse.markdown_sections(marked).alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n_sections"), F.sha2(F.array_join("s.loc", "|"), 256).alias("heads_sha256"))


# Store


@query("SELECT 'raw/' || source || '/' || doc_id || '.txt' AS source_uri FROM documents WHERE source = 'src1' AND lang = 'fr'")
def reconcile_anti(spark, sf):
    docs = corpus(spark, sf)
    return store.missing_on_disk(docs.select("source_uri"), docs.where("lang <> 'fr'"), "raw/src1/")


@query("SELECT CASE WHEN source = 'src2' THEN 'new' ELSE lang END AS lang, count(*) AS n FROM documents GROUP BY 1")
def upsert_docs(spark, sf):
    docs = corpus(spark, sf).select("source_uri", "lang", "source")
    new = docs.where("source = 'src2'").withColumn("lang", F.lit("new"))
    return store.upsert(docs, new).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n FROM chunks WHERE lang = 'de' GROUP BY 1")
def cascade_semi(spark, sf):
    return store.cascade(_chunks(spark, sf), corpus(spark, sf).where("lang = 'de'")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT item_id FROM benchmark WHERE NOT contains(text, 'the')")
def cache_miss_anti(spark, sf):
    items = _t(spark, sf, "benchmark").withColumn("content_hash", F.sha2("text", 256))
    return store.cache_misses(items, items.where(F.contains(F.col("text"), F.lit("the")))).select("item_id")


@query("SELECT 'unique_source_uri' AS rule, lang AS key FROM documents GROUP BY lang HAVING count(*) > 1 UNION ALL SELECT 'chunk_document', l.doc_id::VARCHAR FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents)")
def constraint_violations(spark, sf):
    docs = corpus(spark, sf).select("doc_id", F.col("lang").alias("source_uri"), "allowed_depts")
    return store.violations(docs, _t(spark, sf, "labels").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id")))


@query(r"""WITH t AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, CASE WHEN lang = 'de' THEN len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) ELSE 0 END AS c FROM documents)
SELECT count(*) AS n_docs, sum(n)::BIGINT AS naive_tokens, sum(c)::BIGINT AS context_tokens, max(c) AS max_context, round(1 - sum(c) / sum(n), 6) AS saved, round_even(sum(n) / count(*) * 300, 0)::BIGINT AS projected FROM t""")
def token_economy(spark, sf):
    n = tx.token_count("text")
    return evaluation.token_economy(_t(spark, sf, "documents"), n, F.when(F.col("lang") == "de", n).otherwise(F.lit(0).cast("bigint")))


# Parts that larger queries do not show


@query(rf"""WITH {_WIKI}, n AS (SELECT rel, slug, title, type, len(list_filter(string_split_regex(body, '\s+'), lambda x: x <> '')) AS t, len(list_filter(string_split_regex(rel || chr(10) || title, '\s+'), lambda x: x <> '')) AS p,
len(list_filter(string_split_regex('- [' || title || '](' || rel || ') — ' || trim(url), '\s+'), lambda x: x <> '')) AS l FROM wiki),
i AS (SELECT sum(l) AS index_tokens FROM n WHERE slug NOT IN ('index', 'archive', 'log')), k AS (SELECT sum(p) AS p FROM (SELECT p FROM n ORDER BY rel LIMIT 5))
SELECT count(*) AS n_pages, max(index_tokens)::BIGINT AS index_tokens, max(k.p)::BIGINT AS topk_payload_tokens, max(t) AS one_page_tokens, (max(k.p) + max(t))::BIGINT AS agent_context_tokens, (max(index_tokens) + sum(t))::BIGINT AS naive_dump_tokens FROM n, i, k""")
def token_measurement(spark, sf):
    """The five sums over the pages, with addresses as summaries in the index and titles in the payload."""
    pages = wiki(spark, sf)
    lines = index_parts.index_lines(pages.withColumn("summary", F.col("url")))
    return evaluation.token_measurement(pages.select("rel", F.col("title").alias("summary"), F.col("body").alias("text")), lines, tx.token_count)


@query(r"""WITH n AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'raw/' || page_id || CASE page_id % 4 WHEN 0 THEN '.Tar.GZ' WHEN 1 THEN '/.hidden' WHEN 2 THEN '/x.MD' ELSE '/plain' END AS path FROM pages),
f AS (SELECT *, list_last(string_split(path, '/')) AS name FROM n)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(title, '\p{L}+|[^\p{L}]+'), lambda x: CASE left(x, 1) WHEN 'ß' THEN 'Ss' ELSE upper(left(x, 1)) END || lower(substr(x, 2))), '') AS spoken, replace(lower(title), ' ', '-') || '.md' AS note,
  name, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '^(.+)\.[^.]+$', 1) ELSE name END AS stem, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS suffix,
  array_to_string(list_filter(string_split_regex(trim(replace(replace(title, chr(34), ''), chr(39), '')), '\s+'), lambda x: x <> ''), '|') AS terms,
  array_to_string(list_filter([title, ' ', path], lambda x: trim(x) <> ''), chr(10) || chr(10)) AS whole, CASE WHEN page_id % 3 = 0 THEN -1 ELSE 2 END AS n_depts,
  'loc=' || path || ',title=' || CASE WHEN page_id % 2 = 0 THEN 'own' ELSE title END AS merged FROM f""")
def text_parts(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    end = F.when(F.col("page_id") % 4 == 0, ".Tar.GZ").when(F.col("page_id") % 4 == 1, "/.hidden").when(F.col("page_id") % 4 == 2, "/x.MD").otherwise("/plain")
    pages = pages.withColumn("path", F.concat(F.lit("raw/"), "page_id", end))
    sections = F.array(*(F.struct(x.alias("text")) for x in (F.col("title"), F.lit(" "), F.col("path"))))
    depts = F.size(tx.departments(F.when(F.col("page_id") % 3 == 0, "").otherwise("a,b")))
    own = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("title"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = tx.merge_maps(F.create_map(F.lit("title"), F.col("title"), F.lit("loc"), F.col("path")), own)
    merged = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return pages.select("page_id", tx.title_case("title").alias("spoken"), tx.note_file_name("title").alias("note"), tx.file_name("path").alias("name"), tx.stem("path").alias("stem"), tx.suffix("path").alias("suffix"), F.array_join(tx.query_terms("title"), "|").alias("terms"), tx.full_text(sections).alias("whole"), F.coalesce(depts, F.lit(-1)).alias("n_depts"), merged.alias("merged"))


@query("SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS distance, 1.0::DOUBLE AS from_zero, 0.0::DOUBLE AS other_length, '[' || label || '.0,-1.5]' AS written FROM embeddings")
def vector_parts(spark, sf):
    rows = _t(spark, sf, "embeddings")
    zero = F.array_repeat(F.lit(0.0), 64)
    return rows.select("vec_id", F.round(vx.cosine_distance("embedding", F.reverse("embedding")), 6).alias("distance"), vx.cosine_distance("embedding", zero).alias("from_zero"), vx.cosine("embedding", F.slice("embedding", 1, 9)).alias("other_length"), vx.literal(F.array(F.col("label").cast("double"), F.lit(-1.5))).alias("written"))


@query("""SELECT source, array_to_string(list_sort(list_distinct(list_filter(list_concat(list(DISTINCT lang), [source, CASE WHEN bool_or(lang = 'en') THEN 'all' END, '']), lambda x: x IS NOT NULL AND x <> ''))), ',') AS csv FROM documents GROUP BY source""")
def scope_lists(spark, sf):
    """What a caller of each source may see: its languages as roles, the source as team, and all as clearance where it has English texts."""
    callers = corpus(spark, sf).groupBy("source").agg(F.collect_set("lang").alias("roles"), F.max(F.when(F.col("lang") == "en", "all")).alias("clearance"))
    return callers.select("source", security.departments_of(F.array_append("roles", F.lit("")), F.col("source"), F.col("clearance")).alias("csv"))


_FILES = """fl AS (SELECT doc_id, text, doc_id % 7 AS k, 'a/my-doc_' || doc_id || ['.md', '.csv', '.py', '.PNG', '.bin', '.markdown', '.tsv'][doc_id % 7 + 1] AS uri FROM documents WHERE text <> '')"""


@query(rf"""WITH {_FILES}, st AS (SELECT *, 'my-doc_' || doc_id AS stem FROM fl), tr AS (SELECT doc_id, '\t' AS d, unnest(range(1, doc_id % 45 + 1)) AS r FROM fl WHERE k IN (1, 6)),
tb AS (SELECT doc_id, (r - 1) // 20 AS b, 'Columns: name, score' || chr(10) || string_agg('Row ' || r || ': name: n' || r || ' | score: ' || r * 2, chr(10) ORDER BY r) AS txt, 'Rows ' || min(r) || '-' || max(r) AS loc FROM tr GROUP BY 1, 2),
ta AS (SELECT doc_id, count(*) AS n, string_agg(loc, '|' ORDER BY b) AS locs, string_agg(txt, chr(10) || chr(10) ORDER BY b) AS body FROM tb GROUP BY 1),
m AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM fl WHERE k IN (0, 5))
SELECT uri AS source_uri, CASE WHEN k = 2 THEN stem || '.py' WHEN k = 3 THEN 'My Doc ' || doc_id WHEN k = 4 THEN stem ELSE 'My Doc_' || doc_id END AS title,
  CASE WHEN k IN (1, 6) AND n IS NOT NULL THEN n ELSE 1 END AS n_sections,
  CASE k WHEN 0 THEN 'Section Intro' WHEN 5 THEN 'Section Intro' WHEN 2 THEN 'Full Source Code' WHEN 3 THEN 'Image Asset' WHEN 4 THEN 'Full Document' ELSE coalesce(locs, 'All Rows') END AS locs,
  sha256(CASE WHEN k IN (0, 5) THEN regexp_replace(t, '^\s+|\s+$', '', 'g') WHEN k = 2 THEN '```py' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '```' WHEN k = 3 THEN 'Image: My Doc ' || doc_id || ' (my-doc_' || doc_id || '.PNG). Format: PNG, size: ' || octet_length(encode(text)) || ' bytes. Stored at ' || uri || '.'
    WHEN k = 4 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE coalesce(body, CASE k WHEN 1 THEN 'name,score' ELSE 'name' || chr(9) || 'score' END) END) AS text_sha256
FROM st LEFT JOIN ta USING (doc_id) LEFT JOIN m USING (doc_id) WHERE k NOT IN (0, 5) OR NOT regexp_matches(text, '(^|\n|\r)#|^---')""")
def parsed_files(spark, sf):
    """Documents as files of seven suffixes; tables are made of numbers. Marked-up texts with headings of their own are left to ``markdown_sections``."""
    docs = _t(spark, sf, "documents").where("text <> ''")
    k = (F.col("doc_id") % 7).cast("int")
    docs = docs.where(~k.isin(0, 5) | ~F.col("text").rlike(r"(^|\n|\r)#|^---"))
    uri = F.concat(F.lit("a/my-doc_"), "doc_id", F.element_at(F.array(*map(F.lit, (".md", ".csv", ".py", ".PNG", ".bin", ".markdown", ".tsv"))), k + 1))
    line = lambda d: F.concat(F.lit(f"name{d}score"), F.array_join(F.transform(F.filter(F.sequence(F.lit(0), (F.col("doc_id") % 45).cast("int")), lambda r: r > 0), lambda r: F.concat(F.lit("\nn"), r, F.lit(d), r * 2)), ""))
    content = F.when(k == 1, line(",")).when(k == 6, line("\t")).otherwise(F.col("text"))
    found = parse.parse(docs.select(uri.alias("source_uri"), F.encode(content, "UTF-8").alias("content")))
    return found.select("source_uri", "title", F.size("sections").cast("bigint").alias("n_sections"), F.array_join("sections.loc", "|").alias("locs"), F.sha2(tx.full_text("sections"), 256).alias("text_sha256"))


@query(r"""WITH t AS (SELECT item_id, regexp_replace(item_id || ' ' || replace(replace(text, chr(10), ' '), '#', ''), '^\s+|\s+$', '', 'g') AS t FROM benchmark), c AS (SELECT item_id, unnest(CASE WHEN length(t) <= 1500 THEN [0] ELSE range(0, length(t), 1300) END) AS start, t FROM t),
d AS (SELECT item_id, start, regexp_replace(substr(t, start + 1, 1500), '^\s+|\s+$', '', 'g') AS chunk_text FROM c)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY start) - 1 AS chunk_index, chunk_text, 'Section Intro' AS loc, 'ingested' AS status, (SELECT count(*) FROM benchmark) AS n_documents FROM d WHERE chunk_text <> ''""")
def ingested_directory(spark, sf):
    """A file for each hint is scanned, parsed, cut and stored, twice; the chunks of the last version."""
    folder = shared_folder(spark, "files")
    line = F.concat_ws(" ", "item_id", F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("#"), F.lit("")))
    _t(spark, sf, "benchmark").select("item_id", line.alias("line")).repartition("item_id").write.partitionBy("item_id").text(folder)
    vault = store.VersionedTables(spark, shared_folder(spark, "vault"))
    for _ in range(2):
        status = store.ingest(parse.scan_directory(spark, folder), vault, ["all"])
    chunks = vault.read("chunks", "doc_id string, source_uri string, chunk_index int, chunk_text string, loc string")
    docs = vault.read("documents", "doc_id string").agg(F.count("*").alias("n_documents"))
    item = F.regexp_extract("source_uri", r"item_id=(\d+)/", 1).cast("bigint").alias("item_id")
    return chunks.join(status.select("doc_id", "status"), "doc_id").crossJoin(F.broadcast(docs)).select(item, F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_text", "loc", "status", "n_documents")  # one row of totals


@query(rf"""WITH now AS (SELECT doc_id, text, CASE WHEN doc_id % 100 = 7 THEN 'new' ELSE 'old' END AS dept FROM documents WHERE doc_id % 50 <> 1), x AS (SELECT doc_id, dept, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM now WHERE dept = 'old' OR text <> ''),
y AS (SELECT doc_id, dept, t, unnest(CASE WHEN length(t) <= 1500 THEN [0] ELSE range(0, length(t), 1300) END) AS start FROM x WHERE t <> ''), z AS (SELECT doc_id, dept, regexp_replace(substr(t, start + 1, 1500), '^\s+|\s+$', '', 'g') AS c FROM y)
SELECT doc_id, dept, count(*) AS n_chunks, true AS fewer FROM z WHERE c <> '' GROUP BY 1, 2""")
def bucketed_store(spark, sf):
    """All documents are stored in buckets, a hundredth of them again for another department, and a fiftieth is removed; later changes write fewer buckets than there are documents of theirs or buckets."""
    docs = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("raw/"), "doc_id", F.lit(".bin")).alias("source_uri"), F.encode("text", "UTF-8").alias("content"))
    vault = bucketed.BucketedStore(spark, shared_folder(spark, "bucketed"), buckets=bucketed.buckets_for(docs.count()))
    store.ingest(docs, vault, ["old"])
    first = vault.version()
    again = docs.where("doc_id % 100 = 7")
    store.ingest(again, vault, ["new"])
    second = vault.version()
    written = sum(second.folders[b] != first.folders.get(b) for b in second.folders)
    documents, chunks = "doc_id string, source_uri string, allowed_depts array<string>, title string", "doc_id string, chunk_text string"
    vault.remove(docs.where("doc_id % 50 = 1"), documents, "doc_id string, chunk_id string, source_uri string, chunk_index int, chunk_text string, context_prefix string, loc string, metadata map<string,string>, contextual_text string")
    counts = vault.read("chunks", chunks).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    fewer = written <= min(vault.buckets - 1, again.count())
    return vault.read("documents", documents).join(counts, "doc_id").select(F.regexp_extract("source_uri", r"(\d+)\.bin", 1).cast("bigint").alias("doc_id"), F.col("allowed_depts")[0].alias("dept"), "n_chunks", F.lit(fewer).alias("fewer"))


@query(f"WITH {_CHUNKS} SELECT doc_id, count(chunks.start) AS chunks_count, CASE WHEN count(chunks.start) = 0 THEN 'skipped_empty' ELSE 'dry_run' END AS status FROM documents LEFT JOIN chunks USING (doc_id) GROUP BY 1")
def dry_run_status(spark, sf):
    return store.ingest_status(_t(spark, sf, "documents").select("doc_id"), _chunks(spark, sf), dry_run=True)


@query(f"WITH {_CHUNKS} SELECT doc_id, CASE WHEN source = 'src2' AND lang <> 'de' THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM chunks WHERE NOT (source = 'src2' AND lang <> 'de' AND start > 0) GROUP BY 1, 2")
def replaced_chunks(spark, sf):
    """Documents of one source are ingested anew and give their first chunk only; those in German give none and keep what they had."""
    chunks = _chunks(spark, sf).select("doc_id", "start", "source", "lang", F.lit("old").alias("version"))
    done = _t(spark, sf, "documents").where("source = 'src2'").select("doc_id")
    new = chunks.where("source = 'src2' and lang <> 'de' and start = 0").withColumn("version", F.lit("new"))
    return store.replace_chunks(chunks, new, done).groupBy("doc_id", "version").agg(F.count("*").alias("n"))


@query(f"WITH {_WIKI}, s AS (SELECT slug, rel, page_id FROM wiki) (SELECT 'first' AS how, slug, 0.1::DOUBLE AS score FROM s ORDER BY slug LIMIT 7) UNION ALL SELECT 'slug', slug, 1.0 FROM s WHERE slug = 'the' UNION ALL SELECT 'path', slug, 1.0 FROM s WHERE rel = 'wiki/the.md'")
def pages_without_search(spark, sf):
    """What an empty query finds, and pages by slug, by path, and by a name that is none."""
    pages = wiki(spark, sf)
    read = lambda how, path: search.read_page(pages, path).select(F.lit(how).alias("how"), "slug", F.lit(1.0).alias("score"))
    first = search.first_pages(pages, 7, "slug").select(F.lit("first").alias("how"), F.col("id").alias("slug"), "score")
    return first.union(read("slug", "the")).union(read("path", " .\\wiki\\the.md ")).union(read("none", "no such page"))


@query("SELECT doc_id AS qid, 'f-' || doc_id AS id, 'raw/f-' || doc_id || '.txt' AS path, 0.5::DOUBLE AS score, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary FROM documents")
def fallback_summaries(spark, sf):
    hits = _t(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.concat(F.lit("raw/f-"), "doc_id", F.lit(".txt")).alias("file_path"), F.lit(0.5).alias("score"), "text")
    return search.fallback_hits(hits)


_YAML = r"""CASE WHEN regexp_matches({0}, '^[\p{{L}}][\p{{L}}\p{{N}} _./,()-]*$') AND NOT ends_with({0}, ' ') AND lower({0}) <> 'yes' THEN {0} ELSE '"' || replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' END"""


@query(rf"""WITH n AS (SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'Note ' || item_id WHEN 1 THEN 'a: "' || item_id || '"' ELSE 'yes' END AS title FROM benchmark)
SELECT item_id, 'concept/' || replace(lower(title), ' ', '-') || '.md' AS rel, '---' || chr(10) || 'type: concept' || chr(10) || 'title: ' || {_YAML.format("title")} || chr(10) || 'summary: ' || {_YAML.format("text")} || chr(10) || 'entities: []' || chr(10) || 'department: all' || chr(10) || 'last_compiled: 2026-01-01' || chr(10) || 'sources:' || chr(10) || '  - path: raw/' || item_id || chr(10) || '    hint: h' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || text || chr(10) AS text FROM n""")
def compiled_pages(spark, sf):
    """A page for each hint, whose whole text is the summary."""
    title = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Note "), "item_id")).when(F.col("item_id") % 3 == 1, F.concat(F.lit('a: "'), "item_id", F.lit('"'))).otherwise("yes")
    notes = _t(spark, sf, "benchmark").select(title.alias("title"), F.lit("concept").alias("category"), F.col("text").alias("summary"), F.concat(F.lit("raw/"), "item_id").alias("path"), F.lit("h").alias("hint"))
    made = governance.compile_page(notes, "2026-01-01")
    return made.select(F.regexp_extract("text", r"\n  - path: raw/(\d+)\n    hint: h\n---", 1).cast("bigint").alias("item_id"), "rel", "text")


@query(r"""WITH t AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM benchmark)
SELECT item_id, CASE WHEN item_id % 4 = 3 THEN v ELSE '  - hint: "now ' || replace(v, '"', '\"') || '"' || chr(10) || '  - hint: ' || CASE WHEN item_id % 2 = 0 THEN '"' || v || '"' ELSE v END || chr(10) || '  - hint: "two"' END AS text,
  CASE WHEN item_id % 4 = 3 THEN 0 ELSE 2 END AS applied, '- [now] heal (drift): p' || item_id || ': ' || v || ' -> now ' || v AS line FROM t""")
def applied_heals(spark, sf):
    """Pages that name each hint twice, quoted or not, and a third one; every fourth is a text without sources."""
    hint = F.trim(F.regexp_replace("text", r"\s+", " "))
    items = _t(spark, sf, "benchmark").select("item_id", F.concat(F.lit("p"), "item_id").alias("slug"), hint.alias("old"), F.concat(F.lit("now "), hint).alias("new"))
    written = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('"'), "old", F.lit('"'))).otherwise(F.col("old"))
    pages = items.select("item_id", "slug", F.when(F.col("item_id") % 4 == 3, F.col("old")).otherwise(F.concat(F.lit("  - hint: "), written, F.lit("\n  - hint: "), written, F.lit("\n  - hint: 'zwei'"))).alias("text"))
    heals = items.select("slug", "old", "new").union(items.select("slug", F.lit("zwei"), F.lit("two")))
    log = governance.heal_log(items.select("slug", "old", "new", F.lit("drift").alias("trigger")), "now").select(F.regexp_extract("value", r": (p\d+):", 1).alias("slug"), F.col("value").alias("line"))
    return governance.apply_heals(pages, heals).join(log, "slug").select(F.substring("slug", 2, 20).cast("bigint").alias("item_id"), "text", "applied", "line")


@query("SELECT page_id % 2 = 0 AS same, count(*) AS n FROM pages GROUP BY 1")
def source_round_trips(spark, sf):
    """Lists of sources in another order are the same, with another place they are not."""
    source = lambda hint, loc: F.struct(F.col("url").alias("path"), loc.alias("loc"), hint.alias("hint"))
    pages = _t(spark, sf, "pages").withColumn("slug", F.col("page_id").cast("string"))
    a, b = source(F.lit("a"), F.lit(None).cast("string")), source(F.lit("b"), F.lit("1"))
    after = F.when(F.col("page_id") % 2 == 0, F.array(b, a)).otherwise(F.array(b, source(F.lit("a"), F.lit("2"))))
    return governance.round_trips(pages.withColumn("sources", F.array(a, b)), pages.withColumn("sources", after)).groupBy("same").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, vec_id % 100 = 0 AS paraphrase FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT 'v' || vec_id AS slug, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT qid, slug, round(list_cosine_similarity(q.v, p.v), 9) AS s FROM q, p), b AS (SELECT qid, max(row(s, slug)) AS best FROM s WHERE slug IN ('v' || (qid + 1), 'v' || (qid + 2), 'none') GROUP BY 1),
r AS (SELECT qid, count(*) FILTER (WHERE row(s, slug) > best) + 1 AS rank FROM s JOIN b USING (qid) GROUP BY 1), w AS (SELECT paraphrase, rank FROM q LEFT JOIN r USING (qid))
SELECT count(*) AS n_questions, count(*) FILTER (WHERE paraphrase) AS n_paraphrase, round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_50, round(avg(CASE WHEN rank <= 500 THEN 1.0 ELSE 0.0 END), 3) AS recall_at_500,
  round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END) FILTER (WHERE paraphrase), 3) AS paraphrase_recall_at_50, round(avg(CASE WHEN rank <= 500 THEN 1.0 ELSE 0.0 END) FILTER (WHERE paraphrase), 3) AS paraphrase_recall_at_500, (SELECT count(*) FROM q) AS n_unknown FROM w""")
def paraphrase_recall(spark, sf):
    """Each fiftieth vector asks for one of its two successors; a third target of each is unknown."""
    rows = _t(spark, sf, "embeddings")
    pages = rows.select(F.concat(F.lit("v"), "vec_id").alias("slug"), "embedding")
    name = lambda d: F.concat(F.lit("v"), F.col("vec_id") + d)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"), (F.col("vec_id") % 100 == 0).alias("paraphrase"), F.array(name(1), name(2), F.lit("none")).alias("targets"), F.concat(F.lit("none"), "vec_id").alias("target"))
    unknown = evaluation.unknown_targets(asked, pages).agg(F.count("*").alias("n_unknown"))
    return evaluation.recall_by_paraphrase(asked, evaluation.ranked_pages(pages, asked), (50, 500)).crossJoin(F.broadcast(unknown))  # one row each


@query("""WITH v AS (SELECT item_id, [((unicode(substr(text, i + 1, 1)) * 31 + i) % 100) / 100.0 for i in range(0, least(length(text), 32))] AS a FROM benchmark)
SELECT item_id, 'characters' AS embedder_used, round(list_sum([a[i] * i for i in range(1, len(a) + 1)]) / sqrt(list_sum([x * x for x in a])), 4) AS weighted FROM v""")
def embedder_falls_back(spark, sf):
    def broken(texts):
        raise ConnectionError("no service")

    made = vx.embed(_t(spark, sf, "benchmark"), "text", broken, dims=32)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select("item_id", "embedder_used", F.round(weighted, 4).alias("weighted"))


@query(r"SELECT item_id, sha256(text || '::') AS content_hash, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::DOUBLE AS n_words, (SELECT count(DISTINCT text) FROM benchmark WHERE item_id % 2 = 1) AS n_embedded FROM benchmark")
def cached_index(spark, sf):
    """The index of half of the pages, then of all: the second build embeds only what the first did not."""
    pages = _t(spark, sf, "benchmark").withColumns({"summary": F.col("text"), "entities": F.array().cast("array<string>")})
    cache, seen = store.VersionedTable(spark, shared_folder(spark, "vector-cache")), []

    def embed(rows):
        seen.append(rows.count())
        return vx.hash_embedded(rows, F.col("text"))

    index.build_index(pages.where("item_id % 2 = 0"), cache, embed)
    built = index.build_index(pages, cache, embed)
    return built.select("item_id", "content_hash", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("n_words"), F.lit(seen[-1]).cast("bigint").alias("n_embedded"))


@query("SELECT 1::BIGINT AS batches, count(*) AS n_rows, 1::BIGINT AS n_after FROM events")
def watched_batches(spark, sf):
    """The events as a stream of files: one batch of all, after which the hook runs, and none when it is started again."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder, rows, after = shared_folder(spark, "stream"), [], []
    for _ in range(2):
        changes = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        ev.watch(spark, lambda batch: rows.append(batch.count()) or True, folder, changes=changes, after=lambda: after.append(1))
    return spark.createDataFrame([(len(rows), sum(rows), len(after))], "batches bigint, n_rows bigint, n_after bigint")


_SETTLED = """s AS (SELECT user_id::VARCHAR AS path, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN NULL ELSE event_type END AS digest FROM events),
q AS (SELECT *, lead(us) OVER w AS next FROM s WINDOW w AS (PARTITION BY path ORDER BY us, digest NULLS FIRST)), k AS (SELECT path, us, digest FROM q WHERE next IS NULL OR next - us >= 600000000),
c AS (SELECT *, lag(digest) OVER (PARTITION BY path ORDER BY us, digest NULLS FIRST) AS before FROM k)"""


@query(f"WITH {_SETTLED} SELECT path, us, digest, CASE WHEN before IS NULL THEN 'added' WHEN digest IS NULL THEN 'deleted' ELSE 'changed' END AS kind FROM c WHERE before IS DISTINCT FROM digest")
def settled_changes(spark, sf):
    """Events as observations of files, one for each user; a purchase stands for a removal. Ten minutes of quiet settle a file."""
    seen = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("seen"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("digest"))
    return changes.settled(seen, 600.0).select("path", F.unix_micros("at").alias("us"), "digest", "kind")


# Streams, as tables; the windows go beyond the original scope


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'missing_signature' WHEN user_id % 3 = 1 AND event_type = 'click' THEN 'invalid_signature' WHEN user_id % 7 = 0 THEN 'pong' WHEN event_type = 'view' THEN 'queued' ELSE 'skipped' END AS status, count(*) AS n FROM events GROUP BY 1")
def webhook_classify(spark, sf):
    secret = b"not-a-secret"
    body = F.to_json(F.struct(F.concat(F.lit("refs/heads/"), F.when(F.col("event_type") == "view", "main").otherwise("side")).alias("ref")))
    valid = {ref: hmac.new(secret, f'{{"ref":"refs/heads/{ref}"}}'.encode(), hashlib.sha256).hexdigest() for ref in ("main", "side")}
    right = F.when(F.col("event_type") == "view", f"sha256={valid['main']}").otherwise(valid["side"])
    signature = F.when(F.col("user_id") % 3 == 0, "").when((F.col("user_id") % 3 == 1) & (F.col("event_type") == "click"), valid["main"]).otherwise(right)
    event = F.when(F.col("user_id") % 7 == 0, "ping").otherwise("push")
    hooks = _t(spark, sf, "events").select("event_id", body.alias("body"), signature.alias("signature"), event.alias("event"))
    return ev.classify_hooks(hooks, secret).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return ev.tumbling(_t(spark, sf, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM b GROUP BY user_id, k")
def event_sessions(spark, sf):
    return ev.sessions(_t(spark, sf, "events")).select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), "user_id", "n")
