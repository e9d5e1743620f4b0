"""The registered queries of these operators, with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.collocations import collocations
from groundwell.llm.exact_dedup import duplicates
from groundwell.llm.jaccard_join import components as jaccard_components
from groundwell.llm.license_scan import scan
from groundwell.llm.packing import pack
from groundwell.llm.pii import find
from groundwell.llm.quality_rules import score_rules
from groundwell.llm.sentencepiece_codec import encode_pieces
from groundwell.llm.shared import shared_folder
from groundwell.llm.simhash import components
from groundwell.llm.token_output import read_documents, write_sequences
from groundwell.llm.toxicity import in_fold, score, train
from groundwell.llm.warc import read_warc, write_warc
from groundwell.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "sequences")
    write_sequences(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, folder, docs.schema["doc_id"].dataType).withColumnRenamed("id", "doc_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(in_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).withColumnRenamed("id", "page_id").drop("url")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("matches")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rules(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_token_output": op3_token_output,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_license_scan": op7_license_scan,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_collocations": op13_collocations,
}

#: What SQL can express whole; the other queries are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op6_warc": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM g""",
    "op10_quality_rules": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM d WHERE len(w) >= 3),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM k) WHERE n > 1),
m AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY 1),
s AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM s WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS n_dup_lines FROM n GROUP BY 1),
c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '[a-z]')) AS small, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR capitals > small OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM f""",
    "op13_collocations": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0)),
u AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL), t AS (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY 1),
b AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
c AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
i AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM c UNION ALL SELECT lang, w2, w3, f FROM c) GROUP BY ALL),
s AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k FROM b JOIN u x ON x.lang = b.lang AND x.w1 = b.w1 JOIN u y ON y.lang = b.lang AND y.w1 = b.w2
  LEFT JOIN i ON i.lang = b.lang AND i.w1 = b.w1 AND i.w2 = b.w2 WHERE i.most IS NULL OR 100 * i.most < 50 * b.f
UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, u.f, b.f, 1 FROM c JOIN u ON u.lang = c.lang AND u.w1 = c.w1 JOIN b ON b.lang = c.lang AND b.w1 = c.w2 AND b.w2 = c.w3
UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, b.f, u.f, 2 FROM c JOIN b ON b.lang = c.lang AND b.w1 = c.w1 AND b.w2 = c.w2 JOIN u ON u.lang = c.lang AND u.w1 = c.w3),
m AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM s),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) QUALIFY rank <= 2000""",
}
