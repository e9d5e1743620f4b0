"""Vector expressions and embedders that need no model."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; 0 for null, empty, zero or unequally long vectors."""
    a, b = doubles(a), doubles(b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(F.lit(0.0))


def unit(v: Column | str) -> Column:
    """Scaled to length 1 in double precision; a zero vector stays one."""
    pair = _let(doubles(v), lambda r: F.struct(r.alias("r"), F.sqrt(_sum(F.transform(r, lambda x: x * x))).alias("n")))
    return _let(pair, lambda s: F.when(s["n"] > 0, F.transform(s["r"], lambda x: x / s["n"])).otherwise(s["r"]))


def unit_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of vectors that went through :func:`unit`: one pass over a pair instead of three."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x * y))).otherwise(F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 less the similarity; 1 for zero vectors."""
    return F.lit(1.0) - cosine(a, b)


def fit(v: Column | str, dims: int) -> Column:
    """Cut or padded with zeros to ``dims``."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), dims)), 1, dims)


def literal(v: Column | str) -> Column:
    """Text form: numbers in brackets, with commas."""
    return F.to_json(F.col(v) if isinstance(v, str) else v)


def hash_bucket(token: Column, dims: int) -> Column:
    """SHA-1 of a token modulo ``dims``, a power of two up to 4096: its last hexadecimal digits hold the remainder."""
    assert dims & (dims - 1) == 0 and dims <= 4096
    return (F.conv(F.right(F.sha1(token), F.lit(3)), 16, 10).cast("int") % dims).cast("int")


def hash_embed(text: Column | str, dims: int = 64) -> Column:
    """Counts of lower-cased white-space separated words by bucket."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    if dims > 256:
        zero = F.array_repeat(F.lit(0.0), dims)
        return F.aggregate(F.transform(words, lambda w: hash_bucket(w, dims)), zero, lambda acc, b: F.transform(acc, lambda x, k: x + F.when(k == b, 1.0).otherwise(0.0)))
    # a character for each word: counting one is a plain replacement, far cheaper than a lambda for each word and bucket
    marks = F.array_join(F.transform(words, lambda w: F.char(hash_bucket(w, dims))), "")
    counts = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (F.length(m) - F.length(F.replace(m, F.char(k), F.lit("")))).cast("double"))
    return _let(marks, counts)


#: Words of an Arrow batch that are counted at a time.
_WORDS = 1 << 18


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about :data:`_WORDS` list entries, or one row."""
    piece = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // _WORDS
    begins = np.flatnonzero(np.diff(piece, prepend=-1))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def hash_embedded(df: DataFrame, text: Column, dims: int = 64, out: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the vector that :func:`hash_embed` gives, made within the row: nothing is shuffled.

    Words are cut in the JVM; each distinct one of a piece of an Arrow batch is hashed once. Pieces hold a bounded number of words.
    """
    rows = df.select(*(df.columns if keep is None else keep), F.split(F.lower(text), r"\s+").alias("__words"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, "__words"):
                lists, n = batch.column("__words"), batch.num_rows
                words = lists.flatten().dictionary_encode()
                place = np.array([int(hashlib.sha1(w.encode()).hexdigest()[-3:], 16) % dims if w else -1 for w in words.dictionary.to_pylist()], np.int64)
                row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                bucket = place[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                counts = np.bincount((row * dims + bucket)[bucket >= 0], minlength=n * dims).astype(np.float64)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(counts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], schema.names)

    return rows.mapInArrow(run, schema)


def hash_embeddings(df: DataFrame, id_col: str, text: Column, dims: int = 64) -> DataFrame:
    """``id`` and the ``embedding`` that :func:`hash_embed` gives, for a whole table."""
    return hash_embedded(df.select(F.col(id_col).alias("id"), text.alias("text")), F.col("text"), dims, keep=["id"])


def char_embed(text: Column | str, dims: int = 1024) -> Column:
    """``(code point * 31 + place) mod 100 / 100`` of the first ``dims`` characters, scaled to unit length; zeros beyond the text."""
    text = F.col(text) if isinstance(text, str) else text

    characters = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.left(text, F.lit(dims)), ""))
    raw = F.transform(characters, lambda c, k: ((F.ascii(c) * 31 + k) % 100).cast("double") / 100)
    normed = _let(raw, lambda r: F.struct(r.alias("r"), F.sqrt(_sum(F.transform(r, lambda x: x * x))).alias("n")))
    return fit(_let(normed, lambda s: F.when(s["n"] > 0, F.transform(s["r"], lambda x: x / s["n"])).otherwise(s["r"])), dims)


class Embedder(Protocol):
    """Gives one vector for each text, in order."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class GatewayEmbedder:
    """An embedder behind a service: posts ``{"model", "input"}`` with ``batch`` texts at a time to ``url`` and puts the vectors of the answer in the order of their ``index``.

    An answer that lacks a vector, and any failure of the service, is an error; :func:`embed` decides what follows.
    """

    def __init__(self, url: str, model: str, key: str | None = None, batch: int = 64, timeout: float = 60.0):
        self.url, self.model, self.key, self.batch, self.timeout = url, model, key, batch, timeout

    def _post(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, data=json.dumps({"model": self.model, "input": texts}).encode(), headers=headers, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            rows = {int(x["index"]): x["embedding"] for x in json.load(answer)["data"]}
        if sorted(rows) != list(range(len(texts))):
            raise ValueError(f"{len(texts)} texts gave vectors {sorted(rows)}")
        return [rows[k] for k in range(len(texts))]

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [v for a in range(0, len(texts), self.batch) for v in self._post(texts[a : a + self.batch])]


def embed(df: DataFrame, text_col: str, embedder: Embedder | None = None, dims: int = 1024, fallback: bool = True) -> DataFrame:
    """Adds ``embedding`` and ``embedder_used``.

    ``embedder`` gets the texts of one Arrow batch at a time. If it fails, rows get character vectors and say so, or the failure
    goes on if ``fallback`` is off. Without an embedder, character vectors stay in the JVM.
    """
    if embedder is None:
        return df.withColumns({"embedding": char_embed(text_col, dims), "embedder_used": F.lit("characters")})
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedder_used", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            try:
                vectors, used = [list(map(float, v)) for v in embedder(rows[text_col].fillna("").tolist())], "embedder"
                vectors = [(v + [0.0] * dims)[:dims] for v in vectors]
            except Exception:
                if not fallback:
                    raise
                vectors, used = [None] * len(rows), "characters"
            yield rows.assign(embedding=vectors, embedder_used=used)

    out = df.mapInPandas(run, schema)
    return out.withColumn("embedding", F.coalesce("embedding", char_embed(F.coalesce(F.col(text_col), F.lit("")), dims)))


def in_order(vectors: Column | str) -> Column:
    """The vectors of a response (structs of ``index`` and ``embedding``) in the order of what was sent."""
    return F.transform(F.array_sort(F.col(vectors) if isinstance(vectors, str) else vectors, lambda a, b: F.when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0)), lambda x: x["embedding"])


def rrf(rank: Column | str, k: int = 60, missing: float = 0.0) -> Column:
    """``1 / (k + rank)`` in double precision; ``missing`` where there is no rank."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.coalesce(F.lit(1.0).cast("double") / (F.lit(k) + rank), F.lit(missing).cast("double"))
