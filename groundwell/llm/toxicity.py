"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is its words (runs of characters outside space and the controls 9 to 13, ASCII capitals lowered); each word,
with a space before and behind, gives its n-grams of 2 to 5 characters (code points), hashed into ``dims`` features. A feature's value is
its count divided by the number of words, times the log ratio of its smoothed mean in toxic and in other training
texts. Logistic regression on these gives the weights. Values add up over words, so a distinct word's share of the score is
computed once and whole texts of any length are scored by a gather and a sum.

Training takes at most ``max_rows`` labelled texts, those with the smallest hash of their id, and of these the first whose
features, at most ``dims`` pairs of 6 bytes a text, make at most ``max_bytes``: those go to the driver. Everything else covers all rows.

Defined results: null or empty text scores as the bias alone; null ids and repeated rows are scored like any other; with no labelled
rows, or of one class only, every score is the smoothed share of toxic labels; a null label does not count; repeated labels of a document, equal or not, count as often as they stand; an empty
table gives an empty result; columns other than id and text are ignored. Bytes that are no UTF-8 count as replacement characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.blocks import IS_SPACE, Words, buffer_of, slices
from groundwell.llm.shared import id_and_text, schema_with_id, stored

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GRAMS = (2, 3, 4, 5)
_ROOM = 1_000_000
_PRIOR_WORDS = 40


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    bias: float


def _characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two spaces, end to end, and how many each word has."""
    joined = b"".join(b" " + x + b" " for x in words)
    try:
        text = joined.decode()
    except UnicodeDecodeError:
        return _characters([x.decode(errors="replace").encode() for x in words])
    begins = np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)
    ends = begins[np.cumsum([len(x) + 2 for x in words]) - 1] if words else np.zeros(0, np.int64)
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), np.diff(ends, prepend=0)


def gram_features(words: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of each word's n-grams, word after word, and the bounds of each word."""
    text, lengths = _characters(words)
    text += np.uint64(1)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(text)) - np.repeat(begins, lengths)
    left = np.repeat(lengths, lengths) - place  # characters from here to the word's end
    counts = sum(np.maximum(lengths - n + 1, 0) for n in _GRAMS)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.int32)
    written = bounds[:-1].copy()
    for n in _GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[at + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        own = np.maximum(lengths - n + 1, 0)
        out[np.repeat(written, own) + place[at]] = h % np.uint64(dims)
        written += own
    return out, bounds


def _blocks(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, list[bytes]]:
    """Words of a batch, the number of each among the distinct ones, and those."""
    data, offsets = buffer_of(batch.column("text"))
    data = _LOWER[data]
    words = Words(data, offsets, ~IS_SPACE[data])
    table = words.array().dictionary_encode()
    return words, table.indices.to_numpy(zero_copy_only=False), table.dictionary.to_pylist()


def text_features(docs: DataFrame, dims: int) -> DataFrame:
    """``place`` and ``toxic`` with the features of each text and their values, as bytes of 16-bit numbers and 32-bit floats."""
    assert dims <= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, ids, distinct = _blocks(batch)
            grams, bounds = gram_features(distinct, dims)
            features, values = [], []
            for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
                own, n = np.unique(ids[a:b], return_counts=True)
                sizes = bounds[own + 1] - bounds[own]
                at = np.repeat(bounds[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                count = np.bincount(grams[at], np.repeat(n, sizes), minlength=1)
                found = np.flatnonzero(count)
                features.append(found.astype("<u2").tobytes())
                values.append((count[found] / (b - a + _PRIOR_WORDS)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), pa.array(features, pa.binary()), pa.array(values, pa.binary())], ["place", "toxic", "features", "values"])

    return docs.mapInArrow(run, "place bigint, toxic int, features binary, values binary")


def fit(rows: list, dims: int, ridge: float = 1e-5, steps: int = 120) -> ToxicModel:
    """Logistic regression by accelerated gradient steps on log-count-ratio features."""
    y = np.array([r["toxic"] for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicModel(np.zeros(dims, np.float32), float(np.log(share / (1 - share))))
    at = [np.frombuffer(r["features"], "<u2") for r in rows]
    column = np.concatenate(at).astype(np.int64)
    value = np.concatenate([np.frombuffer(r["values"], "<f4") for r in rows]).astype(np.float64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in at])])
    row = np.repeat(np.arange(len(rows)), np.diff(offsets))
    mean = [np.bincount(column[keep], value[keep], minlength=dims) / (y == k).sum() + 1e-4 for k, keep in ((k, y[row] == k) for k in (0, 1))]
    ratio = np.log(mean[1] / mean[1].sum()) - np.log(mean[0] / mean[0].sum())
    value *= ratio[column]
    scale = 1 / np.sqrt((value**2).sum() / len(rows))
    value *= scale

    def scores(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[column], minlength=len(rows))

    # the largest eigenvalue of the Gram matrix bounds the curvature
    v = np.random.default_rng(0).standard_normal(dims)
    for _ in range(8):
        v = np.bincount(column, value * scores(v / np.linalg.norm(v))[row], minlength=dims)
    step = 1 / (0.25 * (np.linalg.norm(v) / len(rows) + 1) + ridge)
    w, z, b, zb, t = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(scores(z) + zb, -30, 30))) - y
        new = z - step * (np.bincount(column, value * error[row], minlength=dims) / len(rows) + ridge * z)
        new_b = zb - step * error.mean()
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / grown * (new - w), new_b + (t - 1) / grown * (new_b - b)
        w, b, t = new, new_b, grown
    return ToxicModel((w * ratio * scale).astype(np.float32), float(b))


def in_fold(id_column: Column, folds: int = 5) -> Column:
    """The fold of an id: crc32 of its decimal text."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds))


def train(df: DataFrame, labels: DataFrame, max_rows: int = 3000, max_bytes: int = 64 << 20, dims: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learns from the labelled rows outside fold 0, at most ``max_rows`` of them and ``max_bytes`` of their features."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(in_fold(F.col("id")) != 0)
    sample = known.select("id", "toxic", F.xxhash64("id").alias("place")).orderBy("place", "id", "toxic").limit(max_rows)
    docs = id_and_text(df, id_col, text_col).join(F.broadcast(sample), "id")  # a stated number of rows
    made = stored(text_features(docs.select("place", "toxic", "text"), dims), "toxic-features").orderBy("place", "toxic", "features", "values").limit(max_rows)
    sizes = made.select(F.octet_length("features") + F.octet_length("values")).collect()
    fits = int(np.searchsorted(np.cumsum([r[0] for r in sizes]), max_bytes, "right"))
    return fit(made.limit(fits).collect(), dims)


class _Shares:
    """Share of each distinct word in the score; lives as long as its Python worker, for one model at a time."""

    weights: np.ndarray | None = None
    known: dict[bytes, float] = {}

    @classmethod
    def of(cls, model: ToxicModel, words: list[bytes]) -> np.ndarray:
        if cls.weights is None or not np.array_equal(cls.weights, model.weights):
            cls.weights, cls.known = model.weights, {}
        found = [cls.known.get(x) for x in words]
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            grams, bounds = gram_features([words[i] for i in missing], len(model.weights))
            shares = np.add.reduceat(model.weights[grams].astype(np.float64), bounds[:-1]).tolist()  # each word has n-grams
            for i, share in zip(missing, shares, strict=True):
                found[i] = share
                if len(cls.known) < _ROOM:
                    cls.known[words[i]] = share
        return np.array(found, np.float64)


def score(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score``, the probability of a toxic label, and ``predicted``, whether it is at least one half, for every row."""
    docs = id_and_text(df, id_col, text_col)
    out = schema_with_id(docs, "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            words, ids, distinct = _blocks(batch)
            total = _sums(_Shares.of(model, distinct)[ids] if len(ids) else np.zeros(0), words.rows)
            p = 1 / (1 + np.exp(-np.clip(total / (words.counts + _PRIOR_WORDS) + model.bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], out.names)

    return docs.mapInArrow(run, out).withColumnRenamed("id", id_col)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out
