"""Collocations by contiguous pattern growth: frequent words are prefixes, and their occurrences grow to the right.

Texts are cut into pieces and words; words are told apart by a 64-bit hash of language and word, verified against each other over the whole corpus
(two words under one hash start the run again with another seed). Words are counted first. Then every occurrence of a frequent word is projected:
what is shuffled is a pointer to it in the form of the frequent words that follow in its piece, ``longest`` words in all, counted in its block before. All
pointers of a prefix meet in one task; a prefix with more than a small share of all words is dealt over several by its second word, and a pair of that share by
all that follows. In a task pointers are sorted, which walks the tree of extensions depth-first, and runs of equal first words are the supports of its nodes; rare nodes are cut there.

A phrase of m words is scored at each of its cuts by ``10**6 * a * a / (l * r)``, rounded down, from its own count and those of the two parts; the
lowest cut counts, of equal ones the first. A phrase inside a longer candidate that makes up ``share`` per cent of its occurrences or more is dropped.

Defined results: null text counts as empty; null language is ``und``; empty texts and tables give nothing; repeated rows count each; of equal scores the larger
count and then the smaller phrase (bytes) comes first; very long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.blocks import Words, buffer_of, release, row_numbers, slices
from groundwell.llm.shared import bitmap, bound_batches, may_hold, quoted, stored, text_of

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLOCK = 4 << 20
#: A prefix with more than this part of all words is dealt over several tasks; there are no more such prefixes than this.
_HEAVY = 4096
#: Parts of a heavy pair are numbered from here on: its supports are added up over tasks.
_SUMMED = 1 << 20
#: Pointers sorted at a time, and rows of a batch between the JVM and Python.
_ROWS, _BATCH = 1 << 19, 1 << 16


class _Block:
    """The words of a batch: ``words`` distinct ones of a language each, ``hashes`` of those, their number ``code`` by position, and which words the next one follows in its piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        data, offsets = buffer_of(batch.column("text"))
        data = _LOWER[data]
        found = Words(data, offsets, ~(_BLANK | _BREAK)[data])
        row = row_numbers(found.rows)
        piece = np.cumsum(_BREAK[data])[found.starts] if len(found.starts) else np.zeros(0, np.int64)
        self.follows = np.zeros(len(row), bool)
        self.follows[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        lang = batch.column("lang").dictionary_encode()
        word = found.array().dictionary_encode()
        pair = lang.indices.to_numpy()[row].astype(np.int64) * max(1, len(word.dictionary)) + word.indices.to_numpy()
        distinct, self.code = np.unique(pair, return_inverse=True)
        self.n = np.bincount(self.code, minlength=len(distinct))
        self.langs, names = lang.dictionary.to_pylist(), word.dictionary.to_pylist()
        self.lang_of, at = distinct // max(1, len(names)), distinct % max(1, len(names))
        self.words = [names[k] for k in at.tolist()]
        self.seeds = [xxhash.xxh64_intdigest(x.encode(), seed) for x in self.langs]
        self.hashes = np.array([hashed(w, self.seeds[k]) for w, k in zip(self.words, self.lang_of.tolist(), strict=True)], np.uint64)

    def common_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of the pairs that make up half of a heavy share of the block."""
        at = np.flatnonzero(self.follows)
        pair, n = np.unique(self.code[at] * len(self.hashes) + self.code[at + 1], return_counts=True)
        pair, n = pair[2 * n * _HEAVY >= len(self.code)], n[2 * n * _HEAVY >= len(self.code)]
        return pair_hash(self.hashes[pair // len(self.hashes)], self.hashes[pair % len(self.hashes)]) if len(pair) else np.zeros(0, np.uint64), n


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (second >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(32))


def hashed(word: bytes, seed: int) -> int:
    """Never zero, which stands for no word."""
    return xxhash.xxh64_intdigest(word, seed) or 1


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.select(text_of(text_col).alias("text"), F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"))


def word_counts(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """``h``, ``lang``, ``word`` and ``n`` of words that occur ``least`` times or more, and ``clash``, whether another word has that hash.

    The empty word stands for all words of its language, a null word for a pair: its count leaves out blocks in which it is rare, and is
    half a heavy share or more for each heavy pair.
    """

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = _Block(batch, seed)
        totals = np.bincount(b.lang_of, weights=b.n, minlength=len(b.langs)).astype(np.int64)
        pairs, times = b.common_pairs()
        h = np.concatenate([b.hashes, np.array([hashed(b"", s) for s in b.seeds], np.uint64), pairs])
        lang = pa.array(b.langs, pa.string()).take(pa.array(np.concatenate([b.lang_of, np.arange(len(b.langs)), np.zeros(len(pairs), np.int64)])))
        word = pa.array(b.words + [b""] * len(b.langs) + [None] * len(pairs), pa.binary()).cast(pa.string())
        lang = pa.compute.if_else(pa.compute.is_valid(word), lang, "")
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lang, word, pa.array(np.concatenate([b.n, totals, times]))], ["h", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BLOCK):
            yield counts(batch)
        release()

    counted = texts.mapInArrow(run, "h bigint, lang string, word string, n bigint")
    own = F.struct("lang", "word")
    counted = counted.groupBy("h").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.sum("n").alias("n"))
    return counted.select("h", "low.lang", "low.word", "n", (F.col("low") != F.col("high")).alias("clash")).where(F.col("clash") | (F.col("n") >= least))


def verified_words(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """:func:`word_counts` with the first seed under which no two words share a hash, and that seed."""
    seed = 0
    while True:
        words = stored(word_counts(texts, least, seed), "words")
        if not words.where("clash").limit(1).count():
            return words.drop("clash"), seed
        seed += 1


def pointers(texts: DataFrame, words: DataFrame, seed: int, longest: int) -> DataFrame:
    """Occurrences of frequent words that are followed by one: hashes ``h1`` to ``h<longest>`` (0: none), how many there are in their block, and ``part``.

    ``part`` is -1, or for a heavy prefix the task among its own, from ``_SUMMED`` on for heavy pairs. Rare words end a phrase; the filter lets a few pass, which supports rule out.
    """
    bits = bitmap(words.where("word <> ''").select("h"))
    total = words.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def heavy(kind: str, share: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and numbers of parts of what makes up more than that part of all words; there is not more of it than that."""
        found = words.where(kind).where(F.col("n") * share > total).select("h", "n").toArrow()
        h, n = (found.column(k).to_numpy() for k in ("h", "n"))
        order = np.argsort(h.view(np.uint64))
        return h.view(np.uint64)[order], (-(-n[order] * _HEAVY // max(total, 1))).astype(np.uint64)

    heavy_words, heavy_pairs = heavy("word <> ''", _HEAVY), heavy("word is null", 2 * _HEAVY)
    columns = [f"h{k + 1}" for k in range(longest)]

    def grids(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        b = _Block(batch, seed)
        common = may_hold(bits, b.hashes)
        on = np.concatenate([common[b.code], np.zeros(longest, bool)])
        code, follows = np.concatenate([b.code, np.zeros(longest, np.int64)]), np.concatenate([b.follows, np.zeros(longest, bool)])
        starts = np.flatnonzero(on[:-1] & on[1:] & follows[:-1])
        for a in range(0, len(starts), _ROWS):
            at = starts[a : a + _ROWS]
            open_, grid = np.ones(len(at), bool), np.zeros((longest, len(at)), np.int64)
            for k in range(longest):
                open_ &= on[at + k] & (follows[at + k - 1] if k else True)
                grid[k] = np.where(open_, code[at + k] + 1, 0)
            grid = grid[:, np.lexsort(grid[::-1])]
            first = np.flatnonzero(np.concatenate([[True], (grid[:, 1:] != grid[:, :-1]).any(axis=0)]))
            hashes = np.concatenate([np.zeros(1, np.uint64), b.hashes])[grid[:, first]]
            n = np.diff(np.append(first, len(at)))
            for c in range(0, len(first), _BATCH):
                own = np.ascontiguousarray(hashes[:, c : c + _BATCH])
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in own), pa.array(n[c : c + _BATCH]), pa.array(_parts(own, heavy_words, heavy_pairs))], [*columns, "n", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BLOCK):
            yield from grids(batch)
        release()

    return texts.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns) + ", n bigint, part int")


def _parts(hashes: np.ndarray, words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    part = np.full(hashes.shape[1], -1, np.int64)
    for (known, parts), own, rest, base in ((words, hashes[0], hashes[1:2], 0), (pairs, pair_hash(hashes[0], hashes[1]), hashes[1:], _SUMMED)):
        if len(known):
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            large = known[place] == own
            mixed = np.bitwise_xor.reduce((rest[:, large] ^ np.arange(1, len(rest) + 1, dtype=np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15), axis=0)
            part[large] = base + ((mixed >> np.uint64(20)) % parts[place[large]]).astype(np.int64)
    return part.astype(np.int32)


def grown(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """``phrase`` (an array of hashes) and ``n`` of the phrases of 2 to ``longest`` words that occur ``least`` times or more.

    A task gets whole prefixes, sorted, in bounded batches: a run that a batch cuts is carried on as one number for each length. Pairs that are
    dealt over several tasks, and what begins with them, give sums of each, which are added afterwards.
    """
    columns = [f"h{k + 1}" for k in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[tuple[np.ndarray, int, int] | None] = [None] * (longest + 1)  # of each length: the open phrase, its count, its part
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                grid = np.stack([np.asarray(batch.column(c)) for c in columns])
                n, part = np.asarray(batch.column("n")), np.asarray(batch.column("part"))
            for m in range(longest, 1, -1):
                open_ = carried[m]
                if batch is None:
                    if open_ is not None:
                        yield _phrases(open_[0][:, None], np.array([open_[1]]), np.array([open_[2]]), least, m == longest)
                    continue
                full = grid[m - 1] != 0
                own, counts, of = grid[:m, full], n[full], part[full]
                if open_ is not None:
                    own, counts, of = np.concatenate([open_[0][:, None], own], axis=1), np.concatenate([[open_[1]], counts]), np.concatenate([[open_[2]], of])
                if not len(counts):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(axis=0)]))
                sums = np.add.reduceat(counts, first)
                carried[m] = own[:, first[-1]], int(sums[-1]), int(of[first[-1]])
                yield _phrases(own[:, first[:-1]], sums[:-1], of[first[:-1]], least, m == longest)
        release()

    dealt = rows.repartition("h1", "part").sortWithinPartitions(*columns)
    found = dealt.mapInArrow(run, "phrase array<bigint>, n bigint, whole boolean")
    found = stored(found, "grown")
    sums = found.where("not whole").groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.where("whole").select("phrase", "n").union(sums)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _phrases(own: np.ndarray, n: np.ndarray, part: np.ndarray, least: int, longest: bool) -> pa.RecordBatch:
    """Frequent phrases, and the parts of such as other tasks may have too: what follows decides the task, so those of full length are whole."""
    whole = (part < _SUMMED) | longest
    keep = np.flatnonzero((n >= least) | ~whole)
    own = own[:, keep]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * len(own)), pa.array(own.T.ravel().copy()))
    return pa.RecordBatch.from_arrays([lists, pa.array(n[keep]), pa.array(whole[keep])], ["phrase", "n", "whole"])


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrase``, ``a``, and ``l``, ``r`` and ``score`` of the lowest cut."""
    counts = stored(phrases.union(words.where("word <> ''").select(F.array("h"), "n")), "phrase-counts")
    cuts = phrases.select("phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", F.slice("phrase", 1, F.col("k")).alias("first"), F.slice("phrase", F.col("k") + 1, F.size("phrase")).alias("rest"))
    met = cuts.join(counts.select(F.col("phrase").alias("first"), F.col("n").alias("l")), "first").join(counts.select(F.col("phrase").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr("(cast(1000000 AS decimal(38,0)) * cast(a AS decimal(19,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    best = met.withColumn("score", score).groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    return best.select("phrase", "a", "cut.l", "cut.r", "cut.score")


def standing(phrases: DataFrame, share: int) -> DataFrame:
    """The phrases but for those inside a longer one that has ``share`` per cent of their occurrences or more."""
    longer = phrases.where("size(phrase) > 2").select("n", "phrase", F.explode(F.sequence(F.lit(2), F.size("phrase") - 1)).alias("m"))
    inside = longer.select(F.col("n").alias("most"), F.explode(F.transform(F.sequence(F.lit(1), F.size("phrase") - F.col("m") + 1), lambda i: F.slice("phrase", i, F.col("m")))).alias("phrase"))
    inside = inside.groupBy("phrase").agg(F.max("most").alias("most"))
    left = phrases.join(inside, "phrase", "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("n")))
    return left.select("phrase", "n")


def collocations(df: DataFrame, longest: int = 3, least: int = 10, share: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``most`` best phrases of 2 to ``longest`` words of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``."""
    texts = _texts(df, text_col, lang_col)
    words, seed = verified_words(texts, least)
    phrases = stored(grown(pointers(texts, words, seed, longest), least, longest), "phrases")
    left = standing(phrases, share).select("phrase")
    best = scored(phrases, words).join(left, "phrase", "left_semi")
    # places of the words' names; a phrase has one language
    at = best.select("phrase", F.posexplode("phrase").alias("pos", "h")).join(words, "h")
    named = at.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("name"), F.first("lang").alias("lang"))
    totals = words.where("word = ''").select("lang", F.col("n").alias("all"))
    rows = stored(best.join(named, "phrase").select("lang", F.col("name").alias("phrase"), "a", "l", "r", "score"), "scored")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
