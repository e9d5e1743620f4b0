"""The best rows of each query within a task, kept while its batches pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores of a strip of rows by all queries of a block.
SCORES = 1 << 20


def strips(n_rows: int, n_queries: int) -> Iterator[tuple[int, int]]:
    """Start and length of strips of rows whose scores by all queries are few enough."""
    step = max(1, SCORES // max(n_queries, 1))
    return ((at, min(step, n_rows - at)) for at in range(0, n_rows if n_queries else 0, step))


class Best:
    """The k best ids of each of ``n_queries``: scores that agree to nine places are ties, of which the smallest ids stay."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.n_queries = k, n_queries
        self._least, self._held, self._n = np.full(n_queries, -np.inf), [], 0

    def add(self, ids: pa.Array, scores: np.ndarray, matched: np.ndarray | None = None) -> None:
        """Rows by queries; only those ``matched`` count, if given."""
        order = np.round(scores, 9)
        keep = order >= self._least
        if matched is not None:
            keep &= matched
        if len(order) > self.k and np.count_nonzero(keep) > 4 * self.k * self.n_queries:
            order = np.where(keep, order, -np.inf)
            keep &= order >= np.partition(order, len(order) - self.k, axis=0)[len(order) - self.k]  # all ties of the k-th best go on
        i, j = np.nonzero(keep)
        if len(i):
            self._held.append((j, ids.take(pa.array(i)), scores[i, j]))
            self._n += len(i)
        if self._n > max(8 * self.k * self.n_queries, 1 << 16):
            self._cut()

    def _cut(self) -> None:
        j, scores = (np.concatenate([h[x] for h in self._held]) for x in (0, 2))
        ids, order = pa.concat_arrays([h[1] for h in self._held]), np.round(scores, 9)
        place = pc.rank(ids, tiebreaker="first", null_placement="at_start").to_numpy()
        turn = np.lexsort((place, -order, j))
        nth = np.arange(len(turn)) - np.searchsorted(j[turn], j[turn])
        last = turn[nth == self.k - 1]
        self._least[j[last]] = order[last]
        turn = turn[nth < self.k]
        self._held, self._n = [(j[turn], ids.take(pa.array(turn)), scores[turn])], len(turn)

    def batches(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """``qid``, ``id`` and ``score`` of what is left; ``names`` are the queries."""
        if self._held:
            self._cut()
            j, ids, scores = self._held[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), ids, pa.array(scores)], ["qid", "id", "score"])
