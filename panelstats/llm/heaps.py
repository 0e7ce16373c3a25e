"""Lists of the best few per key: kept in a task, and merged over tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists that one merge takes from as many tasks.
WIDTH = 256


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` keys: greater scores first, then lesser ids.

    Equal pairs count ``once``, or each for itself.
    """

    def __init__(self, n: int, k: int, once: bool = True) -> None:
        self.k, self.once = k, once
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)  # the kth score of a key that has as many

    def push(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Add candidates; those under the kth score of their key may be left out by the caller."""
        key, score, ids = np.r_[self.key, key], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        if len(key):
            if self.once:
                new = np.r_[True, (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]
                key, score, ids = key[new], score[new], ids[new]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
            full = place == self.k - 1
            self.least[key[full]] = score[full]
            key, score, ids = (x[place < self.k] for x in (key, score, ids))
        self.key, self.score, self.id = key, score, ids


def merged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, part: str, parts: int, once: bool = True) -> DataFrame:
    """The first ``k`` rows of each key in the given order, of lists that ``part`` (0 to ``parts`` - 1) tells apart.

    At most ``WIDTH`` lists of a key meet in a group; their best go on to the next round.  Equal rows count ``once``,
    or each for itself.
    """
    while True:
        parts = -(-parts // WIDTH)
        rows = rows.withColumn(part, F.floor(F.col(part) / WIDTH).cast("long"))
        rows = rows.distinct() if once else rows
        place = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
        rows = rows.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
        if parts <= 1:
            return rows.drop(part)
