"""Sums of products of rows with many queries where the rows stand, of which each query's k best go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Products, and sums, that are in memory at once.
PRODUCTS, SUMS = 1 << 21, 1 << 22


class Best:
    """A task's k best rows of each query: what can't be among them after rounding is left out, equals stay.

    Queries are (query, code, factor): numbers of queries and of entries, and what an entry's value is multiplied with.
    """

    def __init__(self, query: np.ndarray, code: np.ndarray, factor: np.ndarray, queries: int, codes: int, k: int, slack: float = 2e-6):
        order = np.argsort(code, kind="stable")
        self.query, self.factor = query[order].astype(np.int64), factor[order]
        self.start = np.searchsorted(code[order], np.arange(codes + 1))
        self.queries, self.k, self.slack = queries, k, slack
        self.best = np.full((k, queries), -np.inf)

    def add(self, row: np.ndarray, code: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, sum) of entries (row, code, value) in the order of rows; a row comes in one call."""
        width = np.diff(self.start)[code]
        ends, at, n = np.cumsum(width), 0, len(row)
        while at < n:
            to = np.searchsorted(row, row[at] + max(1, SUMS // self.queries))
            to = min(to, np.searchsorted(ends, ends[at] - width[at] + PRODUCTS, "right"))
            if to < n:  # rows stay whole
                begin = np.searchsorted(row, row[to])
                to = begin if begin > at else np.searchsorted(row, row[at], "right")
            yield self._piece(row[at:to] - row[at], code[at:to], value[at:to], width[at:to], row[at])
            at = to

    def _piece(self, row: np.ndarray, code: np.ndarray, value: np.ndarray, width: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = np.repeat(np.arange(len(row)), width)
        entry = self.start[code][each] + np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
        cell, size = row[each] * self.queries + self.query[entry], (row[-1] + 1) * self.queries
        sums, seen = np.bincount(cell, value[each] * self.factor[entry], size), np.zeros(size, bool)
        seen[cell] = True
        sums = np.where(seen, sums, -np.inf).reshape(-1, self.queries)
        both = np.concatenate([self.best, sums])
        self.best = np.partition(both, len(both) - self.k, axis=0)[-self.k :]
        found, query = np.nonzero(seen.reshape(sums.shape) & (sums >= self.best.min(axis=0) - self.slack))
        return found + base, query, sums[found, query]
