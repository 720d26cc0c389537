"""A run-length compressed Burrows-Wheeler transform of short texts, for long common substrings.

What is common comes from the suffix sort that builds the transform, not from backward search.
"""

from __future__ import annotations

import numpy as np


class RunLengthIndex:
    """Suffixes of texts in order, kept as the runs of their Burrows-Wheeler transform.

    ``owners`` gives each text a number, the smaller the earlier. The suffixes are sorted
    by prefix doubling, every text ending in a separator of its own. Of the transform the
    runs stay: their symbols, first rows, where they lead one step to the left, and the
    text positions at both ends of a run. Of the suffixes that agree in ``length`` bytes,
    which lie next to each other, the least owner stays; prefix doubling over the whole
    texts finds them. The ends of runs are not read yet.
    """

    def __init__(self, texts: list[bytes], owners: np.ndarray, length: int):
        self.length = length
        self.sizes = np.array([len(t) for t in texts])
        m = len(texts)
        ends = np.cumsum(self.sizes + 1) - 1
        n = int(ends[-1]) + 1 if m else 0
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        owner = np.repeat(owners, self.sizes + 1)
        order, agree = self._sorted(symbols, np.repeat(ends, self.sizes + 1) - np.arange(n), n)
        # the transform, as runs of one symbol
        left = symbols[order - 1]
        left[order == 0] = 0
        first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if n else np.zeros(0, np.int64)
        self.run_start = first
        self.run_symbol = left[first]
        lengths = np.diff(np.r_[first, n])
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        target = np.empty(len(first), np.int64)
        target[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.run_target = target
        self.run_ends = order[np.r_[first, np.r_[first[1:], n] - 1]].reshape(2, -1) if n else np.zeros((2, 0), np.int64)
        group = np.flatnonzero(np.r_[True, agree[order][1:] != agree[order][:-1]]) if n else first
        self.group_start = group
        self.group_owner = np.minimum.reduceat(owner[order], group) if n else np.zeros(0, np.int64)
        self._owners = owners

    def _sorted(self, symbols: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order, and per position a number that two share iff they agree in ``length`` symbols.

        ``symbols`` are 0 at the separators, which are in the order of the texts; ``left``
        tells how many symbols are before the next one. A rank is the place of the first of the
        suffixes that agree so far. Only those that share a rank are sorted again.
        """
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        used = np.flatnonzero(np.bincount(symbols))
        code = np.searchsorted(used, np.arange(int(used[-1]) + 1))[symbols]
        bits = len(used).bit_length()
        seen = max(1, min(self.length, (63 - n.bit_length()) // bits))
        key = code.copy()
        for step in range(1, seen):  # as many symbols as fit into one number
            key <<= bits
            key[: max(0, n - step)] |= np.where(left[: max(0, n - step)] >= step, code[step:], 0)
        order, key = self._in_order(key)
        # what ends within these symbols agrees with no other, and comes in the order of the texts
        new = np.r_[True, key[1:] != key[:-1]] | (left[order] < seen)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = order[~(new & np.r_[new[1:], True])]
        agree = rank
        while len(tied):
            if seen < self.length < 2 * seen:
                agree = self._refined(rank, self.length - seen, tied)[0]
            rank, tied = self._refined(rank, seen, tied)
            seen *= 2
            if seen <= self.length:
                agree = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return order, agree

    @staticmethod
    def _in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stable order of numbers, and the numbers in it."""
        places = len(key).bit_length()
        if int(key.max()) >> (63 - places):
            order = np.argsort(key, kind="stable")
            return order, key[order]
        # with its place below it a number is sorted by itself, which takes far less than its order
        packed = np.sort((key << places) | np.arange(len(key)))
        return packed & ((1 << places) - 1), packed >> places

    def _refined(self, rank: np.ndarray, step: int, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by pairs of a position and the one ``step`` behind it, and the positions that still share one."""
        n = len(rank)
        behind = tied + step
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        order, key = self._in_order(rank[tied] * (n + 1) + second)
        tied = tied[order]
        before = rank[tied]
        at = np.arange(len(tied))
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, before[1:] != before[:-1]]
        first = np.maximum.accumulate(np.where(group, at, 0))
        out = rank.copy()
        out[tied] = before + np.maximum.accumulate(np.where(new, at, 0)) - first
        return out, tied[~(new & np.r_[new[1:], True])]

    def matches(self, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(text, start)`` of every ``length`` bytes that also start in a text of a smaller owner.

        The rows of the texts of the given numbers, by default all, are followed from right to
        left, one symbol per step. Every text is in the index itself, so no step fails and no
        matching statistic is kept: a suffix is a match if the least owner of those that agree
        with it in ``length`` bytes is smaller.
        """
        text = np.arange(len(self.sizes)) if texts is None else texts
        rows = text.copy()  # separators come first, in the order of the texts
        n = int(self.sizes.sum()) + len(self.sizes)
        run_of = np.repeat(np.arange(len(self.run_start), dtype=np.int32), np.diff(np.r_[self.run_start, n]))
        owner_of = np.repeat(self.group_owner, np.diff(np.r_[self.group_start, n]))
        jump = self.run_target - self.run_start
        found_text, found_start = [], []
        for done in range(1, int(self.sizes.max(initial=0)) + 1):
            more = self.sizes[text] >= done
            text, rows = text[more], rows[more]
            rows += jump[run_of[rows]]  # the row of the suffix one symbol longer
            if done >= self.length:
                hit = owner_of[rows] < self._owners[text]
                found_text.append(text[hit])
                found_start.append(self.sizes[text[hit]] - done)
        if not found_text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_text), np.concatenate(found_start)
