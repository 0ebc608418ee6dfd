"""Suffix order by induced sorting with bucket queues that spill to disk.

Suffixes that start a descent (S*) are sorted first; the order of all others
is induced from them bucket by bucket, by queues whose blocks of positions
move to an unlinked scratch file beyond a memory budget.  A bucket's suffixes
are taken in whole blocks, so each step is a numpy operation.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .neardup import RADIX, powers

#: Bytes from 1 on, and 0: the end of a text.
SYMBOLS = 257


class BucketQueues:
    """For each symbol a queue of blocks; all are drained in key order, so they form a priority queue."""

    def __init__(self, budget: int):
        self.blocks: list[list] = [[] for _ in range(SYMBOLS)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, positions: np.ndarray, keys: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(keys, kind="stable")
        positions, keys = positions[order], keys[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for block, at in zip(np.split(positions, cuts), [0, *cuts.tolist()], strict=True):
            self.blocks[keys[at]].append(self._kept(block))

    def _kept(self, block: np.ndarray):
        if self.held + block.nbytes <= self.budget:
            self.held += block.nbytes
            return block
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(block.tobytes())
        return at, len(block)

    def drain(self, key: int) -> np.ndarray:
        out = []
        for block in self.blocks[key]:
            if isinstance(block, tuple):
                self.file.seek(block[0])
                out.append(np.frombuffer(self.file.read(block[1] * 8), np.int64))
            else:
                self.held -= block.nbytes
                out.append(block)
        self.blocks[key] = []
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last, a sentinel, counts as such)."""
    step = np.sign(np.diff(text.astype(np.int16)))
    n = len(text)
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.where(at < n - 1, np.append(step, 1)[at] > 0, False)
    return out


def induce(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, budget: int) -> np.ndarray:
    """All suffixes in order, given the S* suffixes in order (sorted within each first symbol)."""
    falling: list[np.ndarray] = []
    keys = text[seeds]
    by_key = [seeds[keys == c] for c in range(SYMBOLS)]
    queues = BucketQueues(budget)

    def before(front: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        own = front[front > 0] - 1
        own = own[up[own] == kind]
        return own, text[own]

    for c in range(SYMBOLS):
        front, out = queues.drain(c), []
        while len(front):
            out.append(front)
            own, key = before(front, False)
            queues.push(own[key > c], key[key > c])
            front = own[key == c]
        falling.append(np.concatenate(out) if out else np.zeros(0, np.int64))
        queues.push(*before(by_key[c], False))
    queues.close()
    queues, parts = BucketQueues(budget), []
    for c in range(SYMBOLS - 1, -1, -1):
        front, out = queues.drain(c), []
        while len(front):
            out.append(front)
            own, key = before(front, True)
            queues.push(own[key < c], key[key < c])
            front = own[key == c]
        queues.push(*before(falling[c][::-1], True))
        if c == 0:
            out.append(np.array([len(text) - 1]))
        parts.append(np.concatenate(out)[::-1] if out else np.zeros(0, np.int64))
        parts.append(falling[c])
    queues.close()
    return np.concatenate(parts[::-1])


def ranked(names: np.ndarray, least: int) -> np.ndarray:
    """Rank of each suffix of ``names`` by its first ``least`` names at least; equal ones share a rank.

    The reduced string has a large alphabet; it is ranked by doubling.
    """
    rank, k, n = names.astype(np.int64), 1, len(names)
    while k < least and int(rank.max()) < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank[order] = fresh
        k *= 2
    return rank


def suffix_order(text: np.ndarray, least: int, budget: int = 64 << 20) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, exact for the first ``least`` symbols.

    Symbols are bytes plus 1; a 0 ends each text, none of which is empty, and all.
    """
    up = rising(text)
    starts = np.flatnonzero(up & ~np.concatenate([[True], up[:-1]]))
    if len(starts) > 1:
        order = induce(text, up, starts, budget)
        place = np.full(len(text), -1, np.int64)
        place[starts] = np.arange(len(starts))
        order = place[order]
        order = order[order >= 0]  # S* in the order of the pieces up to the next S*
        with np.errstate(over="ignore"):
            power = powers(RADIX, len(text) + 1)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
            ends = np.append(starts[1:] + 1, len(text))
            a, b = starts[order], ends[order]
            x, y = prefix[b] - prefix[a], b - a
            high = np.maximum(a[1:], a[:-1])
            same = (y[1:] == y[:-1]) & (x[1:] * power[high - a[1:]] == x[:-1] * power[high - a[:-1]])
        names = np.empty(len(starts), np.int64)
        names[order] = np.concatenate([[0], np.cumsum(~same)])
        starts = starts[np.argsort(ranked(names, least), kind="stable")]
    return induce(text, up, starts, budget)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` have ``least`` (8 or more) bytes in common. ``text`` reaches that far behind both."""
    words = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text).data, strides=(1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, least - 8, 8), least - 8]:
        same &= words[a + k] == words[b + k]
    return same
