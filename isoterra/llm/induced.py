"""Suffix sorting by recursive induction, with queues that live on disk when they are large.

The sort of one level takes the suffixes that start a descent-to-ascent turn, names the pieces between
the turns, sorts the shorter text of names by the same method, and induces all other suffixes from
there: a pass upwards for suffixes that fall at their start, a pass downwards for those that rise.

A pass is a priority queue by first symbol and, for equal symbols, by time of arrival. As the number of
suffixes per symbol is known beforehand, every symbol owns a range of slots, an arriving suffix takes
the next free slot of its symbol, and the queue is emptied in slot order. All filled slots before the
first free one are final, so they leave the queue in one vectorised batch.
"""

from __future__ import annotations

import tempfile
from contextlib import ExitStack

import numpy as np

# Arrays above this size are files that the system pages in and out.
IN_MEMORY_BYTES = 96 << 20
# Suffixes that leave a queue in one batch.
BATCH = 1 << 20


class Space:
    """Arrays in memory or, above a size, in temporary files of this task."""

    def __init__(self, in_memory: int = IN_MEMORY_BYTES):
        self.in_memory, self.stack, self.folder, self.count = in_memory, ExitStack(), None, 0

    def __enter__(self) -> Space:
        return self

    def __exit__(self, *error: object) -> None:
        self.stack.close()

    def full(self, size: int, dtype: type, value: int) -> np.ndarray:
        if size * np.dtype(dtype).itemsize <= self.in_memory:
            return np.full(size, value, dtype)
        if self.folder is None:
            self.folder = self.stack.enter_context(tempfile.TemporaryDirectory(prefix="isoterra-sort-"))
        self.count += 1
        array = np.memmap(f"{self.folder}/{self.count}", dtype, "w+", shape=size)
        for at in range(0, size, BATCH):
            array[at : at + BATCH] = value
        return array


def rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at a place is smaller than the one after it; true for the last."""
    n = len(text)
    same = np.append(text[:-1] == text[1:], False)
    places = np.arange(n)
    # A run of equal symbols goes the way of its end.
    decides = np.minimum.accumulate(np.where(same, n - 1, places)[::-1])[::-1]
    return np.append(text[:-1] < text[1:], True)[decides]


def piece_ranks(text: np.ndarray, starts: np.ndarray, symbols: int) -> np.ndarray:
    """For each piece from one start to the next, both included, the number of smaller pieces.

    Several symbols are packed into one word; only pieces that are still equal and go on are compared by
    their next words. Where one piece is the beginning of another, the longer one falls and is smaller.
    """
    bits = max(1, int(symbols).bit_length())
    packed, m = 62 // bits, len(starts)
    ends = np.append(starts[1:], starts[-1]) + 1

    def word(which: np.ndarray, n: int) -> np.ndarray:
        at, end, value = starts[which] + n * packed, ends[which], np.zeros(len(which), np.int64)
        for k in range(packed):
            inside = at + k < end
            symbol = text[np.minimum(at + k, end - 1)].astype(np.int64)
            value = (value << bits) | np.where(inside, symbol, symbols)
        return value

    first = word(np.arange(m), 0)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    ranks = np.empty(m, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    n = 1
    while True:
        longer = ends - starts > n * packed
        open_groups = np.bincount(ranks[longer], minlength=m) > 0
        open_groups &= np.bincount(ranks, minlength=m) > 1
        which = np.flatnonzero(open_groups[ranks])
        if not len(which):
            return ranks
        words = word(which, n)
        order = np.lexsort((words, ranks[which]))
        which, words = which[order], words[order]
        old, k = ranks[which], np.arange(len(which))
        group = np.append(True, old[1:] != old[:-1])
        new = group | np.append(True, words[1:] != words[:-1])
        ranks[which] = old + np.maximum.accumulate(np.where(new, k, 0)) - np.maximum.accumulate(np.where(group, k, 0))
        n += 1


def induce(space: Space, text: np.ndarray, symbols: int, wanted: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All wanted suffixes in order, from the sorted seeds; equal first symbols put wanted ones before seeds.

    Every wanted suffix stands one place before a seed or before a wanted suffix that is smaller in the
    order of the pass, so whoever leaves the queue brings in the suffix before it.
    """
    counts = np.bincount(text[wanted], minlength=symbols)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    head, total = bounds[:-1].copy(), int(bounds[-1])
    slots = space.full(total, np.int64, -1)
    seed_symbols = text[seeds]
    at = seed = 0
    while at < total or seed < len(seeds):
        end, step = at, 1024
        while end < total and end - at < BATCH:
            free = np.asarray(slots[end : end + step]) < 0
            if free.any():
                end += int(np.argmax(free))
                break
            end, step = min(end + step, total), step * 2
        # Seeds wait until all wanted suffixes of their symbol have left.
        here = int(np.searchsorted(bounds, end, "right")) - 1 if end < total else symbols
        last = int(np.searchsorted(seed_symbols, here, "left"))
        if last - seed > BATCH:
            last = seed + BATCH
            end = min(end, int(bounds[seed_symbols[last] + 1]))
        end = max(end, at)
        leaving = np.asarray(slots[at:end])
        arriving = np.asarray(seeds[seed:last])
        if len(leaving) and len(arriving):
            both = np.concatenate([leaving, arriving])
            key = text[both].astype(np.int64) * 2
            key[len(leaving) :] += 1
            leaving = both[np.argsort(key, kind="stable")]
        elif len(arriving):
            leaving = arriving
        before = leaving[leaving > 0] - 1
        before = before[wanted[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            first, before = first[order], before[order]
            k = np.arange(len(first))
            new = np.append(True, first[1:] != first[:-1])
            slots[head[first] + k - np.maximum.accumulate(np.where(new, k, 0))] = before
            runs = np.flatnonzero(new)
            head[first[runs]] += np.diff(np.append(runs, len(first)))
        at, seed = end, last
    return slots


def suffix_array(text: np.ndarray, symbols: int, space: Space) -> np.ndarray:
    """Places of all suffixes in order; the last symbol must be 0 and stand nowhere else, all are below `symbols`."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    rises = rising(text)
    turns = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    if not len(turns):
        return np.arange(n)[::-1].copy()
    ranks = piece_ranks(text, turns, symbols)
    used, names = np.unique(ranks, return_inverse=True)
    order = np.argsort(ranks, kind="stable") if len(used) == len(turns) else suffix_array(names, len(used), space)
    falling = induce(space, text, symbols, ~rises, turns[order])
    upwards = rises.copy()
    upwards[n - 1] = False
    # The pass downwards is the pass upwards with all symbols turned round.
    down = induce(space, symbols - 1 - text, symbols, upwards, falling[::-1])
    out = space.full(n, np.int64, 0)
    out[0] = n - 1
    both = np.concatenate([falling, down[::-1]])
    key = text[both].astype(np.int64) * 2
    key[len(falling) :] += 1
    out[1:] = both[np.argsort(key, kind="stable")]
    return out
