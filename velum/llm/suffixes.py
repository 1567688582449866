"""Suffix arrays by two-stage sorting, on numpy arrays.

A suffix that is smaller than the one after it is of type S, the others are of type L.
Only S suffixes are sorted by their bytes. L suffixes follow from a scan: the order of the
suffixes that start one place later is that of those with the same first byte, so going
through the buckets of first bytes in ascending order, each bucket hands the places before
its own, in its own order, to the buckets of their bytes.

Suffixes are told apart to ``DEPTH`` bytes, no further. Ties of the direct sort are broken
where a group of suffixes first differs, which prefix hashes find by bisection."""

from __future__ import annotations

import numpy as np

from velum.llm.arrays import BYTES, Stretches

DEPTH = 400


class Parts:
    """Byte strings side by side, each followed by eight zero bytes. ``starts`` of part
    ``p`` are its first ``n[p]`` places: these have ``depth`` bytes inside the part."""

    def __init__(self, parts: list[bytes], depth: int = DEPTH):
        self.depth = depth
        sizes = np.array([len(p) for p in parts], "i8")
        self.at = np.concatenate(([0], np.cumsum(sizes + 8)))[:-1]
        self.end = self.at + sizes
        data = np.frombuffer((b"\0" * 8).join(parts) + b"\0" * 16, "u1")
        self.data = data[:-8]
        n = len(self.data)
        words = np.zeros(n, "u8")
        for j in range(8):
            words |= data[j : j + n].astype("u8") << np.uint64(56 - 8 * j)
        self.words = words
        self.stretches = Stretches(BYTES[self.data])
        self.last = np.repeat(self.end, sizes + 8)
        self.starts = np.maximum(0, sizes - depth + 1)

    def types(self) -> np.ndarray:
        """Whether each place is of type S; the end of a part is smaller than any byte."""
        d, n = self.data, len(self.data)
        follow = np.concatenate((d[1:].astype("i2"), [-1]))
        follow[self.end[self.end > 0] - 1] = -1
        up, same = d < follow, d == follow
        # Of a run of equal bytes all places have the type of its last one.
        decided = np.where(same, n, np.arange(n))
        nearest = np.minimum.accumulate(decided[::-1])[::-1]
        return up[np.minimum(nearest, n - 1)]

    def members(self, small: np.ndarray) -> np.ndarray:
        """Places to sort: all starts, and from the last start of each part on the places
        up to the next one of type S, from which the L ones among the starts follow."""
        n = len(self.data)
        chosen = np.zeros(n, bool)
        change = np.zeros(n + 1, "i4")
        has = self.starts > 0
        np.add.at(change, self.at[has], 1)
        last = self.at[has] + self.starts[has] - 1
        stop = np.where(small, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        np.add.at(change, np.minimum(stop[last] + 1, self.end[has]), -1)
        chosen = np.cumsum(change[:n]) > 0
        return chosen

    def _hashes(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.stretches(place, place + length)

    def direct(self, place: np.ndarray) -> np.ndarray:
        """``place`` in the order of what follows, to ``depth`` bytes or the part's end."""
        place = place[np.argsort(self.words[place])]
        room = np.minimum(self.depth, self.last[place] - place)
        group = _runs(self.words[place])
        open_, at = place, np.arange(len(place))
        while len(open_):
            # Groups of one, and those that agree as far as they are compared, are done.
            sizes = np.bincount(group)
            keep = sizes[group] > 1
            open_, at, group = open_[keep], at[keep], group[keep]
            if not len(open_):
                break
            group = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            limit = np.minimum.reduceat(room[at], first)
            low, high = np.zeros(len(first), "i8"), limit + 1
            while (high - low > 1).any():
                middle = np.where(high - low > 1, (low + high) // 2, low)
                h = self._hashes(open_, middle[group])
                same = np.logical_and.reduceat(h == h[first][group], first)
                low, high = np.where(same, middle, low), np.where(same, high, middle)
            differ = low < np.maximum.reduceat(room[at], first)
            keep = differ[group]
            open_, at, group = open_[keep], at[keep], group[keep]
            if not len(open_):
                break
            depth = low[group]
            inside = open_ + depth < self.last[open_]
            key = np.where(inside, self.words[np.minimum(open_ + depth, len(self.words) - 1)], np.uint64(0))
            # A part that ends here is smaller than one that goes on with a zero byte.
            order = np.lexsort((inside, key, group))
            open_, key, inside, group = open_[order], key[order], inside[order], group[order]
            place[at] = open_
            room[at] = np.minimum(self.depth, self.last[open_] - open_)
            group = _runs(group, key, inside)
        return place

    def order(self) -> np.ndarray:
        """The starts of all parts in the order of their suffixes."""
        small = self.types()
        member = self.members(small)
        direct = self.direct(np.flatnonzero(member & small))
        large = member & ~small
        ready: list[list[np.ndarray]] = [[] for _ in range(256)]
        whole: list[np.ndarray] = []

        def hand_on(found: np.ndarray) -> None:
            before = found - 1
            before = before[(found > 0) & large[before]]
            if not len(before):
                return
            byte = self.data[before]
            by_byte = np.argsort(byte, kind="stable")
            before, byte = before[by_byte], byte[by_byte]
            cuts = np.concatenate(([0], np.flatnonzero(byte[1:] != byte[:-1]) + 1, [len(byte)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                ready[byte[a]].append(before[a:b])

        hand_on(self.end)
        heads = np.searchsorted(self.data[direct], np.arange(257))
        for byte in range(256):
            while ready[byte]:
                found = np.concatenate(ready[byte])
                ready[byte] = []
                whole.append(found)
                hand_on(found)
            found = direct[heads[byte] : heads[byte + 1]]
            if len(found):
                whole.append(found)
                hand_on(found)
        found = np.concatenate(whole) if whole else direct
        return found[self.is_start()[found]]

    def is_start(self) -> np.ndarray:
        change = np.zeros(len(self.data) + 1, "i4")
        np.add.at(change, self.at, 1)
        np.add.at(change, self.at + self.starts, -1)
        return np.cumsum(change[:-1]) > 0

    def classes(self, order: np.ndarray) -> np.ndarray:
        """A number for each place in ``order``, equal for neighbours whose common prefix
        has ``depth`` bytes: hashes tell most apart, the bytes decide."""
        if not len(order):
            return order
        h = self._hashes(order, np.full(len(order), self.depth))
        same = np.flatnonzero(h[1:] == h[:-1])
        a, b = order[same], order[same + 1]
        equal = np.ones(len(same), bool)
        for d in [*range(0, self.depth - 7, 8), self.depth - 8]:
            equal &= self.words[a + d] == self.words[b + d]
        new = np.ones(len(order), bool)
        new[same + 1] = ~equal
        return np.cumsum(new) - 1


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers for the runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)
