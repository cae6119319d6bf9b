"""Signature trees over sets: bitmaps and size ranges in the nodes, and a dual traversal that prunes pairs of nodes."""

from __future__ import annotations

import numpy as np

#: Bits of the trees' bitmaps, and of the widest bitmap of a large set, which has two bits a token up to there.
BITS, MOST_BITS = 1024, 1 << 17
FANOUT = 8
#: Pairs of nodes that are bounded at once, and pairs of sets whose trees are traversed together, to limit memory.
CHUNK, TOGETHER = 1 << 13, 1 << 20


def bitmap(values: np.ndarray) -> bytes:
    """The token bitmap of a set of 64-bit hashes: BITS wide or, where the set is large, the first power of two of twice its size."""
    width = min(MOST_BITS, max(BITS, 1 << (2 * values.size - 1).bit_length())) if values.size else BITS
    bits = np.zeros(width, bool)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(raw: bytes, width: int) -> np.ndarray:
    """A bitmap brought down to a narrower width: bit k stands for all k + i * width."""
    return np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, width // 64), axis=0)


def folded(bitmaps: list[bytes], width: int = BITS) -> np.ndarray:
    if all(len(x) * 8 == width for x in bitmaps):
        return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), width // 64)
    return np.stack([fold(x, width) for x in bitmaps])


def wide_fit(bitmaps: list[bytes], sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bitmaps of the pairs (a, b), at the width that both have, allow the overlap that similar sets need."""
    widths = np.array([8 * len(x) for x in bitmaps])
    width, ok = np.minimum(widths[a], widths[b]), np.ones(a.size, bool)
    for w in np.unique(width[width > BITS]).tolist():
        at = np.flatnonzero(width == w)
        own, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        x, i, j = folded([bitmaps[k] for k in own], w), place[: at.size], place[at.size :]
        for cut in range(0, at.size, max(1, (1 << 24) // w)):
            k = at[cut : cut + max(1, (1 << 24) // w)]
            u, v = x[i[cut : cut + k.size]], x[j[cut : cut + k.size]]
            most = np.minimum(sizes[a[k]] - np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64), sizes[b[k]] - np.bitwise_count(v & ~u).sum(axis=1, dtype=np.int64))
            ok[k] = most * (100 + percent) >= percent * (sizes[a[k]] + sizes[b[k]])
    return ok


class SignatureTree:
    """Trees over the sets of many buckets, one a bucket, that are traversed at once.

    Nodes hold the OR and the AND of the bitmaps below, the range of set sizes, and the group if it is one for all.
    The leaves are a bucket's sets in order of (group, size); each node above stands for up to FANOUT neighbours.
    """

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, groups: np.ndarray, buckets: np.ndarray):
        self.order = np.lexsort((sizes, groups, buckets))
        either, size, group, bucket = bitmaps[self.order], sizes[self.order].astype(np.int64), groups[self.order].astype(np.int64), buckets[self.order]
        self.levels = [(either, either, size, size, group)]
        self.below: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]  # children of a node: from, to
        while (bucket[1:] == bucket[:-1]).any():
            either, every, low, high, group = self.levels[-1]
            first = np.searchsorted(bucket, bucket)
            at = np.flatnonzero((np.arange(bucket.size) - first) % FANOUT == 0)
            least, most = np.minimum.reduceat(group, at), np.maximum.reduceat(group, at)
            self.levels.append((np.bitwise_or.reduceat(either, at, axis=0), np.bitwise_and.reduceat(every, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(least == most, least, -1)))
            self.below.append((at, np.append(at[1:], bucket.size)))
            bucket = bucket[at]

    def reach(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether a pair of sets below nodes i and j can be similar enough, the largest overlap that any pair can have).

        A set below i has at least the bits of i's AND; those that are missing from j's OR are tokens that no set
        below j has. Similar sets overlap in percent / (100 + percent) of their summed sizes at least.
        """
        either, every, low, high, group = self.levels[level]
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i]) & ((group[i] != group[j]) | (group[i] < 0))
        most = np.zeros(len(i), np.int64)
        x, y = i[ok], j[ok]
        most[ok] = np.minimum(high[x] - np.bitwise_count(every[x] & ~either[y]).sum(axis=1, dtype=np.int64), high[y] - np.bitwise_count(every[y] & ~either[x]).sum(axis=1, dtype=np.int64))
        return ok & (most * (100 + percent) >= percent * (low[i] + low[j])), most

    def pairs(self, percent: int):
        """(a, b, largest overlap) of all pairs of sets of a bucket that the bitmaps can't tell apart, of different groups only.

        They come in parts of at most CHUNK pairs, so that no more than a few parts of each level are held.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][2]))
        work, step = [(top, roots, roots)], np.arange(FANOUT)
        while work:
            level, i, j = work.pop()
            if len(i) > CHUNK:
                half = len(i) // 2
                work += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
                continue
            if level == 0:
                i, j = i[i < j], j[i < j]
            ok, most = self.reach(level, i, j, percent)
            i, j = i[ok], j[ok]
            if level == 0:
                if i.size:
                    yield self.order[i], self.order[j], most[ok]
            elif i.size:
                begin, end = self.below[level]
                a = np.broadcast_to((begin[i, None] + step)[:, :, None], (i.size, FANOUT, FANOUT))
                b = np.broadcast_to((begin[j, None] + step)[:, None, :], (i.size, FANOUT, FANOUT))
                there = (a < end[i, None, None]) & (b < end[j, None, None]) & (a <= b)
                work.append((level - 1, a[there], b[there]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (a, b) if a.size <= b.size else (b, a)
    at = np.searchsorted(large, small)
    at[at == large.size] = 0
    both = int((large[at] == small).sum())
    return both > 0 and 100 * both >= percent * (a.size + b.size - both)


def bucket_runs(buckets: np.ndarray, most: int = TOGETHER):
    """(from, to) of runs of whole buckets of rows in order of their bucket, of ``most`` pairs of a bucket's rows or a bucket more."""
    if not buckets.size:
        return
    at = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    squares = np.cumsum(np.diff(np.append(at, buckets.size)) ** 2) // most
    cut = at[np.append(True, squares[1:] != squares[:-1])].tolist()
    yield from zip(cut, [*cut[1:], buckets.size])


def link_sets(ids: list[int], sets: list[np.ndarray], buckets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (id, id) that join all sets of a bucket that a chain of similar pairs joins; verified, without loops."""
    from graphloom.llm.components import Groups

    n = len(ids)
    if n < 2:
        return []
    sizes, bitmaps = np.array([s.size for s in sets]), [bitmap(s) for s in sets]
    tree, found = SignatureTree(folded(bitmaps), sizes, np.arange(n), buckets), []
    for a, b, most in tree.pairs(percent):
        ok = wide_fit(bitmaps, sizes, a, b, percent)
        found.append((a[ok], b[ok], most[ok]))
    if not found:
        return []
    a, b, most = (np.concatenate(x) for x in zip(*found))
    joined, links = Groups(n), []
    for k in np.argsort(-most, kind="stable"):
        x, y = int(a[k]), int(b[k])
        if joined.root(x) != joined.root(y) and similar(sets[x], sets[y], percent):
            joined.join(x, y)
            links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return links
