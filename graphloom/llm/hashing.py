"""Vectorised 64-bit hashing of words, shingles and phrases; the same on every machine and run."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Multipliers of Steele, Lea and Flood's SplitMix64 finaliser (fixed values).
GOLDEN, MIX_1, MIX_2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Bytes that separate words: space and \x09 to \x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> _U(30))) * MIX_1
        x = (x ^ (x >> _U(27))) * MIX_2
        return x ^ (x >> _U(31))


_PLACES = mix(np.arange(4096, dtype=_U)) | _U(1)


def places(n: int) -> np.ndarray:
    """Odd multipliers of the first n places."""
    global _PLACES
    if n > _PLACES.size:
        _PLACES = mix(np.arange(max(n, 2 * _PLACES.size), dtype=_U)) | _U(1)
    return _PLACES[:n]


def multilinear(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run values[starts[k]:ends[k]]; runs are not empty and ascend without overlap."""
    if not starts.size:
        return np.zeros(0, _U)
    lengths = ends - starts
    total = int(lengths.sum())
    offset = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(offset, lengths)
    taken = values if total == values.size else values[place + np.repeat(starts, lengths)]
    with np.errstate(over="ignore"):
        terms = (taken.astype(_U) + _U(1)) * places(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, offset) + mix(lengths.astype(_U)))


#: Odd base of the words' polynomial hash and its inverse modulo 2**64 (fixed values), and a number for each byte.
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=_U) + _U(9000))[LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if n > _POWERS[0].size:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(max(n, 1 << 16), base, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the rows, the n + 1 offsets of the rows' words).

    ``raw`` holds the UTF-8 bytes of the rows and ``offsets`` where they begin. A word is a run of bytes outside
    SEPARATOR; A-Z count as a-z. A word's hash is its polynomial in _BASE, taken as a difference of running sums.
    """
    rows = offsets.size - 1
    if not raw.size:
        return np.zeros(0, _U), np.zeros(rows + 1, np.int64)
    inside = ~SEPARATOR[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last)
    up, down = _powers(raw.size + 1)
    with np.errstate(over="ignore"):
        terms = _BYTE[raw]
        terms *= up[: raw.size]
        sums = np.add.accumulate(terms)
        before = np.where(starts > 0, sums[starts - 1], _U(0))
        hashed = mix((sums[ends] - before) * down[starts] + (ends - starts).astype(_U) * MIX_1)
    return hashed, np.searchsorted(starts, offsets)


def word_chunks(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 19):
    """(first row, hashes, word offsets) of runs of whole rows of about ``most`` bytes, to bound what is in memory."""
    rows, at = offsets.size - 1, 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        hashed, where = words(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        yield at, hashed, where
        at = to


_SHINGLE = mix(np.arange(77, 77 + 64, dtype=_U)) | _U(1)


def shingle_sets(hashed: np.ndarray, where: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's shingles of ``size`` words; a shorter row is one shingle, an empty row none."""
    with np.errstate(over="ignore"):
        n = hashed.size - size + 1
        if n > 0:
            rolled = hashed[:n] * _SHINGLE[0]
            for k in range(1, size):
                rolled += hashed[k : k + n] * _SHINGLE[k]
            rolled = mix(rolled)
        out = []
        for a, b in zip(where[:-1], where[1:]):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                out.append(mix((hashed[a:b] * _SHINGLE[: b - a]).sum(keepdims=True) + _U(b - a)))
            else:
                out.append(np.zeros(0, _U))
        return out


def set_key(values: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set of hashes, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(values ^ _U(0x5851F42D4C957F2D)).sum(), mix(values ^ _U(0x14057B7EF767814F)).sum()
    return int(np.int64(a)), int(np.int64(b))


def set_bytes(values: np.ndarray) -> bytes:
    """The high 48 bits of sorted hashes: enough to compare two sets, and a quarter less to move."""
    return np.unique(values >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def bytes_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()
