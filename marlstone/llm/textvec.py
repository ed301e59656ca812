"""Vectorised words, hashes and shingles over a run of UTF-8 documents (numpy, no per-word Python)."""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
#: Words up to this many bytes are hashed in blocks of eight, all words at once; longer ones one by one.
SHORT = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_LANES = (b"marlstone-0", b"marlstone-1")
_SEEDS = np.array([int.from_bytes(hashlib.blake2b(lane, digest_size=8).digest(), "little") for lane in _LANES], U64)
_ODD, _ADD = U64(0xD6E8FEB86659FD93), U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that any bits of a hash can serve as a bucket."""
    return _mixed(h.copy())


def _mixed(h: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def byte_class(members, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is member by byte, value by byte); with ``lower`` A-Z count as a-z."""
    value = np.arange(256, dtype=np.uint8)
    if lower:
        value[65:91] += 32
    inside = np.zeros(256, bool)
    for b in range(256):
        inside[b] = bool(members(int(value[b])))
    return inside, value


#: Words are runs of anything but ASCII white space.
SPACED = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))
SPACED_LOWER = byte_class(lambda b: not (b == 32 or 9 <= b <= 13), lower=True)
#: Words are runs of digits, letters and everything beyond ASCII.
ALNUM_LOWER = byte_class(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122, lower=True)


def words(data: np.ndarray, offsets: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each document (one entry more than documents)."""
    inside = kind[0][data]
    n = len(data)
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.empty(n + 1, bool)
    after[:n] = inside
    after[n] = False
    after[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros beyond the end); a view of a padded copy."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbours' hashes, in order."""
    h = a * _ODD
    h += _ADD
    h ^= b
    return _mixed(h)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; the two lanes together are one of 128 bits.

    Eight bytes at a time are chained through a finaliser, so no algebraic pattern of letters (as
    sums of powers have) makes words collide; long words go through BLAKE2 keyed by lane.
    """
    value = kind[1][data]
    eight, size = eight_bytes(value), ends - starts
    h = joined(size.astype(U64), _SEEDS[lane])
    own, at, left, out = None, starts, size, h
    for _ in range(0, SHORT, 8):
        h = joined(h, eight[at] & _MASKS[np.minimum(left, 8)])
        if own is None:
            out = h
        else:
            out[own] = h
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        own = more if own is None else own[more]
        h, at, left = h[more], at[more] + 8, left[more] - 8
    raw = value.tobytes()
    for k in own.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8, key=_LANES[lane]).digest(), "little")
    return out


def window_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` symbols (hashes of words); fewer symbols give none.

    Runs of 2, 4, ... symbols are each made of two halves; two of the greatest such length cover a window
    and may overlap.
    """
    if len(symbols) < length:
        return np.zeros(0, U64)
    whole, size = symbols, 1
    while 2 * size <= length:
        whole, size = joined(whole[:-size], whole[size:]), 2 * size
    n = len(symbols) + 1 - length
    return joined(whole[:n], whole[length - size : length - size + n] + U64(length))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = np.minimum(out[:-step], out[step:])
    return out
