"""XXH64 of many byte ranges at once, in numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the published algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer ranges are left to the xxhash library one by one.
LONG = 512
#: Ranges at a time, so that temporary arrays stay in the cache.
CHUNK = 1 << 14


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: bytes, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each data[start : start + length]."""
    padded = np.frombuffer(data + bytes(16), np.uint8)
    at = np.ndarray((len(data) + 8,), "<u8", padded.data, strides=(1,)).astype(np.uint64)  # the 8 bytes from each place on
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(start), CHUNK):
            out[k : k + CHUNK] = _some(at, start[k : k + CHUNK].astype(np.int64), length[k : k + CHUNK].astype(np.int64), seed)
    if (length > LONG).any():
        import xxhash

        for k in np.flatnonzero(length > LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + length[k]], seed)
    return out


def _some(at: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    s = np.uint64(seed)
    acc = np.full(len(start), s + P5, np.uint64)
    place = start.copy()
    stripes = np.where(length <= LONG, length >> 5, 0)
    big = np.flatnonzero(stripes)
    if len(big):
        v = [np.full(len(big), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        left, p, live = stripes[big], start[big], np.arange(len(big))
        while len(live):
            for j in range(4):
                v[j][live] = _round(v[j][live], at[p[live] + 8 * j])
            p[live] += 32
            left[live] -= 1
            live = live[left[live] > 0]
        whole = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for j in range(4):
            whole = (whole ^ _round(np.zeros(len(big), np.uint64), v[j])) * P1 + P4
        acc[big], place[big] = whole, p
    acc += length.astype(np.uint64)
    rest = length & 31
    for j in range(3):
        k = np.flatnonzero(rest >= 8)
        if not len(k):
            break
        acc[k] = _turn(acc[k] ^ _round(np.zeros(len(k), np.uint64), at[place[k]]), 27) * P1 + P4
        place[k] += 8
        rest[k] -= 8
    k = np.flatnonzero(rest >= 4)
    acc[k] = _turn(acc[k] ^ ((at[place[k]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    place[k] += 4
    rest[k] -= 4
    for _ in range(3):
        k = np.flatnonzero(rest > 0)
        if not len(k):
            break
        acc[k] = _turn(acc[k] ^ ((at[place[k]] & np.uint64(0xFF)) * P5), 11) * P1
        place[k] += 1
        rest[k] -= 1
    acc ^= acc >> np.uint64(33)
    acc *= P2
    acc ^= acc >> np.uint64(29)
    acc *= P3
    acc ^= acc >> np.uint64(32)
    return acc
