"""BagMinHash: unbiased weighted-Jaccard signatures of multisets.

Every element draws a Poisson process over time for each unit interval of its weight axis and
each of the m signature places; a place holds the earliest point of all units below the weight
of each element, so two places agree with probability sum(min) / sum(max). The weight axis is
discretised to units and arranged in dyadic blocks [0,1), [1,2), [2,4), [4,8) ...: one process
of the summed rate runs for a block, and each point descends the block's binary tree - the bits
of its position choose the halves - to one unit, counting if that unit lies below the weight.
Points come in time order and a process is dropped as soon as its time passes the largest place
of its multiset, which leaves about n + m ln m points for n elements.
"""

from __future__ import annotations

import numpy as np

from palimpsest.llm.common import mix

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def signatures(value: np.ndarray, owner: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """rows x m arrival times; a row without elements stays at infinity."""
    places = np.full(rows * m, np.inf)
    top = np.full(rows, np.inf)
    seed, row, whole, low, size = [], [], [], [], []
    block, start = 0, 0
    while len(value):
        with np.errstate(over="ignore"):
            seed.append(mix(value + _U(block + 1) * _U(0xC2B2AE3D27D4EB4F)))
        length = max(start, 1)
        row.append(owner)
        whole.append(weight)
        low.append(np.full(len(value), start, np.int64))
        size.append(np.full(len(value), length, np.int64))
        start, block = start + length, block + 1
        more = weight > start
        value, owner, weight = value[more], owner[more], weight[more]
    if not seed:
        return places.reshape(rows, m)
    seed, row, whole, low, size = map(np.concatenate, (seed, row, whole, low, size))
    time = np.zeros(len(seed))
    turn = 0
    with np.errstate(over="ignore"):
        while len(seed):
            turn += 1
            draw = mix(seed + _U(2 * turn) * _STEP)
            time = time - np.log(((draw >> _U(11)) + _U(1)).astype(np.float64) * 2.0**-53) / (size * m)
            live = time <= top[row]
            if not live.all():
                seed, row, whole, low, size, time = (x[live] for x in (seed, row, whole, low, size, time))
            draw = mix(seed + _U(2 * turn + 1) * _STEP)
            unit = low + ((draw & _U(0xFFFFFFFF)) * size.astype(np.uint64) >> _U(32)).astype(np.int64)
            place = row * m + ((draw >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            counts = unit < whole
            np.minimum.at(places, place[counts], time[counts])
            if turn <= 16 or turn % 4 == 0:
                top = places.reshape(rows, m).max(axis=1)
    return places.reshape(rows, m)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """rows x bands keys: each a hash of the band's places and number."""
    rows, m = signature.shape
    bits = signature.view(np.uint64).reshape(rows, bands, m // bands)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), (rows, bands)).copy()
        for k in range(bits.shape[2]):
            key = mix(key * _U(0x9FB21C651E98DF25) + bits[:, :, k])
    return key
