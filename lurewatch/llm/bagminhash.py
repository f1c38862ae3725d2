"""BagMinHash signatures: unbiased estimates of the weighted Jaccard similarity of multisets.

Weights are counts, discretised into whole units; the range of weights is cut
into intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on.  Every element owns a
Poisson process for each interval, of a rate equal to the interval's length.
A point has a time, a register and a place in the interval; halving the
interval again and again down to one unit (the bits of the place) gives the
hierarchy of finer processes, and a point counts for a document if its unit
lies below the element's weight there.  A register holds its earliest point,
so two documents agree in a register with probability
``sum(min(weights)) / sum(max(weights))``.

Points come in order of time.  A document takes all points up to a time that
likely fills its registers, and goes on only while one is empty: later points
can't change anything.  The work follows the number of registers, not the
weights.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of documents laid end to end, and runs of each document.

    A document of fewer words has one run, all of it; one without words has none.
    """
    words = words.view(np.uint64)
    ends = np.cumsum(counts)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.repeat(ends - counts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    length = np.repeat(np.minimum(counts, width), runs)
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(width):
        here = length > k
        out[here] = mix(out[here] + words[starts[here] + k] + np.uint64(k))
    return out, runs


def weigh(hashes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each document: document, element, weight."""
    doc = np.repeat(np.arange(len(runs)), runs)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Times of the earliest points: n_docs x registers (infinite for documents without elements)."""
    # one process for each element and interval that begins below its weight
    seeds, lows, highs, owners, tops = [], [], [], [], []
    low, high = 0, 1
    while True:
        here = weight > low
        if not here.any():
            break
        seeds.append(mix(element[here] ^ mix(np.full(1, high, dtype=np.uint64))))
        lows.append(np.full(here.sum(), low))
        highs.append(np.full(here.sum(), high))
        owners.append(doc[here])
        tops.append(weight[here])
        low, high = high, 2 * high
    out = np.full((n_docs, registers), np.inf)
    if not seeds:
        return out
    seed, low, high, owner, top = map(np.concatenate, (seeds, lows, highs, owners, tops))
    rate = (high - low).astype(np.float64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    horizon = registers * (np.log(registers) + 3) / np.maximum(total, 1)
    flat = out.reshape(-1)
    time = np.zeros(len(seed))
    count = np.zeros(len(seed), dtype=np.uint64)
    active = np.arange(len(seed))
    # the next point of every process, drawn before it is known to fall within the horizon
    draw = lambda at: -np.log(((mix(seed[at] + count[at] * _C) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate[at]
    time[active] = draw(active)
    while len(active):
        now = active
        while len(now := now[time[now] < horizon[owner[now]]]):
            bits = mix(mix(seed[now] + count[now] * _C) ^ _B)
            register = (bits % np.uint64(registers)).astype(np.int64)
            unit = low[now] + ((mix(bits) >> np.uint64(11)).astype(np.float64) / 2.0**53 * rate[now]).astype(np.int64)
            counts = unit < top[now]
            np.minimum.at(flat, owner[now][counts] * registers + register[counts], time[now][counts])
            count[now] += np.uint64(1)
            time[now] += draw(now)
        unfilled = np.isinf(out).any(axis=1)
        active = active[unfilled[owner[active]]]
        horizon[unfilled] *= 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Band hashes (documents x bands) of a signature."""
    bits = np.ascontiguousarray(signature).view(np.uint64)
    n = bits.shape[1] // rows
    out = np.repeat(np.arange(1, n + 1, dtype=np.uint64)[None, :], len(bits), axis=0)
    for r in range(rows):
        out = mix(out ^ bits[:, r : n * rows : rows])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sums of the minima and the maxima of two multisets given as arrays of hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least, len(a) + len(b) - least
