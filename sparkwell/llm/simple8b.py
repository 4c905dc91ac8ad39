"""Simple-8b coding of unsigned integers in numpy, many blocks at a time.

A word has a 4-bit selector in its top bits and 60 bits of data. Selector ``s`` in 1..14 packs
``COUNTS[s]`` values of ``WIDTHS[s]`` bits, the first value lowest. Selector 15 is the escape: its
word carries nothing and the next word is one whole 64-bit value. Every block of ``BLOCK`` values
starts on a word of its own, so that blocks can be decoded alone and all at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the format: values in a word and bits of each, by selector.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15


def _searched(values: np.ndarray) -> np.ndarray:
    limits = np.array([(1 << int(w)) - 1 for w in WIDTHS[1:15]], np.uint64)
    return (np.searchsorted(limits, values, side="left") + 1).astype(np.uint8)


SMALL = _searched(np.arange(1 << 17, dtype=np.uint64))


def _classes(values: np.ndarray) -> np.ndarray:
    """The first selector whose width holds each value."""
    if len(values) and values.max() < len(SMALL):
        return SMALL[values]
    return _searched(values)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, index of each block's first word int64)."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + 64), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = values
    padded[:, :BLOCK] = full.reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK

    # The largest class within the next c values, for each c, from maxima over powers of two.
    power = {1: _classes(padded.ravel()).reshape(padded.shape)}
    for p in (1, 2, 4, 8, 16):
        shifted = np.ones_like(power[p])
        shifted[:, : -p] = power[p][:, p:]
        power[2 * p] = np.maximum(power[p], shifted)
    best = np.where(power[1] == ESCAPE, ESCAPE, 14).astype(np.uint8)
    for s in range(13, 0, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        over = np.ones_like(power[p])
        over[:, : power[p].shape[1] - (c - p)] = power[p][:, c - p :]
        fits = np.maximum(power[p], over) <= s
        if fits.any():
            np.copyto(best, np.uint8(s), where=fits)

    # Follow all blocks' words side by side.
    at, live, seen = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        chosen = best[live, at[live]]
        seen.append((live, at[live], chosen))
        at[live] += COUNTS[chosen]
        live = live[at[live] < size[live]]
    block, start, chosen = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.argsort(block, kind="stable")
    block, start, chosen = block[order], start[order], chosen[order]

    place = np.cumsum(1 + (chosen == ESCAPE)) - 1 - (chosen == ESCAPE)
    words = np.zeros(int(place[-1]) + 1 + int(chosen[-1] == ESCAPE), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[rows] + 1] = padded[block[rows], start[rows]]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        inside = start[rows, None] + np.arange(c)
        taken = np.where(inside < BLOCK, padded[block[rows, None], inside], 0)
        words[place[rows]] |= np.bitwise_or.reduce(taken << (np.arange(c) * w).astype(np.uint64), axis=1)
    first = place[np.searchsorted(block, np.arange(blocks))]
    return words, first.astype(np.int64)


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that ``encode`` coded."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):  # rare: values of over 60 bits, and words after them that look alike
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.where(raw, 0, counts)
    blocks = len(first)
    block = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    upto = np.cumsum(counts) - counts
    inside = upto - upto[first][block]
    out = np.zeros((blocks, BLOCK + 64), np.uint64)
    for s in np.unique(selector[~raw]):
        rows = np.flatnonzero((selector == s) & ~raw)
        if s == ESCAPE:
            out[block[rows], inside[rows]] = words[rows + 1]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        values = (words[rows, None] >> (np.arange(c) * w).astype(np.uint64)) & np.uint64((1 << w) - 1)
        out[block[rows, None], inside[rows, None] + np.arange(c)] = values
    return out[:, :BLOCK].reshape(-1)[:n]
