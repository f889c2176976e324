"""Bit-sliced Hamming comparison and spanning forests, on numpy arrays."""

from __future__ import annotations

import numpy as np


def planes(fingerprints: np.ndarray, spare: int) -> np.ndarray:
    """Bit planes of an (n, bytes) uint8 array: row p holds bit p of all n, 64 to a word.

    ``spare`` zero words follow, so that shifted reads stay inside.
    """
    n = len(fingerprints)
    bits = np.unpackbits(fingerprints, axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((bits.shape[0], (n + 63) // 64 + spare), np.uint64)
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def _unpack(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pairs_within(fingerprints: np.ndarray, later: np.ndarray, radius: int):
    """Yield (i, j, distance) arrays of the pairs of one group at most ``radius`` bits apart.

    Rows of a group are adjacent and ``later[i]`` is the number of rows of its group after row i.
    Row i is compared with row i + s for each s, for 64 rows a word at once: the XOR of a plane with
    itself shifted by s is added to carry-save counters, which start so that they overflow just
    beyond ``radius``; blocks of 64 pairs that have all overflown are abandoned.
    """
    width = max(1, int(radius).bit_length())
    bias = (1 << width) - 1 - radius
    longest = int(later.max(initial=0))
    sliced = planes(fingerprints, longest // 64 + 2)
    rows = np.flatnonzero(later > 0)
    for s in range(1, longest + 1):
        rows = rows[later[rows] >= s]
        at, where = np.unique(rows >> 6, return_inverse=True)
        inside = np.zeros((len(at), 64), np.uint8)
        inside[where, rows & 63] = 1
        alive = np.packbits(inside, axis=1, bitorder="little").view(np.uint64).ravel()
        counters = [np.full(len(at), ~np.uint64(0) if bias >> c & 1 else np.uint64(0)) for c in range(width)]
        skip, shift = s >> 6, np.uint64(s & 63)
        back = np.uint64(64) - shift
        for p, plane in enumerate(sliced):
            other = plane[at + skip] >> shift
            if shift:
                other |= plane[at + skip + 1] << back
            carry = plane[at] ^ other
            for c in range(width):
                total = counters[c] ^ carry
                carry &= counters[c]
                counters[c] = total
            alive &= ~carry
            if p % 8 == 7:
                keep = alive != 0
                if not keep.all():
                    at, alive, counters = at[keep], alive[keep], [c[keep] for c in counters]
                    if not len(at):
                        break
        if len(at):
            block, bit = np.nonzero(_unpack(alive))
            i = at[block] * 64 + bit
            distance = sum(_unpack(c)[block, bit].astype(np.int64) << k for k, c in enumerate(counters)) - bias
            yield i, i + s, distance


def rows_within(fingerprints: np.ndarray, queries: int, radius: int):
    """Yield (i, j) arrays of pairs i < j at most ``radius`` bits apart with i among the first ``queries`` rows.

    For large groups: 64 queries at a time meet all later rows, 64 rows a word.  The counters work as in ``pairs_within``,
    and blocks of a query and 64 rows that have all overflown are abandoned.
    """
    width = max(1, int(radius).bit_length())
    bias = (1 << width) - 1 - radius
    sliced = planes(fingerprints, 0)
    bits = np.unpackbits(fingerprints[:queries], axis=1, bitorder="little").astype(bool)
    inside = np.zeros(sliced.shape[1] * 64, np.uint8)
    inside[: len(fingerprints)] = 1
    inside = np.packbits(inside, bitorder="little").view(np.uint64)
    for first in range(0, queries, 64):
        asked = np.arange(first, min(first + 64, queries))
        words = np.arange(first >> 6, sliced.shape[1])
        query, at = np.repeat(asked, len(words)), np.tile(words, len(asked))
        alive = inside[at]
        counters = [np.full(len(at), ~np.uint64(0) if bias >> c & 1 else np.uint64(0)) for c in range(width)]
        for p, plane in enumerate(sliced):
            carry = np.where(bits[query, p], ~plane[at], plane[at])
            for c in range(width):
                total = counters[c] ^ carry
                carry &= counters[c]
                counters[c] = total
            alive &= ~carry
            if p % 16 == 15 and p > radius:
                keep = alive != 0
                if not keep.all():
                    query, at, alive, counters = query[keep], at[keep], alive[keep], [c[keep] for c in counters]
                    if not len(at):
                        break
        if len(at):
            block, bit = np.nonzero(_unpack(alive))
            i, j = query[block], at[block] * 64 + bit
            yield i[j > i], j[j > i]


def forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the edges of a minimum spanning forest (small integer weights) over n nodes."""
    root, chosen = np.arange(n), []
    for w in np.unique(weight):
        left = np.flatnonzero(weight == w)
        while True:
            x, y = root[a[left]], root[b[left]]
            left = left[x != y]
            if not len(left):
                break
            x, y = root[a[left]], root[b[left]]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            chosen.append(left[first])
            to = np.arange(n)
            to[high] = np.minimum(x, y)[first]  # each hooks to a smaller one, so no cycle arises
            while True:
                further = to[to]
                if (further == to).all():
                    break
                to = further
            root = to[root]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
