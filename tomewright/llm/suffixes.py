"""Suffix arrays by two-stage sorting, on symbols held in numpy arrays.

A suffix smaller than its successor (the suffix one place on) is sorted directly.
All others follow from scanning the sorted order once: when suffix i is met, the
suffix i - 1, if larger than i, is the next of its first symbol.
"""

from __future__ import annotations

import numpy as np

#: Symbols of 9 bits (bytes plus one, and 0 as separator) that fit one key.
STEP = 7


def keys(symbols: np.ndarray) -> np.ndarray:
    """The first STEP symbols of each suffix as one number; zeros past the end."""
    n = len(symbols)
    padded = np.zeros(n + STEP, np.uint64)
    padded[:n] = symbols
    out = np.zeros(n, np.uint64)
    for t in range(STEP):
        out = (out << np.uint64(9)) | padded[t : t + n]
    return out


def smaller(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor. The last one is not, as
    its successor is empty; in a run of one symbol all are as the run's last."""
    n = len(symbols)
    less = np.zeros(n, bool)
    less[:-1] = symbols[:-1] < symbols[1:]
    ends = np.ones(n, bool)
    ends[:-1] = symbols[:-1] != symbols[1:]
    at = np.flatnonzero(ends)
    return np.repeat(less[at], np.diff(at, prepend=-1))


def direct(at: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` in the order of their first ``depth`` symbols, by
    refining groups of equal keys."""
    n = len(key)
    order = at[np.argsort(key[at], kind="stable")]
    k = key[order]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new)
    for far in range(STEP, depth, STEP):
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        places = order[tied] + far
        k = np.where(places < n, key[np.minimum(places, n - 1)], np.uint64(0))
        sort = np.lexsort((k, group[tied]))
        order[tied], k, g = order[tied][sort], k[sort], group[tied][sort]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        new[tied] |= fresh
        group = np.cumsum(new)
    return order


def suffix_array(symbols: np.ndarray, depth: int, key: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` symbols at least.
    ``symbols``: numbers from 0 to 511."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    key = keys(symbols) if key is None else key
    small = smaller(symbols)
    sorted_small = direct(np.flatnonzero(small), key, depth)
    heads = symbols[sorted_small]
    top = int(symbols.max())
    cuts = np.searchsorted(heads, np.arange(top + 2))
    larger: list[list[np.ndarray]] = [[] for _ in range(top + 1)]

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = symbols[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for i, part in zip(starts.tolist(), np.split(before, starts[1:]), strict=True):
                larger[first[i]].append(part)

    induce(np.array([n]))  # the empty suffix comes first
    out: list[np.ndarray] = []
    for c in range(top + 1):
        done = 0
        while done < len(larger[c]):  # runs of c add to the bucket while it is scanned
            wave = np.concatenate(larger[c][done:])
            done = len(larger[c])
            out.append(wave)
            induce(wave)
        rest = sorted_small[cuts[c] : cuts[c + 1]]
        if len(rest):
            out.append(rest)
            induce(rest)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``order`` but the first, the symbols it shares with the
    one before: exact below ``most``, else ``most`` or a little more."""
    n = len(key)
    a, b = order[:-1], order[1:]
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    live = np.arange(len(out))
    for far in range(0, most, STEP):
        i, j = a[live] + far, b[live] + far
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        differ = key[i] ^ key[j]
        same = differ == 0
        rest = differ[~same]
        # leading equal symbols: bit length of the difference tells the first unequal one
        width = np.frexp(rest.astype(np.float64))[1]
        # a float may round up to the next power of two
        width = np.where((width > 0) & (rest < (np.uint64(1) << np.maximum(width - 1, 0).astype(np.uint64))), width - 1, width)
        out[live[~same]] += (9 * STEP - width) // 9
        live = live[same]
        out[live] += STEP
        if not len(live):
            break
    return out
