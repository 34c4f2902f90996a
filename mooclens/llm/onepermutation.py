"""One-permutation bins shared by the fingerprint and the compressed
MinHash registers: each hash falls into one bin by its value, the bin keeps
its least hash, and empty bins borrow by optimal densification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from mooclens.llm.textnum import mix


@lru_cache(maxsize=4)
def probe_ranks(bins: int) -> np.ndarray:
    """rank[j, i]: when empty bin j asks bin i in its own fixed random order
    of all bins. Following the order to the first filled bin is the
    universal-hash probing of optimal densification, and always ends."""
    j, i = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    keys = mix(mix(j + np.uint64(0x51ED27)) + i)
    return np.argsort(np.argsort(keys, axis=1), axis=1).astype(np.uint16)


def bin_minima(sorted_set: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Filled bins and the least hash of each, from ascending distinct
    hashes: the bin is the top of the hash, so each bin is one run."""
    which = ((sorted_set >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    return which[first].astype(np.int64), sorted_set[first]


def densified(filled: np.ndarray, values: np.ndarray, bins: int) -> np.ndarray:
    """``values`` in their bins; each empty bin takes the value of the first
    filled bin in its probing order."""
    out = np.zeros(bins, values.dtype)
    empty = np.ones(bins, bool)
    empty[filled] = False
    out[filled] = values
    gaps = np.flatnonzero(empty)
    if len(gaps):
        nearest = probe_ranks(bins)[np.ix_(gaps, filled)].argmin(axis=1)
        out[gaps] = values[nearest]
    return out
