"""Minimal perfect hashes over byte keys, built in shards.

A shard's keys are hashed to 64 bits and thrown at levels of bit arrays,
twice as many bits as keys are left: a key alone on its bit settles there,
the others go on to the next level. The rank of its bit is the key's slot,
so n keys have the slots 0..n-1 without gaps. Slots keep their keys, and a
look-up compares them: a word that is no key is told apart exactly. Keys that
agree in all 64 bits never settle; they are listed, and looked up by
themselves.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from mooclens.llm.textnum import mix

LEVELS = 48
STEP = 0x9E3779B97F4A7C15
SCHEMA = "shard int, n long, sizes array<long>, bits binary, langs array<string>, terms array<string>, bytes long"


def joined(lang: str, term: str) -> bytes:
    """A key of its two parts; no term holds a NUL."""
    return lang.encode() + b"\0" + term.encode()


def hashed(keys: Iterable[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(k) for k in keys), np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _spot(hashes: np.ndarray, level: int, size) -> np.ndarray:
    return mix(hashes + np.uint64(STEP * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % size


def build(hashes: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, bits of all levels, and the order that puts settled keys
    on their slots, followed by those that never settle."""
    sizes, bits, order = [], [], []
    left = np.arange(len(hashes))
    while len(left) and len(sizes) < LEVELS:
        size = max(64, 2 * len(left) + 63 & ~63)
        spot = _spot(hashes[left], len(sizes), np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size)[spot] == 1
        level = np.zeros(size, bool)
        level[spot[alone]] = True
        order.append(left[alone][np.argsort(spot[alone])])
        left = left[~alone]
        sizes.append(size)
        bits.append(level)
    settled = np.concatenate([np.zeros(0, np.int64), *order])
    return sizes, np.concatenate([np.zeros(0, bool), *bits]), np.concatenate([settled, left])


class PerfectHash:
    """Shards put together. ``lang_slots[l]``: positions of a language's
    keys, and ``local`` each position's number among them."""

    def __init__(self, table: pa.Table, shards: int):
        self.shards = shards
        levels = max([1, *(len(x) for x in table["sizes"].to_pylist())])
        self.size = np.zeros((shards, levels), np.uint64)
        self.base = np.zeros((shards, levels), np.int64)
        at, bits, langs, terms, odd = 0, [], [], [], []
        for row in table.to_pylist():
            for k, size in enumerate(row["sizes"]):
                self.size[row["shard"], k], self.base[row["shard"], k] = size, at
                at += size
            found = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
            settled = int(found.sum())
            bits.append(found)
            langs += row["langs"][:settled]
            terms += row["terms"][:settled]
            odd += zip(row["langs"][settled:], row["terms"][settled:], strict=True)
        bits = np.concatenate([np.zeros(0, np.uint8), *bits])
        self.bits = bits.astype(bool)
        self.rank = np.cumsum(bits, dtype=np.int64) - 1
        self.odd = {joined(*x): len(terms) + k for k, x in enumerate(odd)}
        langs += [x for x, _ in odd]
        terms += [x for _, x in odd]
        self.terms = pa.array(terms, pa.large_string())
        self.keys = pa.array([joined(*x) for x in zip(langs, terms, strict=True)], pa.large_binary())
        names = np.array(langs, object)
        self.local = np.zeros(len(langs), np.int64)
        self.lang_slots = {}
        for lang in dict.fromkeys(langs):
            own = np.flatnonzero(names == lang)
            self.local[own] = np.arange(len(own))
            self.lang_slots[lang] = own

    def __len__(self) -> int:
        return len(self.keys)

    def positions(self, keys: list[bytes]) -> np.ndarray:
        """Position of each key, -1 for what is no key."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self) or not keys:
            return out
        h = hashed(keys)
        shard = shard_of(h, self.shards)
        left = np.arange(len(h))
        for level in range(self.size.shape[1]):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            spot = self.base[shard[left], level] + _spot(h[left], level, size).astype(np.int64)
            hit = self.bits[spot]
            out[left[hit]] = self.rank[spot[hit]]
            left = left[~hit]
        asked = np.flatnonzero(out >= 0)
        mine = pa.array(keys, pa.large_binary()).take(pa.array(asked))
        same = pc.equal(self.keys.take(pa.array(out[asked])), mine).to_numpy(zero_copy_only=False)
        out[asked[~same]] = -1
        if self.odd:
            for k, x in enumerate(keys):
                out[k] = self.odd.get(x, out[k])
        return out
