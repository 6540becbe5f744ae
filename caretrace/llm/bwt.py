"""Burrows-Wheeler transforms of string shards, and their merge by refining an interleave."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that the first comparison takes: seven symbols of nine bits (0 ends a string) make one 63-bit number.
FIRST = 7


def _depths(limit: int) -> list[tuple[int, int]]:
    """(depth known, shift) pairs that lead from FIRST symbols to ``limit``: each step at most doubles the depth."""
    out, depth = [], min(FIRST, limit)
    while depth < limit:
        shift = min(depth, limit - depth)
        out.append((depth, shift))
        depth += shift
    return out


@dataclass
class Strings:
    """Byte strings one after the other, each with an end symbol: places are 32-bit numbers, symbols 16-bit."""

    symbols: np.ndarray  # byte + 1, 0 at ends
    ends: np.ndarray  # for each place the place of its string's end symbol
    starts: np.ndarray  # of the strings

    @classmethod
    def of(cls, strings: list[bytes]) -> Strings:
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        last = np.cumsum(sizes) - 1
        if sizes.sum() >= 1 << 30:
            raise ValueError("the strings of a merge are 1 GB or more")
        symbols = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int16)
        symbols += 1
        symbols[last] = 0
        return cls(symbols, np.repeat(last.astype(np.int32), sizes), last - sizes + 1)

    def first_keys(self, depth: int) -> np.ndarray:
        """The first ``depth`` (at most FIRST) symbols at each place as one number; nothing reaches beyond a string's end."""
        there = np.arange(len(self.symbols), dtype=np.int32)
        key = self.symbols.astype(np.int64)
        for _ in range(1, depth):
            there += 1
            np.minimum(there, self.ends, out=there)  # an end symbol follows itself
            key <<= 9
            key |= self.symbols[there]
        key <<= 9 * (FIRST - depth)
        return key


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sorted_keys), np.int32)
    np.cumsum(sorted_keys[1:] != sorted_keys[:-1], dtype=np.int32, out=out[1:])
    return out


def _pairs(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """One number for each two below ``n``, ordered as they are."""
    key = high.astype(np.int64)
    key *= n
    key += low
    return key


def shard_order(s: Strings, lo: int, hi: int, keys: np.ndarray, limit: int) -> np.ndarray:
    """Places lo..hi (whole strings) in the order of their first ``limit`` symbols, ties by place: the rows of the shard's transform."""
    ends = s.ends[lo:hi] - np.int32(lo)
    at = np.arange(hi - lo, dtype=np.int32)
    key = keys[lo:hi]
    for _, shift in [*_depths(limit), (limit, 0)]:
        order = np.argsort(key)
        rank = np.empty(hi - lo, np.int32)
        rank[order] = _ranks(key[order])
        key = _pairs(rank, rank[np.minimum(at + np.int32(shift), ends)] if shift else at, hi - lo)
    return (lo + np.argsort(key)).astype(np.int32)


@dataclass
class Merged:
    rows: np.ndarray  # places in merged order
    common: np.ndarray  # whether a row shares its first ``limit`` symbols with the row before
    bwt: np.ndarray  # the symbol before each row, 0 before a string's first


def merge(s: Strings, shards: list[np.ndarray], keys: np.ndarray, limit: int) -> Merged:
    """Merge the shards' transforms without sorting their suffixes again.

    ``shards`` are the rows of each shard's transform. The interleave of the shards is known first by FIRST symbols; what
    it says of depth t decides, row by row, the interleave of depth 2t: a row's key is its class of depth t and that of the
    suffix t symbols on. Along each shard's rows the keys never fall, so each refinement merges runs that are in order.
    Rows with the same class in the last interleave have ``limit`` symbols in common.
    """
    rows = np.concatenate(shards)
    n = len(s.symbols)
    key = keys[rows]
    del shards[:], keys  # nothing reads them again, and the merge is what needs most memory
    for _, shift in _depths(limit):
        order = np.argsort(key, kind="stable")  # merges the shards' runs
        ranks = _ranks(key[order])
        klass = np.empty(n, np.int32)
        klass[rows[order]] = ranks
        del order, ranks, key
        key = _pairs(klass[rows], klass[np.minimum(rows + np.int32(shift), s.ends[rows])], n)
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    del order
    common = np.concatenate([[False], key[1:] == key[:-1]])
    before = np.where(np.isin(rows, s.starts), 0, s.symbols[rows - 1])
    return Merged(rows, common, before)


def merged_transform(strings: list[bytes], limit: int, shard_bytes: int) -> tuple[Strings, Merged]:
    """Transform of all ``strings``: shards of whole strings with about ``shard_bytes`` are ordered, then merged."""
    s = Strings.of(strings)
    keys = s.first_keys(min(FIRST, limit))
    cuts = [0]
    for a, b in zip(s.starts.tolist(), [*s.starts[1:].tolist(), len(s.symbols)], strict=True):
        if b - cuts[-1] > shard_bytes and a > cuts[-1]:
            cuts.append(a)
    cuts.append(len(s.symbols))
    shards = [shard_order(s, a, b, keys, limit) for a, b in zip(cuts, cuts[1:], strict=False)]
    first = [keys]
    del keys
    return s, merge(s, shards, first.pop(), limit)


def repeated_starts(strings: list[bytes], limit: int, shard_bytes: int) -> np.ndarray:
    """(string, offset) of every substring of ``limit`` bytes that a string before it holds too (or the same one, before it)."""
    s, merged = merged_transform(strings, limit, shard_bytes)
    rows = merged.rows[merged.common & (s.ends[merged.rows] - merged.rows >= limit)]
    rows.sort()
    at = np.searchsorted(s.starts, rows, side="right") - 1
    return np.stack([at, rows - s.starts[at]], axis=1)
