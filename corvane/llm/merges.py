"""Byte-pair merges of many short pieces at once, as numpy arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

#: Bytes of a piece at most, and pieces that are merged together: their arrays stay in a core's cache.
LONGEST = 64
TOGETHER = 8192
#: A key is rank * LONGEST + place, so that the least one is the lowest rank, leftmost; NONE stands for no merge, also less a few places.
NONE = np.int32(2**31 - 1)
LEAST_NONE = np.int32(2**31 - 1 - LONGEST)


class Merges:
    """The merges of a byte-level BPE model, applied as the library does: the lowest rank first, the leftmost of equals.

    All pieces of one length are one matrix with a column for each.  A round merges one pair of each column, so all of them
    stay equally long; columns without a pair that merges leave.  Pairs are looked up in a perfect hash table.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], alphabet: list[str]):
        self.byte = np.array([vocab[c] for c in alphabet], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._hashed(np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint64))

    @classmethod
    def of(cls, tokenizer, alphabet: list[str]) -> Merges | None:
        """Those of a tokenizer of ``tokenizers``; None if its model does more than merge."""
        model = json.loads(tokenizer.to_str())["model"]
        vocab, merges = model.get("vocab"), model.get("merges")
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        merges = list(map(tuple, merges))
        if not merges or len(set(merges)) < len(merges) or max(vocab.values()) >= 0xFFFF or not all(c in vocab for c in alphabet):
            return None
        return cls(vocab, merges, alphabet)

    def _hashed(self, pairs: np.ndarray) -> None:
        """A table of pairs without collisions: each bucket of pairs has an odd factor that spreads it over free places."""
        bits = max(4, (len(pairs) * 2).bit_length())
        self.place_shift, self.bucket_shift = np.uint64(64 - bits), np.uint64(64 + 3 - bits)
        self.factor = np.ones(1 << bits - 3, np.uint64)
        self.pair, self.rank = np.full(1 << bits, 2**32 - 1, np.uint32), np.zeros(1 << bits, np.int32)
        bucket = self._bucket(pairs)
        free, mark = np.ones(1 << bits, bool), np.zeros(1 << bits, np.int64)
        left, r = np.arange(len(pairs)), np.random.default_rng(1)
        while len(left):
            again = np.unique(bucket[left])
            self.factor[again] = r.integers(0, 2**63, len(again), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            place = (pairs[left] * self.factor[bucket[left]]) >> self.place_shift
            mark[place] = left
            bad = ~free[place] | (mark[place] != left)
            late = np.zeros(len(self.factor), bool)
            late[bucket[left[bad]]] = True
            bad = late[bucket[left]]
            free[place[~bad]] = False
            self.pair[place[~bad]], self.rank[place[~bad]] = pairs[left[~bad]], left[~bad]
            left = left[bad]

    def _bucket(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> self.bucket_shift

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        pairs = (left.astype(np.uint64) << np.uint64(16)) | right.astype(np.uint64)
        at = (pairs * self.factor.take(self._bucket(pairs).view(np.int64))) >> self.place_shift
        at = at.view(np.int64)
        return np.where(self.pair.take(at) == pairs, self.rank.take(at) * np.int32(LONGEST) + place, NONE)

    def _merged(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Columns of symbols, all merged: which columns, and their symbols."""
        which = np.arange(s.shape[1])
        k = np.array([self._keys(s[i], s[i + 1], np.int32(i)) for i in range(len(s) - 1)]).reshape(len(s) - 1, s.shape[1])
        while len(k):
            best = k.min(axis=0)
            more = best < LEAST_NONE
            live = np.flatnonzero(more)
            if len(live) < len(more):
                over = np.flatnonzero(~more)
                yield which[over], s.take(over, axis=1)
                if not len(live):
                    return
                which, best, s, k = which[live], best[live], s.take(live, axis=1), k.take(live, axis=1)
            at, made, n = best & np.int32(LONGEST - 1), self.made.take(best // np.int32(LONGEST)), len(which)
            for i in range(1, len(s) - 1):  # what stands behind the pair moves up
                behind = at < i
                np.copyto(s[i], s[i + 1], where=behind)
                if i < len(k) - 1:
                    np.copyto(k[i], k[i + 1] - np.int32(1), where=behind)
            s, k = s[:-1], k[:-1]
            symbols, keys, place = s.reshape(-1), k.reshape(-1), at.astype(np.int64) * n + np.arange(n)
            symbols[place] = made
            c = np.flatnonzero(at > 0)
            keys[place[c] - n] = self._keys(symbols.take(place[c] - n), made[c], at[c] - np.int32(1))
            c = np.flatnonzero(at < len(k))
            keys[place[c]] = self._keys(made[c], symbols.take(place[c] + n), at[c])
        yield which, s

    def ids(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``buf[start:start+size]`` of 1 to LONGEST bytes, one after another, and how many each has."""
        count, found = np.zeros(len(start), np.int64), []
        order = np.argsort(size.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(size, minlength=1))
        for n in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            for lo in range(int(ends[n - 1]), int(ends[n]), TOGETHER):
                some = order[lo : min(lo + TOGETHER, int(ends[n]))]
                at = start[some]
                for which, s in self._merged(np.array([self.byte.take(buf.take(at + i)) for i in range(n)])):
                    count[some[which]] = len(s)
                    found.append((some[which], s))
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), "<u4")
        for some, s in found:
            at = first[some]
            for i, row in enumerate(s):
                out[at + i] = row
        return out, count
