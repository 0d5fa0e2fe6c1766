"""Byte-pair merging of many words at once.

Words of one length are rows of a matrix. In each step every row that still has a mergeable
pair merges its best one, the leftmost of equals, and so becomes shorter by one symbol: rows that go on stay one
matrix, rows without a pair are done. Pairs are looked up in an open hash table.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(0x7FFFFFFF)
_EMPTY = np.uint32(0xFFFFFFFF)
_BITS = 18


class Merger:
    def __init__(self, tokenizer, letters: dict[int, int]):
        model = json.loads(tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("a plain byte-pair model is due")
        self.first = np.array([vocab[chr(letters[b])] for b in range(256)], np.uint32)
        self.last = np.array([vocab[chr(letters[b]) + suffix] for b in range(256)], np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.key, self.rank = np.full(1 << _BITS, _EMPTY), np.full(1 << _BITS, _NONE)
        left, step = np.arange(len(key)), 0
        while len(left):
            at = self._slot(key[left], step)
            free = np.nonzero(self.key[at] == _EMPTY)[0]
            _, one = np.unique(at[free], return_index=True)  # one for each slot
            put = free[one]
            self.key[at[put]], self.rank[at[put]] = key[left[put]], left[put]
            left, step = np.delete(left, put), step + 1

    @staticmethod
    def _slot(key: np.ndarray, step: int) -> np.ndarray:
        return ((key * np.uint32(2654435769)) >> np.uint32(32 - _BITS)).astype(np.int64) + step & (1 << _BITS) - 1

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``_NONE`` where they do not merge."""
        key = a << np.uint32(16) | b
        at = self._slot(key, 0)
        held = self.key[at]
        out = np.where(held == key, self.rank[at], _NONE)
        todo, step = np.nonzero((held != key) & (held != _EMPTY)), 1
        while len(todo[0]):
            k = key[todo]
            at = self._slot(k, step)
            held = self.key[at]
            hit = held == k
            out[tuple(t[hit] for t in todo)] = self.rank[at[hit]]
            on = ~hit & (held != _EMPTY)
            todo, step = tuple(t[on] for t in todo), step + 1
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty), two bytes each."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
        for n in np.unique(size).tolist():
            index = np.nonzero(size == n)[0]
            for i in range(0, len(index), max(1, 1_000_000 // n)):
                part = index[i : i + max(1, 1_000_000 // n)]
                self._merge(flat[start[part, None] + np.arange(n)], part, out)
        return out

    def _merge(self, raw: np.ndarray, index: np.ndarray, out: list[bytes]) -> None:
        sym = self.first[raw]
        sym[:, -1] = self.last[raw[:, -1]]
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        while True:
            m = sym.shape[1]
            if m == 1:
                done = np.ones(len(sym), bool)
            else:
                p = rank.argmin(axis=1)
                best = rank[np.arange(len(rank)), p]
                done = best == _NONE
            if done.any():
                ids, k = sym[done].astype("<u2").tobytes(), 2 * m
                for j, i in enumerate(index[done].tolist()):
                    out[i] = ids[j * k : j * k + k]
                if m == 1 or done.all():
                    return
                on = ~done
                sym, rank, index, p, best = sym[on], rank[on], index[on], p[on], best[on]
            row, col = np.arange(len(sym)), np.arange(m - 1)
            sym = np.where(col <= p[:, None], sym[:, :-1], sym[:, 1:])
            sym[row, p] = self.merged[best]
            rank = np.where(col[:-1] < p[:, None], rank[:, :-1], rank[:, 1:])
            left, right = np.nonzero(p > 0)[0], np.nonzero(p < m - 2)[0]
            rank[left, p[left] - 1] = self.ranks(sym[left, p[left] - 1], sym[left, p[left]])
            rank[right, p[right]] = self.ranks(sym[right, p[right]], sym[right, p[right] + 1])
