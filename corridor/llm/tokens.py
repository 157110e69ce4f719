"""Token ids of whole texts with a public tokenizer, through a memory of words.

The tokenizer treats space and line feed as separators that nothing crosses, so the ids of a text are those of its
maximal runs of other bytes, one after another.  Each worker encodes a run once and keeps its ids.
"""

from __future__ import annotations

import os

import numpy as np

from .bytehash import U64, prefix, substring
from .common import give_back

END, KEPT, SLOTS = 1, 2_000_000, 1 << 22
#: Stands between words; as one character between spaces it always gives one id of its own.
MARK = " \x01 "
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, 0x0A]] = True
_memory: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.slots = np.full(SLOTS, -1, dtype=np.int32)  # word by the low bits of its key
        self.rest, self.rest_at = np.zeros(0, U64), np.zeros(0, np.int64)  # words whose slot another one holds

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each word in the memory, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1, dtype=np.int64)
        got = self.slots[(key & U64(SLOTS - 1)).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero(self.keys[got] != key)  # -1 reads the last key: right or a miss
        got[got < 0] = -1
        if len(miss):
            got[miss] = -1
            if len(self.rest):
                p = np.minimum(np.searchsorted(self.rest, key[miss]), len(self.rest) - 1)
                hit = self.rest[p] == key[miss]
                got[miss[hit]] = self.rest_at[p[hit]]
        return got

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each), many words to a call, with a mark of one known id between them."""
        mark = np.array([self.mark], dtype=np.uint32)
        got = self.tokenizer.encode_batch_fast([MARK.join(texts[k : k + 64]) for k in range(0, len(texts), 64)], add_special_tokens=False)
        flat = np.concatenate([y for x in got for y in (np.array(x.ids, dtype=np.uint32), mark)]) if got else np.zeros(0, np.uint32)
        ends = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(np.append(-1, ends)) - 1

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        odd = np.array([MARK[1] in x for x in texts], dtype=bool)
        flat, size = self._ids([x for x, o in zip(texts, odd.tolist(), strict=True) if not o])
        if odd.any():
            own = [x.ids for x in self.tokenizer.encode_batch([x for x, o in zip(texts, odd.tolist(), strict=True) if o], add_special_tokens=False)]
            keys = np.concatenate([keys[~odd], keys[odd]])
            flat = np.concatenate([flat, np.array([y for x in own for y in x], dtype=np.uint32)])
            size = np.concatenate([size, np.array([len(x) for x in own], dtype=np.int64)])
        n = len(self.keys)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size, self.keys, self.flat = np.concatenate([self.size, size]), np.concatenate([self.keys, keys]), np.concatenate([self.flat, flat])
        slot = (keys & U64(SLOTS - 1)).astype(np.int64)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = n + np.flatnonzero(free)
        lost = np.flatnonzero(self.slots[slot] != n + np.arange(len(keys)))
        if len(lost):
            rest, at = np.concatenate([self.rest, keys[lost]]), np.concatenate([self.rest_at, n + lost])
            order = np.argsort(rest)
            self.rest, self.rest_at = rest[order], at[order]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END; number of ids of each text)."""
        docs = len(off) - 1
        solid = ~_BREAK[data]
        before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
        filled = off[1:] > off[:-1]
        before[off[:-1][filled]] = False
        after[off[1:][filled] - 1] = False
        s, e = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        d = np.searchsorted(off, s, side="right") - 1
        key = substring(prefix(data), s, e)
        if len(self.keys) > KEPT:
            self._clear()
        w = self._find(key)
        new = np.flatnonzero(w < 0)
        if len(new):
            u, first = np.unique(key[new], return_index=True)
            first = new[first]
            raw = data.tobytes()
            self._learn(u, [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
            w[new] = self._find(key[new])
        at, size = self.at[w], self.size[w]
        count = np.bincount(d, weights=size, minlength=docs).astype(np.int64) + 1
        out = np.full(count.sum(), END, dtype=np.uint32)
        total = int(size.sum())
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.arange(total) + np.repeat(d, size)] = self.flat[np.repeat(at, size) + within]
        return out, count


def word_ids(path: str) -> WordIds:
    if path not in _memory:
        _memory[path] = WordIds(path)
    return _memory[path]


def forget() -> None:
    """Lets go of every tokenizer and its words; a worker would hold them through the operators that come after."""
    if _memory:
        _memory.clear()
        give_back()
