"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice.

The lattice of a text has a node between any two bytes and an edge for every vocabulary piece that matches
(a space stands for the piece's word mark), and one for every byte of a character that is no piece.  Texts are cut before the first of
neighbouring spaces and around line feeds, which no piece spans, and nowhere else, whatever a run's length; each different
run of a chunk is filtered forward once (log-sum of all segmentations up to each node, vectorised over runs).  Every
segmentation passes a node that no edge spans, so forward sums begin anew there and such stretches advance at once.
Every occurrence is then sampled backwards from its end, with uniform numbers that are hashes of the row's
key, the run's place and the step: the same row always gets the same segmentation, wherever it is computed.

Probabilities fall with a piece's rank in the vocabulary (pieces that the model scores below all ranks, such as its
runs of spaces, count as the last); ``sharpness`` raises them to a power (0: all paths of a
lattice equally likely, large: the best path).  Decoding joins the pieces' bytes and is lossless for every text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U64, buffers, chunks, mix, prefix, substring

CHUNK, BYTE_COST, ONE = 1 << 21, 14.0, 1 << 40
_memory: dict = {}
#: Bytes of a character by its first byte.
CHARACTER = np.array([1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lattices:
    """Vocabulary of a model file; filters and samples the lattices of runs."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(raw)]
        self.sharpness = sharpness
        byte = [i for i in range(len(raw)) if model.is_byte(i)]
        if len(byte) != 256:
            raise ValueError("the model has no byte pieces, so decoding would lose text")
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i in byte:
            self.byte_id[self.bytes[i][0]] = i
        own = [i for i, b in enumerate(self.bytes) if b and i not in set(byte)]
        if any(b"\n" in self.bytes[i][1:] or b"\n" in self.bytes[i][:-1] or b" " in self.bytes[i].lstrip(b" ") for i in own):
            raise ValueError("the model has pieces across the cuts between runs")
        data, off = self._flat([self.bytes[i] for i in own])
        h = substring(prefix(data), off[:-1], off[1:])
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array(own)[order]
        self.slots = np.full(1 << 22, -1, dtype=np.int32)  # key by its low bits; of keys that share them, the last
        self.slots[(self.keys & U64((1 << 22) - 1)).astype(np.int64)] = np.arange(len(self.keys))
        self.sizes = sorted(set(np.diff(off).tolist()))
        self.cost = np.full(len(raw), BYTE_COST)
        self.cost[own] = np.log(np.clip(np.array([-model.get_score(i) for i in own]), 0, len(raw)) + 3.0)
        self.out, self.out_off = self._flat(self.bytes)

    @staticmethod
    def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)

    def filter(self, data: np.ndarray, off: np.ndarray):
        """Filters runs laid end to end, one node more than bytes for each run.

        Returns each run's last node, whether a node begins a run, each node's first incoming edge, and the edges'
        source nodes, pieces and cumulated probabilities among the edges into one node.
        """
        runs_, size = len(off) - 1, np.diff(off)
        own = np.repeat(np.arange(runs_), size)
        at = np.arange(len(data))
        left = off[1:][own] - at  # bytes up to the run's end
        h = prefix(data)
        node = at + own  # node before each byte
        src, span, piece = [], [], []
        lead = (data & 0xC0) != 0x80
        known = np.zeros(len(data), dtype=bool)  # by a character's first byte: whether it is a piece
        live = at
        for k in self.sizes:
            live = live[left[live] >= k]
            if not len(live):
                break
            x = substring(h, live, live + k)
            p = self.slots[(x & U64((1 << 22) - 1)).astype(np.int64)]
            ok = np.flatnonzero(p >= 0)
            x, i, p = x[ok], live[ok], p[ok]
            miss = np.flatnonzero(self.keys[p] != x)
            p[miss] = np.minimum(np.searchsorted(self.keys, x[miss]), len(self.keys) - 1)
            ok = np.flatnonzero(self.keys[p] == x)
            i = i[ok]
            known[i[CHARACTER[data[i]] == k]] = True
            src.append(node[i])
            span.append(np.full(len(ok), k))
            piece.append(self.ids[p[ok]])
        bare = np.flatnonzero(~known[np.maximum.accumulate(np.where(lead, at, 0))]) if len(data) else at
        src.append(node[bare])
        span.append(np.zeros(len(bare), np.int64))
        piece.append(self.byte_id[data[bare]])
        src, span, piece = np.concatenate(src), np.concatenate(span), np.concatenate(piece)
        dst = src + np.maximum(span, 1)
        total = len(data) + runs_
        base = off[:-1] + np.arange(runs_)
        over = np.cumsum(np.bincount(src + 1, minlength=total + 1) - np.bincount(dst, minlength=total + 1))  # edges that span a node
        free = over[:total] == 0
        nodes = np.arange(total)
        local = np.zeros(total, dtype=np.int64)  # distance from the free node before
        local[1:] = nodes[1:] - np.maximum.accumulate(np.where(free, nodes, 0))[:-1]
        local[base] = 0
        order = np.argsort((local[dst] * total + dst) * (self.sizes[-1] + 1) + span)  # by distance, then node: all keys differ
        src, dst, piece = src[order], dst[order], piece[order]
        weight = -self.sharpness * self.cost[piece]
        new = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(dst)))
        heads = dst[new]
        level = np.searchsorted(local[heads], np.arange(1, int(local.max(initial=0)) + 2))
        alpha, cum = np.zeros(total), np.zeros(len(dst), dtype=np.int64)
        for a, b in zip(level[:-1], level[1:], strict=True):  # all stretches advance by one byte
            if a == b:
                continue
            x, y = new[a], new[b] if b < len(new) else len(dst)
            v = alpha[src[x:y]] + weight[x:y]
            begin, many = new[a:b] - x, count[a:b]
            sums = np.logaddexp.reduceat(v, begin)
            alpha[heads[a:b]] = np.where(free[heads[a:b]], 0.0, sums)
            c = np.cumsum((np.exp(v - np.repeat(sums, many)) * ONE).astype(np.int64))  # whole numbers: the same in any chunk
            cum[x:y] = c - np.repeat(np.concatenate([[0], c[begin[1:] - 1]]), many)
        cum[new + count - 1] = ONE  # beyond any uniform number
        first = np.zeros(total, dtype=np.int64)
        first[heads] = new
        start = np.zeros(total, dtype=bool)
        start[base] = True
        return base + size, start, first, src, piece, cum

    def sample(self, data: np.ndarray, off: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, number of pieces of each); keys: one 64-bit number a text."""
        docs = len(off) - 1
        s, e, d = runs(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        _, one, which = np.unique(substring(prefix(data), s, e), return_index=True, return_inverse=True)
        a, size = s[one], (e - s)[one]
        flat = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        last, start, first, src, piece, cum = self.filter(data[flat], np.concatenate([[0], np.cumsum(size)]))
        node = last[which]
        where = mix(keys[d] + mix((s - off[d]).astype(U64) + U64(seed)))
        live, step, got = np.arange(len(s)), 0, []
        while len(live):
            r = (mix(where[live] + U64(0x632BE59BD9B4E019 * (step + 1) & 0xFFFFFFFFFFFFFFFF)) >> U64(24)).astype(np.int64)
            x = first[node[live]]
            more = np.flatnonzero(cum[x] <= r)
            while len(more):  # the edges of a node are few
                x[more] += 1
                more = more[cum[x[more]] <= r[more]]
            got.append((live, piece[x]))
            node[live] = src[x]
            live = live[~start[node[live]]]
            step += 1
        count = np.zeros(len(s), dtype=np.int64)
        for i, _ in got:
            count[i] += 1
        end = np.cumsum(count)
        out = np.zeros(int(count.sum()), dtype=np.uint32)
        for k, (i, p) in enumerate(got):
            out[end[i] - 1 - k] = p
        return out, np.bincount(d, weights=count, minlength=docs).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.out_off[ids.astype(np.int64) + 1] - self.out_off[ids]
        return self.out[np.repeat(self.out_off[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run: cut before the first of neighbouring spaces and around line feeds."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    cut[:n] |= data == 0x0A
    cut[1:] |= data == 0x0A
    cut[1:n] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
    at = np.flatnonzero(cut)
    return at[:-1], at[1:], np.searchsorted(off, at[:-1], side="right") - 1


def lattices(path: str, sharpness: float) -> Lattices:
    if (path, sharpness) not in _memory:
        _memory[path, sharpness] = Lattices(path, sharpness)
    return _memory[path, sharpness]


def encoded(docs: DataFrame, model: str | None = None, sharpness: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, lossless (and ids with keep_ids) of each document.

    Null texts count as empty and have no pieces; a null id is a key of its own.
    """
    path = model or model_path()
    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"] + ["ids"] * keep_ids

    def run(batches):
        lat = lattices(path, sharpness)
        for batch in batches:
            data, off = buffers(batch.column(1))
            keys = mix(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            for a, b in chunks(off, CHUNK):
                o = off[a : b + 1]
                part = data[o[0] : o[-1]]
                ids, count = lat.sample(part, o - o[0], keys[a:b], seed)
                end = np.cumsum(count)
                sums, back, same, lists_ = [], [], [], []
                for k, (x, y) in enumerate(zip(end - count, end, strict=True)):
                    own = ids[x:y]
                    text = lat.decode(own)
                    sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                    back.append(hashlib.sha256(text).hexdigest())
                    same.append(text == part[o[k] - o[0] : o[k + 1] - o[0]].tobytes())
                    if keep_ids:
                        lists_.append(own.astype(np.int32))
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(o)), pa.array(count), pa.array(sums, pa.int64()), pa.array(back), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(lists_, pa.list_(pa.int32()))] * keep_ids, names=names)

    schema = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
