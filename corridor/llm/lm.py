"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Counts.  Documents are dealt to parts by a hash of their id.  A part sends each of its different words once, with
its training count, to the word's bucket; buckets add up and answer each part with the corpus counts of its words.
So counts cover all training documents, and of words only those that get vectors reach the driver.

Model.  Words that occur often enough have vectors of their own.  "Often" is max(``LEAST``, N ** (2/3) / 1000) for N
training tokens, so there are at most 1000 * N ** (1/3) such words, and more the more there is to learn from.  They lie
in about sqrt(V) classes of equal share; all other words share ``SHAPES`` classes by their endings, and the end of a
document is a class.  The last ``CONTEXT`` words predict: q = sum of A_k * e[w_k], a diagonal matrix for each place;
P(class) is the softmax of q . u + b over all classes, P(word | class) that of q . t + b over the class's words.  Within
a class of endings a word has its add-one share of the class's training tokens, one more for unseen words.

Training.  Both levels learn by noise-contrastive estimation: noise classes from their shares for a whole batch, noise
words from the class's own shares for each class in a batch.  A first fit on a bounded sample sets the parameters;
every shard of about ``SHARD`` bytes, or of four times the model's, continues from it on all of its training documents, in the order of their ids, and
the results are averaged, each row weighted by how often a shard updated it.  Shards follow from ids and sizes alone, so
the model does not depend on how the input is split.  Scoring normalises exactly, in batched matrix products.

Tokens are runs of non-separators, lower-cased in ASCII, then one end for each document.  Null texts are empty; rows
with a null id are scored, not learnt from; repeated rows are learnt from and returned as often as given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BYTE_LOWER, LOWER, U64, buffers, chunks, mix, prefix, substring, words
from .common import crc_class, memory_stays, one_core_each, parts, saved, whole

SHAPES, WIDTH, CONTEXT, LEAST = 256, 32, 5, 20
NOISE, WORD_NOISE, BATCH, TILE, RATE = 48, 16, 16_384, 256, 0.25
FIRST_DOCS, PASSES, SHARD = 1000, 4, 16 << 20
STEP = 2048
END_KEY = U64(0x1F3D5B79)
F32 = np.float32


def token_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and shapes of all tokens in order, an end after each document; number of tokens of each document."""
    docs = len(off) - 1
    s, e, d = words(data, off)
    count = np.bincount(d, minlength=docs) + 1
    key = np.full(len(s) + docs, END_KEY, dtype=U64)
    shape = np.zeros(len(s) + docs, dtype=np.uint8)
    at = np.arange(len(s)) + d
    h = prefix(data, BYTE_LOWER)
    key[at] = substring(h, s, e)
    shape[at] = mix(substring(h, np.maximum(s, e - 3), e)) % U64(SHAPES)
    return key, shape, count


class Vocabulary:
    """Words with vectors, in the order of their classes, and what classes of endings hold.

    Rows are numbered: words, then endings, then the end.  Classes are numbered: of words, of endings, of the end.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tail: np.ndarray, kinds: np.ndarray, ends: int):
        """``keys`` by falling ``counts``; tokens and different words of each ending; tokens that are ends."""
        self.size = len(keys)
        order = np.argsort(keys)
        self.keys, self.row = keys[order], order
        wanted = max(1, int(np.ceil(np.sqrt(self.size))))
        before = np.cumsum(counts) - counts
        cls = (before * wanted / max(counts.sum(), 1)).astype(np.int64) if self.size else np.zeros(0, np.int64)
        cls = np.cumsum(np.concatenate([[0], np.diff(cls) > 0]))[: self.size] if self.size else cls  # without gaps
        self.word_classes = int(cls[-1]) + 1 if self.size else 0
        self.cls = np.concatenate([cls, self.word_classes + np.arange(SHAPES + 1)]).astype(np.int64)  # of each row
        self.first = np.searchsorted(cls, np.arange(self.word_classes + 1)) if self.size else np.zeros(1, np.int64)  # of each class of words
        self.classes, self.rows, self.end = self.word_classes + SHAPES + 1, self.size + SHAPES + 1, self.size + SHAPES
        own = np.bincount(cls, weights=counts, minlength=self.word_classes) if self.size else np.zeros(0)
        mass = np.concatenate([own, tail, [ends]]) + 0.5
        self.share = mass / mass.sum()
        self.cum = np.cumsum(self.share)
        self.word_cum = np.cumsum((counts + 0.5) / max((counts + 0.5).sum(), 1)) if self.size else np.zeros(0)
        self.word_share = (counts + 0.5) / (own + 0.5 * np.diff(self.first))[cls] if self.size else np.zeros(0)  # within its class
        self.tail, self.kinds = tail, kinds

    def index(self, key: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Row of each token."""
        out = self.size + shape.astype(np.int64)
        if self.size:
            at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
            hit = self.keys[at] == key
            out[hit] = self.row[at[hit]]
        out[key == END_KEY] = self.end
        return out


def places(count: np.ndarray) -> np.ndarray:
    """Each token's place in its document."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _summed(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return r[first], np.add.reduceat(g[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``; far above zero it is 1 in single precision anyway."""
    np.minimum(np.negative(x, out=x), 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Bilinear:
    """Parameters: context vectors e, class vectors u, word vectors t (each with its bias as a last column), places a."""

    NAMES = ("e", "u", "t", "a")

    def __init__(self, v: Vocabulary, parts: list[np.ndarray] | None = None):
        self.v = v
        if parts is None:
            rng = np.random.default_rng(5)
            u = np.concatenate([rng.normal(0, 0.05, (v.classes, WIDTH)), np.log(v.share)[:, None]], axis=1)
            t = np.concatenate([rng.normal(0, 0.05, (v.size, WIDTH)), np.log(np.maximum(v.word_share, 1e-12))[:, None]], axis=1)
            a = np.repeat(1 / (1.0 + np.arange(CONTEXT))[:, None], WIDTH, axis=1)
            parts = [rng.normal(0, 0.3, (v.rows, WIDTH)), u, t, a]
        self.e, self.u, self.t, self.a = (np.array(x, dtype=F32) for x in parts)
        self.offset, self.word_offset = np.log(NOISE * v.share).astype(F32), np.log(WORD_NOISE * np.maximum(v.word_share, 1e-12)).astype(F32)
        self.squares = {n: np.full(len(getattr(self, n)), 1e-4, F32) for n in self.NAMES}
        self.updates = {n: np.zeros(len(getattr(self, n)), np.int64) for n in self.NAMES}

    def copy(self) -> Bilinear:
        out = Bilinear(self.v, [getattr(self, n) for n in self.NAMES])
        out.squares = {n: s.copy() for n, s in self.squares.items()}
        return out

    def _step(self, name: str, rows: np.ndarray, g: np.ndarray) -> None:
        """Gradient ascent, each row's step falling with the sum of its squared gradients; ``g`` is overwritten."""
        s, p = self.squares[name], getattr(self, name)
        now = s[rows] + np.einsum("ij,ij->i", g, g)
        s[rows] = now
        g *= (RATE / np.sqrt(now))[:, None]
        p[rows] += g
        self.updates[name][rows] += 1

    def query(self, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Predictions (with a last column of ones) for the tokens behind the first ``CONTEXT`` rows; the vectors of all
        rows; and for each place before a token the tokens that have a document's beginning there, where ends count.

        Neighbouring tokens share their contexts, so each row's vector is read once.
        """
        got, n = self.e[row], len(row) - CONTEXT
        q = np.ones((n, WIDTH + 1), F32)
        sums, bare, term, total = q[:, :-1], [], np.empty((STEP, WIDTH), F32), np.empty((STEP, WIDTH), F32)
        for x in range(0, n, STEP):  # parts that stay in the processor's cache
            m = min(STEP, n - x)
            t, z = term[:m], total[:m]
            np.multiply(got[x + CONTEXT - 1 : x + CONTEXT - 1 + m], self.a[0], out=z)
            for k in range(1, CONTEXT):
                z += np.multiply(got[x + CONTEXT - k - 1 : x + CONTEXT - k - 1 + m], self.a[k], out=t)
            sums[x : x + m] = z
        early = np.flatnonzero(place < CONTEXT)
        for k in range(CONTEXT):
            bare.append(early[place[early] <= k])
            sums[bare[k]] += (self.e[self.v.end] - got[bare[k] + CONTEXT - k - 1]) * self.a[k]
        return q, got, bare

    def train(self, row: np.ndarray, place: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on neighbouring tokens; ``row`` also has the ``CONTEXT`` rows before them."""
        v = self.v
        around, (q, got, bare) = row, self.query(row, place)
        order = np.argsort(v.cls[row[CONTEXT:]], kind="stable")  # by class, so that a class's tokens lie together
        row, q = row[CONTEXT:][order], q[order]
        cls = v.cls[row]
        # classes: noise in common
        noise = np.searchsorted(v.cum, rng.random(NOISE)).clip(max=v.classes - 1)
        own, other = self.u[cls], self.u[noise]
        up = 1 - _sigmoid(np.einsum("ij,ij->i", q, own) - self.offset[cls])
        down = _sigmoid(q @ other.T - self.offset[noise])
        dq = up[:, None] * own
        dq -= down @ other
        edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        # words within their classes: noise in common for each class; classes share no words, so one step does for all
        draw = rng.random((v.word_classes, WORD_NOISE))
        spans = [(x, y, c) for x, y, c in zip(edge.tolist(), [*edge[1:].tolist(), len(cls)], cls[edge].tolist(), strict=True) if c < v.word_classes]
        last = spans[-1][1] if spans else 0  # classes of words come first
        spans = [(x, y, c) for x, y, c in spans if v.first[c + 1] - v.first[c] > 1]
        if spans:
            c = np.array([c for _, _, c in spans])
            lo, hi = v.first[c], v.first[c + 1]
            base = np.where(lo > 0, v.word_cum[lo - 1], 0.0)
            fake = np.searchsorted(v.word_cum, base[:, None] + draw[c] * (v.word_cum[hi - 1] - base)[:, None])
            fake = np.clip(fake, lo[:, None], hi[:, None] - 1)
            false, offset = self.t[fake], self.word_offset[fake]
            r, here, true = row[:last], q[:last], self.t[row[:last]]
            up1 = 1 - _sigmoid(np.einsum("ij,ij->i", here, true) - self.word_offset[r])
            down1 = np.zeros((last, WORD_NOISE), F32)
            for k, (x, y, _) in enumerate(spans):
                np.subtract(here[x:y] @ false[k].T, offset[k], out=down1[x:y])
            down1 = _sigmoid(down1)
            g = np.empty((last + fake.size, WIDTH + 1), F32)
            g_false = g[last:].reshape(false.shape)
            for k, (x, y, _) in enumerate(spans):
                np.matmul(down1[x:y].T, here[x:y], out=g_false[k])
                dq[x:y] -= down1[x:y] @ false[k]
            g[last:] *= -1
            np.multiply(up1[:, None], here, out=g[:last])
            true *= up1[:, None]
            at = slice(last)
            if sum(y - x for x, y, _ in spans) < last:  # a class of one word has nothing to learn
                at = np.concatenate([np.arange(x, y) for x, y, _ in spans])
                g = np.concatenate([g[at], g[last:]])
            dq[at] += true[at]
            self._step("t", *_summed(np.concatenate([r[at], fake.ravel()]), g))
        more = _summed(noise, -(down.T @ q))
        self._step("u", cls[edge], np.add.reduceat(up[:, None] * q, edge, axis=0))
        self._step("u", *more)
        # back to the order of the text, where each row's vector gets what all tokens behind it say
        back = np.empty((len(order), WIDTH), F32)
        back[order] = dq[:, :-1]
        n, g = len(back), np.zeros((len(got) + 1, WIDTH), F32)  # the last row is the end's, before beginnings of documents
        da, term = np.zeros_like(self.a), np.empty((STEP, WIDTH), F32)
        for x in range(0, n, STEP):
            some = back[x : x + STEP]
            part = term[: len(some)]
            for k in range(CONTEXT):
                own = slice(x + CONTEXT - k - 1, x + CONTEXT - k - 1 + len(some))
                da[k] += np.einsum("ij,ij->j", some, got[own])
                np.multiply(some, self.a[k], out=part)
                lo, hi = np.searchsorted(bare[k], (x, x + len(some)))
                if lo < hi:
                    at = bare[k][lo:hi] - x
                    da[k] += (some[at] * (self.e[v.end] - got[own][at])).sum(axis=0)
                    g[-1] += part[at].sum(axis=0)
                    part[at] = 0
                g[own] += part
        used = np.append(around, v.end)
        self._step("e", *_summed(used, g))
        self._step("a", np.arange(CONTEXT), da)

    def log_probs(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's class and, for words with vectors, of the word within its class.

        ``row`` begins with a document.
        """
        out, v = np.empty(len(row)), self.v
        around = np.concatenate([np.full(CONTEXT, v.end), row])
        room = np.empty(TILE * max(v.classes, np.diff(v.first).max(initial=0)), F32)  # new room for each tile would take longer than the product
        for k in range(0, len(row), 4 * BATCH):
            r = row[k : k + 4 * BATCH]
            q, cls = self.query(around[k : k + CONTEXT + len(r)], place[k : k + len(r)])[0], v.cls[r]
            got = np.empty(len(r))
            for j in range(0, len(r), TILE):
                own = slice(j, j + TILE)
                got[own] = _log_softmax(q[own], self.u, cls[own], room)
            order = np.argsort(cls, kind="stable")
            edge = np.searchsorted(cls[order], np.arange(v.word_classes + 1))
            for c in np.flatnonzero(np.diff(edge)):
                lo, hi = v.first[c], v.first[c + 1]
                at = order[edge[c] : edge[c + 1]]
                for j in range(0, len(at) if hi - lo > 1 else 0, TILE):
                    some = at[j : j + TILE]
                    got[some] += _log_softmax(q[some], self.t[lo:hi], r[some] - lo, room)
            out[k : k + 4 * BATCH] = got
        return out


def _log_softmax(q: np.ndarray, vectors: np.ndarray, which: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``q`` with a last column of ones; ``room`` holds as many numbers as there are rows and vectors, or more."""
    z = np.matmul(q, vectors.T, out=room[: len(q) * len(vectors)].reshape(len(q), len(vectors)))
    own = z[np.arange(len(z)), which].astype(np.float64)
    with np.errstate(over="ignore"):
        total = np.exp(z, out=z) @ np.ones(len(vectors), F32)
    if not (1e-30 < total.min() and total.max() < 1e30):  # beyond what the exponential holds in single precision
        z = q @ vectors.T
        top = z.max(axis=1, keepdims=True)
        return own - top[:, 0] - np.log(np.exp(z - top).sum(axis=1))
    return own - np.log(total)


class Stream:
    """Trains on a stream of documents in batches of ``BATCH`` tokens, wherever its pieces are cut."""

    def __init__(self, model: Bilinear, seed: int):
        self.model, self.rng, self.size = model, np.random.default_rng(seed), 0
        self.rows, self.places = [np.full(CONTEXT, model.v.end)], []  # the rows before the next batch come first

    def add(self, row: np.ndarray, count: np.ndarray) -> None:
        self.rows.append(row)
        self.places.append(places(count))
        self.size += len(row)
        if self.size >= BATCH:
            self._run(self.size // BATCH * BATCH)

    def _run(self, many: int) -> None:
        row, place = np.concatenate(self.rows), np.concatenate(self.places)
        for k in range(0, many, BATCH):
            n = min(BATCH, many - k)
            self.model.train(row[k : k + n + CONTEXT], place[k : k + n], self.rng)
        self.rows, self.places, self.size = [row[many:]], [place[many:]], self.size - many

    def end(self) -> None:
        if self.size:
            self._run(self.size)


def _by_part(batches):
    """Rows of a partition by part number: pid, ids, learn, data and offsets."""
    got = whole(batches)
    if got is None:
        return
    pid = got.column("pid").to_numpy()
    for p in np.unique(pid):
        yield int(p), got.take(pa.array(np.flatnonzero(pid == p)))


def _tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = buffers(column)
    got = []
    for a, b in chunks(off):
        o = off[a : b + 1]
        got.append(token_keys(data[o[0] : o[-1]], o - o[0]))
    return tuple(np.concatenate([g[k] for g in got]) for k in range(3)) if got else (np.zeros(0, U64), np.zeros(0, np.uint8), np.zeros(0, np.int64))


_COUNTS = "kind int, key long, hashes binary, counts binary, shapes binary, n long, shape int"


def _count_rows(rows):
    names = ["kind", "key", "hashes", "counts", "shapes", "n", "shape"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
    for k in range(0, len(rows), 512):
        part = rows[k : k + 512]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], t) for j, t in enumerate(types)], names=names)


def scores(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Learns from documents whose crc32(id as text) modulo ``modulus`` is not ``held``; a null id counts as held out.
    """
    one_core_each(docs.sparkSession)
    memory_stays(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts(docs, "text", 8)
    docs = docs.withColumn("held_out", F.coalesce(crc_class("doc_id", modulus) == held, F.lit(True)))
    dealt = docs.withColumn("pid", F.pmod(F.xxhash64("doc_id"), F.lit(n))).select("pid", "doc_id", "held_out", "text")
    buckets = 2 * n

    def local(batches):
        for pid, t in _by_part(batches):
            key, shape, count = _tokens(t.column("text"))
            learn = np.repeat(~t.column("held_out").to_numpy(zero_copy_only=False).astype(bool), count)
            u, first, at = np.unique(key, return_index=True, return_inverse=True)
            c = np.bincount(at, weights=learn, minlength=len(u)).astype(np.uint32)
            order = np.argsort(u % U64(buckets), kind="stable")
            u, c, s = u[order], c[order], shape[first[order]]
            edge = np.searchsorted(u % U64(buckets), np.arange(buckets + 1).astype(U64))
            yield from _count_rows([(pid, b, u[x:y].tobytes(), c[x:y].tobytes(), s[x:y].tobytes(), None, None) for b, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x])

    def add_up(batches):
        got = whole(batches)
        if got is None:
            return
        h = [np.frombuffer(x, U64) for x in got.column("hashes").to_pylist()]
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in got.column("counts").to_pylist()])
        s = np.concatenate([np.frombuffer(x, np.uint8) for x in got.column("shapes").to_pylist()])
        u, first, at = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)
        rows, x = [], 0
        for pid, keys in zip(got.column("kind").to_pylist(), h, strict=True):
            rows.append((1, pid, keys.tobytes(), total[at[x : x + len(keys)]].tobytes(), None, None, None))
            x += len(keys)
        shape = s[first]
        word = u != END_KEY
        for k in range(SHAPES):  # tokens and different words of each shape
            own = (shape == k) & (total > 0) & word
            if own.any():
                rows.append((2, int(own.sum()), None, None, None, int(total[own].sum()), k))
        rows.append((2, int((total[~word] > 0).sum()), None, None, None, int(total[~word].sum()), -1))
        often = word & (total >= LEAST)
        rows.append((3, None, u[often].tobytes(), total[often].tobytes(), shape[often].tobytes(), None, None))
        yield from _count_rows(rows)

    def frequent(batches):
        for batch in batches:
            for h, c, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                u, c, s = np.frombuffer(h, U64), np.frombuffer(c, np.int64), np.frombuffer(s, np.uint8)
                ok = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(u[ok].view(np.int64)), pa.array(c[ok]), pa.array(s[ok].astype(np.int32))], names=["key", "n", "shape"])

    counted = saved(dealt.repartitionById(n, F.col("pid").cast("int")).mapInArrow(local, _COUNTS).repartition(n, "key").mapInArrow(add_up, _COUNTS))
    tally = {r["shape"]: (r["n"], r["v"]) for r in counted.where("kind = 2").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("key").alias("v")).collect()}
    tokens, types = sum(a for a, _ in tally.values()), sum(b for _, b in tally.values())
    least = max(LEAST, int(tokens ** (2 / 3) / 1000))
    top = counted.where("kind = 3").select("hashes", "counts", "shapes").mapInArrow(frequent, "key long, n long, shape int").toArrow()  # at most tokens / least words
    key, count, shape = top.column("key").to_numpy().view(U64), top.column("n").to_numpy(), top.column("shape").to_numpy()
    order = np.lexsort((key, -count))
    key, count, shape = key[order], count[order], shape[order]
    tail = np.array([tally.get(k, (0, 0)) for k in range(SHAPES)], dtype=np.float64)
    tail -= np.stack([np.bincount(shape, weights=count, minlength=SHAPES), np.bincount(shape, minlength=SHAPES)], axis=1)
    vocabulary = Vocabulary(key, count, tail[:, 0], tail[:, 1], tally.get(-1, (0, 0))[0])

    # A first fit on a bounded sample, then all training documents.
    learn = docs.where("NOT held_out").select("doc_id", "text")
    total, volume = learn.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    few = learn.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIRST_DOCS / max(total, 1))))

    def first_fit(batches):
        got = whole(batches)
        if got is None:
            return
        key, shape, k = _tokens(got.column("text"))
        model, rng, place, step = Bilinear(vocabulary), np.random.default_rng(17), places(k), BATCH // 4
        row = np.concatenate([np.full(CONTEXT, vocabulary.end), vocabulary.index(key, shape)])
        for _ in range(PASSES):
            for x in rng.permutation(-(-len(place) // step)) * step:
                model.train(row[x : x + CONTEXT + step], place[x : x + step], rng)
        yield pa.RecordBatch.from_arrays([pa.array([getattr(model, x).tobytes()], pa.binary()) for x in [*Bilinear.NAMES]] + [pa.array([model.squares[x].tobytes()], pa.binary()) for x in Bilinear.NAMES], names=[*Bilinear.NAMES, *[f"s_{x}" for x in Bilinear.NAMES]])

    columns = ", ".join(f"{x} binary" for x in [*Bilinear.NAMES, *[f"s_{x}" for x in Bilinear.NAMES]])
    start = Bilinear(vocabulary)
    for r in few.repartition(1).sortWithinPartitions("doc_id", "text").select("text").mapInArrow(first_fit, columns).collect():  # one row, from FIRST_DOCS documents or so
        start = Bilinear(vocabulary, [np.frombuffer(r[x], F32).reshape(getattr(start, x).shape) for x in Bilinear.NAMES])
        start.squares = {x: np.frombuffer(r[f"s_{x}"], F32).copy() for x in Bilinear.NAMES}
    shared = docs.sparkSession.sparkContext.broadcast(start)  # 2 * WIDTH numbers a word with vectors

    def refine(batches):
        stream, here = None, None

        def result():
            stream.end()
            m = stream.model
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), *[pa.array([(getattr(m, x) * m.updates[x][:, None]).astype(F32).tobytes()], pa.binary()) for x in m.NAMES], *[pa.array([m.updates[x].tobytes()], pa.binary()) for x in m.NAMES]], names=names)

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                if q > p and shard[p] != here:
                    if stream:
                        yield result()
                    here, stream = int(shard[p]), Stream(shared.value.copy(), 23)
                data, off = buffers(batch.column(1).slice(p, q - p))
                for a, b in chunks(off):
                    o = off[a : b + 1]
                    key, shape, k = token_keys(data[o[0] : o[-1]], o - o[0])
                    stream.add(vocabulary.index(key, shape), k)
        if stream:
            yield result()

    def add(batches):
        sums, here = None, None

        def result():
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in sums]], names=names)

        for batch in batches:
            for shard, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = [np.frombuffer(x, F32) for x in blobs[:4]] + [np.frombuffer(x, np.int64) for x in blobs[4:]]
                if shard // 16 != here:
                    if sums:
                        yield result()
                    here, sums = shard // 16, got
                else:
                    sums = [x + y for x, y in zip(sums, got, strict=True)]
        if sums:
            yield result()

    names = ["shard", *Bilinear.NAMES, *[f"n_{x}" for x in Bilinear.NAMES]]
    schema = "shard long, " + ", ".join(f"{x} binary" for x in names[1:])
    shards = int(volume or 0) // max(SHARD, 16 * sum(getattr(start, x).size for x in Bilinear.NAMES)) + 1
    own = learn.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards))).repartitionById(shards, F.col("shard").cast("int"))
    fitted = own.sortWithinPartitions("shard", "doc_id", "text").select("shard", "text").mapInArrow(refine, schema)
    while shards > 1:  # sums of 16 shards each, in their order
        shards = -(-shards // 16)
        fitted = saved(fitted.repartition(shards, F.floor(F.col("shard") / 16)).sortWithinPartitions("shard").mapInArrow(add, schema))
    final = [getattr(start, x).copy() for x in Bilinear.NAMES]
    for r in fitted.collect():  # one row
        for k, x in enumerate(Bilinear.NAMES):
            n_ = np.frombuffer(r[f"n_{x}"], np.int64)
            hit = n_ > 0
            final[k][hit] = np.frombuffer(r[x], F32).reshape(final[k].shape)[hit] / n_[hit, None]
    fit = docs.sparkSession.sparkContext.broadcast(Bilinear(vocabulary, final))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        model = fit.value
        key, shape, k = _tokens(left.column("text"))
        hashes = [np.frombuffer(x, U64) for x in right.column("hashes").to_pylist()]
        values = [np.frombuffer(x, np.int64) for x in right.column("counts").to_pylist()]
        h, v = (np.concatenate(hashes), np.concatenate(values)) if hashes else (np.zeros(1, U64), np.zeros(1, np.int64))
        order = np.argsort(h)
        c = v[order[np.minimum(np.searchsorted(h[order], key), len(h) - 1)]]
        logp = log10_probs(model, key, shape, k, c)
        base = np.log10((c + 1) / (tokens + types + 1))
        first = np.cumsum(k) - k
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(k.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), "train_tokens": pa.array(np.full(len(k), tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(logp, first)),
        })

    replies = counted.where("kind = 1").select(F.col("key").alias("pid"), "hashes", "counts")
    return dealt.groupBy("pid").cogroup(replies.groupBy("pid")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def log10_probs(model: Bilinear, key: np.ndarray, shape: np.ndarray, count: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """log10 probability of every token, given how often its word is ``seen`` in training."""
    v, out = model.v, np.empty(len(key))
    row = v.index(key, shape)
    end = np.cumsum(count)
    a = 0
    while a < len(count):  # documents of some 2**20 tokens at a time, or a longer one
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + (1 << 20), side="right")))
        x, y = end[a] - count[a], end[b - 1]
        out[x:y] = model.log_probs(row[x:y], places(count[a:b]))
        a = b
    kind = row - v.size
    rest = (kind >= 0) & (kind < SHAPES)
    out /= np.log(10)
    out[rest] += np.log10((seen[rest] + 1) / (v.tail[kind[rest]] + v.kinds[kind[rest]] + 1))
    return out
