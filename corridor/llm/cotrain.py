"""Quality by co-training of two views.

The text view holds hashed trigrams of character classes, hashed words and the repetition of words; the metadata view
holds language, source, length and line layout.  Each round both views are trained, and each gives the documents of an
unlabelled pool that it is surest of to the other one's training set.  Both views are then calibrated and
combined by a logistic regression on labelled rows, and score all documents.

Fitted on at most ``LABELLED`` labelled rows and a pool of ``POOL`` unlabelled ones, chosen by hashes; every document
is scored.  Fitting and the pool see a share of the unlabelled rows alone.  Null texts count as empty, null language or source as a value of its own.  Columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import BYTE_LOWER, U64, buffers, chunks, mix, prefix, substring, words
from .common import free, one_core_each
from .learn import labelled, logistic, sigmoid

LABELLED, POOL, DIM, LEX, SLOTS, ROUNDS, GIVE = 8_000, 8_000, 256, 256, 24, 4, 0.05

CLASS = np.arange(256, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    CLASS[_b] = 97 if 97 <= _b <= 122 else 65 if 65 <= _b <= 90 else 48 if 48 <= _b <= 57 else 128 if _b >= 128 else _b


def _slot(values: pa.Array, salt: int) -> np.ndarray:
    data, off = buffers(values.cast(pa.string()))
    h = substring(prefix(data), off[:-1], off[1:])
    h = np.where(np.asarray(values.is_null()), U64(1), h)
    return (mix(h + U64(salt)) % U64(SLOTS)).astype(np.int64)


def views(data: np.ndarray, off: np.ndarray, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the text view and the metadata view."""
    n = len(off) - 1
    size = np.diff(off)
    s, e, d = words(data, off)
    c = CLASS[data]
    owner = np.repeat(np.arange(n), size)
    text = np.zeros((n, DIM + LEX + 2), dtype=np.float64)
    if len(data) > 2:
        ok = owner[2:] == owner[:-2]
        bucket = (mix((c[:-2] * 65536 + c[1:-1] * 256 + c[2:])[ok].astype(U64)) % U64(DIM)).astype(np.int64) if len(data) < 4096 else _BUCKET(c)[ok]
        flat = np.bincount(owner[2:][ok] * DIM + bucket, minlength=n * DIM).reshape(n, DIM)
        text[:, :DIM] = np.sqrt(flat / np.maximum(size, 1)[:, None])
    w = substring(prefix(data, BYTE_LOWER), s, e)
    order = np.lexsort((w, d))
    new = np.concatenate([[True], (w[order][1:] != w[order][:-1]) | (d[order][1:] != d[order][:-1])]) if len(w) else np.zeros(0, bool)
    count, kinds = np.bincount(d, minlength=n), np.bincount(d[order][new], minlength=n)
    if len(w):
        flat = np.bincount(d * LEX + (mix(w + U64(0x1B873593)) % U64(LEX)).astype(np.int64), minlength=n * LEX).reshape(n, LEX)
        text[:, DIM : DIM + LEX] = np.sqrt(flat / np.maximum(count, 1)[:, None])
    text[:, -2] = kinds / np.maximum(count, 1)
    text[:, -1] = kinds / np.maximum(np.sqrt(count), 1) / 10
    meta = np.zeros((n, 2 * SLOTS + 5), dtype=np.float64)
    meta[np.arange(n), _slot(lang, 11)] = 1
    meta[np.arange(n), SLOTS + _slot(source, 13)] = 1
    lines = np.bincount(owner, weights=data == 10, minlength=n) + 1
    meta[:, -5] = np.log1p(size) / 5
    meta[:, -4] = np.log1p(lines) / 3
    meta[:, -3] = np.log1p(size / lines) / 5
    meta[:, -2] = np.log1p(size / np.maximum(count, 1)) / 2
    meta[:, -1] = np.log1p(count / lines) / 4
    return text, meta


_table: list = []


def _BUCKET(c: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring class triples through a table over the classes that exist."""
    if not _table:
        used = np.unique(CLASS)
        rank = np.zeros(256, dtype=np.int64)
        rank[used] = np.arange(len(used))
        k = len(used)
        x, y, z = np.meshgrid(used, used, used, indexing="ij")
        _table.extend([rank, k, (mix((x * 65536 + y * 256 + z).ravel().astype(U64)) % U64(DIM)).astype(np.int64)])
    rank, k, bucket = _table
    r = rank[c]
    return bucket[(r[:-2] * k + r[1:-1]) * k + r[2:]]


class Model:
    def __init__(self, text: np.ndarray, meta: np.ndarray, both: np.ndarray):
        self.text, self.meta, self.both = text, meta, both

    def logits(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([np.clip(text @ self.text[:-1] + self.text[-1], -12, 12), np.clip(meta @ self.meta[:-1] + self.meta[-1], -12, 12)], axis=1)

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        x = self.logits(text, meta)
        return np.stack([sigmoid(x @ self.both[:-1] + self.both[-1]), sigmoid(x[:, 0]), sigmoid(x[:, 1])], axis=1)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """y: 1, 0, or -1 for the unlabelled pool."""
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    if not len(known):
        return Model(np.zeros(text.shape[1] + 1), np.zeros(meta.shape[1] + 1), np.zeros(3))
    fold = np.arange(len(known)) % 4 == 3  # calibrates; the rest trains
    base, cal = known[~fold], known[fold] if fold.any() else known
    sets = {"text": (base, y[base].astype(float)), "meta": (base, y[base].astype(float))}
    rate = y[base].mean() if len(base) else 0.5
    x = {"text": text, "meta": meta}
    given = {"text": np.zeros(len(y), bool), "meta": np.zeros(len(y), bool)}
    w: dict = {}
    for r in range(rounds + 1):
        w = {k: logistic(x[k][i], t, 1e-4, start=w.get(k)) for k, (i, t) in sets.items()}
        if r == rounds or not len(pool):
            break
        for k, other in (("text", "meta"), ("meta", "text")):
            p = sigmoid(x[k][pool] @ w[k][:-1] + w[k][-1])
            free = np.flatnonzero(~given[k][pool])
            many = max(1, int(GIVE * len(pool)))
            high = free[np.argsort(-p[free], kind="stable")][: max(1, int(many * rate))]
            low = free[np.argsort(p[free], kind="stable")][: max(1, int(many * (1 - rate)))]
            high, low = high[p[high] > 0.9], low[p[low] < 0.1]
            i, t = sets[other]
            sets[other] = (np.concatenate([i, pool[high], pool[low]]), np.concatenate([t, np.ones(len(high)), np.zeros(len(low))]))
            given[k][pool[high]] = given[k][pool[low]] = True
    model = Model(w["text"], w["meta"], np.array([1.0, 0, 0]))
    model.both = logistic(model.logits(text[cal], meta[cal]), y[cal].astype(float), 1e-3)
    return model


def _columns(docs: DataFrame) -> list:
    have = docs.columns
    return [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in ("text", "lang", "source")]


def train(docs: DataFrame, labels: DataFrame, sample: int = LABELLED, pool: int = POOL) -> Model:
    own = labelled(labels, "quality", sample)
    n = docs.count()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(docs))
    few = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, pool / max(n, 1))))
    few = few.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").withColumn("y", F.lit(-1))
    both = ids.join(F.broadcast(own), "doc_id").unionByName(few).drop("doc_id")  # at most ``sample`` rows broadcast

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(0))
            for a, b in chunks(off):
                o = off[a : b + 1]
                t, m = views(data[o[0] : o[-1]], o - o[0], batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in t], pa.binary()), pa.array([r.astype(np.float32).tobytes() for r in m], pa.binary()), batch.column(3).slice(a, b - a)], names=["t", "m", "y"])

    def fit(batches):
        rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))  # sample + pool rows at most
        if not rows:
            return
        text, meta = (np.stack([np.frombuffer(r[k], np.float32) for r in rows]).astype(np.float64) for k in range(2))
        order = np.random.default_rng(3).permutation(len(rows))
        m = cotrain(text[order], meta[order], np.array([r[2] for r in rows])[order])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.text, m.meta, m.both)], names=["text", "meta", "both"])

    one_core_each(docs.sparkSession)
    rows = both.select("text", "lang", "source", "y").mapInArrow(run, "t binary, m binary, y int").repartition(1)
    for r in rows.mapInArrow(fit, "text binary, meta binary, both binary").collect():  # one row
        return Model(*(np.frombuffer(r[k]).copy() for k in ("text", "meta", "both")))
    return Model(np.zeros(DIM + LEX + 3), np.zeros(2 * SLOTS + 6), np.zeros(3))


def scored(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("quality_score", "text_score", "meta_score")) -> DataFrame:
    """docs with the combined score and the score of each view; columns of these names that exist already are refused."""
    docs = free(docs, *names)
    at = {c: docs.columns.index(c) for c in ("text", "lang", "source") if c in docs.columns}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches):
        for batch in batches:
            none = pa.nulls(batch.num_rows, pa.string())
            data, off = buffers(batch.column(at["text"])) if "text" in at else buffers(none)
            lang, source = (batch.column(at[c]) if c in at else none for c in ("lang", "source"))
            out = []
            for a, b in chunks(off, 1 << 19):
                o = off[a : b + 1]
                out.append(model.probability(*views(data[o[0] : o[-1]], o - o[0], lang.slice(a, b - a), source.slice(a, b - a))))
            p = np.concatenate(out) if out else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(3)]], names=schema.names)

    return docs.mapInArrow(run, schema)
