"""Toxicity by maximum-scoring segments of token log-odds.

1. Log-odds with an informative Dirichlet prior (the sample's own background counts) compare in how many
   toxic and other documents each word and each word beginning of 4 to 8 bytes occurs; those whose likelihood
   ratio is significant among all that were tried (the first ``FEATURES`` at most) keep their log-odds as a score, every other token has a small negative score.
2. A linear-time scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text.
3. Extreme-value calibration: the greatest segment of a harmless text of n tokens exceeds x with probability
   1 - exp(-K * n * exp(-rate * x)); rate and K are the most likely ones for the greatest segments of the harmless
   labelled rows.  They turn a segment's score into an expected number of such segments in harmless text of that
   length; a logistic calibration of the strongest and of the summed evidence gives the score.

Labels are learnt from at most ``SAMPLE`` labelled rows outside the held-out third.  Null and empty texts have
no segment and get the score of a text without evidence.  Input columns pass through unchanged; repeated rows are scored
as often as given, and count that often if they are labelled; null ids have no label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import BYTE_LOWER, U64, buffers, chunks, prefix, substring
from .common import free, saved
from .learn import labelled, logistic, sigmoid

SAMPLE, FEATURES, MARGIN, GAP, PRIOR = 30_000, 4096, 4.0, -0.1, 0.02
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bytes that are part of a token: letters, digits, and everything beyond ASCII.
PART = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def tokens(data: np.ndarray, off: np.ndarray):
    """Start, end and document of each token."""
    solid = PART[data]
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    filled = off[1:] > off[:-1]
    before[off[:-1][filled]] = False
    after[off[1:][filled] - 1] = False
    s, e = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def features(data: np.ndarray, off: np.ndarray):
    """Token documents and a matrix of hashes: the word and its beginnings (0 where it is not longer)."""
    s, e, d = tokens(data, off)
    h = prefix(data, BYTE_LOWER)
    cols = [substring(h, s, e)]
    for k in BEGINNINGS:
        cols.append(np.where(e - s > k, substring(h, s, np.minimum(s + k, e)) ^ U64(0xA5A5A5A5A5A5A5A5), U64(0)))
    return d, np.stack(cols, axis=1) if len(s) else np.zeros((0, 1 + len(BEGINNINGS)), U64)


def maximal_segments(score: np.ndarray, at: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, score) where tokens ``at`` have positive scores and others ``gap``."""
    found: list[list] = []  # first, last, sum before, sum after
    total, end = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total += gap * (p - end - 1)
        seg = [p, p, total, total + s]
        total, end = total + s, p
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= seg[2]:
                k -= 1
            if k < 0 or found[k][3] >= seg[3]:
                found.append(seg)
                break
            seg = [found[k][0], seg[1], found[k][2], seg[3]]
            del found[k:]
    return [(a, b, y - x) for a, b, x, y in found]


class Scores:
    """Significant features in the order of their hashes, with scores and significance."""

    def __init__(self, hashes: np.ndarray, score: np.ndarray, z: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.score, self.z = hashes[order], score[order], z[order]
        self.seen = np.zeros(1 << 18, dtype=bool)
        self.seen[(self.hashes & U64((1 << 18) - 1)).astype(np.int64)] = True

    def of(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with a feature in the table, and the score of their most significant one."""
        if not len(self.hashes) or not len(f):
            return np.zeros(0, np.int64), np.zeros(0)
        rows, cols = np.nonzero(self.seen[(f & U64((1 << 18) - 1)).astype(np.int64)])
        h = f[rows, cols]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[at] == h
        rows, at = rows[ok], at[ok]
        order = np.lexsort((-self.z[at], rows))
        rows, at = rows[order], at[order]
        first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
        return rows[first], self.score[at[first]]


def evidence(data: np.ndarray, off: np.ndarray, table: Scores) -> list[tuple[int, list]]:
    """(tokens, maximal segments) of each document."""
    d, f = features(data, off)
    per = np.bincount(d, minlength=len(off) - 1)
    first = np.cumsum(per) - per
    rows, score = table.of(f)
    own = d[rows]
    edge = np.searchsorted(own, np.arange(len(off)))
    return [(int(per[k]), maximal_segments(score[a:b], rows[a:b] - first[k], GAP) if b > a else []) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]


class Model:
    def __init__(self, table: Scores, rate: float, k: float, weights: np.ndarray):
        self.table, self.rate, self.k, self.weights = table, rate, k, weights

    def stats(self, n: int, segs: list) -> list[float]:
        """log-evidence of the strongest segment and of all significant ones, and their number."""
        bits = [max(0.0, self.rate * s - np.log(self.k * max(n, 1) + 1)) for _, _, s in segs]
        return [min(max(bits, default=0.0), 40.0), np.log1p(sum(bits)), float(min(sum(b > 0 for b in bits), 5)), float(bool(segs))]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def extremes(n: np.ndarray, top: np.ndarray, least: float) -> tuple[float, float]:
    """The most likely (rate, K) for greatest segments ``top`` of texts of n tokens.

    Scores come in steps, so a value is only taken to lie between two multiples of ``least``, the smallest score.
    """
    use = n > 0
    n, step = n[use].astype(float), np.floor(top[use] / least + 1e-9)
    if not step.any():  # no harmless text has a segment: as if one more text of the mean length had the least one
        return 1.0 / least, np.exp(1.0) / max(n.sum(), 1.0)

    def fit(rate: float, log_k: float) -> float:
        high = n * np.exp(log_k - rate * least * step)  # expected number of segments beyond the lower end of each step
        return float(np.log(np.maximum(np.exp(-high * np.exp(-rate * least)) - np.where(step > 0, np.exp(-high), 0.0), 1e-300)).sum())

    def best(f, lo: float, hi: float) -> float:
        for _ in range(36):  # one maximum
            a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
            lo, hi = (a, hi) if f(a) < f(b) else (lo, b)
        return (lo + hi) / 2

    def of(log_rate: float) -> float:
        return best(lambda log_k: fit(np.exp(log_rate), log_k), -25.0, 5.0)

    log_rate = best(lambda r: fit(np.exp(r), of(r)), np.log(0.05 / least), np.log(12.0 / least))
    return float(np.exp(log_rate)), float(np.exp(of(log_rate)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled documents (doc_id, text) x (doc_id, toxic)."""
    own = labelled(labels, "toxic", sample)
    # At most ``sample`` rows broadcast; what they say is written once, as it is read three times.
    texts = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id").select("text", "y"))

    def count(batches):
        for batch in batches:
            data, off = buffers(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in chunks(off):
                o = off[a : b + 1]
                d, f = features(data[o[0] : o[-1]], o - o[0])
                d, h = np.repeat(d, f.shape[1])[f.ravel() != 0], f.ravel()[f.ravel() != 0]
                order = np.lexsort((d, h))
                d, h = d[order], h[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
                d, h = d[new], h[new]
                u, at = np.unique(h, return_inverse=True)
                n1 = np.bincount(at, weights=y[a:b][d], minlength=len(u))
                n = np.bincount(at, minlength=len(u))
                # feature 0 counts documents and tokens
                u = np.append(u, U64(0))
                n1, n, tok = np.append(n1, y[a:b].sum()), np.append(n, b - a), np.append(np.zeros(len(n)), len(f))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n1.astype(np.int64)), pa.array((n - n1).astype(np.int64)), pa.array(tok.astype(np.int64))], names=["f", "n1", "n0", "t"])

    counts = saved(texts.mapInArrow(count, "f long, n1 long, n0 long, t long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n1", "n0", "t")]))
    size = texts.groupBy("y").count().collect()
    d1 = sum(r["count"] for r in size if r["y"] == 1)
    d0 = sum(r["count"] for r in size if r["y"] != 1)
    if not d1 or not d0:
        return Model(Scores(np.zeros(0, U64), np.zeros(0), np.zeros(0)), 1.0, 1.0, np.array([0.0, 0, 0, 0, 0.0 if not d0 + d1 else (3.0 if d1 else -3.0)]))
    mass = PRIOR * (d0 + d1)  # documents that the prior counts as, for either class
    share = (F.col("n1") + F.col("n0")) / float(d0 + d1)
    a1, a0 = F.col("n1") + mass * share, F.col("n0") + mass * share
    odds = F.log(a1 / (d1 + mass - a1)) - F.log(a0 / (d0 + mass - a0))
    n, rate1 = F.col("n1") + F.col("n0"), d1 / (d0 + d1)
    part = F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / n / (1 - rate1))).otherwise(0.0)
    ratio = 2 * (F.col("n1") * F.log(F.col("n1") / n / rate1) + part)  # likelihood ratio against the base rate
    tried = counts.where("f <> 0 and n1 + n0 >= 3").count()
    least = 2 * np.log(max(tried, 2)) + MARGIN
    top = counts.where("f <> 0 and n1 >= 3").select("f", "n0", odds.alias("odds"), F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("z"))
    top = top.where((F.col("z") >= float(np.sqrt(least))) & (F.col("odds") > 0.7)).orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    table = Scores(np.array([r["f"] for r in top], np.int64).view(U64), np.array([r["odds"] for r in top]), np.array([r["z"] for r in top]))

    def segments(batches):
        for batch in batches:
            data, off = buffers(batch.column(0))
            for a, b in chunks(off):
                o = off[a : b + 1]
                got = evidence(data[o[0] : o[-1]], o - o[0], table)
                cols = [pa.array([n for n, _ in got], pa.int64()), pa.array([[x for _, _, x in g] for _, g in got], pa.list_(pa.float64())), batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(cols, names=["n", "s", "y"])

    got = texts.mapInArrow(segments, "n long, s array<double>, y int").collect()  # ``sample`` rows at most
    got.sort(key=lambda r: (r["n"], r["y"], r["s"]))
    calm = [r for r in got if r["y"] != 1]
    rate, k = extremes(np.array([r["n"] for r in calm]), np.array([max(r["s"], default=0.0) for r in calm]), float(table.score.min()) if len(table.score) else 1.0)
    model = Model(table, rate, k, np.zeros(5))
    x = np.array([model.stats(r["n"], [(0, 0, v) for v in r["s"]]) for r in got]).reshape(-1, 4)
    model.weights = logistic(x, np.array([r["y"] == 1 for r in got], dtype=float), l2=1e-4)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity", passages_col: str | None = None) -> DataFrame:
    """docs with a score from 0 to 1, and with passages_col the significant passages as token ranges with scores.

    Columns that exist already under these names are refused, whatever their case.
    """
    docs = free(docs, score_col, *[passages_col] * bool(passages_col))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    if passages_col:
        kind = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType())]))
        schema.add(T.StructField(passages_col, kind))

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(at))
            x, passages = [], []
            for a, b in chunks(off):
                o = off[a : b + 1]
                for n, segs in evidence(data[o[0] : o[-1]], o - o[0], model.table):
                    x.append(model.stats(n, segs))
                    if passages_col:
                        passages.append([{"first": p, "last": q, "score": s} for p, q, s in segs if model.rate * s > np.log(model.k * max(n, 1) + 1)])
            out = [*batch.columns, pa.array(model.probability(np.array(x).reshape(-1, 4)))]
            if passages_col:
                out.append(pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.mapInArrow(run, schema)
