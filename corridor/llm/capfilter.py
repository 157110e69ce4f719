"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form a structured random product code: the vector is rotated at random and cut into two
halves, each half has its own codebook of random unit vectors, and a filter is one word from each, so m * m
directions cost two small matrix products.  A vector belongs to every filter whose direction it exceeds
``t`` standard deviations along; list decoding combines only those words of a half whose score suffices
with the best one of the other half.  Vectors that share a filter are compared, in double precision where
single precision does not tell.

Sizes follow from the number n of different vectors and from the distribution of a coordinate on the sphere of their
dimension: t is such that a filter holds about ``HELD`` unrelated vectors (more where caps that narrow would not hold
both of a pair), and m such that a pair at the threshold shares ``SHARE`` filters of a code on average.  Filters of a
code depend on each other, so the share of random pairs at the threshold that a code misses is measured, and there are
as many independent codes as bring it below ``MISS``.

Equal vectors collapse before; filters with many members are cut into blocks and pairs of blocks meet.
Vectors are listed with their filters once; then passes over ranges of filters send each range's members to where they
meet, packed by target, so a shuffle never holds much more than the vectors once, and goes with its pass.
Each pair is counted in the smallest filter that both are in, so links need not be listed: every block
emits a count of links for a vector and a spanning forest, which grow with its members alone.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, lgamma, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U64, mix
from .common import discard, lists, one_core_each, saved, whole
from .components import connected

HELD, SHARE, MISS, BLOCK, SEED = 256.0, 0.5, 1e-6, 512, 20240501
NARROW, PAIRS, CELLS, AT_ONCE = 0.1, 2000, 1 << 21, 256 << 20


def _density(a: np.ndarray, dim: int) -> np.ndarray:
    """Density of a coordinate of a random unit vector; three dimensions or more."""
    return exp(lgamma(dim / 2) - lgamma((dim - 1) / 2)) / sqrt(pi) * np.maximum(1 - a * a, 0) ** ((dim - 3) / 2)


def _tail(s: np.ndarray, dim: int) -> np.ndarray:
    """P(coordinate > s) for a random unit vector."""
    a = np.sin(np.linspace(0, pi / 2, 20001))
    f = _density(a, dim)
    up = np.concatenate([[0], np.cumsum(((f[1:] + f[:-1]) / 2 * np.diff(a))[::-1])])[::-1]
    v = np.interp(np.abs(s), a, up)
    return np.where(np.asarray(s) >= 0, v, 1 - v)


def _joint(s: float, c: float, dim: int) -> float:
    """P(both of two random unit vectors with cosine c exceed s along a direction)."""
    a = np.linspace(s, 1, 4002)[:-1]
    f = _density(a, dim) * _tail(np.clip((s - c * a) / np.sqrt((1 - c * c) * (1 - a * a)), -1, 1), dim - 1)
    return float(((f[1:] + f[:-1]) / 2).sum() * (a[1] - a[0]))


def pairs_at(count: int, dim: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors with that cosine; equal vectors in one dimension."""
    rng = np.random.default_rng(seed)
    x = _unit(rng.standard_normal((count, dim)))
    if dim == 1:
        return x, x
    z = rng.standard_normal((count, dim))
    z = _unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + sqrt(1 - cosine * cosine) * z


def sharing(x: np.ndarray, y: np.ndarray, t: float, m: int, which: int) -> np.ndarray:
    """Number of filters of a code that each x and its y share."""
    step, got = max(16, CELLS // m), []
    for k in range(0, len(x), step):
        both = [r * m * m + f for r, f in (decode(z[k : k + step], t, m, which) for z in (x, y))]
        got.append(np.bincount(np.intersect1d(*both) // (m * m), minlength=len(x[k : k + step])))
    return np.concatenate(got)


@lru_cache(maxsize=64)
def plan(n: int, dim: int, cosine: float) -> tuple[float, int, int]:
    """Threshold in standard deviations, words in each codebook and number of codes."""
    c = min(cosine, 0.999)
    s, m = 0.0, 2  # below four dimensions a half has hardly any directions
    if dim > 3:
        for k in range(1, 400):
            at = k / 400
            tail = float(_tail(at, dim))
            if n * tail < HELD or _joint(at, c, dim) < NARROW * tail:
                break
            s = at
        m = max(2, ceil(sqrt(SHARE / _joint(s, c, dim))))
    t = s * sqrt(dim)
    x, y = pairs_at(PAIRS, dim, c, SEED)
    missed = int((sharing(x, y, t, m, 0) == 0).sum())
    return t, m, max(2, ceil(log(MISS) / log(min(0.95, (missed + 2 * sqrt(missed + 1)) / PAIRS))))


@lru_cache(maxsize=64)
def code(dim: int, m: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random rotation and the two codebooks, the same everywhere."""
    rng = np.random.default_rng([SEED, dim, m, which])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    half = dim // 2
    books = [rng.standard_normal((m, k)) for k in (max(half, 1), max(dim - half, 1))]
    return q * np.sign(np.diag(r)), *(b / np.linalg.norm(b, axis=1, keepdims=True) for b in books)


def decode(x: np.ndarray, t: float, m: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Filters of each unit vector: (rows, filters), ordered by row and filter.  One filter for each row at least."""
    dim = x.shape[1]
    q, b1, b2 = code(dim, m, which)
    y = (x @ q).astype(np.float32)
    half = dim // 2
    # each score has the deviation sqrt(k / dim) for a half of k dimensions, so their sum is compared with t
    s1 = (y[:, :half] if half else np.zeros((len(x), 1), np.float32)) @ (b1.T * sqrt(max(half, 1))).astype(np.float32)
    s2 = y[:, half:] @ (b2.T * sqrt(dim - half)).astype(np.float32)
    least = np.float32(t)
    # words that suffice with the best one of the other half: few, and only these are combined
    r1, w1 = np.nonzero(s1 >= least - s2.max(axis=1)[:, None] - np.float32(1e-4))
    r2, w2 = np.nonzero(s2 >= least - s1.max(axis=1)[:, None] - np.float32(1e-4))
    n2 = np.bincount(r2, minlength=len(x))
    k = n2[r1]
    a = np.repeat(np.arange(len(r1)), k)
    b = np.arange(len(a)) + np.repeat((np.cumsum(n2) - n2)[r1] - (np.cumsum(k) - k), k)
    ok = s1[r1, w1][a] + s2[r2, w2][b] >= least
    a, b = a[ok], b[ok]
    r, f = r1[a], w1[a] * m + w2[b]
    bare = np.flatnonzero(np.bincount(r, minlength=len(x)) == 0)  # the best direction, if none is exceeded
    r = np.concatenate([r, bare])
    f = np.concatenate([f, s1[bare].argmax(axis=1) * m + s2[bare].argmax(axis=1)])
    o = np.lexsort((f, r))
    return r[o], f[o]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(u: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the pairs (u, w) of n things connect, fewer than n: each to the smallest of its component."""
    label = np.arange(n)
    while not np.array_equal(label[u], label[w]):
        least = np.minimum(label[u], label[w])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[w], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
    p = np.flatnonzero(label != np.arange(n))
    return p, label[p]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept.
    Vectors of different lengths do not link.  Rows come back as often as given; rows of one id are one vector that does
    not link with itself.  Rows with a null id link with nothing, have no component and are kept.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    one_core_each(spark)
    # Vectors travel in the width that they have; all arithmetic is in double precision.
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    valid = v.where(good).withColumn("v", F.transform("v", lambda c: c + F.lit(0).cast(kind)))
    reps = saved(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("m")))
    dims = {r[0]: r[1] for r in reps.groupBy(F.size("v").alias("d")).agg(F.count("*")).collect()}  # as many rows as there are lengths
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(dims.values()) // 16384 + 1)
    plans = {d: plan(n, d, cosine) for d, n in dims.items()}
    ids = {d: codes * m * m for d, (_, m, codes) in plans.items()}  # filters, numbered through all codes
    width, whole_number = ("int", np.int32) if all(k < 1 << 31 for k in ids.values()) else ("long", np.int64)
    real = np.float32 if kind == "float" else np.float64

    def filters(batches):
        for t in batches:
            sizes = np.diff(t.column(2).offsets.to_numpy())
            for d in np.unique(sizes):
                own = t.take(pa.array(np.flatnonzero(sizes == d)))
                t_, m, codes = plans[int(d)]
                step = max(16, min(1024, CELLS // m))
                for k in range(0, len(own), step):
                    cut = own.slice(k, step)
                    x = _unit(_matrix(cut.column(2)))
                    both = [decode(x, t_, m, c) for c in range(codes)]
                    r = np.concatenate([a for a, _ in both])
                    f = np.concatenate([b + c * m * m for c, (_, b) in enumerate(both)])
                    o = np.argsort(r, kind="stable")
                    yield pa.RecordBatch.from_arrays([*cut.columns, lists(f[o].astype(whole_number), np.bincount(r, minlength=len(cut)))], names=["rep", "m", "v", "filters"])

    listed = saved(reps.select("rep", "m", "v").repartition(n_parts).mapInArrow(filters, f"rep long, m long, v array<{kind}>, filters array<{width}>"))
    discard(reps)
    reps = listed.select("rep", "m", "v")

    def tallied(batches):
        got: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for d in np.unique(sizes):
                got.setdefault(int(d), []).append(batch.column(1).filter(pa.array(sizes == d)).flatten().to_numpy())
        for d, flat in got.items():
            f, n = np.unique(np.concatenate(flat), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), d, np.int32)), pa.array(f.astype(np.int64)), pa.array(n)], names=["d", "f", "n"])

    held = saved(listed.select("v", "filters").mapInArrow(tallied, "d int, f long, n long").groupBy("d", "f").agg(F.sum("n").alias("n")))
    hot = held.where(F.col("n") > BLOCK).toArrow()  # a row for BLOCK members at least
    hd, hf, hn = (hot.column(c).to_numpy() for c in ("d", "f", "n"))
    crowded = {int(d): (np.sort(hf[hd == d]), -(-hn[hd == d][np.argsort(hf[hd == d])] // BLOCK)) for d in np.unique(hd)}
    # Passes over ranges of filters, so that what lies in a shuffle at one time is about as large as the vectors.
    again = F.col("n") * F.ceil(F.col("n") / BLOCK)
    rows = {r["d"]: (r["n"], r["k"]) for r in held.groupBy("d").agg(F.sum("n").alias("n"), F.sum(again).alias("k")).collect()}
    size = np.dtype(real).itemsize
    volume = sum(k * (d * size + 40 + np.dtype(whole_number).itemsize * n / dims[d] / 2) for d, (n, k) in rows.items())
    passes = max(1, ceil(volume / max(AT_ONCE, sum(n * (d * size + 100) for d, n in dims.items()))))
    targets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(volume / passes) // (24 << 20) + 1)

    def sender(turn):
        def send(batches):
            for batch in batches:
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                for d in np.unique(sizes).tolist():
                    yield from dealt(batch.filter(pa.array(sizes == d)), d)

        def dealt(t, d):
            low, high = turn * ids[d] // passes, (turn + 1) * ids[d] // passes
            rep, m, x = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).flatten().to_numpy().reshape(-1, d)
            val, row = t.column(3).flatten().to_numpy(), np.repeat(np.arange(len(rep)), np.diff(t.column(3).offsets.to_numpy()))
            till = val < high  # smaller filters go along, to tell where a pair counts
            val, row = val[till], row[till]
            n = np.bincount(row, minlength=len(rep))
            start = np.cumsum(n) - n
            now = np.flatnonzero(val >= low)
            row, f = row[now], val[now].astype(np.int64)
            blocks = np.ones(len(f), np.int64)
            if d in crowded:
                names, many = crowded[d]
                at = np.minimum(np.searchsorted(names, f), len(names) - 1)
                blocks = np.where(names[at] == f, many[at], 1)
            mine = (mix(rep[row].view(U64)) % blocks.astype(U64)).astype(np.int64)
            row, f, mine = (np.repeat(z, blocks) for z in (row, f, mine))
            other = np.arange(len(f)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            i, j = np.minimum(mine, other), np.maximum(mine, other)
            p = (mix(mix(f.view(U64) + U64(d)) + mix((i << 32 | j).view(U64))) % U64(targets)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            row, f, i, j, mine, p = (z[order] for z in (row, f, i, j, mine, p))
            edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else np.zeros(1, int)
            out = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own = row[a:b]
                k = n[own]
                some = np.repeat(start[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                cols = (f[a:b], i[a:b], j[a:b], mine[a:b], rep[own], m[own], k)
                out.append((int(p[a]), d, np.stack(cols).tobytes(), x[own].tobytes(), val[some].tobytes()))
            for k in range(0, len(out), 256):
                part = out[k : k + 256]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in part], kinds) for c, kinds in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["p", "d", "head", "v", "filters"])

        return send

    def compare(batches):
        got = whole(batches)
        if got is None:
            return
        sizes = got.column("d").to_numpy()
        edges, counts = [], []
        for d in np.unique(sizes).tolist():
            own = got.filter(pa.array(sizes == d))
            head = np.concatenate([np.frombuffer(z, np.int64).reshape(7, -1) for z in own.column("head").to_pylist()], axis=1)
            f, i, j, mine, rep, mult, n = head
            x = _unit(np.frombuffer(b"".join(own.column("v").to_pylist()), real).reshape(-1, d).astype(np.float64))
            val = np.frombuffer(b"".join(own.column("filters").to_pylist()), whole_number)
            first, rough, slack = np.cumsum(n) - n, x.astype(np.float32), (d + 8) * 2e-7
            order = np.lexsort((j, i, f))
            cut = (f[order][1:] != f[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])
            starts = [0, *(np.flatnonzero(cut) + 1).tolist(), len(order)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                at = order[a:b]
                # single precision tells all but the pairs about the threshold, which double precision settles
                near = rough[at] @ rough[at].T
                hit = np.flatnonzero(near >= cosine - slack)
                u, w = hit // len(at), hit % len(at)
                ok = u < w
                if i[at[0]] != j[at[0]]:
                    ok &= mine[at[u]] != mine[at[w]]
                u, w = u[ok], w[ok]
                close = np.flatnonzero(near[u, w] < cosine + slack)
                ok = np.ones(len(u), bool)
                for k in range(0, len(close), 65536):
                    some = close[k : k + 65536]
                    ok[some] = np.einsum("ij,ij->i", x[at[u[some]]], x[at[w[some]]]) >= cosine
                u, w = u[ok], w[ok]
                if not len(u):
                    continue
                # a pair counts in the smallest filter that both are in
                linked, both = np.unique(np.concatenate([u, w]), return_inverse=True)
                k = n[at[linked]]
                flat = val[np.repeat(first[at[linked]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                whose = np.repeat(np.arange(len(linked)), k)
                smaller = flat < f[at[0]]
                if smaller.any():
                    names, col, often = np.unique(flat[smaller], return_inverse=True, return_counts=True)
                    shared = often > 1
                    col, whose = col[shared[col]], whose[smaller][shared[col]]
                    seen = np.zeros((len(linked), -(-int(shared.sum()) // 64) * 64), bool)
                    seen[whose, (np.cumsum(shared) - 1)[col]] = True
                    bits = np.packbits(seen, axis=1).view(U64)
                    p, q, step = both[: len(u)], both[len(u) :], (1 << 20) // max(1, seen.shape[1] // 64) + 1
                    before = np.concatenate([(bits[p[k : k + step]] & bits[q[k : k + step]]).any(axis=1) for k in range(0, len(u), step)])
                    u, w = u[~before], w[~before]
                n_ = np.bincount(u, weights=mult[at[w]], minlength=len(at)) + np.bincount(w, weights=mult[at[u]], minlength=len(at))
                hit = np.flatnonzero(n_)
                counts.append((rep[at[hit]], n_[hit].astype(np.int64)))
                p, q = _forest(u, w, len(at))
                edges.append((rep[at[p]], rep[at[q]]))
        if counts:
            r, n = (np.concatenate(c) for c in zip(*counts, strict=True))
            p, q = (np.concatenate(c) for c in zip(*edges, strict=True))
            cols = [pa.array(np.concatenate([r, p])), pa.concat_arrays([pa.array(n), pa.nulls(len(p), pa.int64())]), pa.concat_arrays([pa.nulls(len(r), pa.int64()), pa.array(q)])]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "n", "other"])

    found = None
    for turn in range(passes):
        packed = listed.mapInArrow(sender(turn), "p int, d int, head binary, v binary, filters binary")
        part = saved(packed.repartitionById(targets, "p").mapInArrow(compare, "rep long, n long, other long"))
        found = part if found is None else found.unionByName(part)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))).select(F.col("id").alias("rep"), "component")
    per = reps.join(links, "rep", "left").join(comps, "rep", "left").select("v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = valid.join(per, "v").select("vec_id", "n_links", "component_id")
    alone = v.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
