"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each document becomes its set of distinct word shingles (64-bit hashes) and the k smallest of them.
2. Documents with equal sets collapse to one class, whose smallest id stands for it.
3. Inverted lists: two sets with similarity >= t share at least ``need`` retained values, so only the
   ``k - need + 1`` globally rarest retained values of a document need a list (prefix filtering).  Very
   frequent values therefore get no list unless a document consists mostly of them.
4. Within a list the bottom-k sketch of the union estimates the similarity; only a spanning forest of the
   passing pairs is emitted, never all pairs.
5. The candidate groups meet with their whole texts and exact similarity on full sets confirms links; pairs
   that are already connected need no check, as only components are asked.

Lists and groups beyond a bounded size are cut into blocks (``linked``), so no task holds an unbounded one.

With k = 32 and need = 16 a pair at similarity 0.8 is missed with a probability below 1e-4; the estimate's
threshold is the same 16 of 32.  Sets of up to 32 shingles are kept whole, so there the overlap is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BYTE_LOWER, U64, buffers, chunks, mix, prefix, substring, words
from .common import lists, parts, saved, whole
from .components import connected

K, NEED, BLOCK, GROUP_BYTES = 32, 16, 1024, 4 << 20


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's n-word shingles: (flat values, count of each document).

    With fewer words the whole sequence is one shingle; a text without words has none.
    """
    docs = len(off) - 1
    s, e, d = words(data, off)
    w = substring(prefix(data, BYTE_LOWER), s, e)
    per = np.bincount(d, minlength=docs)
    first = np.concatenate([[0], np.cumsum(per)])
    sh = np.zeros(len(w), dtype=U64)
    for k in range(n):
        sh[: len(w) - k] = sh[: len(w) - k] * U64(0xD1342543DE82EF95) + w[k:]
    ok = np.arange(len(w)) + n <= first[d + 1] if len(w) else np.zeros(0, bool)
    value, owner = mix(sh[ok]), d[ok]
    few = np.flatnonzero((per > 0) & (per < n))  # short texts: the whole sequence, told apart by its length
    if len(few):
        h = per[few].astype(U64)
        for k in range(n - 1):
            more = np.flatnonzero(per[few] > k)
            h[more] = h[more] * U64(0xD1342543DE82EF95) + w[first[few[more]] + k]
        value, owner = np.append(value, mix(h)), np.append(owner, few)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.bincount(owner[keep], minlength=docs)


def sketches(docs: DataFrame, words_in_shingle: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, sig binary or null, sketch array<long> in unsigned order)."""

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for a, b in chunks(off):
                o = off[a : b + 1]
                value, count = shingle_sets(data[o[0] : o[-1]], o - o[0], words_in_shingle)
                first = np.concatenate([[0], np.cumsum(count)])
                p = prefix_sum(mix(value ^ U64(0x5851F42D4C957F2D)))
                q = prefix_sum(mix(value + U64(0x14057B7EF767814F)))
                sig = np.stack([p[first[1:]] - p[first[:-1]], q[first[1:]] - q[first[:-1]]], axis=1)
                kept = np.minimum(count, k)
                flat = value[np.repeat(first[:-1], kept) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)]
                blob = [x.tobytes() if c else None for x, c in zip(sig, count, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.array(blob, pa.binary()), lists(flat.view(np.int64), kept)],
                    names=["doc_id", "n_shingles", "sig", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig binary, sketch array<long>")


def prefix_sum(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])


def need(a: int, k: int, floor: int, percent: int) -> int:
    """How many of its retained values a set of a shingles shares with any similar set's, at least."""
    return math.ceil(a * percent / 100) if a <= floor else min(floor, math.ceil(min(a, k) * percent / 100))


def grouped(batches, keys: int, least: int = 2):
    """Tables of ``least`` rows or more of equal first ``keys`` columns, from a partition in any order."""
    got = whole(batches)
    if got is None:
        return
    cols = [got.column(i).to_numpy() for i in range(keys)]
    order = np.lexsort(cols[::-1])
    cut = np.zeros(len(order), dtype=bool)
    for c in cols:
        c = c[order]
        cut[1:] |= c[1:] != c[:-1]
    starts = np.concatenate([[0], np.flatnonzero(cut), [len(order)]])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= least:
            yield got.take(pa.array(np.sort(order[a:b])))


def estimate(one: np.ndarray, many: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Shared values within the bottom-k sketch of the union, of a sketch against rows padded with the maximum."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    inside = np.arange(many.shape[1])[None, :] < size[:, None]
    shared = (one[at] == many) & inside
    rank = np.arange(many.shape[1])[None, :] + np.searchsorted(one, many) - (np.cumsum(shared, axis=1) - shared)
    return (shared & (rank < k)).sum(axis=1)


def candidate_forest(ids: np.ndarray, sk: np.ndarray, size: np.ndarray, k: int, share: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose estimated similarity is at least ``share``."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            got = estimate(sk[x, : size[x]], sk[left], size[left], k)
            hit = got >= np.ceil(share * np.minimum(k, size[x] + size[left] - got))
            edges += [(int(ids[x]), int(y)) for y in ids[left[hit]]]
            queue += list(left[hit])
            left = left[~hit]
    return edges


def confirm(ids: np.ndarray, values: list[np.ndarray], k: int, share: float, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links 100 * |A & B| >= percent * |A | B| on full sets (sorted distinct hashes)."""
    n = len(ids)
    label, edges = np.arange(n), []
    sk = np.full((n, k), np.iinfo(np.uint64).max, dtype=U64)
    size = np.array([min(k, len(v)) for v in values])
    length = np.array([len(v) for v in values])
    for i, v in enumerate(values):
        sk[i, : size[i]] = v[:k]
    for x in range(1, n):
        near = (label[:x] != label[x]) & (100 * np.minimum(length[:x], length[x]) >= percent * np.maximum(length[:x], length[x]))
        left = np.flatnonzero(near)
        if not len(left):
            continue
        got = estimate(sk[x, : size[x]], sk[left], size[left], k)
        fit = got >= np.ceil(share * np.minimum(k, size[x] + size[left] - got))
        left = left[fit][np.argsort(-got[fit], kind="stable")]
        while len(left):
            y, left = left[0], left[1:]
            both = len(np.intersect1d(values[x], values[y], assume_unique=True))
            if 100 * both >= percent * (length[x] + length[y] - both):
                edges.append((int(ids[y]), int(ids[x])))
                label[label == label[x]] = label[y]
                left = left[label[left] != label[x]]
    return edges


_FOUND = "kind int, key long, u long, v long"


def _packed(kind: int, key: list[int], u: list[int], v: list[int]) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(u), kind), pa.int32()), *[pa.array(np.array(x, dtype=np.int64)) for x in (key, u, v)]]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "key", "u", "v"])


def _roots(ids: list[int], edges: list[tuple[int, int]]) -> list[int]:
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def linked(rows: DataFrame, limit: int, links, n: int) -> DataFrame:
    """Edges (u, v) that connect, within each key, what ``links`` finds between rows (key, id, weight, payload).

    ``links`` turns a table of (id, payload) rows into a forest of edges and skips what is connected already.  Keys
    beyond ``limit`` of weight are dealt with in three steps, none of which lists all pairs: blocks by a hash of the
    id; then one row for each group that a block came to; then the rows outside a key's main group, in blocks,
    against all rows of the key.  So each pair of rows either meets or is connected before, and a key whose rows are
    alike costs a number of comparisons in proportion to them.
    """
    total = saved(rows.groupBy("key").agg(F.sum("weight").alias("total")))  # so that the join deals out both sides
    parted = rows.join(total.select("key", F.ceil(F.col("total") / limit).alias("nb")), "key")
    parted = parted.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")))

    def within(batches):
        for g in grouped(batches, 2, 1):
            key, many = g.column("key")[0].as_py(), g.column("nb")[0].as_py() > 1
            edges = links(g) if len(g) > 1 else []
            if edges:
                yield _packed(0, [key] * len(edges), *map(list, zip(*edges, strict=True)))
            if many:
                ids = g.column("id").to_pylist()
                yield _packed(1, [key] * len(ids), ids, _roots(ids, edges))

    lay = ["key", "blk", "nb", "id", "payload"]
    one = saved(parted.select(*lay).repartition(n, "key", "blk").mapInArrow(within, _FOUND))
    edges = one.where("kind = 0").select("u", "v")
    large = one.where("kind = 1")
    if large.isEmpty():
        return edges

    def across(batches):
        for g in grouped(batches, 3, 2):
            got = links(g)
            if got:
                yield _packed(0, [0] * len(got), *map(list, zip(*got, strict=True)))

    def meet(df):
        return df.select("key", "i", "j", "id", "payload").dropDuplicates(["key", "i", "j", "id"]).repartition(n, "key", "i", "j").mapInArrow(across, _FOUND)

    # One row for each group of each block; in pairs of blocks again if these are many.
    heads = rows.join(large.where("u = v").select("key", F.col("u").alias("id")), ["key", "id"])
    heavy = saved(heads.groupBy("key").agg(F.ceil(F.sum("weight") / limit).alias("nb")))
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    heads = heads.join(heavy, "key").withColumn("a", F.pmod(F.xxhash64("id"), F.col("nb"))).withColumn("b", span("nb"))
    two = saved(meet(heads.withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b"))))
    edges = edges.unionByName(two.select("u", "v"))

    # What is not in its key's main group meets all rows of the key.
    comps = connected(edges).select("id", "component")
    label = saved(large.select("key", F.col("u").alias("id")).join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label")))
    sizes = label.groupBy("key", "label").agg(F.count("*").alias("m"))
    main = saved(sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("x")).select("key", F.col("x.label").alias("main")))
    out = saved(label.join(main, "key").where("label <> main").select("key", "id"))
    if out.isEmpty():
        return edges
    loose = rows.join(out, ["key", "id"])
    blocks = saved(loose.groupBy("key").agg(F.ceil(F.sum("weight") / limit).alias("nl")))
    sized = blocks.join(total.select("key", F.ceil(F.col("total") / limit).alias("nb")), "key")
    mine = loose.join(sized, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("nl"))).withColumn("j", span("nb"))
    all_ = rows.join(sized, "key").withColumn("j", F.pmod(F.xxhash64("id"), F.col("nb"))).withColumn("i", span("nl"))
    cols = ["key", "i", "j", "id", "payload"]
    three = saved(meet(mine.select(*cols).unionByName(all_.select(*cols))))
    return edges.unionByName(three.select("u", "v"))


def near_duplicates(docs: DataFrame, words_in_shingle: int = 5, percent: int = 80, k: int = K, floor: int = NEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Null and empty texts and texts without words have no shingle, link with nothing and are kept.  Equal
    texts share a class.  Other columns are ignored, whatever their names.  Ids are taken as unique; rows with a
    null id link with nothing and are kept.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts(docs, "text")
    share = floor / k
    sk = saved(sketches(docs, words_in_shingle, k).withColumn("sig", F.when(F.col("doc_id").isNotNull(), F.col("sig"))))
    # The smallest document of each set.
    reps = saved(sk.where("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("r"), F.count("*").alias("m")).select("sig", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("size"), F.col("r.sketch").alias("sketch"), "m"))
    values = reps.select("rep", F.explode("sketch").alias("value"))
    # Written out, so that the join deals both sides itself and can split a value that very many documents hold.
    common = saved(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    shared = values.join(common, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("rare"))  # k values at most
    least = F.when(F.col("size") <= floor, F.ceil(F.col("size") * percent / 100)).otherwise(F.least(F.lit(floor), F.ceil(F.least("size", F.lit(k)) * percent / 100)))
    posted = shared.join(reps.select("rep", "size", "sketch"), "rep").withColumn("lists", (F.size("sketch") - least + 1 - (F.size("sketch") - F.size("rare"))).cast("int"))
    posted = posted.where("lists > 0").select("rep", "size", "sketch", F.explode(F.slice("rare", F.lit(1), F.col("lists"))).alias("p"))
    posted = posted.select(F.col("p.value").alias("key"), F.col("rep").alias("id"), F.lit(1).cast("long").alias("weight"), F.col("sketch").alias("payload"))

    def propose(g: pa.Table) -> list[tuple[int, int]]:
        flat = g.column("payload").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        size = np.diff(flat.offsets.to_numpy())
        m = np.full((len(size), k), np.iinfo(np.uint64).max, dtype=U64)
        m[np.arange(k)[None, :] < size[:, None]] = flat.flatten().to_numpy().view(U64)
        return candidate_forest(g.column("id").to_numpy(), m, size, k, share)

    groups = saved(connected(linked(posted, BLOCK, propose, n)))
    # Whole texts of the candidates, by group.
    weight = groups.join(reps.select(F.col("rep").alias("id"), (F.col("size") * 8 + 64).alias("weight")), "id")
    texts = saved(weight.join(docs.withColumnRenamed("doc_id", "id"), "id").select(F.col("component").alias("key"), "id", "weight", F.col("text").alias("payload")))

    def verify(g: pa.Table) -> list[tuple[int, int]]:
        data, off = buffers(g.column("payload"))
        values = []
        for a, b in chunks(off):
            o = off[a : b + 1]
            v, c = shingle_sets(data[o[0] : o[-1]], o - o[0], words_in_shingle)
            values += np.split(v, np.cumsum(c)[:-1])
        ids = g.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        return confirm(ids[order], [values[x] for x in order], k, share, percent)

    comps = connected(linked(texts, GROUP_BYTES, verify, n)).select(F.col("id").alias("rep"), "component")
    final = reps.join(comps, "rep", "left").select("sig", F.coalesce("component", "rep").alias("comp"))
    return (
        sk.select("doc_id", "n_shingles", "sig")
        .join(final, "sig", "left")
        .select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
