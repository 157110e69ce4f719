"""Sequence packing along a Hilbert curve.

Each document's hashed token vector is projected to ``AXES`` dimensions; its cell's place on the Hilbert curve is the
sort key, so similar documents lie side by side.  Keys alone (no token ids) are range-sorted by (place, hash of the id,
id, row), so copies can be split anywhere; running totals within each range and one total a range of ``RANGE`` rows give
every document its place in one stream of ids.  A document is then cut where the stream crosses a multiple of
``length``, by itself: ids are shuffled once, to their row's place, and never sorted along the curve.

Null texts count as empty and hold the end id alone.  Rows with a null id and repeated rows are packed as often as given.
Every id lies in one piece; all sequences but the last are full.  Extra columns are ignored, whatever their names; an
empty table has no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import buffers, chunks
from .common import saved
from .tokens import forget, vocabulary_path, word_ids

AXES, BITS, SLOTS, RANGE, PART = 4, 12, 8192, 1 << 20, 1 << 24


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate (Skilling's transform)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def places(ids: np.ndarray, count: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents from the mean direction of their tokens."""
    first = np.cumsum(count) - count
    mean = np.add.reduceat(directions[ids % SLOTS], first, axis=0) / count[:, None] if len(count) else np.zeros((0, AXES))
    cell = np.floor((0.5 + np.arctan(4 * mean) / np.pi) * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cell, 0, (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, place, n, ids) of each document; ids as 16-bit numbers if they fit."""
    directions = np.random.default_rng(11).standard_normal((SLOTS, AXES)).astype(np.float32)

    def run(batches):
        words = word_ids(path)
        for batch in batches:
            data, off = buffers(batch.column(1))
            for a, b in chunks(off, 1 << 21):
                o = off[a : b + 1]
                ids, count = words.encode(data[o[0] : o[-1]], o - o[0])
                place = places(ids, count, directions)
                end = np.cumsum(count)
                blobs = [ids[x:y].astype(np.uint16).tobytes() if not len(ids[x:y]) or ids[x:y].max() < 65536 else ids[x:y].astype(np.uint32).tobytes() for x, y in zip(end - count, end, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(place), pa.array(count), pa.array(blobs, pa.binary())], names=["doc_id", "place", "n", "ids"])

    return docs.mapInArrow(run, "doc_id long, place long, n long, ids binary")


def packed(docs: DataFrame, length: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or vocabulary_path()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokenised(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path)
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), codec="zstd")
    count, total = rows.agg(F.count("*"), F.sum("n")).first()
    n = max(least, int(total or 0) // PART + 1)

    def running(batches):
        from pyspark import TaskContext

        forget()
        here, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(1).to_numpy()
            end = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(size), here, np.int64)), pa.array(end - size), batch.column(1)], names=["row", "range", "at", "n"])
            at = int(end[-1]) if len(end) else at

    keys = rows.select("row", "n", "place", "doc_id", F.xxhash64("doc_id").alias("spread"))
    order = ["place", "spread", "doc_id", "row"]
    sorted_ = keys.repartitionByRange(max(least, count // RANGE + 1), *order).sortWithinPartitions(*order).select("row", "n")
    placed = saved(sorted_.mapInArrow(running, "row long, range long, at long, n long"))  # written: ranges are found by sampling
    totals = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect())  # one number for RANGE rows
    before = dict(zip([k for k, _ in totals], np.cumsum([0] + [x for _, x in totals])[:-1].tolist(), strict=True))

    def from_start(batches):
        forget()
        for batch in batches:
            start = np.array([before[k] for k in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(2).to_numpy() + start)], names=["row", "at"])

    starts = placed.select("row", "range", "at").mapInArrow(from_start, "row long, at long").repartition(n, "row")
    both = rows.select("row", "doc_id", "n", "ids").repartition(n, "row").join(starts.hint("merge"), "row").select("doc_id", "n", "ids", "at")

    def pieces(batches):
        forget()
        for batch in batches:
            doc, size, at = (batch.column(k) for k in (0, 1, 3))
            size, at = size.to_numpy(), at.to_numpy()
            many = (at + size - 1) // length - at // length + 1
            of = np.repeat(np.arange(len(size)), many)
            seq = np.repeat(at // length, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first, end = np.maximum(seq * length, at[of]), np.minimum((seq + 1) * length, (at + size)[of])
            start, k = first - at[of], end - first
            blobs, edge, sums = batch.column(2).to_pylist(), np.cumsum(many), []
            for blob, ids, a, b in zip(blobs, size.tolist(), (edge - many).tolist(), edge.tolist(), strict=True):
                raw = memoryview(np.frombuffer(blob, np.uint16 if len(blob) == 2 * ids else np.uint32).astype("<u4").tobytes())
                sums += [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(start[a:b].tolist(), k[a:b].tolist(), strict=True)]
            cols = [doc.take(pa.array(of)), *[pa.array(c, pa.int64()) for c in (start, k, sums, size[of], seq, first % length)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return both.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
